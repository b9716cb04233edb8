import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tariffmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """``table(ddl, rows)``: a DataFrame; decimals may be given as numbers."""
    from decimal import Decimal

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def make(ddl, rows):
        schema = T.StructType.fromDDL(ddl)
        loose = T.StructType([
            T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, T.DecimalType) else f.dataType) for f in schema
        ])
        def fit(v, t):
            return float(v) if isinstance(t, T.DoubleType) and v is not None else v
        data = [tuple(fit(v, f.dataType) for v, f in zip(r, loose)) for r in rows]
        df = spark.createDataFrame(data, loose)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    make.decimal = Decimal
    return make
