import random

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

CLASHES = {
    "kept": "x", "text_hash": 1, "n_words": "y", "digest": 2.0, "row": 3, "node": "z", "size": "s",
    "shard": "t", "score": "u", "band": 4, "q_text": "v", "clean_text": "w", "keep_id": "k",
}


@pytest.fixture(scope="session")
def documents(spark):
    """``documents(rows)``: (doc_id, text) or (doc_id, text, source) rows with extra columns of clashing names."""
    def make(rows, clashes=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if clashes else df

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, blanks, a long text, repeated rows, ties and one word."""
    rng = random.Random(5)
    long_text = " ".join(prose(rng, 40_000))
    return [
        (None, None), (1, None), (2, ""), (3, " \t\n\x0b "), (4, long_text), (5, "a b c"), (5, "a b c"), (6, "word"), (None, "a b c"),
        (7, "A\x1cB c d"), (8, long_text), (9, None), (None, "only null"),
    ]
