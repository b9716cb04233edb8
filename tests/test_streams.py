"""Streams whose keys never expire, sinks that bear repeated batches, and versioned tables."""

import pytest
from pyspark.sql import functions as F

from tariffmill.sinks import export
from tariffmill.sinks.versions import VersionedTable
from tariffmill.streaming import jobs

ARRIVAL = "path string, day bigint, sha256 string"


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, ARRIVAL).write.mode("append").parquet(f"{folder}/inbox")
    inbox = spark.readStream.schema(ARRIVAL).parquet(f"{folder}/inbox")
    jobs.land(inbox, f"{folder}/landed", f"{folder}/checkpoint", ["day", "path"])
    return sorted(((r.sha256, r.path, r.day) for r in jobs.landed(spark, f"{folder}/landed").collect()), key=str)


def test_a_content_is_landed_once_for_all_time(spark, tmp_path):
    """Also one that comes again after a year, in a later run, or twice in one batch; of these the least path counts."""
    first = _arrive(spark, tmp_path, [("b", 0, "x"), ("a", 0, "x"), ("c", 0, "y"), ("d", 0, None)])
    assert first == sorted([("x", "a", 0), ("y", "c", 0), (None, "d", 0)], key=str)
    again = _arrive(spark, tmp_path, [("0", 9, "x"), ("e", 9, "z"), ("f", 400, "y")])
    assert again == sorted([*first, ("z", "e", 9)], key=str)


def test_a_batch_that_comes_again_lands_nothing_twice(spark, tmp_path):
    """The batch was written but not marked as done, as when the driver dies between both."""
    _arrive(spark, tmp_path, [("a", 0, "x"), ("b", 0, "y")])
    want = _arrive(spark, tmp_path, [("c", 9, "x"), ("d", 9, "z")])
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert _arrive(spark, tmp_path, [("e", 10, "z"), ("f", 10, "w")]) == sorted([*want, ("w", "f", 10)], key=str)


def test_first_arrivals_of_a_batch_table(spark):
    rows = spark.createDataFrame([("b", 1, "x"), ("a", 1, "x"), ("c", 0, "x"), ("d", 0, "y")], ARRIVAL)
    assert {tuple(r) for r in jobs.first_arrivals(rows, "sha256", ["day", "path"]).collect()} == {("x", 0, "c"), ("y", 0, "d")}


def _follow(spark, folder, rows):
    schema = "job_id string, event string, at string, event_id bigint"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/log")
    jobs.follow_jobs(spark.readStream.schema(schema).parquet(f"{folder}/log"), f"{folder}/status", f"{folder}/checkpoint", compact_every=2)
    return {tuple(r) for r in jobs.status_table(spark, f"{folder}/status").load().collect()}


def test_late_and_repeated_events_give_the_batch_result(spark, tmp_path):
    events = [(f"j{k % 4}", f"e{k % 3}", f"2024-01-{1 + k * 7 % 28:02d}", k) for k in range(40)]
    want = {tuple(r) for r in jobs.job_status(spark.createDataFrame(events, "job_id string, event string, at string, event_id bigint")).collect()}
    _follow(spark, tmp_path, events[25:] + events[30:])
    _follow(spark, tmp_path, events[:10])
    assert _follow(spark, tmp_path, events[5:30]) == want
    # The last batch comes again although its version was saved.
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert _follow(spark, tmp_path, events) == want


def _values(df):
    return sorted(((r["supplier_slug"], r["value"]) for r in df.collect()), key=str)


def _entries(spark, *pairs):
    return spark.createDataFrame(list(pairs), "supplier_slug string, value string")


def test_versions_latest_and_as_of(spark, tmp_path):
    store = export.template_store(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.load()
    assert export.save_supplier_templates(_entries(spark, ("a", "A"), ("a", "AA"), ("b", "B"), (None, "N")), store.path) == 0
    assert store.save(_entries(spark, ("a", "A2"), ("c", "C"), (None, "N2"))) == 1
    assert set(_values(store.load())) == {("a", "A2"), ("b", "B"), ("c", "C"), (None, "N2")} and store.load().count() == 4
    assert set(_values(store.load(0))) == {("a", "A"), ("a", "AA"), ("b", "B"), (None, "N")}
    assert store.compact() == 2 and len(store.commits()) == 1
    assert store.save(_entries(spark, ("b", "B3"))) == 3
    assert set(_values(store.load())) == {("a", "A2"), ("b", "B3"), ("c", "C"), (None, "N2")}
    assert set(_values(store.load(0))) == {("a", "A"), ("a", "AA"), ("b", "B"), (None, "N")}
    with pytest.raises(LookupError):
        store.load(9)


def test_a_failed_save_leaves_the_old_version(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "store"), ["supplier_slug"])
    store.save(_entries(spark, ("a", "A")))
    broken = _entries(spark, ("a", "A2")).withColumn("value", F.raise_error(F.lit("disk")).cast("string"))
    with pytest.raises(Exception, match="disk"):
        store.save(broken)
    assert _values(store.load()) == [("a", "A")]
    assert store.save(_entries(spark, ("b", "B"))) == 1 and _values(store.load()) == [("a", "A"), ("b", "B")]


def test_work_is_saved_once_by_its_token(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "store"), ["supplier_slug"])
    assert store.save(_entries(spark, ("a", "A")), token="one") == 0
    assert store.save(_entries(spark, ("a", "B")), token="one") == 0
    store.compact()
    assert store.save(_entries(spark, ("a", "C")), token="one") == 1  # the whole table keeps the token
    assert _values(store.load()) == [("a", "A")]


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    store = VersionedTable(spark, str(tmp_path / "store"), ["supplier_slug"])
    store.save(_entries(spark, ("a", "A")))
    before = store.commits()
    store.save(_entries(spark, ("a", "first")))
    slow = VersionedTable(spark, store.path, ["supplier_slug"])
    monkeypatch.setattr(slow, "commits", lambda until=None: before)
    with pytest.raises(FileExistsError):
        slow.save(_entries(spark, ("a", "second")))
    assert _values(store.load()) == [("a", "first")]
