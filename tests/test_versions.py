"""The versioned table: late rows, runs that break off, readers that keep their version, restarts of a stream."""

import pytest

from solterra.sources import versions
from solterra.streaming import windows

SHAPE = "k string, at long, v double"


def table(spark, path, number=None):
    return {(r.k, r["at"]): r.v for r in versions.read_version(spark, path, SHAPE, number).collect()}


def test_newest_rows_count_and_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    assert table(spark, path) == {} and versions.manifest(spark, path) == (-1, {})
    batch = lambda *rows: spark.createDataFrame(rows, SHAPE)
    assert versions.merge_batch(batch(("a", 5, 1.0), ("b", 5, 2.0), (None, 1, 3.0), ("a", 4, 9.0)), path, ["k"], "at", 0, buckets=16)
    assert versions.merge_batch(batch(("a", 3, 7.0), ("b", 6, None)), path, ["k"], "at", 1, buckets=16)
    assert table(spark, path) == {("a", 5): 1.0, ("b", 6): None, (None, 1): 3.0}
    assert table(spark, path, 0) == {("a", 5): 1.0, ("b", 5): 2.0, (None, 1): 3.0}  # an earlier version stays
    of = versions.manifest(spark, path)[1]
    assert sorted(of.values()) == [0, 1, 1] and not versions.merge_batch(batch(("a", 99, 0.0)), path, ["k"], "at", 1, buckets=16)
    assert versions.merge_batch(batch().limit(0), path, ["k"], "at", 2, buckets=16) and len(table(spark, path)) == 3


def test_a_run_that_breaks_off_before_its_manifest_is_taken_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"k{i}", i, float(i)) for i in range(50)], SHAPE)
    versions.merge_batch(rows, path, ["k"], "at", 0, buckets=4)
    before = table(spark, path)
    more = spark.createDataFrame([(f"k{i}", 100 + i, 0.5) for i in range(20)], SHAPE)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(versions, "_put", stop)  # the buckets are written, the manifest isn't
        with pytest.raises(KeyboardInterrupt):
            versions.merge_batch(more, path, ["k"], "at", 1, buckets=4)
    assert (tmp_path / "t" / "v=1").exists() and table(spark, path) == before
    versions.merge_batch(more, path, ["k"], "at", 1, buckets=4)
    assert len(table(spark, path)) == 50 and sum(v == 0.5 for v in table(spark, path).values()) == 20


def test_a_stream_that_starts_again_adds_nothing(spark, tmp_path):
    source, path, offsets = (str(tmp_path / n) for n in ("in", "t", "offsets"))
    for part in range(3):
        spark.createDataFrame([(f"k{i}", 10 * (3 - part) + i, float(part)) for i in range(6)], SHAPE).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)
        windows.merge_late(stream, path, ["k"], "at", offsets, buckets=4).awaitTermination()
        assert table(spark, path) == {(f"k{i}", 30 + i): 0.0 for i in range(6)}
    assert versions.manifest(spark, path)[0] == 2
