"""Streams in several batches, with state and late rows, on files as the source."""

import pytest

from lattika.streaming import live


def feed(spark, tmp_path, schema, batches, build, mode):
    """What a query gives for batches of rows, each read as one file, in order."""
    src = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src / f"{n}"))
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(src))
    query = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: out.append(sorted(map(tuple, df.collect())))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return out


def test_cadence_keeps_the_last_output_between_batches(spark, tmp_path):
    batches = [[("a", 0.0), ("a", 1.0), ("b", 5.0)], [("a", 2.0), ("a", 2.5), ("b", 5.5)], [("a", 4.0), ("b", 7.0)]]
    got = feed(spark, tmp_path, "k string, t double", batches, lambda s: live.cadence(s, "k", "t", 2.0), "append")
    assert sorted(x for batch in got for x in batch) == [("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", 7.0)]


def test_history_is_bounded(spark, tmp_path):
    batches = [[("a", 1.0, 10.0)], [("a", 2.0, 20.0), ("a", 3.0, 30.0)], [("a", 2.5, 25.0)]]
    got = [b for b in feed(spark, tmp_path, "k string, t double, v double", batches, lambda s: live.history(s, "k", "t", "v", 2), "update") if b]
    assert got[-1] == [("a", 0, 3.0, 30.0), ("a", 1, 2.5, 25.0)] and all(len(b) <= 2 for b in got)


def test_live_reduction_of_windows(spark, tmp_path):
    batches = [[("2024-01-01 00:00:01", 1.0, 1.0), ("2024-01-01 00:00:05", 3.0, 0.5)], [("2024-01-01 00:01:30", 7.0, 1.0)], [("2024-01-01 00:03:00", 9.0, 1.0)], [("2024-01-01 00:00:02", 100.0, 1.0)], [("2024-01-01 00:09:00", 0.0, 1.0)]]
    build = lambda s: live.live_reduction(s.selectExpr("to_timestamp(t) AS t", "x", "w"), "t", "10 seconds", "1 minute", "x", "w", ["sum", "count"]).selectExpr("date_format(window.start, 'HH:mm') AS at", "sum", "count")
    got = sorted(x for b in feed(spark, tmp_path, "t string, x double, w double", batches, build, "append") for x in b)
    assert got[0] == ("00:00", 2.5, 1.5)  # the row that came too late is not in it
    assert ("00:01", 7.0, 1.0) in got and all(x[1] != 100.0 for x in got)


def test_a_missing_column_fails(spark, tmp_path):
    with pytest.raises(Exception):
        feed(spark, tmp_path, "k string, t double", [], lambda s: live.cadence(s, "missing", "t", 1.0), "append")
