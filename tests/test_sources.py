"""Feeds, sinks and streams over small files."""

import gzip
import json

from pyspark.sql import functions as F

from lakeloom.operators import upsert
from lakeloom.sources import readers, writers
from lakeloom.streaming import updates


def test_positional_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Ann,"x,y",3.9,abc\nBob,z\n,q,,7\n')
    got = readers.positional_csv(spark, str(tmp_path / "a.csv"), {"name": (0, "string"), "n": (2, "int"), "x": (3, "double")}, 4).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("Ann", 3, None), (None, None, 7.0)], key=str)


def test_positional_json(spark, tmp_path):
    text = json.dumps([["a", 1, "2026-01-01"], ["b", "7"], ["c", "3.9", None]])
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(text)
    got = readers.positional_json(spark, str(tmp_path / "a.json.gz"), {"k": (0, "string"), "n": (1, "int"), "d": (2, "string")}, 3, ["d"]).collect()
    assert list(map(tuple, got)) == [("a", 1, "2026-01-01")]


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"meta":{"x":1},"teams":{"t1":{"id":"1"},"t2":{"id":"2"}}}'), (2, '{"rows":[{"id":"3"},{"id":"4"},{"id":"5"}]}'), (3, '{"meta":{}}'), (4, None)], "i int, p string")
    got = readers.payload_rows(df, "p", "struct<id:string>").select("i", "row.id").collect()
    assert sorted(map(tuple, got)) == [(1, "1"), (1, "2"), (2, "3"), (2, "4"), (2, "5")]


def test_cache_and_nulls(spark, tmp_path):
    c = spark.sql("select 'e' endpoint, 'h' params_hash, 'old' response, timestamp'2026-01-01' fetched_at, timestamp'2026-01-03' expires_at union all select 'e','h','new',timestamp'2026-01-02',timestamp'2026-01-03' union all select 'e','g','gone',timestamp'2026-01-01',timestamp'2026-01-01'")
    c.write.parquet(str(tmp_path / "c"))
    assert [r["response"] for r in readers.cached(spark, str(tmp_path / "c"), F.lit("2026-01-02 12:00:00").cast("timestamp")).collect()] == ["new"]
    (tmp_path / "p.csv").write_text("id,x\n1,NA\n2,\n3,1.5\n4,NaN\n")
    assert [r["x"] for r in readers.csv_with_nulls(spark, str(tmp_path / "p.csv"), "id int, x double").orderBy("id").collect()] == [None, None, 1.5, None]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    writers.write_seasons(spark.createDataFrame([(1, 2025), (2, 2026)], "v int, season int"), p)
    writers.write_seasons(spark.createDataFrame([(9, 2026)], "v int, season int"), p)
    assert sorted((r["v"], r["season"]) for r in readers.slices(spark, p, [2025, 2026]).collect()) == [(1, 2025), (9, 2026)]
    for n in (1, 2):
        writers.publish(spark, {"a": spark.range(n)}, str(tmp_path / "pub"))
        assert writers.published(spark, str(tmp_path / "pub"), "a").count() == n


def test_publish_has_no_gap(spark, tmp_path):
    """Whoever reads finds a whole set at any time, also one that was found before the next was named."""
    p = str(tmp_path / "p")
    writers.publish(spark, {"a": spark.range(1), "b": spark.range(10)}, p)
    before = writers.published(spark, p, "a")
    for n in (2, 3):
        writers.publish(spark, {"a": spark.range(n), "b": spark.range(10 * n)}, p)
        if n == 2:
            assert before.count() == 1
        assert (writers.published(spark, p, "a").count(), writers.published(spark, p, "b").count()) == (n, 10 * n)
    assert sum(x.name.startswith("set-") for x in (tmp_path / "p").iterdir()) == 2


def test_cache_entries_expire(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    cache = spark.sql("select 'e' endpoint, 'h' params_hash, 'old' response, timestamp'2026-01-01' fetched_at, timestamp'2026-01-03' expires_at")
    new = spark.createDataFrame([("e", "h", "new"), ("e", "g", "other")], "endpoint string, params_hash string, response string")
    both = writers.cache_put(cache, new, 60.5, at("2026-01-02 00:00:00"))
    assert sorted((r["params_hash"], r["response"], str(r["expires_at"])[:22]) for r in both.collect()) == [("g", "other", "2026-01-02 00:01:00.50"), ("h", "new", "2026-01-02 00:01:00.50")]
    assert writers.cache_purge(both, at("2026-01-02 00:01:01")).count() == 0 and writers.cache_purge(both, at("2026-01-02 00:01:00")).count() == 2
    assert writers.cache_clear(both).count() == 0


def test_upsert_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, at int, v int"
    for n, batch in enumerate(([(1, 1, 10), (1, 2, None), (2, 1, 5)], [(2, 2, 6), (3, 1, 7)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        q = updates.upsert_stream(spark.readStream.schema(schema).parquet(src), out, ["k"], ["at"], str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, updates.current(spark, out).collect())) == [(1, 10), (2, 6), (3, 7)]


def test_late_dimension_and_expiry(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "team int, t timestamp, v int"
    dim = spark.createDataFrame([(1, "known")], "team int, name string")
    at = lambda m: f"2026-01-01 00:{m:02d}:00"
    for batch in ([(1, at(0), 1), (2, at(1), 1), (2, at(2), 2)], [(2, at(3), 1), (3, at(4), 9), (None, at(5), 0)]):
        spark.createDataFrame(batch, "team int, t string, v int").selectExpr("team", "cast(t as timestamp) t", "v").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        updates.late_dimension(stream, dim, "team", out, str(tmp_path / "cp"), {"name": "new"}).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, updates.current(spark, out).collect())) == [(1, "known"), (2, "new"), (3, "new")]
    q = updates.unexpired(spark.readStream.schema(schema).parquet(src), "t", ["team"], "1 hour").writeStream.format("memory").queryName("w0").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(str(r["team"]) for r in spark.table("w0").collect()) == ["1", "2", "3", "None"]


def test_windowed_and_state(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select 'a' k, timestamp'2026-01-01 00:10:00' t, 1.0D v union all select 'a', timestamp'2026-01-01 00:50:00', 3.0D union all select 'a', timestamp'2026-01-01 01:05:00', 5.0D").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, t timestamp, v double").parquet(src)
    q = updates.windowed(stream, "t", ["k"], "v").writeStream.format("memory").queryName("w1").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["total"]) for r in spark.table("w1").collect()) == [(1, 5.0), (2, 4.0)]
    q = updates.rolling_state(stream, "k", "t", "v").writeStream.format("memory").queryName("w2").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["prior_mean"] for r in spark.table("w2").orderBy("t").collect()] == [None, 1.0, 2.0]


def test_last_wins_keeps_values_behind_nulls(spark):
    b = spark.createDataFrame([(1, 1, 5), (1, 2, None)], "k int, at int, v int")
    assert upsert.last_wins(b, ["k"], ["at"]).first()["v"] == 5
