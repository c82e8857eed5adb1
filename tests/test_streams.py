"""Streams by batches: expiring entries, ratings of shuffled games, refreshed dimensions, merges by bucket."""

import datetime
import random
from collections import Counter

import pytest

from lakeloom.operators import ratings
from lakeloom.sources.bucketed import BucketTable
from lakeloom.streaming import stateful, updates

T0 = datetime.datetime(2026, 1, 1)


def batches(spark, folder, schema, rows_of_each, start):
    """Feed batches of rows as files, one micro-batch each, to the query that start(stream) gives."""
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = start(stream)
    try:
        for rows in rows_of_each:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
    finally:
        q.stop()


def test_entries_expire_and_are_fetched_again(spark, tmp_path):
    stateful.use_rocksdb(spark)
    calls = tmp_path / "calls"

    def fetch(key):
        with open(calls, "a") as f:
            f.write(f"{key}\n")
        return f"body of {key}"

    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [[("a", at(0)), ("b", at(5)), ("a", at(30))], [("a", at(59)), ("b", at(66))], [("a", at(60))], [("c", at(7200))], [("a", at(7300))]]

    def start(stream):
        out = stateful.cached_stream(stream, "key", "at", fetch, 60, "1 minute")
        return out.writeStream.format("memory").queryName("served").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()

    batches(spark, tmp_path / "in", "key string, at timestamp", rows, start)
    got = sorted((r["at"], r["key"], r["served"]) for r in spark.table("served").collect())
    seconds = [(int((t - T0).total_seconds()), k, s) for t, k, s in got]
    assert seconds == [(0, "a", False), (5, "b", False), (30, "a", True), (59, "a", True), (60, "a", False), (66, "b", False), (7200, "c", False), (7300, "a", False)]
    assert Counter(calls.read_text().split()) == {"a": 3, "b": 2, "c": 1}


def test_ratings_of_shuffled_games(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rng = random.Random(2)
    games = []
    for i in range(160):
        day = i // 4
        home, away = rng.sample(range(8), 2)
        score = (None, None) if i % 31 == 0 else (rng.randint(50, 99), rng.randint(50, 99))
        games.append((2024 + i % 2, 1000 + i, T0 + datetime.timedelta(days=day), home, away, *score, i % 5 == 0))
    schema = "season int, game_id long, at timestamp, home_team_id long, away_team_id long, home_score int, away_score int, is_neutral_site boolean"
    want = {(r["season"], r["game_id"]): (r["home_elo"], r["away_elo"]) for r in ratings.elo(spark.createDataFrame(games, schema).withColumnRenamed("at", "game_date")).collect()}
    mixed = sorted(games, key=lambda g: (g[2] - T0).days + rng.uniform(0, 6))  # each within a week of its place
    end = [(s, 9999, T0 + datetime.timedelta(days=400), 0, 1, None, None, False) for s in (2024, 2025)]

    def start(stream):
        return stateful.elo_stream(stream, "7 days").writeStream.format("memory").queryName("elo").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()

    batches(spark, tmp_path / "in", schema, [mixed[i : i + 40] for i in range(0, 160, 40)] + [end, [end[0]]], start)
    got = {(r["season"], r["game_id"]): (r["home_elo"], r["away_elo"]) for r in spark.table("elo").collect() if r["game_id"] != 9999}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_dimension_is_refreshed(spark, tmp_path):
    dim = str(tmp_path / "dim")
    spark.createDataFrame([(1, "one")], "team int, name string").write.parquet(dim)

    def start(stream):
        return updates.enrich_stream(stream, lambda s: s.read.parquet(dim), "team", str(tmp_path / "out"), str(tmp_path / "missing"), str(tmp_path / "c")).start()

    spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "team int, x int").write.parquet(str(tmp_path / "in"))
    q = start(spark.readStream.schema("team int, x int").parquet(str(tmp_path / "in")))
    q.processAllAvailable()
    spark.createDataFrame([(2, "two")], "team int, name string").write.mode("append").parquet(dim)
    spark.createDataFrame([(2, 40), (1, 50)], "team int, x int").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    read = lambda p: sorted(str(tuple(r)) for r in spark.read.parquet(str(tmp_path / p)).select("team", "x", *(["name"] if p == "out" else [])).collect())
    assert read("out") == ["(1, 10, 'one')", "(1, 50, 'one')", "(2, 40, 'two')"] and read("missing") == ["(2, 20)", "(None, 30)"]


def test_merge_writes_only_what_it_touches(spark, tmp_path):
    schema = "id long, a string, b int"
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], buckets=16)
    rows = {i: (f"a{i}", i % 7) for i in range(200)}
    assert table.read() is None
    table.merge(spark.createDataFrame([(i, *v) for i, v in rows.items()], schema))
    before = table.manifest()["folders"]
    batch = [(3, "new", None), (777, "fresh", 1), (None, "no key", 2)]
    touched = table.merge(spark.createDataFrame(batch, schema), batch=5)
    after = table.manifest()["folders"]
    assert 1 <= len(touched) <= 2 and {int(k) for k in after if after[k] != before.get(k)} == set(touched)
    assert table.merge(spark.createDataFrame([(3, "again", 9)], schema), batch=5) == []  # has been merged
    rows |= {3: ("new", 3), 777: ("fresh", 1)}
    assert {r["id"]: (r["a"], r["b"]) for r in table.read().collect()} == rows
    table.vacuum()
    assert {r["id"]: (r["a"], r["b"]) for r in BucketTable(spark, str(tmp_path / "t"), ["id"], buckets=4).read().collect()} == rows
    assert len(list((tmp_path / "t" / "data").glob("*/__bucket=*"))) == len(after)


def test_merge_of_a_stream(spark, tmp_path):
    def start(stream):
        return updates.merge_stream(stream, str(tmp_path / "t"), ["id"], ["seq"], str(tmp_path / "c"), 8).start()

    batches(spark, tmp_path / "in", "id long, seq int, v string", [[(1, 1, "a"), (1, 2, None), (2, 1, "b")], [(2, 3, "c"), (3, 1, None)]], start)
    assert {(r["id"], r["v"]) for r in BucketTable(spark, str(tmp_path / "t"), ["id"]).read().collect()} == {(1, "a"), (2, "c"), (3, None)}
