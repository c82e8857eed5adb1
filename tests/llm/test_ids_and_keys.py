"""Ids of 64 bits with nulls among them, and keys under changing parallelism."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import decontaminate, jaccard, langid, media, merkle, mixing, pii, quality, secret_scan, substrings, tokencount

from .conftest import prose

IDS = [2**62 + i for i in (1, 3, 5, 7, 9, 11)] + [None, None, -(2**62) - 1]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """All in one batch: the first two and one without an id are near copies."""
    texts = [prose(1), prose(1).replace("river", "lake", 1), *[prose(k) for k in range(2, 6)], prose(1) + " end", None, prose(9)]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(IDS, texts, strict=True)], SCHEMA).coalesce(1)


def labels(spark):
    return spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(IDS)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name, run", [
    ("langid", lambda s, d: langid.predict(d, langid.fit(d))), ("pii", lambda s, d: pii.pii_digest(d)), ("media", lambda s, d: media.media_digest(d)), ("index", lambda s, d: media.index_media(media.write_media(d))),
    ("mix", lambda s, d: mixing.mix(d)), ("tokens", lambda s, d: tokencount.count_redactions(d)), ("secrets", lambda s, d: secret_scan.scan_digest(d)), ("quality", lambda s, d: quality.score(d, labels(s))),
    ("jaccard", lambda s, d: jaccard.jaccard_groups(d)), ("merkle", lambda s, d: merkle.tamper_digest(d)), ("windows", lambda s, d: substrings.dedup_digest(d)),
])
def test_ids_are_whole(spark, docs, name, run):
    out = run(spark, docs)
    assert dict(out.dtypes)["doc_id"] == "bigint"
    assert sorted(map(str, (r["doc_id"] for r in out.select("doc_id").collect()))) == sorted(map(str, IDS))


def test_links_and_leaks_by_whole_ids(spark, docs):
    got = jaccard.jaccard_groups(docs)
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id IS NOT NULL").toArrow())
    want = {r[0]: r for r in con.sql(jaccard.SQL).fetchall()}
    assert {r["doc_id"]: tuple(r) for r in got.where("doc_id IS NOT NULL").collect()} == want
    item = " ".join(prose(4).split()[20:70])
    bench = spark.createDataFrame([(2**62 + 21, item), (None, " ".join(prose(9).split()[20:70]))], "item_id long, text string").coalesce(1)
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert (2**62 + 9, 2**62 + 21) in hits and (-(2**62) - 1, None) in hits


def test_stages_keep_whole_ids(spark, docs, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing that any document holds in any part of it whatever")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r["doc_id"] for r in corpus_pipeline.near_dup_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [i for i in IDS if i != 2**62 + 3][:-3] + [None, -(2**62) - 1]))
    assert corpus_pipeline.leak_stage(spark, docs, str(tmp_path)).count() == len(IDS)
    assert {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()} <= set(IDS)
    assert corpus_pipeline.secret_stage(spark, docs.drop("n_chars"), str(tmp_path)).columns == ["doc_id", "text", "lang", "source"]


def test_keys_stay_when_tasks_change(spark, tmp_path, monkeypatch):
    """Many files, and another number of tasks for every job: the right copies stay."""
    rows = [(i, prose(i, 40) if i < 300 else prose(i - 300, 40), "en", "s", 1) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(13).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    texts = {r[0]: r[1] for r in rows}
    first = {}
    for r in jaccard.jaccard_groups(docs).collect():
        first.setdefault(r["component_id"], []).append(r["doc_id"])
    count = iter(range(10**6))
    write = type(docs.write).parquet

    def changing(self, *a, **b):
        spark.conf.set("spark.sql.files.minPartitionNum", str(1 + 5 * (next(count) % 3)))
        return write(self, *a, **b)

    monkeypatch.setattr(type(docs.write), "parquet", changing)
    try:
        out = corpus_pipeline.near_dup_stage(spark, docs, "").select("doc_id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r["doc_id"] for r in out) == sorted(map(min, first.values())) and all(r["text"] == texts[r["doc_id"]] for r in out)


def test_rows_without_an_id_are_dealt_out(spark):
    """Many rows of one source and size class without an id: no hash bucket holds more than its share."""
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    key = mixing.unit_hash(17, F.col("doc_id"), F.md5(F.col("text").cast("binary")))
    assert df.groupBy(F.floor(key / 2**32 * 40)).count().agg(F.max("count")).first()[0] < 200
    out = mixing.mix(df, group_rows=100).agg(F.sum("taken"), F.max("target")).first()
    assert abs(out[0] - out[1]) <= 2
