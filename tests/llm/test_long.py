"""One text with very many matches or edits: time stays about linear."""

import time

from pyspark.sql import functions as F

from lakeloom.llm import pii, secret_scan, tokencount

N = 100_000


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_a_hundred_thousand_addresses(spark):
    df, start = one(spark, " ".join(f"a{i}@b.de" for i in range(N))), time.perf_counter()
    r = pii.pii_digest(df).first()
    assert r["n_email"] == N and r["spans"].endswith(f"email:{len(df.first()['text']) - 11}:{len(df.first()['text'])}")
    assert time.perf_counter() - start < 200


def test_a_hundred_thousand_secrets(spark):
    df, start = one(spark, " ".join(f"é token=abcdefghijk{i:06d};" for i in range(N))), time.perf_counter()
    r = secret_scan.scan_digest(df).first()
    assert r["n_assign"] == N and r["n_hex"] == 0
    clean = secret_scan.scan(df, keep=True).select(secret_scan.redact(F.col("kept.text"), secret_scan.merged(F.col("base"), F.col("random"))).alias("x")).first()["x"]
    assert clean == " ".join(["é [secret];"] * N)
    assert time.perf_counter() - start < 300


def test_a_hundred_thousand_edits():
    counter = tokencount.Counter(tokencount.read_ranks())
    text = " ".join(f"mail {10_000_000 + i} x" for i in range(N))
    tree, start = tokencount.CountTree(text, counter), time.perf_counter()
    for i in range(N - 1, -1, -1):
        tree.edit(i * 16 + 5, i * 16 + 13, "[num]")
    assert time.perf_counter() - start < 200
    assert tree.text == " ".join(["mail [num] x"] * N) and tree.total == len(counter.bpe.encode_ordinary(tree.text))


def test_edits_at_one_place():
    counter = tokencount.Counter(tokencount.read_ranks())
    tree, start = tokencount.CountTree("a b c " * 2000, counter), time.perf_counter()
    for _ in range(30_000):
        tree.edit(6000, 6000, "new ")
    assert time.perf_counter() - start < 60
    assert tree.total == len(counter.bpe.encode_ordinary(tree.text)) and tree.length[1] == 12_000 + 120_000
