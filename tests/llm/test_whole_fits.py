"""What is learned comes from all rows, and what is stored between stages is small."""

import random
import subprocess

import numpy as np

from lakeloom.llm import quality
from lakeloom.sources.tables import stored

from .conftest import prose


def fitted(x, y, ridge=1.0):
    """Ridge logistic regression on standardised columns by plain Newton steps: the probability of each row."""
    z = np.hstack([(x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), np.ones((len(x), 1))])
    b, pull = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z.T * (q * (1 - q))) @ z + np.diag(pull), z.T @ (y - q) - pull * b)
    return 1 / (1 + np.exp(-np.clip(z @ b, -12, 12)))


def test_the_classifier_learns_from_every_label(spark):
    """More labels than the 20,000 that a bounded fit saw: evidence is that of a fit on all of them, however rows are dealt."""
    rng = random.Random(41)
    texts = [" ".join(rng.choice(["word", "Stone", "UP", "7", "a!b", "x|y", "...", "longer"]) for _ in range(rng.choice([2, 4, 8]))) for _ in range(24_000)]
    given = [int(rng.random() < (0.2 if "UP" in t else 0.7)) for t in texts]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").repartition(6)
    labels = spark.createDataFrame([*enumerate(given), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["p_doc"] for r in quality.score(docs, labels).select("doc_id", "p_doc").collect()}
    want = fitted(np.array([quality.features(t) for t in texts]), np.array(given, float))
    assert np.abs(np.array([got[i] for i in range(len(texts))]) - want).max() < 1e-6
    again = quality.score(docs.repartition(3), labels).select("doc_id", "p_doc").collect()
    assert {r["doc_id"]: r["p_doc"] for r in again} == got


def test_stored_texts_take_less_disk_than_plain_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 900)) for i in range(400)], "id long, text string").repartition(1)
    docs.write.option("compression", "snappy").parquet(str(tmp_path / "plain"))
    table = stored(docs, "texts")
    size = lambda path: int(subprocess.run(["du", "-sb", path], capture_output=True, check=True).stdout.split()[0])
    assert size(table.inputFiles()[0].removeprefix("file://")) < 0.8 * size(str(tmp_path / "plain"))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, docs.collect()))
