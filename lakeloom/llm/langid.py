"""Language of texts: nearest clustered centroid of normalised TF-IDF character n-grams, by cosine, with distance-based rejection.

Training. Document frequencies of hashed n-grams are counted over all training rows. Centroids come from a bounded sample of them,
`per_lang` rows a language by hash: spherical k-means in one task a language, each language giving up to `clusters` unit centroids and the
cosine below which only `reject` of its sample lies. Prediction reads each text once and compares one sparse vector with the
centroids (languages * clusters * dims floats, checked against `model_bytes` before they are broadcast).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_rows, short_batches
from lakeloom.llm.textstats import WINDOW, windows

UND = "und"
ORDERS = (1, 2, 3)
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    dims: int = 1 << 13
    clusters: int = 3
    per_lang: int = 600
    rounds: int = 8
    reject: float = 0.005
    seed: int = 17
    model_bytes: int = 256 << 20


@dataclass(frozen=True)
class Model:
    langs: list[str]  # the language of each centroid
    centroids: np.ndarray  # centroid, dim
    floor: np.ndarray  # per centroid: cosines below are rejected
    idf: np.ndarray


def counts(text: str, dims: int) -> np.ndarray:
    """Hashed n-gram counts of a text in lower case, with runs of other than letters as one space."""
    out = np.zeros(dims)
    prepared = " " + _GAP.sub(" ", text.lower()) + " "
    for cps in windows(prepared, max(ORDERS) - 1):
        x = cps.astype(np.uint64)
        h = np.zeros(len(x), np.uint64)
        for n in ORDERS:
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint64(1_000_003) + x[n - 1 :] + np.uint64(n)
            mixed = h * _MIX
            out += np.bincount((mixed[:WINDOW] >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text, len(idf))) * idf
    return v / (np.sqrt(v @ v) or 1.0)


def cluster(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means of unit rows; the first centre is the mean, each next one the row farthest from those before."""
    mean = x.mean(axis=0)
    centres = [mean / (np.linalg.norm(mean) or 1.0)]
    while len(centres) < min(k, len(x)):
        near = (x @ np.array(centres).T).max(axis=1)
        centres.append(x[int(near.argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if len(part := x[own == j]):
                m = part.mean(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c


def _frequencies(train: DataFrame, dims: int) -> np.ndarray:
    """Number of training rows that hold each hashed n-gram; at its end the number of rows. All rows are read."""

    def op(batches):
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for text in b["text"]:
                df += counts(text, dims) > 0
                n += 1
        if n:
            yield pd.DataFrame({"dim": np.arange(dims + 1), "n": np.append(df, n)})

    summed = train.select("text").mapInPandas(op, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # dims + 1 rows
    out = np.zeros(dims + 1, np.int64)
    for r in summed:
        out[r["dim"]] = r["n"]
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", p: Params = Params()) -> Model:  # noqa: B008
    """Learn from rows with a text and a language. No such row: a model without centroids, which says `und` everywhere."""
    spark = labelled.sparkSession
    short_batches(spark)
    train = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    freq = _frequencies(train, p.dims)
    idf = np.log1p(freq[-1] / (1.0 + freq[:-1]))
    most = p.model_bytes // (p.clusters * p.dims * 4)
    per = train.groupBy("lang").count().limit(most + 1).collect()  # a row a language
    if len(per) > most:
        raise ValueError(f"more than {most} languages need more than {p.model_bytes} bytes; lower dims or clusters")
    if not per:
        return Model([], np.zeros((0, p.dims), np.float32), np.zeros(0), idf)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, p.per_lang / r["count"]))) for r in per])
    pick = F.pmod(F.xxhash64(F.lit(p.seed), F.col("id"), F.col("text")), F.lit(1 << 30)) < share * (1 << 30)
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches):
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "id": b["id"], "v": [vector(t, shared.value).astype(np.float32).tobytes() for t in b["text"]]})

    def centres(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["id", "v"]).head(2 * p.per_lang)
        x = np.array([np.frombuffer(v, np.float32) for v in g["v"]])
        c = cluster(x, p.clusters, p.rounds, p.seed)
        near = x @ c.T
        own = near.argmax(axis=1)
        floor = [float(np.quantile(near[own == j, j], p.reject)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": [g["lang"].iloc[0]] * len(c), "k": range(len(c)), "floor": floor, "c": [v.astype(np.float32).tobytes() for v in c]})

    sample = train.where(pick).mapInPandas(vectors, "lang string, id string, v binary")
    rows = sample.groupBy("lang").applyInPandas(centres, "lang string, k int, floor double, c binary").collect()  # a row a centroid
    rows.sort(key=lambda r: (r["lang"], r["k"]))
    return Model([r["lang"] for r in rows], np.array([np.frombuffer(r["c"], np.float32) for r in rows]).reshape(len(rows), p.dims), np.array([r["floor"] for r in rows]), idf)


def predict_text(text: str | None, m: Model) -> tuple[str, float, bool]:
    """Language, cosine in 0..1, and whether the distance to every centroid is more than the training rows have."""
    if not isinstance(text, str) or not _LETTER.search(text) or not m.langs:
        return UND, 0.0, True
    near = m.centroids @ vector(text, m.idf).astype(np.float32)
    best = int(near.argmax())
    score = float(min(max(near[best], 0.0), 1.0))
    return m.langs[best], score, bool(score < m.floor[best])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row, those that repeat among them. Null texts and texts without a letter: `und`, 0, rejected. Only the
    text is looked at; of centroids that are alike the first language counts; an empty table gives an empty result."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def op(batches):
        for b in batches:
            rows = [predict_text(t, shared.value) for t in b["text"]]
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])
            yield pd.concat([b.drop(columns="text").reset_index(drop=True), out], axis=1)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(src, op, "lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
