"""Quality by hierarchical empirical Bayes: a document classifier's evidence, with priors of its site and of its path within the site.

One pass turns each text into a few numbers (shares of character classes, word statistics). A logistic model of them is fitted on all
labelled rows; it gives each document's evidence. Grouped sums of that evidence by (host, path) give the variance between
hosts, between paths of a host, and within paths; from these, shrinkage constants (Buhlmann-Straub): a site of n documents keeps
n / (n + k) of its own mean, the rest comes from the level above, so a sparse site takes the global prior. The document's log odds
then move by the difference of its path's prior and the global one. A document's own evidence is left out of the priors that move it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_rows, short_batches, stored
from lakeloom.llm.textstats import WINDOW, code_points

NAMES = ("upper", "digit", "space", "mark", "symbol", "other", "bang", "bar", "newline", "symbol_ends", "log_chars", "word_chars", "word_variety", "long_words", "repeats")


@dataclass(frozen=True)
class Params:
    ridge: float = 1.0
    rounds: int = 25
    prior_weight: float = 1.0
    cut: float = 0.5


def _classes() -> np.ndarray:
    """Class of each code point below 0x250: 0 other, 1 lower or unclassed letter, 2 upper, 3 digit, 4 space, 5 mark of prose, 6 symbol."""
    out = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        c = chr(i)
        out[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:'\"-()?" else 6 if c.isprintable() else 0
    return out


_CLASS = _classes()


def features(text: str | None) -> list[float]:
    """NAMES for a text; null and empty texts have zeros. All of the text counts."""
    if not isinstance(text, str) or not text:
        return [0.0] * len(NAMES)
    n, count, bang, bar, newline, ends, sym_ends = 0, np.zeros(7), 0, 0, 0, 0, 0
    for at in range(0, len(text), WINDOW):
        cps = code_points(text[at : at + WINDOW + 1])
        cls = np.where(cps < 0x250, _CLASS[np.minimum(cps, 0x24F)], 1)
        last = (cls[:-1] != 4) & (cls[1:] == 4)
        ends += int(last.sum())
        sym_ends += int((last & (cls[:-1] == 6)).sum())
        own = cls[:WINDOW]
        count += np.bincount(own, minlength=7)
        n += len(own)
        bang += int((cps[:WINDOW] == 33).sum())
        bar += int((cps[:WINDOW] == 124).sum())
        newline += int((cps[:WINDOW] == 10).sum())
    words = text.split()
    w = max(len(words), 1)
    kinds = set(words)
    chars = max(n - count[4], 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [count[2] / chars, count[3] / chars, count[4] / n, count[5] / chars, count[6] / chars, count[0] / n, bang / w, bar / w, newline / w, sym_ends / max(ends, 1), float(np.log1p(n)), chars / w, len(kinds) / w, sum(len(x) > 20 for x in kinds) / w, 1 - pairs / max(w - 1, 1) if w > 1 else 0.0]


def _exact(c: Column) -> Column:
    """A sum of decimals, which does not depend on the order of rows, so reruns agree."""
    return F.sum(c.cast("decimal(38,12)")).cast("double")


def _slopes(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log likelihood at b, over all rows. What a row adds is taken in units of 2^-32, so sums are whole numbers and
    don't depend on how rows are dealt; standardised values are below the root of the number of rows, which keeps a task's sums in 64 bits."""
    k = len(b)

    def op(batches):
        total = np.zeros((k, k + 1), np.int64)
        for part in batches:
            z = np.hstack([(np.stack(part["x"].to_list()) - mean) / sd, np.ones((len(part), 1))])
            q = 1 / (1 + np.exp(-np.clip((z * b).sum(axis=1), -30, 30)))
            own = np.concatenate([z[:, :, None] * z[:, None, :] * (q * (1 - q))[:, None, None], (z * (part["y"].to_numpy(float) - q)[:, None])[:, :, None]], axis=2)
            total += np.rint(own * 2.0**32).astype(np.int64).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    out = np.zeros(k * (k + 1))
    for r in rows.mapInPandas(op, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():  # 272 numbers
        out[r["i"]] = float(r["s"]) / 2.0**32
    out = out.reshape(k, k + 1)
    return out[:, k], out[:, :k]


def logistic(rows: DataFrame, p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic model of y (0 or 1) by x (NAMES), by Newton's method on all rows. Each round is one aggregation."""
    xs, k = [F.get("x", F.lit(i)) for i in range(len(NAMES))], len(NAMES)
    n, ones, *sums = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), *[_exact(x) for x in xs]).first()
    if not n or ones in (0, n):  # nothing to tell apart
        rate = (ones + 1.0) / (n + 2.0)
        return np.zeros(k), float(np.log(rate / (1 - rate)))
    mean = np.array(sums) / n
    sd = np.sqrt(np.array(rows.agg(*[_exact((x - float(m)) * (x - float(m))) for x, m in zip(xs, mean, strict=True)]).first()) / n) + 1e-9
    b = np.zeros(k + 1)
    pull = np.append(np.full(k, p.ridge), 1e-6)
    for _ in range(p.rounds):
        up, curve = _slopes(rows, mean, sd, b)
        step = np.linalg.solve(curve + np.diag(pull), up - pull * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    w = b[:-1] / sd
    return w, float(b[-1] - w @ mean)


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL column, for tables that have one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return host, F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", row_col: str | None = None, p: Params = Params()) -> DataFrame:  # noqa: B008
    """(id, p_doc, host_posterior, path_posterior, p_quality, keep) for each row of docs; with row_col, that column (a long) too.

    Texts that are null or hold no word are not kept and have p_doc 0; they don't count for sites. A null host or path is a site of its own.
    Labels that are null are left out; without labels of both kinds every document has the same evidence. Rows without an id are scored
    as any other; rows that are alike get the same scores; an empty table gives an empty result. A hot host is only ever summed, and joined as rows of numbers, which may be split.
    """
    spark = docs.sparkSession
    short_batches(spark)

    def op(batches):
        for b in batches:
            out = b.drop(columns="text")
            out["x"] = [features(t) for t in b["text"]]
            out["empty"] = [not isinstance(t, str) or not t.strip() for t in b["text"]]
            yield out

    src = docs.select(F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    rows = stored(map_rows(src, op, "host string, path string, x array<double>, empty boolean", ("id", "row")), "quality")

    # the classifier
    given = labels.select(F.col(label_id).alias("lid"), F.col(label_col).cast("int").alias("y")).where("y is not null and lid is not null")
    known = stored(rows.where("not empty").join(given, F.col("id") == F.col("lid")).select("x", (F.col("y") > 0).cast("int").alias("y")), "quality-known")
    w, bias = logistic(known, p)
    terms = [F.lit(float(c)) * F.get("x", F.lit(i)) for i, c in enumerate(w)]
    logodds = F.least(F.greatest(sum(terms, F.lit(bias)), F.lit(-12.0)), F.lit(12.0))
    rows = rows.withColumn("l", logodds).withColumn("q", F.when(F.col("empty"), F.lit(0.0)).otherwise(F.round(_sigmoid(F.col("l")), 9)))

    # sums by path and by host; three variances
    paths = stored(rows.where("not empty").groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), _exact(F.col("q")).alias("s"), _exact(F.col("q") * F.col("q")).alias("s2")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), _exact(F.col("s")).alias("hs"), _exact(F.col("s") * F.col("s") / F.col("n")).alias("between"), _exact(F.col("s2")).alias("hs2"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    t = hosts.agg(
        F.sum("hn").alias("n"), _exact(F.col("hs")).alias("s"), _exact(F.col("hs2")).alias("s2"), F.sum("k").alias("paths"), F.count("*").alias("hosts"), _exact(F.col("between")).alias("of_paths"),
        _exact(F.col("hs") * F.col("hs") / F.col("hn")).alias("of_hosts"), _exact(F.col("hn") * F.col("hn")).alias("hn2"), _exact(F.col("n2") / F.col("hn")).alias("pn2"),
    ).first()
    total = t["n"] or 0.0
    mean = (t["s"] / total) if total else 0.5
    within = max((t["s2"] - t["of_paths"]) / max(total - t["paths"], 1), 1e-6) if total else 1.0
    path_var = max((t["of_paths"] - t["of_hosts"] - (t["paths"] - t["hosts"]) * within) / max(total - t["pn2"], 1e-9), 1e-9) if total else 1.0
    host_var = max((t["of_hosts"] - t["s"] ** 2 / total - (t["hosts"] - 1) * within) / max(total - t["hn2"] / total, 1e-9), 1e-9) if total else 1.0
    k_host, k_path = float(within / host_var), float(within / path_var)

    sites = hosts.select(F.col("host").alias("h"), "hs", "hn").join(paths, F.expr("h <=> host")).select("h", F.col("path").alias("p"), "hs", "hn", "s", "n")
    out = rows.join(sites, F.expr("host <=> h and path <=> p"), "left").fillna(0.0, ["hs", "hn", "s", "n"])
    q, one = F.col("q"), F.when(F.col("empty"), 0.0).otherwise(1.0)  # what the sums hold of the document itself; q is 0 where it is empty
    out = out.withColumn("host_posterior", (F.col("hs") - q + k_host * mean) / (F.col("hn") - one + k_host))
    path_post = (F.col("s") - q + k_path * F.col("host_posterior")) / (F.col("n") - one + k_path)
    final = F.when(F.col("empty"), F.lit(0.0)).otherwise(_sigmoid(F.col("l") + p.prior_weight * (_logit(path_post) - _logit(F.lit(float(mean))))))
    kept = [F.col("row").alias(row_col)] if row_col else []
    out = out.select(F.col("id").alias(id_col), *kept, F.col("q").alias("p_doc"), "host_posterior", path_post.alias("path_posterior"), final.alias("p_quality"))
    return out.withColumn("keep", F.col("p_quality") >= p.cut)
