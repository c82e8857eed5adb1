"""Secret scans: patterns for known forms, and a randomness test battery for tokens of unknown form. Column expressions only.

The battery takes every run of MIN_TOKEN and more characters of A-Z a-z 0-9 + / _ = -, infers the alphabet it is written in (decimal,
hexadecimal, letters, base36, base64) and tests it against uniform draws from that alphabet: chi-squared on symbol counts, the number of runs
above and below the middle symbol, and the correlation of neighbours. Fisher's method joins the three p-values; a token that uniform draws
explain (p >= PASS) is a candidate. How likely ordinary text of that length is to look as even (the lower tail of chi-squared under the
symbol frequencies of all texts of the table) is its p-value as a discovery; it shrinks with length. Benjamini-Hochberg at rate FDR is then applied within
each class of length, over all tokens of the table: p-values are counted in bins of a hundredth of a decade, which bounds the table
of cuts by classes * bins whatever the number of tokens, and rounds p upwards only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import stored
from lakeloom.llm.spans import bound, joined, located, pieces
from lakeloom.llm.spans import scan as folded

MIN_TOKEN = 20
PASS = 0.001
FDR = 0.05
#: p-values below 10^-MAX_DECADES share a bin; BINS to a decade.
MAX_DECADES, BINS = 30, 100


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: str  # a pattern that each text with a match holds
    least: int
    group: int  # the group whose length counts


#: Base kinds in order. Keywords are in either case.
KINDS = (
    Kind("assign", r"""(?=[psta])(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""", r"(?=[psta])(?:password|passwd|secret|token|api_?key)", 12, 2),
    Kind("access", r"AKIA[A-Z0-9]++", r"AKIA[A-Z0-9]", 18, 0),
    Kind("hex", r"[0-9a-f]{16,}+", r"[0-9a-f]{16}", 16, 0),
)
_ANY_CASE = {"assign"}
_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"

#: Alphabets in the order in which they are tried, and for each the sums of squares and cubes of the symbol frequencies of words, numbers
#: and paths. They count as PRIOR symbols of text beside what the table's texts hold, so that a small table does not go by a few letters.
ALPHABETS = (
    ("decimal", "0123456789", 0.2, 0.05),
    ("hexlower", "0123456789abcdef", 0.16, 0.032),
    ("hexupper", "0123456789ABCDEF", 0.16, 0.032),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 0.085, 0.0095),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.085, 0.0095),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 0.08, 0.009),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0.08, 0.009),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 0.07, 0.0072),
)
PRIOR = 1_000

SPANS = "array<struct<kind:string,start:int,end:int>>"


def _flag(kind: Kind, pattern: str) -> str:
    return f"(?i){pattern}" if kind.name in _ANY_CASE else pattern


def find_base(text: Column, kind: Kind) -> Column:
    length = lambda m: F.length(F.regexp_replace(m, _VALUE, "") if kind.group else m)
    spans = F.filter(located(text, _flag(kind, kind.pattern)), lambda s: length(s["m"]) >= kind.least)
    spans = F.transform(spans, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.rlike(text, F.lit(_flag(kind, kind.maybe))), spans).otherwise(F.array().cast(SPANS))


def normal_cdf(z: Column) -> Column:
    """Upper and lower tail of the standard normal by the five-term polynomial of Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.least(0.3989422804014327 * F.exp(-a * a / 2) * poly, F.lit(0.5))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def text_moments(texts: DataFrame) -> list[tuple[float, float]]:
    """For each of ALPHABETS the sums of squares and cubes of its symbols' frequencies in all texts (column t). One aggregation, a row a symbol."""
    symbols = texts.select(F.explode(F.split("t", "")).alias("c")).where(F.col("c").isin(list(ALPHABETS[-1][1])))
    count = {r["c"]: r["n"] for r in symbols.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row a symbol of the last alphabet
    out = []
    for _, abc, k2, k3 in ALPHABETS:
        own = [count.get(c, 0) for c in abc]
        n = sum(own)
        share = [c / max(n, 1) for c in own]
        out.append(((sum(f * f for f in share) * n + k2 * PRIOR) / (n + PRIOR), (sum(f**3 for f in share) * n + k3 * PRIOR) / (n + PRIOR)))
    return out


def _tests(tokens: DataFrame, moments: list[tuple[float, float]]) -> DataFrame:
    """Adds to tokens (m, ...) the alphabet, the three p-values under uniform draws, their joint p and p_text under text_moments()."""
    short = F.regexp_replace("m", "=+$", "")
    form = F.coalesce(*[F.when(F.length(F.translate("s", abc, "")) == 0, F.lit(i)) for i, (_, abc, _, _) in enumerate(ALPHABETS)], F.lit(len(ALPHABETS) - 1))
    learned = [(name, abc, *m) for (name, abc, _, _), m in zip(ALPHABETS, moments, strict=True)]
    at = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in learned]), F.col("form") + 1)
    t = tokens.withColumn("s", short).where(F.length("s") >= MIN_TOKEN).withColumn("form", form).withColumn("encoding", at(0)).withColumn("abc", at(1)).withColumn("k2", at(2)).withColumn("k3", at(3))
    t = t.withColumn("n", F.length("s").cast("double")).withColumn("k", F.length("abc").cast("double"))
    counts = F.transform(F.split("abc", ""), lambda c: F.length("s") - F.length(F.replace(F.col("s"), c, F.lit(""))))
    t = t.withColumn("sq", F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    t = t.withColumn("v", F.transform(F.filter(F.split("s", ""), lambda c: c != ""), lambda c: F.call_function("instr", F.col("abc"), c).cast("double")))
    # chi-squared: mean k - 1 and variance 2 (k - 1)(n - 1) / n under uniform draws
    chi = F.col("k") / F.col("n") * F.col("sq") - F.col("n")
    z_chi = (chi - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))
    # runs above and below the middle of the alphabet
    pairs = F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"), F.slice("v", 2, F.size("v") - 1).alias("b"))
    high = lambda x: x > F.col("k") / 2 + 0.5
    t = t.withColumn("pairs", pairs).withColumn("up", F.size(F.filter("v", high)).cast("double"))
    t = t.withColumn("runs", 1.0 + F.size(F.filter("pairs", lambda p: high(p["a"]) != high(p["b"]))))
    down = F.col("n") - F.col("up")
    mean = 1 + 2 * F.col("up") * down / F.col("n")
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    z_runs = F.when(var > 0, (F.col("runs") - mean) / F.sqrt(var)).otherwise(F.lit(9.0))
    # correlation of neighbours around the alphabet's middle: each product has variance ((k^2 - 1) / 12)^2
    mid = (F.col("k") + 1) / 2
    z_serial = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + (p["a"] - mid) * (p["b"] - mid)) / (F.sqrt(F.col("n") - 1) * (F.col("k") * F.col("k") - 1) / 12)
    two = lambda z: F.greatest(2 * normal_cdf(-F.abs(z)), F.lit(1e-30))
    t = t.withColumn("p_chi", F.greatest(normal_cdf(-z_chi), F.lit(1e-30))).withColumn("p_runs", two(z_runs)).withColumn("p_serial", two(z_serial))
    half = -(F.log("p_chi") + F.log("p_runs") + F.log("p_serial"))
    t = t.withColumn("p_random", F.exp(-half) * (1 + half + half * half / 2))
    # the sum of squared counts under the frequencies of text
    n, k2, k3 = F.col("n"), F.col("k2"), F.col("k3")
    text_mean = n * (n - 1) * k2 + n
    text_var = 4 * n * (n - 1) * (n - 2) * (k3 - k2 * k2) + 2 * n * (n - 1) * (k2 - k2 * k2)
    t = t.withColumn("p_text", F.greatest(normal_cdf((F.col("sq") - text_mean) / F.sqrt(text_var)), F.lit(10.0**-MAX_DECADES)))
    return t.withColumn("bin", F.floor(-F.log10("p_text") * BINS).cast("int")).withColumn("length_class", F.least(F.floor(F.log2(F.col("n") / MIN_TOKEN) * 2), F.lit(12)).cast("int"))


def _cuts(tokens: DataFrame) -> DataFrame:
    """Benjamini-Hochberg by length class: (length_class, cut), the lowest bin whose tokens are discoveries. A row a class at most."""
    bins = tokens.groupBy("length_class", "bin").agg(F.count("*").alias("c"), F.sum(F.when(F.col("p_random") >= PASS, 1).otherwise(0)).alias("hits"))
    up = W.partitionBy("length_class").orderBy(F.col("bin").desc())
    bins = bins.withColumn("rank", F.sum("hits").over(up)).withColumn("total", F.sum("c").over(W.partitionBy("length_class")))
    passed = F.pow(F.lit(10.0), -F.col("bin") / BINS) <= F.col("rank") / F.col("total") * FDR
    return bins.where(passed & (F.col("rank") > 0)).groupBy("length_class").agg(F.min("bin").alias("cut"))


_ORDER = [*(k.name for k in KINDS), "random"]


def _by_start(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    order = F.array(*[F.lit(k) for k in _ORDER])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).cast("int").alias("place"), s["end"].alias("end")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(F.element_at(order, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _outside(found: Column, base: Column) -> Column:
    """Found stretches (start, end) that lie in no base span, as spans of the kind random: one pass over both in order of their starts."""
    keyed = lambda x, new: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(new).alias("new"), s["end"].alias("end")))

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        span = F.array(F.struct(F.lit("random").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(s["new"] == 0, F.greatest(reach, s["end"])).otherwise(reach), F.when((s["new"] == 1) & (s["end"] > reach), span).otherwise(F.array().cast(SPANS))

    both = folded(F.sort_array(F.concat(keyed(base, 0), keyed(found, 1))), F.lit(0), step, SPANS)["out"]
    return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(both)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, base, random): arrays of spans (kind, start, end), by start and then kind; with `keep`, (kept, base, random), where kept is the
    whole row of docs as a struct, so that no name of its columns can clash.

    `random` are the battery's discoveries outside the base spans. Texts are read twice: for their symbols, then for spans and tokens, which go to the shared folder; tokens are
    tested, and cuts come back by broadcast (at most 13 rows). Null and empty texts have empty arrays; repeated rows and ids give a row
    each; an empty table gives an empty result.
    """
    kept = F.struct("*") if keep else F.col(id_col)
    rows = docs.select(kept.alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = _by_start(F.concat(*[find_base(F.col("t"), k) for k in KINDS]))
    tokens = F.when(F.rlike("t", F.lit(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN}}}")), located(F.col("t"), TOKEN)).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))
    found = stored(rows.select(F.monotonically_increasing_id().alias("row"), "kept", base.alias("base"), tokens.alias("tokens")), "secrets")
    tested = stored(_tests(found.select("row", F.explode("tokens").alias("x")).select("row", "x.*"), text_moments(rows)).select("row", "start", "end", "encoding", "length_class", "bin", "p_random"), "secret-tokens")
    real = tested.join(F.broadcast(_cuts(tested)), "length_class").where((F.col("bin") >= F.col("cut")) & (F.col("p_random") >= PASS))
    spans = real.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    random = _outside(F.coalesce("r", F.array().cast("array<struct<start:int,end:int>>")), F.col("base"))
    return found.join(spans, "row", "left").select(F.col("kept").alias("kept" if keep else id_col), "base", random.alias("random"))


def merged(base: Column, random: Column) -> Column:
    """All spans by start, kind: base kinds as listed, then random."""
    return _by_start(F.concat(base, random))


def scan_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, a digest of the base spans, and the list of all spans per row."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k.name)).cast("long").alias(f"n_{k.name}")
    return scan(docs, id_col, text_col).select(id_col, *[count(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(merged(F.col("base"), F.col("random"))).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced by `mask`. spans: by start; they may overlap. Linear in the text and its spans."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.array(F.struct(at.alias("start"), s["start"].alias("end")))
        return F.greatest(at, s["end"]), F.when(s["start"] < at, F.array().cast(cuts)).otherwise(gap)

    cuts = "array<struct<start:int,end:int>>"
    rest = lambda done: F.array(F.struct(done["state"].alias("start"), F.length(text).alias("end")))
    clean = bound(folded(spans, F.lit(0), step, cuts), lambda done: F.array_join(pieces(text, F.concat(done["out"], rest(done))), mask))
    return F.when(F.size(spans) == 0, text).otherwise(clean)
