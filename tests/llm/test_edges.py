"""Every operator on messy, repeated and empty tables: nothing crashes, each row has its defined result, reruns agree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat, decontaminate, jaccard, langid, media, merkle, mixing, pii, quality, secret_scan, substrings, tokencount

BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def labels(spark, n=12):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(n)] + [(3, None, 0), (None, 1, 0), (3, 1, 0)], LABELS)


OPERATORS = {
    "langid": lambda s, d: langid.predict(d, langid.fit(d)),
    "pii": lambda s, d: pii.pii_digest(d),
    "media": lambda s, d: media.media_digest(d),
    "mix": lambda s, d: mixing.mix(d),
    "tokens": lambda s, d: tokencount.count_redactions(d),
    "secrets": lambda s, d: secret_scan.scan_digest(d),
    "quality": lambda s, d: quality.score(d, labels(s)),
    "jaccard": lambda s, d: jaccard.jaccard_groups(d),
    "merkle": lambda s, d: merkle.tamper_digest(d),
    "windows": lambda s, d: substrings.dedup_digest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_row(spark, messy, name):
    out = OPERATORS[name](spark, messy)
    assert out.columns.count("doc_id") == 1
    first = sorted(map(str, out.collect()))
    assert len(first) == messy.count()
    assert first == sorted(map(str, OPERATORS[name](spark, messy.repartition(3)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_edges(spark, messy):
    r = by_id(langid.predict(messy, langid.fit(messy)))
    assert {r[i]["lang_pred"] for i in (22, 23, 24, 27)} == {"und"} and r[28]["lang_pred"] in ("en", "de") and 0 <= r[28]["score"] <= 1
    nothing = langid.fit(messy.where("false"))
    assert {x["lang_pred"] for x in langid.predict(messy, nothing).collect()} == {"und"}


def test_languages_are_told_apart(spark):
    import random

    rng = random.Random(5)
    kinds = {"aa": "ka lo mi ten sura pel".split(), "bb": "zwij quorth blin xest".split()}
    text = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(2)) for _ in range(40))
    rows = [(i, text(k), k) for i, k in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = by_id(langid.predict(df, langid.fit(df.where("doc_id < 50"))))
    assert all(out[i]["lang_pred"] == k for i, _, k in rows)


def test_media_round_trip(spark, messy):
    texts = {r["doc_id"]: r["text"] for r in messy.collect()}
    for i, r in by_id(media.media_digest(messy)).items():
        raw = (texts[i] or "").encode()
        pad = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pad))
        assert r["payload_sha256"] == hashlib.sha256(pad).hexdigest() and r["tail_crc32"] == zlib.crc32(pad[-16:])
    both = media.write_media(messy)
    index = by_id(media.index_media(both))
    blob = {r["doc_id"]: bytes(r["media"]) for r in both.collect()}
    assert all(x["error"] is None and x["codec"] == "raw " for x in index.values())
    keys = index[28]["keyframes"]
    assert len(keys) == -(-index[28]["n_samples"] // 64) and blob[28][keys[1]["offset"] :][: keys[1]["size"]] == texts[28].encode()[64 * 192 :][:192]


def test_broken_media():
    good = media.mux(media.pad(b"abc" * 500))
    for bad in (b"", b"abc", good[: len(good) // 2], good.replace(b"stsz", b"stsx"), b"\xff" * 64, good[:40] + b"\x00\x00\x00\x01" + good[44:]):
        media.walk(bad)
    assert media.walk(good[:100]).error


def test_jaccard_edges(spark, messy):
    r = by_id(jaccard.jaccard_groups(messy))
    assert r[20]["component_id"] == 3 and r[21]["component_id"] == 3
    assert [r[i]["n_shingles"] for i in (22, 23, 24)] == [0, 0, 0] and [r[i]["component_id"] for i in (22, 23, 24)] == [22, 23, 24]
    assert r[26]["component_id"] == 25 and r[26]["n_shingles"] == 1 and r[28]["n_shingles"] == 1


def test_secrets_and_personal_data(spark, messy):
    s = by_id(secret_scan.scan_digest(messy))[30]
    assert (s["n_assign"], s["n_access"], s["n_hex"]) == (1, 0, 1) and s["spans"] == "assign:0:49,hex:9:49"
    p = by_id(pii.pii_digest(messy))
    assert p[30]["n_email"] == 1 and p[30]["n_phone"] == 1 and p[22]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_redaction(spark):
    df = spark.createDataFrame([(1, "aé token = abcdefghijklmnop z"), (2, "plain"), (3, None)], "doc_id long, text string")
    out = secret_scan.scan(df, keep=True).select("kept.doc_id", secret_scan.redact(F.col("kept.text"), secret_scan.merged(F.col("base"), F.col("random"))).alias("x"))
    assert {r["doc_id"]: r["x"] for r in out.collect()} == {1: "aé [secret] z", 2: "plain", 3: None}


def test_iban_and_context(spark):
    df = spark.createDataFrame([(1, "Konto GB82 WEST 1234 5698 7654 32."), (2, "Konto GB82 WEST 1234 5698 7654 33."), (3, "my social security number 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    r = by_id(pii.pii_digest(df))
    assert [r[i]["spans"] for i in (1, 2, 3, 4)] == ["iban:6:33", "", "ssn:26:37", ""]


def test_quality_edges(spark, messy):
    r = by_id(quality.score(messy, labels(spark)))
    assert not any(r[i]["keep"] for i in (22, 23, 24)) and r[22]["p_doc"] == 0
    none = quality.score(messy, labels(spark).where("false")).collect()
    assert len({x["p_doc"] for x in none if x["p_doc"]}) == 1


def test_decontamination_edges(spark, messy, empty):
    bench = spark.createDataFrame([(1, prose_of(messy, 5)), (2, None), (3, ""), (4, "wholly unrelated words that no document here has at all, really none of them")], BENCH)
    hits = decontaminate.find_leaks(messy, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(5, 1)}
    assert decontaminate.find_leaks(empty, bench).collect() == []
    assert decontaminate.find_leaks(messy, bench.where("false")).collect() == []


def prose_of(df, i):
    words = df.where(f"doc_id = {i}").first()["text"].split()
    return " ".join(words[30:70])


def test_common_subsequence():
    assert decontaminate.common([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
    assert decontaminate.common([], [1]) == 0 and decontaminate.common([1, 1, 2], [1, 2, 1]) == 2


def test_chat_edges(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, None, None, "late"), (1, 300, "ann", "bye"), (None, 0, "x", "y"), (2, 0, "system", "alone"), (3, 0, "a", "twice"), (3, 0, "a", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 0), (None, "x", 0), (3, "a", 0)}
    ann = out[1, "ann", 0]
    assert ann["rendered"].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>")
    assert ann["rendered"].endswith("bye<|im_end|>\n<|im_start|>user name=unknown\nlate<|im_end|>\n")  # null turns stand last
    assert [ann["rendered"][slice(*map(int, m.split(":")))] for m in ann["mask"].split(",")] == ["hi<|im_end|>\n", "bye<|im_end|>\n"] and ann["n_chars"] == len(ann["rendered"])
    assert out[3, "a", 0]["n_turns"] == 2
    assert chat.rotate(df.where("false")).collect() == []


def test_chat_of_many_turns_without_number(spark):
    """Null conversations, null and repeated turn numbers: parts stay bounded, null turns come last, base runs on; as the SQL says."""
    import duckdb

    rows = [(None, None if i % 3 else i % 7, "ann" if i % 2 else "bob", f"é{i}") for i in range(1500)] + [(5, 1, "system" if i % 9 == 0 else f"s{i % 3}", f"x{i % 400}") for i in range(900)] + [(6, i, "a", str(i)) for i in range(256)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.rotate(df).toPandas()
    assert got["n_turns"].max() == chat.PART_TURNS and (got["n_chars"] == got["rendered"].str.len()).all()
    whole = "".join(got[(got["conv_id"].isna()) & (got["perspective"] == "ann")].sort_values("part")["rendered"])
    ends = [whole.index(f"\né{i}<|im_end|>") for i in range(1500)]
    assert max(e for i, e in enumerate(ends) if i % 3 == 0) < min(e for i, e in enumerate(ends) if i % 3)
    conversations = df.toPandas()  # noqa: F841
    conversations["conv_id"], conversations["turn"] = conversations["conv_id"].astype("Int64"), conversations["turn"].astype("Int64")
    want = duckdb.sql(chat.SQL).df()
    keys = ["conv_id", "perspective", "part"]
    clean = lambda d: [tuple(str(x) for x in r) for r in d.assign(conv_id=d["conv_id"].fillna(-1).astype(int)).sort_values(keys)[[*keys, "n_turns", "n_chars", "base", "rendered", "mask"]].itertuples(index=False)]
    assert clean(got) == clean(want)


def test_mixing_rules(spark):
    rows = [(i, "w " * (1 + i % 13), s, None, None) for s, n in (("a", 400), ("b", 40), (None, 300), ("z", 0), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = mixing.mix(df, group_rows=20).collect()
    size, want, took = {}, {}, {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] = r["source_size"]
        want[r["source"]] = r["target"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
    total, weight = sum(size.values()), dict(zip(sorted(x for x in size if x), (1, 2, 3), strict=False))
    weight[None] = (1, 2, 3)[len(weight) % 3]
    target, open_ = {}, set(size)  # reshare until none is above
    while True:
        left = total - sum(target.values())
        plan = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if plan[s] > 3 * size[s]}
        if not over:
            target |= plan
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    assert want == pytest.approx(target)
    assert all(abs(took[s] - want[s]) <= 13 for s in size)


def test_sources_that_are_alike(spark):
    """Six sources of one size: the level is that of the first of those that stay below their caps."""
    rows = [(100 * k + i, "w " * 10, f"s{k}") for k in range(6) for i in range(10)]
    out = mixing.water_fill(spark.createDataFrame(rows, "doc_id long, text string, source string").groupBy("source").agg((F.count("*") * 10).alias("source_size")))
    assert {r["source"]: r["target"] for r in out.collect()} == {f"s{k}": 50.0 * (k % 3 + 1) for k in range(6)}


def test_sites_of_urls(spark):
    rows = [("https://User@Example.org:80/a/b?q#f",), ("http://x.y",), ("no url",), (None,), ("ftp+s://h/?p/q",)]
    out = spark.createDataFrame(rows, "u string").select(*quality.site_of(F.col("u")))
    assert list(map(tuple, out.collect())) == [("example.org", "/a"), ("x.y", ""), ("", ""), (None, None), ("h", "/")]
