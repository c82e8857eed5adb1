"""Decontamination held against plants and brute force where words are common, items many or short, and slots shared."""

import random
import time

import numpy as np

from lakeloom.llm import decontaminate, shingles
from lakeloom.llm.shingles import WordHash, plain_hashes


def found(spark, docs, items):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")).collect()}


def test_passages_that_many_documents_share_are_found(spark):
    rng = random.Random(3)
    frequent = [f"c{i}" for i in range(40)]
    items = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)], rng.sample(frequent, 30)]
    docs, want = [], set()
    for i in range(600):
        body = [rng.choice(frequent) if rng.random() < 0.4 else f"d{rng.randrange(9000)}" for _ in range(rng.choice([60, 150]))]
        for k in [k for k, every in enumerate((20, 3, 50)) if i % every == 0]:  # 5%, a third, and one of words that are in every document
            body += items[k] + [f"d{rng.randrange(9000)}" for _ in range(40)]
            want.add((i, k))
        docs.append((i, body))
    assert found(spark, docs, items) == want


def words_within(text, item):
    """The greatest common subsequence of the item with any stretch of twice its words, by the plain table."""
    best, m = 0, len(item)
    for x in range(len(text)):
        here, row = text[x : x + 2 * m], [0] * (m + 1)
        for w in here:
            last = 0
            for j, v in enumerate(item, 1):
                last, row[j] = row[j], last + 1 if v == w else max(row[j], row[j - 1])
        best = max(best, row[-1])
    return best


def test_recall_against_every_pair(spark):
    """Every document against every item, by plain subsequences: items of common words only, of rare ones and short ones, copied, thinned and mixed."""
    rng = random.Random(11)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(4000)]
    items = [rng.sample(common, 14), rng.sample(common, 20), rng.sample(rare, 16), rng.sample(rare, 24), rng.sample(rare, 5), rng.sample(common, 6), rng.sample(common[:15], 7) + rng.sample(rare, 7)]
    docs = []
    for i in range(140):
        body = [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.choice([30, 90]))]
        if i % 2:
            item = items[i // 2 % len(items)]
            leak = [w for w in item if len(item) < 8 or rng.random() > 0.4 * (i % 3) / 2]
            at = rng.randrange(len(body))
            body[at:at] = leak
        docs.append((i, body))
    want = {(i, k) for i, t in docs for k, item in enumerate(items) if words_within(t, item) >= (0.6 if len(item) >= 8 else 1.0) * len(item) - 1e-9}
    got = found(spark, docs, items)
    assert len(want) >= 50 and want <= got  # recall 1
    whole = {(i, k) for i, t in docs for k, item in enumerate(items) if decontaminate.common(item, t) >= (0.45 if len(item) >= 8 else 1.0) * len(item) - 1e-9}
    assert got <= whole


def test_a_benchmark_in_parts(spark):
    rng = random.Random(12)
    items = [[f"p{k}x{i}" for i in range(12)] for k in range(40)]
    docs = [(i, [f"d{rng.randrange(900)}" for _ in range(30)] + items[i % 40] + [f"d{rng.randrange(900)}" for _ in range(30)]) for i in range(60)]
    docs_df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    small = decontaminate.Params(rank=8, rounds=1, benchmark_bytes=900)
    out = decontaminate.find_leaks(docs_df, bench, p=small)
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(i, i % 40) for i in range(60)]


def test_thousands_of_items(spark):
    """Far more passages than latent dimensions: copies, and copies with other words between all of theirs, are found all the same."""
    rng = random.Random(4)
    items = [[f"w{rng.randrange(6000)}" for _ in range(30)] for _ in range(3000)]
    docs, want = [], set()
    for i, k in enumerate(rng.sample(range(3000), 240)):
        other = [f"w{rng.randrange(6000)}" for _ in range(120)]
        leak = items[k] if i % 2 else [x for w in items[k] for x in (w, *[f"d{rng.randrange(9000)}" for _ in range(rng.choice([2, 3]))])]
        docs.append((i, other[:60] + leak + other[60:]))
        want.add((i, k))
    assert found(spark, docs, items) == want


def test_a_frequent_word_in_the_slot_of_rare_ones(spark):
    """Rare benchmark words keep their weights, and their leaks are found, where frequent words share their slots."""
    memo, slots, pairs = WordHash(), {}, []
    for i in range(60_000):
        d = int(decontaminate.dim(plain_hashes(f"v{i}", memo))[0])
        if d in slots:
            pairs.append((slots.pop(d), f"v{i}"))  # each word in one pair at most
        else:
            slots[d] = f"v{i}"
    item, frequent = map(list, zip(*pairs[:30], strict=True))
    docs = [(i, frequent + [f"d{i}x{j}" for j in range(40)] + (item if i == 7 else [])) for i in range(100)]
    assert found(spark, docs, [item]) == {(7, 0)}
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "id long, text string")
    space, _ = decontaminate.fit(table, [(0, " ".join(item))])
    assert (space.weight.of(plain_hashes(" ".join(item), memo)) > 3.5).all()
    assert (space.weight.of(plain_hashes(" ".join(frequent), memo)) < 0.1).all()


def test_short_items_against_brute_force(spark):
    """Short items of middling frequent words among rare ones: every verbatim copy and every paraphrase that the subsequence accepts is found."""
    rng = random.Random(5)
    middling = [f"m{i}" for i in range(400)]
    items = [rng.sample(middling, n) for n in (5, 5, 8, 8, 12, 12, 16, 16, 20, 20, 30, 30) for _ in range(5)]
    docs, plants = [], set()
    for i in range(600):
        body = [rng.choice(middling) if rng.random() < 0.1 else f"r{rng.randrange(200_000)}" for _ in range(rng.choice([80, 200]))]
        k = rng.randrange(len(items))
        changed = rng.random() < 0.5 and len(items[k]) >= 8
        leak = [f"r{rng.randrange(200_000)}" if changed and rng.random() < 0.38 else w for w in items[k]]
        at = rng.randrange(len(body))
        body[at:at] = leak
        if sum(a == b for a, b in zip(leak, items[k], strict=True)) >= (0.6 if changed else 1.0) * len(items[k]):
            plants.add((i, k))
        docs.append((i, body))
    got = found(spark, docs, items)
    assert plants <= got
    lcs = {(i, k) for i, t in docs for k, item in enumerate(items) if decontaminate.common(item, t) >= (0.6 if len(item) >= 8 else 1.0) * len(item)}
    assert got <= lcs


def recall_case(rng):
    """Documents with items copied, thinned or with other words in their place, and all pairs that the plain table accepts."""
    middling = [f"m{i}" for i in range(300)]
    items = [rng.sample(middling, n) for n in (10, 14, 18, 24, 30, 40, 55, 70) for _ in range(6)]
    docs = []
    for i in range(240):
        body = [rng.choice(middling) if rng.random() < 0.1 else f"r{rng.randrange(50_000)}" for _ in range(rng.choice([60, 200]))]
        leak = [f"r{rng.randrange(50_000)}" if rng.random() < 0.15 * (i % 3) else w for w in rng.choice(items)]
        at = rng.randrange(len(body))
        docs.append((i, body[:at] + leak + body[at:]))
    want = set()
    for i, t in docs:
        for k, item in enumerate(items):
            least, m = 0.6 * len(item) - 1e-9, len(item)
            if len(set(t) & set(item)) >= least and max(decontaminate.common(item, t[x : x + 2 * m]) for x in range(len(t))) >= least:
                want.add((i, k))
    return docs, items, want


def test_recall_of_the_latent_search_alone(spark):
    """Without the exact way at least 0.9 of what all pairs give; without a latent space nothing; with both ways all, each pair under the way it came."""
    docs, items, want = recall_case(random.Random(21))
    assert len(want) > 200
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    pairs = lambda rows: {(r["doc_id"], r["item_id"]) for r in rows}
    alone = decontaminate.find_leaks(table, bench, p=decontaminate.Params(exact=False)).collect()
    assert len(pairs(alone) & want) >= 0.9 * len(want)
    assert {r["found_by"] for r in alone} == {"latent"}
    both = decontaminate.find_leaks(table, bench).collect()
    assert want <= pairs(both) and pairs(r for r in both if r["found_by"] == "latent") == pairs(alone)
    assert decontaminate.find_leaks(table, bench, p=decontaminate.Params(rank=1, rounds=0, propose=9.0, exact=False)).collect() == []


def test_repetitive_texts_take_little_time(spark):
    """A text of few kinds of words against a long item of the same: stretches are judged together."""
    rng = random.Random(8)
    kinds = [f"k{i}" for i in range(12)]
    item, text = rng.choices(kinds, k=400), rng.choices(kinds, k=20_000)
    memo = WordHash()
    space, items = decontaminate.fit(spark.createDataFrame([(0, " ".join(text))], "id long, text string"), [(0, " ".join(item))])
    words = plain_hashes(" ".join(text), memo)
    start = time.process_time()
    decontaminate.leaks([words], space, items, decontaminate.Params())
    took = time.process_time() - start
    assert took < 5, took


def test_stretches_agree_with_each_start_by_itself():
    rng = random.Random(9)
    for case in range(60):
        kinds = [f"k{i}" for i in range(rng.choice([3, 6, 20]))]
        words = [rng.choice(kinds) for _ in range(rng.choice([8, 12, 20]))]
        item = decontaminate.Item(0, words, words[-rng.choice([2, 4]) :])
        text = [rng.choice([*kinds, "x", "y", "z"]) for _ in range(150)]
        at = [i for i, w in enumerate(text) if w in item.at]
        around = [text[i] for i in at]
        p = decontaminate.Params(same=rng.choice([0.6, 0.7, 0.9]))
        close = decontaminate.Close(item, at, around, p)

        def within(x, width, end, at=at, around=around):
            return [around[y] for y in range(x, end) if at[y] < at[x] + width]

        def plain(x0, end, item=item, p=p, within=within):
            for x in range(x0, end):
                here = within(x, 2 * len(item.words), end)
                share, _, leaked = decontaminate.settled(item, here, p)
                if leaked and (share >= p.same or any(decontaminate.common(item.answer, within(y, 2 * len(item.answer), x + len(here))) >= 0.8 * len(item.answer) for y in range(x, x + len(here)))):
                    return True
            return False

        for _ in range(12):
            x, end = sorted(rng.sample(range(len(at) + 1), 2)) if at else (0, 0)
            assert close.between(x, end) == plain(x, end), case


def test_the_latent_space_does_not_depend_on_which_rows_a_hash_picks(spark):
    """The basis holds every passage of the benchmark, and other ids of the same texts give the same space."""
    rng = random.Random(31)
    known = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.sample(known, 20))) for k in range(40)]
    texts = [" ".join(rng.choices(known, k=70)) for _ in range(900)]
    spaces = [decontaminate.fit(spark.createDataFrame([(i + shift, t) for i, t in enumerate(texts)], "id long, text string"), items)[0] for shift in (0, 10_000)]
    one, other = (s.basis @ s.basis.T for s in spaces)
    assert np.abs(one - other).max() < 1e-3
    for _, text in items:
        words, w = decontaminate.weights(plain_hashes(text, WordHash()), spaces[0].weight)
        held = spaces[0].basis[decontaminate.places(words, spaces[0].weight.words)].T @ w
        assert abs(held @ held - 1) < 1e-3


def test_texts_hashed_together_and_marked_words():
    """Short texts that are hashed as one, long ones and empty ones have the words that each has by itself; marked numbers are those that sorting gives."""
    rng = random.Random(32)
    odd = ["", " ", "...", "x", "x" * 100 + " y", "Z\u00fcrich \u0130\udc80 a-b", "word " * 9_000, "y" * 40_000, "a" * 65]
    texts = odd + ["".join(rng.choice("ab, .\n\u00e9") for _ in range(rng.choice([0, 3, 200, 20_000]))) for _ in range(60)] + odd
    memo = WordHash()
    got = shingles.plain_hashes_each(texts, memo)
    assert [w.tolist() for w in got] == [plain_hashes(t, WordHash()).tolist() for t in texts]
    assert shingles.plain_hashes_each([], memo) == []
    x = np.array([rng.randrange(500) for _ in range(300)])
    assert decontaminate.distinct(x, 500).tolist() == decontaminate.distinct(x, decontaminate.MARKED + 1).tolist() == sorted(set(x.tolist()))
