"""Token counts that follow edits: a segment tree of pre-tokens per document.

A byte-level BPE vocabulary never merges across pre-tokens, so a text's count is the sum of its pre-tokens' counts. A CountTree keeps runs of LEAF
pre-tokens with their text, lengths and counts, and sums over subtrees. An edit re-encodes from one pre-token before the first one that it can
touch and on, until a boundary of the new text falls on a boundary of the old one behind the edit; from there on both texts are cut
alike, since a match depends only on what follows it. Leaves in between are replaced, and only sums above them change. Where leaves
become more, those of the smallest subtree around them that has room are spread anew, so many edits of one text stay cheap.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_rows, short_batches
from lakeloom.llm.spans import located

LEAF = 32
#: Where the public vocabulary lies on the driver; it is read there once and broadcast (about 1 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's pre-tokens are cut.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = regex.compile(PATTERN)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Counter(dict):
    """Tokens of a pre-token, remembered; bounded in number, and long pre-tokens are not kept."""

    LIMIT = 200_000

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.bpe.encode_ordinary(piece))
        if len(piece) <= 32:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = n
        return n


@dataclass
class Leaf:
    text: str
    lengths: list[int]
    counts: list[int]


def _leaves(text: str, lengths: list[int], counts: list[int]) -> list[Leaf]:
    """One leaf, or of more than 2 * LEAF pre-tokens leaves of about LEAF each, so that a leaf that was cut takes many edits before the next cut."""
    size = len(lengths) if len(lengths) <= 2 * LEAF else -(-len(lengths) // (len(lengths) // LEAF))
    out, at = [], 0
    for i in range(0, len(lengths), size or 1):
        n = sum(lengths[i : i + size])
        out.append(Leaf(text[at : at + n], lengths[i : i + size], counts[i : i + size]))
        at += n
    return out


class CountTree:
    """Sums over leaves in a binary tree of `width` places, some of them empty."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        pieces = self._cut(text)
        self._build(_leaves(text, list(map(len, pieces)), list(map(counter.__getitem__, pieces))))

    def _cut(self, text: str) -> list[str]:
        pieces = _CUT.findall(text)
        self.encoded += len(pieces)
        return pieces

    def _build(self, leaves: list[Leaf]) -> None:
        self.width = 1
        while self.width < max(2 * len(leaves), 1):
            self.width *= 2
        self.leaves: list[Leaf | None] = [None] * self.width
        self.length, self.count = [0] * (2 * self.width), [0] * (2 * self.width)
        self._spread(1, leaves)

    def _spread(self, node: int, leaves: list[Leaf]) -> None:
        """Put leaves evenly over the places below a node, in place of those there, and sum up."""
        low = node
        while low < self.width:
            low *= 2
        places = self.width >> (node.bit_length() - 1)
        at = low - self.width
        self.leaves[at : at + places] = [None] * places
        for i, leaf in enumerate(leaves):
            self.leaves[at + i * places // len(leaves)] = leaf
        for i in range(low, low + places):
            leaf = self.leaves[i - self.width]
            self.length[i], self.count[i] = (sum(leaf.lengths), sum(leaf.counts)) if leaf else (0, 0)
        first, last = low // 2, (low + places - 1) // 2
        while first >= node and first:
            for i in range(first, last + 1):
                self._sum(i)
            first, last = first // 2, last // 2
        while node > 1:
            node //= 2
            self._sum(node)

    def _sum(self, i: int) -> None:
        self.length[i] = self.length[2 * i] + self.length[2 * i + 1]
        self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    @property
    def total(self) -> int:
        return self.count[1]

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves if leaf)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf in which offset `at` lies, or the last one, and where that leaf starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.length[i] and self.length[i + 1]:
                start += self.length[i]
                i += 1
        return i - self.width, start

    def _replace(self, first: int, last: int, fresh: list[Leaf]) -> None:
        """Leaves at places first to last give way to others."""
        if len(fresh) <= last - first + 1:
            for i in range(first, last + 1):
                leaf = self.leaves[i] = fresh[i - first] if i - first < len(fresh) else None
                n = self.width + i
                self.length[n], self.count[n] = (sum(leaf.lengths), sum(leaf.counts)) if leaf else (0, 0)
            low, high = (self.width + first) // 2, (self.width + last) // 2
            while low:
                for i in range(low, high + 1):
                    self._sum(i)
                low, high = low // 2, high // 2
            return
        # the smallest subtree around them that has room; the higher, the fuller it must not be
        low, high, places = self.width + first, self.width + last, 1
        while True:
            if low == high:
                at = low * places - self.width
                kept = [x for x in self.leaves[at:first] if x] + fresh + [x for x in self.leaves[last + 1 : at + places] if x]
                if len(kept) <= places * (0.5 + 0.4 / places.bit_length()):
                    return self._spread(low, kept)
                if low == 1:
                    return self._build(kept)
            low, high, places = low // 2, high // 2, places * 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; returns how many pre-tokens were encoded again."""
        before = self.encoded
        if not self.length[1]:
            pieces = self._cut(new)
            self._build(_leaves(new, list(map(len, pieces)), list(map(self.counter.__getitem__, pieces))))
            return self.encoded - before
        # from one pre-token before the one that holds the code point before the edit: a match looks one code point ahead at most
        first, at = self.find(max(start - 1, 0))
        head, k, pos = self.leaves[first], 0, at
        while k < len(head.lengths) - 1 and pos + head.lengths[k] <= max(start - 1, 0):
            pos += head.lengths[k]
            k += 1
        if k:
            k -= 1
            pos -= head.lengths[k]
        elif first_before := at:
            first, at = self.find(first_before - 1)
            head = self.leaves[first]
            k = len(head.lengths) - 1
            pos = first_before - head.lengths[k]
        lengths, counts = head.lengths[:k], head.counts[:k]
        # old boundaries from the end of the edit on, in the leaves that are looked at
        last, edge = self.find(min(end, self.length[1] - 1))
        behind, j = self.leaves[last], 0
        while j < len(behind.lengths) and edge < end:
            edge += behind.lengths[j]
            j += 1
        # text to match in: what is before the edit, the new text, what follows; more of it when a match comes near its end
        seen = self._between(first, last)
        text = seen[pos - at : start - at] + new + seen[end - at :]
        reach, shift, here = at + len(seen), len(new) - (end - start), pos
        done = pos  # in places of the new text, as here, where text begins
        met, ready = False, ""
        while True:
            m = _CUT.match(text, here - done)
            whole = reach >= self.length[1]
            if not whole and (m is None or m.end() + 1 > len(text)):
                more, _ = self.find(reach)
                text += self.leaves[more].text
                reach += len(self.leaves[more].text)
                continue
            while edge + shift < here:  # the next old boundary at or behind this place
                if j >= len(behind.lengths):
                    if edge >= self.length[1]:
                        break
                    last, _ = self.find(edge)
                    behind, j = self.leaves[last], 0
                edge += behind.lengths[j]
                j += 1
            if here >= start + len(new) and edge + shift == here:
                met = True
                break
            if m is None:
                break
            lengths.append(m.end() - m.start())
            counts.append(self.counter[m.group()])
            self.encoded += 1
            here += m.end() - m.start()
        ready = head.text[: pos - at] + text[: here - done]
        if met:
            rest = sum(behind.lengths[j:])
            lengths += behind.lengths[j:]
            counts += behind.counts[j:]
            ready += behind.text[len(behind.text) - rest :]
        else:
            last = self.find(self.length[1] - 1)[0]
        self._replace(first, last, _leaves(ready, lengths, counts))
        return self.encoded - before

    def _between(self, first: int, last: int) -> str:
        return "".join(leaf.text for leaf in self.leaves[first : last + 1] if leaf)


def count_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (id, text), edits (id, edits array<struct<start:int,end:int,new:string>>, applied in turn): (id, n_tokens, n_pieces, n_edits,
    n_tokens_after, n_encoded, text_sha256) for each row of docs.

    Edits of ids that docs lacks change nothing. Null texts count as empty; edits that are null or out of range are left out. An id that repeats in
    `edits` repeats its documents, once for each of its rows; an empty table of docs gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(edits.select(F.col(id_col).alias("eid"), "edits"), F.col("id") == F.col("eid"), "left")
    return _counted(rows.select("id", "text", "edits"), vocabulary).withColumnRenamed("id", id_col)


def _counted(rows: DataFrame, vocabulary: str) -> DataFrame:
    short_batches(rows.sparkSession)
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def op(batches):
        counter = Counter(ranks.value)
        for b in batches:
            out = [_count(t, e, counter) for t, e in zip(b["text"], b["edits"], strict=True)]
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_tokens", "n_pieces", "n_edits", "n_tokens_after", "n_encoded", "text_sha256"])], axis=1)

    return map_rows(rows, op, "n_tokens long, n_pieces long, n_edits long, n_tokens_after long, n_encoded long, text_sha256 string")


def _count(text: object, edits: Iterable | None, counter: Counter) -> tuple[int, int, int, int, int, str]:
    tree = CountTree(text if isinstance(text, str) else "", counter)
    base, pieces, done, again = tree.total, tree.encoded, 0, 0
    for e in edits if edits is not None else ():
        if e is None or e["start"] is None or e["end"] is None or not 0 <= e["start"] <= e["end"] <= tree.length[1]:
            continue
        again += tree.edit(int(e["start"]), int(e["end"]), e["new"] or "")
        done += 1
    return base, pieces, done, tree.total, again, hashlib.sha256(tree.text.encode("utf-8", "surrogatepass")).hexdigest()


def redaction_edits(text: F.Column) -> F.Column:
    """Edits that put [num] in place of every run of eight and more digits and a notice in front, from the end to the front."""
    runs = F.transform(F.reverse(located(text, "[0-9]{8,}+")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[num]").alias("new")))
    return F.concat(runs, F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("Reviewed copy.\n").alias("new"))))


def count_redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """count_edits() with each document's own redaction_edits(); no join. A row for each row of docs; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _counted(rows.withColumn("edits", redaction_edits(F.col("text"))), vocabulary).withColumnRenamed("id", id_col)
