"""Exact removal of repeated passages: every window of WINDOW words that also starts in a document with a smaller id, with a count-min prefilter.

Documents are packed into blocks, rows of some megabytes with their ids and texts, which are written once. All that follows is a talk between blocks
and shards of the range of window hashes, in packed arrays; no row stands for a window.

1. Counting. A block sends each shard a sketch of its distinct windows: their cells in ROWS rows of counters, and which of them it holds in
   several documents. The shard merges the sketches by adding them up and answers each block with a bit a window: whether the least of
   its counters is 2 or more. Counters are shared by windows that fall on them, so they say too much at times and never too little.
2. Grouping. Of the windows so estimated a block sends the whole hash (128 bits) and its least document. The shard groups them exactly and answers
   with a bit: whether a block elsewhere has a smaller document.
3. Removing. A block removes the words under each window that has a smaller document, here or elsewhere.

The number of shards follows the number of words, so the load of a counter is the same at any size: about PER_SHARD windows for CELLS counters a row. A
window that a third of all documents share is sent once by a block, so no shard gets more of it than there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches, stored
from lakeloom.llm.shingles import _BASE, WordHash, hashed, mixed

WINDOW = 13
#: Bytes of text after which a block is closed.
BLOCK_BYTES = 4 << 20
#: Windows that a shard is made for, and counters of a row of its sketch.
PER_SHARD, CELL_BITS = 1 << 20, 22
CELLS, ROWS = 1 << CELL_BITS, 2


# ---- the sketch


def shard_of(windows: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the upper half of a hash, so sorted hashes lie in shards one after another."""
    return ((windows >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def cells_of(windows: np.ndarray, shards: int) -> np.ndarray:
    """The counter of each window in each row of its shard's sketch: one from the rest of the upper half, one from the lower."""
    rest = ((windows >> np.uint64(32)) * np.uint64(shards)) & np.uint64(0xFFFFFFFF)
    return np.stack([rest >> np.uint64(32 - CELL_BITS), windows & np.uint64(CELLS - 1)]).astype(np.uint32)


class Sketch:
    """A count-min sketch: ROWS rows of CELLS counters, merged by addition."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        """parts: for each block its cells (ROWS x windows) and which windows count twice."""
        self.rows = []
        for k in range(ROWS):
            found = [x for cells, twice in parts for x in (cells[k], cells[k][twice])]
            self.rows.append(np.bincount(np.concatenate(found), minlength=CELLS) > 1)

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        """True where the least counter is over 1."""
        return self.rows[0][cells[0]] & self.rows[1][cells[1]]


def packed(cells: np.ndarray) -> bytes:
    """Cells as planes of bytes. The first row ascends, so its steps are kept, whose upper planes are nearly all 0."""
    steps = np.diff(cells[0], prepend=np.uint32(0))
    return b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes() for x in (steps, cells[1]))


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(ROWS, 3, -1).astype(np.uint32)
    cells = planes[:, 0] | planes[:, 1] << np.uint32(8) | planes[:, 2] << np.uint32(16)
    cells[0] = np.cumsum(cells[0], dtype=np.uint32)
    return cells


# ---- a block


_SCHEMA = pa.schema([("id", pa.int64()), ("text", pa.binary())])


def sealed(ids: list, texts: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=_SCHEMA))
    return sink.getvalue().to_pybytes()


class Block:
    """A block's texts as words, and its distinct windows in the order of their hashes. Windows of documents without an id are left out."""

    def __init__(self, raw: bytes, width: int, memo: tuple[WordHash, ...]):
        batch = pa.ipc.open_stream(raw).read_all()
        self.ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
        self.texts = texts
        hashes = [[hashed(t, m) for t in texts] for m in memo]
        self.sizes = np.array([len(h) for h in hashes[0]], np.int64)
        self.width = width
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        doc = np.repeat(np.arange(len(texts)), np.maximum(self.sizes - width + 1, 0) * np.array([i is not None for i in self.ids], bool))
        #: Of each window: its document's place in the block and its first word.
        self.doc = doc
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        lengths = np.diff(first, append=len(doc))
        self.at = np.arange(len(doc)) - np.repeat(first, lengths) + self.starts[doc]
        a, *rest = (self._rolled(np.concatenate(h)) for h in hashes)
        order = np.argsort(a, kind="stable")
        if rest:
            same = a[order][1:] == a[order][:-1]
            if (rest[0][order][1:][same] != rest[0][order][:-1][same]).any():
                order = np.lexsort((rest[0], a))
        self.order = order
        keys = [h[order] for h in (a, *rest)]
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        #: Of each window its place among the distinct ones; the distinct ones by hash, and of each the least document.
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.keys = [k[new] for k in keys]
        cuts = np.flatnonzero(new)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)[doc][order]
        self.least = np.minimum.reduceat(ids, cuts) if len(ids) else ids
        self.several = (np.maximum.reduceat(ids, cuts) if len(ids) else ids) != self.least

    def _rolled(self, words: np.ndarray) -> np.ndarray:
        h = np.full(len(self.at), self.width, np.uint64)
        for i in range(self.width):
            h = h * np.uint64(_BASE) + words[self.at + i]
        return mixed(h)

    def slices(self, shards: int) -> Iterator[tuple[int, slice]]:
        """Each shard's stretch of the distinct windows."""
        of = shard_of(self.keys[0], shards).astype(np.int64)
        cuts = np.concatenate([np.flatnonzero(np.diff(of, prepend=-1)), [len(of)]]).astype(int) if len(of) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(of[lo]), slice(int(lo), int(hi))

    def results(self, elsewhere: np.ndarray) -> list[tuple]:
        """(id, n_words, n_removed, the words that stay) of each document. elsewhere: of each distinct window whether another block has a smaller document."""
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        gone = elsewhere[self.place] | (ids[self.doc] > self.least[self.place])
        edges = np.zeros(int(self.starts[-1]) + self.width + 1, np.int64)
        np.add.at(edges, self.at[gone], 1)
        np.add.at(edges, self.at[gone] + self.width, -1)
        covered = np.cumsum(edges) > 0
        out = []
        for i, (doc_id, text) in enumerate(zip(self.ids, self.texts, strict=True)):
            lost = covered[self.starts[i] : self.starts[i + 1]]
            words = text.split()
            kept = [w for w, x in zip(words, lost.tolist(), strict=True) if not x] if lost.any() else words
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
        return out


# ---- the talk


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """(block, docs, words): rows of docs (id, text) packed in the order they are read. A block's number holds that of its task, so it is unique
    within the table, which is written once."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal ids, texts, held, number
            words = sum(len(t.split()) for t in texts)
            out = pa.record_batch([pa.array([number], pa.int64()), pa.array([sealed(ids, texts)], pa.binary()), pa.array([words], pa.int64())], names=["block", "docs", "words"])
            ids, texts, held, number = [], [], 0, number + 1
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                held += len(t or b"")
                if held >= size:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(op, "block long, docs binary, words long")


def _memo() -> tuple[WordHash, ...]:
    return WordHash(), WordHash(1)


def _counted(blocks: DataFrame, width: int, shards: int) -> DataFrame:
    """(block, shard, bits): of each block's distinct windows in a shard, whether they are estimated to be repeated."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _memo()
        for batch in batches:
            for number, raw in zip(batch["block"], batch["docs"], strict=True):
                b = Block(raw, width, memo)
                cells = cells_of(b.keys[0], shards)
                rows = [(number, s, packed(cells[:, part]), np.packbits(b.several[part]).tobytes(), part.stop - part.start) for s, part in b.slices(shards)]
                yield pd.DataFrame(rows, columns=["block", "shard", "cells", "twice", "n"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        cells = [unpacked(raw) for raw in parts["cells"]]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(parts["twice"], parts["n"], strict=True)]
        sketch = Sketch(list(zip(cells, twice, strict=True)))
        return pd.DataFrame({"block": parts["block"], "shard": key[0], "bits": [np.packbits(sketch.repeated(c)).tobytes() for c in cells]})

    sent = blocks.select("block", "docs").mapInPandas(send, "block long, shard long, cells binary, twice binary, n long")
    return sent.groupBy("shard").applyInPandas(merge, "block long, shard long, bits binary")


def _estimated(b: Block, shards: int, answers: pd.DataFrame) -> dict[int, np.ndarray]:
    """By shard, the places of the distinct windows that the sketches estimate to be repeated."""
    found = dict(zip(answers["shard"], answers["bits"], strict=True))
    return {s: np.flatnonzero(np.unpackbits(np.frombuffer(found[s], np.uint8), count=part.stop - part.start)) + part.start for s, part in b.slices(shards)}


def _grouped(blocks: DataFrame, counted: DataFrame, width: int, shards: int) -> DataFrame:
    """(block, shard, bits): of the windows that are estimated to be repeated, whether another block has a smaller document."""

    def send(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = Block(own["docs"].iloc[0], width, _memo())
        rows = [(key[0], s, b.keys[0][at].tobytes(), b.keys[1][at].tobytes(), b.least[at].tobytes()) for s, at in _estimated(b, shards, answers).items() if len(at)]
        return pd.DataFrame(rows, columns=["block", "shard", "a", "b", "least"])

    def group(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        a, b, least = (np.concatenate([np.frombuffer(x, kind) for x in parts[c]]) for c, kind in (("a", np.uint64), ("b", np.uint64), ("least", np.int64)))
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        beaten = np.empty(len(order), bool)
        beaten[order] = smallest < least[order]
        cuts = np.cumsum([len(x) // 8 for x in parts["a"]])[:-1]
        return pd.DataFrame({"block": parts["block"], "shard": key[0], "bits": [np.packbits(x).tobytes() for x in np.split(beaten, cuts)]})

    sent = blocks.select("block", "docs").groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(send, "block long, shard long, a binary, b binary, least binary")
    return sent.groupBy("shard").applyInPandas(group, "block long, shard long, bits binary")


def _removed(blocks: DataFrame, counted: DataFrame, grouped: DataFrame, width: int, shards: int) -> DataFrame:
    """(id as text, n_words, n_removed, kept) of each document."""

    def finish(_: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = Block(own["docs"].iloc[0], width, _memo())
        elsewhere = np.zeros(len(b.keys[0]), bool)
        exact = answers[answers["exact"]]
        found = dict(zip(exact["shard"], exact["bits"], strict=True))
        for s, at in _estimated(b, shards, answers[~answers["exact"]]).items():
            if len(at):
                elsewhere[at] = np.unpackbits(np.frombuffer(found[s], np.uint8), count=len(at)).astype(bool)
        rows = [(None if i is None else str(i), n, gone, kept.decode("utf-8", "surrogatepass")) for i, n, gone, kept in b.results(elsewhere)]
        return pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept"])

    answers = counted.withColumn("exact", F.lit(False)).unionByName(grouped.withColumn("exact", F.lit(True)))
    return blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, "id string, n_words long, n_removed long, kept string")


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES, per_shard: int = PER_SHARD) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row of docs; kept: the words that stay, joined by one space.

    A word goes if it stands in a window of `width` words whose words also start in a document of a smaller id (whole numbers). Windows are judged on
    the texts as they come, whatever is removed. So the document of the least id keeps a passage, also where it repeats it; rows of one
    id take nothing from each other; a row without an id takes nothing and loses nothing. Null texts have no words, texts of fewer
    words than a window no window. Repeated rows give a row each; an empty table gives an empty result. One document is held by one task.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    blocks = stored(_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), block_bytes), "windows-blocks")
    shards = max(1, -(-(blocks.agg(F.sum("words")).first()[0] or 0) // per_shard))
    counted = stored(_counted(blocks, width, shards), "windows-counted")
    grouped = stored(_grouped(blocks, counted, width, shards), "windows-grouped")
    return _removed(blocks, counted, grouped, width, shards).select(F.col("id").cast("long").cast(kind).alias(id_col), "n_words", "n_removed", "kept")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of dedup_windows."""
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The rows of dedup_digest(documents) in DuckDB.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w, ROW_NUMBER() OVER () AS row FROM documents),
s AS MATERIALIZED (SELECT row, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
o AS (SELECT g, MIN(doc_id) AS first FROM s GROUP BY g),
c AS (SELECT row, unnest(range(i, i + {WINDOW})) AS i FROM s JOIN o ON o.g = s.g WHERE s.doc_id > o.first),
r AS (SELECT row, list(DISTINCT i) AS gone FROM c GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(COALESCE(gone, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON r.row = d.row
"""
