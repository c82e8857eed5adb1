"""Words and word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20
#: Bytes of short texts that are hashed together.
TOGETHER = 1 << 15
#: A word of more bytes has a hash of another kind, wherever it stands: sums of powers modulo 2^64 tell long periodic words apart badly.
LONG = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPACES = [bytes([i]) for i in (32, *range(9, 14))]
_BASE = 0x9E3779B97F4A7C15 | 1
_PLAIN = bytes(i if i > 126 or chr(i).isalnum() else 32 for i in range(256))
_GAP = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])


def _inverse(x: int) -> int:
    """Of an odd number, modulo 2^64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHash:
    """Hashes all words of a stretch of text at once: a word's hash is a polynomial in an odd base over its bytes, mixed; that of a word of more than
    LONG bytes is xxh3. Sums are taken with the powers of places in the stretch and then divided by the power of the word's start. Powers are
    kept and grow with the longest stretch. Hashes of different seeds have nothing in common."""

    def __init__(self, seed: int = 0) -> None:
        self.seed, self.base = seed, (_BASE + seed * 0xD1342543DE82EF96) % (1 << 64) | 1
        self.powers = self.inverses = np.zeros(0, np.uint64)
        #: What each byte adds to a word's sum: 64 mixed bits, 0 for white space.
        self.bytes = np.where(_GAP, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.base)))

    def _grow(self, n: int) -> None:
        size = 1 << max(n - 1, 1 << 12).bit_length()
        for name, base in (("powers", self.base), ("inverses", _inverse(self.base))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def of(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of raw, in order."""
        return self._of(raw)[0]

    def of_each(self, raws: list[bytes]) -> list[np.ndarray]:
        """The same of several stretches, hashed as one."""
        out, starts = self._of(b" ".join(raws))
        ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws])).tolist()
        return [out[a:e] for a, e in zip([0, *ends], ends, strict=False)]

    def _of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of raw and where each starts, in order."""
        b = np.frombuffer(raw, np.uint8)
        if len(b) > len(self.powers):
            self._grow(len(b))
        gap = _GAP[b]
        first = ~gap
        first[1:] &= gap[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        sums = np.add.reduceat(self.bytes[b] * self.powers[: len(b)], starts)
        out = mixed(sums * self.inverses[starts])
        for i in np.flatnonzero(np.diff(starts, append=len(b)) > LONG).tolist():
            start = int(starts[i])
            end = start + int(np.argmax(np.append(gap[start : starts[i + 1] if i + 1 < len(starts) else len(b)], True)))
            if end - start > LONG:
                out[i] = self.long(raw[start:end])
        return out, starts

    def long(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word, self.seed)


def word_hashes(text: str, memo: WordHash) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case; words are runs of other than x20 and x09-x0D."""
    return hashed(text.encode("utf-8", "surrogatepass").lower(), memo)  # bytes.lower() knows ASCII alone


def plain_hashes(text: str, memo: WordHash) -> np.ndarray:
    """Hashes of the words of a text in lower case, with ASCII punctuation taken as white space."""
    return hashed(_plain(text), memo)


def _plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


def plain_hashes_each(texts: list[str], memo: WordHash) -> list[np.ndarray]:
    """The same of each of several texts. Short ones are hashed together, as most of the time for a short text goes into calls."""
    out: list[np.ndarray] = []
    some: list[bytes] = []
    size = 0
    for raw in map(_plain, texts):
        if some and size + len(raw) > TOGETHER:
            out += memo.of_each(some)
            some, size = [], 0
        if len(raw) > TOGETHER:
            out.append(hashed(raw, memo))
        else:
            some.append(raw)
            size += len(raw) + 1
    return out + (memo.of_each(some) if some else [])


def hashed(raw: bytes, memo: WordHash) -> np.ndarray:
    if len(raw) <= CHUNK:
        return memo.of(raw)
    parts, at = [], 0
    while at < len(raw):
        gap = _SPACE.search(raw, min(at + CHUNK, len(raw)))
        end = gap.start() if gap else len(raw)
        if end - at > CHUNK and end - (last := max(at, *(raw.rfind(c, at, end) + 1 for c in _SPACES))) > CHUNK:  # the last word is a long one
            parts += [memo.of(raw[at:last]), np.array([memo.long(raw[last:end])], np.uint64)]
        else:
            parts.append(memo.of(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct k-word shingles, sorted; with fewer words, the whole sequence as one; without words, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = h * np.uint64(_BASE) + words[i : n - width + 1 + i]
    return np.unique(mixed(h))
