"""Counts over whole texts in numpy, in windows, so that memory stays bounded however long a text is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points taken at a time.
WINDOW = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def windows(text: str, overlap: int) -> Iterator[np.ndarray]:
    """Code points in windows of WINDOW and `overlap` more; n-grams that start among the first WINDOW belong to a window."""
    for at in range(0, max(len(text), 1), WINDOW):
        yield code_points(text[at : at + WINDOW + overlap])
