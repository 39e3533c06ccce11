"""Texts as arrays of lower-case letters."""

from __future__ import annotations

import numpy as np
import regex

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point the lower case of a letter (its first character), else 0."""
    if not _letters:
        table = np.zeros(0x110000, dtype=np.uint32)
        everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
        for m in regex.finditer(r"\p{L}+", everything):
            table[m.start() : m.end()] = [ord(c.lower()[0]) for c in m.group()]
        _letters.append(table)
    return _letters[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in them) of texts in a UTF-8 buffer."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b0 = data[at].astype(np.uint32)
    if len(at) < len(data):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
        wide = np.flatnonzero(b0 >= 0xC0)
        x, p = b0[wide], at[wide]
        b1, b2, b3 = (padded[p + i] & 63 for i in (1, 2, 3))
        b0[wide] = np.where(x < 0xE0, (x & 31) << 6 | b1, np.where(x < 0xF0, (x & 15) << 12 | b1 << 6 | b2, (x & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    before = np.concatenate(([0], np.cumsum(lead)))
    return b0, before[offsets]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letters, 0 for anything else; offsets) of texts in a UTF-8 buffer."""
    points, at = code_points(data, offsets)
    return letter_table()[np.minimum(points, 0x10FFFF)], at
