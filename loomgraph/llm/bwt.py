"""Repeated substrings of a few megabytes of text by threshold-bounded interval expansion.

The Burrows-Wheeler transform is expanded breadth first: from the interval of all suffixes that start with a string w,
one backward step per letter c before it leads to the interval of cw. A right boundary that is met for the first time
at depth d separates suffixes with a common prefix of d - 1 letters, so common prefixes come out by increasing value,
each boundary once; at the threshold the expansion stops, and the boundaries it never met separate nothing shorter.
"""

from __future__ import annotations

import numpy as np


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of ``text`` (uint8) by its first ``depth`` or more letters, by prefix doubling from 8 letters on."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        if width >= depth:
            return order
        s = key[order]
        new = np.empty(n, np.uint64)
        new[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.uint64)])).astype(np.uint64)
        later = np.zeros(n, np.uint64)
        later[: max(0, n - width)] = new[width:]
        key = new << np.uint64(32) | later
        width *= 2


def classes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each place in it): suffixes of one class share their first ``least`` letters.

    Classes of suffixes shorter than ``least`` mean nothing; the caller leaves those out.
    """
    n = len(text) + 1  # the empty suffix stands first and is preceded by the last letter
    order = suffixes(text, least)
    at = np.concatenate([[len(text)], order])
    before = np.where(at > 0, text[at - 1].astype(np.int16), -1)  # the transform; nothing precedes the whole text
    by_letter = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one letter longer stands
    step[by_letter] = np.arange(n)
    same = before[by_letter[1:]] == before[by_letter[:-1]]
    following, previous = np.full(n, n), np.full(n, -1)
    following[by_letter[:-1][same]] = by_letter[1:][same]
    previous[by_letter[1:][same]] = by_letter[:-1][same]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        sizes = high - low + 1
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
        first = previous[inside] < np.repeat(low, sizes)
        last = following[inside] > np.repeat(high, sizes)
        # intervals of strings of one length are disjoint, so their sorted ends belong together
        low, high = np.sort(step[inside[first]]), np.sort(step[inside[last]])
        new = ~met[high + 1]
        low, high = low[new], high[new]
        if not len(low):
            break
        met[high + 1] = True
    return order, np.cumsum(met[1:n])
