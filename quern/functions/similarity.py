"""The ratio of difflib's SequenceMatcher for texts that are nearly equal, with bounds that part the others first."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np

#: Characters of a counted run, numbers that runs are hashed to, and the longest common run that is left to difflib.
RUN, BUCKETS, SHORT = 4, 2048, 8
#: Ratios are rounded to six places before they are compared, so a bound must fall this far below a threshold.
SLACK = 1e-6


def counts(text: str) -> np.ndarray:
    """How often a text's runs of RUN characters fall in each bucket."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = np.zeros(max(len(codes) - RUN + 1, 0), dtype=np.uint64)
    for j in range(RUN):
        h = h * np.uint64(1_000_003) + codes[j : j + len(h)]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((h >> np.uint64(53)).astype(np.int64), minlength=BUCKETS).astype(np.int32)


def bound(left: np.ndarray, right: np.ndarray, length: int) -> float:
    """The best ratio that the counts of two texts of so many characters together allow. M matched characters stand in at most length - 2 M + 1 blocks, as between two blocks a character is left over; a block that is n long has n - RUN + 1 runs in common."""
    shared = int(np.minimum(left, right).sum())
    return 2.0 * (shared + (RUN - 1) * (length + 1)) / ((2 * RUN - 1) * length)


def prefix(a: str, i: int, b: str, j: int) -> int:
    """How many characters from a[i] and b[j] on are equal, by halving."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[i + low : i + mid] == b[j + low : j + mid] else (low, mid - 1)
    return low


def suffix(a: str, i: int, b: str, j: int) -> int:
    """How many characters before a[i] and b[j] are equal."""
    low, high = 0, min(i, j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[i - mid : i - low] == b[j - mid : j - low] else (low, mid - 1)
    return low


def subsequence(a: str, b: str, enough: float = math.inf) -> int:
    """Length of the longest common subsequence, or of the common ends if those are enough; a row of the table in the bits of one number."""
    start = prefix(a, 0, b, 0)
    a, b = a[start:], b[start:]
    end = suffix(a, len(a), b, len(b))
    if start + end >= enough:
        return start + end
    a, b = a[: len(a) - end], b[: len(b) - end]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & every
    return start + end + len(a) - row.bit_count()


def longest(a: str, b: str) -> tuple[int, int, int] | None:
    """The longest common run as (place in a, place in b, length), of several the first in a, then in b; None if it is shorter than SHORT. A run of at least `size` holds one of a's pieces of half that length that stand so far apart, so pieces are looked up in b and widened."""
    size, short = min(len(a), len(b)), 0
    while size >= SHORT:
        k = (size + 1) // 2
        best, ends = None, {}
        for p in range(0, len(a) - k + 1, size - k + 1):
            piece = a[p : p + k]
            q = b.find(piece)
            while q >= 0:
                if p + k > ends.get(q - p, 0):
                    back = suffix(a, p, b, q)
                    n = back + k + prefix(a, p + k, b, q + k)
                    ends[q - p] = p - back + n
                    if best is None or (-n, p - back, q - back) < best:
                        best = (-n, p - back, q - back)
                q = b.find(piece, q + 1)
        short = max(short, -best[0] if best else 0)
        if short >= size:
            return best[1], best[2], short
        size = max(short, size // 2)
    return None


def matched(a: str, b: str, least: float) -> int:
    """The characters in SequenceMatcher's matching blocks: the longest run, then those on its left and right; 0 if they are fewer than `least`."""
    total, open_, rest = 0, min(len(a), len(b)), [(a, b)]
    while rest:
        if total + open_ < least:
            return 0
        x, y = rest.pop()
        open_ -= min(len(x), len(y))
        if min(len(x), len(y)) < 2:
            total += (x in y if len(x) < 2 else y in x) if x and y else 0
        elif found := longest(x, y):
            i, j, k = found
            total += k
            rest += [(x[:i], y[:j]), (x[i + k :], y[j + k :])]
            open_ += min(i, j) + min(len(x) - i - k, len(y) - j - k)
        else:
            total += sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    return total if total >= least else 0


def gate(a: str | None, b: str | None, threshold: float) -> bool:
    """Whether two lengths allow the threshold."""
    n, m = len(a or ""), len(b or "")
    return 2.0 * min(n, m) / max(n + m, 1) >= threshold


def ratio(a: str, b: str, threshold: float) -> float:
    """SequenceMatcher(None, a, b, autojunk=False).ratio(), or 0 where that is below the threshold. A common subsequence holds as many characters at least."""
    least = (threshold - SLACK) * (len(a) + len(b)) / 2
    if not a or not b or subsequence(a, b, least) < least:
        return 0.0
    return 2.0 * matched(a, b, least) / (len(a) + len(b))
