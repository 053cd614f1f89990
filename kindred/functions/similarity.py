"""String similarities on normalised Indel (longest common subsequence), in Arrow batches over distinct pairs.

Each measure has a form for one pair, which says what it is, and one for many pairs, which
works on all of a batch together, array operation by array operation.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit a character of ``a``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS / total length; 1 for two blanks, 0 for one."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2 * lcs_length(a, b) / (len(a) + len(b))


def window_lcs(a: str, b: str) -> list[int]:
    """LCS lengths of ``a`` with every window of ``b`` of its length, those cut at the ends included, from left to right.

    Strands of a grid of both texts are combed once: a strand that enters above position i of
    ``b`` and leaves below before j stands for a character of the window [i, j) that no common
    subsequence uses. Windows are then counted by sliding.
    """
    m, n = len(a), len(b)
    below = list(range(m, m + n))
    for i in range(m):
        ch, strand = a[i], m - 1 - i
        for j in range(n):
            if b[j] == ch or strand > below[j]:
                strand, below[j] = below[j], strand
    leaves_at = {s - m: j for j, s in enumerate(below) if s >= m}
    enters_at = {j: i for i, j in leaves_at.items()}
    unused, found, low = 0, [], 0
    for end in range(1, n + m):
        high = min(end, n)
        if end <= n and enters_at.get(end - 1, -1) >= low:
            unused += 1
        if end > m:
            if leaves_at.get(low, n + 1) < high:
                unused -= 1
            low += 1
        found.append(high - low - unused)
    return found


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer, those cut at the ends included."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _best_window(a: str, b: str) -> float:
    m, n = len(a), len(b)
    return max(2 * k / (m + min(end, n) - max(0, end - m)) for end, k in enumerate(window_lcs(a, b), 1))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared tokens and the shared with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 1.0 if a == b else 0.0
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, (shared, " ".join(sorted(s))))) for s in (x - y, y - x))
    best = ratio(left, right)
    return max(best, ratio(shared, left), ratio(shared, right)) if shared else best


SIMILARITIES = {"edit": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio}
_STRUCT = T.StructType([T.StructField(k, T.DoubleType()) for k in SIMILARITIES])

#: Pairs of strings that are worked on at once, and the longest of them (others go one by one).
AT_ONCE, LONGEST = 8192, 63


def _matrices(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Characters as small numbers, a row a string, filled up by numbers that match nothing; lengths; and how many numbers there are."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    points = np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), "<u4")
    _, number = np.unique(points, return_inverse=True)
    n, cut, out = int(number.max(initial=-1)) + 1, 0, []
    for k, size in enumerate(sizes):
        made = np.full((len(size), int(size.max(initial=0))), n + k, np.int64)
        made[np.arange(made.shape[1]) < size[:, None]] = number[cut : cut + size.sum()]
        cut += int(size.sum())
        out.append(made)
    return *out, *sizes, n + 2


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, ``a`` of at most 63 characters: one bit a character, all pairs together."""
    x, y, m, _, n = _matrices(a, b)
    rows = np.arange(len(x))
    masks = np.zeros((len(x), n), np.uint64)
    for i in range(x.shape[1]):
        masks[rows, x[:, i]] |= np.uint64(1) << np.uint64(i)
    masks[:, n - 2 :] = 0
    full = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for j in range(y.shape[1]):
        hit = row & masks[rows, y[:, j]]
        row = ((row + hit) | (row - hit)) & full
    return m - np.bitwise_count(row).astype(np.int64)


def best_windows(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of each ``a`` with the windows of its ``b``, as ``window_lcs`` has them, all pairs together; neither is blank."""
    x, y, m, n, _ = _matrices(a, b)
    size, high = x.shape[1], y.shape[1]
    below = np.repeat(np.arange(size, size + high, dtype=np.int32)[:, None], len(x), 1)
    columns = np.ascontiguousarray(y.T)
    for i in range(size):
        ch, strand = x[:, i], np.full(len(x), size - 1 - i, np.int32)
        for j in range(high):
            swap = (columns[j] == ch) | (strand > below[j])
            strand, below[j] = np.where(swap, below[j], strand), np.where(swap, strand, below[j])
    rows = np.arange(len(x))
    enters, leaves = np.full((high, len(x)), -1, np.int32), np.full((high, len(x)), high + 1, np.int32)
    j, k = np.nonzero(below >= size)
    i = below[j, k] - size
    enters[j, k], leaves[i, k] = i, j
    unused, low, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
    for end in range(1, int((m + n).max())):
        stop, live = np.minimum(end, n), end < m + n
        if end <= high:
            unused += (end <= n) & (enters[end - 1] >= low)
        moves = live & (end > m)
        unused -= moves & (leaves[np.minimum(low, high - 1), rows] < stop)
        low += moves
        found = 2 * (stop - low - unused) / np.maximum(1, m + stop - np.maximum(0, end - m))
        best = np.where(live, np.maximum(best, found), best)
    return best


def _in_groups(a: list[str], b: list[str], some, one) -> np.ndarray:
    """``some(a, b)`` of pairs of at most ``LONGEST`` characters, those of like lengths together, and ``one`` of each of the others."""
    out = np.zeros(len(a))
    short = [i for i in range(len(a)) if len(a[i]) <= LONGEST and len(b[i]) <= LONGEST]
    short.sort(key=lambda i: (len(a[i]), len(b[i])))
    for at in range(0, len(short), AT_ONCE):
        ids = short[at : at + AT_ONCE]
        out[ids] = some([a[i] for i in ids], [b[i] for i in ids])
    for i in set(range(len(a))).difference(short):
        out[i] = one(a[i], b[i])
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of pairs."""
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    rest = [i for i in range(len(a)) if a[i] and b[i] and a[i] != b[i]]
    # the shorter first: it has the bits
    x, y = [min(a[i], b[i], key=len) for i in rest], [max(b[i], a[i], key=len) for i in rest]
    if rest:
        total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
        out[rest] = 2 * _in_groups(x, y, lcs_lengths, lcs_length) / total
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``partial_ratio`` of pairs."""
    out, rest, x, y = np.zeros(len(a)), [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        p, q = (p, q) if len(p) <= len(q) else (q, p)
        if not p:
            out[i] = float(p == q)
        elif p in q:
            out[i] = 1.0
        else:
            for both in ((p, q), (q, p)) if len(p) == len(q) else ((p, q),):
                rest.append(i)
                x.append(both[0])
                y.append(both[1])
    if rest:
        np.maximum.at(out, rest, _in_groups(x, y, best_windows, _best_window))
    return out


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``token_set_ratio`` of pairs."""
    out, rest, x, y = np.zeros(len(a)), [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        s, t = set(p.split()), set(q.split())
        if not s or not t:
            out[i] = float(p == q)
            continue
        shared = " ".join(sorted(s & t))
        if shared and (s <= t or t <= s):
            out[i] = 1.0
            continue
        left, right = (" ".join(filter(None, (shared, " ".join(sorted(z))))) for z in (s - t, t - s))
        for both in ((left, right), (shared, left), (shared, right)) if shared else ((left, right),):
            rest.append(i)
            x.append(both[0])
            y.append(both[1])
    if rest:
        np.maximum.at(out, rest, ratios(x, y))
    return out


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``token_sort_ratio`` of pairs."""
    return ratios([" ".join(sorted(x.split())) for x in a], [" ".join(sorted(x.split())) for x in b])


MANY = {"edit": ratios, "partial": partial_ratios, "token_sort": token_sort_ratios, "token_set": token_set_ratios}


def distinct_pairs(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray]:
    """The different pairs of a batch, and the place of each row's pair among them."""
    (i, left), (j, right) = (pd.factorize(x.fillna("")) for x in (a, b))
    at, kept = pd.factorize(i.astype("int64") * max(len(right), 1) + j)
    return left[kept // max(len(right), 1)].tolist(), right[kept % max(len(right), 1)].tolist(), at


@F.pandas_udf(_STRUCT)
def all_similarities(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The four similarities of string pairs, worked out once for each different pair of a batch."""
    x, y, at = distinct_pairs(a, b)
    return pd.DataFrame({k: f(x, y)[at] for k, f in MANY.items()}, columns=list(MANY))


@F.pandas_udf(T.DoubleType())
def edit_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y, at = distinct_pairs(a, b)
    return pd.Series(ratios(x, y)[at], dtype="float64")


@F.pandas_udf(T.DoubleType())
def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio; 1 for two blanks."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def with_similarities(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add struct ``out`` with the four similarities of columns ``a`` and ``b``.

    Nothing is joined: a join on few different strings deals many pairs to one task, and repeats
    all that comes before it in the plan.
    """
    return pairs.withColumn(out, all_similarities(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets: 1 for two empty, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
