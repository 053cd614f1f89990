"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by binary trie self-joins.

Fingerprints are leaves of a binary trie over their bits. The join walks pairs of nodes of
equal depth together, adds a bit to the pair's differences where it takes different
branches, and drops a pair whose differences exceed the budget. Two fingerprints within the
radius k differ in at most k // 2 bits of one of their halves, so the join runs twice, once
with each half on top, and the budget down to depth 32 is k // 2: few pairs survive.

The work is dealt by pairs of prefixes: a unit holds the fingerprints of two prefixes within
the budget. Prefixes lengthen until no unit is large, and exact copies share one
fingerprint, so neither copies nor crowded prefixes gather in a task (hashes spread evenly: the
longest prefix tried has room for some billions of fingerprints). Where a link within the
radius is all that counts, a unit returns a spanning forest of what it has linked, not its
pairs; node pairs whose leaves are already in one component are dropped. Where the texts of
links are compared too, that is done inside the links' components, by units that return a
spanning forest as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import MAX_BROADCAST_IDS, drop_ids, lower_ascii, map_rows, materialise, words_of
from kindred.llm.components import connected_components

#: Most fingerprints of one prefix in a unit, and the prefix lengths tried for it.
UNIT_ROWS, PREFIX_BITS = 100_000, (4, 6, 8, 10, 12, 14, 16)
#: Node pairs expanded at once, leaf pairs of a node pair that are compared directly, and leaf pairs compared at once.
BLOCK, LEAF_PAIRS, AT_ONCE = 1 << 15, 64, 1 << 21


def shingles(text: str | None, width: int) -> list[str]:
    """Shingles of lower-cased words, repeats included; the whole sequence if shorter, none for no words."""
    words = words_of(lower_ascii(text or ""))
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def fingerprint(features: list[str]) -> int:
    """Bits set in over half of the features' XXH64 hashes (seed 42); zero for no features."""
    if not features:
        return 0
    digest = b"".join([xxhash.xxh64_digest(s.encode(), 42) for s in features])
    ones = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(features)).tobytes(), "big")


def shingle_hashes(words: list[str], hashes: dict[str, int], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the words' shingles, made of ``hashes`` of the words, in order."""
    word = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1) if words else 0
    made = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        made = (made ^ word[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
    return np.unique(made)


def bitmap(hashes: np.ndarray, per_hash: int = 1) -> bytes:
    """One bit set for each hash; ``per_hash`` bits a hash or up to twice that, a power of two, 64 at least."""
    size = max(64, 1 << (per_hash * len(hashes) - 1).bit_length()) if len(hashes) else 64
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_agree(a: bytes, n_a: int, b: bytes, n_b: int, threshold: float) -> bool:
    """False only if sets of ``n_a`` and ``n_b`` hashes with these bitmaps have a Jaccard similarity below ``threshold``.

    A bit that is set on one side only is a hash at least that the other set doesn't have.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    most = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return most + 1e-6 >= threshold * (n_a + n_b - most)


def word_fingerprint(words: list[str]) -> int:
    """SimHash of the words with the square roots of their counts as weights."""
    if not words:
        return 0
    counts = Counter(words)
    digest = b"".join([xxhash.xxh64_digest(w.encode(), 42) for w in counts])
    bits = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    weights = np.sqrt(np.fromiter(counts.values(), np.float32))
    return int.from_bytes(np.packbits(2 * (weights @ bits) > weights.sum()).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """Return ``doc_id, fp`` (the 64 bits as a signed long) of every row of ``docs(doc_id, text)``."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [fingerprint(shingles(t, width)) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "fp": [x - (1 << 64) if x >> 63 else x for x in found]}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, fp long")


class Forest:
    """Components of leaves, joined as pairs come; labels are kept flat so that ranges can be compared.

    Labels given are those of components that the leaves are already in.
    """

    def __init__(self, n: int, label: np.ndarray | None = None) -> None:
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.label = np.arange(n) if label is None else label
        self._ranges()

    def _ranges(self) -> None:
        ends = np.append(np.flatnonzero(np.diff(self.label)) + 1, len(self.label))
        self.until = ends[np.searchsorted(ends, np.arange(len(self.label)), side="right")]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        label = self.label
        while True:
            x, y = label[a], label[b]
            if not (open_ := x != y).any():
                break
            a, b = a[open_], b[open_]
            low, high = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
            # each root hooks onto its lowest neighbour, by one pair
            order = np.lexsort((low, high))
            first = order[np.append(True, np.diff(high[order]) > 0)]
            label[high[first]] = low[first]
            self.edges.append((a[first], b[first]))
            while (label[label] != label).any():
                label = label[label]
        self.label = label
        self._ranges()

    def settled(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Node pairs of which all leaves are in one component."""
        return (self.until[a0] >= a1) & (self.until[b0] >= b1) & (self.label[a0] == self.label[b0])


def trie_join(leaves: np.ndarray, split: int, radius: int, depth: int = 0, forest: Forest | None = None) -> Forest:
    """Link leaves within ``radius`` bits.

    ``leaves[:split]`` and ``leaves[split:]`` are sorted, each sharing its first ``depth`` bits:
    the leaves of two trie nodes to be joined. ``split`` = all of them: one node with itself.
    A forest given goes on from the components that it has.
    """
    forest = Forest(len(leaves)) if forest is None else forest
    for x, y in near_pairs(leaves, split, radius, depth, forest):
        forest.join(x, y)
    return forest


def near_pairs(leaves: np.ndarray, split: int, radius: int, depth: int, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves, as ``trie_join`` takes them, within ``radius`` bits; some or all of those inside one component of ``forest`` are left out.

    In a node with itself a pair may come both ways round.
    """
    n, half = len(leaves), radius // 2
    one = np.uint64(1)
    same = split == n
    apart = 0 if same or not split else int(np.bitwise_count((leaves[0] ^ leaves[-1]) >> np.uint64(64 - depth))) if depth else 0
    if n < 2 or not split or apart > (half if depth <= 32 else radius):
        return
    first = np.array([[0, split, 0 if same else split, n, apart]])
    stack = [(depth, first)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > BLOCK:
            stack += [(depth, pairs[:-BLOCK]), (depth, pairs[-BLOCK:])]
            continue
        a0, a1, b0, b1, acc = pairs.T
        pairs = pairs[~forest.settled(a0, a1, b0, b1)]
        a0, a1, b0, b1, acc = pairs.T
        # all leaves below are within the radius
        near = acc + (64 - depth) <= radius
        small = near | ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS)
        if small.any():
            x0, x1, y0, y1 = a0[small], a1[small], b0[small], b1[small]
            wide = y1 - y0
            every = (x1 - x0) * wide
            group = np.cumsum(every) // AT_ONCE
            for lo, hi in zip(np.flatnonzero(np.diff(group, prepend=-1)).tolist(), [*np.flatnonzero(np.diff(group) > 0) + 1, len(group)], strict=True):
                count = every[lo:hi]
                at = lo + np.repeat(np.arange(len(count)), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                x, y = x0[at] + k // wide[at], y0[at] + k % wide[at]
                linked = (x != y) & (np.bitwise_count(leaves[x] ^ leaves[y]) <= radius)
                if linked.any():
                    yield x[linked], y[linked]
        pairs = pairs[~small]
        if depth == 64 or not len(pairs):
            continue
        a0, a1, b0, b1, acc = pairs.T
        high = ~np.uint64((1 << (64 - depth)) - 1) if depth else np.uint64(0)
        bit = one << np.uint64(63 - depth)

        def middle(lo: np.ndarray, hi: np.ndarray, high: np.uint64 = high, bit: np.uint64 = bit) -> np.ndarray:
            want = (leaves[lo] & high) | bit
            left = lo < split
            found = np.where(left, np.searchsorted(leaves[:split], want), 0)
            if split < n:
                found = np.where(left, found, split + np.searchsorted(leaves[split:], want))
            return np.clip(found, lo, hi)

        am, bm = middle(a0, a1), middle(b0, b1)
        itself = a0 == b0
        most = half if depth < 32 else radius
        children = np.concatenate([np.stack([a0, am, b0, bm, acc], 1), np.stack([am, a1, bm, b1, acc], 1), np.stack([a0, am, bm, b1, acc + 1], 1), np.stack([am, a1, b0, bm, acc + 1], 1)[~itself]])
        live = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= most)
        stack.append((depth + 1, children[live]))


def _prefix_masks(bits: int, differ: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(differ + 1) for c in combinations(range(bits), r)]


def _prefix_length(leaves: DataFrame) -> int:
    """The shortest prefix of which no value has over ``UNIT_ROWS`` fingerprints (else the longest)."""
    longest = PREFIX_BITS[-1]
    counts = leaves.groupBy("turn", F.shiftrightunsigned("leaf", 64 - longest).alias("top")).count()
    by_length = counts.select("turn", "count", "top", F.explode(F.array(*map(F.lit, PREFIX_BITS))).alias("bits"))
    cut = F.expr(f"shiftright(top, {longest} - bits)")
    largest = by_length.groupBy("turn", "bits", cut.alias("prefix")).agg(F.sum("count").alias("n")).groupBy("bits").agg(F.max("n").alias("n")).collect()
    return min((r["bits"] for r in largest if r["n"] <= UNIT_ROWS), default=longest)


def _dealt(fps: DataFrame, radius: int, *more: str) -> tuple[DataFrame, int]:
    """Rows ``turn, low, high, leaf`` and columns ``more`` of ``fps(fp)`` in the units that join them, and the length of their prefixes."""
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    leaves = fps.select(F.lit(0).alias("turn"), F.col("fp").alias("leaf"), *more).unionByName(fps.select(F.lit(1).alias("turn"), turned.alias("leaf"), *more))
    bits = _prefix_length(leaves)
    own = F.shiftrightunsigned("leaf", 64 - bits).cast("int")
    dealt = leaves.select("turn", "leaf", *more, own.alias("own"), F.explode(F.array(*map(F.lit, _prefix_masks(bits, radius // 2)))).alias("mask"))
    dealt = dealt.withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    return dealt.select("turn", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "leaf", *more), bits


def _split(leaf: np.ndarray, low: int, high: int, bits: int) -> int:
    """Where the leaves of the prefix ``high`` begin; all of them if there is one prefix."""
    return len(leaf) if low == high else int(np.searchsorted(leaf >> np.uint64(64 - bits), np.uint64(high)))


def _turned_back(leaf: np.ndarray) -> np.ndarray:
    return (leaf << np.uint64(32)) | (leaf >> np.uint64(32))


def link_forest(fps: DataFrame, radius: int, nearest: bool = False) -> DataFrame:
    """Spanning edges ``a, b`` of the links within ``radius`` between the distinct values of ``fps(fp)``.

    ``nearest``: of least Hamming distance, by joins of growing radius.
    """
    dealt, bits = _dealt(fps, radius)

    def join_unit(key: tuple, rows: pa.Table) -> pa.Table:
        turn, low, high = (k.as_py() for k in key)
        leaf = np.sort(rows.column("leaf").to_numpy().view(np.uint64))
        split = _split(leaf, low, high, bits)
        forest = Forest(len(leaf))
        for r in range(1, radius + 1) if nearest else [radius]:
            trie_join(leaf, split, r, bits, forest)
        none = np.zeros(0, np.int64)
        ends = [leaf[np.concatenate([none, *[e[i] for e in forest.edges]])] for i in range(2)]
        if turn:
            ends = [_turned_back(x) for x in ends]
        return pa.table({"a": ends[0].view(np.int64), "b": ends[1].view(np.int64)})

    return dealt.groupBy("turn", "low", "high").applyInArrow(join_unit, "a long, b long")


def open_links(fps: DataFrame, radius: int, threshold: float) -> DataFrame:
    """All links ``a, b`` within ``radius`` between values of ``fps(fp, label, least_size, most_size)``, once each, but those that can't tell anything.

    Those are links of equal labels (null: equal to none) and those of sizes that rule out a
    Jaccard similarity of ``threshold``. ``fp`` is unique.
    """
    dealt, bits = _dealt(fps, radius, "label", "least_size", "most_size")

    def join_unit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, low, high = (k.as_py() for k in key)
        rows = pa.Table.from_batches(list(batches))
        leaf = rows.column("leaf").to_numpy().view(np.uint64)
        order = np.argsort(leaf)
        leaf = leaf[order]
        label = rows.column("label").combine_chunks()
        _, number = np.unique(label.fill_null(0).to_numpy(zero_copy_only=False)[order], return_inverse=True)
        # a null label is one of its own
        alone = label.is_null().to_numpy(zero_copy_only=False)[order]
        number = np.where(alone, -1 - np.arange(len(leaf)), number)
        least, most = (rows.column(c).to_numpy()[order] for c in ("least_size", "most_size"))
        for x, y in near_pairs(leaf, _split(leaf, low, high, bits), radius, bits, Forest(len(leaf), number)):
            x, y = np.minimum(x, y), np.maximum(x, y)
            open_ = (number[x] != number[y]) & (most[x] + 1e-6 >= threshold * least[y]) & (most[y] + 1e-6 >= threshold * least[x])
            # a pair is of the first turn if few of its differences are in the upper half
            upper = np.bitwise_count((leaf[x] ^ leaf[y]) & np.uint64(0xFFFFFFFF if turn else 0xFFFFFFFF << 32))
            open_ &= upper > radius // 2 if turn else upper <= radius // 2
            pairs = np.unique(np.stack([x[open_], y[open_]], 1), axis=0)
            a, b = leaf[pairs[:, 0]], leaf[pairs[:, 1]]
            if turn:
                a, b = _turned_back(a), _turned_back(b)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("turn", "low", "high").applyInArrow(join_unit, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 5) -> DataFrame:
    """Return ``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id that links reach, itself included. Texts with no word
    (null, empty, white space) have fingerprint zero and are linked like any other; repeated
    rows stay repeated; a null id never is a component's smallest unless all its ids are null;
    an empty table gives an empty result and other columns are ignored.
    """
    found = materialise(fingerprints(docs, width), "fingerprints")
    classes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = connected_components(link_forest(classes.select("fp"), radius))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "n", "component_id")
    return place(found, named, "fp").select("doc_id", "fp", "component_id")


def place(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Join ``component_id`` to ``rows`` by ``key``, unique in ``named(key, n, component_id)``, where ``n`` is how many rows have it.

    Of n rows, under a thousand keys can have over n / 1000 each: those hot keys are few
    enough to broadcast, whatever n is; the others are joined by a shuffle.
    """
    named = materialise(named.select(key, "n", "component_id"), "named")
    hot = named.where(F.col("n") > max(rows.count() // 1000, 1000)).select(key, F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")).limit(1000)
    known = rows.join(F.broadcast(hot), key, "left")
    cold = known.where("is_hot is null").select(*rows.columns).join(named.select(key, "component_id"), key)
    return known.where("is_hot").select(*rows.columns, F.col("hot_id").alias("component_id")).unionByName(cold.select(*rows.columns, "component_id"))


#: Radius of the word fingerprints whose texts are compared: texts of which four fifths of the shingles agree differ in 3 bits at the median.
WORD_RADIUS = 7

#: Classes of a block of a large cluster (a unit compares two), blocks of a cluster while they don't grow, and most classes of a block.
BLOCK_ROWS, BLOCKS, MOST_BLOCK_ROWS = 128, 16, 1 << 14

#: Bits of a bitmap for each hash of a set (up to twice that), and most rows of units that are broadcast to the sets.
BITS_PER_HASH, MAX_BROADCAST_UNIT_ROWS = 4, 75_000


def maybe_similar(fps: np.ndarray, size: np.ndarray, bits: list[np.ndarray], radius: int, threshold: float, cluster: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
    """True for rows of a pair that ``similar_forest`` may find, by the bitmaps of sets of ``size`` hashes: never false for a row of such a pair."""
    width = np.array([len(x) for x in bits], np.int64)
    whole, half, at = {}, {}, np.zeros(len(bits), np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        at[rows] = np.arange(len(rows))
        whole[w] = np.stack([bits[i] for i in rows])
        half[w] = whole[w][:, : w // 2] | whole[w][:, w // 2 :]
    found = np.zeros(len(bits), bool)
    for x in range(len(bits) - 1):
        near = (np.bitwise_count(fps[x + 1 :] ^ fps[x]) <= radius) & (cluster[x + 1 :] == cluster[x])
        near &= np.minimum(size[x + 1 :], size[x]) + 1e-6 >= threshold * np.maximum(size[x + 1 :], size[x])
        near &= (size[x + 1 :] > 0) & ~(found[x + 1 :] & found[x])
        if part is not None:
            near &= part[x + 1 :] != part[x]
        left = x + 1 + np.flatnonzero(near)
        w = int(width[x])
        # bitmaps of other widths aren't compared
        open_ = left[(width[left] != w) & (width[left] != 2 * w) & (2 * width[left] != w)]
        found[open_] = True
        found[x] |= len(open_) > 0
        for other, mine, theirs in ((w, whole, whole), (2 * w, whole, half), (w // 2, half, whole)):
            some = left[width[left] == other]
            for lo in range(0, len(some), 1024):
                y = some[lo : lo + 1024]
                a, b = mine[w][at[x]], theirs[other][at[y]]
                # a bit that is set on one side only is a hash at least that the other set doesn't have
                most = np.minimum(size[x] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), size[y] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                y = y[most + 1e-6 >= threshold * (size[x] + size[y] - most)]
                found[y] = True
                found[x] |= len(y) > 0
    return found


def similar_forest(fps: np.ndarray, sets: list[np.ndarray], radius: int, threshold: float, cluster: np.ndarray, part: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Spanning edges of the pairs within ``radius`` bits whose sets have a Jaccard similarity of ``threshold`` or more.

    ``sets`` are without repeats. Every pair of one cluster (and, given their parts, of different parts) is compared but those inside one component of what has passed and those whose sizes rule it out.
    """
    size = np.array([len(x) for x in sets], np.int64)
    start = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    mine, label = np.zeros(len(values), bool), np.arange(len(sets))
    for x in range(len(sets) - 1):
        near = (np.bitwise_count(fps[x + 1 :] ^ fps[x]) <= radius) & (label[x + 1 :] != label[x])
        near &= cluster[x + 1 :] == cluster[x]
        near &= np.minimum(size[x + 1 :], size[x]) + 1e-6 >= threshold * np.maximum(size[x + 1 :], size[x])
        if part is not None:
            near &= part[x + 1 :] != part[x]
        left = x + 1 + np.flatnonzero(near & (size[x + 1 :] > 0))
        if not len(left):
            continue
        own = flat[start[x] : start[x] + size[x]]
        mine[own] = True
        while len(left):
            some, left = left[:4096], left[4096:]
            first = np.cumsum(size[some]) - size[some]
            at = np.arange(size[some].sum()) + np.repeat(start[some] - first, size[some])
            shared = np.add.reduceat(mine[flat[at]], first, dtype=np.int64)
            for y in some[shared >= threshold * (size[x] + size[some] - shared)].tolist():
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    yield x, y
        mine[own] = False


def in_units(rows: DataFrame) -> DataFrame:
    """``rows(cluster, least, fp, ...)`` as often as units compare them, with the columns ``unit, low, high, part``.

    Small clusters share a unit, and large ones are cut into blocks whose pairs are the units. Of a cluster of up to
    ``BLOCKS * MOST_BLOCK_ROWS`` rows, each is sent ``BLOCKS`` times at most, of a larger one once a block.
    """
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > BLOCK_ROWS)
    # one of BLOCK_ROWS rows at most
    large = materialise(sizes.select("cluster", F.ceil(F.col("n_rows") / F.least(F.lit(MOST_BLOCK_ROWS), F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("n_rows") / BLOCKS)))).cast("int").alias("blocks")), "large")
    units = max(1, rows.count() // (2 * BLOCK_ROWS))
    known = rows.join(F.broadcast(large) if large.count() <= MAX_BROADCAST_IDS else large, "cluster", "left")
    few = known.where("blocks is null").select(F.pmod(F.xxhash64("cluster"), F.lit(units)).alias("unit"), F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.lit(-1).alias("part"), *rows.columns)
    part = F.pmod(F.xxhash64("least", "fp"), "blocks").cast("int")
    many = known.where("blocks is not null").select(F.col("cluster").alias("unit"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), *rows.columns)
    many = many.select("unit", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", *rows.columns)
    return few.unionByName(many)


def similar_links(rows: DataFrame, radius: int, threshold: float) -> DataFrame:
    """Edges ``a, b`` that connect what the similar pairs of ``rows(cluster, least, fp, sh)`` connect; pairs of different clusters aren't tried.

    ``sh`` has the 64-bit hashes of a set. Units first get bitmaps, a tenth of the sets, and tell which of their rows have a pair
    that bitmaps don't rule out; only those rows' sets are sent to that unit, which compares them exactly.
    Neither the rows of a unit nor those that it returns grow with the square of a cluster.
    """
    row = ["cluster", "least", "fp", "key"]
    rows = rows.withColumn("key", F.xxhash64("sh"))

    def sketch(found: dict[str, list]) -> dict[str, list]:
        sets = [np.frombuffer(x, np.uint64) for x in found["sh"]]
        return {c: found[c] for c in row} | {"n": [len(x) for x in sets], "bits": [bitmap(x, BITS_PER_HASH) for x in sets]}

    # rows of one key have equal sets
    sketches = materialise(map_rows(rows, sketch, "cluster long, least long, fp long, key long, n long, bits binary").dropDuplicates(row), "sketches")

    def parts_of(key: tuple, found: pa.Table) -> np.ndarray | None:
        return found.column("part").to_numpy() if key[1].as_py() != key[2].as_py() else None

    def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), np.uint64) for chunk in column.chunks for x in chunk]

    def pick(key: tuple, found: pa.Table) -> pa.Table:
        fps, n, cluster = (found.column(c).to_numpy() for c in ("fp", "n", "cluster"))
        open_ = maybe_similar(fps.view(np.uint64), n, arrays(found.column("bits")), radius, threshold, cluster, parts_of(key, found))
        return found.select(["unit", "low", "high", "part", *row]).filter(pa.array(open_))

    def compare(key: tuple, found: pa.Table) -> pa.Table:
        edges = np.array(list(similar_forest(found.column("fp").to_numpy().view(np.uint64), arrays(found.column("sh")), radius, threshold, found.column("cluster").to_numpy(), parts_of(key, found))), np.int64).reshape(-1, 2)
        least = found.column("least").to_numpy()
        return pa.table({"a": least[edges[:, 0]], "b": least[edges[:, 1]]})

    unit = ["unit", "low", "high"]
    open_ = materialise(in_units(sketches).groupBy(*unit).applyInArrow(pick, "unit long, low int, high int, part int, cluster long, least long, fp long, key long"), "maybe")
    sets = rows.join(F.broadcast(open_) if open_.count() <= MAX_BROADCAST_UNIT_ROWS else open_, row).select(*unit, "part", "cluster", "least", "fp", "sh")
    return sets.groupBy(*unit).applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Return ``doc_id, component_id`` of the rows of ``docs(doc_id, text)`` that are copies of a row with a smaller id.

    Texts of the same lower-cased words are one class. Classes are joined by the trie join
    on word fingerprints, which differ in few bits where a few words do, unlike those of
    shingles. The links' components are clusters, in which all links within the radius are tried,
    and those stay whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold``
    or more. Tasks return spanning edges of those, not pairs. Texts with no words (null, empty, white space)
    are one class; very long texts are read whole. Rows with a null id are never copies; a repeated
    row is one copy; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """

    def hashed(text: str | None) -> tuple[list[str], str, np.ndarray]:
        words = words_of(lower_ascii(text or ""))
        found = shingle_hashes(words, {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in set(words)}, width)
        return words, xxhash.xxh3_128_hexdigest(" ".join(words).encode()), found

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": rows["doc_id"], "same": [], "alike": [], "fp": []}
        for t in rows["text"]:
            words, same, found = hashed(t)
            fp = word_fingerprint(words)
            out["same"].append(same)
            out["alike"].append(xxhash.xxh3_128_hexdigest(found.tobytes()) if words else None)
            out["fp"].append(fp - (1 << 64) if fp >> 63 else fp)
        return out

    def shingle_sets(rows: dict[str, list]) -> dict[str, list]:
        found = [hashed(t) for t in rows["text"]]
        return {"least": rows["doc_id"], "same": [same for _, same, _ in found], "sh": [sh.tobytes() for _, _, sh in found]}

    rows = materialise(map_rows(docs.select("doc_id", "text").where("doc_id is not null"), run, "doc_id long, same string, alike string, fp long"), "words")
    # equal words have equal hashes and fingerprints; classes go by their least id
    facts = [F.min(c).alias(c) for c in ("alike", "fp")]
    classes = materialise(rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *facts), "classes")
    # classes of the same shingles hang from the least of them
    first = classes.groupBy("alike").agg(F.min("least").alias("a")).where("alike is not null")
    equal = classes.join(first, "alike").where("least <> a").select("a", F.col("least").alias("b"))
    # what has a link, or shares its fingerprint
    fps = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    clusters = connected_components(link_forest(classes.select("fp").distinct(), WORD_RADIUS)).withColumnRenamed("node", "fp")
    linked = fps.join(clusters, "fp", "left").where("root is not null or n > 1").select("fp", "n", F.coalesce("root", "fp").alias("component_id"))
    open_ = materialise(place(classes.select("same", "least", "fp"), linked, "fp").withColumnRenamed("component_id", "cluster"), "open")
    ends = open_.select(F.col("least").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ends) if open_.count() <= MAX_BROADCAST_IDS else ends, "doc_id")
    sets = map_rows(texts, shingle_sets, "least long, same string, sh binary").dropDuplicates(["least", "same"])
    tried = materialise(open_.join(sets, ["least", "same"]).select("cluster", "least", "fp", "sh"), "sets")
    roots = connected_components(equal.unionByName(similar_links(tried, WORD_RADIUS, threshold)))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    moved = materialise(roots.join(least, "root").select(F.col("node").alias("least"), "component_id"), "moved")
    named = classes.join(moved, "least", "left").select("same", "n", F.coalesce("component_id", "least").alias("component_id"))
    return place(rows.select("doc_id", "same"), named, "same").where("doc_id <> component_id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Rows of ``docs``, all columns (those of clashing names too), but the near copies of one with a smaller id.

    Rows that repeat an id stay or go together, rows with a null id stay, texts with no words
    are copies of each other, an empty table gives an empty result.
    """
    return drop_ids(docs, near_copies(docs, threshold, width).select("doc_id"))
