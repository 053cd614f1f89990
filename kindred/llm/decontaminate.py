"""Benchmark decontamination: passages of texts that are near copies of benchmark items.

Item-sized windows of a text get SimHash fingerprints. Multi-index Hamming blocks, joined on
(size, block, value), find for each window every item of its size within a radius, whichever
item that is; exact weighted-shingle similarity decides. Everything is DataFrame expressions:
no Python runs on the executors.

Which windows get a fingerprint: a window that reaches the similarity t with an item of L
shingles shares at least ``t * L`` of them, so it has one of any ``L - ceil(t * L) + 1``. Those
rarest among the items are the item's seeds. Every window of L shingles that has a seed of some
item of that size is fingerprinted, wherever the seed stands in it and in the item: edited and
reordered passages alike. Two bitmaps of the seeds' hashes, tested inside the scan, spare all
other texts.

Sizes of passages and items only count linearly. Texts are cut into chunks of as many window
starts as an item has shingles; bit counts of windows are differences of running sums of packed
bits, and shared weights are running sums of the places where an item's shingle comes in and
goes out. No row holds more than a chunk, so an item of thousands of words needs no more memory
for a window than one of ten.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import drop_ids, materialise

WIDTH = 5
#: Bits of a bitmap for each seed, and its least and most size as powers of two (beyond that it lets more through).
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 32, 12, 24
#: 64 bits in eight blocks; with up to two bits flipped in a block, all within 23 bits are found.
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Most seeds, and most shingles of items, to broadcast (16 bytes each); most items whose index is broadcast (300 rows of 32 bytes each).
MAX_BROADCAST_ROWS, MAX_BROADCAST_ITEMS = 200_000, 1000
#: Least number of window starts in a chunk.
LEAST_STARTS = 32
#: A window's 64 bit counts, two to a long.
HALVES = 32


def words_column(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; none for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """Replace ``text`` by ``sh``: hashes of its word shingles in order; of the whole sequence if shorter, none for no words."""
    rest = [c for c in df.columns if c != text]
    hashed = df.select(*rest, F.transform(words_column(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h")
    whole = F.array(F.xxhash64(F.array_join("h", " ")))
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(width)]))
    return hashed.select(*rest, F.when(n == 0, F.expr("cast(array() as array<bigint>)")).when(n < width, whole).otherwise(runs).alias("sh"))


def simhash(shingles: str) -> Column:
    """Bits set in over half of an array of hashes."""
    ones = f"transform(sequence(0, 63), b -> aggregate({shingles}, 0, (n, x) -> n + cast(shiftright(x, b) & 1 as int)))"
    return F.expr(f"aggregate(transform({ones}, (n, b) -> if(2 * n > size({shingles}), shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)")


def packed(h: str, k: int) -> Column:
    """Bits k and k + 32 of a hash as the two halves of a long, so that sums of them count both."""
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1 | 1 << 32))


def majority(counts: list[Column], n: Column) -> Column:
    """The fingerprint of a window of ``n`` shingles from its 32 packed bit counts."""
    fp = F.lit(0).cast("long")
    for k, c in enumerate(counts):
        for half, bit in ((c.bitwiseAND(F.lit((1 << 32) - 1)), k), (F.shiftrightunsigned(c, 32), k + 32)):
            value = 1 << bit if bit < 63 else -(1 << 63)
            fp = fp.bitwiseOR(F.when(2 * half > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def block_values(fp: str) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, 64 // BLOCKS * b).bitwiseAND(F.lit(255)).alias("value")) for b in range(BLOCKS)])


def seeds_of(shingles: DataFrame, threshold: float) -> DataFrame:
    """Distinct ``seed, size`` of ``shingles(sig, size, s, k)``, the shingles of items with how often they occur."""
    common = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("n_items"))
    before = Window.partitionBy("sig").orderBy("n_items", "s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = shingles.join(common, "s").withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    keep = ranked.where(F.col("before") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")))
    return keep.select(F.col("s").alias("seed"), "size").distinct()


def bitmap_of(seeds: DataFrame, n_seeds: int, shift: int) -> tuple[Column, int]:
    """A constant array of longs with a bit set for each seed's hash from bit ``shift`` on, and the mask of such places."""
    bits = min(1 << MOST_BITS, max(1 << LEAST_BITS, 1 << (n_seeds * BITS_PER_SEED).bit_length()))
    at = F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit(bits - 1))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    longs = [0] * (bits // 64)
    for i, x in seeds.groupBy(F.shiftright(at, 6).cast("int").alias("i")).agg(F.bit_or(word).alias("x")).collect():  # at most 2**18 rows
        longs[i] = x
    return F.expr(f"cast(split('{','.join(map(str, longs))}', ',') as array<bigint>)"), bits - 1


def suspects_of(docs: DataFrame, seeds: DataFrame, n_seeds: int) -> DataFrame:
    """Written rows ``row, doc_id, sh, at`` of texts with places ``at`` whose shingle may be a seed."""
    maps = [(shift, *bitmap_of(seeds, n_seeds, shift)) for shift in (0, 40)]

    def listed(i: Column) -> Column:
        both = F.lit(True)
        for shift, bitmap, mask in maps:
            at = F.shiftrightunsigned(F.get("sh", i), shift).bitwiseAND(F.lit(mask))
            word = F.get(bitmap, F.shiftright(at, 6).cast("int"))
            both = both & (F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return both

    texts = with_shingles(docs.select("doc_id", "text"), "text")
    every = F.when(F.size("sh") > 0, F.sequence(F.lit(0), F.size("sh") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    # outer: as a filter on the array, it would be computed once for the filter and once for the result
    found = texts.select("doc_id", "sh", F.explode_outer(F.array(F.filter(every, listed))).alias("at")).where(F.size("at") > 0)
    return materialise(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sh", "at"), "suspects")


def chunks_of(suspects: DataFrame, seeds: DataFrame, few_seeds: bool) -> DataFrame:
    """Written rows ``row, doc_id, size, chunk, base, n, part``: the stretches of texts whose windows are fingerprinted.

    A chunk has the windows of ``size`` shingles that start at ``base`` or one of the next
    ``greatest(size, LEAST_STARTS)`` places; ``part`` holds their shingles, ``n`` is the size of the whole text.
    """
    places = suspects.select("row", F.size("sh").alias("n"), F.explode("at").alias("pos"), "sh").select("row", "n", "pos", F.get("sh", F.col("pos")).alias("seed"))
    hits = places.join(F.broadcast(seeds) if few_seeds else seeds, "seed")
    starts = F.greatest("size", F.lit(LEAST_STARTS))
    last = F.greatest(F.lit(0), F.col("n") - F.col("size"))
    low, high = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("size") + 1, last)), F.least(F.col("pos"), last)
    touched = hits.select("row", "size", F.explode(F.sequence((low / starts).cast("int"), (high / starts).cast("int"))).alias("chunk")).distinct()
    parts = touched.join(suspects.select("row", "doc_id", "sh"), "row")
    base = F.col("chunk") * starts
    return materialise(parts.select("row", "doc_id", "size", "chunk", base.alias("base"), F.size("sh").alias("n"), F.slice("sh", base + 1, starts + F.col("size") - 1).alias("part")), "chunks")


WINDOW = ["row", "size", "chunk"]


def windows_of(chunks: DataFrame) -> DataFrame:
    """``row, size, chunk, start, n_own, fp`` of every whole window of the chunks; a text shorter than ``size`` is one window."""
    rows = chunks.select(*WINDOW, "base", "n", F.posexplode("part").alias("i", "h"))
    upto = Window.partitionBy(*WINDOW).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(*WINDOW, "base", "n", "i", *[F.sum(packed("h", k)).over(upto).alias(f"c{k}") for k in range(HALVES)])
    # the sums up to a place end the window that it is the last of, and begin the one after it
    own = F.least("size", "n")
    ends = F.array(F.struct((F.col("i") - own + 1).alias("j"), F.lit(1).alias("sign")), F.struct((F.col("i") + 1).alias("j"), F.lit(-1).alias("sign")))
    both = summed.select(*WINDOW, "base", "n", F.explode(ends).alias("e"), *[f"c{k}" for k in range(HALVES)]).where((F.col("e.j") >= 0) & (F.col("e.j") < F.greatest("size", F.lit(LEAST_STARTS))))
    whole = both.groupBy(*WINDOW, "base", "n", F.col("e.j").alias("j")).agg(F.max("e.sign").alias("ended"), *[F.sum(F.col("e.sign") * F.col(f"c{k}")).alias(f"c{k}") for k in range(HALVES)]).where("ended = 1")
    return whole.select(*WINDOW, (F.col("base") + F.col("j")).alias("start"), F.least("size", "n").alias("n_own"), majority([F.col(f"c{k}") for k in range(HALVES)], F.least("size", "n")).alias("fp"))


def candidates_of(windows: DataFrame, items: DataFrame, few_items: bool) -> DataFrame:
    """Windows and items of their size within ``RADIUS`` bits: ``row, size, chunk, start, n_own, sig, hamming``."""
    flips = [sum(1 << i for i in c) for r in range(FLIPS + 1) for c in combinations(range(64 // BLOCKS), r)]
    index = items.select("sig", "size", "item_fp", F.explode(block_values("item_fp")).alias("part")).select("sig", "size", "item_fp", "part.block", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("part.value").bitwiseXOR(f))).alias("value"))
    probes = windows.select("*", F.explode(block_values("fp")).alias("part")).select(*windows.columns, "part.*")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = probes.join(F.broadcast(index) if few_items else index, ["size", "block", "value"]).withColumn("hamming", hamming).where(F.col("hamming") <= RADIUS)
    return near.select(*WINDOW, "start", "n_own", "sig", "hamming").distinct()


def similarities(candidates: DataFrame, chunks: DataFrame, shingles: DataFrame, few_shingles: bool) -> DataFrame:
    """Exact weighted similarity of candidates: shared over total weight of shingles, each as often as it occurs.

    An occurrence of a shingle that the item has k times counts in the windows that hold it but
    not the occurrence k places before: from one start to another. The running sum of those
    intervals' ends, at a candidate's start, is what it shares.
    """
    pair = [*WINDOW, "sig"]
    pairs = candidates.select(*pair).distinct()
    own = pairs.join(chunks.select(*WINDOW, "base", F.posexplode("part").alias("i", "s")), WINDOW).select(*pair, "s", (F.col("base") + F.col("i")).alias("pos"))
    items = shingles.select("sig", "s", "k")
    met = own.join(F.broadcast(items) if few_shingles else items, ["sig", "s"]).groupBy(*pair, "s", "k").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    each = met.select(*pair, "k", "at", F.posexplode("at").alias("o", "pos"))
    first = F.greatest(F.col("pos") - F.col("size") + 1, F.when(F.col("o") >= F.col("k"), F.get("at", (F.col("o") - F.col("k")).cast("int")) + 1).otherwise(F.lit(0)), F.lit(0))
    events = each.select(*pair, F.explode(F.array(F.struct(first.alias("start"), F.lit(1).alias("delta")), F.struct((F.col("pos") + 1).alias("start"), F.lit(-1).alias("delta")))).alias("e"))
    none = F.lit(None).cast("int")
    both = events.select(*pair, F.col("e.start").alias("start"), F.col("e.delta").alias("delta"), F.lit(0).alias("kind"), none.alias("n_own"), none.alias("hamming")).unionByName(
        candidates.select(*pair, "start", F.lit(0).alias("delta"), F.lit(1).alias("kind"), "n_own", "hamming")
    )
    shared = F.sum("delta").over(Window.partitionBy(*pair).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    asked = both.withColumn("shared", shared).where("kind = 1")
    return asked.select(*pair, "start", "hamming", (F.col("shared") / (F.col("n_own") + F.col("size") - F.col("shared"))).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Return ``doc_id, item_id, start, hamming, similarity, n_windows`` for each text with a near copy of an item.

    ``docs`` has ``doc_id, text``, ``benchmark`` has ``item_id, text``; other columns are ignored.
    ``start`` is the first word of the most similar window (the earliest on ties), ``n_windows``
    how many pass. Null and empty texts or items match nothing; an item of under five words
    matches texts of the same words only; repeated rows of either side count once; empty tables
    give an empty result. Very long texts and items are read whole. A window beyond ``RADIUS``
    bits of an item's fingerprint isn't compared to it.
    """
    rows = with_shingles(benchmark.select("item_id", "text"), "text").where(F.size("sh") > 0).distinct()
    named = materialise(rows.select("item_id", F.xxhash64("sh").alias("sig"), F.size("sh").alias("size"), "sh"), "items")
    items = materialise(named.dropDuplicates(["sig"]).select("sig", "size", "sh", simhash("sh").alias("item_fp")), "fingerprints")
    shingles = materialise(items.select("sig", "size", F.explode("sh").alias("s")).groupBy("sig", "size", "s").agg(F.count(F.lit(1)).alias("k")), "shingles")
    seeds = materialise(seeds_of(shingles, threshold), "seeds")
    n_items, n_shingles, n_seeds = items.count(), shingles.count(), seeds.count()

    suspects = suspects_of(docs, seeds, n_seeds)
    chunks = chunks_of(suspects, seeds, n_seeds <= MAX_BROADCAST_ROWS)
    candidates = materialise(candidates_of(windows_of(chunks), items, n_items <= MAX_BROADCAST_ITEMS), "candidates")
    passed = similarities(candidates, chunks, shingles, n_shingles <= MAX_BROADCAST_ROWS).where(F.col("similarity") >= threshold)
    texts = chunks.select("row", "doc_id").distinct()
    best = passed.join(texts, "row").groupBy("doc_id", "sig").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"), (-F.col("hamming")).alias("h"))).alias("best"), F.countDistinct("start").alias("n_windows"))
    ids = named.select("sig", "item_id")
    found = best.join(F.broadcast(ids) if n_items <= MAX_BROADCAST_ITEMS and named.count() <= MAX_BROADCAST_ROWS else ids, "sig")
    return found.select("doc_id", "item_id", (-F.col("best.at")).alias("start"), (-F.col("best.h")).alias("hamming"), F.round("best.similarity", 6).alias("similarity"), "n_windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns (those of clashing names too), without a near copy of a benchmark item.

    Null and empty texts and null ids stay, rows that repeat an id go together, empty tables change nothing.
    """
    return drop_ids(docs, contaminated(docs, benchmark, threshold).select("doc_id"))
