"""Language-model scores by online logistic context mixing.

A text is coded as binary decisions. Each word of a vocabulary of the commonest training
words has a Huffman code; other words are an escape code and then either their count or the bits of their bytes: their
probability is a mixture of the two, weighted by the share of unseen words among escapes.
For every bit several hashed contexts (the code node alone, with the word before, with the
two words before; for bytes the byte or the three bytes before) look up how often the bit was set in
training. Their log odds are mixed by weights that a gate selects by how much evidence the
contexts have; the weights, and a refinement of the mixed odds, adapt online within a text.
Adaptation is by blocks of words and starts afresh in each text, so a score depends on the
text and the trained tables only, not on how rows are dealt.

A match predictor knows longer contexts. Texts are cut into passages of some sixteen words
where the hash of two neighbouring words says so, and every passage of every training text is
counted. A passage's probability is a mixture of its share of all those passages and of what
the bits give it; the weight is gated by whether the passage before was such a match, and
follows the posterior online. A training text's own passages don't count for itself. Tables of
passages grow with the corpus and stay distributed: passages meet their counts in a join.

The base score is an add-0.1 unigram of all training tokens. The commonest tokens are a
bounded table that travels to the executors; all rarer tokens meet their counts in a join.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import held_out, materialise, slices

FOLDS = 10
#: The token after the last word; no word has this character. Tokens are UTF-8 bytes.
END = b"\n"
#: Tokens whose bits are looked up at once: what that makes stays in a core's cache.
PART = 4096
#: Bins a doubling of the count, where the head of the commonest tokens is cut off.
BINS = 64


@dataclass(frozen=True)
class Options:
    """``head`` tokens with counts travel to the executors, at most.

    Of them, those met ``least_coded`` times have codes, ``vocabulary`` at most; each context of
    words has a slot a training token up to 2**``word_bits`` of them, each of bytes 2**``byte_bits``:
    both bounds are of workers' memory. Passages end at one pair of words in ``passage`` (a power of two).
    """

    head: int = 250_000
    least_coded: int = 16
    vocabulary: int = 1 << 14
    word_bits: int = 21
    byte_bits: int = 18
    passage: int = 16
    block: int = 64
    rate: float = 0.01
    refine_rate: float = 0.01
    chunk_tokens: int = 150_000
    fan_in: int = 48


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Hash two 64-bit values into one."""
    x = (a ^ (np.uint64(b) if isinstance(b, int) else b)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Numbers(dict):
    """Numbers of tokens; ``other`` for the rest."""

    def __init__(self, numbers: dict[bytes, int], other: int) -> None:
        super().__init__(numbers)
        self.other = other

    def __missing__(self, token: bytes) -> int:
        return self.other

    def of(self, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
        """All tokens in a row, and their numbers."""
        flat = list(chain.from_iterable(texts))
        return flat, np.fromiter(map(self.get, flat, repeat(self.other)), np.int64, len(flat))

    def __reduce__(self):
        return Numbers, (dict(self), self.other)


class Hashes(dict):
    """64-bit hashes of tokens; the table of a worker starts afresh when it is full."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h

    def __reduce__(self):
        return Hashes, ()


def passages_of(hashes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where passages begin, and the hash of each passage, for tokens' hashes and their texts' numbers."""
    n = len(hashes)
    fresh = np.append(True, doc[1:] != doc[:-1])
    pair = (np.append(np.uint64(0), hashes[:-1]) ^ (hashes << np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    last = (pair >> np.uint64(40)) % np.uint64(length) == 0
    begins = fresh | np.append(True, last[:-1])
    first = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0xD6E8FEB86659FD93, np.uint64))
    return begins, np.add.reduceat((hashes ^ (hashes >> np.uint64(31))) * powers[place], first)


@dataclass
class Scored:
    """Of a group of texts: base scores and known tokens; passages' hashes, costs and counts in their text; rare tokens, once a text, with spelled costs and passages.

    ``n_passages``, ``n_rare`` and ``n_at`` say how many belong to each text, text and rare token.
    """

    base: np.ndarray
    known: np.ndarray
    passages: np.ndarray
    costs: np.ndarray
    own: np.ndarray
    n_passages: np.ndarray
    rare: list[bytes]
    spelled: np.ndarray
    n_rare: np.ndarray
    at: np.ndarray
    n_at: np.ndarray


def _alike(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How often each value is in its group."""
    _, inverse, often = np.unique(_mix(values, group.astype(np.uint64)), return_inverse=True, return_counts=True)
    return often[inverse]


class Code:
    """Huffman code of the vocabulary: per symbol the inner nodes passed and the branches taken."""

    def __init__(self, counts: list[int]) -> None:
        n = len(counts)
        heap = [(c + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent = np.zeros(2 * n - 1, np.int64)
        branch = np.zeros(2 * n - 1, np.int8)
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], branch[y] = node, node, 1
            heapq.heappush(heap, (a + b, node))
        root, self.size = 2 * n - 2, np.zeros(n, np.int64)
        nodes, bits = [], []
        for s in range(n):
            path = []
            at = s
            while at != root:
                path.append((parent[at] - n, branch[at]))
                at = parent[at]
            self.size[s] = len(path)
            nodes += [x for x, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.nodes, self.bits = np.array(nodes, np.int64), np.array(bits, np.int8)
        #: Nodes spread over 64 bits.
        self.spread = self.nodes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (start, size): the range each element belongs to, and its position."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


class Bits:
    """Turns tokens into bits and their contexts' slots."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, options: Options) -> None:
        self.options = options
        words = [x for x in head[: options.vocabulary] if x[1] >= options.least_coded] or head[:1]
        self.word_bits = min(options.word_bits, max(10, total.bit_length()))
        self.escape = len(words)
        self.symbol = Numbers({w: i for i, (w, _) in enumerate(words)}, self.escape)
        self.code = Code([*[c for _, c in words], max(0, total - sum(c for _, c in words))])
        self.sizes = [len(self.code.size), 1 << self.word_bits, 1 << self.word_bits, 1 << 16, 1 << options.byte_bits]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @property
    def slots(self) -> int:
        return int(self.offsets[-1])

    def coded(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all tokens, and the number of the text that each is of."""
        _, symbols = self.symbol.of(texts)
        return symbols, np.repeat(np.arange(len(texts)), [len(t) for t in texts])

    def words(self, symbols: np.ndarray, doc: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens with their texts' numbers: owning token, three slots and value of each bit, token by token as ``order`` says."""
        one = np.concatenate([[self.escape], symbols[:-1]]).astype(np.uint64) + np.uint64(1)
        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        one[fresh] = 0
        two = np.concatenate([[0], one[:-1]]).astype(np.uint64)
        two[fresh] = 0
        h1 = _mix(one, 1)
        h2 = _mix(_mix(two, 2), h1)
        if order is not None:
            symbols, h1, h2 = symbols[order], h1[order], h2[order]
        size = self.code.size[symbols]
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        owner, slots, value = np.empty(n, np.int64), np.empty((3, n), np.int64), np.empty(n, np.int8)
        shift, spread = np.uint64(64 - self.word_bits), np.uint64(0x9E3779B97F4A7C15)
        first = self.code.start[symbols] - ends + size
        for i in range(0, len(symbols), PART):
            some = slice(i, i + PART)
            lo, hi = int(ends[i] - size[i]), int(ends[some][-1])
            at = np.repeat(first[some], size[some])
            at += np.arange(lo, hi)
            owner[lo:hi] = np.repeat(np.arange(i, i + len(size[some])), size[some])
            np.take(self.code.nodes, at, out=slots[0, lo:hi], mode="clip")
            np.take(self.code.bits, at, out=value[lo:hi], mode="clip")
            n64 = self.code.spread[at]
            # _mix of both, in place
            for k, h in ((1, h1), (2, h2)):
                x = np.repeat(h[some], size[some])
                x ^= n64
                x *= spread
                x ^= x >> np.uint64(29)
                x >>= shift
                np.add(x.view(np.int64), self.offsets[k], out=slots[k, lo:hi])
        return owner, slots, value

    def spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of words by their bytes and a final space, with two slots: owning word, slots and value of each bit."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        text = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)

        def before(k: int) -> np.ndarray:
            return np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), text])[: len(text)], np.uint64(0))

        one = before(1)
        bit = np.unpackbits(text.astype(np.uint8)[:, None], axis=1)
        # the bits of the byte so far, after a leading one
        partial = (text[:, None] | np.uint64(256)) >> np.arange(8, 0, -1).astype(np.uint64)
        h3 = _mix(_mix(one * np.uint64(65536) + before(2) * np.uint64(256) + before(3), 4), np.minimum(place, 20).astype(np.uint64))
        shift = np.uint64(64 - self.options.byte_bits)
        first = (one[:, None] * np.uint64(256) + partial).astype(np.int64) + self.offsets[3]
        second = (_mix(h3[:, None], partial * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64) + self.offsets[4]
        return np.repeat(owner, 8), np.stack([first.ravel(), second.ravel()]), bit.ravel()


def tokens_of(text: str | bytes | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then the end; bytes split at ASCII white space, as words do."""
    if not text:
        return [END]
    return [*(text.encode() if isinstance(text, str) else text).lower().split(), END]


def _utf8(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


class Tables:
    """How often each slot saw a zero and a one."""

    def __init__(self, bits: Bits) -> None:
        self.bits = bits
        self.seen = np.zeros(2 * bits.slots, np.uint32)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Count the bits of the words' codes."""
        for group in _grouped(texts, self.bits.options.chunk_tokens):
            symbols, doc = self.bits.coded(group)
            _, slots, value = self.bits.words(symbols, doc)
            for k in range(3):
                np.add.at(self.seen, 2 * slots[k] + value, np.uint32(1))

    def learn_spelling(self, words: list[bytes], times: np.ndarray) -> None:
        """Count the bits of words' bytes, each word as often as it stands in the texts."""
        for i in range(0, len(words), 10_000):
            owner, slots, value = self.bits.spelled(words[i : i + 10_000])
            often = times[i : i + 10_000].astype(np.uint32)[owner]
            for k in range(2):
                np.add.at(self.seen, 2 * slots[k] + value, often)


def _grouped(texts: list[list[bytes]], most: int) -> Iterator[list[list[bytes]]]:
    """Consecutive texts of about ``most`` tokens together (one at least)."""
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > most:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t)
    if group:
        yield group


#: Slots in a block of a table as it is sent and summed.
PIECE = 1 << 17


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4")


class Mixer:
    """Trained tables as log odds and evidence, and how they are mixed."""

    def __init__(self, bits: Bits, seen: np.ndarray, counts: dict[bytes, int], total: int, distinct: int, single: int) -> None:
        """``counts``: of the head tokens; ``single``: how many tokens were seen once."""
        self.bits, self.met = bits, {}
        escapes = max(1, total - sum(counts.get(w, 0) for w in bits.symbol))
        unseen = (single + 0.5) / (escapes + 1)
        #: Log10 weights of a word's count and of its spelling.
        self.by_count = math.log10(max(1e-9, 1 - unseen) / escapes)
        self.by_spelling = math.log10(min(1.0, unseen))
        zero, one = seen[0::2].astype(np.float32), seen[1::2].astype(np.float32)
        odds = np.clip(np.log((one + 0.4) / (zero + 0.4)), -12, 12).astype(np.float32)
        self.odds = ((odds.view(np.int32) & ~3) | np.digitize(zero + one, [2, 30]).astype(np.int32)).view(np.float32)
        scale = total + 0.1 * (distinct + 1)
        #: Base log10 probability of each symbol; escapes are looked up.
        self.base_of = np.array([*[math.log10((counts[w] + 0.1) / scale) for w in bits.symbol], 0.0])
        rest = [w for w in counts if w not in bits.symbol]
        #: Numbers of all head tokens: symbols, then (after the escape's) the others, with their base and cost after the escape.
        self.number = Numbers(dict(bits.symbol) | {w: bits.escape + 1 + i for i, w in enumerate(rest)}, -1)
        self.rest_base = np.array([math.log10((counts[w] + 0.1) / scale) for w in rest])
        self.hashes = Hashes()
        #: Hashes of tokens by number; the escape's and the rare ones' place is never read.
        self.hash_of = np.fromiter((xxhash.xxh64_intdigest(w) for w in [*bits.symbol, b"", *rest]), np.uint64, len(bits.symbol) + 1 + len(rest))
        self.rest_cost = np.array([self.escaped(counts[w], x) for w, x in zip(rest, self.spelled_costs(rest).tolist(), strict=True)])

    def _start(self, lanes: int) -> np.ndarray:
        """First weights by gate (evidence of the second and third context), for each text."""
        longest = np.array([0.0, 0.25, 0.6])
        middle = np.array([0.0, 0.25, 0.5])
        w = np.zeros((3, 3, 3))
        for a in range(3):
            for b in range(3):
                w[a, b] = [1.0 - 0.85 * min(1.0, middle[a] + longest[b]), middle[a] * (1 - 0.3 * (b == 2)), longest[b]]
        return np.tile(w.reshape(1, 9, 3), (lanes, 1, 1))

    def word_costs(self, symbols: np.ndarray, doc: np.ndarray, lanes: int) -> np.ndarray:
        """Log10 probability of each of the coded words of ``lanes`` texts, by online mixing."""
        options = self.bits.options
        place = np.arange(len(symbols)) - np.searchsorted(doc, np.arange(lanes))[doc]
        block = place // options.block
        order = np.argsort(block.astype(np.int32), kind="stable")
        owner, slots, value = self.bits.words(symbols, doc, order)
        lane = doc[order][owner]
        odds = np.take(self.odds, slots)
        value = value.astype(np.float32)
        # the two lowest bits of the odds tell the evidence
        evidence = odds.view(np.int32)[1:] & 3
        evidence[0] *= 3
        evidence[0] += evidence[1]
        bucket0 = lane * 24
        cell = lane
        cell *= 9
        cell += evidence[0]
        bucket0 += 12
        size = np.concatenate([[0], np.cumsum(self.bits.code.size[symbols[order]])])
        ends = size[np.searchsorted(block[order], np.arange(block[order[-1]] + 2))]
        weights, refined = self._start(lanes).reshape(-1, 3).T.astype(np.float32).copy(), np.zeros(lanes * 24, np.float32)
        errors = np.empty(len(value), np.float32)
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at, x = cell[i:j], odds[:, i:j]
            mixed = np.take(weights[0], at)
            mixed *= x[0]
            for k in (1, 2):
                part = np.take(weights[k], at)
                part *= x[k]
                mixed += part
            np.clip(mixed, -11.9, 11.9, out=mixed)
            bucket = bucket0[i:j]
            bucket += np.floor(mixed, out=part).astype(np.int64)
            mixed += np.take(refined, bucket)
            np.negative(mixed, out=mixed)
            np.exp(mixed, out=mixed)
            mixed += 1
            np.divide(1, mixed, out=mixed)
            error = np.subtract(value[i:j], mixed, out=errors[i:j])
            for k in range(3):
                weights[k] += options.rate * np.bincount(at, np.multiply(error, x[k], out=part), lanes * 9)
            refined += options.refine_rate * np.bincount(bucket, error, lanes * 24)
        np.abs(errors, out=errors)
        np.subtract(1, errors, out=errors)
        return np.bincount(order[owner], np.log(errors, out=errors), len(symbols)) / math.log(10)

    def spelled_costs(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of the bytes of each word, by evidence-gated mixing."""
        out = np.zeros(len(words))
        for i in range(0, len(words), 5_000):
            owner, slots, value = self.bits.spelled(words[i : i + 5_000])
            odds = self.odds[slots]
            second = np.array([0.0, 0.6, 0.85], np.float32)[odds[1].view(np.int32) & 3]
            mixed = odds[0] + second * (odds[1] - odds[0])
            p = 1 / (1 + np.exp(-mixed))
            out[i : i + 5_000] = np.bincount(owner, np.log10(1 - np.abs(value - p)), len(words[i : i + 5_000]))
        return out

    def escaped(self, count: int, spelled: float) -> float:
        """Log10 probability of a word after the escape: a mixture of its count's and its spelling's."""
        a, b = (self.by_count + math.log10(count) if count else -math.inf), self.by_spelling + spelled
        high, low = max(a, b), min(a, b)
        return high + math.log10(1 + 10 ** max(low - high, -300))

    def score(self, texts: list[list[bytes]]) -> Iterator[Scored]:
        """Scores, group by group, that leave out tokens outside the head: what they add depends on counts that aren't here."""
        escape = self.bits.escape
        for group in _grouped(texts, self.bits.options.chunk_tokens):
            flat, numbers = self.number.of(group)
            size = np.array([len(t) for t in group], np.int64)
            doc = np.repeat(np.arange(len(group)), size)
            symbols = np.where((numbers < 0) | (numbers > escape), escape, numbers)
            cost = self.word_costs(symbols, doc, len(group))
            base = self.base_of[symbols]
            told = np.flatnonzero(numbers > escape)
            base[told] += self.rest_base[numbers[told] - escape - 1]
            cost[told] += self.rest_cost[numbers[told] - escape - 1]
            rare = np.flatnonzero(numbers < 0)
            hashes = self.hash_of[numbers]
            words = [flat[i] for i in rare.tolist()]
            hashes[rare] = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
            begins, passages = passages_of(hashes, doc, self.bits.options.passage)
            which = np.cumsum(begins) - 1
            of = doc[begins]
            first = np.searchsorted(of, np.arange(len(group)))
            own = _alike(passages, of)
            # a rare token of a text stands where it is met first, with all its passages
            number, start, often = np.unique(_mix(hashes[rare], doc[rare].astype(np.uint64)), return_index=True, return_counts=True)
            order = np.argsort(start)
            kind = np.empty(len(number), np.int64)
            kind[order] = np.arange(len(number))
            spread = np.argsort(kind[np.searchsorted(number, _mix(hashes[rare], doc[rare].astype(np.uint64)))], kind="stable")
            words = [words[i] for i in start[order].tolist()]
            spelled = self._spell(words)
            yield Scored(
                np.bincount(doc, base, len(group)), size - np.bincount(doc[rare], minlength=len(group)),
                passages, np.bincount(which, cost, len(passages)), own, np.bincount(of, minlength=len(group)),
                words, np.fromiter(map(spelled.__getitem__, words), float, len(words)), np.bincount(doc[rare[start]], minlength=len(group)),
                (which[rare] - first[doc[rare]])[spread], often[order],
            )

    def _spell(self, words: list[bytes]) -> dict[bytes, float]:
        """Spelled costs by a table of words met before."""
        if len(self.met) > 100_000:
            self.met = {}
        if new := sorted(set(words) - self.met.keys()):
            self.met.update(zip(new, self.spelled_costs(new).tolist(), strict=True))
        return self.met


def token_counts(train: DataFrame) -> DataFrame:
    """Return ``token, c``: occurrences in all texts of ``train(text)``, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.binary()).cast(pa.string()), "c": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return made

        for batch in slices(batches):
            for text in _utf8(batch.column(0)):
                counts.update(tokens_of(text))
            if len(counts) > 200_000:
                yield out()
        yield out()

    return train.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def count_bin() -> Column:
    """Counts told apart when the head is cut off: exact where small, within a hundredth beyond."""
    return F.floor(F.log2("c") * BINS).cast("int")


def head_bin(counts: DataFrame, most: int) -> int:
    """The least bin so that at most ``most`` tokens are in it or above."""
    bins = counts.groupBy(count_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 * BINS rows
    left, least = most, 64 * BINS
    for b, n in sorted(((r["bin"], r["n"]) for r in bins), reverse=True):
        left -= n
        if left < 0:
            break
        least = b
    return least


def train_tables(train: DataFrame, counts: DataFrame, bits: Bits) -> np.ndarray:
    """Tables over all of ``train(text)`` and the spellings of all of ``counts(token, c)`` that have no code.

    Each task sums its own; pieces of tables are then summed in groups of bounded size.
    """
    shared = train.sparkSession.sparkContext.broadcast(bits)
    n_pieces = -(-2 * bits.slots // PIECE)

    def pieces(tables: Tables, kind: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = 2 * TaskContext.get().partitionId() + kind
        for k in range(n_pieces):
            part = tables.seen[k * PIECE : (k + 1) * PIECE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "task": pa.array([task], pa.int32()), "data": pa.array([_pack(part)], pa.binary())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in slices(batches):
            tables.learn([tokens_of(t) for t in _utf8(batch.column(0))])
        yield from pieces(tables, 0)

    def learn_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in batches:
            rows = [(w, c) for w, c in zip(_utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True) if w not in shared.value.symbol]
            tables.learn_spelling([w for w, _ in rows], np.array([c for _, c in rows], np.uint64))
        yield from pieces(tables, 1)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = None
        for data in rows.column("data").to_pylist():
            one = _unpack(data)
            total = one.astype(np.uint64) if total is None else total + one
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([_pack(np.minimum(total, 2**32 - 1))], pa.binary())})

    schema = "piece int, task int, data binary"
    spelled = counts.select("token", "c")
    tasks = 2 * max(train.rdd.getNumPartitions(), spelled.rdd.getNumPartitions())
    made = materialise(train.select("text").mapInArrow(learn, schema).unionByName(spelled.mapInArrow(learn_spelling, schema)), "tables")
    while tasks > 1:
        made = materialise(made.withColumn("task", F.floor(F.col("task") / bits.options.fan_in).cast("int")).groupBy("piece", "task").applyInArrow(add, schema), "summed")
        tasks = -(-tasks // bits.options.fan_in)
    seen = np.zeros(n_pieces * PIECE, np.uint32)
    for r in made.select("piece", "data").toLocalIterator():
        piece = _unpack(r["data"])
        seen[r["piece"] * PIECE : r["piece"] * PIECE + len(piece)] = piece
    return seen[: 2 * bits.slots]


#: First weights of a match, by whether the passage before was one, and how fast they follow.
MATCH, FOLLOW = (0.02, 0.8), 0.05


def mix_matches(costs: list[float], matches: list[float | None]) -> float:
    """Log10 probability of a text from its passages' costs by bits and by share of all passages (null: none)."""
    weight, gate, total = list(MATCH), 0, 0.0
    for cost, match in zip(costs, matches, strict=True):
        w = weight[gate]
        if match is None:
            total += cost + math.log10(1 - w)
            posterior = 0.0
        else:
            a, b = math.log10(w) + match, math.log10(1 - w) + cost
            high, low = max(a, b), min(a, b)
            total += high + math.log10(1 + 10 ** max(low - high, -300))
            posterior = 1 / (1 + 10 ** min(300, max(-300, b - a)))
        weight[gate] = min(0.99, max(0.001, w + FOLLOW * (posterior - w)))
        gate = int(posterior > 0.5)
    return total


def lm_scores(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Score every row of ``docs(doc_id, text)``, learning from rows outside the held-out tenth.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte``. Null and empty texts are the end token alone (bits per byte null); very long
    texts are scored whole; repeated rows stay repeated; without training rows all counts are
    zero; an empty table gives an empty result; other columns are ignored.

    To the driver go ``head`` counts and tables of 2**bits slots, whatever the corpus. What
    tasks send to be summed, the rare tokens and the passages that meet their counts in joins, grow with it.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), FOLDS).alias("held_out"))
    train = rows.where("not held_out").select("text")
    counts = materialise(token_counts(train), "counts")
    total, distinct, single = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first())
    least = head_bin(counts, options.head)
    top = counts.where(count_bin() >= least).toArrow()
    head = sorted(zip(_utf8(top.column("token")), top.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    bits = Bits(head, total, options)
    model = Mixer(bits, train_tables(train, counts, bits), dict(head), total, distinct, single)
    mixer = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _utf8(batch.column(1))
            tokens = [tokens_of(t) for t in texts]
            found = list(mixer.value.score(tokens))

            def lists(n: str, values: pa.Array, found: list[Scored] = found) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *[getattr(f, n) for f in found]]))), pa.int32()), values)

            def column(n: str, kind: pa.DataType, found: list[Scored] = found) -> pa.Array:
                return pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *[getattr(f, n) for f in found]]), kind)

            words = pa.array([w for f in found for w in f.rare], pa.binary()).cast(pa.string())
            rare = pa.StructArray.from_arrays([words, column("spelled", pa.float64()), lists("n_at", column("at", pa.int32()))], ["token", "spelled", "at"])
            hashes = pa.array(np.concatenate([np.zeros(0, np.uint64), *[f.passages for f in found]]).view(np.int64))
            passages = pa.StructArray.from_arrays([hashes, column("costs", pa.float64()), column("own", pa.int64())], ["hash", "cost", "own"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "held_out": batch.column(2),
                "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()), "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
                "known": column("known", pa.int64()), "base": column("base", pa.float64()), "passages": lists("n_passages", passages), "rare": lists("n_rare", rare),
            })

    schema = "doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, passages array<struct<hash: long, cost: double, own: long>>, rare array<struct<token: string, spelled: double, at: array<int>>>"
    scored = materialise(rows.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")

    # passages that other training texts have, and how often; a training text's own don't count
    passages = scored.select("row", F.col("held_out").alias("new"), F.posexplode("passages").alias("at", "p")).select("row", "at", "p.hash", F.when(F.col("new"), 0).otherwise(F.col("p.own")).alias("own"))
    learned = scored.where("not held_out").select(F.explode("passages.hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("c"))
    n_passages = scored.where("not held_out").agg(F.sum(F.size("passages"))).first()[0] or 0
    others = F.col("c") - F.col("own")
    matched = passages.join(learned, "hash").where(others > 0).select("row", F.struct("at", F.log10(others / F.lit(max(1, n_passages))).alias("match")).alias("match"))
    # tokens outside the head, once a text; one that only held-out texts have may be hot, and is split where it is
    tail = counts.where(count_bin() < least)
    met = scored.select("row", F.explode("rare").alias("one")).select("row", "one.*").join(tail, "token", "left")
    scale = total + 0.1 * (distinct + 1)
    log = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.1) / scale)
    by_count, by_spelling = F.log10("c") + model.by_count, F.col("spelled") + model.by_spelling
    high, low = F.greatest(by_count, by_spelling), F.least(by_count, by_spelling)
    escaped = F.when(F.col("c").isNull(), by_spelling).otherwise(high + F.log10(1 + F.pow(F.lit(10.0), F.greatest(low - high, F.lit(-300.0)))))
    rare = met.select("row", F.struct("at", escaped.alias("cost")).alias("rare"), (F.size("at") * log).alias("base"), F.when(F.col("c").isNotNull(), F.size("at")).otherwise(0).cast("long").alias("known"))
    facts = ["doc_id", "held_out", "n_bytes", "n_tokens"]
    own = scored.select("row", *facts, "known", "base", F.col("passages.cost").alias("costs"))
    parts = own.unionByName(rare, allowMissingColumns=True).unionByName(matched, allowMissingColumns=True)
    whole = parts.groupBy("row").agg(
        *[F.max(c).alias(c) for c in facts], F.first("costs", ignorenulls=True).alias("costs"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.collect_list("rare").alias("rare"), F.collect_list("match").alias("matches")
    )

    def places(lists: pa.ListArray, begins: np.ndarray) -> np.ndarray:
        """Where the first passage of each element's text is."""
        cut = lists.offsets.to_numpy()
        return np.repeat(begins, np.diff(cut))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cut = batch.column("costs").offsets.to_numpy()
            cut = cut - cut[0]
            costs = batch.column("costs").flatten().to_numpy().copy()
            rare, matches = batch.column("rare"), batch.column("matches")
            words = rare.flatten()
            size = np.diff(words.field("at").offsets.to_numpy())[: len(words)]
            at = np.repeat(places(rare, cut[:-1]), size) + words.field("at").flatten().to_numpy()
            np.add.at(costs, at, np.repeat(words.field("cost").to_numpy(), size))
            found = matches.flatten()
            match = np.full(len(costs), np.nan)
            match[places(matches, cut[:-1]) + found.field("at").to_numpy()] = found.field("match").to_numpy()
            each, shares = costs.tolist(), [None if x != x else x for x in match.tolist()]
            scores = [mix_matches(each[a:b], shares[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            names = ["doc_id", "held_out", "n_tokens", "known", "base", "n_bytes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64())], names=[*names, "score"])

    mixed = whole.mapInArrow(mix, "doc_id long, held_out boolean, n_tokens long, known long, base double, n_bytes long, score double")
    return mixed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
