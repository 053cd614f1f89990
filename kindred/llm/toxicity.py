"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Every word of a text, and the beginnings of long words, are terms. A term's weight is its
TF-IDF times a *relevance*: a floor that all terms have, and more where a word stands in clearly
more contexts of toxic than of other labelled texts. No term is left out. Plain TF-IDF, with
equal relevances, finds neighbours by subject instead (see the README's figures). Counting
distinct contexts (the words around) instead of occurrences keeps copies of one text from
making its words look toxic.

Labelled examples form a block-max inverted index: for each term, the blocks of examples that
have it, its largest weight in each, and its postings there. A search bounds every block by
the query's terms, then reads blocks from the highest bound down, until the next bound is below
the worst of the k nearest: the neighbours are exact. Terms that a tenth of the examples or more have
would loosen the bounds and make most of the postings: what they give is added up for all examples first, and only the
other terms are bounded. Their votes, weighted by similarity, are
calibrated by a logistic curve that is fitted on examples voted on by other folds only, with
relevances of those other folds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import held_out, keep_rows, map_rows, materialise

_TERM = re.compile(r"\w+")
FOLDS = 5
#: Lengths of the beginnings that count as terms.
STEMS = (5, 7)
#: Terms that one of so many examples has, or more of them, are frequent.
FREQUENT = 20
#: Texts whose frequent terms are added up together, and how far such a sum may be off.
TOGETHER, NOISE = 64, 1e-12


@dataclass(frozen=True)
class Options:
    """Bounds on the labelled rows learned from (those of least hash) and constants of the vote.

    ``max_examples`` of each label are indexed, ``max_weighed`` of each label give the terms'
    relevances, ``calibrate`` of each label and fold are voted on for the calibration.
    """

    max_examples: int = 1000
    max_weighed: int = 4000
    neighbours: int = 15
    smoothing: float = 1.0
    block: int = 32
    floor: float = 0.02
    caution: float = 3.0
    folds: int = 3
    calibrate: int = 120


def terms_of(text: str | None) -> list[str]:
    """Lower-cased words."""
    return _TERM.findall(text.lower()) if text else []


def features_of(word: str) -> tuple[str, ...]:
    """A word and, marked by a star, its beginnings: they stand for words that no example has."""
    return (word, *[word[:k] + "*" for k in STEMS if len(word) > k])


def count_terms(words: Iterable[str]) -> Counter:
    """How often a text has each term."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        for term in features_of(word):
            found[term] += n
    return found


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges (start, size), one range after the other."""
    ends = np.cumsum(size, dtype=np.int32)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Words(dict):
    """Numbers of words met, and of each the numbers of its terms that some example has (-1: none)."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.known, self.terms = terms, np.empty((1024, 1 + len(STEMS)), np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n == len(self.terms):
            self.terms = np.concatenate([self.terms, np.empty_like(self.terms)])
        found = [self.known.get(t, -1) for t in features_of(word)]
        self.terms[n] = found + [-1] * (1 + len(STEMS) - len(found))
        return n


class BlockMaxIndex:
    """Unit vectors by term, cut into blocks of consecutive examples, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int) -> None:
        """``vectors``: term numbers and weights of each example."""
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        none = [np.zeros(0, np.int64)]
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        term = np.concatenate(none + [t for t, _ in vectors])
        order = np.lexsort((example, term))
        self.example = example[order].astype(np.int32)
        self.weight = np.concatenate([*none, *[w for _, w in vectors]])[order].astype(np.float64)
        term = term[order]
        key = term * max(1, self.blocks) + self.example // block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        #: Of each (term, block) entry: its block, its largest weight, and where its postings begin and how many there are.
        self.entry_block = (self.example[first] // block).astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry_start = first.astype(np.int32)
        self.entry_size = np.diff(np.append(first, len(term))).astype(np.int32)
        self.term_start = np.searchsorted(term[first], np.arange(n_terms + 1)).astype(np.int32)
        self.begins = np.arange(0, self.n, block)
        self.block_of = np.arange(self.n) // block
        self.frequent: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"frequent": None}

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term its row, -1 for rare ones, in the weights of the frequent terms by example."""
        start = np.append(self.entry_start, len(self.example))[self.term_start]
        size = np.diff(start)
        terms = np.flatnonzero((size > 0) & (size * FREQUENT >= self.n))
        row = np.full(len(size), -1, np.int32)
        row[terms] = np.arange(len(terms))
        weights = np.zeros((len(terms), self.n))
        at = _ranges(start[terms], size[terms])
        weights[np.repeat(row[terms], size[terms]), self.example[at]] = self.weight[at]
        return row, weights

    def by_frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What frequent terms add to each vector's cosine with each example, within ``NOISE``."""
        if self.frequent is None:
            self.frequent = self._frequent()
        row, often = self.frequent
        asked = np.zeros((len(vectors), len(often)))
        for i, (terms, weights) in enumerate(vectors):
            at = row[terms]
            asked[i, at[at >= 0]] = weights[at >= 0]
        return asked @ often

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, score: np.ndarray | None = None) -> list[tuple[int, float]]:
        """The k nearest examples with a positive cosine, nearest first, lower positions first on ties; exact.

        ``score``: the vector's row of ``by_frequent``, if it is known; overwritten.
        """
        if not self.n:
            return []
        if score is None:
            score = self.by_frequent([(terms, weights)])[0]
        row, often = self.frequent[0][terms], self.frequent[1]
        # what frequent terms give is known of all examples, so their part of a bound is the block's largest
        rare = row < 0
        common, row, terms, weights = weights[~rare], row[~rare], terms[rare], weights[rare]
        start = self.term_start[terms]
        size = self.term_start[terms + 1] - start
        entry = _ranges(start, size)
        block, weight = self.entry_block[entry], np.repeat(weights, size)
        bounds = np.bincount(block, weight * self.entry_max[entry], self.blocks) + np.maximum.reduceat(score, self.begins)
        order = np.argsort(-bounds, kind="stable")
        top, worst, read, done, wave = np.zeros(0, np.int64), -1.0, np.zeros(self.blocks, bool), 0, 16
        by_rare = np.zeros(self.n)
        while done < self.blocks and bounds[order[done]] > 0:
            if bounds[order[done]] < worst - NOISE:
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[order[done : done + wave]] = True
            mine = np.flatnonzero(chosen[block])
            size = self.entry_size[entry[mine]]
            at = _ranges(self.entry_start[entry[mine]], size)
            more = np.bincount(self.example[at], np.repeat(weight[mine], size) * self.weight[at], self.n)
            score += more
            by_rare += more
            read |= chosen
            done, wave = done + wave, 2 * wave
            top = np.flatnonzero((score > 0) & read[self.block_of])
            if len(top) > k:
                worst = np.partition(score[top], len(top) - k)[len(top) - k]
                top = top[score[top] >= worst - NOISE]
        # sums in one order, whatever other texts were added up together
        exact = (common[:, None] * often[row[:, None], top]).sum(axis=0) + by_rare[top]
        best = np.lexsort((top, -exact))[:k]
        return list(zip(top[best].tolist(), exact[best].tolist(), strict=True))


@dataclass
class Example:
    """A labelled row: its term numbers and counts, and how many labelled rows it stands for."""

    doc_id: int
    label: int
    fold: int
    terms: np.ndarray
    counts: np.ndarray
    rate: float


class Space:
    """Weighted vectors of examples, their index, and votes of the nearest."""

    def __init__(self, examples: list[Example], n_terms: int, relevance: np.ndarray, options: Options) -> None:
        self.options = options
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *[e.terms for e in examples]]), minlength=n_terms)
        self.scale = (np.log((1 + len(examples)) / (1 + df)) + 1) * relevance
        vectors = [self.vector(e.terms, e.counts) for e in examples]
        # alike examples in a block give tight bounds: by label, then by the heaviest term
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(examples)), key=lambda i: (examples[i].label, heaviest[i], examples[i].doc_id))
        self.ids = [examples[i].doc_id for i in order]
        self.labels = np.array([examples[i].label for i in order], float)
        self.rates = np.array([examples[i].rate for i in order])
        self.prior = float((self.labels @ self.rates + 0.5) / (self.rates.sum() + 1)) if order else 0.0
        self.index = BlockMaxIndex([vectors[i] for i in order], n_terms, options.block)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of term counts."""
        w = (1 + np.log(counts)) * self.scale[terms]
        return terms, w / (math.sqrt(float(w @ w)) or 1.0)

    def vote(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Share of toxic among the nearest examples, weighted by similarity and smoothed towards the prior; their positions."""
        return next(self.votes([(terms, counts)]))

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[int]]]:
        """The same of several texts' terms and counts."""
        for i in range(0, len(texts), TOGETHER):
            vectors = [self.vector(*x) for x in texts[i : i + TOGETHER]]
            for (terms, weights), score in zip(vectors, self.index.by_frequent(vectors), strict=True):
                yield self._vote(self.index.nearest(terms, weights, self.options.neighbours, score))

    def _vote(self, near: list[tuple[int, float]]) -> tuple[float, list[int]]:
        at = [i for i, _ in near]
        w = np.array([s for _, s in near]) * self.rates[at] / max(self.rates.max(initial=1.0), 1.0)
        return float((w @ self.labels[at] + self.options.smoothing * self.prior) / (w.sum() + self.options.smoothing)), at


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Offset and slope (0 at least) of the logistic curve from logits of votes to probabilities; a slight pull to the identity."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * votes, -30, 30)))
        g = np.array([weights @ (p - labels) + 0.1 * a, weights @ ((p - labels) * votes) + 0.1 * (b - 1)])
        s = weights * p * (1 - p)
        h = np.array([[s.sum() + 0.1, s @ votes], [s @ votes, s @ (votes * votes) + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return a, max(b, 0.0)


class Model:
    """The space of labelled examples and the calibration of its votes."""

    def __init__(self, terms: list[str], examples: list[Example], contexts: dict[str, tuple[np.ndarray, np.ndarray]], totals: tuple[np.ndarray, np.ndarray], options: Options) -> None:
        """``contexts``: by term, the contexts of other and of toxic texts in each fold; ``totals``: the same of all terms."""
        self.options = options
        self.terms = {t: i for i, t in enumerate(terms)}
        known = [(self.terms[t], n0, n1) for t, (n0, n1) in contexts.items() if t in self.terms]
        at = np.array([i for i, _, _ in known], np.int64)
        n0, n1 = (np.array([x[k] for x in known], float).reshape(-1, options.folds) for k in (1, 2))
        everything = np.ones(options.folds)

        def space(those: list[Example], folds: np.ndarray) -> Space:
            relevance = np.full(len(terms), options.floor)
            relevance[at] += self._relevance(n0 @ folds, n1 @ folds, float(totals[0] @ folds), float(totals[1] @ folds))
            return Space(those, len(terms), relevance, options)

        self.space = space(examples, everything)
        votes, labels, weights = [], [], []
        for f in range(options.folds):
            mine = [e for e in examples if e.fold == f]
            if not mine or len({e.label for e in examples if e.fold != f}) < 2:
                continue
            other = space([e for e in examples if e.fold != f], everything - (np.arange(options.folds) == f))
            for y in (0, 1):
                asked = [e for e in mine if e.label == y][: options.calibrate]
                share = sum(e.rate for e in mine if e.label == y) / max(1, len(asked))
                for e in asked:
                    votes.append(logit(other.vote(e.terms, e.counts)[0]))
                    labels.append(y)
                    weights.append(share)
        self.curve = (0.0, 1.0)
        if len(set(labels)) == 2:
            w = np.array(weights)
            self.curve = fit_curve(np.array(votes), np.array(labels, float), w * len(w) / w.sum())
        self._words: Words | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": None}

    def _relevance(self, n0: np.ndarray, n1: np.ndarray, t0: float, t1: float) -> np.ndarray:
        """Square of how far the log ratio of context rates stays above zero after ``caution`` standard errors."""
        ratio = np.log((n1 + 0.5) / (t1 + 1)) - np.log((n0 + 0.5) / (t0 + 1))
        return np.maximum(0, ratio - self.options.caution * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))) ** 2

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's terms that some example has, ascending, and their counts."""
        if self._words is None or len(self._words) > 200_000:
            self._words = Words(self.terms)
        met, times = np.unique(np.fromiter(map(self._words.__getitem__, words), np.int64, len(words)), return_counts=True)
        found = self._words.terms[met].ravel()
        some = found >= 0
        terms, where = np.unique(found[some], return_inverse=True)
        return terms, np.bincount(where, np.repeat(times, 1 + len(STEMS))[some], len(terms))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Calibrated probability that a text is toxic, and the ids of its three nearest examples."""
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """The same of several texts; a text's doesn't depend on the others."""
        if not self.space.ids:
            return [(0.0, [])] * len(texts)
        a, b = self.curve
        votes = self.space.votes([self.numbers(terms_of(t)) for t in texts])
        return [(1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * logit(vote))))), [self.space.ids[i] for i in at[:3]]) for vote, at in votes]


def labelled_sample(docs: DataFrame, labels: DataFrame, options: Options) -> tuple[DataFrame, dict[int, int]]:
    """Texts of the labelled rows learned from with their place by hash among those of their label, and how many rows have each label."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), FOLDS)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rank = F.monotonically_increasing_id()
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.max_weighed).coalesce(1).withColumn("place", rank) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # at most 2 * max_weighed rows
    return materialise(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]), "labelled"), sizes


def fold_of(doc_id: int, folds: int) -> int:
    return crc32(f"fold {doc_id}".encode()) % folds


def count_contexts(sample: DataFrame, options: Options) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Distinct contexts of each term by label and fold, of the terms that can be relevant, and of all terms together."""

    def contexts(rows: dict[str, list]) -> dict[str, list]:
        seen: dict[tuple[str, int, int], set] = {}
        for doc_id, text, y in zip(rows["doc_id"], rows["text"], rows["toxic"], strict=True):
            words = ["", *terms_of(text), ""]
            f = fold_of(doc_id, options.folds)
            for i in range(1, len(words) - 1):
                around = crc32(f"{words[i - 1]} {words[i + 1]}".encode())
                for term in features_of(words[i]):
                    seen.setdefault((term, y, f), set()).add(around)
        flat = [(w, y, f, a) for (w, y, f), around in seen.items() for a in around]
        return {k: [x[i] for x in flat] for i, k in enumerate(("term", "toxic", "fold", "around"))}

    spread = map_rows(sample.select("doc_id", "text", "toxic"), contexts, "term string, toxic int, fold int, around long").groupBy("term", "around", "toxic").agg(F.min("fold").alias("fold"))
    cells = [F.count_if((F.col("toxic") == y) & (F.col("fold") == f)).alias(f"n{y}_{f}") for y in (0, 1) for f in range(options.folds)]
    counts = materialise(spread.groupBy("term").agg(*cells), "contexts")
    names = [[f"n{y}_{f}" for f in range(options.folds)] for y in (0, 1)]
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for cs in names for c in cs]).first()
    often = sum((F.col(c) for c in names[1]), F.lit(0))

    def above(left_out: int | None) -> Column:
        """How far a term's log ratio stays above zero without a fold; as ``Model._relevance`` has it."""
        folds = [f for f in range(options.folds) if f != left_out]
        n0, n1 = (sum((F.col(cs[f]) for f in folds), F.lit(0.0)) + 0.5 for cs in names)
        t0, t1 = (sum(totals[cs[f]] for f in folds) + 1.0 for cs in names)
        return F.log(n1 / n0) + math.log(t0 / t1) - options.caution * F.sqrt(1 / n1 + 1 / n0)

    telling = F.greatest(*[above(f) for f in (None, *range(options.folds))]) > -1e-6
    found = {r["term"]: tuple(np.array([r[c] for c in cs], float) for cs in names) for r in counts.where((often >= 3) & telling).collect()}
    return found, tuple(np.array([totals[c] for c in cs], float) for cs in names)


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """Learn, at once, from labelled rows outside the held-out fold.

    To the driver go the term counts of ``max_examples`` rows of each label, and the contexts of
    terms of more than the floor's relevance from ``max_weighed`` rows of each label.
    """
    sample, sizes = labelled_sample(docs, labels, options)
    contexts, totals = count_contexts(sample, options)

    def count(rows: dict[str, list]) -> dict[str, list]:
        found = [count_terms(terms_of(t)) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "toxic": rows["toxic"], "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found]}

    indexed = sample.where(F.col("place") < options.max_examples).select("doc_id", "toxic", "text")
    table = map_rows(indexed, count, "doc_id long, toxic int, terms array<string>, counts array<int>").toArrow()
    terms: dict[str, int] = {}
    examples = []
    taken = {y: max(1, min(sizes.get(y, 0), options.max_examples)) for y in (0, 1)}
    for batch in table.to_batches(max_chunksize=100):
        for doc_id, label, own, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            numbers = np.array([terms.setdefault(t, len(terms)) for t in own], np.int64)
            examples.append(Example(doc_id, label, fold_of(doc_id, options.folds), numbers, np.array(counts, float), sizes[label] / taken[label]))
    examples.sort(key=lambda e: e.doc_id)
    return Model(list(terms), examples, contexts, totals, options)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted, evidence`` for every row of ``docs(doc_id, text)``.

    Null and empty texts, and texts without a known term, have no neighbours: their vote is the
    prior. Very long texts are scored whole. Repeated rows stay repeated, an empty table gives
    an empty result, other columns are ignored; without labelled rows all scores are zero.
    Ties between neighbours go to the one of lower position in the index. ``evidence`` has the
    ids of the three nearest labelled examples.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = shared.value.scores(rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": [s for s, _ in found], "predicted": [int(s >= 0.5) for s, _ in found], "evidence": [e for _, e in found]}

    keyed = docs.select("doc_id", "text", held_out(F.col("doc_id"), FOLDS).alias("held_out"))
    return map_rows(keyed, run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns (those of clashing names too), that aren't predicted toxic.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: [p < 0.5 for p, _ in shared.value.scores(texts)])
