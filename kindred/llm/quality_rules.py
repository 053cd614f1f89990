"""Document quality rules: length and repetition counts, then distribution divergence.

Each language of the corpus gets a reference: the histogram of its character classes and
of its commonest words over all its documents. A document is compared to the reference
of its language by Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1),
once for each histogram. Short documents have noisy histograms, so minimum-length guards
leave them to the base rules alone. References of the largest languages travel to the
executors; where there are more languages, documents of the others meet theirs in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import bounded, map_rows, materialise, slices, words_of

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Character classes: white space, a-z, A-Z, digits, sentence punctuation, other ASCII, Latin letters beyond ASCII, the rest.
N_CLASSES = 8
_SENTENCE = ".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    """Class of every code point below U+0250; the last entry stands for all others."""
    table = np.full(0x251, 7, np.int8)
    for c in range(0x250):
        x = chr(c)
        table[c] = 0 if c == 32 or 9 <= c <= 13 else 1 if "a" <= x <= "z" else 2 if "A" <= x <= "Z" else 3 if "0" <= x <= "9" else 4 if x in _SENTENCE else 5 if c < 128 else 6 if x.isalpha() else 7
    return table


_CLASS = _class_table()


@dataclass(frozen=True)
class Options:
    """Limits of the rules. References of ``max_languages`` languages are sent to the executors; those of others are joined."""

    min_words: int = 10
    max_repeat_percent: int = 20
    common_words: int = 64
    max_languages: int = 128
    guard_chars: int = 200
    guard_words: int = 80
    max_class_distance: float = 0.35
    max_word_distance: float = 0.75


def class_histogram(text: str) -> np.ndarray:
    """Characters by class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_CLASS[np.minimum(points, 0x250)], minlength=N_CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def to_m(x: np.ndarray) -> float:
        on = x > 0
        return float((x[on] * np.log2(x[on] / m[on])).sum())

    return float(np.sqrt(max(0.0, (to_m(p) + to_m(q)) / 2)))


def repeat_counts(text: str, words: list[str]) -> tuple[int, int]:
    """Repeated lines with a word, and words inside 5-word windows found twice or more (all occurrences)."""
    lines, dup_lines = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            dup_lines += line in lines
            lines.add(line)
    windows = list(zip(words, *(islice(words, k, None) for k in range(1, 5)), strict=False))
    if len(set(windows)) == len(windows):
        return dup_lines, 0
    counts, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 5 - max(i, upto)
            upto = i + 5
    return dup_lines, covered


def language_references(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Return ``lang, kind ('class' or 'word'), key, n``: reference histograms over all of ``docs(text, lang)``.

    Counts are summed in each task before the shuffle and the commonest words are ranked
    in two steps, so that a language with most of the rows doesn't meet in one task. A null
    language is the language ``''``.
    """
    flush = 200_000

    def count(batches):
        import pyarrow as pa

        counts: Counter = Counter()

        def rows():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "kind", "key", "n"])
            counts.clear()
            return out

        for batch in slices(batches):
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    own = by_lang.setdefault(lang or "", Counter())
                    own.update(words_of(text))
                    for k, n in enumerate(class_histogram(text).tolist()):
                        own[k] += n
            for lang, own in by_lang.items():
                for k, n in own.items():
                    counts[(lang, "class", str(k)) if isinstance(k, int) else (lang, "word", k)] += n
            if len(counts) > flush:
                yield rows()
        yield rows()

    total = bounded(docs.select("text", "lang")).mapInArrow(count, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "key"]
    first = Window.partitionBy("lang", "kind", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order)
    last = Window.partitionBy("lang", "kind").orderBy(*order)
    top = total.withColumn("r", F.row_number().over(first)).where(F.col("r") <= options.common_words).withColumn("r", F.row_number().over(last)).where(F.col("r") <= options.common_words)
    return top.select("lang", "kind", "key", "n")


class Reference:
    """Histograms of a language: character classes, and its common words."""

    def __init__(self, rows: Iterable[tuple[str, str, int]]) -> None:
        """``rows``: (kind, key, n)."""
        self.classes = np.zeros(N_CLASSES)
        self.words: dict[str, int] = {}
        for kind, key, n in sorted(rows):
            if kind == "class":
                self.classes[int(key)] = n
            else:
                self.words[key] = n
        self.counts = np.array(list(self.words.values()), float)

    def distances(self, text: str, words: list[str], histogram: np.ndarray, options: Options) -> tuple[float | None, float | None]:
        """Distances of classes and of common words; null where a text is too short or there is nothing to compare it to."""
        near = far = None
        if self.classes.any() and len(text) >= options.guard_chars:
            near = js_distance(histogram, self.classes)
        if self.words and len(words) >= options.guard_words:
            of = Counter(w for w in words if w in self.words)
            far = js_distance(np.array([of[w] for w in self.words], float), self.counts) if of else 1.0
        return near, far


def quality_rules(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Judge every row of ``docs(doc_id, text, lang)``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept``. A null text has no words and fails
    the base rules; distances are null where a guard leaves a document uncompared. Very long
    texts are read whole. Repeated rows stay repeated, an empty table gives an empty result and
    other columns are ignored.

    The references of at most ``max_languages`` languages, each of ``common_words`` words and
    the character classes, travel to the executors: their size doesn't follow the corpus.
    """
    found = materialise(language_references(docs, options), "references")
    sizes = found.where("kind = 'class'").groupBy("lang").agg(F.sum("n").alias("chars")).orderBy(F.desc("chars"), "lang").limit(options.max_languages + 1).collect()
    large = [r["lang"] for r in sizes[: options.max_languages]]
    by_lang: dict[str, list[tuple[str, str, int]]] = {}
    for lang, kind, key, n in found.where(F.col("lang").isin(large)).select("lang", "kind", "key", "n").collect() if large else ():
        by_lang.setdefault(lang, []).append((kind, key, n))
    sent = {lang: Reference(rows) for lang, rows in by_lang.items()}
    none = Reference(())

    def judge(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")}
        joined = rows.get("reference", [None] * len(rows["text"]))
        for text, lang, own in zip(rows["text"], rows["lang"], joined, strict=True):
            text = text or ""
            words = words_of(text)
            histogram = class_histogram(text)
            dup, repeat = repeat_counts(text, words)
            failed = len(words) < options.min_words or 100 * repeat > options.max_repeat_percent * len(words)
            reference = sent.get(lang or "", none) if own is None else Reference((r["kind"], r["key"], r["n"]) for r in own)
            near, far = reference.distances(text, words, histogram, options)
            kept = not failed and (near or 0) <= options.max_class_distance and (far or 0) <= options.max_word_distance
            for k, v in zip(out, (len(words), len(text) - int(histogram[0]), sum(map(text.count, SYMBOLS)), dup, repeat, failed, near, far, kept), strict=True):
                out[k].append(v)
        return {"doc_id": rows["doc_id"]} | out

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    if len(sizes) <= options.max_languages:
        return map_rows(rows, judge, schema)
    is_large = F.col("lang").isin(large)
    others = found.where(~is_large).groupBy("lang").agg(F.collect_list(F.struct("kind", "key", "n")).alias("reference"))  # some 70 rows a language
    rest = rows.where(~is_large).join(others, "lang", "left").select("doc_id", "text", "lang", "reference")
    return map_rows(rows.where(is_large), judge, schema).unionByName(map_rows(rest, judge, schema))
