"""Secret scans: base patterns, then grammar inference over the formats of known credentials.

Credentials that the base patterns find are the labelled examples. For each kind a prefix
tree over character classes is generalised by merging statistically compatible states
(Hoeffding bounds on the frequencies of continuing and ending, down all shared suffixes)
into a probabilistic automaton. Every other run of eight or more credential characters, and
what base spans leave of one, is a candidate. It is a secret if the best automaton's likelihood
of its format exceeds that of a background model, class bigrams of all ordinary runs of the
corpus, by the odds of an ordinary run against a credential there and a margin. Runs of the
same classes have the same score, which a worker works out once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded, map_rows, materialise, slices

#: The base patterns by kind, in their order.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
#: The least length of a credential is the base's.
LEAST = 8
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: d: digit, a: a-f, l: other lower case, A: A-F, U: other upper case; other characters stand for themselves.
_CLASS = str.maketrans({chr(c): "d" if chr(c).isdigit() else "a" if chr(c) in "abcdef" else "l" if chr(c).islower() else "A" if chr(c) in "ABCDEF" else "U" for c in range(128) if chr(c).isalnum()})
Span = tuple[str, int, int]


@dataclass(frozen=True)
class Options:
    """``max_examples`` bounds the credentials of a kind that are learned from (those of least hash).

    Automata read a run in pieces of ``piece`` characters; ``margin`` is in bits.
    """

    max_examples: int = 256
    alpha: float = 0.05
    margin: float = 10.0
    piece: int = 128


def base_spans(text: str | None) -> list[Span]:
    """Leftmost matches that don't overlap within a kind, by start, then kind: (kind, start, end) in code points."""
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def credential_of(text: str, span: Span) -> str:
    """The credential itself: of an assignment, its value."""
    kind, start, end = span
    return _ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]


def candidates(text: str | None, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters, without what base spans cover of them."""
    if not text:
        return
    taken: list[list[int]] = []
    for _, a, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    begins = [a for a, _ in taken]
    for m in _RUN.finditer(text):
        at, end = m.span()
        for a, b in taken[max(0, bisect_right(begins, at) - 1) :] if taken else ():
            if a >= end:
                break
            if a - at >= LEAST:
                yield at, a
            at = max(at, b)
        if end - at >= LEAST:
            yield at, end


def classes_of(run: str) -> str:
    """The classes of a run's characters."""
    return run.translate(_CLASS)


def pieces_of(run: str, size: int) -> list[str]:
    return [run[i : i + size] for i in range(0, len(run), size)]


class Automaton:
    """Probabilistic automaton by state merging; ``arcs[state][class] = [target, count]``, ``ends[state]`` = runs ending there."""

    def __init__(self, examples: list[str], alpha: float) -> None:
        self.arcs: list[dict[str, list[int]]] = [{}]
        self.ends = [0]
        for run in examples:
            at = 0
            for c in run:
                if c not in self.arcs[at]:
                    self.arcs[at][c] = [len(self.arcs), 0]
                    self.arcs.append({})
                    self.ends.append(0)
                self.arcs[at][c][1] += 1
                at = self.arcs[at][c][0]
            self.ends[at] += 1
        self._factor = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(n for _, n in self.arcs[s].values())

    def _differ(self, n: int, of_n: int, m: int, of_m: int) -> bool:
        """Whether two frequencies differ by more than their Hoeffding bound."""
        return bool(of_n and of_m) and abs(n / of_n - m / of_m) > self._factor * (1 / math.sqrt(of_n) + 1 / math.sqrt(of_m))

    def _compatible(self, red: int, blue: int) -> bool:
        work = [(red, blue)]
        while work:
            r, b = work.pop()
            nr, nb = self._total(r), self._total(b)
            if self._differ(self.ends[r], nr, self.ends[b], nb):
                return False
            for c in self.arcs[r].keys() | self.arcs[b].keys():
                x, y = self.arcs[r].get(c), self.arcs[b].get(c)
                if self._differ(x[1] if x else 0, nr, y[1] if y else 0, nb):
                    return False
                if x and y:
                    work.append((x[0], y[0]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red``."""
        work = [(red, blue)]
        while work:
            r, b = work.pop()
            self.ends[r] += self.ends[b]
            for c, (target, n) in self.arcs[b].items():
                if c in self.arcs[r]:
                    self.arcs[r][c][1] += n
                    work.append((self.arcs[r][c][0], target))
                else:
                    self.arcs[r][c] = [target, n]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            settled = set(red)
            blue = [(s, c, t) for s in red for c, (t, _) in sorted(self.arcs[s].items()) if t not in settled]
            if not blue:
                break
            source, c, state = max(blue, key=lambda x: (self._total(x[2]), -x[2]))
            for r in red:
                if self._compatible(r, state):
                    self.arcs[source][c][0] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)

    def log2_likelihood(self, run: str) -> float:
        """Log2 probability of a run and its end, smoothed by half a count over the classes seen and one more."""
        at, total = 0, 0.0
        for c in run:
            n = self._total(at) + 0.5 * (len(self.arcs[at]) + 2)
            target, count = self.arcs[at].get(c, (0, 0))
            total += math.log2((count + 0.5) / n / (1 if count else 8))
            at = target
        return total + math.log2((self.ends[at] + 0.5) / (self._total(at) + 0.5 * (len(self.arcs[at]) + 2)))


class Background:
    """Class bigrams of ordinary runs."""

    def __init__(self, pairs: dict[tuple[str, str], int]) -> None:
        self.pairs: dict[str, Counter] = defaultdict(Counter)
        for (a, b), n in pairs.items():
            self.pairs[a][b] += n
        self.totals = {a: after.total() for a, after in self.pairs.items()}
        self.kinds = 2 + len({b for after in self.pairs.values() for b in after})

    def log2_likelihood(self, shape: str) -> float:
        none: Counter = Counter()
        return sum(math.log2((self.pairs.get(a, none)[b] + 0.5) / (self.totals.get(a, 0) + 0.5 * self.kinds)) for a, b in zip("^" + shape, shape + "$", strict=True))


def bigrams(shapes: Counter) -> Counter:
    """Class bigrams of runs with their beginnings and ends, by how often each shape occurs."""
    pairs: Counter = Counter()
    for shape, n in shapes.items():
        for a, b in zip("^" + shape, shape + "$", strict=True):
            pairs[a, b] += n
    return pairs


class Scanner:
    """Scores candidates by format."""

    def __init__(self, examples: dict[str, list[str]], ordinary: dict[tuple[str, str], int], n_credentials: int, options: Options = Options()) -> None:
        """``examples``: pieces of credentials by kind; ``ordinary``: class bigrams of all ordinary runs; ``n_credentials``: how many there are."""
        self.options = options
        self.automata = {k: Automaton([classes_of(x) for x in sorted(v)], options.alpha) for k, v in sorted(examples.items()) if v}
        self.background = Background(ordinary)
        runs = sum(n for (a, _), n in ordinary.items() if a == "^")
        #: Bits by which an automaton must be better than the background.
        self.threshold = math.log2((runs + 1) / (n_credentials + 1)) + options.margin
        self._met: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_met": {}}

    def score(self, run: str) -> float:
        """Bits by which the best automaton explains a run's format better than the background; minus infinity without credentials."""
        if not self.automata:
            return -math.inf
        shape = classes_of(run)
        if (known := self._met.get(shape)) is None:
            pieces = pieces_of(shape, self.options.piece)
            known = max(sum(a.log2_likelihood(p) for p in pieces) for a in self.automata.values()) - self.background.log2_likelihood(shape)
            if len(self._met) > 200_000:
                self._met.clear()
            self._met[shape] = known
        return known

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans by start, then kind."""
        base = base_spans(text)
        added = [("format", a, b) for a, b in candidates(text, base) if self.score(text[a:b]) >= self.threshold]
        return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))) if added else base


def ordinary_bigrams(docs: DataFrame) -> dict[tuple[str, str], int]:
    """Class bigrams of all ordinary runs of all texts: summed in each task, then over tasks; under 200 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        shapes: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                shapes.update(classes_of(text[a:b]) for a, b in candidates(text, base_spans(text)))
            if len(shapes) > 50_000:
                pairs.update(bigrams(shapes))
                shapes.clear()
        pairs.update(bigrams(shapes))
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string()), "n": pa.array(list(pairs.values()), pa.int64())})

    found = bounded(docs.select("text")).mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["n"] for r in found.collect()}


def fit(docs: DataFrame, options: Options = Options()) -> Scanner:
    """Learn, at once, from base matches and ordinary runs of all of ``docs(text)``.

    Every match takes part in the choice, in pieces of ``piece`` characters; those of least hash
    are learned from, a bounded number a kind. Every ordinary run counts in the background.
    """

    def offer(rows: dict[str, list]) -> dict[str, list]:
        out: Counter = Counter()
        for text in rows["text"]:
            for span in base_spans(text):
                for p in pieces_of(credential_of(text, span), options.piece):
                    out[span[0], p] += 1
        return {"kind": [k for k, _ in out], "value": [v for _, v in out], "n": list(out.values())}

    found = materialise(map_rows(docs.select("text"), offer, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    examples: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(options.max_examples).collect():
            examples.setdefault(kind, []).append(r["value"])
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Scanner(examples, ordinary_bigrams(docs), n, options)


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """Return ``doc_id, base, spans`` (arrays of ``kind, start, end``) for every row of ``docs(doc_id, text)``.

    Null and empty texts have no spans; very long texts are scanned whole; repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [scanner.spans(t) for t in rows["text"]]
        as_rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in pair] for pair in found]
        return {"doc_id": rows["doc_id"], "base": [b for b, _ in as_rows], "spans": [s for _, s in as_rows]}

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id long, base {span}, spans {span}")


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """``text`` with every span replaced by ``mark``, spans that overlap by one."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """The columns of ``docs`` with every span in ``text`` replaced by ``[secret]`` and ``n_chars`` (if there) brought up to date.

    Null and empty texts stay as they are, as do rows without a span and all other columns,
    whatever their names; repeated rows stay repeated; an empty table gives an empty result.
    """
    sizes = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [redacted(t, s) if t and (s := scanner.spans(t)[1]) else t for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if sizes:
                at = batch.schema.get_field_index("n_chars")
                counts = [n if t is None else len(t) for t, n in zip(texts, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
            yield batch

    return bounded(docs).mapInArrow(run, docs.schema)
