"""Token counts from a compiled finite-state transducer.

The BPE vocabulary of a sentencepiece model is compiled, lazily, into a deterministic
transducer over characters. A state keeps what later characters can still ask for: the
longest suffix of the input that begins some piece and, for every suffix that does, the
last token of the text before it. A transition carries the number of tokens by which the
count of the prefix changes (it can be negative: a merge takes tokens back), so a text's
count is the sum along its path.

Every text is cut into chunks, and every chunk becomes a *state map*: a table from entry
states to the end state and the tokens emitted on the way. White space synchronises the
transducer (no piece has a marker after another character, so the state after "character,
marker" is the start state whatever came before): the left context of a chunk, read from its
last synchronising point, tells the entry state that its table is made for. Without such a
point the state is a guess, and a table gets an entry for any other state that it is asked
for. State maps compose associatively; ``prefix_scan`` composes those of a text in a balanced
tree. Words between synchronising points are macro transitions from the start state to itself,
kept by a worker with what they emit.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kindred.llm.common import map_rows

MARK = "▁"
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A character that is no marker and the marker after it.
_SYNC = re.compile(f"[^{MARK}]{MARK}")
#: Code points in a chunk, and those before it that are read for its entry state.
CHUNK, CONTEXT = 1 << 12, 1 << 8
#: States and words kept by a worker before it starts afresh.
MAX_STATES, MAX_WORDS = 200_000, 1_000_000


class Vocabulary:
    """Pieces and merge priorities of a BPE sentencepiece model."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.priority: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)):
                self.priority[sp.id_to_piece(i)] = sp.get_score(i)
        self.prefixes = {p[:k] for p in self.priority for k in range(1, len(p) + 1)}
        if any(MARK in p.lstrip(MARK) for p in self.priority):
            raise ValueError("pieces cross white space: the transducer would not synchronise")

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: merge the adjacent pair of highest score, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.priority.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Transducer:
    """Lazily determinised counting transducer; ``step`` builds a transition once."""

    START = 0

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._adjacent: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the start."""
        start = ("", ((0, "", 0),))
        self.states, self.ids, self.arcs = [start], {start: 0}, [{}]
        self._adjacent.clear()

    def _fits(self, before: str, token: str) -> bool:
        """Whether ``token`` can follow ``before`` in a canonical tokenisation."""
        key = (before, token)
        if (known := self._adjacent.get(key)) is None:
            got = self.vocabulary.merge(before + token)
            known = self._adjacent[key] = got == ([before, token] if before else [token])
        return known

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the change in the number of tokens."""
        arcs = self.arcs[state]
        if char in arcs:
            return arcs[char]
        suffix, frontier = self.states[state]
        pieces, prefixes = self.vocabulary.priority, self.vocabulary.prefixes
        for size, before, since in frontier:  # longest first
            token = suffix[len(suffix) - size :] + char if size else char
            if (token in pieces or not size) and self._fits(before, token):
                gain = (1 if token in pieces else len(char.encode())) - since
                break
        else:
            raise AssertionError("every prefix has a tokenisation")
        kept = tuple((size + 1, before, since + gain) for size, before, since in frontier if suffix[len(suffix) - size :] + char in prefixes) if suffix else tuple((1, before, since + gain) for _, before, since in frontier if char in prefixes)
        longest = kept[0][0] if kept else 0
        new = ((suffix + char)[len(suffix) + 1 - longest :] if longest else "", (*kept, (0, token, 0)))
        to = self.ids.setdefault(new, len(self.states))
        if to == len(self.states):
            self.states.append(new)
            self.arcs.append({})
        arcs[char] = (to, gain)
        return to, gain

    def run(self, state: int, text: str) -> tuple[int, int]:
        """End state and summed emissions of ``text`` read from ``state``."""
        arcs, total = self.arcs, 0
        for char in text:
            to = arcs[state].get(char)
            state, gain = to if to is not None else self.step(state, char)
            total += gain
        return state, total


@dataclass
class StateMap:
    """What a chunk, or the two maps that it is made of, does to entry states: ``table[entry] = (end, emitted)``."""

    of: str | tuple[StateMap, StateMap]
    table: dict[int, tuple[int, int]] = field(default_factory=dict)


class WordCounts(dict):
    """Emissions of a marked word read from the start state, by its text without the mark."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        count = self.machine.run(Transducer.START, MARK + word)[1]
        self[word] = count
        return count


class Counter:
    """Counts tokens of whole texts."""

    def __init__(self, model_path: str) -> None:
        self.machine = Transducer(Vocabulary(model_path))
        self.words = WordCounts(self.machine)

    def _whole(self, marked: str) -> int:
        """Tokens of marked words that each begin in the start state."""
        if not marked:
            return 0
        if MARK + MARK not in marked:
            return sum(map(self.words.__getitem__, marked[1:].split(MARK)))
        run = self.machine.run
        return sum(self.words[w[1:]] if w[1:2] != MARK else run(Transducer.START, w)[1] for w in _MARKED.findall(marked))

    def read(self, state: int, chunk: str) -> tuple[int, int]:
        """End state and emissions of a chunk of marked text: step by step to its first synchronising point and from its last, by words between."""
        points = self._points(chunk)
        if points is None:
            return self.machine.run(state, chunk)
        first, last = points
        count = self.machine.run(state, chunk[:first])[1] if first else 0
        end, tail = self.machine.run(Transducer.START, chunk[last:])
        return end, count + self._whole(chunk[first:last]) + tail

    @staticmethod
    def _points(chunk: str) -> tuple[int, int] | None:
        """Places of the first and the last marker after another character."""
        first = _SYNC.search(chunk)
        if not first:
            return None
        last = chunk.rfind(MARK)
        while chunk[last - 1] == MARK:
            last -= 1
        return first.start() + 1, last

    def summarise(self, chunk: str, before: str = "") -> StateMap:
        """State map of a chunk, with the entry state that the text ``before`` it leads to."""
        points = self._points(before)
        entry = self.machine.run(Transducer.START, before[points[1] :] if points else before)[0]
        return StateMap(chunk, {entry: self.read(entry, chunk)})

    def apply(self, m: StateMap, state: int) -> tuple[int, int]:
        """End state and emissions of a map from an entry state; worked out and kept if it isn't in the table yet."""
        if state not in m.table:
            if isinstance(m.of, str):
                m.table[state] = self.read(state, m.of)
            else:
                middle, count = self.apply(m.of[0], state)
                end, more = self.apply(m.of[1], middle)
                m.table[state] = end, count + more
        return m.table[state]

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``; associative."""
        both = StateMap((a, b))
        for state in list(a.table):
            self.apply(both, state)
        return both

    def prefix_scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All inclusive prefixes of ``maps`` under ``compose``, by recursive doubling of pairs."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
        done = self.prefix_scan(pairs)
        return [maps[0] if i == 0 else done[i // 2] if i % 2 else self.compose(done[i // 2 - 1], maps[i]) for i in range(len(maps))]

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; a null or empty text has none."""
        if not text:
            return 0
        if len(self.machine.states) > MAX_STATES:
            self.words.clear()
            self.machine.reset()
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        marked = MARK + text.replace(" ", MARK)
        maps = [self.summarise(marked[i : i + chunk], marked[max(0, i - CONTEXT) : i]) for i in range(0, len(marked), chunk)]
        return self.apply(self.prefix_scan(maps)[-1], Transducer.START)[1]


@functools.lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """One counter a worker process."""
    return Counter(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Return ``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    Null texts count as empty (0 bytes, 0 tokens); very long texts are read whole, chunk by
    chunk; repeated rows stay repeated; an empty table gives an empty result; other columns are
    ignored. No shuffle; memory per worker is bounded by ``MAX_STATES`` and ``MAX_WORDS``.
    """

    def count(rows: dict[str, list]) -> dict[str, list]:
        tokens = [counter(model_path).count(t) for t in rows["text"]]
        sizes = [len(t.encode()) if t else 0 for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_rows(docs.select("doc_id", "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
