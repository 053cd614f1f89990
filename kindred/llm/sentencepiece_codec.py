"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece has a white-space marker after another character, so a piece never crosses
from one marked word (markers, then other characters) to the next. A worker keeps a
table of the distinct marked words it has met; each is segmented once by the library,
and the ids of a text are put together from the table by position. Decoding is the library's,
of all ids of a text together.

The table is a worker's, not the corpus's: a joined table of all words would move every
text's words over the network twice (see the README's figures).
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame

from kindred.llm.common import map_rows

MARK = "▁"
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct words kept by a worker before its table starts afresh.
MAX_WORDS = 250_000


class ChunkTable(dict):
    """Marked word (without its first mark) -> (ids as text, ids)."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces cross white space: words can't be segmented alone")

    def __missing__(self, word: str) -> tuple[str, list[int]]:
        # the library puts a mark before the text itself; a lone mark can only come from it that way
        ids = self.library.encode(word) if word else [self.library.piece_to_id(MARK)]
        self[word] = entry = (",".join(map(str, ids)), ids)
        return entry

    def entries(self, text: str | None) -> list[tuple[str, list[int]]]:
        """Table entries of a text's marked words, in order."""
        if not text:
            return []
        if len(self) > MAX_WORDS:
            self.clear()
        marked = text.replace(" ", MARK)
        if MARK + MARK in marked or marked[0] == MARK or marked[-1] == MARK:
            return [self[w[1:]] for w in _MARKED.findall(MARK + marked)]
        return [self[w] for w in marked.split(MARK)]


@functools.lru_cache(maxsize=2)
def chunk_table(model_path: str) -> ChunkTable:
    """One table a worker process."""
    return ChunkTable(model_path)


def encode_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """Return ``doc_id, ids array<int>`` of whole texts, without begin or end ids.

    Null and empty texts give an empty array, very long texts are encoded whole, repeated rows
    stay repeated, an empty table gives an empty result, other columns are ignored.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        table = chunk_table(model_path)
        ids = [list(chain.from_iterable(e[1] for e in table.entries(t))) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "ids": ids}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """Return ``doc_id, text`` decoded from ``ids``; null or no ids give an empty text, repeated rows stay repeated, other columns are ignored."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "text": [chunk_table(model_path).library.decode(list(i or [])) for i in rows["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def codec_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Return ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the round trip of every text.

    Null and empty texts have no ids (digests of the empty string), very long texts are taken
    whole. Repeated rows stay repeated, an empty table gives an empty result, other columns are
    ignored.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        table, n, ids, decoded = chunk_table(model_path), [], [], []
        for text in rows["text"]:
            found = table.entries(text)
            whole = list(chain.from_iterable([e[1] for e in found]))
            n.append(len(whole))
            ids.append(hashlib.sha256(",".join([e[0] for e in found]).encode()).hexdigest())
            decoded.append(hashlib.sha256(table.library.decode(whole).encode()).hexdigest())
        return {"doc_id": rows["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
