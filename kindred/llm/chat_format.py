"""Chat formatting: the best root-to-leaf path of each reply tree, written as one conversation.

Paths come from iterative self-joins by pointer doubling: round k knows every message's
2^k-th ancestor and the summed score up to it, so a tree of depth d takes log2(d) joins.
Branches are ranked by their mean score; only the chosen paths are spelled out, again by
doubling. Both sides of each join are shuffled tables, so that a message with very many
replies is split by adaptive execution. Texts join at the end. The template marks turns; control strings inside texts are
escaped reversibly with a backslash, and a mask of spans covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import map_rows, materialise

#: What begins and ends a turn.
HEAD, TAIL = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def format_turns(turns: list[tuple[str | None, str | None]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Format (role, text) turns; spans, in code points, of the texts of role ``trained``. Nulls count as empty."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{HEAD}{_ROLE_CONTROL.sub(r'\\\g<0>', role or '')}: "
        body = _CONTROL.sub(r"\\\g<0>", text or "")
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), spans


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def best_paths(messages: DataFrame, n_best: int = 1) -> DataFrame:
    """Return ``path, rank, node, back`` of the ``n_best`` branches of each tree of ``messages(tree, node, parent, score)``.

    ``path`` is the leaf, ``back`` the distance from it. Branches are ranked by mean score,
    then length, then the leaf that sorts first. A parent that isn't there makes a root;
    a null score counts as zero; messages on a cycle hang from no root and are in no path.
    ``node`` must be unique. Other columns are ignored; an empty table gives an empty result.
    """
    rows = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = rows.join(known, "parent", "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"))
    up = materialise(up.withColumn("depth", F.col("up").isNotNull().cast("int")), "up")
    jumps = []
    open_ = -1
    for k in range(64):
        before, open_ = open_, up.where("up is not null").count()
        if open_ in (0, before):  # all reach a root, or the rest is on cycles
            break
        jumps.append(up.select("node", F.col("up").alias("to")))
        over = up.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        far = up.where("up is not null").join(over, "up")
        far = far.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"))
        up = materialise(up.where("up is null").unionByName(far), f"up{k}")
    leaves = up.where("up is null").join(rows.where("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node"))
    found = leaves.withColumn("rank", rank).where(F.col("rank") <= n_best).select(F.col("node").alias("path"), "rank", "node", F.lit(0).alias("back"))
    for k, jump in enumerate(jumps):
        higher = found.join(jump.where("to is not null"), "node").select("path", "rank", F.col("to").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        found = materialise(found.unionByName(higher), f"path{k}")
    return found


def format_conversations(messages: DataFrame, n_best: int = 1, trained: str = "assistant") -> DataFrame:
    """Return ``tree, rank, formatted, mask array<struct<start, end>>``: one row a chosen branch.

    ``messages`` has ``tree, node, parent, score, role, text``; other columns are ignored.
    Null roles and texts count as empty, very long texts are taken whole; an empty table gives an
    empty result. A conversation is one row, so its turns meet in one task, as its text does in any case.
    """
    paths = best_paths(messages, n_best)
    turns = paths.join(messages.select("node", "tree", "role", "text"), "node")
    whole = turns.groupBy("tree", "path", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"))

    def run(rows: dict[str, list]) -> dict[str, list]:
        done = [format_turns([(t["role"], t["text"]) for t in turns], trained) for turns in rows["turns"]]
        return {"tree": rows["tree"], "rank": rows["rank"], "formatted": [f for f, _ in done], "mask": [[{"start": a, "end": b} for a, b in m] for _, m in done]}

    return map_rows(whole.select("tree", "rank", "turns"), run, "tree long, rank int, formatted string, mask array<struct<start: int, end: int>>")


def as_chains(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before it (by turn, then role and text)."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    numbered = conversations.select("conv_id", "role", "text", "turn").withColumn("n", order)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("/"))
    return numbered.select(F.col("conv_id").alias("tree"), F.concat(name, F.col("n")).alias("node"), F.when(F.col("n") > 1, F.concat(name, F.col("n") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of ``tree, formatted, mask``, all taken from the formatted text."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, mask in zip(rows["formatted"], rows["mask"], strict=True):
            turns = read_turns(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
            for k, v in zip(out, (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                out[k].append(v)
        return {"conv_id": rows["tree"]} | out

    return map_rows(formatted.select("tree", "formatted", "mask"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
