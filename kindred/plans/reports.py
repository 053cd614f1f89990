"""Profiles as JSON and Markdown: small result tables only, rendered on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

#: Rows of a table that a report shows; it says how many more there are.
SHOWN = 200


def collected(parts: Mapping[str, DataFrame], shown: int = SHOWN) -> dict[str, list[dict]]:
    """The first rows of each table, sorted by all its columns; a last one says how many more there are, if any."""
    out = {}
    for name, df in parts.items():
        rows = [r.asDict(recursive=True) for r in df.orderBy(*df.columns).limit(shown + 1).collect()]
        if len(rows) > shown:
            rows[shown:] = [dict.fromkeys(df.columns) | {df.columns[0]: f"and {df.count() - shown} more rows"}]
        out[name] = rows
    return out


def as_json(parts: Mapping[str, DataFrame]) -> str:
    return json.dumps(collected(parts), indent=2, default=str, ensure_ascii=False)


def as_markdown(title: str, parts: Mapping[str, DataFrame]) -> str:
    """A heading and a table for each part; an empty part says so."""
    lines = [f"# {title}", ""]
    for name, rows in collected(parts).items():
        lines += [f"## {name}", ""]
        if rows:
            columns = list(rows[0])
            lines += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
            lines += ["| " + " | ".join("" if r[c] is None else str(r[c]).replace("|", "\\|").replace("\n", " ") for c in columns) + " |" for r in rows]
        else:
            lines.append("No rows.")
        lines.append("")
    return "\n".join(lines)
