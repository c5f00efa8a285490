"""Small helpers for registered queries and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATES = frozenset({"time", "window_end", "start", "end", "event_start", "event_end", "timestamp", "time_start", "time_end"})


#: Added before rounding, so that a tie does not fall to either side by the order of a sum.
NUDGE = 2e-10


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that sums in any order agree, and dates as text."""

    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        # Rounding by whole numbers: the built-in goes by way of decimals, row by row.
        return (F.rint((c + NUDGE) * 1e6) / 1e6 + 0.0).alias(name) if kind == "double" else c.cast("string").alias(name) if kind == "date" else c.alias(name)

    return df.select(*[one(c, t) for c, t in df.dtypes])


def _top_level(sql: str) -> list[tuple[int, str]]:
    """Positions of characters outside parentheses and quotes."""
    depth, quoted, out = 0, "", []
    for i, ch in enumerate(sql):
        if quoted:
            quoted = "" if ch == quoted else quoted
            continue
        if ch == "'":
            quoted = ch
        depth += (ch in "([") - (ch in ")]")
        if depth == 0:
            out.append((i, ch))
    return out


def output_columns(sql: str) -> list[str]:
    """Names of the columns of a statement's last select at the top level."""
    outside = {i for i, _ in _top_level(sql)}
    start = [m.end() for m in re.finditer(r"\bSELECT\b(\s+DISTINCT\b)?", sql) if m.start() in outside][-1]
    end = next((m.start() for m in re.finditer(r"\bFROM\b", sql) if m.start() in outside and m.start() > start), len(sql))
    cuts = [start - 1, *(i for i, ch in _top_level(sql) if ch == "," and start <= i < end), end]
    items = [sql[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False)]
    return [re.split(r"[\s.]+", item)[-1].strip('"') for item in items]


def finished(sql: str) -> str:
    """The statement with its date columns as text, rounding as :func:`rounded` does."""
    sql = sql.replace(", 6)", f" + {NUDGE}, 6)")
    dates = [c for c in output_columns(sql) if c in DATES]
    return f'SELECT * REPLACE ({", ".join(f"""CAST("{c}" AS VARCHAR) AS "{c}" """ for c in dates)}) FROM ({sql})' if dates else sql
