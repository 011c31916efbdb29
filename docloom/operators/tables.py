"""Flattening of table matrices to self-describing lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that hold nothing, and headers that qualify nothing.
FILLERS = {"", ":", "-", "--", "|", "n.a.", "na", "nan"}
GENERIC = {"", "value", "values", "amount", "amounts", "details", "particulars", "description", "remarks", "v"}
LONG_LABEL = 60
HEADER_ROWS = 2

_SPACE = re.compile(r"\s+")


def squeeze(cell: str | None) -> str:
    return _SPACE.sub(" ", (cell or "").strip())


def _digits(cell: str) -> bool:
    return any(c.isdecimal() for c in cell)


class _Grid:
    """A cleaned, padded matrix whose rows become lines."""

    def __init__(self, rows: Sequence[Sequence[str | None]]):
        squeezed = [[squeeze(c) for c in row] for row in rows]
        full = [row for row in squeezed if any(row)]
        full = [row if len(row) < 3 else [c for c in row if c != ":"] for row in full]
        self.width = max(map(len, full), default=0)
        self.rows = [row + [""] * (self.width - len(row)) for row in full]

    def lines(self) -> list[str]:
        if not self.rows:
            return []
        if len(self.rows) == 1 or self.width <= 2:
            return [x for row in self.rows if (x := self._plain(row))]
        depth = self._header_rows()
        titles = [" ".join(t for level in self.rows[:depth] if (t := level[k]).lower() not in GENERIC) for k in range(self.width)]
        return [line for row in self.rows[depth:] for line in self._record(row, titles)]

    @staticmethod
    def _plain(row: list[str]) -> str:
        """``label: a | b``; the label alone if no value says anything."""
        if all(c in FILLERS for c in row[1:]):
            return "" if row[0] in FILLERS else row[0]
        values = " | ".join(c for c in row[1:] if c)
        return f"{row[0]}: {values}" if row[0] else ""

    def _header_rows(self) -> int:
        """Leading rows without digits, never the last row."""
        depth = 0
        while depth < min(HEADER_ROWS, len(self.rows) - 1) and any(self.rows[depth]) and not any(map(_digits, self.rows[depth])):
            depth += 1
        return depth

    def _record(self, row: list[str], titles: list[str]) -> list[str]:
        at = next((k for k, c in enumerate(row) if c not in FILLERS), 0)
        label = row[at]
        values = [(titles[k], c) for k, c in enumerate(row) if k > at and c not in FILLERS]
        if not values:
            return [] if label in FILLERS else [label]
        if not _digits(label) and not any(_digits(v) for _, v in values):
            return [" | ".join(c for c in row if c not in FILLERS)]
        if all(t.lower() in GENERIC for t, _ in values):
            return [f"{label}: " + " | ".join(v for _, v in values)] if label else []
        lines = [f"{self._named(label, t)}: {v}" for t, v in values if t]
        bare = " | ".join(v for t, v in values if not t)
        if bare:
            lines.append(f"{label} (other values): {bare}" if lines else f"{label}: {bare}")
        return lines

    @staticmethod
    def _named(label: str, title: str) -> str:
        label = label or title
        if title.lower() in label.lower() or len(label) > LONG_LABEL:
            return label
        return f"{label} - {title}" if "(" in title else f"{label} ({title})"


def flatten(rows: Sequence[Sequence[str | None]] | None, heading: str | None = "") -> str:
    """``Label (Qualifier): value`` lines of a matrix under its heading."""
    title = squeeze(heading)
    return "\n".join([title] * bool(title) + _Grid(rows if rows is not None else []).lines())


def flatten_column(rows: Column, heading: Column) -> Column:
    """``flatten`` over columns, in Arrow batches."""

    @F.arrow_udf("string")
    def run(matrix: pa.Array, title: pa.Array) -> pa.Array:
        return pa.array((flatten(m.as_py(), t.as_py()) for m, t in zip(matrix, title, strict=True)), pa.string())

    return run(rows, heading)
