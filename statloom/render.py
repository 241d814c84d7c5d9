"""Small results as Markdown, CSV and aligned text. They are collected: these are for tables of a report's size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from statloom.functions.polynomials import format_number
from statloom.models.linear import RegressionSummary
from statloom.operators.aggregates import summary

SUMMARY_SHORT = ("count", "mean", "std", "min", "max")


def _cells(df: DataFrame, columns: tuple[str, ...] | list[str] | None) -> tuple[list[str], list[list[str]]]:
    names = list(columns or df.columns)
    return names, [[_cell(v) for v in r] for r in df.select(*names).collect()]


def _cell(v) -> str:
    return "" if v is None else format_number(v) if isinstance(v, float) else str(v)


def markdown(df: DataFrame, columns: list[str] | None = None) -> str:
    names, rows = _cells(df, columns)
    return "\n".join(f"| {' | '.join(r)} |" for r in [names, ["---"] * len(names), *rows])


def csv(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    names, rows = _cells(df, columns)
    return [",".join(r) for r in [names, *rows]]


def text(df: DataFrame, columns: list[str] | None = None) -> str:
    names, rows = _cells(df, columns)
    width = [max(len(r[k]) for r in [names, *rows]) for k in range(len(names))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, width)) for r in [names, *rows])


def summary_markdown(summary: DataFrame) -> str:
    """Five of the nine fields of a frame summary."""
    return markdown(summary, ["column", *SUMMARY_SHORT])


def contingency_markdown(table: DataFrame, probabilities: bool = False) -> str:
    """A contingency table (row, column, count) with its margins."""
    found = {(r["row"], r["column"]): r["count"] for r in table.collect()}
    rows, columns = sorted({r for r, _ in found}), sorted({c for _, c in found})
    whole = sum(found.values())
    show = (lambda n: f"{n / whole if whole else 0:.4f}") if probabilities else str
    lines = [["", *columns, "Total"], ["---"] * (len(columns) + 2)]
    lines += [[r, *(show(found[r, c]) for c in columns), show(sum(found[r, c] for c in columns))] for r in rows]
    lines.append(["Total", *(show(sum(found[r, c] for r in rows)) for c in columns), show(whole)])
    return "\n".join(f"| {' | '.join(map(str, line))} |" for line in lines)


def contingency_csv(table: DataFrame) -> str:
    """The cells, row by row."""
    return ",".join(str(r["count"]) for r in table.orderBy("row", "column").collect())


def regression_markdown(summary: RegressionSummary) -> str:
    head = ["Term", "Coefficient", "Std. error", "t", "p", "Lower", "Upper"]
    lines = [head, ["---"] * len(head), *([n, *map(format_number, v)] for n, *v in summary.rows())]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def regression_csv(summary: RegressionSummary) -> list[str]:
    return ["term,coefficient,standard_error,t,p,lower,upper", *(",".join([n, *map(repr, v)]) for n, *v in summary.rows())]


def vector(values, inline: bool = False) -> str:
    """A vector of numbers or fractions as a bracketed column, or on one line."""
    cells = [format_number(v) if isinstance(v, (int, float)) else str(v) for v in values]
    if inline:
        return f"[{', '.join(cells)}]"
    return matrix([[c] for c in cells])


def matrix(rows) -> str:
    """A matrix as a grid between tall brackets."""
    cells = [[v if isinstance(v, str) else format_number(v) if isinstance(v, (int, float)) else str(v) for v in r] for r in rows]
    if not cells:
        return "[]"
    width = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))]
    lines = ["  ".join(v.rjust(w) for v, w in zip(r, width)) for r in cells]
    if len(lines) == 1:
        return f"[ {lines[0]} ]"
    left = ["⎡", *"⎢" * (len(lines) - 2), "⎣"]
    right = ["⎤", *"⎥" * (len(lines) - 2), "⎦"]
    return "\n".join(f"{a} {line} {b}" for a, line, b in zip(left, lines, right))


def info(df: DataFrame, v: str, order: str, preview: int = 5) -> str:
    """Count, type, mean, deviation, range and the first items of a column."""
    got = summary(df, v).first()
    first = [format_number(float(r[0])) for r in df.orderBy(order).select(v).limit(preview).collect() if r[0] is not None]
    return f"count: {got['count']}\ntype: {df.schema[v].dataType.simpleString()}\nmean: {_cell(got['mean'])}, std: {_cell(got['std'])}, min: {_cell(got['min'])}, max: {_cell(got['max'])}\nitems: [{', '.join(first)}{', ...' if got['count'] > preview else ''}]"
