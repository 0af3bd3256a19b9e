"""Rendering of finished result tables; the tables hold one row per condition."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def html_table(rows: DataFrame, title: str, max_rows: int = 1000) -> str:
    """Self-contained page for a small result table, numbers to three decimals."""
    found = rows.limit(max_rows + 1).collect()
    if len(found) > max_rows:
        raise ValueError("a report shows summary rows only")

    def cell(value) -> str:
        return f"{value:.3f}" if isinstance(value, float) else escape("" if value is None else str(value))

    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in found)
    return (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head>'
        f"<body><h1>{escape(title)}</h1><table><thead><tr>{head}</tr></thead>"
        f"<tbody>{body}</tbody></table></body></html>"
    )
