"""Helpers that write the DuckDB oracle texts (one text per registered query)."""

from __future__ import annotations

from ..sources.frames import risk_frame_sql_duckdb


def with_rf(body: str, *ctes: str) -> str:
    """``WITH rf AS (<risk_frame>)[, more ctes] <body>``."""
    parts = [f"rf AS ({risk_frame_sql_duckdb()})", *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def r4(expr: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def union_all(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


def nan_null(expr: str) -> str:
    """DuckDB gives NaN where Spark gives null (constant columns)."""
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END"
