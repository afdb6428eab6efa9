"""Explicit schemas, as DDL text, of the tables that the operators read and write."""

from __future__ import annotations

def monthly_wide_schema() -> str:
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    return (
        "Year int, Type string, " + ", ".join(f"{m} long" for m in months)
    )


def with_types(columns: list[str], default: str = "string", **types) -> str:
    """Schema for a text file where only some columns deviate from a default."""
    return (
        ", ".join(f"`{c}` {types.get(c, default)}" for c in columns)
    )
