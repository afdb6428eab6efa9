"""Text expressions: padded codes, split names, labels, point text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.constants import PAIR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded(number, width: int) -> Column:
    """Zero-padded code number that is never cut when it is longer."""
    digits = _col(number).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def place_code(state_part, county_part) -> Column:
    return F.concat(_col(state_part), _col(county_part))


def split_pair(text) -> tuple[Column, Column]:
    """Both halves of ``left,right``; NULL when the text is not such a pair."""
    return tuple(
        F.nullif(F.regexp_extract(_col(text), PAIR, i), F.lit("")) for i in (1, 2)
    )


def split_part(text, delimiter: str, index: int) -> Column:
    return F.get(F.split(_col(text), delimiter), index)


def point_text(x, y) -> Column:
    return F.concat_ws(" ", _col(x).cast("string"), _col(y).cast("string"))


def legal_names(df: DataFrame) -> DataFrame:
    """Column names with every illegal character replaced by a dot-free mark."""
    import re

    def legal(name: str) -> str:
        name = re.sub(r"[^0-9A-Za-z_]", "_", name.strip())
        return f"X{name}" if not name or name[0].isdigit() else name

    return df.toDF(*[legal(c) for c in df.columns])
