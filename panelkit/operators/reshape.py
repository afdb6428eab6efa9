"""Long to wide and back."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.dictionary import position

#: Most categories of a one-hot column, whose names travel with the schema.
MAX_CATEGORIES = 10_000


def widen(
    df: DataFrame, keys: list[str], names: str, values: dict[str, str], kinds, how=F.max
) -> DataFrame:
    """One column per kind and measure, named ``<prefix>_<kind>``.

    ``values`` maps prefix to source column. All columns come from conditional
    aggregates of one ``groupBy``, so the reshape costs one shuffle. With the
    default ``max`` the keys and kind must identify a row; the query fails if they don't.
    """
    def cell(source: str, k) -> Column:
        value = how(F.when(F.col(names) == k, F.col(source)))
        if how is not F.max:
            return value
        return F.when(F.count_if(F.col(names) == k) > 1, F.raise_error(F.lit(f"several rows for {keys} and {k}"))).otherwise(value)

    cells = [cell(source, k).alias(f"{prefix}_{k}") for prefix, source in values.items() for k in kinds]
    return df.groupBy(*keys).agg(*cells)


def widen_sums(df: DataFrame, keys: list[str], names: str, value: str, prefix: str, kinds) -> DataFrame:
    """Widened sums: NULL for a kind without rows, else the sum of what is present."""

    def cell(k: str) -> Column:
        this = F.col(names) == k
        return F.when(F.count_if(this) > 0, F.coalesce(F.sum(F.when(this, F.col(value))), F.lit(0)))

    return df.groupBy(*keys).agg(*[cell(k).alias(f"{prefix}_{k}") for k in kinds])


def lengthen(
    df: DataFrame, keys: list[str], names: str, values: dict[str, str], kinds
) -> DataFrame:
    """The inverse of ``widen``: one row per kind."""
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias(names),
                *[F.col(f"{prefix}_{k}").alias(source) for prefix, source in values.items()],
            )
            for k in kinds
        ]
    )
    return df.select(*keys, F.inline(cells))


def name_value_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Named columns as (variable, value) rows."""
    return df.unpivot(keys, columns, "variable", "value")


def categories(df: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list[str]:
    """The values of a column in their order; more than ``most`` are an error. :mod:`dictionary` numbers any number of them."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found


def one_hot(df: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    """A sparse vector with a 1 at the place of the row's value.

    The last place stands for whatever is not in ``values``, NULL too. The names of
    the places are metadata of the vector column, in which files and models keep them.
    """
    if not values or len(set(values)) < len(values):
        raise ValueError("one-hot values must be given, each once")
    place = f"_{name}_place"
    spot = F.coalesce(position(column, values), F.lit(len(values))).cast("double")
    nominal = {"ml_attr": {"type": "nominal", "name": column, "vals": list(values)}}
    placed = df.withColumn(place, spot.alias(place, metadata=nominal))
    encoder = OneHotEncoder(inputCols=[place], outputCols=[name], handleInvalid="keep", dropLast=False)
    return encoder.fit(placed.limit(0)).transform(placed).drop(place)


def one_hot_values(df: DataFrame, name: str) -> list[str]:
    """The values that a one-hot column has places for, from its metadata."""
    attributes = df.schema[name].metadata["ml_attr"]["attrs"]["binary"]
    return [a["name"] for a in sorted(attributes, key=lambda a: a["idx"])][:-1]


def from_one_hot(df: DataFrame, name: str, column: str) -> DataFrame:
    """The value whose place a one-hot vector holds; NULL for one that had no place of its own."""
    values = F.array(*[F.lit(v) for v in one_hot_values(df, name)])
    place = F.unwrap_udt(name)["indices"][0]
    return df.withColumn(column, F.get(values, place))
