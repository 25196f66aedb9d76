"""Small configuration tables as JVM-side literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def config_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A few fixed rows known to the optimizer, so joins see their exact size."""
    cell = lambda v: f"{v!r}D" if isinstance(v, float) else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v))
    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long by one generator: no copy of the row per column before pruning."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])
    return df.select(*keep, F.inline(pairs))


def pick(condition: Column, value: str) -> Column:
    """Aggregate: the value of the row that meets a condition."""
    return F.max(F.when(condition, F.col(value)))
