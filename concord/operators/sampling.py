"""Random rows: a sample of the source's first key restricts both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.types import family
from concord.operators.kept import kept
from concord.plans.frames import SOURCE, actual, filtered
from concord.plans.spec import ValidationSpec

#: Largest sample that is broadcast.
BROADCAST_ROWS = 100_000


def sample_keys(df: DataFrame, columns: list[str], rows: int, seed: int | None = None, order: bool = True) -> DataFrame:
    """Keys of ``rows`` random rows; only the first of each task's order meet at the end.

    Without ``order`` they are any rows, as few as the scan needs to read: for engines
    whose own samples are random, or where sorting all rows costs too much.
    """
    if not order:
        return df.select(*[F.col(f"`{actual(df, c)}`") for c in columns]).limit(rows)
    return df.select(*[F.col(f"`{actual(df, c)}`") for c in columns]).orderBy(F.rand(seed)).limit(rows)


def in_sample(df: DataFrame, name: str, keys: DataFrame, rows: int) -> DataFrame:
    """Rows whose key is in the sample, whose column is ``key``."""
    side = F.broadcast(keys) if rows <= BROADCAST_ROWS else keys
    name = actual(df, name)
    same = F.col(f"l.`{name}`") == F.col("r.key")
    return df.alias("l").join(side.alias("r"), same, "left_semi")


def random_rows(source: DataFrame, target: DataFrame, spec: ValidationSpec, seed: int | None = None, order: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows for a sample of the source's first key, of rows that pass its filters; an empty sample restricts nothing."""
    key, n = spec.primary_keys[0], spec.random_row_batch_size
    keys = kept(sample_keys(filtered(source, spec.filters, SOURCE), [key.source], n, seed, order).toDF("key"))  # one sample for both sides
    if keys.isEmpty():
        return source, target
    if spec.trim_string_pks and family(keys.schema["key"].dataType) == "string":
        keys = keys.select(F.regexp_replace("key", r"\s+$", "").alias("key"))
        return in_trimmed(source, key.source, keys, n), in_trimmed(target, key.target, keys, n)
    return in_sample(source, key.source, keys, n), in_sample(target, key.target, keys, n)


def in_trimmed(df: DataFrame, name: str, keys: DataFrame, rows: int) -> DataFrame:
    """As in_sample, with the key's trailing blanks passed over."""
    side = F.broadcast(keys.distinct()) if rows <= BROADCAST_ROWS else keys.distinct()
    same = F.regexp_replace(F.col(f"l.`{actual(df, name)}`"), r"\s+$", "") == F.col("r.key")
    return df.alias("l").join(side.alias("r"), same, "left_semi")

