"""First- and last-wins dedup by an explicit sequence, with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def _pick(df: DataFrame, keys: list[str], seq: list[str], how) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if len(seq) == 1:
        # one buffer for each column: hash aggregates, where the columns have fixed widths; all take the same row
        picked = df.groupBy(*keys).agg(*[how(c, seq[0]).alias(c) for c in rest])
        return picked.select(*df.columns)
    picked = df.groupBy(*keys).agg(how(F.struct(*rest), F.struct(*seq)).alias("__row"))
    return picked.select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def first_wins(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The row of each key that comes first in ``seq``."""
    return _pick(df, keys, seq, F.min_by)


def last_wins(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    return _pick(df, keys, seq, F.max_by)


def append_new(existing: DataFrame, rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key ``existing`` lacks, first-wins among themselves."""
    return first_wins(rows.join(existing.select(*keys), keys, "left_anti"), keys, seq)


def two_key_first_wins(df: DataFrame, first: str, second: str, seq: str) -> DataFrame:
    """Rows kept, in the order of ``seq`` (unique), unless an earlier kept row has the same ``first`` or the same ``second``.

    A rejected row reserves nothing. Where ``first`` is unique this is first-wins on ``second``. Else, in rounds, rows that
    come first for both keys are kept and rows that share a key with them go, until none is left.
    """
    if df.groupBy(first).count().where("count > 1").isEmpty():
        return first_wins(df, [second], [seq]).select(*df.columns)
    left, kept = staged(df, "two-keys"), []
    while not left.isEmpty():
        low = lambda c: F.min(seq).over(Window.partitionBy(c))
        lead = left.withColumn("__a", low(first)).withColumn("__b", low(second))
        found = staged(lead.where((F.col("__a") == F.col(seq)) & (F.col("__b") == F.col(seq))).select(*df.columns), "two-keys-kept")
        kept.append(found)
        rest = left.join(found.select(first), first, "left_anti").join(found.select(second), second, "left_anti")
        left = staged(rest.select(*df.columns), "two-keys")
    out = df.limit(0) if not kept else kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out
