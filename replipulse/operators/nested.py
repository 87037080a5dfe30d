"""Nested payloads: explode, flatten, and blanking of repeated keys."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replipulse.sources.store import kept

#: Hashes of repeated keys that are broadcast at most; of more, all rows are looked up.
BROADCAST_HASHES = 2_000_000


def explode_records(
    pages: DataFrame,
    payload: str = "payload",
    pos: str = "record_pos",
    record: str = "record",
    fields: Sequence[str] | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per record of a list column, with its position.

    Naming the ``fields`` to keep lets the scan read just these: Spark prunes a
    generator's output for one field only, a zip of field lists for any number.
    With ``keep_empty`` a NULL or empty list gives one row with a NULL record.
    """
    records = F.arrays_zip(*[f"{payload}.{f}" for f in fields]) if fields else F.col(payload)
    explode = F.posexplode_outer if keep_empty else F.posexplode
    kept = [c for c in pages.columns if c != payload]
    return pages.select(*kept, explode(records).alias(pos, record))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Turn struct columns, at any depth, into columns with joined names. Lists stay lists."""

    def leaves(column: Column, name: str, kind: T.DataType) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [column.alias(name)]
        return [
            leaf
            for field in kind.fields
            for leaf in leaves(
                column.getField(field.name), f"{name}{sep}{field.name}", field.dataType
            )
        ]

    return df.select(
        *[
            leaf
            for field in df.schema.fields
            for leaf in leaves(df[f"`{field.name}`"], field.name, field.dataType)
        ]
    )


def packed(columns: Sequence[str], digits: Sequence[int], last: Column | None = None) -> Column:
    """Whole numbers of so many digits as one, in the same order; ``last`` is one more digit.

    A number can be compared in the buffer of a hash aggregation, a struct cannot. Negative
    numbers and numbers with more digits are refused.
    """
    if sum(digits) + (last is not None) > 38:
        raise ValueError("more than 38 digits")
    total = F.lit(0).cast("decimal(38,0)")
    for name, size in zip(columns, digits):
        fits = F.col(name) >= 0
        if size < 19:
            fits = fits & (F.col(name) < 10**size)
        wrong = F.raise_error(F.lit(f"{name} is not a whole number of up to {size} digits"))
        value = F.when(fits, F.col(name)).otherwise(wrong.cast("bigint")).cast("decimal(19,0)")
        total = (total * F.lit(Decimal(10**size)) + value).cast("decimal(38,0)")
    if last is not None:
        total = (total * F.lit(Decimal(10)) + last.cast("decimal(1,0)")).cast("decimal(38,0)")
    return total


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Key columns equal their namesakes with a prefix; NULLs are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{k}") for k in keys]


def mark_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: str = "is_first",
) -> DataFrame:
    """Flag the first row of every key combination; NULL keys compare equal.

    ``order`` names whole numbers, not negative; rows that tie in all of them are first
    together. A window would sort all rows of one key in one task. Here hashes of the keys are
    counted first. Those that occur again are broadcast, if they are not very many, and rows of
    all other keys are first without a further look, where they are. Of the rows that are left,
    one hash aggregation, which combines before the shuffle, tells how often a key occurs and
    the smallest number that its first two order columns make; it is stored, so that Spark knows
    its size and may split a hot key in the joins. Of further order columns only those of rows
    that tie in the first two are compared, two at a time. ``df`` is read up to six times, and
    but for the last two only its keys and order columns, so it should be stored.
    """
    hashed = F.xxhash64(*keys)
    short = F.pmod(hashed, F.lit(2**31)).cast("int")
    again = df.groupBy(hashed.alias("_hash")).count().filter(F.col("count") > 1)
    again = kept(again.select(F.pmod("_hash", F.lit(2**31)).cast("int").alias("_again")).distinct(), "repeats")
    if again.count() > BROADCAST_HASHES:
        return _looked_up(df, keys, order, flag)
    listed = F.broadcast(again)
    once = df.join(listed, short == F.col("_again"), "left_anti").withColumn(flag, F.lit(True))
    rest = df.join(listed, short == F.col("_again"), "left_semi")
    return once.unionByName(_looked_up(rest, keys, order, flag))


def _looked_up(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """``mark_first`` by a lookup of every row."""
    pair = order[:2]
    placed = df.select(*keys, *order).withColumn("_place", packed(pair, [19] * len(pair)))
    least = placed.groupBy(*_renamed(keys, "_key_")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_least")
    )
    least = kept(least.filter(F.col("_rows") > 1).drop("_rows"), "first-places")
    if len(order) <= 2:
        found, place = least, packed(pair, [19] * len(pair))
        is_first = F.col("_least").isNull() | (F.col("_least") == place)
    else:
        tied = placed.join(least, _same(keys, "_key_")).filter("_place = _least")
        first = kept(tied.select(*keys, *order), "first-ties")
        for i in range(2, len(order), 2):
            pair = order[i : i + 2]
            placed = first.withColumn("_place", packed(pair, [19] * len(pair)))
            least = placed.groupBy(*_renamed(keys, "_key_")).agg(F.min("_place").alias("_least"))
            tied = placed.join(least, _same(keys, "_key_")).filter("_place = _least")
            first = tied.select(*keys, *order)
        found = first.select(*_renamed(keys, "_key_"), *_renamed(order, "_first_")).distinct()
        is_first = F.col(f"_first_{order[0]}").isNull() | _same(order, "_first_")
    extra = [c for c in found.columns if c not in df.columns]
    return df.join(found, _same(keys, "_key_"), "left").withColumn(flag, is_first).drop(*extra)


def blank_where(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """Empty the given text columns of the rows that match."""
    return df.withColumns({c: F.when(condition, F.lit("")).otherwise(F.col(c)) for c in columns})
