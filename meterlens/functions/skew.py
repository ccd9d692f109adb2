"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes without being helped.
ROWS_PER_SALT = 1 << 20
#: Stored bytes below which no key can be too much for a task.
SMALL_INPUT = 64 << 20


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right-hand key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def attach(fact: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """`join_null_safe` in which only the lookup can be broadcast.

    Spark may broadcast either side of an inner join. A stored fact table that compresses well looks small until it is
    read, so an inner join is a semi join and a left join here: both can build on the lookup only.
    """
    if how == "inner":
        fact = join_null_safe(fact, lookup.select(*keys), keys, "left_semi")
    return join_null_safe(fact, lookup, keys, "left" if how == "inner" else how)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as Spark knows them without reading."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def hot_keys(fact: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(keys, _salts): the keys with more than `rows_per_salt` rows, each with the number of parts that its rows need.

    Counts are summed in the tasks first, so a hot key is one row a task. At most four times as many keys are kept as
    there are shuffle partitions, the hottest: one beyond these holds less than a quarter of a partition's share.
    """
    tasks = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = fact.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_salt)
    salts = F.least(F.lit(tasks), F.ceil(F.col("_n") / rows_per_salt)).cast("int")
    return counts.orderBy(F.col("_n").desc()).limit(4 * tasks).select(*keys, salts.alias("_salts"))


def salted_lookup(
    fact: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
    small_input: int = SMALL_INPUT,
) -> DataFrame:
    """Attach a one-row-per-key table to a fact table whose keys may be heavily skewed; NULL keys match each other.

    The rows of a hot key are dealt to as many salts as its share asks for, by a hash of their content, and its lookup row
    is repeated once per salt; nothing else is copied. The hot keys reach the rows by a broadcast of a few rows per
    shuffle partition at most. Spark still broadcasts the lookup instead when its measured size allows, the facts never.
    """
    if stored_bytes(fact) <= small_input:
        return attach(fact, lookup, keys, how)
    hot = F.broadcast(hot_keys(fact, keys, rows_per_salt))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*fact.columns), F.col("_salts")).cast("int"))
    spread = join_null_safe(fact, hot, keys).withColumn("_salt", salt).drop("_salts")
    parts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = join_null_safe(lookup, hot, keys).withColumn("_salt", F.explode(parts)).drop("_salts")
    return attach(spread, repeated, [*keys, "_salt"], how).drop("_salt")
