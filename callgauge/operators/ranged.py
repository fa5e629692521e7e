"""A whole table cut into ranges of an order, with no count made before.

The cut points come from an even sample of the keys, which Spark takes while the query
runs: keys are dealt to a fixed number of bins by hash, and each bin keeps its key with the
least hash. A key's range depends on the key and the sample alone, so it is the same in
every branch of a plan and in every rerun of a task. Tables of any size take this way; a
small one gets a single range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges a table is cut into at most.
RANGES = 4096
#: Rows a range has at least, on average.
LEAST_ROWS = 1000
#: Sampled keys to a range.
SAMPLED = 8
#: A row finds its range among every 64th cut first, then among the 64 after it.
STEP = 64


def cut_points(rows: DataFrame, order: list[str], ranges: int = RANGES, least_rows: int = LEAST_ROWS) -> Column:
    """A scalar subquery: ``cuts``, ascending and distinct, and ``steps``, every STEP-th of them.

    A cut is the last key of its range. The sample holds SAMPLED * ranges keys at most.
    """
    bins, key = SAMPLED * ranges, F.struct(*order)
    keyed = rows.select(key.alias("key"), F.xxhash64(*order).alias("hash"))
    sample = keyed.groupBy(F.pmod("hash", F.lit(bins)).alias("bin")).agg(
        F.min(F.struct("hash", "key")).alias("first"), F.count("*").alias("rows")
    )
    keys = sample.agg(F.array_sort(F.collect_list("first.key")).alias("keys"), F.sum("rows").alias("rows"))
    share = F.greatest(F.lit(1 / ranges), F.lit(least_rows) / F.col("rows"))
    every = F.greatest(F.ceil(F.size("keys") * share), F.lit(1))
    cuts = keys.select(F.filter("keys", lambda _, i: (i + 1) % every == 0).alias("cuts"))
    steps = F.filter("cuts", lambda _, i: (i + 1) % STEP == 0)
    return cuts.select(F.struct("cuts", steps.alias("steps")).alias("found")).scalar()


def _before(key: Column, cuts: Column) -> Column:
    """How many of a few ascending cuts lie before a key. Lambdas can't hold a subquery, so the key is sorted in."""
    return F.array_position(F.sort_array(F.array_append(cuts, key)), key).cast("int") - 1


def range_of(order: list[str], found: Column) -> Column:
    """Number of the range that a row is in: how many cuts lie before it."""
    key = F.struct(*order)
    steps = _before(key, found["steps"]) * STEP
    return steps + _before(key, F.slice(found["cuts"], steps + 1, F.lit(STEP)))


def goes_on(group: str, number: str, found: Column) -> Column:
    """True if rows of this row's group may follow in the next range.

    ``group`` is the first column of the order. A border lies inside the group its cut
    belongs to, or after the last row of it.
    """
    return (F.col(number) < F.size(found["cuts"])) & F.get(found["cuts"], F.col(number))[group].eqNullSafe(F.col(group))
