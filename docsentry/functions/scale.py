"""Ordered computations that keep working when one key owns a third of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. The helpers
here add a coarse, order-preserving bucket: work happens per (key, bucket) and
only one small row per bucket is combined per key.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of a distribution: enough for as many tasks, few enough for one window over their totals.
QUANTILE_BUCKETS = 256


def broadcast_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Broadcast hint for a configuration table, only after its size is checked; beyond the bound Spark joins as usual."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def running_totals(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], totals: dict[str, Column]
) -> DataFrame:
    """Adds inclusive running totals per ``keys`` in ``order``.

    ``bucket`` must never decrease along ``order``. Rows of one (key, bucket) are
    sorted together; the per-bucket sums are accumulated separately and joined
    back. Window, sums and join all partition by the same struct of key and
    bucket, so the large side is shuffled once, and null keys match themselves.
    """
    keys = list(keys)
    base = df.withColumn("_part", F.struct(*keys, bucket.alias("_bucket")))
    for name, value in totals.items():
        base = base.withColumn(f"_v_{name}", value)
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_l_{n}") for n in totals])
    sums = base.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
    outer = Window.partitionBy(*([F.col(f"_part.{k}") for k in keys] or [F.lit(0)])).orderBy("_part._bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("_part").alias("_base"), *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}") for n in totals])
    out = local.join(bases, F.col("_part") == F.col("_base"))
    for n in totals:
        out = out.withColumn(n, F.col(f"_l_{n}") + F.col(f"_b_{n}"))
    return out.drop("_part", "_base", *[f"_{p}_{n}" for p in "vlb" for n in totals])


def row_numbers(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """``row_number()`` per key in ``order`` without one task per key."""
    return running_totals(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def first_row(df: DataFrame, keys: Sequence[str], order: Column, latest: bool = False) -> DataFrame:
    """One whole row per key, first (or last) by ``order``; combines map side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, bucket: Column, picks: dict[str, tuple[str, float]]
) -> DataFrame:
    """Exact order statistics per key from value counts.

    Equal values collapse before the shuffle. Bucket totals (a small table) tell
    which bucket holds each wanted rank; only those buckets are then sorted, so
    neither a hot key nor a long tail reaches one task. ``picks`` maps an output
    column to ("linear", q) as in ``numpy.percentile`` or ("upper", 0.5) for element n//2.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_part", F.struct(*keys, bucket.alias("_bucket")))
    whole = Window.partitionBy(*([F.col(f"_part.{k}") for k in keys] or [F.lit(0)]))
    before = whole.orderBy("_part._bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("_part").agg(F.sum("_n").alias("_t"))
    placed = sums.select(
        F.col("_part").alias("_at"), "_t", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_below"), F.sum("_t").over(whole).alias("_total")
    )
    ranks = {}
    for name, (kind, q) in picks.items():
        if kind == "upper":
            low = F.floor(F.col("_total") * q)
            ranks[name] = (low, low, F.lit(0.0))
        else:
            position = (F.col("_total") - 1) * F.lit(q)
            ranks[name] = (F.floor(position), F.ceil(position), position - F.floor(position))
    needed = F.lit(False)
    for low, high, _ in ranks.values():
        for rank in (low, high):
            needed = needed | ((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_t")))
    chosen = counts.join(placed.where(needed), F.col("_part") == F.col("_at"))
    inner = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = chosen.withColumn("_cum", F.col("_below") + F.sum("_n").over(inner))
    aggs = []
    for name, (low, high, frac) in ranks.items():
        holds = lambda rank: (F.col("_cum") > rank) & (F.col("_cum") - F.col("_n") <= rank)
        lo, hi = (F.max(F.when(holds(r), F.col(value))) for r in (low, high))
        aggs.append((lo + (hi - lo) * F.max(frac)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def quantile_bucket(df: DataFrame, value: str, buckets: int = QUANTILE_BUCKETS) -> Column:
    """Number of the bucket of ``value``, from 0 to ``buckets`` - 1, rising with it; buckets hold about as many rows each.

    Boundaries are quantiles of a KLL sketch, which tasks build and merge, so
    they follow the values wherever these lie. Being a function of the value
    alone, a bucket has all rows of a value; null is in bucket 0. The sketch is
    one job, run here.
    """
    x = F.col(value).cast("double")
    usable = F.when(~F.isnan(x), x)
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    (cuts,) = df.agg(F.when(F.count(usable) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(usable), ranks)).alias("_cuts")).first()
    inner = sorted(set(cuts or []))

    def below(cuts: list[float]) -> Column:
        """Number of ``cuts`` up to the value, found by halving."""
        if not cuts:
            return F.lit(0)
        middle = len(cuts) // 2
        return F.when(x < cuts[middle], below(cuts[:middle])).otherwise(below(cuts[middle + 1 :]) + middle + 1)

    return F.coalesce(below(inner), F.lit(0))


def balanced(df: DataFrame, cost: Column, key: Sequence[Column], shares: int) -> DataFrame:
    """``df`` in ``shares`` partitions of about equal total ``cost``, with one shuffle of its rows.

    Rows fall into 64 hash buckets a share by ``key``. Only the buckets' costs,
    64 numbers a share, go to the driver; dearest first, each goes to the share
    that has least so far. A row that costs more than a share should has one
    nearly to itself. Null costs count as 0.
    """
    buckets = 64 * shares
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    held = df.groupBy(bucket.alias("_bucket")).agg(F.sum(F.coalesce(cost, F.lit(0)).cast("double")).alias("_cost")).collect()
    loads = [(0.0, share) for share in range(shares)]
    placed = [i % shares for i in range(buckets)]
    for row in sorted(held, key=lambda r: (-r["_cost"], r["_bucket"])):
        load, share = heapq.heappop(loads)
        placed[row["_bucket"]] = share
        heapq.heappush(loads, (load + row["_cost"], share))
    return df.repartitionById(shares, F.element_at(F.array(*map(F.lit, placed)), bucket + 1))


def with_halo(df: DataFrame, row_no: str, before: int, block_rows: int = 4096) -> DataFrame:
    """Splits numbered rows into blocks; each block also gets the ``before`` rows preceding it.

    Adds ``_block`` and ``_home`` (false for copies): a window partitioned by
    (key, _block) then sees every frame it needs, for keys of any size.
    """
    block = F.floor((F.col(row_no) - 1) / block_rows)
    near_end = (F.col(row_no) - 1) % block_rows >= block_rows - before
    homes = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    out = df.withColumn("_blocks", homes).withColumn("_block", F.explode("_blocks"))
    return out.withColumn("_home", F.col("_block") == F.element_at("_blocks", 1)).drop("_blocks")
