"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Every source has a weight at some knots of it,
linear between them. The integral of a source's weights up to a time, scaled
so that the whole of it is the source's target, is the number of its words that
training has asked for by then. A source is a queue of documents in an order
drawn by hash; where a document begins in words, counted over repeated passes
of the queue, the demand is inverted (a quadratic within one segment) and gives
the time at which the document is due. Documents are range-sorted by it.

Nothing here moves texts: sizes are written once, running totals form per
(source, range of the hash), so that a source with a third of all documents is
many groups, and sources meet documents in a join on the source.

Targets share the words of the corpus by weight. A source has at most
``max_repeats`` times its own words; what is above that goes to the others by
weight, in rounds of one aggregate over the sources, until none is above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsentry.functions.scale import broadcast_small, row_numbers, running_totals
from docsentry.session import materialize, wide_partitions

from .common import set_columns

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
RESULTS = ("source", "size", "source_size", "target", "taken", "position", "places")
#: Documents of one group of running totals over all sources, and groups at most: they are summed per source.
GROUP_ROWS = 4096
MAX_GROUPS = 1 << 16


def measured(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``_kept`` (a struct of the columns ``keep``), source, size (words of the whole text, 0 for null), ``_order`` (hash of doc_id, which orders a queue)."""
    own = {
        "_kept": F.struct(F.lit(True).alias("_row"), *[F.col(f"`{c}`") for c in keep if c not in RESULTS]),
        "source": F.col("source").cast("string"),
        "size": F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"),
        "_order": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
    }
    return set_columns(docs, own, [])


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cycled_weights(sources: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """``sources`` with ``weight``: the given ones in turn, sources taken by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(wide_partitions(sources.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    numbered = row_numbers(materialize(ranged, "mix-sources"), [], F.col("_range"), order, "_number").drop("_range")
    turns = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    return set_columns(numbered, {"weight": F.element_at(turns, ((F.col("_number") - 1) % len(weights) + 1).cast("int"))}).drop("_number")


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``, the words to take; targets add up to all sizes.

    Weights are integers, not negative; one of them must be positive where
    there are words. The loop ends because a source that has reached its limit
    stays there.
    """
    sources = materialize(sources, "mix-weights")
    total, weight_sum = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    limit = F.lit(max_repeats) * F.col("source_size")
    level, at_limit = total / weight_sum if weight_sum else 0.0, 0
    while True:
        above = F.lit(level) * F.col("weight") > limit
        rows, held, left = sources.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if rows == at_limit or not left:
            break
        level, at_limit = (total - held) / left, rows
    above = F.lit(level) * F.col("weight") > limit
    return set_columns(sources, {"target": F.when(above, limit.cast("double")).otherwise(F.lit(level) * F.col("weight"))})


def with_schedule(sources: DataFrame, knots: Sequence[tuple[float, Column]]) -> DataFrame:
    """``sources`` with the weight schedule of each: times, rates at them and the rates' integral up to each time.

    ``knots`` are (time, weight expression) from time 0 to time 1, in order. A
    source whose weights are all zero is spread evenly.
    """
    times = [float(t) for t, _ in knots]
    if len(times) < 2 or times[0] != 0.0 or times[-1] != 1.0 or any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("knots must rise from time 0 to time 1")
    rates = [F.coalesce(rate.cast("double"), F.lit(0.0)) for _, rate in knots]
    flat = sum(rates[1:], rates[0]) <= 0
    own = F.array(*[F.when(flat, 1.0).otherwise(r) for r in rates])
    staged = set_columns(sources, {"times": F.array(*map(F.lit, times)), "rates": own})
    sums = [F.lit(0.0)]
    for i in range(1, len(times)):
        sums.append(sums[-1] + (F.col("rates")[i - 1] + F.col("rates")[i]) / 2 * (times[i] - times[i - 1]))
    return set_columns(staged, {"integrals": F.array(*sums)})


def tilted(sources: DataFrame) -> DataFrame:
    """``sources`` with a linear schedule whose mean is the target.

    Training begins as near to the corpus's own proportions as it can while no
    rate turns negative by the end, and goes on to as much beyond the target.
    """
    own, goal = F.col("source_size").cast("double"), F.col("target")
    (reach,) = sources.agg(F.least(F.lit(1.0), F.min(F.when(own > goal, F.try_divide(goal, own - goal))))).first()
    reach = F.lit(1.0 if reach is None else reach)
    return with_schedule(sources, [(0.0, goal + reach * (own - goal)), (1.0, goal - reach * (own - goal))])


def due(words: Column) -> Column:
    """The time at which training has asked for ``words`` of a source: its demand inverted."""
    times, rates, integrals = F.col("times"), F.col("rates"), F.col("integrals")
    asked = words * F.try_divide(F.element_at(integrals, -1), F.col("target"))

    def within(i: Column) -> Column:
        rate, after = F.element_at(rates, i), F.element_at(rates, i + 1)
        length = F.element_at(times, i + 1) - F.element_at(times, i)
        rest = asked - F.element_at(integrals, i)
        root = F.sqrt(F.greatest(F.lit(0.0), rate * rate + 2 * (after - rate) * rest / length))
        return F.element_at(times, i) + F.when(rest > 0, F.coalesce(F.try_divide(2 * rest, rate + root), length)).otherwise(0.0)

    passed = F.size(F.filter(integrals, lambda x: x <= asked))
    return within(F.least(F.greatest(passed, F.lit(1)), F.size(integrals) - 1))


def plan(sized: DataFrame, scheduled: DataFrame, max_repeats: int = MAX_REPEATS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``sized`` documents with source_size, target, taken and places: array of (position, words) in time.

    Passes of a queue follow one another, so the repeats of a document lie as
    far apart as its source allows. Where a source's target ends within a
    document, that pass takes only its first words. Empty documents have no
    place. Rows of one doc_id follow each other by size.
    """
    groups = min(MAX_GROUPS, max(1, -(-sized.count() // group_rows)))
    part = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * groups / F.lit(1 << 32))
    queued = running_totals(sized, ["source"], part, [F.col("_order"), F.col("size")], {"_upto": F.col("size")})
    own = scheduled.select(F.col("source").alias("_source"), "source_size", "target", "times", "rates", "integrals")
    joined = queued.join(broadcast_small(own), F.col("source").eqNullSafe(F.col("_source")))

    def place(turn: Column) -> Column:
        begins = turn * F.col("source_size") + F.col("_upto") - F.col("size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - begins))
        return F.struct(due(begins).alias("position"), words.alias("words"))

    places = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long")), place), lambda p: p["words"] > 0)
    staged = joined.withColumn("places", places)
    return set_columns(staged, {"taken": F.aggregate("places", F.lit(0).cast("long"), lambda sum_, p: sum_ + p["words"])}).drop(
        "_source", "_upto", "times", "rates", "integrals"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame = (5, 2, 1),
    knots: Sequence[tuple[float, Column]] | None = None,
    max_repeats: int = MAX_REPEATS,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Documents range-sorted by the time of their first place: ``keep``, source, size, source_size, target, taken, position, places.

    ``docs`` needs doc_id, text and source. ``weights`` are taken in turn by
    source, or a table (source, weight); a source it lacks weighs 0. ``knots``
    default to a linear schedule about the target. Documents without a place
    come last, with a null position. Null texts have size 0, a null source is a
    source, repeated rows are documents of their own. Extra columns are read
    only if kept; one with the name of a result gives way to it.
    """
    sized = materialize(measured(docs, keep), "mix-sizes")
    sources = source_sizes(sized)
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight"))
    else:
        sources = cycled_weights(sources, weights)
    wanted = materialize(targets(sources, max_repeats), "mix-targets")
    scheduled = tilted(wanted) if knots is None else with_schedule(wanted, knots)
    planned = plan(sized, materialize(scheduled, "mix-schedules"), max_repeats)
    first = set_columns(planned, {"position": F.get("places", F.lit(0))["position"]})
    written = materialize(first, "mix-plan")  # the range sort samples its input before it sorts it
    ordered = written.orderBy(F.col("position").asc_nulls_last(), "_order")
    return ordered.select(*[F.col("_kept").getField(c).alias(c) for c in keep if c not in RESULTS], *RESULTS)


def occurrences(mixed: DataFrame) -> DataFrame:
    """One row per place of a document, range-sorted by its time: the order in which training reads."""
    rest = [c for c in mixed.columns if c not in ("places", "position", "taken")]
    return mixed.select(*rest, F.inline("places")).orderBy("position", "source")
