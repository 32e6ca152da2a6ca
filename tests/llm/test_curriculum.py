"""Curriculum mixing against plain Python."""

import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docsentry.llm import curriculum as C


def level_of(sizes, weights, most=3):
    """Targets by repeated sharing, in fractions."""
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in held]
        share = Fraction(total - sum(held.values())) / (sum(weights[s] for s in free) or 1)
        above = [s for s in free if share * weights[s] > most * sizes[s]]
        if not above:
            return {s: float(held.get(s, share * weights[s])) for s in sizes}
        held.update({s: most * sizes[s] for s in above})


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def sample(n=400):
    rng = random.Random(5)
    docs = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["b", "c", "é", "Z", None, "tiny"])
        words = 0 if i % 29 == 0 else rng.randint(1, 3 if source == "tiny" else 60)
        docs.append((i, " ".join(["w"] * words) if i % 58 else None, source, "x", 7))
    docs += [(None, "null id here", "b", "x", 7), (5, "again", "big", "x", 7), (5, "again", "big", "x", 7), (5, "again but longer", "big", "x", 7)]
    docs.append((1000, "long word and " * 70_000, "c", "x", 7))
    return docs


SCHEMA = "doc_id long, text string, source string, target string, size int"


def test_targets_places_and_order(spark):
    data = sample()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = C.mix(df, keep=["doc_id", "target", "size"]).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source, _, _ in data:
        sizes[source] = sizes.get(source, 0) + count(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = level_of(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert abs(sum(wanted.values()) - sum(sizes.values())) < 1e-6 and any(wanted[s] == 3 * sizes[s] for s in sizes)
    for r in got:
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == sum(p["words"] for p in r["places"]) <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
    for s in sizes:
        assert sum(r["taken"] for r in got if r["source"] == s) == int(wanted[s] + 0.5)
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and [r["position"] for r in got][len(positions) :] == [None] * (len(got) - len(positions))


def test_positions_invert_the_demand(spark):
    data = sample()
    got = C.mix(spark.createDataFrame(data, SCHEMA)).collect()
    queues = {}
    for r in got:
        queues.setdefault(r["source"], []).append(r)
    goals = {s: (rows[0]["target"], rows[0]["source_size"]) for s, rows in queues.items()}
    reach = min([1.0] + [t / (n - t) for t, n in goals.values() if n > t])
    for s, rows in queues.items():
        target, own = goals[s]
        first, last = target + reach * (own - target), target - reach * (own - target)
        key = lambda r: (hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), r["size"])
        at = 0
        for r in sorted(rows, key=key):
            for turn, place in enumerate(r["places"]):
                t = place["position"]
                asked = first * t + (last - first) * t * t / 2  # words of the source wanted by then
                assert asked == pytest.approx(turn * own + at, abs=1e-3 * target + 1e-6) and -1e-9 <= t <= 1 + 1e-6
            at += r["size"]


def test_given_knots_and_weights(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', array_repeat('w', 10)) AS text", "IF(id % 2 = 0, 'early', 'late') AS source")
    weights = spark.createDataFrame([("early", 1), ("late", 1)], "source string, weight int")
    early = F.col("source") == "early"
    knots = [(0.0, F.when(early, 1.0).otherwise(0.0)), (0.25, F.when(early, 1.0).otherwise(0.0)), (0.5, F.lit(0.5)), (1.0, F.when(early, 0.0).otherwise(1.0))]
    got = C.mix(docs, weights, knots).collect()
    begins = {s: [r["position"] for r in got if r["source"] == s] for s in ("early", "late")}
    assert begins["early"][0] == 0.0 and begins["late"][0] == pytest.approx(0.25)
    rate = {"early": [(0, 0.25, 1, 1), (0.25, 0.5, 1, 0.5), (0.5, 1, 0.5, 0)], "late": [(0, 0.25, 0, 0), (0.25, 0.5, 0, 0.5), (0.5, 1, 0.5, 1)]}
    for s, parts in rate.items():
        whole = sum((b - a) * (x + y) / 2 for a, b, x, y in parts)
        for i, t in enumerate(begins[s]):
            upto = sum((min(t, b) - a) * (x + (x + (y - x) * (min(t, b) - a) / (b - a))) / 2 for a, b, x, y in parts if t > a)
            assert upto / whole == pytest.approx(i / 300, abs=1e-9)


def test_layout_does_not_matter_and_groups_join_up(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    plain = sorted(map(str, C.mix(df).drop("places").collect()))
    assert plain == sorted(map(str, C.mix(df.repartition(7, "doc_id")).drop("places").collect()))
    sized = C.measured(df)
    scheduled = C.tilted(C.targets(C.cycled_weights(C.source_sizes(sized))))
    many = C.plan(sized, scheduled, group_rows=9)
    columns = ["doc_id", "size", "source", "taken", "target"]
    assert sorted(map(str, many.select("_kept.doc_id", *columns[1:]).collect())) == sorted(map(str, C.mix(df).select(*columns).collect()))


def test_occurrences_are_in_time(spark):
    rows = C.occurrences(C.mix(spark.createDataFrame(sample(), SCHEMA))).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and min(r["words"] for r in rows) > 0


def test_empty_tables_and_wordless_corpora(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    assert C.mix(df.limit(0)).count() == 0
    blank = C.mix(df.withColumn("text", F.lit(" \n"))).collect()
    assert len(blank) == len(sample()) and all(r["taken"] == 0 and r["target"] == 0 and r["position"] is None for r in blank)


def test_bad_knots_are_refused(spark):
    sources = spark.createDataFrame([("a", 3, 1)], "source string, source_size long, weight long")
    for times in ((0.0,), (0.0, 0.5), (0.1, 1.0), (0.0, 0.5, 0.5, 1.0)):
        with pytest.raises(ValueError, match="knots"):
            C.with_schedule(sources, [(t, F.lit(1)) for t in times])
