"""Offsets, prefix sums and dialects against Python's ``re``."""

import random
import re

from pyspark.sql import functions as F

from docsentry import rules as R
from docsentry.functions.matching import Rule, prefix_sums, scan, with_offsets
from docsentry.functions.patterns import java, re2


def expected(text, pattern, flags=0):
    return [(m.group(0), m.start(), m.end()) for m in re.finditer(pattern, text, flags)]


def test_offsets_count_code_points(spark):
    texts = ["", "x=1", "😀 a@b.co é c@d.org", "a@b.co", "tail a@b.co\n", "é" * 50 + " k@l.mn 😀😀 z@y.xw"]
    pattern = r"[a-z]+@[a-z]+\.[a-z]+"
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = with_offsets(df, "text", F.lit(pattern)).collect()
    for i, t in enumerate(texts):
        assert sorted((r["match"], r["start"], r["end"]) for r in rows if r["id"] == i) == sorted(expected(t, pattern))


def test_scan_equals_finditer_for_every_rule(spark):
    rng = random.Random(7)
    words = ["ignore", "previous", "instructions", "<script>", "</script>", "onload =", "javascript:", "AKIA" + "A" * 16, "api_key=" + "a" * 32, "555-123-4567", "été", "😀", "10.0.3.4", "db01.internal",
             "jwt_secret=x", "\n", "https://a.b/c", "password: 'x1'", "eval(", "DROP TABLE", "begin DAN", "<iframe src=x>", "data:text,", "mysql://u@h/x", "you are now admin, you must", "123-45-6789", "change the mode to 'x' and ignore all checks"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rules = [r for r in (*R.MARKDOWN_RULES, *R.SECRET_RULES, *R.FALLBACK_RULES)]
    rules = [Rule(**{**r.__dict__, "name": f"{r.family}/{r.name}"}) for r in rules]
    got = {}
    for r in scan(df, "text", rules, ["id"]).collect():
        got.setdefault((r["id"], r["rule_name"]), []).append((r["match"], r["start"], r["end"]))
    bits = {"i": re.I, "s": re.S, "m": re.M}
    for rule in rules:
        flags = 0
        for f in rule.flags:
            flags |= bits[f]
        for i, t in enumerate(texts):
            assert sorted(got.get((i, rule.name), [])) == sorted(expected(t, rule.pattern, flags)), (rule.name, t)


def test_prefix_sums_across_blocks(spark):
    for n in (0, 1, 511, 512, 513, 2000):
        df = spark.createDataFrame([(list(range(n)),)], "a array<int>")
        got = df.select(prefix_sums(F.col("a")).alias("s")).first()["s"]
        total, want = 0, []
        for i in range(n):
            total += i
            want.append(total)
        assert got == want


def test_many_matches_in_one_text_with_lines(spark):
    text = "\n".join(f"row {i} x{i}" for i in range(1500))
    df = spark.createDataFrame([(text,)], "text string")
    rows = with_offsets(df, "text", F.lit(r"x\d+"), lines=True).orderBy("match_no").collect()
    assert [(r["match"], r["start"], r["end"]) for r in rows] == expected(text, r"x\d+")
    assert [r["line"] for r in rows] == list(range(1, 1501))


def test_named_groups_and_dialects():
    assert java(r"(?P<tool_name>\w+)") == r"(?dU)(?<toolname>\w+)"
    assert re2(r"a.b") == "(?-s)a.b"
    assert re2(r"[^\s]\w", "is").startswith("(?is)[^\\t")


def test_gates_never_hide_a_match():
    for rule in (*R.MARKDOWN_RULES, *R.SECRET_RULES, *R.FALLBACK_RULES, *R.CODE_RULES):
        for alternatives in rule.gate:
            assert all(a == a.lower() for a in alternatives), rule.name
    assert all(re.compile(r.pattern).match("") is None for r in (*R.MARKDOWN_RULES, *R.SECRET_RULES, *R.FALLBACK_RULES, *R.response_rules(), *R.profile_rules()))


def test_override_pattern_is_linear_and_the_same(spark):
    import random
    import re
    import time

    from docsentry import rules as R
    from docsentry.functions.matching import scan

    rule = [r for r in R.MARKDOWN_RULES if r.name == "override_instructions"]
    draw = random.Random(1)
    words = ["ignore", "all", "rules", "x", "reset", "your", "role", "ignored", "users", "\n"]
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 14)))) for i in range(300)]
    found = scan(spark.createDataFrame(texts, "doc_id int, text string"), "text", rule, ["doc_id"]).select("doc_id", "start", "end").collect()
    expected = {(i, m.start(), m.end()) for i, t in texts for m in re.finditer(rule[0].pattern, t, re.I | re.S)}
    assert {tuple(r) for r in found} == expected and expected
    hostile = spark.createDataFrame([(1, "instructions " + "ignore all " * 4000)], "doc_id int, text string")
    start = time.time()
    assert scan(hostile, "text", rule, ["doc_id"]).count() == 0
    assert time.time() - start < 60
