"""RE2 looks before Java's engine: never at the cost of a match."""

import random

from pyspark.sql import functions as F

from docsentry import rules as R
from docsentry.functions.linear import may_match, pattern_counts
from docsentry.functions.matching import scan
from docsentry.functions.patterns import java
from docsentry.operators import features as FE

PIECES = (
    *"# ,## ,\n,- item,> q, , ,|a|b|\n|--|\n,[a](b),```py\nx\n```,eval(,importX,import os,def f (,def ́e(,https://ab.cde.com/x,\\x41,password='x',PAſSWORD = 'x'".split(","),
    *"toKen:\"y\",APı key='z',<ſcript >,</SCRIPT>,1.2.3.4,١.2.3.4,select a from b,JOİN İNTO,'a' + 'b',system,́,é,漢,\U0001f600,_,ssn 123-45-6789,555 123 4567,٥٥٥-123-4567".split(","),
)


def odd_texts(n: int) -> list[tuple[int, str | None]]:
    chosen = random.Random(3)
    return [(i, "".join(chosen.choice(PIECES) for _ in range(chosen.randint(0, 12)))) for i in range(n)] + [(-1, None), (-2, "")]


def test_a_text_that_matches_passes_the_look(spark):
    docs = spark.createDataFrame(odd_texts(1500), "doc_id long, text string")
    patterns = [*FE.PATTERNS.values(), *[(r.pattern, r.flags) for r in (*R.SECRET_RULES, *R.MARKDOWN_RULES)]]
    wide = [(p, f, may) for p, f in patterns if (may := may_match(p, f))]
    assert all(FE._same_in_re2(n) for n, (p, f) in FE.PATTERNS.items() if may_match(p, f) is None)
    looked = docs.select("text", pattern_counts(F.col("text"), [may for _, _, may in wide], [False] * len(wide)).alias("may"))
    missed = [F.count_if((F.get("may", F.lit(i)) == 0) & F.col("text").rlike(java(p, f))).alias(str(i)) for i, (p, f, _) in enumerate(wide)]
    assert set(looked.select(*missed).first()) == {0}


def test_counts_by_re2_are_those_of_the_patterns(spark):
    docs = spark.createDataFrame(odd_texts(1500), "doc_id long, text string")
    found = FE.extract(docs, keep=("doc_id", "text"))
    counts = {**R.CODE_COUNTS, **R.MARKDOWN_COUNTS, **R.EVASION_COUNTS}
    wrong = [F.count_if(~F.col(n).eqNullSafe(F.regexp_count("text", F.lit(java(p, f))))).alias(n) for n, (p, f) in counts.items()]
    wrong += [F.count_if(~F.col(n).eqNullSafe(F.col("text").rlike(java(p, f)))).alias(n) for n, (p, f) in R.SECURITY_FLAGS.items()]
    joined = docs.join(found.drop("text"), "doc_id")
    assert {k: v for k, v in joined.select(*wrong).first().asDict().items() if v} == {}


def test_rules_are_looked_for_in_one_pass(spark, capsys):
    docs = spark.createDataFrame([(1, "mail a@b.org")], "doc_id long, text string")
    found = scan(docs, "text", R.SECRET_RULES, ["doc_id"])
    found.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert [r["match"] for r in found.collect()] == ["a@b.org"]


def test_patterns_that_re2_cannot_take_keep_their_gates():
    assert may_match(r"(?<!a)b") is None and may_match(r"(a)\1") is None and may_match("end$") is None
    assert r"\b" not in may_match(r"\b\d+") and r"\b" in may_match(r"\beval\b")
