"""Queries of the operators on training order and form: curriculum, fill-in-middle, ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsentry.session import materialize

from . import curriculum, fill_in_middle, treap_search
from .common import query, read


@query(
    "op12_fill_in_middle",
    """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
c AS (
  SELECT doc_id, t, l, CAST(len(l) AS BIGINT) AS n,
         CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(l) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, t, n, form, array_to_string(l[1:least(a, b)], '') AS prefix, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(l[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""",
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, as digests; the frames are stored once and read again."""
    stored = materialize(fill_in_middle.store(read(spark, sf_dir, "documents")), "fim-frames")
    return fill_in_middle.with_digests(fill_in_middle.rearrange(fill_in_middle.with_cuts(stored)))


@query(
    "op11_mixing_sources",
    """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
f AS (
  SELECT *, 3 * source_size AS held, 3 * source_size / w AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
l AS (SELECT max(level) FILTER (ratio >= level) AS level FROM f),
t AS (
  SELECT source, source_size, CASE WHEN l.level * w > held THEN CAST(held AS DOUBLE) ELSE l.level * w END AS target FROM f, l),
e AS (SELECT least(1.0, min(CASE WHEN source_size > target THEN target / (source_size - target) END)) AS e FROM t),
r AS (SELECT *, target + e * (source_size - target) AS r0, target - e * (source_size - target) AS r1 FROM t, e),
q AS (
  SELECT doc_id, d.source, size, sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d),
k AS (
  SELECT doc_id, size, source_size, target, before, CAST(round(target) AS BIGINT) AS goal, r0, r1, before * ((r0 + r1) / 2 / target) AS y
  FROM q JOIN r ON q.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - before - source_size)) + greatest(0, least(size, goal - before - 2 * source_size)) AS BIGINT) AS taken,
       CASE WHEN size = 0 OR before >= goal THEN NULL WHEN y > 0 THEN 2 * y / (r0 + sqrt(greatest(0.0, r0 * r0 + 2 * (r1 - r0) * y))) ELSE 0.0 END AS position
FROM k
""",
)
def op11_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's target, the words taken of it and its first place in training time."""
    return curriculum.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


@query(
    "op13_ranked_search",
    """
WITH x AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
d AS (SELECT doc_id, r, CAST(len(words) AS BIGINT) AS n, words FROM x WHERE len(words) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
s AS (
  SELECT item_id, d.doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN i USING (term) JOIN d USING (r), c GROUP BY item_id, d.doc_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return treap_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
