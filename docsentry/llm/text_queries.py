"""Queries of the operators on texts: packing, tokenizing, languages and scoring."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, language_id, packing, pseudo_likelihood, sentencepiece_codec
from .common import query, read

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
SENTENCEPIECE = f"{TOKENIZERS}/piece_bpe_32k.model"


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of 2048 tokens, each mixed like the corpus."""
    return packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE)


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids as a digest, with parity and round trip."""
    return sentencepiece_codec.encode_digest(read(spark, sf_dir, "documents"), SENTENCEPIECE)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learnt from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language_id.train(docs, ~held_out)
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pseudo-log-likelihood under a network trained on all of them."""
    docs = read(spark, sf_dir, "documents")
    vocabulary = pseudo_likelihood.build_vocabulary(docs)
    encoded = pseudo_likelihood.encode(docs, vocabulary)
    weights = pseudo_likelihood.train(docs, vocabulary, encoded=encoded)
    return pseudo_likelihood.score(docs, vocabulary, weights, encoded=encoded)


@query(
    "op8_ngram_jaccard",
    """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
""",
)
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under links of 0.8 Jaccard similarity of five-word shingles."""
    return jaccard_join.join(read(spark, sf_dir, "documents"))
