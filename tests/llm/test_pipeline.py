"""The pipeline's stages against brute force, and the registered queries."""

import pytest

import corpus_pipeline
from docsentry.llm import catalogue
from docsentry.llm.text_queries import BYTE_BPE
from tests.llm.test_texts import brute_components, packed_rightly, word_sets
from tests.oracle_check import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COPY = "these words stand in both texts and make them copies of each other " * 3
ROWS = [
    (1, "ordinary words of one text", "en", "a", 26),
    (2, "12345 !!", "en", "a", 8),
    (3, None, None, None, None),
    (4, COPY, "en", "b", 1),
    (5, COPY + "end", "de", "b", 1),
    (5, COPY + "end", "de", "b", 1),
    (6, 'mein token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" hier', "de", "c", 1),
    (None, "a row without id", "en", None, 3),
    (7, "doppelte zeile mit gleicher nummer", "de", "c", 3),
    (7, "doppelte zeile mit gleicher nummer", "de", "c", 3),
]


def test_stages(spark, sf):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    results = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "stage")
        results.append(docs)
        if number < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [sorted(str(r["doc_id"]) for r in d.collect()) for d in results[:3]]
    assert ids[0] == ["1", "4", "5", "5", "6", "7", "7", "None"]
    assert ids[1] == ids[2] == ["1", "4", "6", "7", "None"]
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in results[2].collect()}
    assert texts[1] == (ROWS[0][1], 26) and texts[6] == ('mein [SECRET]" hier', 19)
    assert {r["doc_id"] for r in results[3].collect()} == {1, 4, 6, 7, None}


def test_no_documents(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_run_over_the_table(spark, sf):
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    classes = brute_components(word_sets([r["text"] for r in rows]))
    kept = [r for i, r in enumerate(rows) if classes[i] == i and any(c.isalpha() for c in r["text"])]
    from docsentry.llm.secrets_scan import redact

    clean = {r["doc_id"]: r["text"] for r in redact(spark.createDataFrame(kept)).collect()}
    library = Tokenizer.from_file(BYTE_BPE)
    expected = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in clean.items()}
    packed_rightly(corpus_pipeline.run(spark, sf).collect(), expected, 2048)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    status, _, _, detail = compare(spark, duck(sf), sf, name, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert status == "ok", detail


COLUMNS = {
    "op1_sharding": "doc_id slot shard_id",
    "op2_nearest_neighbours": "query_id rank vec_id score",
    "op3_sentencepiece": "doc_id n_tokens ids_sha256 parity round_trip",
    "op4_html_extraction": "page_id url text n_chars",
    "op5_exact_topk": "query_id rank vec_id score",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset source",
    "op7_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_ngram_jaccard": "doc_id n_shingles component_id",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_lm_scoring": "doc_id n_tokens log_prob mean_log_prob",
    "op11_mixing_sources": "doc_id size source_size target taken position",
    "op12_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13_ranked_search": "item_id rank doc_id score",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, sf, name):
    out = catalogue.QUERIES[name](spark, sf)
    assert out.columns == COLUMNS[name].split() and not out.isEmpty()


def test_all_are_registered():
    assert set(catalogue.QUERIES) == set(COLUMNS)
