"""Operators on texts against brute force."""

import re
import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsentry.llm import byte_bpe, jaccard_join, language_id, packing, shingles
from docsentry.llm import pseudo_likelihood as LM
from docsentry.llm import sentencepiece_codec as SP
from docsentry.llm.components import components
from docsentry.llm.text_queries import BYTE_BPE, SENTENCEPIECE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, n_tokens int"
ODD_TEXTS = ["", " ", "\n\n", "a", "x" * 5000, "a  b \t c\n d", "I'll it's 12_3 ² ½ <|endoftext|> z", "中文 été 🙂", "▁x ▁", "\x00a\x85b\xa0c", "</s> <0x41> <unk>", "  lead", "trail  "]


def documents(spark, texts, sources=None):
    data = [(i, t, None, (sources[i] if sources else "s"), 0, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


# --- tokens ------------------------------------------------------------------------------------
def test_byte_ids_equal_the_library(real):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    coder = byte_bpe.encoder(BYTE_BPE)
    assert coder.quick is not None
    texts = real + ODD_TEXTS
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def packed_rightly(rows, docs, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for key, text in docs.items():
        ids = np.array(text, "<u4")
        at = 0
        for r in sorted(by_doc.pop(key), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return by_sequence


def test_packing_is_a_round_trip(spark, real):
    texts = real + ODD_TEXTS + [None]
    df = documents(spark, texts, [f"s{i % 7}" if i % 3 else None for i in range(len(texts))])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    docs = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    rows = packing.pack(df, BYTE_BPE, lane_tokens=40_000).collect()
    sequences = packed_rightly(rows, docs, 2048)
    total = sum(map(len, docs.values()))
    assert total > 0.95 * 2048 * len(sequences)
    assert packing.pack(df.limit(0), BYTE_BPE).count() == 0


def test_packing_holds_the_mixture():
    draw = random.Random(1)
    queues = [[(i * 100 + k, draw.randint(1, 3000)) for k in range(100)] for i in range(3)]
    shares = [sum(n for _, n in q) for q in queues]
    shares = [s / sum(shares) for s in shares]
    sent = np.zeros(3)
    windows = defaultdict(lambda: np.zeros(3))
    for doc, _, length, window, _ in packing.Lane(queues, shares, [0.0] * 3, 2048, 256).pieces():
        windows[window][doc // 100] += length
    for number in sorted(windows)[:-1]:
        sent += windows[number]
        assert sent.sum() == (number + 1) * 2048
        assert np.abs(sent - sent.sum() * np.array(shares)).max() < 2 * 2048


def test_packing_starts_from_carried_deficits():
    queues = [[(0, 4000)], [(1, 4000)]]
    first = next(packing.Lane(queues, [0.5, 0.5], [-5000.0, 5000.0], 2048, 256).pieces())
    assert first[0] == 1 and first[2] == 2048


# --- SentencePiece -----------------------------------------------------------------------------
def test_sentencepiece_parity_and_round_trip(spark, real):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE)
    texts = real[:60] + ODD_TEXTS + [None]
    df = documents(spark, texts)
    coded = SP.encode(df, SENTENCEPIECE)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert got == {i: None if t is None else library.encode(t) for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in SP.decode(coded, SENTENCEPIECE).collect()}
    assert back == {i: None if t is None else t.replace("▁", " ") for i, t in enumerate(texts)}
    digests = {r["doc_id"]: r for r in SP.encode_digest(df, SENTENCEPIECE).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert digests[i]["n_tokens"] == len(ids) and digests[i]["round_trip"]
    assert sum(not r["parity"] for r in digests.values()) <= 2
    assert SP.encode(df.limit(0), SENTENCEPIECE).count() == 0


def _message(*fields):
    """Protobuf bytes of (number, value) pairs: bytes, floats or small integers."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def test_unigram_models_are_rebuilt(tmp_path):
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁ab", -5.5, 1), ("ba", -6.0, 1), ("▁a", -4.2, 1), ("abab", -7.5, 1)]
    body = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    data = body + _message((2, _message((3, 1), (4, len(pieces)), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab", "abab ba", "  a   b ", "xé", "", "bababab aab"]
    for text, (ids, same, _) in zip(texts, SP.Codec(data).encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text) and same


# --- near copies -------------------------------------------------------------------------------
def word_sets(texts):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def brute_components(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 80 * len(sets[i] | sets[k]):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def made_texts():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    texts = list(base)
    for _ in range(60):  # near copies of one text, at several distances
        words = base[0].split()
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [base[1]] * 30 + [f"{passage} {' '.join(word() for _ in range(draw.randint(1, 40)))}" for _ in range(40)]
    chain = base[2].split()
    for _ in range(8):  # a chain whose ends do not link
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(" ".join(chain))
    return texts + ["", None, " \t", "One two", "one TWO", "one\x1ctwo", "five words make one shingle", "FIVE words make one shingle", "É a b c d", "é a b c d"]


def test_components_equal_brute_force(spark):
    texts = made_texts()
    df = documents(spark, texts)
    sets = word_sets(texts)
    got = {r["doc_id"]: r for r in jaccard_join.join(df).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(sets)
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_all_orders_keep_every_link():
    draw = np.random.default_rng(3)
    for _ in range(200):
        n = int(draw.integers(1, 60))
        a = draw.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[int(draw.integers(0, n // 4 + 1)) :], draw.integers(0, 1 << 62, int(draw.integers(0, 8))).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        assert jaccard_join.linked(a, b) == (100 * both >= 80 * (len(a) + len(b) - both))


def test_shingles_tell_order_and_length_apart():
    of = shingles.Shingler().of
    assert len(of("a b c d e")) == 1 and of("a b c d e") != of("e d c b a") and of("a b") != of("b a") and of("a") != of("a a")
    assert list(of("A B c d e f")) == list(of("a b  c\td e\nf")) and len(of("x " * 50)) == 1


def test_components_of_long_chains(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.range(500, 600).selectExpr("500L AS a", "id AS b"))
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 600), 500)}


# --- languages ---------------------------------------------------------------------------------
def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(docs, ~held_out)
    rows = language_id.predict(docs, model).join(docs.filter(held_out), "doc_id").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    model = language_id.Model([("en", "the", 10), ("en", "house", 3), ("de", "das", 9), ("de", "haus", 4)])
    texts = [None, "", "12 34 ² ½ !", "the house", "Das Haus", "hauses", "Ω"]
    out = language_id.predict(documents(spark, texts), model, keep=("doc_id", "ids"))
    assert out.columns == ["doc_id", "ids", "lang_pred", "score"]
    got = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert [got[i] for i in range(6)] == ["und", "und", "und", "en", "de", "de"] and got[6] in ("en", "de")
    nothing = language_id.train(documents(spark, texts), F.lit(True))
    assert not nothing.known and {r["lang_pred"] for r in language_id.predict(documents(spark, texts), nothing).collect()} == {"und"}


def test_known_words_come_before_grams():
    model = language_id.Model([("en", "gift", 100), ("de", "gift", 1), ("de", "giftig", 50)])
    en, de = model.languages.index("en"), model.languages.index("de")
    assert model.word_scores("gift")[en] > model.word_scores("gift")[de]
    assert model.word_scores("giftigen")[de] > model.word_scores("giftigen")[en]


def test_languages_equal_a_plain_recount(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    taught = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None]
    counts = Counter((r["lang"], w) for r in taught for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))
    totals = Counter()
    for (language, _), n in counts.items():
        totals[language] += n
    languages, vocabulary = sorted(totals), {w for _, w in counts}
    grams = {}
    for w in vocabulary:
        marked = f"<{w}>"
        for size in range(1, 6):
            for i in range(len(marked) - size + 1):
                row = grams.setdefault(marked[i : i + size], [0] * len(languages))
                for k, language in enumerate(languages):
                    row[k] += counts[language, w]
    grams = {g: row for g, row in grams.items() if len(g) == 1 or sum(row) >= 3}
    whole = {size: [sum(row[k] for g, row in grams.items() if len(g) == size) + 0.1 * sum(len(g) == size for g in grams) for k in range(len(languages))] for size in range(1, 6)}

    def word(w):
        if w in vocabulary:
            return [math.log((counts[x, w] + 0.1) / (totals[x] + 0.1 * len(vocabulary))) for x in languages]
        marked, at, parts, sums = f"<{w}>", 0, 0, [0.0] * len(languages)
        while at < len(marked):
            size = next((n for n in range(min(5, len(marked) - at), 0, -1) if marked[at : at + n] in grams), 0)
            if size:
                row = grams[marked[at : at + size]]
                sums, parts = [a + math.log((c + 0.1) / whole[size][k]) for k, (a, c) in enumerate(zip(sums, row))], parts + 1
            at += size or 1
        return [x / max(1, parts) for x in sums]

    model = language_id.train(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    extra = [(10_000 + i, t, None) for i, t in enumerate(["zzyzx unheardof wordlings", "qqqq Ωmega", "x" * 30_000, "1 2 3", None])]
    tested = docs.unionByName(spark.createDataFrame(extra, docs.schema)).union(docs.limit(3))
    got = language_id.predict(tested, model, keep=("doc_id", "text", "score")).collect()
    assert len(got) == len(rows) + 8 and list(got[0].asDict()) == ["doc_id", "text", "lang_pred", "score"]
    for r in got:
        found = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = [sum(x) for x in zip(*map(word, found))]
        best = max(range(len(languages)), key=lambda k: sums[k])
        assert r["lang_pred"] == languages[best] and r["score"] == pytest.approx(1 / sum(math.exp(x - sums[best]) for x in sums), rel=1e-6)


# --- pseudo-likelihood -------------------------------------------------------------------------
def test_training_beats_class_frequencies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocabulary = LM.build_vocabulary(docs)
    weights = LM.train(docs, vocabulary, rounds=2, stride=2)
    rows = LM.score(docs, vocabulary, weights).collect()
    assert len(rows) == docs.count()
    ids = [vocabulary.ids(r["text"]) for r in docs.collect()]
    classes = np.concatenate([vocabulary.class_of[i] for i in ids])
    share = np.bincount(classes, minlength=vocabulary.n_classes) / len(classes)
    frequency = sum(np.log(share[vocabulary.class_of[i]]).sum() + vocabulary.log_within[i].sum() for i in ids)
    assert sum(r["log_prob"] for r in rows) > frequency


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    net = LM.Network(6)
    net.out[:] = rng.normal(0, 0.3, net.out.shape)
    window, target = rng.integers(0, 50, (30, 2 * LM.SIDE)), rng.integers(0, 6, 30)

    def loss(n):
        return -n.forward(window, n.tables())[1][np.arange(30), target].mean()

    before = net.vector.copy()
    moved = LM.Network(6, before.copy())
    moved.step(window, target, 1e-3)
    gradient = (before - moved.vector) / 1e-3
    places = np.argsort(-np.abs(gradient))[:12]
    for place in places:
        up, down = before.astype(float).copy(), before.astype(float).copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        assert abs((loss(LM.Network(6, up)) - loss(LM.Network(6, down))) / 2e-2 - gradient[place]) < 0.05 * abs(gradient[place]) + 2e-4


def test_scores_of_odd_texts(spark):
    df = documents(spark, [None, "", "a b c", "a b c", "x " * 40000])
    vocabulary = LM.build_vocabulary(df)
    got = {r["doc_id"]: r for r in LM.score(df, vocabulary, LM.train(df, vocabulary)).collect()}
    assert [got[i]["n_tokens"] for i in range(5)] == [0, 0, 3, 3, 40000]
    assert got[0]["log_prob"] == 0 and got[1]["mean_log_prob"] is None and got[2]["log_prob"] == pytest.approx(got[3]["log_prob"])
    assert math.isfinite(got[4]["log_prob"])
    empty = df.limit(0)
    nothing = LM.build_vocabulary(empty)
    assert LM.score(empty, nothing, LM.train(empty, nothing)).count() == 0


def test_registered_training_takes_every_position_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").union(documents(spark, ["a", "a b", "a b c", None, ""]).select("text"))
    vocabulary = LM.build_vocabulary(docs)
    shared = spark.sparkContext.broadcast(vocabulary)
    weights = spark.sparkContext.broadcast(LM.Network(vocabulary.n_classes).vector)
    turns = [LM._train_round(docs, shared, weights, turn, LM.STRIDE).where("part = 0").agg({"tokens": "sum"}).first()[0] for turn in range(LM.ROUNDS)]
    assert sum(turns) == sum(len(vocabulary.ids(r["text"])) for r in docs.collect())


def test_registered_training_beats_class_frequencies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocabulary = LM.build_vocabulary(docs)
    untrained = LM.Network(vocabulary.n_classes)
    untrained.out_bias[:] = np.log(vocabulary.class_share)
    total = lambda weights: LM.score(docs, vocabulary, weights).agg({"log_prob": "sum"}).first()[0]
    assert total(LM.train(docs, vocabulary)) > total(untrained.vector)


def test_registered_scoring_splits_texts_twice(spark):
    docs = documents(spark, ["a b. a", "b", "", None, "c a"])
    vocabulary = LM.build_vocabulary(docs)
    encoded = LM.encode(docs, vocabulary)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = encoded.collect()
    assert len(rows) == 5 and all(vocabulary.read(r["ids"]).tolist() == vocabulary.ids(texts[r["doc_id"]]).tolist() for r in rows)
    # scores and rounds read the ids, and no text any more
    without = docs.select("doc_id")
    weights = LM.train(without, vocabulary, encoded=encoded)
    got = {r["doc_id"]: r["n_tokens"] for r in LM.score(without, vocabulary, weights, encoded=encoded).collect()}
    assert got == {k: len(vocabulary.ids(t)) for k, t in texts.items()}
    assert LM.Vocabulary({str(i): i for i in range(1 << 16)}, None, None, 1, None).stored == "<u4"


def test_places_are_scored_without_the_other_classes():
    rng = np.random.default_rng(3)
    net = LM.Network(6)
    window, target = rng.integers(0, 50, (30, 2 * LM.SIDE)), rng.integers(0, 6, 30)
    for size in (0.3, 500.0):  # the second would overflow without a shift
        net.out[:] = rng.normal(0, size, net.out.shape)
        logs = net.log_probs(window, target, net.tables())
        assert np.isfinite(logs).all()
        assert np.allclose(logs, net.forward(window, net.tables())[1][np.arange(30), target], atol=1e-4)
