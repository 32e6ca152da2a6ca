"""Fill-in-middle over compressed frames against plain strings."""

import hashlib
import random
import re

import pytest
import zstandard

from docsentry.llm import fill_in_middle as M

compress, decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def expected(key, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in M.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(3)
    made = [None, "", "\n", "\n\n", "a", "a\n", "no break at all " * 40, "é漢😀\n" * 50, "<<S", "x<P>y\nz", "a <\nP>\n<\n", "😀" * 300, "\r\n\r\n"]
    for _ in range(40):
        made.append("".join(rng.choice(["a", "é", "😀", "\n", " word", "<", ">"]) for _ in range(rng.randint(0, 400))))
    return made


@pytest.mark.parametrize("frame_bytes", [4, 17, 100, 1 << 16])
def test_frames_hold_the_text_and_find_every_unit(frame_bytes):
    for text in texts():
        data = (text or "").encode()
        frames, n, chars = M.to_frames(data, compress, frame_bytes)
        units = UNIT.findall(text or "")
        assert b"".join(decompress(f.data) for f in frames) == data and n == len(units) and chars == len(text or "")
        assert all(len(decompress(f.data)) <= frame_bytes for f in frames)
        stored = M.Text(frames, n, chars, decompress)
        for k in range(n + 1):
            place = stored.cut(k)
            before = b"".join(decompress(f.data) for f in frames[: place.frame]) + (stored.open(place.frame)[: place.byte] if place.byte else b"")
            assert before.decode() == "".join(units[:k]) and place.char == len(before.decode())


@pytest.mark.parametrize("frame_bytes", [4, 17, 1 << 16])
def test_output_and_rebuilt_text(frame_bytes):
    for text in texts():
        units = UNIT.findall(text or "")
        frames, n, chars = M.to_frames((text or "").encode(), compress, frame_bytes)
        if any(m in (text or "") for m in M.MARKERS):
            continue
        for form in ("psm", "spm", "plain"):
            for a in range(0, n + 1, max(1, n // 5)):
                for b in range(a, n + 1, max(1, n // 5)):
                    stored = M.Text(frames, n, chars, decompress)
                    out, p, m = M.rearranged(stored, form, a, b, compress)
                    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
                    whole = {"psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}", "plain": text or ""}[form]
                    assert b"".join(map(decompress, out)).decode() == whole
                    assert (p, m) == ((None, None) if form == "plain" else (len(prefix), len(middle)))
                    assert M.digests(out, form, decompress) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (whole, text or ""))
                    assert len(stored.opened) <= 2


def test_only_frames_of_the_cuts_are_opened_and_the_others_are_reused():
    text = "".join(f"line {i}\n" for i in range(5000))
    frames, n, chars = M.to_frames(text.encode(), compress, 512)
    stored = M.Text(frames, n, chars, decompress)
    out, _, _ = M.rearranged(stored, "psm", 1200, 3300, compress)
    assert len(stored.opened) == 2
    assert sum(f.data in set(out) for f in frames) >= len(frames) - 2


def test_table_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    data = [(i, t, f"o{i}", -i) for i, t in enumerate(texts())]
    data += [(None, "a\nb\nc\n", "null key", 0), (3, "again\nand\nagain\n", "repeated", 1), (3, "again\nand\nagain\n", "repeated", 1), (99, "long line " * 60_000 + "\n" + "s\n" * 90_000, "long", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, output string, frames int")
    stored = M.store(docs, keep=["doc_id", "text", "output", "frames"], frame_bytes=1000)
    made = M.rearrange(M.with_cuts(stored), keep=["doc_id", "text", "n", "output"])
    got = M.with_digests(made).collect()
    full = M.with_text(made).collect()
    assert len(got) == len(data) == len(full)
    for r in got:
        n, form, p, m, whole = expected(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert all(r["output"] == expected(r["doc_id"], r["text"])[4] for r in full)
    empty = M.with_digests(M.rearrange(M.with_cuts(M.store(docs.limit(0)))))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_rates(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a\\nb\\n', id) AS text")
    forms = [r["form"] for r in M.with_cuts(M.store(docs), seed=1, rate=50, spm_rate=20).collect()]
    assert forms == [expected(i, f"a\nb\n{i}", 1, 50, 20)[1] for i in range(300)]
    assert {"plain", "psm", "spm"} == set(forms)


def test_bad_markers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "<M>")):
        with pytest.raises(ValueError, match="marker"):
            M.store(docs, markers=markers)
    with pytest.raises(ValueError, match="frame"):
        M.store(docs, frame_bytes=3)
