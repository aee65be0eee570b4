import hashlib
import random
import re

import numpy as np
import pytest

from quizloom.llm import infill

SENTINELS = ("<P>", "<S>", "<M>")


def brute(doc_id, text, rate=90, spm_rate=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(count):
    rng = random.Random(5)
    letters = ["a", "Z", "word", " ", "\n", "é", "漢", "🙂", "1", "<", ">", "<P", "[", "`", "{", "@", "\x00", "é"]
    made = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(count)]
    return made + [None, "", "a", "é", "<P>", "x<M>y", "z" * 200_000, "ab é" * 60_000, "🙂" * 70_000, "dup", "dup"]


@pytest.fixture(params=[infill.BLOCK, 7])
def block(request, monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", request.param)


def test_units(block):
    rng = random.Random(6)
    listed = [(t or "").encode() for t in texts(60) if len(t or "") < 500]
    ends = np.concatenate([[0], np.cumsum(list(map(len, listed)))])
    units = infill.Units(np.frombuffer(b"".join(listed), np.uint8), ends)
    found = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t.decode()) for t in listed]
    assert units.counts().tolist() == list(map(len, found))
    chosen = [rng.randrange(len(u) + 1) for u in found]
    places = units.places(np.array(chosen))
    for text, own, k, place, start, end in zip(listed, found, chosen, places, ends[:-1], ends[1:]):
        assert text[:place - start].decode() == "".join(own[:k])
    assert units.points(ends[:-1], places).tolist() == [len("".join(u[:k])) for u, k in zip(found, chosen)]


def test_pieces():
    buffers = infill.Buffers(memoryview(b"one two three"))
    table = [(0, 0, 13)]
    pieces = infill.cut(table, [4, 8])
    assert pieces == [[(0, 0, 4)], [(0, 4, 4)], [(0, 8, 5)]]
    assert infill.cut([(0, 0, 4), (0, 4, 4)], [4, 4]) == [[(0, 0, 4)], [], [(0, 4, 4)]]
    for form, text in (("psm", b"<P>one <S>three<M>two "), ("spm", b"<S>three<P>one <M>two ")):
        made = infill.arrange(buffers, pieces, form)
        assert buffers.write(made) == text and buffers.hash(made) == hashlib.sha256(text).hexdigest()
        out = infill.Buffers(memoryview(text))
        assert out.write(infill.restore(out, [(0, 0, len(text))], text, form)) == b"one two three"
    with pytest.raises(ValueError):
        infill.restore(out, [(0, 0, 3)], b"<S>", "psm")


def test_rows(spark):
    rows = [(None if i == 7 else i // 2, t, "clash", i, "own") for i, t in enumerate(texts(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, `_h1` int, `a.b` string")
    made = infill.transform(df, "doc_id", "text")
    assert made.columns == ["doc_id", "text", "_h1", "a.b", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    done = infill.undo(made)
    assert done.columns == [*made.columns, "restored", "restored_sha256"]
    done = done.collect()
    assert {r["_h1"] for r in done} == set(range(len(rows)))
    for row in done:
        n, form, prefix, middle, output = brute(row.doc_id, row.text)
        assert (row.n, row.form, row.prefix_chars, row.middle_chars) == (n, form, prefix, middle)
        assert row.output == output and row.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert row.restored == (row.text or "")
        assert row.restored_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
        assert row["a.b"] == "own"
    assert {r.form for r in done} == {"plain", "psm", "spm"}
    assert infill.undo(infill.transform(df.limit(0), "doc_id", "text")).count() == 0
    other = infill.transform(df, "doc_id", "text", seed=2, rate=0, out="o").collect()
    assert all(r.form == "plain" and r.o == (r.text or "") for r in other)


def test_undo_alone(spark):
    rows = [(None, "psm"), ("text", "other"), ("text", None), ("", "plain")]
    df = spark.createDataFrame(rows, "output string, form string")
    assert [r.restored for r in infill.undo(df.where("form <> 'psm' OR form IS NULL")).collect()] == ["text", "text", ""]
    with pytest.raises(Exception, match="lacks <P>"):
        infill.undo(df.limit(1)).collect()
