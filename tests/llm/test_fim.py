"""Fill-in-the-middle samples against slices of plain strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from fieldpulse.llm import fim, queries

TEXTS = ["", "a", "é", "𝄞x", "one two\nthree  vier_5\r\n", "has <P> inside", "<", "<P", "日本語 text, mixed — end", "a\n\n\nb",
         "x" * 3000 + "ü" * 500, "é combining", "   z"]


def expected(key, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{head}<S>{tail}<M>{middle}"


def test_ranks_equal_counts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 6, size).astype(np.uint8)
        matrix, upto = fim.WaveletMatrix(symbols), np.arange(size + 1)
        for c in fim.CLASSES:
            assert matrix.rank(c, upto).tolist() == [int((symbols[:i] == c).sum()) for i in upto]


@pytest.mark.parametrize("unit, begins", [
    ("char", lambda t, i: True),
    ("word", lambda t, i: (t[i].isascii() and t[i].isalnum() or ord(t[i]) > 127)
     and (i == 0 or not (t[i - 1].isascii() and t[i - 1].isalnum() or ord(t[i - 1]) > 127))),
    ("line", lambda t, i: i == 0 or t[i - 1] == "\n")])
def test_cuts_are_where_units_begin(unit, begins):
    data, offsets = fim.scan.text_bytes(pa.array(TEXTS))
    matrix = fim.WaveletMatrix(fim.classes(data, offsets))
    begin, end = offsets[:-1], offsets[1:]
    starts = [[len(t[:i].encode()) for i in range(len(t)) if begins(t, i)] for t in TEXTS]
    n = fim.units_before(matrix, unit, begin, end)
    if unit == "line":  # a break at the very end begins no line of its own
        n = np.minimum(n, [len(s) for s in starts])
    assert n.tolist() == [len(s) for s in starts]
    for k in range(4):
        at = fim.place_after(matrix, unit, begin, end, np.minimum(k, n))
        if unit == "char":
            for t, s, a, b, e in zip(TEXTS, starts, at, begin, end):
                assert a - b == (s + [e - b])[min(k, len(s))]
        for t, a, b in zip(TEXTS, at, begin):
            t.encode()[: a - b].decode()  # no code point is split


def test_query_equals_plain_slices(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS + [None])] + [(None, "no key"), (3, "again"), (3, "again")]
    rows += [(i, "".join(rng.choices("ab c\né𝄞<>PSM", k=rng.randint(1, 60)))) for i in range(100, 700)]
    spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, form string, n int").write.parquet(
        f"{tmp_path}/documents.parquet")
    want = []
    for k, t in rows:
        n, form, a, m, out = expected(k, t)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, t or "")]
        want.append((k, n, form, a, m, *sha))
    got = queries.op13_fim(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
        "output_sha256": "string", "restored_sha256": "string"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_words_and_lines_restore(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 5)), "k int, body string")
    for unit in fim.UNITS:
        found = fim.transform(docs, "k", "body", unit)
        assert found.where(fim.restore(found.output, found.form) != found.text).count() == 0
    assert fim.transform(docs.limit(0), "k", "body").count() == 0
