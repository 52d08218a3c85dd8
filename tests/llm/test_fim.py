"""Fill-in-middle on small tables: round trips, edge cases, repeats, many pieces."""

import hashlib
import random

import pytest

from storyledger.llm import fim

TEXTS = [None, "", "a", "<P>", "x<M", "ab<", "日本語 🎉", "<S" * 9, "é" * 40, "one <P> two", "plain words " * 20]


def expected(identifier, text):
    text = text or ""
    form, a, b = fim.drawn("" if identifier is None else str(identifier), text)
    if form == "plain":
        return (identifier, len(text), form, None, None, text)
    parts = ("<P>" + text[:a], "<S>" + text[b:], "<M>" + text[a:b])
    output = "".join(parts if form == "psm" else (parts[1], parts[0], parts[2]))
    return (identifier, len(text), form, a, b - a, output)


def table(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 6)]
    rows += [(None, t, "x", 1) for t in TEXTS] + [(3, "one id", "x", 1), (3, "two texts", "x", 1)] + [(7, TEXTS[8], "x", 1)] * 25
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, form string, position int").repartition(3)


@pytest.mark.parametrize("size", [1, 3, 1 << 15])
def test_outputs_and_digests(spark, size):
    rows, docs = table(spark)
    pieces = fim.pieces(docs, size=size)
    wanted = sorted((expected(r[0], r[1]) for r in rows), key=str)
    assert sorted(map(tuple, fim.outputs(pieces).collect()), key=str) == wanted
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = [(r[0], r[1] or "") for r in rows]
    full = sorted(((*expected(*r)[:5], sha(expected(*r)[5]), sha(r[1])) for r in texts), key=str)
    assert sorted(map(tuple, fim.digests(pieces).collect()), key=str) == full
    assert {r[2] for r in wanted} == {"plain", "psm", "spm"}


def test_no_rows_and_a_very_long_text(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert fim.digests(fim.pieces(empty)).count() == 0 and fim.outputs(fim.pieces(empty)).count() == 0
    long = "".join(random.Random(5).choices("abc é日\n", k=3_000_000))
    ids = [i for i in range(200) if fim.drawn(str(i), "ab" * 9)[0] != "plain"][:2]
    docs = spark.createDataFrame([(i, long) for i in ids], "doc_id int, text string")
    for row in fim.digests(fim.pieces(docs)).collect():
        assert row.n == len(long) and row.restored_sha256 == hashlib.sha256(long.encode()).hexdigest()
        assert row.output_sha256 == hashlib.sha256(expected(row.id, long)[5].encode()).hexdigest()


def test_parser_of_any_pieces():
    rng = random.Random(3)
    for _ in range(3_000):
        text = "".join(rng.choices("<PSM>ab é日", k=rng.randint(0, 14)))
        form, a, b = fim.drawn(str(rng.random()), text)
        output = "".join(fim.cut(text, form, a, b, rng.randint(1, 5)))
        parser, parts = fim.Parser(form), []
        while output:
            k = rng.randint(1, 6)
            parts += parser.feed(output[:k])
            output = output[k:]
        assert "".join(p[1] for p in sorted(parts, key=lambda p: p[0])) == text
