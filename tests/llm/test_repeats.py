"""Repeated byte strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from storyledger.llm import repeats
from storyledger.llm.queries import QUERIES


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(d), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def test_transform_finds_all_repeated_windows():
    rng = random.Random(1)
    for _ in range(500):
        length, base = rng.randint(1, 9), bytes(rng.choices(b"ab\x00\xff", k=30))
        parts = [base[a : a + rng.randint(0, 20)] + bytes(rng.choices(b"abc", k=rng.randint(0, 10))) for a in rng.choices(range(25), k=rng.randint(1, 5))]
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]
        assert [s.tolist() for s in repeats.repeated_windows(parts, length)] == want


def test_sections_depend_on_content_alone(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 400)
    repeats._powers.cache_clear()
    rng = random.Random(2)
    keys = {}
    for n in range(150):
        data = bytes(rng.choices(b"abcdefgh" if n % 3 else b"aab", k=rng.randint(0, 3000)))
        found = [x.tolist() for x in repeats.sections(np.frombuffer(data, np.uint8), 20, 6)]
        windows = []
        for start, stop, key in zip(*found, strict=True):
            own = [data[i : i + 20] for i in range(start, stop - 19)]
            assert len(set(own)) == len(own) and all(keys.setdefault(w, key) == key for w in own)
            windows += range(start, stop - 19)
        assert windows == list(range(max(len(data) - 19, 0)))
    monkeypatch.undo()
    repeats._powers.cache_clear()


def texts_with_repeats(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcdefghij é日", k=n))
    passage, group = text(90), text(400)
    out = [None, "", "a", "x" * 39, "y" * 40, "z" * 41, "ab" * 300, text(500), "é" * 30]
    out += [text(rng.randint(0, 60)) + passage + text(rng.randint(0, 60)) for _ in range(40)]
    out += [group[:i] + "#" + group[i + 1 :] for i in rng.choices(range(400), k=15)] + [group] * 30 + [passage[:39], passage[5:45]]
    return out


@pytest.mark.parametrize("most", [3, repeats.MOST])
def test_removal_matches_brute_force(spark, most):
    texts = texts_with_repeats(4)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, row string, start int").repartition(3)
    want = brute(texts, 40)
    got = repeats.without_repeats(docs, length=40, gram=8, most=most).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == want[r.id]
    assert any(spans for _, spans, _ in want) and any(not spans for _, spans, _ in want)


def test_no_rows_null_and_repeated_identifiers(spark):
    schema = "doc_id string, text string"
    assert repeats.without_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "q" * 100 + str(i) * 150) for i in range(3)] + [("same", "one text of its own " * 30)] * 2
    got = repeats.without_repeats(spark.createDataFrame(rows, schema)).collect()
    want = sorted(brute([t for _, t in rows], 200))
    assert sorted((r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == want


def test_query_matches_brute_force(spark, duck, sf_dir):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = dict(zip([r[0] for r in rows], brute([r[1] for r in rows], 200), strict=True))
    got = QUERIES["op13_remove_repeats"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        size, spans, left = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, size - len(left), len(spans), hashlib.sha256(left).hexdigest())
    assert any(r.n_removed for r in got)
