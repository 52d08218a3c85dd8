"""Tokenizer alignment against a plain version that reads every text as a whole."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from storyledger.llm import align
from storyledger.llm.queries import QUERIES
from storyledger.session import landed

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "\n", "a ", " a  ", "\n a\n\n b ", "日本語 🎉 ①é́", "▁x", "x ▁ y", "<s> <|endoftext|> <0x0A> </s>", "ﬁ x　y   z",
    "no" * 400, "a\tb\r\nc  d   e ", "don't we'll I'M  12345 x1y2", "\x00\x01 \x7f é", "🎉🎉🎉 🏳️‍🌈", "a\x85b ​c",
]


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(A, B)


def plain(aligner, texts):
    """Tokens of whole texts, groups by decoded bytes, all links one by one."""
    chars = align.byte_level()
    rows, holders = [], Counter()
    for text in texts:
        a = aligner.a.encode(" " + text, add_special_tokens=False) if text else None
        ids_a = a.ids if text else []
        bytes_a = [bytes(chars[c] for c in t) for t in a.tokens] if text else []
        ids_b = aligner.b.encode(text) if text else []
        bytes_b = [aligner.b_bytes[i] for i in ids_b]
        links, groups = Counter(), []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends = []
            for side in (bytes_a, bytes_b):
                at, own = 0, []
                for piece in side:
                    at += len(piece)
                    own.append(at)
                ends.append(own)
            last = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                own = [i for i, e in zip(ids_a, ends[0]) if last < e <= cut], [i for i, e in zip(ids_b, ends[1]) if last < e <= cut]
                groups.append(own)
                links.update((x, y) for x in own[0] for y in own[1])
                last = cut
        else:
            ids_a, ids_b = [], []
        holders.update(links.keys())
        rows.append((ids_a, ids_b, groups, links))
    best = {}
    for (x, _), n in holders.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for ids_a, ids_b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for (x, y), n in links.items() if holders[x, y] == best[x])
        out.append((
            len(ids_a), len(ids_b), len(groups), sum(links.values()), n_best, sum(n * holders[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def noise(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choices("aeth ing  \n\té日🎉.'s1▁", weights=[5] * 8 + [3, 3, 1, 1, 2, 1, 1, 1, 1, 1, 1, 0.02], k=n))


def test_pieces_of_texts_add_up(aligner):
    texts = [t or "" for t in ODD] + [noise(i, 300) for i in range(300)]
    units = align.Units(aligner)
    assert aligner.cuttable
    for chars in (7, 100, 1 << 20):
        got = list(align.aligned_texts(iter(texts), units, chars))
        for row, want in zip(got, plain(aligner, texts), strict=True):
            assert tuple(row[0]) == want[:4]
            assert (hashlib.sha256(row[1].encode()).hexdigest() if row[0][2] else "") == want[6]
    assert any(row[0][0] == 0 for row in got[20:]) and "x ▁ y" in ODD and got[ODD.index("x ▁ y")][0] == [0, 0, 0, 0]


@pytest.mark.parametrize("head", [3, 40, align.HEAD])
def test_scores_with_few_and_many_pairs_broadcast(spark, aligner, head):
    texts = ODD + [noise(i, 120) for i in range(60)] + [noise(1, 120)] * 30
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_a int, row string").repartition(3)
    rows = align.numbered(align.aligned(docs, A, B))
    got = align.with_scores(rows, landed(align.pair_counts(rows), "counts"), head).collect()
    want = plain(aligner, [t or "" for t in texts])
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[r.id][:6]
    empty = align.numbered(align.aligned(docs.limit(0), A, B))
    assert align.with_scores(empty, landed(align.pair_counts(empty), "counts"), head).count() == 0


def test_query_matches_plain_version(spark, duck, sf_dir, aligner):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = dict(zip([r[0] for r in rows], plain(aligner, [r[1] or "" for r in rows]), strict=True))
    got = QUERIES["op12_align_tokenizers"](spark, sf_dir).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
