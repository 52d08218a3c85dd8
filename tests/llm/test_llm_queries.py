"""Queries against their SQL, and those without SQL against brute force."""

import re
from itertools import combinations

import pytest

from storyledger.llm.oracle import ORACLE
from storyledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = [tuple(r[columns.index(c)] for c in frame.columns) for r in cursor.fetchall()]
    assert ordered(map(tuple, frame.collect())) == ordered(expected)


def test_token_counts_match_the_library(spark, duck, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    for row in QUERIES["op5_count_tokens"](spark, sf_dir).collect():
        own = library.encode(texts[row.doc_id] or "", add_special_tokens=False)
        assert (row.n_tokens, row.n_bytes) == (len(own), len((texts[row.doc_id] or "").encode()))


def test_languages_of_held_out_documents(spark, duck, sf_dir):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in QUERIES["op2_identify_language"](spark, sf_dir).collect() if r.held_out]
    assert len(rows) > 20
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) / len(rows) > 0.95


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicates_match_brute_force(spark, duck, sf_dir):
    sets = {k: shingle_set(t) for k, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    classes = {r.doc_id: r.class_id for r in QUERIES["op8_near_duplicates"](spark, sf_dir).collect()}
    assert set(classes) == set(sets)
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        similarity = shared / max(len(sets[a] | sets[b]), 1)
        if similarity >= 0.82 or (not sets[a] and not sets[b]):
            assert classes[a] == classes[b]
        if similarity >= 0.78:  # weights move the level a little
            parent[max(root(a), root(b))] = min(root(a), root(b))
    for a, b in combinations(sorted(sets), 2):
        if classes[a] == classes[b]:
            assert root(a) == root(b) or not sets[a]
