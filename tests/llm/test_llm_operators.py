"""Operators on small tables: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyledger.llm import (
    components,
    decontaminate,
    exact_dup,
    language,
    licenses,
    mixing,
    near_dup,
    shards,
    shingles,
    token_counts,
    url_rules,
    warc,
)

from storyledger.session import landed

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rule string, row string, label string"


def docs_of(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(n))


TEXTS = [None, "", "  ", "One", "one two three", prose(1, 40), prose(1, 40), prose(2, 30_000), "Ünïcode çá 123 — x"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 257])
def test_permutation_is_one_to_one(spark, n):
    placed = spark.range(n).select(shards.permuted(F.col("id"), n, 3).alias("p"))
    assert sorted(r.p for r in placed.collect()) == list(range(n))


def test_shards_are_even_gapless_and_repeatable(spark):
    docs = docs_of(spark, TEXTS * 4).withColumn("slot", F.lit("old"))
    once, again = ([tuple(r) for r in shards.shard(docs, ["doc_id"], 5, seed=1).select("doc_id", "shard", "slot").collect()] for _ in "ab")
    assert sorted(once) == sorted(again)
    by_shard = {}
    for _, shard, slot in once:
        by_shard.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert shards.shard(docs.limit(0), ["doc_id"], 5).count() == 0


def test_mix_targets_and_positions(spark):
    rows = spark.createDataFrame(
        [(i, s, z, f"{i:05d}") for i, (s, z) in enumerate([("a", 10)] * 90 + [("b", 10)] * 5 + [(None, 7)] * 5 + [("c", 0)])],
        "doc_id bigint, source string, size bigint, tie string",
    )
    targets = landed(mixing.source_targets(rows, F.col("rank") % 3 + 1), "targets")
    got = {r.source: (r.source_size, r.target) for r in targets.collect()}
    assert got["b"][1] == 150 and got[None][1] == 105 and got["c"][1] == 0
    assert got["a"][1] == pytest.approx(985 - 255)
    placed = mixing.place(rows, targets, mixing.SHAPES).collect()
    taken = {}
    for r in placed:
        words = sum(p.words for p in r.placements)
        assert words <= 3 * r["size"] and all(0 <= p.position <= 1 for p in r.placements)
        taken[r.source] = taken.get(r.source, 0) + words
    assert all(abs(taken[s] - got[s][1]) <= 1 for s in got)
    assert mixing.place(rows.limit(0), mixing.source_targets(rows.limit(0), F.lit(1))).count() == 0


def test_inverse_demand_inverts_the_schedule(spark):
    for knots in mixing.SHAPES:
        shares = [i / 50 for i in range(51)]
        frame = spark.createDataFrame([(s,) for s in shares], "share double")
        for share, time in frame.select("share", mixing.inverse_demand(F.col("share"), knots)).collect():
            area = 0.0
            for t0, length, w0, w1, _, _ in mixing.pieces(knots):
                x = min(max(time - t0, 0.0), length)
                area += w0 * x + (w1 - w0) / length * x * x / 2
            assert area == pytest.approx(share, abs=1e-9)


def test_url_rules_match_brute_force(spark):
    rules = [("net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/y", "block"), ("b.a.net", "/", "allow"), ("org", "", "block")]
    hosts = ["net", "a.net", "b.a.net", "c.b.a.net", "xa.net", "org", "A.NET", "", "net.", "a.net:80"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/", "/x/yz?q", "/X/", "#f")] + [None, "", "a.net/x/", "http://a.net/x/"]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(frame, table, "url", "page_id").collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
        assert got[i] == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert url_rules.judge_urls(frame.limit(0), table, "url", "page_id").count() == 0
    assert {r.verdict for r in url_rules.judge_urls(frame, table.limit(0), "url", "page_id").collect()} == {"allow"}


def test_contamination_with_short_and_long_items(spark):
    shared = prose(5, 12)
    docs = docs_of(spark, TEXTS + [f"{prose(6, 5)} {shared.upper()} {prose(7, 5)}", f"a {' '.join(shared.split()[:9])} b", "one two"])
    items = spark.createDataFrame([(1, shared), (2, "One, two"), (3, None), (4, ""), (1, shared)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items, {"doc_id": F.col("doc_id")}).collect()}
    assert got[9] == (12, ["1"]) and got[10] == (0, []) and got[11] == (2, ["2"]) and got[4] == (2, ["2"]) and got[0] == (0, [])
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {0, 1, 2, 3, 5, 6, 7, 8, 10}
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), items, {}).count() == 0


def test_licenses_and_suppression(spark):
    texts = TEXTS + ["Licensed under the Apache License, Version 2.0.", "CC-BY cc by GENERAL public license; All rights reserved", "ACC BY"]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, texts), ["doc_id"]).collect()}
    assert len(got) == len(texts)
    assert got[9].labels == "apache-2.0" and got[9].n_base == 0 and got[9].score == 0.98
    assert (got[10].n_base, got[10].first_word, got[10].last_word) == (4, 0, 7)
    assert got[10].base_labels == "cc-by,gpl,reserved" and got[11].n_base == 0
    assert (got[0].n_words, got[0].labels, got[0].score, got[0].first_word) == (0, "", 0.0, None)
    assert len(licenses.RULES) > 200


def sample_of(rule):
    """A shortest text that the pattern of a rule matches from its keyword on."""

    def grown(pattern):
        found = re.search(r"\(([^()]*)\)(\??)|\[([^]]*)\](?:\{(\d)\})?|(.)\?", pattern)
        if not found:
            return [pattern]
        group, maybe, chars, times, _ = found.groups()
        options = [chars[0] * int(times or 1)] if chars else group.split("|") if group else []
        options = [""] + options if maybe or group is None and not chars else options
        return [t for o in options for t in grown(pattern[: found.start()] + o + pattern[found.end() :])]

    # The opening words of a grant are the same in all rules: the shortest form of them is put first.
    pattern = re.sub(r"^\^\(licensed\|.*?conditions of \(the \)\?\)\?", f"{rule.keyword} under ", rule.pattern).removeprefix("^")
    fitting = [t for t in grown(pattern) if t.split(" ")[0] == rule.keyword or t == rule.keyword]
    return min(fitting, key=len)


def test_every_license_rule_fires(spark):
    texts = spark.createDataFrame([(i, f"so {sample_of(r)} x") for i, r in enumerate(licenses.RULES)], "doc_id bigint, text string")
    fired = {(r.doc_id, r.rule) for r in licenses.detections(texts, ["doc_id"]).where("rule is not null").collect()}
    assert [r for i, r in enumerate(licenses.RULES) if (i, i) not in fired] == []
    named = ["Under GPLv3", "LGPLv2.1", "AGPLv3 here", "BSD 3-Clause License", "2-clause BSD license", "Released under the 3-Clause License"]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs_of(spark, named), ["doc_id"]).collect()}
    assert [got[i] for i in range(6)] == ["gpl-3.0", "lgpl-2.1", "agpl-3.0", "bsd-3-clause-any", "bsd-2-clause-any", "bsd-3-clause-any"]
    with pytest.raises(ValueError):
        licenses._starts("[a-z]+ license ")


def test_exact_dedup_over_several_batches_and_colliding_digests(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c"), (7, "a"), (7, "a"), (None, "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("other")).repartition(4)
    frame.write.parquet(f"{tmp_path}/t")

    def weak(text):
        return F.lit("same")

    for digest in (exact_dup.sha256, weak):
        got = exact_dup.exact_dedup(spark, f"{tmp_path}/t", digest=digest, bytes_per_batch=1).collect()
        assert len(got) == len(rows)
        assert sorted((r.keep_id, r.n) for r in got if r.kept) == [(2, 2), (5, 2), (6, 1), (7, 4)]
        assert {r.id: r.keep_id for r in got} == {1: 7, 2: 2, 3: 7, 4: 5, 5: 5, 6: 6, 7: 7, None: 2}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    first.write.parquet(f"{tmp_path}/t")
    args = {"key": "doc_id", "text": "text"}
    exact_dup.absorb(spark, f"{tmp_path}/t", f"{tmp_path}/s", **args).collect()
    spark.createDataFrame([(9, "a")], "doc_id bigint, text string").write.mode("append").parquet(f"{tmp_path}/t")
    state = exact_dup.absorb(spark, f"{tmp_path}/t", f"{tmp_path}/s", **args).collect()
    assert sorted((r.n, r["last"].id) for r in state) == [(1, 2), (2, 9)]


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
    pages = [(1, "http://a/\r\nb", long), (2, None, long), (3, "http://c", "x"), (4, "http://d", "x"), (5, "http://e", None), (-6, "u", long)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    warc.write_archives(frame, f"{tmp_path}/w")
    records = warc.read_archives(spark, f"{tmp_path}/w", with_payload=True)
    got = {warc_key(r): r for r in warc.assemble(records).collect()}
    assert len(got) == 6
    assert {k: r.main.type for k, r in got.items()} == {1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response", -6: "revisit"}
    assert bytes(got[2].main.payload).decode() == long and got[5].main.payload_bytes == 0
    assert got[1].main.payload_bytes == len(long.encode()) and got[1].main.refers_to.startswith("<urn:page:2:")
    assert all(r.request is not None and r.n_metadata == 1 for r in got.values())


def warc_key(row):
    return int(row.main.record_id.split(":")[2])


def test_token_pieces_are_safe(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, lengths = Tokenizer.from_file(path), token_counts.PieceLengths(path)
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\x1c", "　", "\xa0", "\x85", "a", "Bc", "'s", "'", "!", "12", "é", "<|endoftext|>", "日本", "💡"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)] + ["", "x" * 5000, " " * 3000]
    expected = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.text_lengths(iter(texts), lengths) == expected
    assert token_counts.text_lengths(iter(texts), lengths) == expected


def test_character_model_is_a_distribution():
    grams = {"x": {"   a": 3, "  ab": 3, " aba": 2, "abab": 4, "bab ": 2, "aba ": 1}, "y": {"   c": 2, "  ca": 2, " ca ": 2}}
    model = language.Model(grams)
    for context in ([0, 0, 0], [0, 1, 2], [3, 1, 3], [2, 2, 2]):
        ids = np.array([[*context, c] for c in range(model.unknown + 1)], np.uint16)
        logs = np.concatenate([model.log_probabilities(row) for row in ids])
        assert np.exp(logs.astype(float)).sum(0) == pytest.approx(np.ones(2), abs=1e-5)


def test_language_of_odd_texts(spark):
    english, french = [prose(i, 60) for i in range(30)], [prose(i, 60).translate(str.maketrans("aeiou", "éàùçê")) for i in range(30)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "e") for t in english] + [(t, "f") for t in french] + [("junk", None)])]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.col("doc_id"))
    docs = docs_of(spark, [None, "", "12 - !", prose(99, 80), prose(98, 50_000), "qqq"]).withColumn("score", F.lit("old"))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(6)][:5] == ["und", "und", "und", "e", "e"]
    assert got[5].lang_pred in ("e", "f") and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].rejected and not got[3].rejected
    nothing = language.Model({})
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_near_duplicates_small(spark):
    base = prose(11, 200).split()
    edits = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (20, 90, 150)]
    docs = docs_of(spark, [*TEXTS, " ".join(base), *edits, prose(12, 200)])
    got = {r.id: r for r in near_dup.near_classes(docs).collect()}
    assert {got[i].class_id for i in (9, 10, 11, 12)} == {9} and got[9].class_size == 4
    assert got[5].class_id == got[6].class_id == 5 and got[13].class_id == 13
    assert got[0].class_id == got[1].class_id == got[2].class_id == 0
    twice = docs.union(docs)
    kept = near_dup.without_near_duplicates(twice)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 7, 8, 9, 13]
    assert near_dup.without_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_buckets_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHAIN", 3)
    base = prose(21, 200).split()
    edits = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(10, 190, 18)]
    rows = [(i, t) for i, t in enumerate([*edits, prose(22, 200)])] + [(None, " ".join(base)), (None, prose(23, 200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_classes(docs).collect()
    assert {r.class_id for r in got if r.id is not None and r.id < len(edits)} == {0}
    alone = [r for r in got if r.class_size == 1]
    assert len(alone) == 2 and {r.class_id for r in alone} == {None, len(edits)}
    assert sum(r.kept for r in got) == 3


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"{out[i]}{rng.randint(0, 10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("kind", ["third", "band"])
def test_recall_of_pairs_by_brute_force(spark, kind, record_property):
    """A group of edited copies that is a third of all rows; many texts whose pairs lie at 0.7 to 0.8."""
    rng = random.Random(8)
    base = prose(31, 200).split()
    if kind == "third":
        texts = [edited(rng, base, rng.randint(0, 5)) for _ in range(150)] + [prose(500 + i, 150) for i in range(300)]
    else:
        texts = [edited(rng, base, rng.choice([2, 3, 4])) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf = near_dup.document_frequencies(docs, "text")
    sets = [(h, shingles.weights(h, n, idf)) for h, n in map(shingles.shingles, texts)]
    classes = {r.id: r.class_id for r in near_dup.near_classes(docs).collect()}
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if shingles.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    recall = sum(classes[a] == classes[b] for a, b in alike) / len(alike)
    record_property("recall", recall)
    print(kind, len(alike), "pairs, recall", recall)
    assert len(alike) > 50 and recall >= 0.9
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in alike:
        parent[root(a)] = root(b)
    assert all(root(i) == root(c) for i, c in classes.items())


def test_weights_fall_with_the_groups_that_share_a_passage(spark):
    notice = prose(41, 60)
    base = prose(42, 200).split()
    rng = random.Random(2)
    texts = [f"{prose(600 + i, 100)} {notice}" for i in range(60)] + [prose(700 + i, 100) for i in range(60)]
    texts += [edited(rng, base, 2) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf = near_dup.document_frequencies(docs, "text")
    assert len(set(idf.tolist())) > 5

    def weight(text):
        found = shingles.shingles(text)[0]
        return float(np.median(shingles.weights(found, np.ones(len(found)), idf)))

    own, shared, copied = weight(texts[61]), weight(notice), weight(" ".join(base))
    assert shared < 0.75 * own and copied > 0.9 * own
    classes = {r.id: r.class_id for r in near_dup.near_classes(docs).collect()}
    assert all(classes[i] == i for i in range(120)) and {classes[i] for i in range(120, 180)} == {120}


@pytest.mark.parametrize("block", [4, 1000])
def test_pairs_that_leaders_chains_and_turns_leave(spark, monkeypatch, block):
    """Without any turn, every pair of one bucket is still compared, in blocks or in one task."""
    monkeypatch.setattr(near_dup, "TURNS", 0)
    monkeypatch.setattr(near_dup, "CHAIN", 1)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(5)
    base = [prose(51 + i, 200).split() for i in range(2)]
    texts = [edited(rng, base[i % 2], 1 + i % 3 // 2) for i in range(24)] + [prose(900 + i, 150) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf = near_dup.document_frequencies(docs, "text")
    sets = [(h, shingles.weights(h, n, idf)) for h, n in map(shingles.shingles, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if shingles.weighted_jaccard(sets[a], sets[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert len(set(root)) < len(texts) - 10
    assert {r.id: r.class_id for r in near_dup.near_classes(docs).collect()} == dict(enumerate(root))


def test_pairs_whose_samples_hardly_agree(spark, monkeypatch):
    """Samples only choose what is tried first: a pair that shares a bucket is decided on whole texts."""
    own = [[1] * 36, [1] * 3 + [2] * 33, [3] * 36]
    rows = [(0, 5, 2, f"n{i}", i, 10.0, own[i]) for i in (0, 1)] + [(1, 6, 3, f"m{i}", i, 10.0, own[i]) for i in range(3)]
    members = spark.createDataFrame(rows, "band int, value bigint, n bigint, node string, first_id bigint, total double, samples array<int>")
    assert [(r.a, r.b) for r in near_dup.candidate_pairs(members, 0.8).collect()] == [("n0", "n1")]

    monkeypatch.setattr(near_dup, "CHAIN", 1)
    monkeypatch.setattr(near_dup, "FINE_AGREE", shingles.SAMPLES + shingles.FINE_SAMPLES + 1)
    rng = random.Random(6)
    base = prose(61, 200).split()
    texts = [edited(rng, base, 1) for _ in range(8)] + [prose(950 + i, 150) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(near_dup.candidate_pairs, "__defaults__", (shingles.SAMPLES + 1,))
    assert [r.class_id for r in near_dup.near_classes(docs).orderBy("id").collect()] == [0] * 8 + list(range(8, 13))


def test_bins_bound_what_two_texts_share():
    rng = random.Random(9)
    base = prose(71, 300).split()
    texts = [edited(rng, base, n) for n in (0, 1, 5, 20, 60, 150)] + ["one", "one two", prose(72, 3000)]
    sets = [(h, n * (1.0 + h % np.uint64(5))) for h, n in map(shingles.shingles, texts)]
    for a, b in combinations(sets, 2):
        most = float(np.minimum(shingles.weight_bins(*a), shingles.weight_bins(*b)).sum(dtype=np.float64))
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        assert most >= np.minimum(a[1][i], b[1][j]).sum() * (1 - near_dup.SLACK)
    assert shingles.weight_bins(*sets[0]).shape == (shingles.BINS,)


def test_digest_of_words_in_tasks_and_in_expressions(spark):
    texts = [*TEXTS, "A\x00b\tC", " lead  and trail ", "ÄÖ ß İ 🎉x y", "a-b_c`d{e~f\x7fg", "0 9 Z z @ [", "\u00a0 \u2028 x"]
    docs = docs_of(spark, texts).select("doc_id", near_dup.words_key(F.col("text")).alias("key"))
    assert {r.doc_id: r.key for r in docs.collect()} == {i: shingles.words_digest(t or "") for i, t in enumerate(texts)}


def test_word_hashes_byte_by_byte():
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def slow(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
        sums = [sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w)) & mask for w in words]
        return shingles.mix(np.array(sums, np.uint64)).tolist()

    for text in [t or "" for t in TEXTS] + [" x", "A\x00b", "...", "Ä🎉 b" * 50]:
        assert shingles.word_hashes(text).tolist() == slow(text)
    long = prose(73, 100_000)
    assert len(long) > shingles.SLICE / 2 and shingles.word_hashes(f"{long} {long}").tolist() == slow(long) * 2


def test_samples_reuse_their_arrays_without_mixing_texts():
    sets = [(h, n * (1.0 + h % np.uint64(3))) for h, n in (shingles.shingles(prose(80 + i, n)) for i, n in enumerate((3, 1500, 40)))]
    once = [shingles.consistent_samples(*s) for s in sets]
    shingles.consistent_samples(*sets[1], shingles.SAMPLES, shingles.FINE_SAMPLES)
    assert all((a == shingles.consistent_samples(*s)).all() for a, s in zip(once[::-1], sets[::-1], strict=True))


def test_long_texts_fill_a_task_of_the_exact_pass(spark, monkeypatch):
    """Parts are bounded by the size of their texts; each pair of different components still meets once."""
    monkeypatch.setattr(near_dup, "BLOCK", 20)
    rows = [(1, 7, f"n{i:03d}", "n000" if i < 40 else f"n{i:03d}", 4.0 if i % 2 else 1.0) for i in range(80)]
    members = spark.createDataFrame(rows, "band int, value bigint, node string, root string, size double")
    tasks = {}
    for r in near_dup.blocks(members).collect():
        for t in r.tasks:
            tasks.setdefault((t.low, t.high), []).append((r.node, r.part))
    size, root = {n: s for _, _, n, _, s in rows}, {n: r for _, _, n, r, _ in rows}
    assert len(tasks) > 20 and max(sum(size[n] for n, _ in held) for held in tasks.values()) <= 80
    met = Counter(
        (min(a, b), max(a, b))
        for (low, high), held in tasks.items()
        for a, pa in held
        for b, pb in held
        if pa == low and pb == high and (low < high or a < b) and root[a] != root[b]
    )
    assert met == Counter((a, b) for a, b in combinations(sorted(root), 2) if root[a] != root[b])


def test_frequencies_leave_no_grams_behind(spark, monkeypatch):
    """Repeated rows count as one; what lands is digests, far less than the texts."""
    texts = [prose(800 + i, 400) for i in range(40)]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    kept = []
    monkeypatch.setattr(near_dup, "landed", lambda df, purpose: kept.append(landed(df, purpose)) or kept[-1])
    once = near_dup.document_frequencies(docs, "text")
    for frame in kept:
        assert not any("array<int>" in kind for _, kind in frame.dtypes)
        assert len(str(frame.toPandas().values.tolist())) < sum(map(len, texts)) / 4
    assert (near_dup.document_frequencies(docs.union(docs).union(docs), "text") == once).all()


def test_near_duplicates_of_a_group_that_is_a_third_of_all_rows(spark):
    base = prose(25, 200).split()

    def copy(i):  # two edits of its own, so any two copies share 176 of 216 shingles
        return " ".join(f"own{i}" if j in (5 + 16 * i, 13 + 16 * i) else w for j, w in enumerate(base))

    texts = [copy(i) for i in range(12)] + [prose(100 + i, 200) for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.class_id for r in near_dup.near_classes(docs).collect()}
    assert {got[i] for i in range(12)} == {0}
    assert all(got[i] == i for i in range(12, 36))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    frame = spark.createDataFrame([(f"{a:03d}", f"{b:03d}") for a, b in links], "a string, b string")
    got = {r.node: r.root for r in components.components(frame).collect()}
    assert {got[f"{i:03d}"] for i in range(21)} == {"000"} and {got[f"{i:03d}"] for i in range(100, 130)} == {"100"}


def test_pipeline_stages_keep_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == (columns if i < 4 else [*columns, "shard", "slot"])
        assert docs.count() > 0


def test_clashing_columns_come_back_as_they_were(spark, sf_dir):
    """Names that stages use inside, and names of judgments, with the caller's own values."""
    names = ["score", "rejected", "lang_pred", "n_scored", "__id", "__node", "__tie", "__digest", "__text", "__place", "__part", "__position", "row", "id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        got = landed(stage(spark, odd, sf_dir), f"clash-{name}")
        assert got.columns[: len(odd.columns)] == odd.columns
        wrong = F.lit(False)
        for n in names:
            wrong = wrong | (F.col(f"`{n}`") != F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string"))) | F.col(f"`{n}`").isNull()
        assert got.count() > 0 and got.where(wrong).isEmpty()


def test_short_texts_in_no_known_script_are_rejected(spark):
    rows = [(i, prose(i, 60), "e") for i in range(60)] + [(100 + i, prose(i, 60).translate(str.maketrans("aeiou", "éàùçê")), "f") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.col("doc_id"))
    docs = docs_of(spark, ["αβγδε ζηθικ λμνξο πρστυ φχψωα βγδεζ", "日本語日本語日本語", prose(7, 6), prose(8, 3)])
    got = {r.doc_id: r.rejected for r in language.identify(docs, model).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}
    model.limits.pop("f")
    again = language.identify(docs_of(spark, ["ЖЗИ ЙКЛ МНО ПРС ТУФ " * 5]), model).first()
    assert again.rejected


def test_exact_dedup_of_later_and_older_files(spark, tmp_path):
    import os

    def add(name, rows, age):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        for f in os.listdir(tmp_path / name):
            if f.startswith("part-") and os.path.getmtime(tmp_path / name / f) > 1.7e9:
                os.utime(tmp_path / name / f, (1.7e9 - age, 1.7e9 - age))

    def run():
        return sorted((r.id, r.keep_id, r.n, r.kept) for r in exact_dup.exact_dedup(spark, f"{tmp_path}/in", folder=f"{tmp_path}/state").collect())

    add("in", [(1, "a"), (2, None)], 0)
    assert run() == [(1, 1, 1, True), (2, 2, 1, True)]
    add("in", [(3, "a"), (4, "old")], 30 * 86_400)
    assert run() == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]
    assert spark.read.parquet(f"{tmp_path}/state/changes").where("n = 2").count() == 1  # a hit on state of an earlier batch


def test_periodic_documents_meet_periodic_items_in_proportion(spark):
    words = " ".join(["one", "two", "three"] * 200)
    docs = spark.createDataFrame([(1, words), (2, words + " more")], "doc_id bigint, text string")
    items = spark.createDataFrame([(f"i{i}", words) for i in range(2)], "item_id string, text string")
    prints = decontaminate.item_fingerprints(items, "item_id", "text")
    scanned = decontaminate.scan(docs, "text", {"doc_id": F.col("doc_id")}, landed(prints, "prints"))
    assert prints.count() < 60 and decontaminate.shared_spans(scanned, prints).count() < 60 * 600
    got = decontaminate.contamination(docs, items, {"doc_id": F.col("doc_id")}).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == {1: (600, 600, 2), 2: (601, 600, 2)}
