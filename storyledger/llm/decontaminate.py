"""Benchmark decontamination by winnowing.

The fingerprints of a text are the smallest hashes of word 5-grams in every 6 neighbouring 5-grams, so any 10
words that two texts share have a fingerprint in common. Document fingerprints that are also in the
benchmark are kept with the words around them, joined with the benchmark's, and each hit is extended to both sides
word by word: runs of 10 equal words or more are shared for certain, whatever the hashes say. Items
of fewer than 10 words must occur whole; they are looked up by their first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.steps import let, pinned
from storyledger.llm.text import hidden, words
from storyledger.session import landed
from storyledger.sizing import broadcast_if_small

WINDOW = 10
GRAM = 5
SPREAD = WINDOW - GRAM + 1  # neighbouring grams that share one fingerprint
BACK, AHEAD = WINDOW - GRAM, WINDOW - 1  # words kept before and after the start of a gram
# Up to so many fingerprints a document's own are tested in its row; with more, the join tests them all.
IN_ROW_FINGERPRINTS = 20_000
# Rows of an item's hit are under 1 kB, so the bound is 50 MB.
MAX_BROADCAST_HITS = 50_000


def gram_hashes(tokens: Column, k: int) -> Column:
    """Hash of every ``k`` consecutive words."""

    def joined(hashes: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)])

        return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0))), at)

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), joined)


def winnowed(grams: Column) -> Column:
    """Distinct minima of all ``SPREAD`` neighbouring hashes; none for fewer."""

    def smallest(x: Column, i: Column) -> Column:
        return F.least(x, *[F.get(grams, i + j) for j in range(1, SPREAD)])

    firsts = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - (SPREAD - 1), F.lit(0)))
    return F.array_distinct(F.transform(firsts, smallest))


def around(tokens: Column, start: Column) -> Column:
    """The words from ``BACK`` before ``start`` to ``AHEAD`` after; null beyond the text."""
    return F.transform(F.sequence(start - BACK, start + AHEAD), lambda i: F.get(tokens, i))


def places(tokens: Column, grams: Column, wanted: Column, k: int) -> Column:
    """Every place of a gram whose hash is in ``wanted``: ``k``, ``hash``, ``at``, ``near``."""
    numbered = F.transform(grams, lambda x, i: F.struct(x.alias("hash"), i.alias("at")))
    return F.transform(
        F.filter(numbered, lambda s: F.array_contains(wanted, s["hash"])),
        lambda s: F.struct(F.lit(k).alias("k"), s["hash"].alias("hash"), s["at"].alias("at"), around(tokens, s["at"]).alias("near")),
    )


def item_fingerprints(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item_id``, ``need`` (words that must be equal), ``whole`` and a row for each fingerprint and the words around it.

    Places of an item with equal words around them, as in periodic texts, are one row.
    ``whole`` is the family: items of 10 words or more are winnowed, shorter ones give their first gram.
    """
    split = pinned(items, [item], {"tokens": words(F.col(text))}).where(F.size("tokens") > 0)

    def long_item(grams: Column) -> Column:
        return places(F.col("tokens"), grams, winnowed(grams), GRAM)

    def short_item(k: int) -> Column:
        return let(gram_hashes(F.col("tokens"), k), lambda g: places(F.col("tokens"), g, F.slice(g, 1, 1), k))

    n = F.size("tokens")
    found = F.when(n >= WINDOW, let(gram_hashes(F.col("tokens"), GRAM), long_item))
    for k in range(1, GRAM):
        found = found.when(n == k, short_item(k))
    found = found.otherwise(short_item(GRAM))
    rows = pinned(split, [item, "tokens"], {"places": found})
    return rows.select(
        F.col(item).alias("item_id"), F.least(n, F.lit(WINDOW)).alias("need"), (n < WINDOW).alias("whole"), F.inline("places")
    ).drop("at").distinct()


def scan(docs: DataFrame, text: str, keep: dict[str, Column], prints: DataFrame) -> DataFrame:
    """One landed row for each document: ``keep``, ``n_words``, ``places`` that may be in the benchmark."""
    families = [(r["whole"], r["k"]) for r in prints.select("whole", "k").distinct().collect()]  # at most six
    known = {
        f: [r[0] for r in prints.where((F.col("whole") == f[0]) & (F.col("k") == f[1])).select("hash").distinct().limit(IN_ROW_FINGERPRINTS + 1).collect()]
        for f in families
    }

    def wanted(candidates: Column, hashes: list[int]) -> Column:
        if len(hashes) > IN_ROW_FINGERPRINTS:
            return candidates
        return F.filter(candidates, lambda x: x.isin(hashes))

    def family(tokens: Column, whole: bool, k: int, hashes: list[int]) -> Column:
        def found(grams: Column) -> Column:
            own = wanted(F.array_distinct(grams) if whole else winnowed(grams), hashes)
            return let(own, lambda w: F.when(F.size(w) > 0, places(tokens, grams, w, k)))

        return let(gram_hashes(tokens, k), found)

    def found(tokens: Column) -> Column:
        each = [family(tokens, whole, k, hashes) for (whole, k), hashes in known.items()]
        kind = "array<struct<k: int, hash: bigint, at: int, near: array<string>>>"
        all_places = F.flatten(F.array_compact(F.array(*[e.cast(kind) for e in each]))) if each else F.lit(None).cast(kind)
        return F.struct(F.size(tokens).cast("bigint").alias("n_words"), all_places.alias("places"))

    named = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("__text"))
    rows = pinned(named, list(keep), {"found": let(words(F.col("__text")), found)})
    return landed(rows.select(F.monotonically_increasing_id().alias("row"), *keep, "found.*"), "winnowed")


def shared_spans(scanned: DataFrame, prints: DataFrame) -> DataFrame:
    """Extended hits: ``row``, ``item_id``, ``start`` and ``stop`` (exclusive) in words of the document."""
    hits = scanned.where(F.size("places") > 0).select("row", F.inline("places"))
    other = broadcast_if_small(prints.withColumnRenamed("near", "item_near"), MAX_BROADCAST_HITS)
    pairs = hits.join(other, ["k", "hash"])
    same = F.zip_with("near", "item_near", lambda a, b: F.coalesce(a == b, F.lit(False)))
    left = F.array_position(F.reverse(F.slice("same", 1, BACK)), F.lit(False))
    core = F.slice(F.col("same"), F.lit(BACK + 1), F.col("k"))
    right = F.array_position(F.slice(F.col("same"), BACK + 1 + F.col("k"), AHEAD + 1 - F.col("k")), F.lit(False))
    grown = pairs.withColumn("same", same).select(
        "row", "item_id", "need", "at", "k",
        F.forall(core, lambda x: x).alias("core"),
        F.when(left == 0, F.lit(BACK)).otherwise(left - 1).alias("left"),
        F.when(right == 0, AHEAD + 1 - F.col("k")).otherwise(right - 1).alias("right"),
    )
    good = grown.where(F.col("core") & (F.col("left") + F.col("k") + F.col("right") >= F.col("need")))
    return good.select(
        "row", "item_id",
        (F.col("at") - F.col("left")).cast("int").alias("start"),
        (F.col("at") + F.col("k") + F.col("right")).cast("int").alias("stop"),
    )


def contamination(
    docs: DataFrame, items: DataFrame, keep: dict[str, Column], *, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """For each row of ``docs``: ``keep``, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``contaminated``.

    ``items`` are the identifiers of benchmark rows that share ``WINDOW`` consecutive words (shorter rows: all
    their words), as sorted text. Null and empty texts have no words, so they neither hit nor are hit. Repeated
    documents each get their row; repeated items with one identifier count once. An empty benchmark hits nothing.
    """
    prints = landed(item_fingerprints(items, item, item_text), "benchmark")
    scanned = scan(docs, text, keep, prints)
    spans = landed(shared_spans(scanned, prints), "spans")
    covered = (
        spans.select("row", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("at")).distinct()
        .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        spans.select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    joined = scanned.drop("places").join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        *keep, "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        listed.alias("items"), (n_hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without the rows that share a window with a benchmark row; all columns as they were, whatever their names."""
    digest, own = F.sha2(F.coalesce(F.col(text), F.lit("")), 256), hidden(docs, "__digest")
    judged = contamination(docs, items, {"__digest": digest}, text=text)
    bad = landed(judged.where("contaminated").select(F.col("__digest").alias(own)).distinct(), "contaminated")
    return docs.join(broadcast_if_small(bad, 200_000), digest == F.col(own), "left_anti")
