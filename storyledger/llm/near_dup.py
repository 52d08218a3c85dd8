"""Near duplicates by improved consistent weighted sampling.

Texts are weighted sets of word 5-grams: term frequency times inverse document frequency. Frequencies are counted over
groups, not rows: texts that share their most common one of four least hashes are one group, so the copies of a
text do not make its own words common, while passages that many unlike texts share weigh less. A
count-min sketch holds the counts, sized by the mean text and of bounded size.

Each text has 36 consistent samples in 12 bands. Texts with the same words fold to one node first. Nodes that share a
band become candidate pairs, a constant number for each node of a bucket; pairs whose samples agree enough, and those of
buckets of two, are verified on whole texts by weighted Jaccard similarity. Where the nodes of a bucket are then in several components,
they take 96 further samples in 16 finer bands, in which a pair at 0.8 meets with probability 0.99 and a
pair at 0.6 seldom. Inside the finer buckets nodes are paired the same way, then representatives of the components
that are left meet in other orders, in a fixed number of turns. These steps make pairs in proportion to nodes.
Last, an exact pass compares what they left, block by block: all pairs that share a bucket and are in different
components, whatever their samples; only bounds on what two texts can share spare it whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyledger.functions.steps import pinned
from storyledger.llm.components import components, joined_components
from storyledger.llm.shingles import (
    BANDS,
    FINE_BANDS,
    FINE_ROWS,
    FINE_SAMPLES,
    ROWS,
    SAMPLES,
    SKETCH_DEPTH,
    band_keys,
    consistent_samples,
    grams,
    idf_table,
    least_hashes,
    set_digest,
    shingles,
    sketch_slots,
    sketch_width,
    weight_bins,
    weighted_jaccard,
    weights,
    words_digest,
)
from storyledger.llm.shipping import ship
from storyledger.llm.text import ascii_lower, hidden
from storyledger.session import landed

SIMILARITY = 0.8
# Which pairs of larger buckets are tried before the exact pass, which uses neither number.
# Of 36 samples a pair at 0.8 agrees in 29 on average; fewer than 20 is 3.7 standard deviations below.
LEAST_AGREE = 20
# Of all 132 samples a pair at 0.8 agrees in 106 on average; fewer than 88 is 3.8 standard deviations below.
FINE_AGREE = 88
TURNS = 3  # in the finer buckets: all nodes first, then representatives of components
FACES = 3  # representatives of a component in a bucket
BLOCK = 1_000  # nodes on either side of a task of the exact pass
NODE_BYTES = 16_384  # a longer text takes the place of several nodes there
CHAIN = 2_000  # nodes of a bucket that are chained together; larger buckets have several chains
SLACK = 1e-6  # for rounding of total weights
# 250 000 identifiers with their digests stay under 25 MB.
MAX_BROADCAST_IDS = 250_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_key(text: Column) -> Column:
    """Digest of the words of a text: equal for texts that have the same words in the same order."""
    return F.md5(F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, " ")))


def set_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``whole`` (digest of the set of shingles), its ``size`` and four ``leasts`` of each row with a word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, sizes, leasts = [], [], []
            for value in batch.column(1):
                found = shingles(value.as_py() or "")[0]
                wholes.append(set_digest(found))
                sizes.append(len(found))
                leasts.append(least_hashes(found))
            columns = [pa.array(wholes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(leasts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "whole", "size", "leasts"])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(read, "id bigint, whole bigint, size bigint, leasts array<bigint>").where("size > 0")


def group_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One text for each group of texts that are mostly alike: ``whole``, ``id``, its ``size`` and ``times``, its rows.

    A text has four least hashes; its group is the one of them that most texts share. An edit seldom changes all four,
    so the copies of a text are a few groups, however many they are. Only digests move.
    """
    rows = landed(set_keys(docs, key, text), "leasts")
    copies = rows.groupBy("whole", "id").agg(F.count(F.lit(1)).alias("times"), F.first("size").alias("size"), F.first("leasts").alias("leasts"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "times", "size"))
    wholes = landed(copies.groupBy("whole").agg(F.sum("times").alias("n"), first.alias("copy"), F.first("leasts").alias("leasts")), "wholes")
    each = wholes.select("whole", "copy", "n", F.posexplode("leasts").alias("place", "least"))
    shared = landed(each.groupBy("place", "least").agg(F.sum("n").alias("shared")), "shared")
    best = F.max(F.struct("shared", "place", "least"))
    choice = each.join(shared, ["place", "least"]).groupBy("whole").agg(best.alias("best"), F.first("copy").alias("copy"))
    reps = choice.groupBy("best.place", "best.least").agg(F.min(F.struct("whole", "copy")).alias("rep"))
    return landed(reps.select("rep.whole", "rep.copy.id", "rep.copy.size", "rep.copy.times"), "reps")


def folded_grams(docs: DataFrame, key: str, text: str, reps: DataFrame) -> DataFrame:
    """``grams`` of the texts in ``reps`` and their ``times``. Grams are made again, since all of them are as long as the texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, wholes, held, size = 0, [], [], 0

            def packed(at: int, wholes: list, held: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [pa.array(wholes, pa.int64()), pa.array(held, pa.list_(pa.int32()))]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), *columns], names=["id", "whole", "grams"])

            for value in batch.column(1):
                found = shingles(value.as_py() or "")[0]
                wholes.append(set_digest(found))
                held.append(grams(found).view(np.int32))
                size += len(found)
                if size > 1 << 20:
                    yield packed(at, wholes, held)
                    at, wholes, held, size = at + len(held), [], [], 0
            if held:
                yield packed(at, wholes, held)

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    made = rows.mapInArrow(read, "id bigint, whole bigint, grams array<int>")
    wanted = reps.select(F.col("id").alias("__id"), F.col("whole").alias("__whole"), "times")
    return made.join(wanted, (F.col("whole") == F.col("__whole")) & F.col("id").eqNullSafe(F.col("__id"))).select("grams", "times")


def document_frequencies(docs: DataFrame, text: str, key: str = "doc_id") -> np.ndarray:
    """Inverse document frequency of each slot of the sketch, from all rows of ``docs``."""
    reps = group_texts(docs, key, text)
    facts = reps.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    n_groups, width = facts["n"], sketch_width(facts["total"] / max(facts["n"], 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(width * SKETCH_DEPTH)
        for batch in batches:
            own = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            times = batch.column(1).to_numpy()
            # A row that is there several times counts as one.
            part = None if (times == 1).all() else np.repeat(1 / times, np.diff(batch.column(0).offsets.to_numpy()))
            for slots in sketch_slots(own, width):
                sketch += np.bincount(slots, part, minlength=len(sketch))
        used = np.flatnonzero(sketch)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sketch[used])], names=["slot", "n"])

    totals = folded_grams(docs, key, text, reps).mapInArrow(counted, "slot bigint, n double").groupBy("slot").agg(F.sum("n"))
    counts = np.zeros(width * SKETCH_DEPTH)
    for slot, n in totals.collect():  # the size of the sketch, whatever the number of documents
        counts[slot] = n
    return idf_table(np.rint(counts), n_groups)


def features(docs: DataFrame, key: str, text: str, idf: np.ndarray) -> DataFrame:
    """``id``, ``node`` (digest of the words), ``bands``, ``samples`` and ``total`` weight of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # constant size

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            named, bands, samples, totals = [], [], [], []
            for value in batch.column(1):
                read = value.as_py() or ""
                named.append(words_digest(read))
                found, times = shingles(read)
                if not len(found):
                    bands.append([]), samples.append([]), totals.append(0.0)
                    continue
                weight = weights(found, times, table)
                own = consistent_samples(found, weight)
                bands.append(band_keys(own))
                samples.append(own.astype(np.uint32).view(np.int32))
                totals.append(float(weight.sum()))
            columns = [pa.array(named), pa.array(bands, pa.list_(pa.int64())), pa.array(samples, pa.list_(pa.int32())), pa.array(totals)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "node", "bands", "samples", "total"])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sampled, "id bigint, node string, bands array<bigint>, samples array<int>, total double")


def buckets(nodes: DataFrame) -> DataFrame:
    """``node``, ``first_id``, ``total``, ``samples`` and bucket (``band``, ``value``, its size ``n``) for buckets of two nodes or more.

    Samples join once it is known which nodes share a bucket, so those of texts without any neighbour are not moved.
    """
    each = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    large = each.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = nodes.select("node", "first_id", "total", "samples")
    return each.join(large, ["band", "value"]).join(own, "node")


def pairs_of(left: Column, right: Column) -> Column:
    """A pair with the lesser node as ``a``."""
    low, high = F.least(left, right), F.greatest(left, right)
    return F.struct(low["node"].alias("a"), low["first_id"].alias("id_a"), high["node"].alias("b"), high["first_id"].alias("id_b"))


def candidate_pairs(members: DataFrame, similarity: float, least: int = LEAST_AGREE) -> DataFrame:
    """Pairs ``a`` < ``b`` with ``id_a``, ``id_b``: each node with the leader of its bucket and with its neighbour in a chain.

    Large buckets are cut into parts of about ``CHAIN`` nodes, in each band another way. The leader is the same node in all
    bands that hold it, and chains follow the total weight, so the bands of a pair mostly give it once. Pairs go whose
    total weights alone keep them below ``similarity``. A bucket of two gives its pair in any other case. In larger ones
    pairs wait whose samples agree in fewer than ``least`` places: ``links_left`` compares all pairs of these buckets.
    """
    part = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / CHAIN))
    keys = ["band", "value", "__part"]
    me = F.struct("node", "first_id", "total", "samples")
    group, line = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("total", "node")
    seen = members.withColumn("__part", part).withColumn("__me", me).select(
        "__me", "n", F.lag("__me").over(line).alias("__near"), F.min_by("__me", F.xxhash64("node")).over(group).alias("__lead"),
    )
    both = seen.select("__me", "n", F.explode(F.array("__near", "__lead")).alias("__other"))
    same = F.size(F.filter(F.zip_with("__me.samples", "__other.samples", lambda x, y: x == y), lambda x: x))
    mine, other = F.col("__me.total"), F.col("__other.total")
    alike = F.least(mine, other) >= F.greatest(mine, other) * (similarity - SLACK)
    apart = F.col("__other").isNotNull() & (F.col("__me.node") != F.col("__other.node"))
    likely = both.where(apart & alike).where((F.col("n") == 2) | (same >= least))
    return likely.select(pairs_of(F.col("__me"), F.col("__other")).alias("p")).select("p.*").distinct()


def fine_features(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``node``, keys of the finer ``bands``, further ``samples`` and weights by bin (``sums``) of ``texts`` (``node``, ``text``)."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)  # bounded size

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, samples, sums = [], [], []
            for value in batch.column(1):
                found, times = shingles(value.as_py() or "")
                weight = weights(found, times, shared.value)
                sums.append(weight_bins(found, weight))
                own = consistent_samples(found, weight, SAMPLES, FINE_SAMPLES)
                bands.append(band_keys(own, FINE_BANDS, FINE_ROWS))
                samples.append(own.astype(np.uint32).view(np.int32))
            lists = [(bands, pa.int64()), (samples, pa.int32()), (sums, pa.float32())]
            columns = [batch.column(0), *(pa.array(held, pa.list_(kind)) for held, kind in lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "bands", "samples", "sums"])

    return texts.select("node", "text").mapInArrow(sampled, "node string, bands array<bigint>, samples array<int>, sums array<float>")


def several_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``members`` (``band``, ``value``, ``node``) with their ``root``, of buckets in several components."""
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return named.join(mixed.select("band", "value"), ["band", "value"], "left_semi")


def fine_pairs(members: DataFrame, turn: int, least: int, similarity: float) -> DataFrame:
    """Pairs ``a`` < ``b`` of different components in a finer bucket, two for each node at most.

    In the first turn all nodes of a bucket meet a leader and their neighbour in a chain. In later turns up to
    ``FACES`` nodes stand for a component, and meet their neighbours in two other orders. Large buckets are cut into
    parts, in each turn and band another way.
    """
    me = F.struct("node", "first_id", "total", "samples", "root")
    keys = ["band", "value", "__part"]
    if turn == 0:
        seen = members.select("band", "value", "n", me.alias("__me"))
    else:
        faces = F.array(*(F.min_by(me, F.xxhash64("node", F.lit(FACES * turn + i))) for i in range(FACES)))
        stood = members.groupBy("band", "value", "n", "root").agg(F.array_distinct(faces).alias("__faces"))
        seen = stood.select("band", "value", "n", F.explode("__faces").alias("__me"))
    part = F.pmod(F.xxhash64("__me.node", "band", F.lit(turn)), F.ceil(F.col("n") / CHAIN))
    seen = seen.withColumn("__part", part)
    group, node = Window.partitionBy(*keys), F.col("__me.node")
    by_total, by_hash = group.orderBy("__me.total", node), group.orderBy(F.xxhash64(node, F.lit(turn)), node)
    others = [F.lag("__me").over(by_total)]
    others.append(F.min_by("__me", F.xxhash64(node)).over(group) if turn == 0 else F.lag("__me").over(by_hash))
    met = seen.select("__me", *(o.alias(f"__other_{i}") for i, o in enumerate(others)))
    both = met.select("__me", F.explode(F.array("__other_0", "__other_1")).alias("__other"))
    apart = both.where(F.col("__other").isNotNull() & (F.col("__me.root") != F.col("__other.root")))
    mine, other = F.col("__me.total"), F.col("__other.total")
    alike = F.least(mine, other) >= F.greatest(mine, other) * (similarity - SLACK)
    same = F.size(F.filter(F.zip_with("__me.samples", "__other.samples", lambda x, y: x == y), lambda x: x))
    likely = apart.where(alike).where(same >= least)
    return likely.select(pairs_of(F.col("__me"), F.col("__other")).alias("p")).select("p.*").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """Rows of mixed buckets (``band``, ``value``, ``node``, ``root``, ``size``) with their ``part`` and ``tasks`` (``low``, ``high``).

    Nodes of the largest component of a bucket need no meeting among themselves: the others are the first parts, and
    meet all parts. A part is of about ``BLOCK`` in size, a task has two parts, or one with itself, so each pair of
    different components is in one task.
    """
    by_root = members.groupBy("band", "value", "root").agg(F.sum("size").alias("n"))
    sizes = by_root.groupBy("band", "value").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("core"))
    parts_of = lambda n: F.ceil(n / BLOCK).cast("int")
    small = F.col("all") <= BLOCK  # one task with itself
    first = F.when(small, 1).otherwise(parts_of(F.col("all") - F.col("core.n")))
    dealt = members.join(sizes, ["band", "value"]).withColumns({"__first": first, "__core": F.when(small, 0).otherwise(parts_of(F.col("core.n")))})
    inside = (F.col("root") == F.col("core.root")) & ~small
    spread = F.xxhash64("node", F.lit("block"))
    part = F.when(inside, F.col("__first") + F.pmod(spread, "__core")).otherwise(F.pmod(spread, "__first")).cast("int")
    last = F.when(inside, F.col("__first")).otherwise(F.col("__first") + F.col("__core")) - 1
    tasks = F.transform(F.sequence(F.lit(0), last), lambda q: F.struct(F.least(q, "part").alias("low"), F.greatest(q, "part").alias("high")))
    return dealt.withColumn("part", part).select("band", "value", "node", "root", "part", tasks.alias("tasks"))


def links_left(members: DataFrame, nodes: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links ``a`` < ``b`` between different components: every pair of ``members`` that shares a bucket is compared.

    ``members`` has ``band`` (the finer ones after the others), ``value``, ``node``, ``root``, ``size``; ``nodes`` has ``node``,
    ``total``, all ``samples``, ``sums`` and ``text``. A pair is compared in the first band that it shares, and passed over
    where links of its task have joined both already. Whole texts decide, unless total weights or the smaller sums of
    all bins already keep a pair below ``similarity``: both are bounds, so no link is lost to them. Work is quadratic in
    the buckets that stay mixed, memory is not.
    """
    shared = members.sparkSession.sparkContext.broadcast(idf)  # bounded size

    def compared(rows: list, samples: np.ndarray, sums: np.ndarray) -> list[tuple[str, str]]:
        names, parts = [r["node"] for r in rows], np.array([r["part"] for r in rows])
        totals, band = np.array([r["total"] for r in rows]), rows[0]["band"]
        codes = np.unique([r["root"] for r in rows], return_inverse=True)[1]
        parent, known, links = list(range(len(rows))), {}, []

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def profile(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in known:
                found, times = shingles(rows[i]["text"] or "")
                known[i] = found, weights(found, times, shared.value)
            return known[i]

        low, high = parts.min(), parts.max()
        right = np.flatnonzero(parts == high)
        for i in np.flatnonzero(parts == low):
            js = right[right > i] if low == high else right
            js = js[codes[js] != codes[i]]
            js = js[np.minimum(totals[js], totals[i]) >= np.maximum(totals[js], totals[i]) * (similarity - SLACK)]
            most = np.minimum(sums[js], sums[i]).sum(1, dtype=np.float64)  # what a pair can share
            js = js[most * (1 + similarity) >= (totals[js] + totals[i]) * (similarity - SLACK)]
            same = samples[js] == samples[i]
            coarse = same[:, :SAMPLES].reshape(len(js), BANDS, ROWS).all(2)
            fine = same[:, SAMPLES:].reshape(len(js), FINE_BANDS, FINE_ROWS).all(2)
            met = np.concatenate((coarse, fine), axis=1)
            for j in js[~met[:, :band].any(1)].tolist():
                a, b = top(codes[i]), top(codes[j])
                if a != b and weighted_jaccard(profile(i), profile(j)) >= similarity:
                    parent[a] = b
                    links.append((min(names[i], names[j]), max(names[i], names[j])))
        return links

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, arrays, now = [], [], None
        for batch in batches:
            links = []
            own = [batch.column(batch.schema.get_field_index(x)).flatten().to_numpy().reshape(len(batch), -1) for x in ("samples", "sums")]
            for row, *held in zip(batch.drop_columns(["samples", "sums"]).to_pylist(), *own, strict=True):
                task = (row["band"], row["value"], row["low"], row["high"])
                if task != now and rows:
                    links += compared(rows, *map(np.stack, zip(*arrays, strict=True)))
                    rows, arrays = [], []
                now = task
                rows.append(row)
                arrays.append(held)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.string()) for k in (0, 1)], names=["a", "b"])
        links = compared(rows, *map(np.stack, zip(*arrays, strict=True))) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.string()) for k in (0, 1)], names=["a", "b"])

    task = ["band", "value", "low", "high"]
    # Rows are repeated for their tasks once they are dealt by node: a large bucket is in many partitions there.
    met = blocks(members).join(nodes, "node").withColumn("t", F.explode("tasks"))
    dealt = met.select("band", "value", "t.low", "t.high", "part", "node", "root", "total", "samples", "sums", "text")
    return dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(read, "a string, b string")


def texts_of(docs: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """``node`` and the whole text of one of its documents, for ``nodes`` (``node``, ``first_id``)."""
    wanted = landed(nodes.select("node", "first_id").distinct(), "wanted")
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    # By identifier first: the words of all other texts need no digest.
    met = pinned(rows.join(wanted, F.col("id").eqNullSafe(F.col("first_id"))), ["node"], {"text": F.col("text")})
    some = met.where(words_key(F.col("text")) == F.col("node"))
    return some.groupBy("node").agg(F.max("text").alias("text"))


def ends_of(pairs: DataFrame) -> DataFrame:
    """``node`` and ``first_id`` of both ends of ``pairs``."""
    ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(f"id_{x}").alias("first_id")) for x in ("a", "b")))
    return pairs.select(F.explode(ends).alias("w")).select("w.*")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Pairs with weighted Jaccard similarity of ``similarity`` or more, by their whole texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)  # constant size

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        last: tuple[str, tuple] | None = None

        def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
            found, times = shingles(text)
            return found, weights(found, times, table)

        for batch in batches:
            good = []
            for a, text_a, text_b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                name = a.as_py()
                if last is None or last[0] != name:
                    last = (name, profile(text_a.as_py() or ""))
                good.append(weighted_jaccard(last[1], profile(text_b.as_py() or "")) >= similarity)
            chosen = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(compared, "a string, b string")


def near_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """For each row: ``id``, ``node``, ``class_id``, ``class_size`` (rows), ``kept``.

    Rows are in one class if a chain of links joins them; ``class_id`` is the least identifier in it, and ``kept``
    marks rows with that identifier and the words of the node that stays. Texts with the same words are copies,
    also null, empty and wordless texts among themselves; those are linked to nothing else. Null identifiers
    come after all others: ``class_id`` is null if all rows of a class have none. Repeated rows have equal results.
    """
    spark = docs.sparkSession
    ship(spark)
    idf = document_frequencies(docs, text, key)
    rows = landed(features(docs, key, text, idf), "features")
    nodes = landed(
        rows.groupBy("node").agg(
            F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"),
            F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.first("total").alias("total"),
        ),
        "nodes",
    )
    members = landed(buckets(nodes), "buckets")
    tried = landed(candidate_pairs(members, similarity), "likely")
    texts = landed(texts_of(docs, key, text, ends_of(tried)), "texts")
    roots = landed(components(landed(verified(tried, texts, idf, similarity), "verified")), "roots")
    # Buckets of two have been decided on whole texts.
    wide = landed(several_components(members.where("n > 2").select("band", "value", "node", "first_id"), roots).select("node", "first_id").distinct(), "wide")
    if not wide.isEmpty():
        texts = landed(texts_of(docs, key, text, wide), "texts")
        fine = landed(fine_features(texts, idf), "fine")
        own = nodes.select("node", "first_id", "total", F.col("samples").alias("__first"))
        both = fine.select("node", "bands", F.col("samples").alias("__more"), "sums").join(own, "node")
        finer = landed(buckets(both.withColumn("samples", F.concat("__first", "__more"))), "fine-buckets")
        for turn in range(TURNS):
            mixed = landed(several_components(finer, roots), "mixed")
            fresh = landed(fine_pairs(mixed, turn, FINE_AGREE, similarity).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "likely")
            if not fresh.isEmpty():
                found = landed(verified(fresh, texts, idf, similarity), "verified")
                if not found.isEmpty():
                    roots = landed(joined_components(roots, found), "roots")
                tried = landed(tried.select("a", "b").union(fresh.select("a", "b")), "tried")
        # What leaders, chains and turns left: every pair of a bucket that is still in different components.
        held = members.where("n > 2").select("band", "value", "node").union(finer.select(F.col("band") + BANDS, "value", "node"))
        whole = both.join(texts, "node").select("node", "total", F.concat("__first", "__more").alias("samples"), "sums", "text")
        lengths = texts.select("node", F.greatest(F.octet_length("text") / NODE_BYTES, F.lit(1.0)).alias("size"))
        left = landed(several_components(held, roots).join(lengths, "node").select("band", "value", "node", "root", "size"), "left")
        found = landed(links_left(left, whole, idf, similarity), "verified")
        if not found.isEmpty():
            roots = landed(joined_components(roots, found), "roots")
    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")
    sizes = classed.groupBy("root").agg(F.sum("n").alias("class_size"), F.min(best).alias("best"))
    named = classed.select("node", "root").join(sizes, "root").select("node", "class_size", "best")
    return rows.select("id", "node").join(named, "node").select(
        "id", "node", F.col("best.first_id").alias("class_id"), "class_size",
        (F.col("id").eqNullSafe(F.col("best.first_id")) & (F.col("node") == F.col("best.node"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of ``near_classes``; all columns as they were, whatever their names."""
    own, gone_id, gone_node = (hidden(docs, name) for name in ("__node", "__gone_id", "__gone_node"))
    classes = landed(near_classes(docs, key=key, text=text), "classes")
    gone = landed(classes.where(~F.col("kept")).select(F.col("id").alias(gone_id), F.col("node").alias(gone_node)).distinct(), "gone")
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = F.col(key).cast("bigint").eqNullSafe(F.col(gone_id)) & (words_key(F.col(text)) == F.col(gone_node))
    left = docs.join(gone, same, "left_anti")
    # Rows that share identifier and words were all marked as the one that stays.
    repeated = classes.where("kept").groupBy("id", "node").count().where("count > 1")
    if repeated.isEmpty():
        return left
    spare = docs.columns
    return left.withColumn(own, words_key(F.col(text))).dropDuplicates([key, own]).select(*spare)
