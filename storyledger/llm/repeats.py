"""Removal of byte strings that a corpus repeats, by bounded interval expansion on Burrows-Wheeler transforms.

A string of ``length`` bytes is repeated if it starts at two places, of one document or of two; matches never cross documents.

1. Every window of ``length`` bytes goes to the hash of its least ``GRAM``-byte gram (its key), which its content alone
   decides, so all places of one string have one key. Consecutive windows with the same gram are one section.
2. A key with one section has no repeat. A key whose sections all have the same bytes has nothing but repeats. Both
   are settled by counts. Only keys with unlike sections need their bytes.
3. Unlike sections of a key meet in one task, equal ones folded. Their Burrows-Wheeler transform is extended
   backwards, breadth first: intervals of strings of growing length give the common prefixes of neighbouring suffixes
   by increasing value, and the expansion stops at ``length``. Neighbours that are still undecided share that many bytes.
4. A key with more than ``MOST`` unlike sections (a passage in very many documents, at its edges) is spread by the
   digests of its windows instead, which fold before they are shuffled.

Sections are found by counts that fold before the shuffle and by joins whose skewed partitions are split at run time; texts
are dealt once, into buckets that the two later joins read in place.

Results by case: a null text counts as empty and loses nothing, nor does one shorter than ``length``. Repeated rows
repeat each other, so those of ``length`` bytes or more lose all. Only the identifier and the text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyledger.llm.shingles import mix
from storyledger.llm.shipping import ship
from storyledger.session import landed, work_dir

LENGTH = 200
GRAM = 32
MOST = 4_096
SLICE = 1 << 18  # bytes handled at once
INDEX_BYTES = 1 << 21  # bytes of sections in one transform; more only if one key has more
OUT_BYTES = 1 << 23
PLACE_BITS = 20
SYMBOL_BITS, PACKED = 9, 7
U = np.uint64


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base, size = 0x9E3779B97F4A7C15, SLICE * 2
    powers = np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)
    return powers, np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)


def _least_grams(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the least gram of every window, the leftmost of equal ones, and the hash of every gram."""
    powers, inverse = _powers()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + U(1)) * powers[: len(data)], dtype=np.uint64)))
    n = len(data) - gram + 1
    hashes = mix((sums[gram:] - sums[:n]) * inverse[:n])
    mask = U((1 << PLACE_BITS) - 1)
    least = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & mask).astype(np.int64), hashes


def sections(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and key of every maximal run of windows that have the same least gram."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts, grams, keys = [], [], []
    step = SLICE - length
    for at in range(0, len(data) - length + 1, step):
        own = data[at : min(at + step + length - 1, len(data))]
        places, hashes = _least_grams(own, length, gram)
        edges = np.flatnonzero(np.diff(places, prepend=-1))
        starts.append(edges + at)
        grams.append(places[edges] + at)
        keys.append(hashes[places[edges]])
    start, place, key = np.concatenate(starts), np.concatenate(grams), np.concatenate(keys)
    first = np.diff(place, prepend=-1) != 0  # a run that goes on in the next slice
    start, key = start[first], key[first].view(np.int64)
    stop = np.append(start[1:], len(data) - length + 1) + length - 1
    return start, stop, key


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places of ``symbols`` in the order of what follows them, to ``length`` symbols at least, by doubling."""
    n = len(symbols)
    packed, padded = np.zeros(n, np.uint64), np.append(symbols.astype(np.uint64), np.zeros(PACKED, np.uint64))
    for i in range(PACKED):
        packed = (packed << U(SYMBOL_BITS)) | padded[i : n + i]
    order = np.argsort(packed)
    rank, slots, keys, known = np.zeros(n, np.int64), np.arange(n), packed[order], PACKED
    members = order
    while True:
        edge = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        rank[members] = slots[np.maximum.accumulate(np.where(edge, np.arange(len(slots)), 0))]
        alone = edge & np.append(edge[1:], True) if len(edge) else edge
        slots, members = slots[~alone], members[~alone]
        if known >= length or not len(slots):
            return order
        ahead = members + known
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = rank[members] * (n + 1) + following
        again = np.argsort(keys)
        members, keys = members[again], keys[again]
        order[slots] = members
        known *= 2


def short_prefixes(bwt: np.ndarray, length: int) -> np.ndarray:
    """For each row but the first whether it shares fewer than ``length`` symbols with the row above; one more at the end.

    Level by level, every interval of rows that begin with one string is extended by each symbol before it. Where an
    extended interval ends, the common prefix with the next row is as long as the string; an interval goes on
    only if it is the first to end there.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    after, before = np.full(n, n), np.full(n, -1)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    decided = np.zeros(n + 1, bool)
    decided[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(length):
        if not len(low):
            break
        size = high - low + 1
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)
        last, first = after[rows] > high[owner], before[rows] < low[owner]
        alone, last, first = step[rows[last & first]], last & ~first, first & ~last
        ends, starts = step[rows[last]], step[rows[first]]
        # Both in the order of interval and symbol.
        ends = ends[np.argsort(owner[last] * n + ends)]
        starts = starts[np.argsort(owner[first] * n + starts)]
        low, high = np.concatenate((alone, starts)), np.concatenate((alone, ends))
        fresh = ~decided[high + 1]
        low, high = low[fresh], high[fresh]
        decided[high + 1] = True
    return decided


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Starts of those windows of each part that start at another place of the parts too."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = data.astype(np.uint16) + np.uint16(1)
    symbols[ends] = 0
    order = suffix_order(symbols, length)
    decided = short_prefixes(symbols[order - 1], length)
    open_rows = np.flatnonzero(~decided)
    starts = np.unique(np.concatenate((order[open_rows], order[open_rows - 1])))
    owner = np.searchsorted(ends, starts)
    # A window that reaches over the end of its part is none.
    fits = starts + length <= ends[owner]
    starts, owner = starts[fits], owner[fits]
    edges = np.searchsorted(owner, np.arange(len(parts) + 1))
    return [starts[edges[i] : edges[i + 1]] - (ends[i] - sizes[i]) for i in range(len(parts))]


def joined_spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs, in order."""
    if not len(starts):
        return starts, stops
    by_start = np.argsort(starts, kind="stable")
    starts, reach = starts[by_start], np.maximum.accumulate(stops[by_start])
    fresh = np.append(True, starts[1:] > reach[:-1])
    return starts[fresh], reach[np.append(fresh[1:], True)]


def found_sections(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``key``, ``content`` (digest of the bytes), ``row``, ``start`` and ``size`` of all sections of ``rows``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "content", "row", "start", "size"]
        for batch in batches:
            held, digests, count = [], [], 0

            def packed(held: list, digests: list) -> pa.RecordBatch:
                keys, owners, starts, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
                columns = [keys, np.array(digests, np.uint64).view(np.int64), owners, starts.astype(np.int32), sizes.astype(np.int32)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = memoryview(text.as_buffer()) if text.as_buffer() else b""
                start, stop, key = sections(np.frombuffer(buffer, np.uint8), length, gram)
                if not len(start):
                    continue
                held.append((key, np.full(len(start), row, np.int64), start, stop - start))
                digests += [xxhash.xxh3_64_intdigest(buffer[i:j]) for i, j in zip(start.tolist(), stop.tolist(), strict=True)]
                count += len(start)
                if count >= 1 << 17:
                    yield packed(held, digests)
                    held, digests, count = [], [], 0
            if held:
                yield packed(held, digests)

    return rows.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(
        found, "key bigint, content bigint, row bigint, start int, size int"
    )


def _spans_batch(rows: list[int], starts: list[np.ndarray], stops: list[np.ndarray]) -> pa.RecordBatch:
    owner = np.repeat(np.array(rows, np.int64), [len(s) for s in starts])
    columns = [owner, np.concatenate(starts).astype(np.int32), np.concatenate(stops).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "start", "stop"])


def indexed_spans(unlike: DataFrame, length: int) -> DataFrame:
    """Repeated spans (``row``, ``start``, ``stop``) of sections that occur once, from transforms of whole keys.

    ``unlike`` has ``key``, ``n`` (how often the bytes occur), ``row``, ``start`` and ``data``.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, now = 0, None

        def settled() -> Iterator[pa.RecordBatch]:
            rows, starts, stops = [], [], []
            for (n, row, at, _), windows in zip(held, repeated_windows([h[3] for h in held], length), strict=True):
                if n == 1 and len(windows):
                    own = joined_spans(windows, windows + length)
                    rows.append(row), starts.append(own[0] + at), stops.append(own[1] + at)
            if rows:
                yield _spans_batch(rows, starts, stops)

        for batch in batches:
            for key, n, row, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now and size >= INDEX_BYTES:
                    yield from settled()
                    held, size = [], 0
                now = key
                held.append((n, row, at, data))
                size += len(data) + 1
        if held:
            yield from settled()

    dealt = unlike.select("key", "n", "row", "start", "data").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(found, "row bigint, start int, stop int")


def window_spans(unlike: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many sections, by digests of all their windows."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, int, int]] = []
            for n, row, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(xxhash.xxh3_128_digest(data[i : i + length]), n, row, at + i) for i in range(len(data) - length + 1)]
            digest, n, row, start = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(row, pa.int64()), pa.array(start, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "row", "start"])

    windows = unlike.select("n", "row", "start", "data").mapInArrow(digested, "digest binary, n bigint, row bigint, start int")
    often = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest")
    single = windows.where("n = 1")
    return single.join(often, "digest").select("row", "start", (F.col("start") + length).alias("stop"))


def dealt_by_row(rows: DataFrame) -> DataFrame:
    """``rows`` in buckets by ``row`` in the shared folder, so that joins by ``row`` read them in place.

    The table leaves the catalog at once; the frame keeps its files and their buckets.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"repeats_{uuid.uuid4().hex[:12]}"
    writer = rows.repartition(n, "row").write.format("parquet").option("compression", "zstd").bucketBy(n, "row")
    writer.option("path", work_dir(spark, "repeats-rows")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def repeated_spans(store: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``row``, ``start`` and ``stop`` of spans of repeated bytes, overlapping, for ``store`` (``row``, ``text``)."""
    every = landed(found_sections(store, length, gram), "sections")
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("content") != F.max("content")).alias("unlike"))
    # Landed, so that both sides of the join are shuffled for it and skewed partitions of sections can be split.
    keys = landed(keys.where("n > 1").select("key", "unlike"), "shared-keys")
    shared = landed(every.join(keys, "key"), "shared-sections")
    place = F.struct("row", "start", "size")
    distinct = shared.where("unlike").groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    distinct = landed(distinct.select("key", "content", "n", "place.*"), "distinct-sections")
    stop = (F.col("start") + F.col("size")).alias("stop")
    equal = shared.where("NOT unlike").select("row", "start", stop)
    copies = shared.where("unlike").join(distinct.where("n > 1").select("key", "content"), ["key", "content"]).select("row", "start", stop)
    wanted = distinct.groupBy("row").agg(F.collect_list(F.struct("key", "n", "start", "size")).alias("sections"))
    data = F.col("text").cast("binary")
    cut = F.transform("sections", lambda s: F.struct(s["key"].alias("key"), s["n"].alias("n"), s["start"].alias("start"), F.substr(data, s["start"] + 1, s["size"]).alias("data")))
    unlike = landed(store.join(wanted, "row").select("row", F.explode(cut).alias("s")).select("row", "s.*"), "unlike-sections")
    large = landed(distinct.groupBy("key").count().where(F.col("count") > most).select("key"), "large-keys")
    if large.isEmpty():
        parts = [indexed_spans(unlike, length)]
    else:
        parts = [indexed_spans(unlike.join(large, "key", "left_anti"), length), window_spans(unlike.join(large, "key"), length)]
    spans = equal.union(copies)
    for part in parts:
        spans = spans.union(part)
    return spans


def without_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST
) -> DataFrame:
    """``id``, ``n_bytes``, ``spans`` (removed runs: ``start``, ``stop``) and the ``kept`` bytes of each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_ddl = rows.schema["id"].dataType.simpleString()
    store = dealt_by_row(rows)
    removed = repeated_spans(store.select("row", "text"), length, gram, most)
    per_row = removed.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = store.join(per_row, "row", "left").select("id", F.col("text").cast("binary").alias("text"), "starts", "stops")
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, size, columns = batch.column(0), 0, 0, ([], [], [])

            def packed(start: int, columns: tuple, ids: pa.Array = ids) -> pa.RecordBatch:
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(span)), pa.array(columns[2], pa.binary())]
                return pa.RecordBatch.from_arrays([ids.slice(start, len(columns[0])), *arrays], names=["id", "n_bytes", "spans", "kept"])

            for data, starts, stops in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                whole = data.as_py()
                runs = joined_spans(np.array(starts.as_py() or [], np.int64), np.array(stops.as_py() or [], np.int64))
                own = list(zip(runs[0].tolist(), runs[1].tolist(), strict=True))
                left = b"".join(whole[i:j] for i, j in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(whole)], strict=True))
                for column, value in zip(columns, (len(whole), [{"start": a, "stop": b} for a, b in own], left), strict=True):
                    column.append(value)
                size += len(left) + 64
                if size >= OUT_BYTES:
                    yield packed(at, columns)
                    at, size, columns = at + len(columns[0]), 0, ([], [], [])
            if columns[0]:
                yield packed(at, columns)

    ddl = f"id {id_ddl}, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"
    return joined.mapInArrow(kept, ddl)
