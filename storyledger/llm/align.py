"""Alignment of two tokenizers over whole texts, and how often their token pairs meet across a corpus.

Tokenizer A reads a space and the text, tokenizer B (sentencepiece) the text, to which it adds the space itself. The
character offsets of A and the spans of B cut a text where tokens of both end at whole characters. Tokens that
share a character, and byte-fallback tokens, have no such end of their own; theirs follow from their decoded bytes.
Where ends of both sides coincide, a group ends. Every token of A is linked with every token of B in its group.

A text is read in units, which are white space and the word that follows; a single line feed is a unit of its own. No
token of either side crosses from a word into white space, nor out of a line feed (for B this is checked in its
vocabulary), so units are aligned once and kept in a bounded table. New plain units are read together, one on each
line. A text with a unit that does not come back byte for byte is read again as a whole.

Corpus-wide counts of pairs are a plain aggregation. They go back to the documents in two parts: pairs of many
documents, at most ``HEAD`` of them by count, are broadcast; the others are joined by shuffle, and no key
of that join holds more than its share of rows. Pairs of one document need no join.

Results by case: null, empty and irreversible texts have no tokens. Repeated rows each get their row. Only
the identifier and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyledger.llm.shipping import ship
from storyledger.llm.token_counts import SPACE
from storyledger.session import landed

PLAIN = re.compile(f" ?[^{SPACE}▁]+")
PLAIN_CHARS, LINES = 256, 16_384
# Letters of the Latin blocks, and marks that end words.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?"
FEED = "\n"
BATCH_CHARS = 1 << 20
MAX_KNOWN = 300_000
HEAD = 250_000  # pairs broadcast at most: 4 MB of numbers
A_SHIFT = 32


def byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible Latin-1 as itself, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pairs(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


class Aligner:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        chars = byte_level()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(chars.get(c, 0) for c in t) for t, i in entries.items()}
        self.a_sizes = np.zeros(max(self.a_bytes, default=0) + 1, np.int64)
        for i, data in self.a_bytes.items():
            self.a_sizes[i] = len(data)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.b_is_byte, strict=True)
        ]
        self.b_sizes = np.array([len(d) for d in self.b_bytes], np.int64)
        glued = {c for p in pieces for c in re.findall(f"[^{SPACE}▁]([{SPACE}▁])", p)}
        self.cuttable = not glued & {"▁", " "} and not any(FEED in p for p in pieces)
        # A unit goes on where some entry of B holds a word's end and this kind of white space.
        after = f"(?:[{re.escape(''.join(sorted(glued)))}][{SPACE}]*[^{SPACE}]*)*" if glued else ""
        # And it ends before a mark that no entry of B holds after a letter; A splits there in any case.
        marks = "".join(c for c in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(c)}", p) for p in pieces))
        word = f"[{SPACE}]*[{LETTERS}]+(?=[{re.escape(marks)}])|" if marks else ""
        self.unit = re.compile(f"\\n(?=[^{SPACE}])|{word}[{SPACE}]*[^{SPACE}]+{after}|[{SPACE}]+")

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Identifiers of A and B in ``text`` and the byte offsets where they end; None where their bytes differ from it.

        A reads the text as it is, B reads it after a line feed, which takes the space that B adds; both leave it again.
        """
        data = text.encode()
        if len(data) == len(text):
            found, ids_b = None, np.array(self.b.encode_as_numpy(FEED + text), np.int64)
            own = self.a.encode_batch_fast([text], add_special_tokens=False)[0]
        else:
            found = self.b.encode_as_offset_mapping(FEED + text)
            ids_b = np.array(found["ids"], np.int64)
            own = self.a.encode(text, add_special_tokens=False)
        ids_a = np.array(own.ids, np.int64)
        lead = self.b_sizes[ids_b[:2]].sum() if len(ids_b) > 1 else 0
        if b"".join(map(self.b_bytes.__getitem__, ids_b.tolist())) != b" \n" + data or lead != 2:
            return None
        if b"".join(map(self.a_bytes.__getitem__, ids_a.tolist())) != data:
            return None
        ids_b = ids_b[2:]
        if found is None:
            # A character is a byte: offsets, spans and decoded bytes are the same numbers.
            return ids_a, np.cumsum(self.a_sizes[ids_a]), ids_b, np.cumsum(self.b_sizes[ids_b])
        spans_a, spans_b = _pairs(own.offsets), _pairs(found["offsets"])[2:] - 1
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at_byte = np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))))
        ends = []
        for ids, spans, sizes, loose in ((ids_a, spans_a, self.a_sizes, None), (ids_b, spans_b, self.b_sizes, self.b_is_byte)):
            end = at_byte[spans[:, 1]]
            # Tokens that share a character with the next one, and byte-fallback tokens, end where their bytes do.
            inside = np.zeros(len(ids), bool)
            inside[:-1] = spans[1:, 0] < spans[:-1, 1]
            if loose is not None:
                inside |= loose[ids]
            ends.append(np.where(inside, np.cumsum(sizes[ids]), end))
        return ids_a, ends[0], ids_b, ends[1]


@lru_cache(maxsize=1 << 18)
def _one_to_one(a: int, b: int) -> str:
    return f"{a}|{b}"


def grouped(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """End of each group, how many tokens of A and of B it has, and its text."""
    cuts = np.intersect1d(ends_a, ends_b)
    n_a = np.diff(np.searchsorted(ends_a, cuts, "right"), prepend=0)
    n_b = np.diff(np.searchsorted(ends_b, cuts, "right"), prepend=0)
    of_a, of_b = ids_a.tolist(), ids_b.tolist()
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    texts = list(map(_one_to_one, ids_a[first_a].tolist(), ids_b[first_b].tolist()))
    many = np.flatnonzero((n_a > 1) | (n_b > 1))
    for g, i, a, j, b in zip(*(x[many].tolist() for x in (np.arange(len(cuts)), first_a, n_a, first_b, n_b)), strict=True):
        texts[g] = f"{','.join(map(str, of_a[i : i + a]))}|{','.join(map(str, of_b[j : j + b]))}"
    return cuts, n_a, n_b, texts


class _Grown:
    """An array that grows by doubling."""

    def __init__(self) -> None:
        self.data, self.n = np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.zeros(max(len(self.data), len(values)), np.int64)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.data[: self.n]


class Units:
    """What the groups of a unit add up to; keeps so many units, then starts afresh."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner = aligner
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bad: set[int] = set()
        self.texts: list[str] = []
        self.sums = [_Grown() for _ in range(4)]  # tokens of A, of B, groups, links of each unit
        self.pair_ids: dict[int, int] = {}
        self.pairs, self.ids, self.times, self.stops = _Grown(), _Grown(), _Grown(), _Grown()
        self.stops.add(np.zeros(1, np.int64))

    def learn(self, units: list[str]) -> None:
        """Plain units together, the others, and any batch that does not come back whole, one by one."""
        fits = [len(u) <= PLAIN_CHARS and PLAIN.fullmatch(u) is not None for u in units]
        alone = [u for u, fit in zip(units, fits, strict=True) if not fit]
        plain = [u for u, fit in zip(units, fits, strict=True) if fit]
        for kind in ([u for u in plain if u.isascii()], [u for u in plain if not u.isascii()]):
            for at in range(0, len(kind), LINES):
                batch = kind[at : at + LINES]
                if not self._learn_lines(batch):
                    alone += batch
        for unit in alone:
            self._learn_one(unit)

    def _named(self, codes: np.ndarray) -> np.ndarray:
        """Own numbers of pairs."""
        listed = codes.tolist()
        new = list(filterfalse(self.pair_ids.__contains__, listed))
        self.pair_ids.update(zip(new, range(len(self.pair_ids), len(self.pair_ids) + len(new)), strict=True))
        self.pairs.add(np.array(new, np.int64))
        return np.fromiter(map(self.pair_ids.__getitem__, listed), np.int64, len(listed))

    def _learn_lines(self, units: list[str]) -> bool:
        read = self.aligner.read(FEED.join(units))
        if read is None:
            return False
        ids_a, ends_a, ids_b, ends_b = read
        cuts, n_a, n_b, texts = grouped(*read)
        sizes = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        stop = np.cumsum(sizes + 1) - 1
        owner = np.searchsorted(stop, cuts)
        own = cuts > stop[owner.clip(max=len(units) - 1)] - sizes[owner.clip(max=len(units) - 1)]  # not a line feed between units
        if not np.isin(stop, cuts).all():
            return False
        links = n_a * n_b
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        group = np.repeat(np.flatnonzero(own), links[own])
        within = np.arange(len(group)) - np.repeat(np.cumsum(links[own]) - links[own], links[own])
        a, b = ids_a[first_a[group] + within // n_b[group]], ids_b[first_b[group] + within % n_b[group]]
        codes, inverse = np.unique((a << A_SHIFT) + b, return_inverse=True)
        held, times = np.unique((owner[group] << 32) + self._named(codes)[inverse], return_counts=True)
        start = len(self.texts)
        self.known.update(zip(units, range(start, start + len(units)), strict=True))
        edges = np.searchsorted(owner, np.arange(len(units) + 1))
        first = edges[:-1] + ~own[edges[:-1]]
        self.texts += [";".join(texts[i:j]) for i, j in zip(first.tolist(), edges[1:].tolist(), strict=True)]
        for grown, values in zip(self.sums, (n_a, n_b, np.ones(len(cuts), np.int64), links), strict=True):
            grown.add(np.bincount(owner[own], weights=values[own], minlength=len(units)).astype(np.int64))
        self.stops.add(self.ids.n + np.searchsorted(held >> 32, np.arange(len(units)), "right"))
        self.ids.add(held & 0xFFFFFFFF)
        self.times.add(times)
        return True

    def _learn_one(self, unit: str) -> None:
        number = self.known[unit] = len(self.texts)
        read = self.aligner.read(unit)
        if read is None:
            self.bad.add(number)
            read = (np.zeros(0, np.int64),) * 4
        ids_a, _, ids_b, _ = read
        _, n_a, n_b, texts = grouped(*read)
        met: Counter[int] = Counter()
        i = j = 0
        for a, b in zip(n_a.tolist(), n_b.tolist(), strict=True):
            of_b = Counter(ids_b[j : j + b].tolist()).items()
            for x, m in Counter(ids_a[i : i + a].tolist()).items():
                for y, n in of_b:
                    met[(x << A_SHIFT) + y] += m * n
            i, j = i + a, j + b
        self.texts.append(";".join(texts))
        for grown, value in zip(self.sums, (n_a.sum(), n_b.sum(), len(texts), (n_a * n_b).sum()), strict=True):
            grown.add(np.array([value], np.int64))
        self.ids.add(self._named(np.fromiter(met, np.int64, len(met))))
        self.times.add(np.fromiter(met.values(), np.int64, len(met)))
        self.stops.add(np.array([self.ids.n], np.int64))

    def settle(self, spans: list[list[str]]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """For each list of units: sums, groups as text, pairs and how often each is linked; None if a unit is irreversible."""
        if len(self.known) > MAX_KNOWN:
            self.clear()
        new = list(dict.fromkeys(filterfalse(self.known.__contains__, chain.from_iterable(spans))))
        if new:
            self.learn(new)
        numbers = [list(map(self.known.__getitem__, span)) for span in spans]
        sizes = np.fromiter(map(len, spans), np.int64, len(spans))
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        both, occurs = np.unique((np.repeat(np.arange(len(spans)), sizes) << 32) + flat, return_counts=True)
        owner, unit = both >> 32, both & 0xFFFFFFFF
        sums = np.stack([np.bincount(owner, weights=g.all()[unit] * occurs, minlength=len(spans)).astype(np.int64) for g in self.sums], axis=1)
        stops = self.stops.all()
        start, size = stops[unit], stops[unit + 1] - stops[unit]
        place = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        times = self.times.all()[place] * np.repeat(occurs, size)
        keys, inverse = np.unique((np.repeat(owner, size) << 32) + self.ids.all()[place], return_inverse=True)
        times = np.bincount(inverse, weights=times, minlength=len(keys)).astype(np.int64)
        codes = self.pairs.all()[keys & 0xFFFFFFFF]
        edges = np.searchsorted(keys >> 32, np.arange(len(spans) + 1))
        out = []
        for i, own in enumerate(numbers):
            if self.bad and not self.bad.isdisjoint(own):
                out.append(None)
                continue
            at, to = edges[i], edges[i + 1]
            out.append((sums[i], ";".join(map(self.texts.__getitem__, own)), codes[at:to], times[at:to]))
        return out


@lru_cache(maxsize=1)
def _units(a_path: str, b_path: str) -> Units:
    return Units(Aligner(a_path, b_path))


def whole_text(aligner: Aligner, text: str) -> tuple[np.ndarray, str, np.ndarray, np.ndarray] | None:
    """The result of a text read as one unit."""
    alone = Units(aligner)
    alone._learn_one(text)
    return alone.settle([[text]])[0]


def merged(parts: list[tuple | None]) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """One result from those of consecutive parts of a text."""
    if len(parts) == 1:
        sums, text, pairs, times = parts[0]
        return sums.tolist(), text, pairs, times
    pairs, inverse = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    times = np.bincount(inverse, weights=np.concatenate([p[3] for p in parts]), minlength=len(pairs)).astype(np.int64)
    return sum(p[0] for p in parts).tolist(), ";".join(p[1] for p in parts), pairs, times


NONE = ([0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def aligned_texts(texts: Iterator[str], units: Units, batch_chars: int = BATCH_CHARS) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
    """The result of each text in order; several texts, or parts of a long one, are settled together."""
    waiting: list[tuple[str, list]] = []  # texts whose results are incomplete, with the parts so far
    spans: list[list[str]] = []
    owners: list[int] = []
    chars = 0

    def settled() -> None:
        nonlocal spans, owners, chars
        for owner, part in zip(owners, units.settle(spans), strict=True):
            waiting[owner][1].append(part)
        spans, owners, chars = [], [], 0

    def done(rows: list[tuple[str, list]]) -> Iterator[tuple]:
        for text, parts in rows:
            if parts and any(p is None for p in parts):
                whole = whole_text(units.aligner, " " + text)
                parts = [] if whole is None else [whole]
            yield merged(parts) if parts else NONE

    for text in texts:
        waiting.append((text, []))
        if not text:
            continue
        if not units.aligner.cuttable:
            waiting[-1][1].append(whole_text(units.aligner, " " + text))
        else:
            spans.append([])
            owners.append(len(waiting) - 1)
            if len(text) < batch_chars:
                spans[-1] = units.aligner.unit.findall(" " + text)
                chars += len(text)
                if chars >= batch_chars:
                    settled()
                    spans, owners = [[]], [len(waiting) - 1]
            else:
                for found in units.aligner.unit.finditer(" " + text):
                    spans[-1].append(found[0])
                    chars += len(found[0])
                    if chars >= batch_chars:
                        settled()
                        spans, owners = [[]], [len(waiting) - 1]
            if not spans[-1]:
                spans.pop(), owners.pop()
        if not spans or len(waiting) >= 4096:
            if spans:
                settled()
            yield from done(waiting)
            waiting = []
    if spans:
        settled()
    yield from done(waiting)


def aligned(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, and the ``pairs`` and ``times`` of links of each row.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``. A pair is the identifier of A above 32 bits that hold that of B; ``times``
    has how many links each pair has in the text. Executors read both tokenizer files from their paths.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_ddl = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(a_path, b_path)
        for batch in batches:
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
            ids, at = batch.column(0), 0
            held: list[tuple] = []
            size = 0

            def packed(start: int, rows: list[tuple], ids: pa.Array = ids, names: list[str] = names) -> pa.RecordBatch:
                sums = np.array([r[0] for r in rows], np.int64)
                stops = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32())
                lists = [pa.ListArray.from_arrays(stops, pa.array(np.concatenate([r[i] for r in rows]))) for i in (2, 3)]
                columns = [ids.slice(start, len(rows)), *(pa.array(sums[:, i]) for i in range(4)), pa.array([r[1] for r in rows], pa.string())]
                return pa.RecordBatch.from_arrays([*columns, *lists], names=names)

            for row in aligned_texts((t.as_py() for t in batch.column(1)), units):
                held.append(row)
                size += len(row[1]) + 16 * len(row[2])
                if size >= 1 << 23:
                    yield packed(at, held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield packed(at, held)

    ddl = f"id {id_ddl}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    return rows.mapInArrow(read, ddl)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair`` and ``docs``, the number of rows that hold it linked."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))


def with_scores(rows: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``rows`` without their pairs, with ``n_best`` and ``count_sum``. Both frames should be stored.

    ``n_best`` has the links whose pair has the highest count of all pairs of its A token; ``count_sum`` adds the counts
    of all links. ``rows`` needs a column ``row`` that numbers its rows.
    """
    total = counts.agg(F.count(F.when(F.col("docs") > 1, 1)).alias("n"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    # At most ``head`` pairs can each have the ``head``-th part of all counts.
    least = 2 if total["n"] <= head else max(2, -(-total["docs"] // head))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    # As many rows as tokenizer A has entries, at most.
    best = F.broadcast(counts.groupBy(F.shiftright("pair", A_SHIFT).alias("a")).agg(F.max("docs").alias("best")))
    often = F.broadcast(counts.where(F.col("docs") >= least))
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    each = each.join(often, "pair", "left").join(best, F.shiftright("pair", A_SHIFT) == F.col("a"))

    def summed(linked: DataFrame) -> DataFrame:
        hit = F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)
        return linked.groupBy("row").agg(F.sum(hit).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))

    if least == 2:
        sums = summed(each.withColumn("docs", F.coalesce("docs", F.lit(1))))
    else:
        some = counts.where((F.col("docs") > 1) & (F.col("docs") < least))
        rest = each.where("docs IS NULL").drop("docs").join(some, "pair", "left").withColumn("docs", F.coalesce("docs", F.lit(1)))
        parts = summed(each.where("docs IS NOT NULL")).unionByName(summed(rest))
        sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    joined = rows.select(*kept).join(sums, "row", "left")
    return joined.withColumn("n_best", F.coalesce("n_best", zero)).withColumn("count_sum", F.coalesce("count_sum", zero))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number of its own for each, landed."""
    return landed(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
