"""Fill-in-middle transformation of whole texts, assembled by a secondary sort.

Every text is cut into prefix, middle and suffix at two positions that its identifier decides. Each row emits
pieces of bounded size, keyed by document and position in the output. Pieces are dealt by document and sorted by
position within each partition; they then stream through an incremental digest, so no task holds a document. What
streams out is read back by a parser that sees only output and form; its parts are sorted again within the same
partitions, now by their place in the text, and stream through a second digest. Texts are shuffled once.

Results by case: a null text counts as empty. Empty texts, and texts that hold a sentinel, stay plain. A null
identifier draws as the empty string. Rows that repeat identifier and text each get their row; rows that
share only the identifier are separate documents. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyledger.llm.shipping import ship

# Sentinels, and the shares of plain and of suffix-first outputs in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
SEED = "1"
# Which part follows each sentinel, by its place in the text, in the order of the output.
ORDERS = {"plain": (("", 0),), "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
PIECE = 1 << 15  # code points of a piece at most
BATCH_CHARS = 1 << 21
END = 3  # place of the row that closes a document

GROUP = ["id", "text_key", "part"]
FACTS = ["n", "form", "prefix_chars", "middle_chars"]
FACTS_DDL = "n bigint, form string, prefix_chars bigint, middle_chars bigint"


def drawn(identifier: str, text: str, seed: str = SEED) -> tuple[str, int, int]:
    """Form of the output, and where prefix and middle of ``text`` end."""
    n, digest = len(text), hashlib.sha256(f"{seed}:{identifier}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return "plain", n, n
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"), first, second


def cut(text: str, form: str, first: int, second: int, size: int = PIECE) -> Iterator[str]:
    """The output in order, in pieces of ``size`` code points at most; sentinels are pieces of their own."""
    spans = [(0, first), (first, second), (second, len(text))]
    for sentinel, part in ORDERS[form]:
        if sentinel:
            yield sentinel
        start, stop = spans[part] if sentinel else (0, len(text))
        for at in range(start, stop, size):
            yield text[at : min(at + size, stop)]
    if not text:
        yield ""


class Parser:
    """Parts of a text from the pieces of its output, by form alone; holds back at most two characters."""

    def __init__(self, form: str) -> None:
        self.order, self.step, self.held = ORDERS[form], 0, ""
        self.part = 0 if form == "plain" else None

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[int, str]]:
        """(place in the text, characters) of what ``piece`` decides."""
        data, self.held = self.held + piece, ""
        if self.part is None or self.order[0][0]:
            while self.step < len(self.order):
                sentinel, part = self.order[self.step]
                at = data.find(sentinel)
                if at < 0:
                    break
                if at and self.part is not None:
                    yield self.part, data[:at]
                data, self.part, self.step = data[at + len(sentinel) :], part, self.step + 1
            if self.step < len(self.order) and not last:
                keep = next((k for k in (2, 1) if data and self.order[self.step][0].startswith(data[-k:])), 0)
                data, self.held = data[: len(data) - keep], data[len(data) - keep :]
        if data and self.part is not None:
            yield self.part, data


class _Rows:
    """Collects rows as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.columns, self.chars = schema, [[] for _ in schema], 0

    def add(self, *values: Any) -> pa.RecordBatch | None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.chars += 64 + (len(values[-1]) if isinstance(values[-1], str) else 0)
        return self.batch() if self.chars >= BATCH_CHARS else None

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns, self.chars = [[] for _ in self.schema], 0
        return out


def _schema(id_type: pa.DataType, *rest: tuple[str, pa.DataType]) -> pa.Schema:
    head = [("id", id_type), ("text_key", pa.binary()), ("part", pa.int32())]
    facts = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    return pa.schema([*head, *facts, *rest])


def pieces(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = SEED, size: int = PIECE) -> DataFrame:
    """The transformed documents: ``id``, ``form``, lengths, and pieces sorted by ``position`` within their partition.

    All pieces of a row are in one partition, one after the other. ``part`` is the input partition of the row: many
    repeats of one row are dealt to as many groups as partitions hold them.
    """
    ship(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.unhex(F.md5(whole)).alias("text_key"), F.spark_partition_id().alias("part"), whole.alias("text"))
    id_ddl = rows.schema["id"].dataType.simpleString()

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            out = out or _Rows(_schema(batch.schema.field(0).type, ("position", pa.int32()), ("piece", pa.string())))
            ids, keys, parts = (batch.column(i).to_pylist() for i in range(3))
            for i, value in enumerate(batch.column(3)):
                own = value.as_py()
                form, first, second = drawn("" if ids[i] is None else str(ids[i]), own, seed)
                ends = (None, None) if form == "plain" else (first, second - first)
                for position, piece in enumerate(cut(own, form, first, second, size)):
                    full = out.add(ids[i], keys[i], parts[i], len(own), form, *ends, position, piece)
                    if full:
                        yield full
        if out and out.chars:
            yield out.batch()

    ddl = f"id {id_ddl}, text_key binary, part int, {FACTS_DDL}, position int, piece string"
    return rows.mapInArrow(emitted, ddl).repartition(*GROUP).sortWithinPartitions(*GROUP, "position")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def outputs(cut_pieces: DataFrame) -> DataFrame:
    """``id``, ``n``, ``form``, lengths and the whole ``output`` text of each row of ``pieces``."""
    id_ddl = cut_pieces.schema["id"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, last, copies, held = None, -1, 0, []

        def done() -> Iterator[pa.RecordBatch]:
            whole = "".join(held)
            for _ in range(copies):
                full = out.add(now[0], *now[3:7], whole)
                if full:
                    yield full

        out = None
        for batch in batches:
            if schema is None:
                names = ["id", *FACTS]
                schema = pa.schema([*(batch.schema.field(n) for n in names), pa.field("output", pa.string())])
                out = _Rows(schema)
            for row in _rows_of(iter([batch])):
                if now is None or row[:3] != now[:3]:
                    if now is not None:
                        yield from done()
                    now, last, copies, held = row, -1, 0, []
                copies += row[7] == 0
                if row[7] != last:
                    held.append(row[8])
                    last = row[7]
        if now is not None:
            yield from done()
            yield out.batch()

    return cut_pieces.mapInArrow(joined, f"id {id_ddl}, {FACTS_DDL}, output string")


def digests(cut_pieces: DataFrame) -> DataFrame:
    """``id``, ``n``, ``form``, lengths, and sha256 of output (``output_sha256``) and restored text (``restored_sha256``).

    ``cut_pieces`` comes from ``pieces``. Repeats of a row share their pieces and give a row each.
    """
    id_ddl = cut_pieces.schema["id"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts with their place in the text; a last row has the digest of the output and the number of repeats."""
        now, last, copies, count, sha, parser, out = None, -1, 0, 0, None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            full = out.add(*now[:7], END, 0, copies, sha.hexdigest())
            if full:
                yield full

        for batch in batches:
            if out is None:
                rest = [("place", pa.int32()), ("count", pa.int32()), ("copies", pa.int64()), ("piece", pa.string())]
                out = _Rows(_schema(batch.schema.field(0).type, *rest))
            for row in _rows_of(iter([batch])):
                if now is None or row[:3] != now[:3]:
                    if now is not None:
                        yield from closed()
                    now, last, copies, count, sha, parser = row, -1, 0, 0, hashlib.sha256(), Parser(row[4])
                copies += row[7] == 0
                if row[7] == last:
                    continue
                last = row[7]
                sha.update(row[8].encode("utf-8"))
                for place, part in parser.feed(row[8]):
                    full = out.add(*now[:7], place, count, None, part)
                    count += 1
                    if full:
                        yield full
        if now is not None:
            yield from closed()
            yield out.batch()

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, out = hashlib.sha256(), None
        for batch in batches:
            if out is None:
                names = ["id", *FACTS]
                ends = [pa.field("output_sha256", pa.string()), pa.field("restored_sha256", pa.string())]
                out = _Rows(pa.schema([*(batch.schema.field(n) for n in names), *ends]))
            for row in _rows_of(iter([batch])):
                if row[7] < END:
                    sha.update(row[10].encode("utf-8"))
                    continue
                for _ in range(row[9]):
                    full = out.add(row[0], *row[3:7], row[10], sha.hexdigest())
                    if full:
                        yield full
                sha = hashlib.sha256()
        if out and out.chars:
            yield out.batch()

    ddl = f"id {id_ddl}, text_key binary, part int, {FACTS_DDL}, place int, count int, copies bigint, piece string"
    resorted = cut_pieces.mapInArrow(parsed, ddl).sortWithinPartitions(*GROUP, "place", "count")
    return resorted.mapInArrow(restored, f"id {id_ddl}, {FACTS_DDL}, output_sha256 string, restored_sha256 string")
