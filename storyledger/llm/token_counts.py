"""Token counts of whole texts by a tokenizer file.

Arrow batches come in; their texts are cut where no token can cross, namely between a character that is not white space
and white space that follows it, and pieces are encoded in batches of about equal bytes. Only lengths leave the
function. A piece that occurs again takes its length from a bounded table of lengths already known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyledger.llm.shipping import ship

# White space as the tokenizers' own patterns see it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BATCH_CHARS = 1 << 20
MAX_KNOWN = 400_000
MAX_KNOWN_CHARS = 64


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceLengths:
    """Lengths of pieces in tokens; keeps short ones, starts afresh when it holds too many."""

    def __init__(self, path: str) -> None:
        self.encoder = tokenizer(path)
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        encoded = self.encoder.encode_batch_fast(pieces, add_special_tokens=False)
        self.known.update(zip(pieces, map(len, encoded), strict=True))

    def totals(self, spans: list[list[str]]) -> list[int]:
        """Tokens of each list of pieces."""
        new = [p for p in dict.fromkeys(p for span in spans for p in span) if p not in self.known]
        batch, size = [], 0
        for piece in new:
            batch.append(piece)
            size += len(piece)
            if size >= BATCH_CHARS:
                self.learn(batch)
                batch, size = [], 0
        if batch:
            self.learn(batch)
        known = self.known.__getitem__
        out = [sum(map(known, span)) for span in spans]
        if len(self.known) > MAX_KNOWN:
            self.known.clear()
        else:
            for piece in new:
                if len(piece) > MAX_KNOWN_CHARS:
                    del self.known[piece]
        return out


def text_lengths(texts: Iterator[str], lengths: PieceLengths) -> list[int]:
    """Tokens of each text; pieces of several texts, or parts of a long one, are looked up together."""
    out: list[int] = []
    owners, spans, chars = [], [[]], 0

    def settle() -> None:
        for owner, n in zip(owners, lengths.totals(spans[: len(owners)]), strict=True):
            out[owner] += n

    for i, text in enumerate(texts):
        out.append(0)
        owners.append(i)
        for found in PIECE.finditer(text):
            spans[-1].append(found[0])
            chars += len(found[0])
            if chars >= BATCH_CHARS:
                settle()
                owners, spans, chars = [i], [[]], 0
        spans.append([])
    settle()
    return out


def count_tokens(docs: DataFrame, path: str, keep: list[str], *, text: str = "text", limit: int = 512) -> DataFrame:
    """``keep`` of each row with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of its whole text.

    Null texts count as empty: no bytes, no tokens. Repeated rows each get their row. ``path`` names a tokenizer
    file whose pre-tokenizer splits at white space and which has no normalizer; executors read it from there.
    """
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kept = [rows.schema[c] for c in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = PieceLengths(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(texts).cast(pa.int64())
            counts = text_lengths((t.as_py() for t in texts), lengths)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [sizes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(counted, f"{ddl}, n_bytes bigint, n_tokens bigint, over_limit boolean")
