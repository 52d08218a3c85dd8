"""Language identification by character models with interpolated Kneser-Ney smoothing.

One model of ``ORDER`` characters for each language, counted by Spark on a bounded sample of labelled rows. The models
are stored together: for each order, the sorted hashes of all n-grams that any language has, with the
interpolated log probability in every language beside them, and the same for contexts and their back-off weights. A
position of a text needs one binary search, and further ones only if no language knows the n-gram.
The language with the least cross-entropy per character wins. A text whose least cross-entropy is above what
calibration rows of that language show is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyledger.llm.shipping import ship

ORDER = 4
BITS = 16
SAMPLE_ROWS = 500  # labelled rows a language is learned from, about
CALIBRATION_ROWS = 500  # further labelled rows for the rejection level, about
MAX_LETTERS = (1 << BITS) - 2  # letters beyond so many different ones in the sample count as one unknown letter
PIECE = 1 << 19  # characters handled at once
LEAST_CALIBRATED = 50  # scored characters of a text that a rejection level is read from
QUANTILE = 0.999
SLACK = 0.5  # nats a character above the quantile
SPREAD = 8.0  # further nats, over the root of the scored characters: short texts vary more
SHARPNESS = 25.0  # characters of evidence that the score counts at most
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letters(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of ``text`` by ``table`` in pieces: runs of 0 become one, one 0 is added after the last letter.

    Each piece starts with the ``ORDER - 1`` codes before it, which are 0 at the start of the text.
    """
    before = np.zeros(ORDER - 1, table.dtype)
    for at in range(0, max(len(text), 1), PIECE):
        codes = table[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        last = np.concatenate((before[-1:], codes[:-1])) if len(codes) else codes
        kept = codes[(codes != 0) | (last != 0)]
        if at + PIECE >= len(text) and (kept[-1] if len(kept) else before[-1]) != 0:
            kept = np.append(kept, table.dtype.type(0))
        yield np.concatenate((before, kept))
        before = np.concatenate((before, kept))[-(ORDER - 1) :]


def mixed(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of packed n-grams; one to one, so equal hashes are equal n-grams."""
    z = codes.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def packed(ids: np.ndarray, n: int) -> np.ndarray:
    """N-grams that end at each of ``ids`` from the ``ORDER``-th on, first letter in the highest bits."""
    out = np.zeros(len(ids) - ORDER + 1, np.uint64)
    for back in range(n - 1, -1, -1):
        stop = len(ids) - back
        out = (out << np.uint64(BITS)) | ids[ORDER - 1 - back : stop].astype(np.uint64)
    return out


class Table:
    """Sorted hashes with a row of values each."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        hashes = mixed(codes)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order])

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``values`` of each code, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        wanted = mixed(codes)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return at, self.hashes[at] == wanted


class Model:
    """Interpolated Kneser-Ney models of several languages; ``limits`` are the rejection levels."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        self.languages = sorted(counts)
        self.limits: dict[str, float] = {}
        seen = Counter()
        for grams in counts.values():
            for gram, n in grams.items():
                seen[gram[-1]] += n
        seen.pop(" ", None)
        alphabet = sorted(sorted(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: MAX_LETTERS - 1]))
        self.unknown = len(alphabet) + 1
        self.alphabet = np.array([ord(c) for c in alphabet], np.int32)
        self._fit(counts)

    def ids(self) -> np.ndarray:
        """Letter number of each code point, 0 for what is no letter."""
        table = letter_table()
        at = np.searchsorted(self.alphabet, table)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == table if len(self.alphabet) else np.zeros(len(table), bool)
        return np.where(table == 0, 0, np.where(known, at + 1, self.unknown)).astype(np.uint16)

    def _fit(self, counts: dict[str, dict[str, int]]) -> None:
        width, n_languages = 1 << BITS, len(self.languages)
        number = {chr(c): i + 1 for i, c in enumerate(self.alphabet)} | {" ": 0}

        def code(gram: str) -> int:
            out = 0
            for char in gram:
                out = out << BITS | number.get(char, self.unknown)
            return out

        grams = {lang: Counter() for lang in self.languages}
        for lang in self.languages:
            for gram, n in counts[lang].items():
                grams[lang][code(gram)] += n
        # Counts of the highest order, and below it the number of distinct letters before an n-gram.
        by_order: dict[int, list[dict[int, int]]] = {ORDER: [grams[lang] for lang in self.languages]}
        for n in range(ORDER - 1, 0, -1):
            mask = (1 << (BITS * n)) - 1
            by_order[n] = [Counter(g & mask for g in higher) for higher in by_order[n + 1]]
        self.grams: list[Table] = []
        self.contexts: list[Table] = []
        lower = np.full((1, n_languages), 1.0 / (self.unknown + 1))
        below: dict[int, int] = {0: 0}
        for n in range(1, ORDER + 1):
            union = sorted(set().union(*by_order[n]))
            place = {g: i for i, g in enumerate(union)}
            count = np.zeros((len(union), n_languages))
            for i, table in enumerate(by_order[n]):
                count[[place[g] for g in table], i] = list(table.values())
            heads = sorted({g // width for g in union})
            head_place = {h: i for i, h in enumerate(heads)}
            head = np.array([head_place[g // width] for g in union], np.int64)
            ones, twos = (count == 1).sum(0), (count == 2).sum(0)
            discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
            discount = np.clip(discount, 0.1, 0.9)
            total, kinds = np.zeros((len(heads), n_languages)), np.zeros((len(heads), n_languages))
            np.add.at(total, head, count)
            np.add.at(kinds, head, count > 0)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            tail = (1 << (BITS * (n - 1))) - 1
            shorter = lower[[below[g & tail] for g in union]]
            prob = np.maximum(count - discount, 0) / np.maximum(total[head], 1) + back[head] * shorter
            self.grams.append(Table(np.array(union, np.uint64), np.log(prob).astype(np.float32)))
            self.contexts.append(Table(np.array(heads, np.uint64), np.log(back).astype(np.float32)))
            lower, below = prob, place
        self.floor = np.float32(np.log(1.0 / (self.unknown + 1)))

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Log probability in each language of each letter after the first ``ORDER - 1``."""
        out = np.zeros((len(ids) - ORDER + 1, len(self.languages)), np.float32)
        open_ = None  # places not settled by a longer n-gram
        for n in range(ORDER, 0, -1):
            codes = packed(ids, n) if open_ is None else codes[keep] & np.uint64((1 << (BITS * n)) - 1)
            at, found = self.grams[n - 1].find(codes)
            if open_ is None:
                open_ = np.arange(len(codes))
            out[open_[found]] += self.grams[n - 1].values[at[found]]
            keep = ~found
            open_ = open_[keep]
            if not len(open_):
                break
            back, known = self.contexts[n - 1].find(codes[keep] >> np.uint64(BITS))
            out[open_[known]] += self.contexts[n - 1].values[back[known]]
            if n == 1:
                out[open_] += self.floor
        return out


class Detector:
    """Sums over whole texts by a model."""

    def __init__(self, model: Model, table: np.ndarray) -> None:
        self.model, self.table = model, table

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the log probability in each language, the scored characters and the letters."""
        total = np.zeros((len(texts), len(self.model.languages)))
        scored, alphas = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def settle() -> None:
            ids = np.concatenate(held)
            logs = self.model.log_probabilities(ids)
            ends = np.cumsum([len(h) for h in held])
            starts = ends - np.array([len(h) for h in held])
            for start in starts[1:]:  # n-grams over the seam of two texts
                logs[start - ORDER + 1 : start] = 0
            parts = np.add.reduceat(logs, np.minimum(starts, len(logs) - 1), axis=0, dtype=np.float64)
            np.add.at(total, owners, parts)

        for i, text in enumerate(texts):
            for ids in letters(text, self.table):
                if len(ids) == ORDER - 1:
                    continue
                held.append(ids)
                owners.append(i)
                scored[i] += len(ids) - ORDER + 1
                alphas[i] += np.count_nonzero(ids[ORDER - 1 :])
                size += len(ids)
                if size >= PIECE:
                    settle()
                    held, owners, size = [], [], 0
        if held:
            settle()
        return total, scored, alphas

    def judge(self, texts: list[str]) -> list[pa.Array]:
        """Columns of ``OUT`` for ``texts``."""
        total, scored, alphas = self.sums(texts)
        names = self.model.languages
        if not names:
            none = pa.nulls(len(texts), pa.float64())
            return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts))), none, pa.array(scored), pa.array(alphas == 0)]
        entropy = -total / np.maximum(scored, 1)[:, None]
        best = entropy.argmin(1)
        least = entropy.min(1)
        gap = (entropy - least[:, None]) * np.minimum(scored, SHARPNESS)[:, None]
        score = np.where(alphas > 0, 1.0 / np.exp(-gap).sum(1), 0.0)
        # A language without a level of its own has the highest of the others.
        pooled = max(self.model.limits.values(), default=np.inf)
        limit = np.array([self.model.limits.get(n, pooled) for n in names])[best]
        allowed = limit + SPREAD / np.sqrt(np.maximum(scored, 1))
        rejected = (alphas == 0) | (least > allowed)
        named = [names[b] if a else UNKNOWN for b, a in zip(best, alphas, strict=True)]
        return [pa.array(named), pa.array(score), pa.array(np.where(alphas > 0, least, np.nan), from_pandas=True), pa.array(scored), pa.array(rejected)]


OUT = "lang_pred string, score double, cross_entropy double, n_scored bigint, rejected boolean"


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``OUT``; columns of these names are replaced.

    The text alone decides. ``lang_pred`` is ``und``, with score 0 and ``rejected``, for null texts and texts without a
    letter. Ties go to the first language in sorted order. Every other text gets a language, also a rejected one.
    """
    ship(docs.sparkSession)
    names = [part.split()[0] for part in OUT.split(", ")]
    rows = docs.drop(*names)
    at = rows.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.ids()))  # bounded by the sample

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(*shared.value)
        for batch in batches:
            found = detector.judge([t.as_py() or "" for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *names])

    return rows.mapInArrow(judged, T.StructType([*rows.schema, *T.StructType.fromDDL(OUT)]))


def count_grams(sample: DataFrame) -> dict[str, dict[str, int]]:
    """N-grams of ``ORDER`` characters of ``lang``, ``text`` rows, counted for each language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        found: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for codes in letters(text or "", table):
                    flat = np.where(codes == 0, 32, codes).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                    found.update((lang, flat[i : i + ORDER]) for i in range(len(flat) - ORDER + 1))
        rows = [{"lang": k[0], "gram": k[1], "n": n} for k, n in found.items()]
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ship(sample.sparkSession)
    counts: dict[str, dict[str, int]] = {}
    totals = sample.select("lang", "text").mapInArrow(counted, "lang string, gram string, n bigint")
    for lang, gram, n in totals.groupBy("lang", "gram").agg(F.sum("n")).collect():  # bounded by the sample
        counts.setdefault(lang, {})[gram] = n
    return counts


def fit(
    labelled: DataFrame, key: Column, *, sample_rows: int = SAMPLE_ROWS, calibration_rows: int = CALIBRATION_ROWS
) -> Model:
    """A model from ``lang``, ``text`` rows; rows of null ``lang`` are ignored.

    About ``sample_rows`` rows of each language, picked by a hash of ``key``, are learned from, and about
    ``calibration_rows`` others set the level above which a text is rejected. No rows give a model that knows no language.
    """
    rows = labelled.where(F.col("lang").isNotNull()).withColumn("__dice", F.pmod(F.xxhash64(key.cast("string"), F.lit("language")), F.lit(1_000_000)))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    learn = cal = F.lit(False)
    for lang, n in sizes.items():
        part = min(0.7, sample_rows / n)  # some rows are always left for calibration
        until = min(1.0, part + calibration_rows / n)
        own = F.col("lang") == lang
        learn = learn | (own & (F.col("__dice") < int(part * 1_000_000)))
        cal = cal | (own & F.col("__dice").between(int(part * 1_000_000), int(until * 1_000_000)))
    model = Model(count_grams(rows.where(learn)))
    judged = identify(rows.where(cal).select("lang", "text"), model)
    levels = judged.where(F.col("n_scored") >= LEAST_CALIBRATED).groupBy("lang_pred").agg(F.percentile("cross_entropy", F.lit(QUANTILE)))
    model.limits = {lang: level + SLACK for lang, level in levels.collect()}
    return model


def accepted(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is rejected; learned from two thirds of their labels.

    All columns come back as they were, whatever their names.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    model = fit(rows.where(~held_out(F.col("key"))), F.col("key"))
    judged = identify(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")), model)
    return judged.where(~F.col("rejected")).select("row.*")


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: ``crc32`` of the key as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1
