"""Lempel-Ziv fingerprints: a text is parsed into dictionary phrases, and the least hashes of the phrase set are kept.

Two texts that compress well together share phrases; the share of equal values among the least of both
signatures estimates the Jaccard likeness of the phrase sets.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 64  # values of a signature
LEAST_SPREAD = 128  # rows of each range over which a repeated row is spread
_MASK = (1 << 64) - 1
_NO_ID = -(1 << 63)
_ROWS_OUT = 256


class Parser:
    """LZ78 over bytes. ``mark`` and ``back`` return to an earlier point, so two texts can share a beginning."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}  # (node << 8 | byte) -> child << 8
        self.added: list[int] = []
        self.hashes = [0]  # of the phrase at each node; node 0 is the empty phrase
        self.node = 0

    def feed(self, data: bytes) -> None:
        following, added, hashes, node = self.next.get, self.added, self.hashes, self.node
        table = self.next
        for byte in data:
            key = node | byte
            child = following(key)
            if child is None:
                table[key] = len(hashes) << 8
                added.append(key)
                hashes.append((hashes[node >> 8] * 0x100000001B3 + byte + 1) & _MASK)
                node = 0
            else:
                node = child
        self.node = node

    def mark(self) -> tuple[int, int]:
        return len(self.added), self.node

    def back(self, mark: tuple[int, int]) -> None:
        kept, self.node = mark
        for key in self.added[kept:]:
            del self.next[key]
        del self.added[kept:], self.hashes[kept + 1 :]

    def signature(self, least: int = LEAST) -> np.ndarray:
        """The least 32-bit hashes of the phrases so far, sorted and distinct."""
        h = np.array(self.hashes[1:], dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h = ((h ^ (h >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
        if len(h) > 4 * least:
            h = np.partition(h, 2 * least)[: 2 * least]
        return np.unique(h)[:least]


def signature(text: str | None, least: int = LEAST) -> np.ndarray:
    parser = Parser()
    parser.feed((text or "").encode())
    return parser.signature(least)


def likeness(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> float:
    """Share of values that both have among the least of both; two empty signatures are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:least]
    return float(np.count_nonzero(np.isin(union, a) & np.isin(union, b))) / len(union)


def to_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


@F.arrow_udf(T.StringType())
def _fingerprint_column(texts: pa.Array) -> pa.Array:
    return pa.array([to_text(signature(t.as_py())) for t in texts], type=pa.string())


@F.arrow_udf(T.DoubleType())
def _likeness_column(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([likeness(from_text(x.as_py()), from_text(y.as_py())) for x, y in zip(a, b, strict=True)], type=pa.float64())


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text: 8 hexadecimal digits for each kept hash. Null counts as empty, which gives ''."""
    return _fingerprint_column(F.coalesce(text, F.lit("")))


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; null counts as the empty fingerprint."""
    return _likeness_column(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def _ranges(cut: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Ends of ranges (key, hash, rows), sorted, and how many ranges share the end at a place: those of a repeated row.

    Only where each of these has LEAST_SPREAD rows is the row spread, so that none of them can come out empty.
    """
    ends: list[tuple[int, int]] = []
    spread: dict[int, int] = {}
    same: dict[tuple[int, int], list[int]] = {}
    for key, h, n in cut:
        same.setdefault((key, h), []).append(n)
    for end in sorted(same):
        many = len(same[end]) - 1  # the first of them may hold rows before the repeated one
        if many > 1 and sum(same[end]) // len(same[end]) >= LEAST_SPREAD:
            spread[len(ends)] = many
            ends += [end] * many
        else:
            ends.append(end)
    return ends, spread


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and the likeness to both it and the next document.

    The next document has the next smaller id (after the last: the first); null ids come last, rows of one
    id go by a hash of their text, and of equal rows each is the other's next. Null texts count as empty. One
    row a row of ``docs``; an empty table gives none; ids are longs, other columns, whatever their names, do not count.
    Documents are dealt out by ranges of (id, hash), and each range also gets the last document of the range
    before it, so that every task reads its rows in order and holds two texts at a time. A row that is
    repeated beyond a range is spread over several, where it follows itself.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(_NO_ID)).alias("key"), F.xxhash64(text).alias("h"), F.col(id_col).alias("doc_id"), text.alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * tasks
    slim = keyed.select("key", "h").withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(buckets, "key", "h", "salt")
    cut = slim.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("key", "h")).alias("end"), F.count(F.lit(1)).alias("n")).select("end.key", "end.h", "n").collect()
    ends, spread = _ranges([(r["key"], r["h"], r["n"]) for r in cut])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(keys: pa.Array, hashes: pa.Array, salts: pa.Array) -> pa.Array:
        """The own range, and for the last row of a range also the range that follows, as -number - 1."""
        found = []
        for row in zip(keys.to_pylist(), hashes.to_pylist(), strict=True):
            at = bisect_left(ends, row)
            if ends[at] != row:
                found.append([at])
                continue
            own = at + int(salts[len(found)].as_py() % spread.get(at, 1))
            last = at + spread.get(at, 1) - 1
            found.append([own, -((last + 1) % len(ends)) - 1] if own == last else [own])
        return pa.array(found, type=pa.list_(pa.int32()))

    sent = keyed.withColumn("place", F.explode(places("key", "h", F.monotonically_increasing_id())))
    sent = sent.withColumn("range", F.when(F.col("place") < 0, -F.col("place") - 1).otherwise(F.col("place"))).withColumn("own", F.col("place") >= 0).drop("place")
    dealt = sent.repartition(tasks, "range").sortWithinPartitions("range", "own", "key", "h")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, sign = None, "", None
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("range", "own", "doc_id", "text")]
            for place, own, doc_id, text in zip(*columns, strict=True):
                place, text = place.as_py(), text.as_py()
                if place != at:
                    at, before, sign = place, None, None
                if not own.as_py():
                    before = text
                    continue
                if sign is None:  # a range of one repeated row has none before it but itself
                    before = text if before is None else before
                    sign = signature(before)
                half = len(text) // 2
                parser = Parser()
                kept, cut = text[: len(text) - half], before[:half]
                start = kept.encode()
                parser.feed(start)
                mark = parser.mark()
                parser.feed(text[len(text) - half :].encode())
                mine = parser.signature()
                parser.back(mark)
                tail = cut.encode()
                parser.feed(tail)
                other = parser.signature()
                out.append((doc_id.as_py(), len(text), hashlib.sha256(start + tail).hexdigest(), to_text(mine), to_text(other), likeness(mine, other), likeness(mine, sign)))
                before, sign = text, mine
                if len(out) >= _ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return dealt.select("range", "own", "doc_id", "text").mapInArrow(compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
