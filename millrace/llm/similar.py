"""SimHash near-duplicates by word-shingle similarity, for links wider than a Hamming ball of a few bits.

64-bit SimHashes go through the vantage-point tree of ``simhash``, which proposes every two texts within two
bits. At a Jaccard similarity of 0.8 a 64-bit SimHash differs in about 9 bits and in up to 17, where a tree of
Hamming balls overlaps everywhere and prunes nothing. For these links shards are cut by shared minimum hashes
besides: texts this similar share one of sixteen with a probability over 0.99998. Inside a shard the distances
to a vantage point prune pairs by the triangle bound, and 1,024-bit SimHashes propose what may be similar,
with a margin of about five times their spread. The whole sets of shingles decide, among texts that
proposals connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.simhash import _hashes, components, links
from millrace.session import pinned

LANES = 16  # words of 64 bits in a sketch
BANDS, TOGETHER = 16, 3  # keys, and minimum hashes of a key
FEW, SOME = 24, 37  # up to FEW shingles only the set is kept, up to SOME both, beyond only the sketch
SLACK = 0.12  # of the similarity, for the spread of the estimate: what it proposes is compared exactly
MOST_BITS = 2  # between the 64-bit SimHashes that the tree links
MOST_IN_SHARD = 16_384
MOST_SHINGLES = 4_000_000  # of the sets that are compared in one task
SMALL = 200_000

_rng = np.random.default_rng(512)
_SPREAD = _rng.integers(0, 2**63, LANES, dtype=np.uint64) | np.uint64(1)
_ORDERS = _rng.integers(0, 2**63, BANDS * TOGETHER, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 16_384
_TOGETHER = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(np.array(_hashes(text or b"", size), dtype=np.uint64))


def kind_of(shingles: np.ndarray) -> int:
    total = np.append(_mixed(shingles), np.array([len(shingles)], np.uint64) * _MIX).sum(dtype=np.uint64, keepdims=True)
    return int(_mixed(total).view(np.int64)[0])


def fingerprint(shingles: np.ndarray) -> int:
    """64-bit SimHash, signed, of a set of shingles: one where over half of them have a one. No shingles: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        ones += np.unpackbits(shingles[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")[0])


def profile(text: bytes | None, size: int) -> tuple[int, int, list[int], bytes]:
    """(class, number of distinct shingles, band keys, sketch and/or set). Texts with the same shingles have one class."""
    return _profile(shingle_set(text, size))


def _profile(shingles: np.ndarray) -> tuple[int, int, list[int], bytes]:
    count = len(shingles)
    if not count:
        return 0, 0, [0], b""
    kind = kind_of(shingles)
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros(LANES * 64, np.int64)
    for at in range(0, count, _CHUNK):
        part = shingles[at : at + _CHUNK]
        least = np.minimum(least, _mixed(part[None, :] * _ORDERS[:, None]).min(axis=1))
        if count > FEW:
            bits = np.unpackbits(_mixed(part[:, None] * _SPREAD).view(np.uint8).reshape(len(part), -1), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
    rows = least.reshape(BANDS, TOGETHER)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(TOGETHER):
        keys = _mixed(keys * _MIX + rows[:, i])
    sketch = np.packbits(ones * 2 > count).tobytes() if count > FEW else b""
    return kind, count, keys.view(np.int64).tolist(), sketch + (shingles.astype("<u8").tobytes() if count <= SOME else b"")


_PROFILE = T.StructType([T.StructField("kind", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType()), T.StructField("fp", T.LongType())])


def profiles(text: Column, size: int) -> Column:
    kind = pa.struct([("kind", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("data", pa.binary()), ("fp", pa.int64())])

    @F.arrow_udf(_PROFILE)
    def of(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py(), size) for t in texts.cast(pa.binary()))
        return pa.array([dict(zip(("kind", "n", "keys", "data", "fp"), (*_profile(s), fingerprint(s)), strict=True)) for s in sets], type=kind)

    return of(F.coalesce(text, F.lit("")))


def whole_sets(text: Column, size: int) -> Column:
    """(class, all shingles) of a text, sorted, eight bytes each."""

    @F.arrow_udf(T.StructType([T.StructField("kind", T.LongType()), T.StructField("whole", T.BinaryType())]))
    def of(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), size) for t in texts.cast(pa.binary())]
        return pa.array([{"kind": kind_of(s), "whole": s.astype("<u8").tobytes()} for s in sets], type=pa.struct([("kind", pa.int64()), ("whole", pa.binary())]))

    return of(text)


def similarity(distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets of sizes a and b whose sketches differ in ``distance`` bits: the angle gives the overlap."""
    shared = np.cos(np.pi * distance / (LANES * 64)) * np.sqrt(a * b)
    return shared / (a + b - shared)


class Shard:
    """Texts that share a key: number of shingles, sketch, set. With the whole sets, what the sketches propose is compared exactly."""

    def __init__(self, count: np.ndarray, data: list[bytes], least: float, whole: list[bytes] | None = None) -> None:
        self.count, self.least = count.astype(np.float64), least
        width = LANES * 8
        self.sketches = np.zeros((len(data), LANES), np.uint64)
        for i, (n, d) in enumerate(zip(count.tolist(), data, strict=True)):
            if n > FEW:
                self.sketches[i] = np.frombuffer(d[:width], np.uint64)
        sets = [np.frombuffer(d[width if n > FEW else 0 :], "<u8") if n <= SOME else np.array([], "<u8") for n, d in zip(count.tolist(), data, strict=True)]
        self.flat = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.sets = sets
        self.whole = whole and [np.frombuffer(w, "<u8") for w in whole]
        # no two texts of the similarity differ in more bits, whatever their sizes
        cos = 2 * (least - SLACK) / (1 + least - SLACK)
        self.most = math.ceil(LANES * 64 * math.acos(min(1.0, cos)) / math.pi)
        big = np.flatnonzero(count > FEW)
        self.vantage = self.distance(big[0], np.arange(len(data))) if len(big) else np.zeros(len(data), np.int64)

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.sketches[others] ^ self.sketches[x]).sum(axis=1, dtype=np.int64)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Mask of ``others`` that are as similar to x as asked."""
        n, found = self.count[x], np.zeros(len(others), bool)
        fits = (self.count[others] >= n * self.least - 1e-9) & (self.count[others] * self.least <= n + 1e-9)
        if n <= SOME:
            exact = fits & (self.count[others] <= SOME)
            if exact.any():
                common = np.bincount(self.owner[np.isin(self.flat, self.sets[x])], minlength=len(self.count))[others]
                found |= exact & (common >= self.least * (n + self.count[others] - common) - 1e-9)
            fits &= ~exact
        if n > FEW:
            fits &= (self.count[others] > FEW) & (np.abs(self.vantage[others] - self.vantage[x]) <= self.most)
            at = np.flatnonzero(fits)
            d = self.distance(x, others[at])
            at = at[(d <= self.most) & (similarity(d, n, self.count[others[at]]) >= self.least - SLACK)]
            found[at] = True if self.whole is None else self.same(x, others[at])
        return found

    def same(self, x: int, others: np.ndarray) -> np.ndarray:
        """Mask of ``others`` whose whole sets are as similar to that of x as asked."""
        own, sizes = self.whole[x], np.array([len(self.whole[y]) for y in others], np.int64)
        found = np.zeros(len(others), bool)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(others):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, side="right")))
            flat = np.concatenate([self.whole[y] for y in others[at:end]])
            there = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(there, np.cumsum(sizes[at:end]) - sizes[at:end], dtype=np.int64)
            found[at:end] = common >= self.least * (len(own) + sizes[at:end] - common) - 1e-9
            at = end
        return found

    def forest(self) -> list[tuple[int, int]]:
        """Edges that connect what is similar, directly or by others: one less than texts in each group."""
        edges, left = [], np.arange(len(self.count))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = self.near(x, left)
                if hit.any():
                    new = left[hit].tolist()
                    left = left[~hit]
                    edges += [(x, y) for y in new]
                    queue += new
        return edges


def _linked(least: float):
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may begin in one batch and end in a later one."""
        held: list[pa.RecordBatch] = []

        def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            marks = np.stack([rows.column(n).to_numpy().astype(np.int64) for n in ("key", "i", "j")])
            starts = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))
            ends = np.append(starts[1:], rows.num_rows)
            shared = ends - starts > 1
            kinds, counts, data = rows.column("kind").to_numpy(), rows.column("n").to_numpy(), rows.column("data")
            whole = rows.column("whole") if "whole" in rows.column_names else None
            a, b = [], []
            for start, end in zip(starts[shared].tolist(), ends[shared].tolist(), strict=True):
                own = kinds[start:end]
                sets = whole and whole.slice(start, end - start).to_pylist()
                for x, y in Shard(counts[start:end], data.slice(start, end - start).to_pylist(), least, sets).forest():
                    a.append(own[x])
                    b.append(own[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(batch.column(i)[-1].as_py() for i in range(3))
            marks = [batch.column(i).to_numpy() for i in range(3)]
            other = np.flatnonzero((marks[0] != last[0]) | (marks[1] != last[1]) | (marks[2] != last[2]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from edges(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and tuple(held[-1].column(i)[-1].as_py() for i in range(3)) != last:
                yield from edges(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from edges(pa.Table.from_batches(held))

    return connect


def _found(rows: DataFrame, heavy: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) inside each key of ``rows``. Keys of ``heavy`` (key, blocks) are dealt out as pairs of blocks."""
    heavy = pinned(heavy)
    if heavy.count() <= SMALL:
        heavy = F.broadcast(heavy)
    block = F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    cells = rows.join(heavy, "key", "left").withColumn("cell", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select("key", "cell.i", "cell.j", *[c for c in rows.columns if c != "key"]).repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_linked(least), "a bigint, b bigint")


def tree_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect classes (kind, fp) whose SimHashes differ in MOST_BITS or fewer, by the vantage-point tree."""
    points = pinned(classes.groupBy("fp").agg(F.min("kind").alias("rep")))
    same = classes.join(points, "fp").filter("kind <> rep").select(F.col("kind").alias("a"), F.col("rep").alias("b"))
    named = lambda end: points.select(F.col("fp").alias(end), F.col("rep").alias(f"{end}_kind"))
    found = links(points.select("fp"), MOST_BITS).join(named("a"), "a").join(named("b"), "b")
    return same.unionByName(found.select(F.col("a_kind").alias("a"), F.col("b_kind").alias("b")))


def band_links(classes: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between classes (kind, n, keys, data) that share a key, where the sketches do not rule out ``least``."""
    bands = classes.select("kind", "n", "data", F.explode("keys").alias("key"))
    large = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > MOST_IN_SHARD).select("key", F.ceil(F.col("m") / (MOST_IN_SHARD // 2)).cast("int").alias("blocks"))
    return _found(bands, large, least)


def similar_documents(docs: DataFrame, text_col: str = "text", size: int = 5, least: float = 0.8, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., kind, root): rows whose texts share ``least`` of their word shingles, directly or by others, have one root.

    Shingles are sets, of A-Z lower-cased words between ASCII white space; a text of fewer words is one shingle,
    and texts without words, null ones included, form one group. Equal sets are one class before the
    search, so copies cost nothing. The tree, keys and sketches only tell which classes may belong together; inside
    such a group the whole sets are compared, each made from one text of its class. A shard that outgrows
    MOST_IN_SHARD, or a group that outgrows MOST_SHINGLES, is dealt out as pairs of blocks. A pair of 0.8 is
    compared with a probability of about 0.9999, and more above; what is compared is decided exactly.
    An empty table gives no rows.
    """
    text = F.col(text_col)
    own = pinned(docs.select(*keep, F.xxhash64(text).alias("_mr_same"), profiles(text, size).alias("p")).select(*keep, "_mr_same", "p.*"))
    classes = pinned(own.groupBy("kind").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("data").alias("data"), F.first("fp").alias("fp"), F.min("_mr_same").alias("_mr_same")))
    worded = classes.filter("n > 0")
    groups = components(tree_links(worded).unionByName(band_links(worded, least)))
    maybe = pinned(classes.join(groups, F.col("kind") == F.col("node")).select("kind", "n", "data", "_mr_same", F.col("root").alias("key")))
    sought = maybe.select("_mr_same").distinct()
    texts = docs.select(text.alias("_mr_text"), F.xxhash64(text).alias("_mr_same")).join(sought, "_mr_same", "left_semi").groupBy("_mr_same").agg(F.first("_mr_text").alias("_mr_text"))
    sets = texts.select(whole_sets(F.col("_mr_text"), size).alias("w")).select("w.*")
    heavy = maybe.groupBy("key").agg(F.sum("n").alias("m")).filter(F.col("m") > MOST_SHINGLES).select("key", F.ceil(F.col("m") / (MOST_SHINGLES // 2)).cast("int").alias("blocks"))
    roots = components(_found(maybe.drop("_mr_same").join(sets, "kind"), heavy, least))
    table = pinned(classes.select("kind").join(roots, F.col("kind") == F.col("node"), "left").select("kind", F.coalesce("root", "kind").alias("root")))
    return own.drop("n", "keys", "data", "fp", "_mr_same").join(table, "kind")


def one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the smallest doc_id, null last.

    Rows that repeat an id go by a hash of their text, and of rows equal in both one stays.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_mr_text"))
    grouped = pinned(similar_documents(hashed, size=size, least=least, keep=("doc_id", "_mr_text")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_mr_text")))
    kept = grouped.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("_mr_id"), F.col("k._mr_text").alias("_mr_hash"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    gone = grouped.select("doc_id", "_mr_text").join(kept, same("doc_id", "_mr_id") & same("_mr_text", "_mr_hash"), "left_anti")
    gone = pinned(gone.select(F.col("doc_id").alias("_mr_id"), F.col("_mr_text").alias("_mr_hash")))
    if gone.count() <= SMALL:
        gone = F.broadcast(gone)
    left = docs.withColumn("_mr_text", F.xxhash64("text")).join(gone, same("doc_id", "_mr_id") & same("_mr_text", "_mr_hash"), "left_anti")
    repeated = grouped.join(kept, same("doc_id", "_mr_id") & same("_mr_text", "_mr_hash"), "left_semi").groupBy("doc_id", "_mr_text").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    if repeated.limit(1).count():
        left = left.dropDuplicates(["doc_id", "_mr_text"])
    return left.drop("_mr_text")
