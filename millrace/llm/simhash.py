"""SimHash near-duplicates: fingerprints in shards of a vantage-point tree, linked exactly.

A tree over a bounded sample of fingerprints cuts the Hamming space by distance to vantage points. Every
fingerprint goes to each leaf that its ball of half the link distance meets: by the triangle bound the
other branches cannot hold it, and two fingerprints within the link distance meet in the leaf of a
point between them. Leaves give spanning forests, which are joined by star contraction.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import pinned

SEED = 42
SAMPLE = 16_384  # fingerprints the tree is fitted on
LEAF = 1_024  # fingerprints a leaf is meant to hold
MOST_IN_LEAF = 131_072  # a larger leaf is cut by a tree of its own; where no cut helps, it is dealt out as pairs of blocks
SMALL = 50_000  # large leaves up to which their table is broadcast
_LEAVES = 4_096  # numbers of a leaf's leaves; a tree on SAMPLE points has fewer
_LAST_LEAF = (1 << 62) // _LEAVES
SHRINKS = 0.8  # of the points: what a side may keep, overlap included, for a cut to count
_FORK = 4_096
_CHUNK = 65_536


def _hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()  # on bytes: A-Z only, and the six white-space signs of ASCII
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def simhash(text: bytes | None, size: int = 3) -> int:
    """64 bits: one where over half the shingles' XXH64 have a one. No words: zero."""
    hashes = _hashes(text or b"", size)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_column(size: int):
    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((simhash(t.as_py(), size) for t in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of


def fingerprints(text: Column, size: int = 3) -> Column:
    """Signed 64-bit SimHash of a text's word shingles; null counts as empty, and an empty text gives 0."""
    return _fingerprint_column(size)(F.coalesce(text, F.lit("")))


# ---- the vantage-point tree


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _cut(points: np.ndarray, reach: int, rng) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point and radius with the least overlap among a few; None if no cut makes both sides smaller."""
    best, least = None, SHRINKS * len(points)
    for vantage in rng.choice(points, size=min(8, len(points)), replace=False):
        d = _distance(points, vantage)
        for radius in np.unique(np.percentile(d, (35, 42, 50, 58, 65), method="lower")).astype(int):
            larger = max(np.count_nonzero(d <= radius + reach), np.count_nonzero(d > radius - reach))
            if larger < least:
                best, least = (vantage, int(radius), d), larger
    return best


def fit_tree(sample: np.ndarray, leaf: int, reach: int, seed: int = 9) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer); a child below 0 is leaf -child - 1. One leaf: no nodes."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        found = _cut(points, reach, rng) if len(points) > leaf else None
        if found is None:
            leaves += 1
            return -leaves
        vantage, radius, d = found
        at = len(nodes)
        nodes.append(())
        nodes[at] = (int(vantage), radius, grow(points[d <= radius]), grow(points[d > radius]))
        return at

    grow(np.unique(sample))
    return nodes


def route(points: np.ndarray, nodes: list[tuple], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, leaf) for each leaf that the ball of ``reach`` around a point meets."""
    rows, leaves = [], []
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if at < 0:
            rows.append(own)
            leaves.append(np.full(len(own), -at - 1))
        elif len(own):
            vantage, radius, inner, outer = nodes[at]
            d = _distance(points[own], np.uint64(vantage)).astype(np.int64)
            todo += [(inner, own[d - reach <= radius]), (outer, own[d + reach > radius])]
    return np.concatenate(rows), np.concatenate(leaves)


def forest(points: np.ndarray, most: int, seed: int = 9) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the graph that links points at ``most`` differing bits or fewer."""
    reach = -(-most // 2)
    if len(points) > _FORK and (found := _cut(points, reach, np.random.default_rng(seed))):
        _, radius, d = found
        d = d.astype(np.int64)
        return forest(points[d - reach <= radius], most, seed + 1) + forest(points[d + reach > radius], most, seed + 1)
    edges = []
    left = points
    while len(left):
        queue, left = [left[-1]], left[:-1]
        while queue and len(left):
            x = queue.pop()
            near = _distance(left, x) <= most
            if near.any():
                new = left[near]
                left = left[~near]
                edges.append((np.full(len(new), x), new))
                queue.extend(new)
    return edges


def _fit(rows: pd.DataFrame, leaf: int, reach: int) -> bytes:
    return json.dumps(fit_tree(rows["fp"].to_numpy(np.int64).view(np.uint64), leaf, reach)).encode()


def _finer(sent: DataFrame, large: DataFrame, reach: int) -> DataFrame:
    """``sent`` with the leaves of ``large`` (leaf, n) cut by trees of their own, each fitted on about SAMPLE points of its leaf.

    A leaf that no cut makes smaller gets a negative number, as does one whose numbers are used up: it is final.
    """
    parts = large.withColumns({"step": F.ceil(F.col("n") / SAMPLE), "blocks": F.ceil(F.col("n") / _CHUNK)})
    if parts.count() <= SMALL:
        parts = F.broadcast(parts)
    rows = sent.join(parts, "leaf")

    def fit(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        nodes = _fit(own, max(64, math.ceil(LEAF * len(own) / int(own["n"].iloc[0]))), reach)
        return pd.DataFrame({"leaf": [key[0]], "tree": [nodes if key[0] < _LAST_LEAF else b"[]"]})

    some = rows.filter(F.pmod(F.xxhash64("fp", F.lit(17)), F.col("step")) == 0).select("leaf", "n", "fp")
    trees = pinned(some.groupBy("leaf").applyInPandas(fit, "leaf bigint, tree binary"))
    cut = trees.filter("tree <> cast('[]' AS binary)")

    def send(key: tuple, own: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        points = own["fp"].to_numpy(np.int64)
        if not len(tree):
            return pd.DataFrame({"leaf": np.full(len(points), -key[0] - 1), "fp": points})
        at, leaf = route(points.view(np.uint64), [tuple(n) for n in json.loads(tree["tree"].iloc[0])], reach)
        return pd.DataFrame({"leaf": key[0] * _LEAVES + leaf + 1, "fp": points[at]})

    block = F.pmod(F.xxhash64("fp", F.lit(18)), F.col("blocks")).cast("int").alias("block")
    each = cut.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), "tree")
    routed = rows.select("leaf", block, "fp").groupBy("leaf", "block").cogroup(each.groupBy("leaf", "block")).applyInPandas(send, "leaf bigint, fp bigint")
    return sent.join(parts.select("leaf"), "leaf", "left_anti").select("leaf", "fp").unionByName(routed)


def shards(points: DataFrame, most: int) -> DataFrame:
    """(leaf, fp): distinct fingerprints ``fp`` in the leaves of a tree; any two within ``most`` bits share a leaf.

    The first tree is fitted on a bounded sample of all points; leaves above MOST_IN_LEAF are cut by further
    trees, fitted on samples of their own, until they are small or no cut makes them smaller.
    """
    reach = -(-most // 2)
    total = points.count()
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = fit_tree(sample, max(64, math.ceil(LEAF * len(sample) / max(1, total))), reach)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if len(own):
                at, leaf = route(own, nodes, reach)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(own[at].view(np.int64))], names=["leaf", "fp"])

    sent = pinned(points.select("fp").mapInArrow(send, "leaf bigint, fp bigint"))
    while True:
        large = pinned(sent.filter("leaf >= 0").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_IN_LEAF))
        if not large.limit(1).count():
            return sent
        sent = pinned(_finer(sent, large, reach))


def links(points: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp``, enough to connect all that are linked."""
    sent = shards(points, most)
    large = sent.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_IN_LEAF).select("leaf", F.ceil(F.col("n") / (MOST_IN_LEAF // 2)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    cells = sent.join(large, "leaf", "left").select("leaf", "fp", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)).alias("cell")).select("leaf", "cell.i", "cell.j", "fp")

    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        found = forest(np.unique(rows["fp"].to_numpy(np.int64)).view(np.uint64), most)
        ends = [np.concatenate(x).view(np.int64) if found else np.array([], np.int64) for x in (zip(*found, strict=True) if found else ((), ()))]
        return pd.DataFrame({"a": ends[0], "b": ends[1]})

    return cells.groupBy("leaf", "i", "j").applyInPandas(connect, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches, by large-star and small-star rounds.

    A round sends every edge to the least neighbour known at one of its ends; minima are pre-aggregated
    and joined back, so a star of any size is split like any other join. Ends when a round changes nothing.
    """
    edges = pinned(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = pinned(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link at ``most`` differing bits, directly or by others.

    ``component_id`` is the smallest id of the component (null only if all its ids are null). Texts without
    words, null ones included, have fingerprint 0 and link like any other. Equal fingerprints meet before
    the search, so copies cost one point; rows that repeat an id stay rows. An empty table gives no rows.
    """
    own = pinned(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), size).alias("fp")))
    classes = pinned(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), most))
    linked = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    table = linked.join(least, "root").select(F.col("fp").alias("p"), "least")
    table = pinned(classes.join(table, F.col("fp") == F.col("p"), "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return own.join(table, "fp").select("doc_id", "fp", "component_id")


def hex64(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
