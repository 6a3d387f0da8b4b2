"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every partition of the input learns how many of its rows go to each shard (a random matrix with fixed
row and column sums), permutes its rows locally, sends them, and every shard permutes what it got.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import pinned

ROWS_PER_CELL = 65_536
_ROW_BITS = (1 << 33) - 1


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Exact draw by inversion of ``u``: how many of ``drawn`` rows are among the ``marked`` of ``total``.

    Weights are taken relative to the mode by the ratio of neighbours, within 12 standard deviations
    (beyond lies less than a double resolves), first the mode, then below it, then above it.
    """
    d = lambda c: c.cast("double")
    nothing = F.array().cast("array<bigint>")

    def bounds(v):
        n, k, m = d(v.n), d(v.k), d(v.m)
        share = k / F.greatest(n, F.lit(1.0))
        sd = F.sqrt(m * share * (1.0 - share) * (n - m) / F.greatest(n - 1.0, F.lit(1.0)))
        low, high = F.greatest(F.lit(0).cast("bigint"), v.m + v.k - v.n), F.least(v.m, v.k)
        mode = F.least(high, F.greatest(low, F.floor((m + 1.0) * (k + 1.0) / (n + 2.0))))
        wide = F.ceil(sd * 12.0).cast("bigint") + 12
        return F.struct(v.n.alias("n"), v.k.alias("k"), v.m.alias("m"), v.u.alias("u"), mode.alias("mode"), F.greatest(low, mode - wide).alias("low"), F.least(high, mode + wide).alias("high"))

    def below(v, x):  # weight of x - 1 over that of x
        x = d(x)
        return x * (d(v.n) - d(v.k) - d(v.m) + x) / ((d(v.k) - x + 1.0) * (d(v.m) - x + 1.0))

    def above(v, x):  # weight of x over that of x - 1
        x = d(x)
        return (d(v.k) - x + 1.0) * (d(v.m) - x + 1.0) / (x * (d(v.n) - d(v.k) - d(v.m) + x))

    def total_weight(v, steps, ratio):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps, start, lambda a, x: F.struct((a.w * ratio(v, x)).alias("w"), (a["sum"] + a.w * ratio(v, x)).alias("sum")))["sum"]

    def find(v, steps, ratio, rest, shift, last):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("at"))

        def step(a, x):
            w = a.w * ratio(v, x)
            return F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.coalesce(a.at, F.when(a["sum"] + w >= rest, x + shift)).alias("at"))

        return F.coalesce(F.aggregate(steps, start, step).at, last)

    def draw(v):
        down = F.when(v.mode > v.low, F.sequence(v.mode, v.low + 1, F.lit(-1).cast("bigint"))).otherwise(nothing)
        up = F.when(v.high > v.mode, F.sequence(v.mode + 1, v.high, F.lit(1).cast("bigint"))).otherwise(nothing)
        sums = F.struct(v.alias("v"), down.alias("down"), up.alias("up"), total_weight(v, down, below).alias("under"), total_weight(v, up, above).alias("upper"))
        return _let(sums, lambda s: _let(F.struct(s.alias("s"), (s.v.u * (1.0 + s.under + s.upper)).alias("t")), pick))

    def pick(p):
        s = p.s
        return (
            F.when(p.t < 1.0, s.v.mode)
            .when(p.t < 1.0 + s.under, find(s.v, s.down, below, p.t - 1.0, -1, s.v.low))
            .otherwise(find(s.v, s.up, above, p.t - 1.0 - s.under, 0, s.v.high))
        )

    given = F.struct(total.alias("n"), marked.alias("k"), drawn.alias("m"), u.alias("u"))
    return _let(given, lambda g: _let(bounds(g), draw))


def _row_of_matrix(caps: Column, drawn: Column, *seeds: Column) -> Column:
    """Multivariate draw: one count for each shard, together ``drawn``."""
    start = F.struct(drawn.alias("left"), F.aggregate(caps, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("rest"), F.array().cast("array<bigint>").alias("xs"))

    def step(a, s):
        cap = caps[s]
        x = hypergeometric(a.rest, cap, a.left, _uniform(*seeds, s))
        return _let(x, lambda got: F.struct((a.left - got).alias("left"), (a.rest - cap).alias("rest"), F.concat(a.xs, F.array(got)).alias("xs")))

    return F.aggregate(F.sequence(F.lit(0), F.size(caps) - 1), start, step).xs


def communication_matrix(counts: DataFrame, shards: int, partitions: int, seed: int) -> DataFrame:
    """(part, to_shard array) with exact sums: each part's rows, and shard sizes at most one apart.

    ``counts`` is (part int, n bigint), one row for each partition with rows. The table of part sizes
    (16 bytes a partition) is halved again and again, and each half draws its share of the shards, so
    the draws of one level are independent and run in parallel.
    """
    parts = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("total"))
    node = parts.filter(F.size("parts") > 0).select(
        "parts",
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards).cast("bigint") + F.when(s < F.col("total") % shards, 1).otherwise(0).cast("bigint")).alias("caps"),
    )
    for level in range(max(1, math.ceil(math.log2(max(2, partitions))))):
        if level >= 8:
            node = node.repartition(F.xxhash64(F.col("parts")[0]["part"]))
        half = F.floor(F.size("parts") / 2).cast("int")
        split = node.select("parts", "caps", half.alias("half")).select(
            "parts", "caps", "half", F.aggregate(F.slice("parts", 1, F.col("half")), F.lit(0).cast("bigint"), lambda a, x: a + x.n).alias("size_left")
        )
        left = F.when(F.col("half") > 0, _row_of_matrix(F.col("caps"), F.col("size_left"), F.lit(seed), F.lit(level), F.col("parts")[0]["part"]))
        split = split.select("parts", "caps", "half", left.alias("left"))
        two = F.array(
            F.struct(F.slice("parts", 1, F.col("half")).alias("parts"), F.col("left").alias("caps")),
            F.struct(F.slice("parts", F.col("half") + 1, F.size("parts") - F.col("half")).alias("parts"), F.zip_with("caps", "left", lambda a, b: a - b).alias("caps")),
        )
        same = F.array(F.struct("parts", "caps"))
        node = split.select(F.explode(F.when(F.col("half") > 0, two).otherwise(same)).alias("x")).select("x.parts", "x.caps")
    return node.select(F.col("parts")[0]["part"].alias("part"), F.col("caps").alias("to_shard"))


def uniform_shards(rows: DataFrame, shards: int = 24, seed: int = 10) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1, sizes at most one apart) and ``slot`` (gapless from 0 in a shard).

    Every assignment of rows to shards and slots is equally likely. Equal rows and null values are rows
    like any other; an empty table gives an empty result. Input columns named ``shard`` or ``slot`` are
    replaced. Wide columns travel with the rows: pass what is needed.
    Place in the input is part of a row's random key, so a key that a third of all rows share is dealt
    out evenly; the keyed rows are checkpointed once, and a lost executor changes nothing.
    """
    rows = rows.drop("shard", "slot")
    keyed = rows.withColumn("_mr_key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    kept = pinned(keyed.sortWithinPartitions("_mr_key"))  # the local permutation: its order is what is stored
    total, last = kept.select(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)), F.max("p")).first()
    placed = kept.withColumn("_mr_part", F.spark_partition_id()).withColumn("_mr_at", F.monotonically_increasing_id().bitwiseAND(_ROW_BITS))
    counts = kept.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ends = F.aggregate("to_shard", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")))))
    matrix = pinned(communication_matrix(counts, shards, (last or 0) + 1, seed).select(F.col("part").alias("_mr_part"), ends.alias("_mr_ends")))
    cells = max(1, math.ceil(total / shards / ROWS_PER_CELL))
    sent = (
        placed.join(matrix, "_mr_part")
        .withColumn("shard", F.size(F.filter("_mr_ends", lambda e: e <= F.col("_mr_at"))).cast("int"))
        .withColumn("_mr_again", F.xxhash64(F.lit(seed + 1), "_mr_key"))
        .withColumn("_mr_cell", F.pmod(F.shiftrightunsigned("_mr_again", 8), F.lit(cells)).cast("int"))
        .drop("_mr_part", "_mr_at", "_mr_ends")
    )
    before = Window.partitionBy("shard").orderBy("_mr_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "_mr_cell").agg(F.count(F.lit(1)).alias("_mr_n")).select("shard", "_mr_cell", F.coalesce(F.sum("_mr_n").over(before), F.lit(0)).alias("_mr_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_mr_cell").orderBy("_mr_again", "_mr_key"))
    return sent.join(offsets, ["shard", "_mr_cell"]).withColumn("slot", (F.col("_mr_before") + inside - 1).cast("bigint")).select(*rows.columns, "shard", "slot")
