import math
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import queries, sharding
from millrace.session import table


def check(rows, shards):
    sizes = Counter(s for s, _ in rows)
    assert max(sizes.values()) - min([sizes.get(s, 0) for s in range(shards)]) <= 1
    for s in sizes:
        assert sorted(p for t, p in rows if t == s) == list(range(sizes[s]))


def test_query(spark, sf):
    rows = queries.op10_sharding(spark, sf).collect()
    docs = table(spark, sf, "documents")
    want = sorted(map(tuple, docs.select("doc_id", (F.octet_length("text") + 8).cast("bigint"), F.crc32("text")).collect()))
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    check([(r["shard"], r["slot"]) for r in rows], 24)


def test_sizes_of_any_count(spark):
    for n, shards, parts in ((0, 3, 1), (1, 3, 1), (5, 8, 3), (97, 7, 5), (1000, 24, 13)):
        rows = sharding.uniform_shards(spark.range(n).repartition(parts), shards).collect()
        assert sorted(r.id for r in rows) == list(range(n))
        if n >= shards:
            check([(r["shard"], r["slot"]) for r in rows], shards)


def test_one_key_for_all_and_clashing_names(spark):
    rows = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("shard"))
    out = sharding.uniform_shards(rows, 5)
    assert out.columns == ["doc_id", "shard", "slot"]
    check([(r["shard"], r["slot"]) for r in out.collect()], 5)


def test_small_cells_keep_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 10)
    check([(r["shard"], r["slot"]) for r in sharding.uniform_shards(spark.range(777).repartition(4), 6).collect()], 6)


def test_every_place_is_as_likely(spark):
    seen = Counter()
    for seed in range(60):
        seen.update((r["shard"], r["slot"]) for r in sharding.uniform_shards(spark.range(40).repartition(2), 4, seed).filter("id = 7").collect())
    assert len(seen) > 22 and max(seen.values()) < 9  # 60 draws over 40 places


def test_hypergeometric_counts(spark):
    n = 40_000
    draw = sharding.hypergeometric(F.lit(50).cast("bigint"), F.lit(20).cast("bigint"), F.lit(10).cast("bigint"), F.rand(3))
    seen = {r.x: r["count"] for r in spark.range(n).select(draw.alias("x")).groupBy("x").count().collect()}
    for x in range(11):
        p = math.comb(20, x) * math.comb(30, 10 - x) / math.comb(50, 10)
        assert abs(seen.get(x, 0) - n * p) < 6 * math.sqrt(n * p) + 3


def test_matrix_has_exact_sums(spark):
    sizes = [13, 0, 7, 100, 1, 42, 5]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part int, n long")
    rows = {r.part: r.to_shard for r in sharding.communication_matrix(counts, 9, 7, 1).collect()}
    assert {p: sum(x) for p, x in rows.items()} == {i: n for i, n in enumerate(sizes) if n}
    columns = [sum(x[s] for x in rows.values()) for s in range(9)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1
