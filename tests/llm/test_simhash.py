import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries, simhash
from millrace.session import table


def plain_fingerprint(text, size=3):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(rows, most):
    """{row number: smallest id reachable}"""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = [f for _, f in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [least.get(top(i)) for i in range(len(rows))]


def test_query_against_brute_force(spark, sf):
    got = sorted(map(tuple, queries.op9_simhash(spark, sf).collect()))
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in table(spark, sf, "documents").collect()]
    want = plain_components(docs, 2)
    assert got == sorted((k, f"{f:016x}", c) for (k, f), c in zip(docs, want, strict=True))
    assert len({c for _, _, c in got}) < len(got)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()]
    got = sorted(map(str, ((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd_docs).collect())))
    want = plain_components(rows, 2)
    assert got == sorted(map(str, ((k, f, c) for (k, f), c in zip(rows, want, strict=True))))
    assert {k for k, f in rows if f == 0} >= {1, 2, 3}


def test_empty_table(odd_docs):
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_fingerprint_agrees_with_sparks_hash(spark):
    text = "One  two\tTHREE"
    want = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % 2**64
    assert simhash.simhash(text.encode()) == want  # a single shingle: the fingerprint is its hash


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_tree_loses_no_link(most):
    rng = np.random.default_rng(most)
    centres = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = centres[rng.integers(0, 300, 3000)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    points = np.unique(np.concatenate([centres, near]))
    reach = -(-most // 2)
    nodes = simhash.fit_tree(points[::3], 40, reach)
    at, leaf = simhash.route(points, nodes, reach)
    homes = {}
    for a, b in zip(at, leaf, strict=True):
        homes.setdefault(int(a), set()).add(int(b))
    assert len(set(leaf.tolist())) > 8
    for i, p in enumerate(points):
        for j in np.nonzero(np.bitwise_count(points ^ p) <= most)[0]:
            assert homes[i] & homes[int(j)]


def test_forest_connects_what_is_linked(monkeypatch):
    monkeypatch.setattr(simhash, "_FORK", 64)
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 2**14, 600, dtype=np.uint64))
    want = plain_components([(int(p), int(p)) for p in points], 2)
    root = {int(p): int(p) for p in points}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.forest(points, 2):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 2
            lo, hi = sorted((top(x), top(y)))
            root[hi] = lo
    least = {}
    for p in points.tolist():
        least[top(p)] = min(p, least.get(top(p), p))
    assert [least[top(int(p))] for p in points] == want


def test_large_leaves_are_dealt_out_as_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_IN_LEAF", 4)
    docs = make_docs([(i, f"alpha beta gamma delta epsilon {i // 7}", "a") for i in range(60)])
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = {k: c for (k, _), c in zip(rows, plain_components(rows, 2), strict=True)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1200)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trees_grow_with_the_table(spark, monkeypatch):
    for name, value in (("SAMPLE", 200), ("LEAF", 30), ("MOST_IN_LEAF", 400), ("_CHUNK", 300)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    points = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) for _ in range(2)]]))
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(5)
    sent = simhash.shards(frame, 2)
    sizes = {r.leaf: r["count"] for r in sent.groupBy("leaf").count().collect()}
    assert max(n for leaf, n in sizes.items() if leaf >= 0) <= 400 and max(sizes) >= simhash._LEAVES
    found = {int(p): int(p) for p in points.view(np.int64)}
    found.update({r.node: r.root for r in simhash.components(simhash.links(frame, 2)).collect()})
    want = plain_components([(int(p), int(u)) for p, u in zip(points.view(np.int64), points, strict=True)], 2)
    assert [found[int(p)] for p in points.view(np.int64)] == want


def test_a_dense_table_is_dealt_out_as_blocks(spark, monkeypatch):
    for name, value in (("SAMPLE", 100), ("LEAF", 10), ("MOST_IN_LEAF", 50)):
        monkeypatch.setattr(simhash, name, value)
    points = np.arange(256, dtype=np.uint64)  # each is within two bits of many others
    frame = spark.createDataFrame([(int(p),) for p in points], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 2)).collect()}
    assert set(roots.values()) == {0} and len(roots) == 256


def test_clashing_columns(odd_docs):
    want = sorted(map(str, simhash.near_duplicates(odd_docs).collect()))
    docs = odd_docs.withColumns({n: F.lit(1) for n in ("fp", "component_id", "leaf", "first", "node")})
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == want
