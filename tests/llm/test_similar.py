import random

from pyspark.sql import functions as F

from millrace.llm import similar
from millrace.llm.simhash import components as components_of
from millrace.session import table


def shingles(text, size=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(sets, least):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= least or not (sets[i] or sets[j]):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(sets))]


def edited(words, rng, count):
    words = list(words)
    for _ in range(count):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_near_copies_meet_and_others_do_not(make_docs):
    rng = random.Random(5)
    rows, group = [], {}
    for g in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 15, 30, 60, 200, 900]))]
        for copy in range(rng.choice([1, 2, 5])):
            key = len(rows)
            light = edited(words, rng, len(words) // 100) if copy else words
            rows.append((key, " ".join(light) + (" passage that many share word for word" if len(words) > 150 else ""), "s"))
            group[key] = g
    got = {r.doc_id: r.root for r in similar.similar_documents(make_docs(rows)).collect()}
    for a in got:
        for b in got:
            if a < b:
                assert (got[a] == got[b]) == (group[a] == group[b]), (rows[a], rows[b])


def test_components_of_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.root for r in similar.similar_documents(docs).collect()}
    sets = [shingles(r.text) for r in rows]
    sure, loose = components(sets, 0.84), components(sets, 0.74)
    for i in range(len(rows)):
        for j in range(i):
            same = got[rows[i].doc_id] == got[rows[j].doc_id]
            assert same or sure[i] != sure[j]
            assert not same or loose[i] == loose[j]


def test_blocks_of_large_shards(make_docs, monkeypatch):
    monkeypatch.setattr(similar, "MOST_IN_SHARD", 4)
    monkeypatch.setattr(similar, "SMALL", 0)
    words = [f"w{i}" for i in range(120)]
    docs = make_docs([(i, " ".join([*words, f"end{i}"]), "s") for i in range(40)] + [(100, "quite another text of few words", "s")])
    got = {r.doc_id: r.root for r in similar.similar_documents(docs).collect()}
    assert len({got[i] for i in range(40)}) == 1 and got[100] != got[0]


def test_the_tree_links_what_is_within_its_bits(spark):
    rng = random.Random(12)
    points = [rng.getrandbits(63) for _ in range(40)]
    for p in points[:20]:
        near = p ^ (1 << rng.randrange(63))
        points += [near, near ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)), p]
    classes = spark.createDataFrame([(1000 + i, p) for i, p in enumerate(points)], "kind long, fp long")
    got = {r.node: r.root for r in components_of(similar.tree_links(classes)).collect()}
    root = list(range(len(points)))
    for _ in points:  # as many rounds as the longest chain could need
        for i, a in enumerate(points):
            root[i] = min(root[j] for j, b in enumerate(points) if (a ^ b).bit_count() <= 2)
    assert [got.get(1000 + i, 1000 + i) for i in range(len(points))] == [1000 + r for r in root]


def test_near_copies_meet_through_the_tree_alone(make_docs, monkeypatch):
    monkeypatch.setattr(similar, "band_links", lambda classes, least: classes.select(F.col("kind").alias("a"), F.col("kind").alias("b")))
    words = [f"w{i}" for i in range(4_000)]
    docs = make_docs([(1, " ".join(words), "s"), (2, " ".join([*words, "more"]), "s"), (3, " ".join([*words[:1_000], "or", *words[2_500:]]), "s")])
    assert [r.n for r in docs.select(similar.profiles(F.col("text"), 5).alias("p")).select("p.n").collect()] == [3996, 3997, 2497]
    got = {r.doc_id: r.root for r in similar.similar_documents(docs).collect()}
    assert got[1] == got[2] != got[3]


def test_one_of_each(odd_docs, make_docs):
    rows = similar.one_of_each(odd_docs).collect()
    assert odd_docs.columns == list(rows[0].asDict())
    kept = sorted(str(r.doc_id) for r in rows)
    assert kept == sorted(["1", "5", "7", "8", "9", "10", "None"])  # 1, 2, 3 have no words; 5, 6, 6 are copies
    assert similar.one_of_each(odd_docs.limit(0)).count() == 0
    twice = make_docs([(4, "one text twice", "s"), (4, "one text twice", "s"), (None, "one text twice", "s")])
    assert [r.doc_id for r in similar.one_of_each(twice).collect()] == [4]


def test_profiles_do_not_depend_on_order_or_repeats(spark):
    a, b = similar.profile(b"a b c d e f g " * 3, 5), similar.profile(b"A b  c d\te f g " * 5, 5)
    assert a[0] == b[0] and a[1] == b[1] == 7
    assert similar.profile(None, 5) == (0, 0, [0], b"")
    frame = spark.createDataFrame([("x y",), (None,)], "t string")
    assert [r.n for r in frame.select(similar.profiles(F.col("t"), 5).alias("p")).select("p.n").collect()] == [1, 0]


def around(rng, size, count):
    """Pairs of texts whose similarity is near 0.8, on either side."""
    rows = []
    for g in range(count):
        words = [f"g{g}w{i}" for i in range(size)]
        shared = round((size - 4) * (0.873 + 0.03 * rng.random()))  # of the shingles; both texts end in words of their own
        rows += [" ".join(words), " ".join(words[: shared + 4] + [f"g{g}v{i}" for i in range(size - shared - 4)])]
    return rows


def test_exact_sets_decide_around_the_limit(make_docs, monkeypatch):
    rng = random.Random(8)
    texts = [t for size in (40, 120, 400) for t in around(rng, size, 60)]
    want = [jaccard(shingles(a), shingles(b)) >= 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert 0.2 < sum(want) / len(want) < 0.8
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    for most in (similar.MOST_SHINGLES, 100):  # 100: every group is dealt out as pairs of blocks
        monkeypatch.setattr(similar, "MOST_SHINGLES", most)
        got = {r.doc_id: r.root for r in similar.similar_documents(docs).collect()}
        assert [got[i] == got[i + 1] for i in range(0, len(texts), 2)] == want


def test_components_of_the_table_are_exact(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.root for r in similar.similar_documents(docs).collect()}
    want = components([shingles(r.text) for r in rows], 0.8)
    groups = {}
    for r, w in zip(rows, want, strict=True):
        groups.setdefault(w, set()).add(got[r.doc_id])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(got.values()))
