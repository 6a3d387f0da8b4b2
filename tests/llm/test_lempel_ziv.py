import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import lempel_ziv as lz
from millrace.llm import queries
from millrace.session import table


def plain_phrases(data):
    """Phrases as byte strings: the shortest piece that is new, again and again."""
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_parser_finds_the_plain_phrases():
    rng = np.random.default_rng(0)
    for size in (0, 1, 2, 50, 3000):
        data = bytes(rng.integers(97, 100, size).astype(np.uint8))
        parser = lz.Parser()
        parser.feed(data)
        assert len(parser.hashes) - 1 == len(plain_phrases(data)) == len(set(parser.hashes[1:]))


def test_shared_beginnings():
    a, b, c = b"the same beginning " * 20, b"one end " * 9, b"and another " * 7
    parser = lz.Parser()
    parser.feed(a)
    mark = parser.mark()
    parser.feed(b)
    first = parser.signature()
    parser.back(mark)
    parser.feed(c)
    second = parser.signature()
    for whole, got in ((a + b, first), (a + c, second)):
        fresh = lz.Parser()
        fresh.feed(whole)
        assert (fresh.signature() == got).all()


def test_likeness_estimates_the_overlap_of_phrase_sets(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").limit(60).collect()]
    errors = []
    for x, y in zip(texts, [t[: len(t) // 2] + u for t, u in zip(texts, texts[1:], strict=False)], strict=False):
        a, b = plain_phrases(x.encode()), plain_phrases(y.encode())
        errors.append(lz.likeness(lz.signature(x), lz.signature(y)) - len(a & b) / len(a | b))
    # one hash for all texts: errors of texts that share phrases go together, so the mean is as wide as one of them
    assert abs(np.mean(errors)) < 0.08 and np.std(errors) < 0.1


def hashed(text):
    return xxhash.xxh64_intdigest((text or "").encode(), 42) - (xxhash.xxh64_intdigest((text or "").encode(), 42) >> 63 << 64)


def plain_rows(docs):
    """docs: (id, text), in any order; the next of each is the next smaller id, rows of one id by a hash of the text."""
    order = sorted(docs, key=lambda d: (-(1 << 63) if d[0] is None else d[0], hashed(d[1])))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[i - 1][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = lz.signature(text), lz.signature(edited), lz.signature(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz.to_text(a), lz.to_text(b), lz.likeness(a, b), lz.likeness(a, c)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, queries.op3_document_fingerprints(spark, sf).collect()), key=str) == plain_rows(docs)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_odd_rows_and_ranges(odd_docs, buckets):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, lz.with_neighbours(odd_docs, buckets=buckets).collect()), key=str) == plain_rows(docs)


def test_few_rows(make_docs):
    assert lz.with_neighbours(make_docs([]).limit(0)).count() == 0
    for rows in ([(5, "only one")], [(None, "a text"), (None, None)], [(1, "x"), (2, None)]):
        docs = make_docs([(i, t, "s") for i, t in rows])
        assert sorted(map(tuple, lz.with_neighbours(docs).collect()), key=str) == plain_rows(rows)


def test_columns(spark):
    frame = spark.createDataFrame([("some text " * 30, "some text " * 30), ("a", None), (None, None)], "a string, b string")
    rows = frame.select(lz.similarity(lz.fingerprint(F.col("a")), lz.fingerprint(F.col("b"))).alias("s")).collect()
    assert [r.s for r in rows] == [1.0, 0.0, 1.0]


@pytest.mark.parametrize("buckets", [4, 30])
def test_a_third_of_all_rows_without_an_id(make_docs, buckets):
    rows = [(None if i % 3 == 0 else i, f"text {i} " * (i % 9), "s") for i in range(240)]
    docs = make_docs(rows)
    got = sorted(map(tuple, lz.with_neighbours(docs, buckets=buckets).collect()), key=str)
    assert got == plain_rows([(i, t) for i, t, _ in rows])


def test_a_repeated_row_is_spread(make_docs, monkeypatch):
    monkeypatch.setattr(lz, "LEAST_SPREAD", 20)
    rows = [(5, "the same row ", "s")] * 400 + [(i, f"other {i}", "s") for i in range(100, 160)] + [(1, "low", "s")]
    docs = make_docs(rows).repartition(6)
    got = sorted(map(tuple, lz.with_neighbours(docs, buckets=12).collect()), key=str)
    assert got == plain_rows([(i, t) for i, t, _ in rows])
    assert lz._ranges([(1, 1, 40), (5, 7, 40), (5, 7, 40), (5, 7, 40), (9, 2, 3)]) == ([(1, 1), (5, 7), (5, 7), (9, 2)], {1: 2})


def test_clashing_columns(odd_docs):
    want = sorted(map(str, lz.with_neighbours(odd_docs).collect()))
    docs = odd_docs.withColumns({n: F.lit("x") for n in ("key", "h", "place", "range", "own", "salt")})
    assert sorted(map(str, lz.with_neighbours(docs).collect())) == want
