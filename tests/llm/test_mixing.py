import re
from collections import defaultdict

import pytest

from millrace.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, most=3):
    """Caps and reshares round by round, as the rule says it."""
    fixed, left = {}, dict(weights)
    while left:
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] >= most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}
        left = {s: w for s, w in left.items() if s not in over}
    return fixed


def cycle(names):
    ordered = sorted([n for n in names if n is not None]) + [None] * (None in names)
    return {n: (5, 2, 1)[i % 3] for i, n in enumerate(ordered)}


def test_targets_and_budgets(make_docs):
    docs = make_docs([(i, "w " * (i % 17 * 10 ** (i % 3)), ("a", "b", "c", None, "tiny")[0 if i % 3 == 0 else i % 5]) for i in range(400)])
    rows = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = plain_targets(sizes, cycle(set(sizes)))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert {s: int(t + 1e-6) for s, t in want.items()} == pytest.approx(taken, abs=1)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_small_cells_change_nothing(make_docs, monkeypatch):
    docs = make_docs([(i, "w " * (i % 13 + 1), "ab"[i % 2]) for i in range(300)])
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 7)
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


def test_odd_rows(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_weights_as_a_table(spark, make_docs):
    docs = make_docs([(i, "w w w", "abc"[i % 3]) for i in range(90)])
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    taken = defaultdict(int)
    for r in mixing.mix(docs, weights=weights).collect():
        taken[r.source] += r.taken
    assert taken == {"a": 67, "b": 202, "c": 0}


def test_documents_of_the_mix(odd_docs, make_docs):
    docs = make_docs([(i, " one two\tthree four" if i % 2 else "x", "abc"[i % 3]) for i in range(60)] + [(99, None, "a"), (7, "one two\tthree", "b"), (7, "one two\tthree", "b")])
    amounts = sum(r.taken for r in mixing.mix(docs).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(WORD.findall(r.text or "")) for r in rows) == amounts
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    cut = [r for r in rows if (r.doc_id, r.text) not in whole]
    assert len(cut) <= 3 and all(any(t and t.startswith(r.text) for d, t in whole if d == r.doc_id) and r.n_chars == len(r.text) for r in cut)
    assert sum(r.doc_id == 99 for r in rows) == 1
    assert mixing.mixed_documents(odd_docs).filter("n_chars is null").count() == 1


def test_query_runs_agree(spark, sf):
    first = sorted(map(tuple, queries.op2_mixing(spark, sf).collect()))
    assert first == sorted(map(tuple, queries.op2_mixing(spark, sf).collect()))


@pytest.mark.parametrize("cells", [8192, 5])
def test_one_id_for_a_third_of_all_rows(make_docs, monkeypatch, cells):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", cells)
    rows = [(None if i % 3 == 0 else i, "w " * (i % 11 + 1) + str(i), "ab"[i % 2]) for i in range(300)]
    docs = make_docs(rows)
    found = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want, taken = plain_targets(sizes, cycle(set(sizes))), defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
    assert len(found) == 300 and taken == {s: int(t + 1e-6) for s, t in want.items()}
    key = mixing._groups(docs, "doc_id", "text", "source", (5.0, 2.0, 1.0), 3, 2).select("_key").distinct().count()
    assert key == 300  # rows of one id have keys of their own, so they spread over the cells


@pytest.mark.parametrize("cells", [8192, 4])
def test_copies_of_one_row(make_docs, monkeypatch, cells):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", cells)
    rows = [(7, "one two three", "a")] * 50 + [(i, "x y", "b") for i in range(100, 130)] + [(None, None, "b")] * 20
    docs = make_docs(rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
    want = plain_targets({"a": 150, "b": 60}, {"a": 5, "b": 2})
    assert taken == {s: int(t + 1e-6) for s, t in want.items()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    said = defaultdict(int)
    for r in out.collect():
        said[r.source] += len(WORD.findall(r.text or ""))
    assert said == taken
    assert out.filter("doc_id is null").count() == 20


def test_many_sources_by_rounds(make_docs, monkeypatch):
    docs = make_docs([(i, "w " * (i * i % 97 + 1), f"s{i % 23}" if i % 24 else None) for i in range(500)])
    want = {r.source: (r.source_size, r.target) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "SMALL", 0)
    got = {r.source: (r.source_size, r.target) for r in mixing.mix(docs).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_clashing_columns(odd_docs):
    for name in ("taken", "size", "target", "_cell", "weight"):
        docs = odd_docs.withColumn(name, odd_docs["doc_id"])
        assert mixing.mix(docs).count() == docs.count()
        assert mixing.mixed_documents(docs).columns == docs.columns
