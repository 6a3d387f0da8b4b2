import random

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.imports import _go_text, python_imports

SIGNS = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  　é😀./\\"


def samples(count, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(count)]


def test_strip_and_lines_are_those_of_python(spark):
    texts = samples(1500)
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.strip(F.col("t")).alias("s"), tx.lines(F.col("t")).alias("l"), tx.insufficient(F.col("t")).alias("i"))
    for r in frame.collect():
        assert r.s == r.t.strip() and r.l == r.t.splitlines(keepends=True) and r.i == (not r.t.strip()), repr(r.t)


def test_truncation(spark):
    texts = ["x" * n for n in (0, 5, 22, 23, 24, 99, 100, 101, 500)] + ["é😀" * 200]
    for most in (10, 23, 24, 100):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.truncated(F.col("t"), most).alias("c")).collect()
        for r in rows:
            if len(r.t) <= most:
                assert r.c == r.t
            else:
                budget = most - len(tx.MARKER)
                head = int(budget * 0.7)
                assert len(r.c) == most
                assert r.c == (tx.MARKER[:most] if budget <= 0 else r.t[:head] + tx.MARKER + r.t[len(r.t) - (budget - head) :])


def test_tokens_and_snapshot(spark):
    from millrace.sources.files import snapshot

    assert [r.t for r in spark.createDataFrame([(0,), (1,), (4,), (5,)], "n int").select(tx.tokens(F.col("n")).alias("t")).collect()] == [0, 1, 1, 2]
    raw = b"\xef\xbb\xbfa\r\nb\rc\xff"
    row = spark.createDataFrame([(bytearray(raw),)], "b binary").select(snapshot(F.col("b")).alias("s")).first().s
    assert row.content == "a\nb\nc�"


def test_imports_of_python_go_breadth_first():
    source = "import os\nif 1:\n    import deep\nfrom . import a\nfrom ..b.c import d\nimport sys, os\n"
    assert python_imports(source) == ["os", ".", "..b.c", "sys", "deep"]
    assert python_imports("def (") is None


def test_go_literals():
    assert _go_text('"a/b"') == "a/b" and _go_text("`raw\\n`") == "raw\\n" and _go_text('"\\x61\\u00e9\\101"') == "aéA" and _go_text('"\\q"') == "\\q"
