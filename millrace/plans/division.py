"""Queries over divided files: chunks and pieces, the calls above them, what a plan says of itself, declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import structure as st
from millrace.operators import division as dv
from millrace.plans import documents as docs
from millrace.session import importable

BUDGET = 100  # signs of a chunk: most lines are longer, so that every way of cutting occurs
MANIFEST = 4_000  # signs of a manifest: at most 12 children of a node, and 3 of the last


def _chunks(spark, sf):
    return dv.divided(docs.files(spark, sf), BUDGET)


def divided_chunks(spark, sf):
    return _chunks(spark, sf).select("rel", "chunk", "chunks", "unit_group", "piece", "pieces", "first_unit", "last_unit", "start_byte", "end_byte", "chars", "reason", "left_edge", "right_edge")


def metadata_bounded_chunks(spark, sf):
    """Chunks that the bound on what a prompt says of its units closes: 600 signs hold four or five units."""
    tight = dv.divided(docs.files(spark, sf), 2_000, 600)
    return tight.groupBy("reason").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.col("last_unit") - F.col("first_unit") + 1).alias("most_units"), F.sum("chars").alias("chars"))


def reduction_calls(spark, sf):
    plan = dv.reduction_plan(_chunks(spark, sf), MANIFEST)
    return plan.groupBy("rel", "phase", "level").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.size("children")).alias("children"), F.max("last").alias("last"))


def division_plans(spark, sf):
    return dv.plan_figures(_chunks(spark, sf), MANIFEST)


def unit_summaries(spark, sf):
    found = dv.units(docs.files(spark, sf))
    return dv.unit_summaries(_chunks(spark, sf), found, BUDGET).select("rel", "unit", "chars", "least", "pieces", "extra", F.array_join(F.transform("payloads", lambda p: p["chars"].cast("string")), ",").alias("payloads"))


def leaf_summaries(spark, sf):
    found = dv.units(docs.files(spark, sf))
    return dv.leaf_summaries(_chunks(spark, sf), found).select("rel", "chunk", "reason", F.array_join(F.transform("parts", lambda p: F.concat(p["unit"].cast("string"), F.lit(":"), p["chars"].cast("string"))), ",").alias("parts"))


def plan_stream(spark, sf):
    files = docs.files(spark, sf)
    stream = dv.plan_stream(dv.divided(files, BUDGET), dv.units(files), BUDGET, MANIFEST)
    return stream.groupBy("rel", "kind").agg(F.count(F.lit(1)).alias("items"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def division_totals(spark, sf):
    return dv.division_totals(division_plans(spark, sf))


def fixed_width_atoms(spark, sf):
    atoms = dv.line_atoms(docs.files(spark, sf))
    return dv.fixed_width(atoms, 400).select("rel", "ord", "part", F.sha2("source", 256).alias("digest"))


def capacity_codes(spark, sf):
    """Every bound passed in turn, and the first of several."""
    rows = [("fits", 1, 1, 1, 1, 1, 1), ("a", 4097, 9999, 9999, 999, 9, 99), ("s", 4096, 8193, 1, 1, 1, 1), ("u", 1, 1, 4097, 257, 1, 1), ("c", 1, 1, 4096, 257, 7, 1), ("d", 1, 1, 1, 256, 7, 99), ("f", 1, 1, 1, 1, 6, 30), ("e", 1, 1, 1, 1, 6, 29)]
    counts = spark.createDataFrame(rows, "rel string, atoms int, symbols int, units int, chunks int, depth int, roots int")
    none = dv.capacity(counts.limit(0)).select("rel", "blocked")
    tight = counts.filter("rel = 'fits'")
    every = [dv.capacity(counts).select("rel", "blocked"), dv.capacity(tight.withColumn("rel", F.lit("no envelope")), 80).select("rel", "blocked"), dv.capacity(tight.withColumn("rel", F.lit("no fan")), 684).select("rel", "blocked")]
    for part in every:
        none = none.unionByName(part)
    return none


SOURCE = '''import os


@cached
def first(a, b=1):
    """Says é."""
    def inner():
        return a
    return inner


class Shape(Base):
    size = 1

    async def area(self) -> int:
        return self.size


x = first(1)
'''
SOURCES = (("a.py", "python", SOURCE), ("broken.py", "python", "def (:\n"), ("b.ts", "typescript", "function no() {}\n"), ("crlf.py", "python", "def f():\r\n    pass\r\n"))


def source_structure(spark, sf):
    importable(spark)
    return dv.declared(spark.createDataFrame(list(SOURCES), "rel string, language string, content string")).withColumn("bucket", st.bucket(F.col("kind")))


def source_units(spark, sf):
    importable(spark)
    return dv.units(spark.createDataFrame(list(SOURCES), "rel string, language string, content string"))


def embedded_regions(spark, sf):
    """Declarations of a page and the script that holds each, if one does."""
    points = spark.createDataFrame([("p", 5, "a"), ("p", 10, "b"), ("p", 19, "c"), ("p", 20, "d"), ("p", 30, "e"), ("q", 10, "f")], "rel string, at long, name string")
    regions = spark.createDataFrame([("p", "s1", 10, 20), ("p", "s2", 20, 30), ("p", "s3", 40, 50)], "rel string, range_id string, start long, end long")
    return dv.in_ranges(points, regions)


KINDS = ("function_item", " Method ", "constructor_declaration", "trait_item", "struct_specifier", "impl_item", "namespace", "")


def kind_buckets(spark, sf):
    return spark.createDataFrame([(k,) for k in KINDS], "kind string").withColumn("bucket", st.bucket(F.col("kind")))


NAMES = (
    "divided_chunks", "metadata_bounded_chunks", "reduction_calls", "division_plans", "unit_summaries", "leaf_summaries", "plan_stream", "division_totals", "fixed_width_atoms", "capacity_codes", "source_structure", "source_units", "embedded_regions", "kind_buckets",
)
QUERIES = {name: globals()[name] for name in NAMES}

_GROUPS = docs._PACKED.replace("2000", str(BUDGET))
# lines hold no end of two signs here, so a unit is cut into pieces of ceil or floor of an equal share, the larger first
_CUT = f"""{_GROUPS},
piece AS (SELECT c.*, CASE WHEN big THEN CAST(ceil(chars / {BUDGET}.0) AS INTEGER) ELSE 1 END AS pieces FROM chunks c),
cut0 AS (SELECT *, unnest(range(0, pieces)) AS piece FROM piece),
pc AS (SELECT rel, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk, CAST(count(*) OVER (PARTITION BY rel) AS INTEGER) AS chunks, chunk AS unit_group, CAST(piece AS INTEGER) AS piece, pieces, first_ord AS first_unit, last_ord AS last_unit,
  CAST(CASE WHEN big THEN chars // pieces + CAST(piece < chars % pieces AS INT) ELSE chars END AS BIGINT) AS chars, big, lead(chunk) OVER w AS after_, lead(big) OVER w AS after_big, lead(piece) OVER w AS after_piece
  FROM cut0 WINDOW w AS (PARTITION BY rel ORDER BY chunk, piece)),
full_ AS (SELECT c.*, CASE WHEN big THEN 'continuation' WHEN after_ IS NULL THEN 'end-of-file' WHEN after_big THEN 'oversized-unit-isolation' ELSE 'source-ceiling' END AS reason,
  CASE WHEN chunk = 0 THEN 'file-start' WHEN piece > 0 THEN 'balanced-codepoint' ELSE 'semantic-unit' END AS left_edge,
  CASE WHEN after_ IS NULL THEN 'file-end' WHEN after_piece > 0 THEN 'balanced-codepoint' ELSE 'semantic-unit' END AS right_edge, sum(chars) OVER (PARTITION BY rel ORDER BY chunk) AS upto FROM pc c),
bytes AS (SELECT f.*, CAST(strlen(left(content, CAST(upto - f.chars AS INT))) AS BIGINT) AS start_byte, CAST(strlen(left(content, CAST(upto AS INT))) AS BIGINT) AS end_byte FROM full_ f JOIN files USING (rel))"""
_CALLS = f"""{_CUT},
roots AS (SELECT rel, max(unit_group) + 1 AS n, CASE WHEN max(unit_group) + 1 <= 3 THEN 0 WHEN max(unit_group) + 1 <= 36 THEN 1 WHEN max(unit_group) + 1 <= 432 THEN 2 ELSE 3 END AS levels FROM pc GROUP BY rel),
items AS (SELECT rel, 'unit-consolidation' AS phase, unit_group, pieces AS n, chunk AS from_, 6 AS levels FROM pc WHERE piece = 0 AND pieces > 1 UNION ALL SELECT rel, 'general', NULL, n, 0, levels FROM roots),
lv AS (SELECT *, unnest(range(1, levels + 1)) AS level FROM items), at_ AS (SELECT *, unnest(range(0, CAST(ceil(n / pow(12, level)) AS BIGINT))) AS g FROM lv),
nodes AS (SELECT rel, phase, CAST(level AS INTEGER) AS level, least((g + 1) * CAST(pow(12, level) AS BIGINT), n) AS to_, to_ - g * CAST(pow(12, level) AS BIGINT) AS size, from_ FROM at_ WHERE size > CAST(pow(12, level - 1) AS BIGINT)),
calls AS (SELECT rel, phase, level, count(*) AS nodes, CAST(sum(ceil(size / pow(12, level - 1))) AS BIGINT) AS children, CAST(max(from_ + to_) - 1 AS INTEGER) AS last FROM nodes GROUP BY ALL
  UNION ALL SELECT rel, 'final', 0, 1, CAST(ceil(n / pow(12, levels)) AS BIGINT), CAST(n - 1 AS INTEGER) FROM roots)"""

_PLANS = f"""{_CALLS}, f AS (SELECT rel, max(last_unit) + 1 AS units, count(*) AS chunks, count(*) FILTER (pieces > 1 AND piece = 0) AS continuation_groups FROM pc GROUP BY rel),
n AS (SELECT rel, CAST(coalesce(sum(nodes) FILTER (phase = 'unit-consolidation'), 0) AS BIGINT) AS consolidations, CAST(coalesce(sum(nodes) FILTER (phase = 'general'), 0) AS BIGINT) AS generals, max(level) AS levels FROM calls GROUP BY rel),
plans AS (SELECT rel, 'lexical' AS mode, CAST(units AS BIGINT) AS units, chunks, continuation_groups, consolidations, generals, levels, chunks + consolidations + generals + 1 AS calls, CASE WHEN units > 4096 THEN 'atom-cap' WHEN chunks > 256 THEN 'chunk-cap' END AS blocked FROM f JOIN n USING (rel))"""


def _values(rows, names):
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


ORACLE_SQL = {
    "divided_chunks": f"WITH RECURSIVE {_CUT} SELECT rel, chunk, chunks, unit_group, piece, pieces, first_unit, last_unit, start_byte, end_byte, chars, reason, left_edge, right_edge FROM bytes",
    "reduction_calls": f"WITH RECURSIVE {_CALLS} SELECT rel, phase, level, nodes, children, last FROM calls",
    "division_plans": f"WITH RECURSIVE {_PLANS} SELECT * FROM plans",
    "division_totals": f"""WITH RECURSIVE {_PLANS}, r AS (SELECT *, coalesce(blocked, 'none') AS reason FROM plans)
SELECT CASE grouping(mode, reason) WHEN 1 THEN 'mode' WHEN 2 THEN 'reason' ELSE 'all' END AS of, coalesce(mode, reason, 'all') AS value, count(*) AS files, CAST(sum(units) AS BIGINT) AS units, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(continuation_groups) AS BIGINT) AS continuation_groups, CAST(sum(CASE WHEN blocked IS NULL THEN calls ELSE 0 END) AS BIGINT) AS calls FROM r GROUP BY GROUPING SETS ((mode), (reason), ())""",
    "fixed_width_atoms": f"WITH {docs._ATOMS}, p AS (SELECT rel, ord, source, CAST(unnest(range(0, CAST(ceil(chars / 400.0) AS INT))) AS INTEGER) AS part FROM atoms) SELECT rel, ord, part, sha256(substr(source, part * 400 + 1, 400)) AS digest FROM p",
    "unit_summaries": f"""WITH RECURSIVE {_CUT}, p AS (SELECT rel, first_unit AS ord, string_agg(CAST(chars AS VARCHAR), ',' ORDER BY piece) AS payloads FROM pc WHERE pieces > 1 GROUP BY ALL)
SELECT a.rel, a.ord AS unit, a.chars, CAST(greatest(1, ceil(a.chars / {BUDGET}.0)) AS INTEGER) AS least, CAST(greatest(1, ceil(a.chars / {BUDGET}.0)) AS INTEGER) AS pieces, 0 AS extra, coalesce(payloads, '') AS payloads FROM atoms a LEFT JOIN p ON p.rel = a.rel AND p.ord = a.ord""",
    "leaf_summaries": f"""WITH RECURSIVE {_CUT} SELECT f.rel, f.chunk, f.reason, string_agg(a.ord || ':' || CASE WHEN f.pieces > 1 THEN f.chars ELSE a.chars END, ',' ORDER BY a.ord) AS parts
FROM full_ f JOIN atoms a ON a.rel = f.rel AND a.ord BETWEEN f.first_unit AND f.last_unit GROUP BY ALL""",
    "plan_stream": f"""WITH RECURSIVE {_CALLS}, k AS (SELECT rel, 0 AS o, 'file' AS kind, 1 AS n FROM roots UNION ALL SELECT rel, 1, 'unit', count(*) FROM atoms GROUP BY rel UNION ALL SELECT rel, 2, 'leaf', count(*) FROM pc GROUP BY rel UNION ALL SELECT rel, 3, 'node', sum(nodes) FROM calls GROUP BY rel),
u AS (SELECT *, sum(n) OVER (PARTITION BY rel ORDER BY o) AS upto FROM k) SELECT rel, kind, CAST(n AS BIGINT) AS items, CAST(upto - n AS INTEGER) AS first, CAST(upto - 1 AS INTEGER) AS last FROM u""",
    "capacity_codes": _values([("fits", None), ("a", "atom-cap"), ("s", "symbol-cap"), ("u", "unit-cap"), ("c", "chunk-cap"), ("d", "reduction-depth-cap"), ("f", "final-synthesis-envelope-cap"), ("e", None), ("no envelope", "reduction-envelope-cap"), ("no fan", "reduction-fan-in-cap")], "rel, blocked"),
    "source_structure": _values([
        ("a.py", "function_definition", "first", "def first(a, b=1):", 12, 108, 4, 0, 9, "functions"), ("a.py", "function_definition", "first.inner", "def inner():", 62, 91, 7, 4, 8, "functions"),
        ("a.py", "class_definition", "Shape", "class Shape(Base):", 111, 201, 12, 0, 16, "classes"), ("a.py", "function_definition", "Shape.area", "async def area(self) -> int:", 148, 201, 15, 4, 16, "functions"),
        ("crlf.py", "function_definition", "f", "def f():", 0, 18, 1, 0, 2, "functions"),
    ], "rel, kind, name, signature, start_byte, end_byte, line, \"column\", last_line, bucket"),
    "embedded_regions": _values([("p", 5, "a", None), ("p", 10, "b", "s1"), ("p", 19, "c", "s1"), ("p", 20, "d", "s2"), ("p", 30, "e", None), ("q", 10, "f", None)], "rel, at, name, range_id").replace("(rel, at,", '(rel, "at",'),
    "kind_buckets": _values([("function_item", "functions"), (" Method ", "functions"), ("constructor_declaration", "functions"), ("trait_item", "classes"), ("struct_specifier", "classes"), ("impl_item", None), ("namespace", None), ("", None)], "kind, bucket"),
}
