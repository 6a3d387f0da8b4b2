"""Queries over part keys and pages as graphs, and over inline import lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import classify as cl
from millrace.functions import imports as im
from millrace.functions import text as tx
from millrace.operators import graph as gr
from millrace.operators import view as vw
from millrace.session import importable, table


def part_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("rel"))


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Part p above 0 to 2p and 2p + 1, where there: no cycles."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    out = p.filter("k > 0").select("k", F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("d"))
    return out.join(p.select(F.col("k").alias("d")), "d").select(F.col("k").cast("string").alias("src"), F.col("d").cast("string").alias("dst"))


def cyclic_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Part p to 3p and 3p + 2, and from multiples of 10 back to a third."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    out = p.select("k", F.explode(F.array(F.col("k") * 3, F.col("k") * 3 + 2)).alias("d")).unionByName(p.filter("k % 10 = 0").select("k", F.floor(F.col("k") / 3).alias("d")))
    return out.join(p.select(F.col("k").alias("d")), "d").select(F.col("k").cast("string").alias("src"), F.col("d").cast("string").alias("dst"))


def reachable(spark, sf):
    return gr.reachable(part_edges(spark, sf), part_files(spark, sf), "3").select("node", "depth")


def affected_by_changes(spark, sf):
    changed = spark.createDataFrame([("100",), ("77",), ("not a part",)], "node string")
    return gr.affected(cyclic_edges(spark, sf), changed).select("node", "depth")


def entry_selection(spark, sf):
    chosen = gr.select_files(cyclic_edges(spark, sf), part_files(spark, sf), "2")
    return chosen.groupBy("reachable", "documented").agg(F.count(F.lit(1)).alias("files"), F.min("rel").alias("first_rel"))


def topo_level(spark, sf):
    nodes = part_files(spark, sf).select(F.col("rel").alias("node"))
    return gr.topological(part_edges(spark, sf), nodes).select("node", "level")


def topo_rank(spark, sf):
    nodes = part_files(spark, sf).select(F.col("rel").alias("node"))
    return gr.topological(part_edges(spark, sf), nodes).select("node", "rank")


def topo_rank_with_cycles(spark, sf):
    nodes = part_files(spark, sf).select(F.col("rel").alias("node"))
    return gr.topological(cyclic_edges(spark, sf), nodes)


def graph_summary(spark, sf):
    return gr.summary(cyclic_edges(spark, sf), part_files(spark, sf).select(F.col("rel").alias("node")))


def link_edges(spark, sf):
    """Pages to the names they link to."""
    pages = table(spark, sf, "pages")
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select(F.col("page_id").cast("string").alias("src"), F.explode(hrefs).alias("dst")).distinct()


def edge_indexes(spark, sf):
    index = gr.edge_indexes(link_edges(spark, sf))
    return index.select("node", F.array_join("dependencies", " ").alias("dependencies"), F.array_join("dependents", " ").alias("dependents"))


def page_hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("folder")).agg(F.count(F.lit(1)).alias("pages"))


# Inline imports: (rel, ord, raw), and the files of a small project.
PROJECT = ("src/app/main.py", "src/app/util.py", "src/app/__init__.py", "src/lib/core.ts", "src/lib/index.ts", "src/lib/view/index.tsx", "src/lib/x.c", "src/lib/x.py", "lib/dart_ui.dart", "web/index.html", "web/app.js", "pkg/mod.go", "Main.java", "src/app/sub/__init__.py")
IMPORTS = (
    ("src/app/main.py", 0, ".util"), ("src/app/main.py", 1, "."), ("src/app/main.py", 2, "..lib.x"), ("src/app/main.py", 3, "os.path"), ("src/app/main.py", 4, "src.app.util"), ("src/app/main.py", 5, "util"),
    ("src/app/main.py", 6, ".sub"), ("src/app/util.py", 0, "numpy"), ("src/app/util.py", 1, "app.core"), ("src/lib/core.ts", 0, "./view"), ("src/lib/core.ts", 1, "./x"), ("src/lib/core.ts", 2, "../app/util"),
    ("src/lib/core.ts", 3, "@scope/pkg/deep"), ("src/lib/core.ts", 4, "./a.service"), ("src/lib/core.ts", 5, "."), ("lib/dart_ui.dart", 0, "package:app/dart_ui.dart"), ("lib/dart_ui.dart", 1, "dart:async"),
    ("lib/dart_ui.dart", 2, "package:flutter/material.dart"), ("web/index.html", 0, "app.js"), ("web/index.html", 1, "/web/app.js"), ("web/index.html", 2, "HTTPS://cdn/x.js"), ("Main.java", 0, "pkg.mod"), ("Main.java", 1, "java.util.List"),
    ("src/app/util.py", 2, "../lib/x.py"), ("src/app/util.py", 3, "Src.App.Util"), ("src/app/__init__.py", 0, "."), ("pkg/mod.go", 0, "github.com/x/y"), ("src/lib/core.ts", 6, "..\\lib\\x.c"), ("src/app/main.py", 7, ""),
)
#: What the rules give, worked out by hand.
RESOLVED = {
    ("src/app/main.py", 0): "src/app/util.py", ("src/app/main.py", 1): "src/app/__init__.py", ("src/app/main.py", 2): "src/lib/x.c", ("src/app/main.py", 4): "src/app/util.py", ("src/app/main.py", 5): "src/app/util.py",
    ("src/app/main.py", 6): "src/app/sub/__init__.py", ("src/lib/core.ts", 0): "src/lib/view/index.tsx", ("src/lib/core.ts", 1): "src/lib/x.c", ("src/lib/core.ts", 2): "src/app/util.py", ("src/lib/core.ts", 5): "src/lib/index.ts",
    ("lib/dart_ui.dart", 0): "lib/dart_ui.dart", ("web/index.html", 0): "web/app.js", ("web/index.html", 1): "web/app.js", ("Main.java", 0): "pkg/mod.go",
    ("src/app/__init__.py", 0): "src/app/__init__.py", ("src/app/util.py", 2): "src/lib/x.py",
}
LANGUAGE = {"py": "python", "ts": "typescript", "tsx": "tsx", "dart": "dart", "html": "html", "js": "javascript", "go": "go", "java": "java", "c": "c"}


def project(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    importable(spark)
    files = spark.createDataFrame([(p, LANGUAGE[p.rsplit(".", 1)[1]]) for p in PROJECT], "rel string, language string")
    return spark.createDataFrame(list(IMPORTS), "rel string, ord int, raw string"), files


def resolve_candidates(spark, sf):
    imports, files = project(spark)
    return gr.resolve(imports, files).select("rel", "ord", "raw", "target")


def unresolved_refs(spark, sf):
    imports, files = project(spark)
    return gr.unresolved(gr.resolve(imports, files))


def classify_dependency(spark, sf):
    raws = ("os.path", " numpy.linalg ", ".rel", "./x\\y", "node:fs/promises", "fs", "@a/b/c", "@a", "react/dom", "dart:io", "package:x/y.dart", "package:./z", "", "crypto/x")
    pairs = [(r, lang) for r in raws for lang in ("python", "TypeScript", "dart", "java")]
    frame = spark.createDataFrame(pairs, "raw string, language string")
    return frame.withColumn("d", cl.dependency(F.col("raw"), F.col("language"))).select("raw", "language", "d.canonical", "d.kind")


def project_links(spark, sf):
    imports, files = project(spark)
    found = gr.resolve(imports, files)
    model = spark.createDataFrame([("src/lib/core.ts", "rxjs/operators"), ("src/lib/core.ts", "fs"), ("src/app/util.py", "invented")], "rel string, raw string")
    return vw.links(gr.unresolved(found).filter("raw <> ''"), files, gr.edges(found), model)


def dependency_catalog(spark, sf):
    """Suppliers as files, part sizes as dependencies: which are known for a text, and what text."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    pairs = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").cast("string").alias("rel"), "p_size").distinct()
    kind = F.when(F.col("p_size") % 7 == 0, "internal").when(F.col("p_size") % 3 == 0, "sdk").otherwise("external")
    keys = pairs.select("rel", kind.alias("type"), F.col("p_size").cast("string").alias("name"))
    order = keys.select("rel").distinct().select("rel", F.col("rel").cast("int").alias("ord"))
    said = keys.withColumn("h", F.expr("(cast(rel as int) * 31 + cast(name as int) * 17) % 11")).filter("h < 4")
    texts = said.select("rel", "type", "name", F.col("h").alias("seq"), F.when(F.col("h") < 2, "update").otherwise("note").alias("origin"), F.concat(F.try_element_at(F.array(*[F.lit(x) for x in ("used", "api of the app", "database schema", "state")]), F.col("h").cast("int") + 1), F.lit(" "), F.repeat(F.lit("x"), F.expr("cast(rel as int) % 4"))).alias("used_for"))
    found = vw.catalog(keys, texts, order)
    return found.select("type", "name", "used_for", F.array_join("files", ",").alias("files"), "file_count")


SOURCES = (
    ("a.ts", "typescript", "import x from './a'\nimport './b'\nimport y from 'react'\nexport * from '@lib/c'\nconst z = require('../d')\nimport('./e'); import x2 from './a'\n"),
    ("b.java", "java", "package q;\nimport java.util.List;\n  import a.b.C ;\n// import no.such\n"), ("c.cs", "csharp", "using System.Text;\nusing X;\n"), ("d.rs", "rust", "use std::io;\nmod inner;\nextern crate serde;\n"),
    ("e.c", "c", '#include <stdio.h>\n  #include "x/y.h"\n'), ("f.rb", "ruby", "require 'json'\nrequire_relative \"./g\"\n"), ("g.html", "html", '<script defer src="a.js"></script><SCRIPT src=\'b.js\'></SCRIPT><link href="c.css">'),
    ("h.kt", "kotlin", "import a.b\nimport c\n"), ("i.swift", "swift", "import Foundation\n"), ("j.dart", "dart", "import 'dart:io';\npart \"p.dart\";\n"), ("k.xyz", "unknown", "use 'lib'\nimport some/path-x\n"),
)


def pattern_imports(spark, sf):
    importable(spark)
    frame = spark.createDataFrame(list(SOURCES), "rel string, language string, content string")
    found = im.by_pattern(F.col("content"), "")
    for name in im.PATTERNS:
        names = ("javascript", "typescript") if name == "javascript" else (name,)
        found = F.when(F.col("language").isin(*names), im.by_pattern(F.col("content"), name)).otherwise(found)
    return frame.select("rel", F.posexplode(found).alias("ord", "raw"))


def parsed_imports(spark, sf):
    importable(spark)
    extra = (("l.py", "python", "import os, sys\ndef f():\n    import json\nfrom . import x\nfrom ..a.b import c\nfrom os import path\n"), ("m.py", "python", "def (:\n"), ("n.go", "go", 'import "fmt"\nimport (\n a "x/y" // "no"\n `raw/z`\n)\n/* import "nope" */\nvar s = "not"\nimport . "esc\\x2fd"\n'))
    frame = spark.createDataFrame([*SOURCES, *extra], "rel string, language string, content string")
    return frame.select("rel", F.array_join(im.imports(F.col("content"), F.col("language")), " ").alias("found"))


def normalised_paths(spark, sf):
    paths = [(p,) for p in ("a//b/./c", "../x", "a/../../b", "a\\b\\..\\c", "", "/", "./.ts", "x/y.TSX", ".hidden", "a/b.tar.gz")]
    return spark.createDataFrame(paths, "path string").select("path", tx.posix(F.col("path")).alias("posix"), tx.extension(F.col("path")).alias("extension"), tx.top_folder(tx.posix(F.col("path"))).alias("folder"))


NAMES = (
    "reachable", "affected_by_changes", "entry_selection", "topo_level", "topo_rank", "topo_rank_with_cycles", "graph_summary", "link_edges", "edge_indexes", "page_hosts", "resolve_candidates", "unresolved_refs",
    "classify_dependency", "project_links", "dependency_catalog", "pattern_imports", "parsed_imports", "normalised_paths",
)
QUERIES = {name: globals()[name] for name in NAMES}

_PARTS = "parts AS (SELECT p_partkey AS k FROM part), tree AS (SELECT a.k AS src, b.k AS dst FROM parts a JOIN parts b ON a.k > 0 AND b.k IN (a.k * 2, a.k * 2 + 1))"
_CYCLIC = "parts AS (SELECT p_partkey AS k FROM part), tree AS (SELECT a.k AS src, b.k AS dst FROM parts a JOIN parts b ON b.k = a.k * 3 OR b.k = a.k * 3 + 2 OR (a.k % 10 = 0 AND b.k = a.k // 3))"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'" if "\n" not in value else "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in value.split("\n")) + ")"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else _quoted(v) for v in r) + ")" for r in rows)


_TARGETS = _rows([(rel, o, raw, RESOLVED.get((rel, o))) for rel, o, raw in IMPORTS])
_CLASSES = """CASE WHEN v = '' THEN '' WHEN lang = 'dart' THEN CASE WHEN v LIKE 'dart:%' THEN v WHEN regexp_replace(v, '^package:', '') LIKE './%' OR regexp_replace(v, '^package:', '') LIKE '../%' THEN replace(regexp_replace(v, '^package:', ''), '\\', '/') ELSE split_part(regexp_replace(v, '^package:', ''), '/', 1) END
WHEN lang = 'python' THEN CASE WHEN v LIKE './%' OR v LIKE '../%' THEN replace(v, '\\', '/') ELSE trim(split_part(v, '.', 1)) END
WHEN lang = 'typescript' THEN CASE WHEN v LIKE 'node:%' THEN split_part(substr(v, 6), '/', 1) WHEN v LIKE './%' OR v LIKE '../%' THEN replace(v, '\\', '/') WHEN v LIKE '@%' THEN array_to_string(list_slice(string_split(v, '/'), 1, 2), '/') ELSE split_part(v, '/', 1) END ELSE v END"""

ORACLE_SQL = {
    "reachable": f"WITH RECURSIVE {_PARTS}, r AS (SELECT 3::BIGINT AS n, 0 AS depth UNION SELECT t.dst, depth + 1 FROM r JOIN tree t ON t.src = r.n) SELECT CAST(n AS VARCHAR) AS node, min(depth) AS depth FROM r WHERE n IN (SELECT k FROM parts) GROUP BY n",
    "affected_by_changes": f"""WITH RECURSIVE {_CYCLIC}, r AS (SELECT unnest(['100', '77', 'not a part']) AS n, 0 AS depth UNION SELECT CAST(t.src AS VARCHAR), depth + 1 FROM r JOIN tree t ON CAST(t.dst AS VARCHAR) = r.n WHERE depth < 40)
SELECT n AS node, min(depth) AS depth FROM r GROUP BY n""",
    "entry_selection": f"""WITH RECURSIVE {_CYCLIC}, r AS (SELECT 2::BIGINT AS n UNION SELECT t.dst FROM r JOIN tree t ON t.src = r.n)
SELECT k IN (SELECT n FROM r) AS reachable, k IN (SELECT n FROM r) AS documented, count(*) AS files, min(CAST(k AS VARCHAR)) AS first_rel FROM parts GROUP BY 1""",
    "topo_level": f"WITH RECURSIVE {_PARTS}, r AS (SELECT k AS n, 0 AS level FROM parts WHERE k NOT IN (SELECT src FROM tree) UNION SELECT t.src, level + 1 FROM r JOIN tree t ON t.dst = r.n) SELECT CAST(n AS VARCHAR) AS node, max(level) AS level FROM r GROUP BY n",
    "graph_summary": f"WITH {_CYCLIC} SELECT (SELECT count(*) FROM parts) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT * FROM tree)) AS edges",
    "link_edges": """SELECT DISTINCT CAST(page_id AS VARCHAR) AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM pages""",
    "edge_indexes": """WITH e AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM pages), x AS (SELECT * FROM e WHERE dst <> ''),
f AS (SELECT src AS node, string_agg(dst, ' ' ORDER BY dst) AS d FROM x GROUP BY src), b AS (SELECT dst AS node, string_agg(src, ' ' ORDER BY src) AS d FROM x GROUP BY dst)
SELECT coalesce(f.node, b.node) AS node, coalesce(f.d, '') AS dependencies, coalesce(b.d, '') AS dependents FROM f FULL JOIN b ON f.node = b.node""",
    "page_hosts": "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS folder, count(*) AS pages FROM pages GROUP BY 1",
    "resolve_candidates": f"SELECT * FROM (VALUES {_TARGETS}) AS t(rel, ord, raw, target)",
    "unresolved_refs": f"SELECT rel, ord, raw FROM (VALUES {_TARGETS}) AS t(rel, ord, raw, target) WHERE target IS NULL",
    "classify_dependency": f"""WITH p AS (SELECT raw, language, trim(raw) AS v, lower(language) AS lang FROM (SELECT unnest(['os.path', ' numpy.linalg ', '.rel', './x\\y', 'node:fs/promises', 'fs', '@a/b/c', '@a', 'react/dom', 'dart:io', 'package:x/y.dart', 'package:./z', '', 'crypto/x']) AS raw) CROSS JOIN (SELECT unnest(['python', 'TypeScript', 'dart', 'java']) AS language)),
c AS (SELECT *, {_CLASSES} AS canonical FROM p)
SELECT raw, language, canonical, CASE WHEN lang = 'dart' AND v LIKE 'dart:%' THEN 'sdk' WHEN lang = 'python' AND canonical IN ('os') AND v NOT LIKE '.%' THEN 'sdk' WHEN lang = 'typescript' AND (v LIKE 'node:%' OR (canonical IN ('fs', 'crypto') AND v NOT LIKE '.%')) THEN 'sdk' ELSE 'external' END AS kind FROM c""",
    "project_links": f"""SELECT * FROM (VALUES {_rows([("src/app/main.py", "sdk", "os"), ("src/app/util.py", "external", "numpy"), ("src/app/util.py", "external", "app"), ("src/app/util.py", "external", "Src"), ("src/lib/core.ts", "external", "rxjs"), ("src/lib/core.ts", "sdk", "fs"), ("lib/dart_ui.dart", "sdk", "dart:async"), ("lib/dart_ui.dart", "external", "flutter"), ("web/index.html", "external", "HTTPS://cdn/x.js"), ("Main.java", "external", "java.util.List"), ("pkg/mod.go", "external", "github.com/x/y")])}) AS t(rel, kind, canonical)""",
    "dependency_catalog": """WITH keys AS (SELECT DISTINCT l_suppkey AS ord, CAST(l_suppkey AS VARCHAR) AS rel, CASE WHEN p_size % 7 = 0 THEN 'internal' WHEN p_size % 3 = 0 THEN 'sdk' ELSE 'external' END AS type, CAST(p_size AS VARCHAR) AS name, (l_suppkey * 31 + p_size * 17) % 11 AS h FROM lineitem JOIN part ON l_partkey = p_partkey),
texts AS (SELECT *, CASE WHEN h < 2 THEN 'update' ELSE 'note' END AS origin, ['used', 'api of the app', 'database schema', 'state'][h + 1] || ' ' || repeat('x', CAST(ord % 4 AS INT)) AS t FROM keys WHERE h < 4 AND NOT (type <> 'x' AND type = 'internal' AND h >= 2)),
first_ AS (SELECT type, name, min(ord) AS since, min_by(t, ord) AS first_text FROM texts GROUP BY ALL),
better AS (SELECT t.type, t.name, t.t, length(t.t) AS len, t.ord, t.origin FROM texts t),
ranked AS (SELECT b.type, b.name, b.t, row_number() OVER (PARTITION BY b.type, b.name ORDER BY s.hits DESC, s.len DESC, b.ord) AS nth FROM better b JOIN first_ f ON f.type = b.type AND f.name = b.name
  CROSS JOIN LATERAL (SELECT (CASE WHEN b.t LIKE 'api%' THEN 2 WHEN b.t LIKE 'database%' THEN 2 WHEN b.t LIKE 'state%' THEN 1 ELSE 0 END) AS hits, b.len AS len) s WHERE b.origin = 'update' OR b.ord = f.since),
backing AS (SELECT k.type, k.name, k.rel FROM keys k JOIN first_ f ON f.type = k.type AND f.name = k.name WHERE (k.type <> 'internal' AND k.ord >= f.since) OR EXISTS (SELECT 1 FROM texts t WHERE t.type = k.type AND t.name = k.name AND t.rel = k.rel))
SELECT r.type, r.name, r.t AS used_for, string_agg(DISTINCT b.rel, ',' ORDER BY b.rel) AS files, count(DISTINCT b.rel) AS file_count FROM ranked r JOIN backing b ON b.type = r.type AND b.name = r.name WHERE r.nth = 1 GROUP BY ALL""",
    "pattern_imports": f"""SELECT * FROM (VALUES {_rows([("a.ts", 0, "./a"), ("a.ts", 1, "./b"), ("a.ts", 2, "@lib/c"), ("a.ts", 3, "../d"), ("a.ts", 4, "./e"), ("b.java", 0, "java.util.List"), ("b.java", 1, "a.b.C"), ("c.cs", 0, "System.Text"), ("c.cs", 1, "X"), ("d.rs", 0, "std::io"), ("d.rs", 1, "inner"), ("d.rs", 2, "serde"), ("e.c", 0, "stdio.h"), ("e.c", 1, "x/y.h"), ("f.rb", 0, "json"), ("f.rb", 1, "./g"), ("g.html", 0, "a.js"), ("g.html", 1, "b.js"), ("h.kt", 0, "a.b"), ("h.kt", 1, "c"), ("i.swift", 0, "Foundation"), ("j.dart", 0, "dart:io"), ("j.dart", 1, "p.dart"), ("k.xyz", 0, "lib"), ("k.xyz", 1, "some/path-x")])}) AS t(rel, ord, raw)""",
    "normalised_paths": """SELECT * FROM (VALUES ('a//b/./c', 'a/b/c', '', 'a'), ('../x', 'x', '', '.'), ('a/../../b', 'b', '', '.'), ('a\\b\\..\\c', 'a/c', '.\\c', 'a'), ('', '', '', '.'), ('/', '', '', '.'), ('./.ts', '.ts', '', '.'), ('x/y.TSX', 'x/y.TSX', '.tsx', 'x'), ('.hidden', '.hidden', '', '.'), ('a/b.tar.gz', 'a/b.tar.gz', '.gz', 'a')) AS t(path, posix, extension, folder)""",
}
