"""Queries over project documents, cleaned answers, profiles, and the small operators around a run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import cleaning as cn
from millrace.operators import ledger as lg
from millrace.operators import planning as pl
from millrace.operators import project as pj
from millrace.operators import responses as rs
from millrace.operators import view as vw
from millrace.plans import documents as docs
from millrace.plans import graphs
from millrace.session import checkpoint_folder, dropped, importable, pinned, table
from millrace.streaming import incremental as inc

RUN = {"entry_file": "src/main.py", "entry_source": "auto", "files_documented_by_llm": 3, "files_reused_unchanged": 4, "files_resumed_from_recovery": 2}


def _records(spark, sf):
    """Documents as records: texts of several lines, symbols with and without a description, every other one without a role."""
    d = table(spark, sf, "documents").withColumn("rel", docs.from_rel())
    symbol = lambda name, text: F.struct(name.alias("name"), text.alias("description"))
    odd = F.col("doc_id") % 2 == 1
    return d.select(
        F.sha2("text", 256).alias("hash"), F.col("rel").alias("path"), F.col("lang").alias("language"), F.concat(F.lit("About "), "rel", F.lit(".\n\nSecond `part`: "), F.col("n_chars").cast("string")).alias("description"),
        F.when(odd, F.lit("")).otherwise(F.concat(F.lit("Role of "), "source")).alias("role_in_system"), F.array(F.lit("os"), F.col("lang")).alias("imports"),
        F.array(symbol(F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.lit("does: *x*")), symbol(F.lit("g"), F.lit(""))).alias("functions"), F.array(F.col("lang")).alias("exports"),
        F.when(odd, F.array(F.col("source"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("key_concepts"), F.when(F.col("doc_id") % 3 == 0, "from Your_Project import x").otherwise("x = 1\ny = 2").alias("usage_example"),
        (~odd).alias("reachable_from_entry"), F.when(odd, F.struct(F.array(F.lit("a/b.py")).alias("internal_dependencies"), F.array().cast("array<string>").alias("imported_by"), F.array(F.lit("numpy"), F.lit("x`y")).alias("external_dependencies"), F.array(F.lit("os")).alias("sdk_dependencies"))).alias("links"),
        F.struct(F.lit("r0").alias("analysis_revision"), F.lit("single").alias("analysis_mode")).alias("inner"), F.when(odd, "r1").alias("analysis_revision"),
    )


def _view(spark, sf) -> pj.View:
    files = docs.files(spark, sf)
    folders = vw.folder_rollup(files).select(F.col("folder").alias("path"), F.concat(F.lit("Files of "), "folder").alias("summary"), "file_count", "languages", "files")
    catalog = files.groupBy(F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("file_count")).select("name", F.lit("external").alias("type"), F.when(F.col("name") != "fr", F.concat(F.lit("talks "), "name")).alias("used_for"), F.array(F.lit("x")).alias("files"), "file_count")
    edges = docs.doc_edges(spark, sf).select(F.col("src").alias("from"), F.col("dst").alias("to"))
    return pj.View(_records(spark, sf), folders, catalog, edges, RUN, "one error")


def _flat(files):
    joined = lambda c: F.array_join(c, "|").alias(c)
    said = F.array_join(F.transform("functions", lambda s: F.concat(s["name"], F.lit("="), F.coalesce(s["description"], F.lit("")))), "|").alias("functions")
    links = F.concat_ws("|", "links.internal_dependencies", "links.external_dependencies", "links.sdk_dependencies").alias("links")
    return files.select("path", "language", "description", "role_in_system", joined("imports"), said, joined("exports"), joined("key_concepts"), "usage_example", "reachable_from_entry", links)


def public_records(spark, sf):
    found = pj.public_files(_records(spark, sf), nested="inner")
    return found.select("path", "hash", "role_in_system", F.size("key_concepts").alias("concepts"), "usage_example", F.col("classes").isNull().alias("no_classes"), "analysis_revision", "analysis_mode", "ordinary_path_identity")


def project_sections(spark, sf):
    files = pj.public_files(_records(spark, sf))
    return files.select("path", pj.file_section(files).alias("section"))


def project_blocks(spark, sf):
    blocks = pj.markdown_blocks(_view(spark, sf)).filter("part <> 8")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda b: b["text"]), "")
    return blocks.groupBy("part").agg(F.count(F.lit(1)).alias("blocks"), F.sha2(whole, 256).alias("digest"))


def _written(spark, blocks, read):
    importable(spark)
    folder = f"{checkpoint_folder(spark).rstrip('/')}/document-{uuid.uuid4().hex}"
    pj.write(blocks, folder)
    rows = pinned(read(folder))
    dropped(spark, folder)
    return rows


def project_markdown_read(spark, sf):
    """Files from what the document shows: the comments that hold them whole are taken out before."""
    bare = lambda rows: rows.select(F.regexp_replace("body", "<!-- file:[A-Za-z0-9+/=\\s]* -->\n\n?", "").alias("body"))
    return _flat(_written(spark, pj.markdown_blocks(_view(spark, sf)), lambda folder: pj.files_of(bare(pj.stored_chunks(spark, folder, "Files")))))


def project_markdown_whole(spark, sf):
    found = _written(spark, pj.markdown_blocks(_view(spark, sf)), lambda folder: pj.files_of(pj.stored_chunks(spark, folder, "Files")))
    return _flat(found).join(found.select("path", "hash", "analysis_revision"), "path")


def project_json_read(spark, sf):
    found = _written(spark, pj.json_blocks(_view(spark, sf)), lambda folder: pj.read_json(pj.read_text(spark, folder)))
    return _flat(found).join(found.select("path", "hash", "analysis_revision"), "path")


def project_catalog_read(spark, sf):
    return _written(spark, pj.markdown_blocks(_view(spark, sf)), lambda folder: pj.catalog_of(pj.stored_chunks(spark, folder, "Dependency Catalog")))


def project_edges_read(spark, sf):
    return _written(spark, pj.markdown_blocks(_view(spark, sf)), lambda folder: pj.stored_edges(spark, folder))


def run_summary(spark, sf):
    return pj.figures(pj.View(_records(spark, sf), run=RUN))


NOTES = (("a.py", 0, "os", "paths"), ("a.py", 1, " os ", "files"), ("a.py", 2, "re", " "), ("a.py", 3, "", "x"), ("b.py", 0, "re", "patterns"))


def usage_note_map(spark, sf):
    found = pj.usage_notes(spark.createDataFrame(list(NOTES), "rel string, ord int, import string, used_for string"))
    return found.select("rel", F.to_json("notes").alias("notes"))


# ---- answers


def _answers(spark, sf):
    said = table(spark, sf, "conversations").filter("role = 'assistant'")
    body = F.to_json(F.struct(F.concat(F.lit(" "), "text").alias("description"), F.split("text", " ").alias("key_concepts"), F.lit(7).alias("role_in_system"), F.col("turn").cast("string").alias("mood")))
    return said.select("conv_id", "turn", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")).alias("raw"))


def cleaned_documentation(spark, sf):
    importable(spark)
    found = cn.contracts(_answers(spark, sf), "documentation")
    part = lambda name: F.get_json_object("contract.body", f"$.{name}")
    count = lambda reason: F.size(F.filter("contract.removed", lambda r: r["reason"] == reason)).alias(reason)
    concepts = F.array_join(F.from_json(part("key_concepts"), "array<string>"), " ")
    return found.select("conv_id", "turn", part("description").alias("description"), concepts.alias("key_concepts"), count("wrong_type"), count("unknown_field"), F.array_join("contract.retained", ",").alias("retained"))


ANSWERS = (
    ("combined", "nothing"), ("combined", '{"description": '), ("combined", "{"), ("combined", "{]}"), ("combined", "[1]"), ("combined", '{"mood": 1}'), ("combined", '{"role_in_system": "r"}'),
    ("combined", '{"description": " d ", "functions": [{"name": "f", "description": 3, "x": 1}, {"name": " "}, 5, {"name": "f"}], "dependencies_analysis": {"catalog_updates": [{"name": "n", "type": "sdk", "used_for": "u"}, {"name": "n", "type": "internal", "used_for": "u"}], "usage_notes": [{"import": "os"}], "odd": []}}'),
    ("leaf", '{"description": "' + "x" * 301 + '"}'), ("leaf", '{"description": "d", "functions": [{"name": "f", "signature": "f()"}, {"name": "f", "signature": "f()"}], "exports": []}'),
    ("reduction", '{"narrative": "n"}'), ("reduction", '{"narrative": null}'), ("dependency", '{"internal": ["./a", "./a", ""], "warnings": []}'), ("structure", None),
)
# What the rules give, worked out by hand: stage, reason, body, and removals as path=reason.
JUDGED = (
    ("json_extract", "no_json_object", None, ""), ("json_extract", "no_json_object", None, ""), ("json_extract", "no_json_object", None, ""), ("json_parse", "json_parse_error", None, ""), ("top_level", "top_level_not_object", None, ""),
    ("profile_filter", "no_usable_fields", None, "mood=unknown_field"), ("required_fields", "missing_required", None, ""),
    (None, None, '{"dependencies_analysis":{"catalog_updates":[{"name":"n","type":"internal","used_for":"u"}]},"description":"d","functions":[{"name":"f"}]}', "functions[0].x=unknown_field functions[0].description=wrong_type functions[1].name=empty_value functions[2]=wrong_type functions[3]=duplicate dependencies_analysis.odd=unknown_field dependencies_analysis.catalog_updates[0].type=invalid_value dependencies_analysis.usage_notes[0].used_for=wrong_type"),
    ("clean", "fixed_cap_exceeded", None, "description=response_cap"), (None, None, '{"description":"d","functions":[{"name":"f","signature":"f()"},{"name":"f","signature":"f()"}]}', ""),
    (None, None, '{"narrative":"n"}', ""), ("profile_filter", "no_usable_fields", None, "narrative=wrong_type"), (None, None, '{"dependencies_analysis":{"internal":["./a"]}}', "dependencies_analysis.internal[1]=duplicate dependencies_analysis.internal[2]=empty_value"), ("json_extract", "no_json_object", None, ""),
)


def contract_outcomes(spark, sf):
    importable(spark)
    rows = spark.createDataFrame([(n, k, r) for n, (k, r) in enumerate(ANSWERS)], "id int, kind string, raw string")
    out = None
    for kind in dict.fromkeys(k for k, _ in ANSWERS):
        found = cn.contracts(rows.filter(F.col("kind") == kind), kind)
        out = found if out is None else out.unionByName(found)
    removed = F.array_join(F.transform("contract.removed", lambda r: F.concat(r["path"], F.lit("="), r["reason"])), " ")
    return out.select("id", "contract.stage", "contract.reason", "contract.body", removed.alias("removed"))


def requested_fields(spark, sf):
    importable(spark)
    found = cn.contracts(_answers(spark, sf), "documentation", requested=("description",))
    dropped_ = F.filter("contract.removed", lambda r: r["reason"] == "not_requested")
    return found.select("conv_id", "turn", F.array_join("contract.retained", ",").alias("retained"), F.get_json_object("contract.body", "$.key_concepts").isNull().alias("no_concepts"), F.array_join(F.transform(dropped_, lambda r: r["path"]), ",").alias("not_requested"))


DEFAULTS = {"description": "what it is", "key_concepts": "main ideas", "role_in_system": "its part", "usage_example": "how to use it"}
PROFILE = cn.Profile("documentation", DEFAULTS, {".en": {"description": "what it is, in all files"}, ".de": {"description": "was es ist", "key_concepts": "main ideas"}})


def profile_scopes(spark, sf):
    shaped = cn.shaped(docs.files(spark, sf), PROFILE)
    return shaped.groupBy(F.coalesce("scope", F.lit("*")).alias("scope"), "shape").agg(F.count(F.lit(1)).alias("files"))


NAMED = ("a.ts", "A.D.TS", ".ts", "x/.d.ts", "b.d.ts", "dir.ts/c.js", "c.ts.js", "w\\v.ts")


def profile_selectors(spark, sf):
    return spark.createDataFrame([(n,) for n in NAMED], "rel string").withColumn("scope", cn.selector(F.col("rel"), (".ts", ".d.ts", ".js")))


def review_batches(spark, sf):
    importable(spark)
    units = cn.review_units(docs.files(spark, sf), PROFILE, DEFAULTS)
    return cn.review_batches(units, 110)


# ---- around a run

FORCED = ("src/a.py", "./src//b.py", "src\\c.py", "../x.py", "/abs.py", "C:/x.py", "src/../d.py", "src/../../e.py", "", ".", " e.py ")


def forced_paths(spark, sf):
    return spark.createDataFrame([(p,) for p in FORCED], "given string").withColumn("rel", pl.forced_paths(F.col("given")))


def scope_figures(spark, sf):
    planned = docs.planned(spark, sf)
    chosen = table(spark, sf, "documents").select(docs.from_rel(), (F.col("doc_id") % 3 > 0).alias("reachable"), (F.col("doc_id") % 3 != 1).alias("documented"))
    return pl.scope_counts(chosen, planned, pl.manifest(planned, pl.Run(mode="triple")))


def run_partition(spark, sf):
    """Files whose outcome is known by their length: a third is never asked, a third fails."""
    planned = docs.planned(spark, sf)
    return pl.run_partition(planned, planned.filter("route = 'agent' AND chars % 3 < 2").select("rel", (F.col("chars") % 3 == 0).alias("ok")))


STRICT = ('{"a":1,"b":[]}', '{"b":1,"a":2}', '{"a": 1}', '{"a":1,"a":1}', '{"a":NaN}', "[1]", "{}", "", '{"é":"é"}', '{"\\u00e9":1}', '{"a":1}}')


def strict_objects(spark, sf):
    importable(spark)
    return spark.createDataFrame([(t,) for t in STRICT], "text string").withColumn("strict", rs.strict_json(F.col("text")).isNotNull())


def repeated_symbols(spark, sf):
    rows = spark.createDataFrame([(0, [("f", "x"), (" f ", "x"), ("", "y"), ("g", " "), ("f", "x")])], "id int, xs array<struct<name:string,description:string>>")
    shown = lambda distinct: F.array_join(F.transform(rs.clean_symbols(F.col("xs"), 4, distinct), lambda s: F.concat_ws("=", s["name"], s["description"])), ",")
    return rows.select("id", shown(True).alias("collapsed"), shown(False).alias("every"))


def unattempted_calls(spark, sf):
    calls = pl.manifest(docs.planned(spark, sf), docs.RUN)
    return pl.unattempted(calls, calls.filter("seq % 4 <> 0").select("call_id")).select("seq", "category", "rel")


def ordered_files(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", docs.from_rel())
    ranked = d.select("rel", F.when(F.col("doc_id") % 5 > 0, -F.col("doc_id")).alias("rank"))
    fresh = d.filter("doc_id % 2 = 0").select("rel", F.lit("new").alias("record"))
    found = vw.file_order(ranked, fresh, d.filter("doc_id % 3 = 0").select("rel", F.lit("old").alias("record")))
    return found.select("rel", "rank", "record")


def eligible_dependencies(spark, sf):
    linked = spark.createDataFrame([("a.py", "sdk", "os"), ("a.py", "sdk", "os"), ("b.py", "external", "numpy")], "rel string, kind string, canonical string")
    edges = spark.createDataFrame([("a.py", "b.py"), ("a.py", "b.py")], "src string, dst string")
    return vw.eligible_keys(linked, edges)


def published_exports(spark, sf):
    exports = spark.createDataFrame([("a.py", "x"), ("a.py", "y"), ("a.py", "z"), ("b.py", "x")], "rel string, name string")
    proven = spark.createDataFrame([("a.py", "z", 30), ("a.py", "x", 20), ("a.py", "x", 10), ("b.py", "y", 5)], "rel string, name string, start int")
    return lg.public_exports(exports, proven)


OBJECTS = ((("n", "t", " u "), ("n", "t", "u"), ("", "t", "u"), (None, "t", "u"), ("m", "t", "u" * 300)),)


def cleaned_objects(spark, sf):
    rows = spark.createDataFrame([(0, [tuple(o) for o in OBJECTS[0]])], "id int, xs array<struct<name:string,type:string,used_for:string>>")
    found = rs.clean_objects(F.col("xs"), ("name", "type"), ("used_for",))
    return rows.select("id", F.explode(found).alias("o")).select("id", "o.name", "o.type", F.length("o.used_for").alias("chars"))


SYMBOL_NAMES = (("  A \n b ", "python"), ("e\u0301", "python"), ("Total", "SQL"), ("Total", "go"), ("É", "fortran"))


def symbol_keys(spark, sf):
    importable(spark)
    rows = spark.createDataFrame([(n, *r) for n, r in enumerate(SYMBOL_NAMES)], "id int, name string, language string")
    return rows.select("id", lg.symbol_key(F.col("name"), F.col("language")).alias("key"))


def bounded_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (tx.bounded_chars(F.col("text"), 2_000) > 2_000).alias("above"))


def _event_stream(spark, sf, folder):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("rel"), "event_type")
    rows.unionByName(rows.filter("event_id % 3 = 0")).repartition(3).write.parquet(f"{folder}/in")
    return inc.stream(spark, f"{folder}/in", "event_id long, ts timestamp, rel string, event_type string", 8)


def deduplicated_stream(spark, sf):
    """Events of which every third comes twice, once each."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/in-{uuid.uuid4().hex}"
    rows = inc.run_once(inc.once(_event_stream(spark, sf, folder), ["event_id"], "ts", "400 days"), uuid.uuid4().hex)
    dropped(spark, folder)
    return rows.select("event_id", "rel")


def latest_states(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("rel"), "event_id", "event_type")
    return inc.latest(events, "rel", "event_id", "event_type")


def excluded_files(spark, sf):
    from millrace.operators import graph as gr

    return gr.excluded_sample(gr.select_files(graphs.cyclic_edges(spark, sf), graphs.part_files(spark, sf), "2"))


def scan_report(spark, sf):
    from millrace.sources.files import scan_details, scanned

    paths = table(spark, sf, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "build/").otherwise(""), F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".py")).alias("rel"), (F.col("n_chars") * 200).alias("length"))
    return scan_details(scanned(paths), 3)


NAMES = (
    "public_records", "project_sections", "project_blocks", "project_markdown_read", "project_markdown_whole", "project_json_read", "project_catalog_read", "project_edges_read", "run_summary", "usage_note_map", "cleaned_documentation",
    "contract_outcomes", "requested_fields", "profile_scopes", "profile_selectors", "review_batches", "forced_paths", "scope_figures", "run_partition", "strict_objects", "repeated_symbols", "unattempted_calls", "ordered_files", "eligible_dependencies", "published_exports", "cleaned_objects",
    "symbol_keys", "bounded_lengths", "deduplicated_stream", "latest_states", "excluded_files", "scan_report",
)
QUERIES = {name: globals()[name] for name in NAMES}


def _values(rows, names):
    def shown(v):
        if v is None or isinstance(v, bool | int):
            return "NULL" if v is None else str(v).lower()
        return "'" + v.replace("'", "''") + "'" if "\n" not in v else "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in v.split("\n")) + ")"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


_RECORDS = """recs AS (SELECT doc_id, sha256(text) AS hash, concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 8, '0'), '.', lang) AS path, lang AS language, n_chars, source, doc_id % 2 = 1 AS odd,
  CASE WHEN doc_id % 2 = 0 THEN 'Role of ' || source END AS role_in_system, CASE WHEN doc_id % 3 > 0 THEN 'x = 1' || chr(10) || 'y = 2' END AS usage_example FROM documents),
full_ AS (SELECT *, 'About ' || path || '.' || chr(10) || chr(10) || 'Second `part`: ' || n_chars AS description, 'os|' || language AS imports, 'f' || doc_id || '=does: *x*|g=' AS functions, language AS exports,
  CASE WHEN odd THEN source || '|x' END AS key_concepts, NOT odd AS reachable_from_entry, CASE WHEN odd THEN 'a/b.py|numpy|x`y|os' ELSE '' END AS links FROM recs)"""
_FLAT = "path, language, description, role_in_system, imports, functions, exports, key_concepts, usage_example, reachable_from_entry, links"
_N = "chr(10)"
_SECTION = f"""concat('### ', path, {_N}, {_N}, '**Language:** ', language, '  ', {_N}, {_N}, '**Reachable from entry:** ', CASE WHEN odd THEN 'No' ELSE 'Yes' END, '  ', {_N}, {_N}, '**Description:** ', description, {_N}, {_N},
  '**Role:** ' || role_in_system || {_N} || {_N}, '**Imports:**', {_N}, {_N}, '- `os`', {_N}, '- `', language, '`', {_N}, {_N},
  CASE WHEN odd THEN concat('**Internal Dependencies:**', {_N}, {_N}, '- `a/b.py`', {_N}, {_N}, '**External Dependencies:**', {_N}, {_N}, '- `numpy`', {_N}, '- `x`y`', {_N}, {_N}, '**SDK / Standard Library:**', {_N}, {_N}, '- `os`', {_N}, {_N}) END,
  '**Functions:**', {_N}, {_N}, '- `f', doc_id, '`: does: *x*', {_N}, '- `g`', {_N}, {_N}, '**Exports:**', {_N}, {_N}, '- `', language, '`', {_N}, {_N}, CASE WHEN odd THEN concat('**Key Concepts:**', {_N}, {_N}, '- ', source, {_N}, '- x', {_N}, {_N}) END,
  '**Usage Example:**' || {_N} || {_N} || '```text' || {_N} || usage_example || {_N} || '```' || {_N} || {_N})"""
_BLOCKS = f"""b AS (
  SELECT 0 AS part, [''] AS at_, concat('# Project documentation', {_N}, {_N}, '## Project Overview', {_N}, {_N}, '- Entry file: `src/main.py`', {_N}, '- Files documented: ', count(*), {_N}, '- Languages: ', array_to_string(list_sort(list_distinct(list(language))), ', '), {_N}, '- Folders: ', array_to_string(list_transform(list_sort(list_distinct(list(source))), lambda s: '`' || s || '`'), ', '), {_N}, {_N}) AS text FROM recs
  UNION ALL SELECT 1, [''], concat('## Run Summary', {_N}, {_N}, '- Files documented by LLM: 3', {_N}, '- Files failed: 0', {_N}, '- Files reused (unchanged): 4', {_N}, '- Files reused (identical content): 0', {_N}, '- Files resumed from recovery: 2', {_N}, {_N})
  UNION ALL SELECT 2, [''], concat('## Project Tree', {_N}, {_N}, '```text', {_N}) UNION ALL SELECT DISTINCT 2, [' ', source], source || '/' || {_N} FROM recs UNION ALL SELECT 2, [' ', source, split_part(path, '/', 2)], '  ' || split_part(path, '/', 2) || {_N} FROM recs
  UNION ALL SELECT 3, [''], concat('```', {_N}, {_N}) UNION ALL SELECT 4, [''], concat('## Folder Map', {_N}, {_N})
  UNION ALL SELECT 4, [' ', source], concat('### ', source, {_N}, {_N}, 'Files of ', source, {_N}, {_N}, '- Files: ', count(*), {_N}, '- Languages: ', array_to_string(list_sort(list_distinct(list(language))), ', '), {_N}, {_N}) FROM recs GROUP BY source
  UNION ALL SELECT 5, [''], concat('## Dependency Map', {_N}, {_N}) UNION ALL SELECT 5, [' ', a.path, z.path], concat('- `', a.path, '` -> `', z.path, '`', {_N}) FROM recs a JOIN recs z ON z.doc_id = a.doc_id // 10 WHERE a.doc_id > 0 AND (a.doc_id // 10) % 2 = 0
  UNION ALL SELECT 6, [''], {_N} UNION ALL SELECT 7, [''], concat('## Dependency Catalog', {_N}, {_N})
  UNION ALL SELECT 7, [' ', 'external', language], concat('### ', language, {_N}, {_N}, '- Type: external', {_N}, '- Used by: ', count(*), ' file(s)', {_N}, CASE WHEN language <> 'fr' THEN concat('- Used for: talks ', language, {_N}) END, {_N}) FROM recs GROUP BY language
  UNION ALL SELECT 9, [''], concat('## Errors', {_N}, {_N}, '```text', {_N}, 'one error', {_N}, '```', {_N}))"""
_SAID = f"""said AS (SELECT conv_id, turn, text, string_split(text, ' ') AS ws FROM conversations WHERE role = 'assistant'),
w AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS i, left(trim(unnest(ws), concat(' ', chr(9), {_N}, chr(13))), 300) AS v FROM said),
k AS (SELECT conv_id, turn, v, min(i) AS i FROM w WHERE v <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS nth FROM k QUALIFY nth <= 16),
c AS (SELECT conv_id, turn, string_agg(v, ' ' ORDER BY i) AS concepts FROM n GROUP BY ALL)"""

ORACLE_SQL = {
    "public_records": f"WITH {_RECORDS} SELECT path, hash, role_in_system, CASE WHEN odd THEN 2 END AS concepts, usage_example, true AS no_classes, CASE WHEN odd THEN 'r1' ELSE 'r0' END AS analysis_revision, 'single' AS analysis_mode, NULL::VARCHAR AS ordinary_path_identity FROM full_",
    "project_sections": f"WITH {_RECORDS} SELECT path, {_SECTION} AS section FROM full_",
    "project_blocks": f"WITH {_RECORDS}, {_BLOCKS} SELECT part, count(*) AS blocks, sha256(string_agg(text, '' ORDER BY at_)) AS digest FROM b GROUP BY part",
    "project_markdown_read": f"WITH {_RECORDS} SELECT {_FLAT} FROM full_",
    "project_markdown_whole": f"WITH {_RECORDS} SELECT {_FLAT}, hash, CASE WHEN odd THEN 'r1' END AS analysis_revision FROM full_",
    "project_json_read": f"WITH {_RECORDS} SELECT {_FLAT}, hash, CASE WHEN odd THEN 'r1' END AS analysis_revision FROM full_",
    "project_catalog_read": "SELECT lang AS name, 'external' AS type, count(*) AS file_count, CASE WHEN lang <> 'fr' THEN 'talks ' || lang END AS used_for FROM documents GROUP BY lang",
    "project_edges_read": f'WITH {_RECORDS} SELECT a.path AS "from", z.path AS "to" FROM recs a JOIN recs z ON z.doc_id = a.doc_id // 10 WHERE a.doc_id > 0 AND (a.doc_id // 10) % 2 = 0',
    "run_summary": _values([("src/main.py", "auto", None, None, 0, 0, 3, 0, 0, 0, 4, 0, 2)], ", ".join(pj.RUN_FIELDS)),
    "usage_note_map": _values([("a.py", '{"os":"files"}'), ("b.py", '{"re":"patterns"}')], "rel, notes"),
    "cleaned_documentation": f"WITH {_SAID} SELECT s.conv_id, s.turn, left(trim(text, concat(' ', chr(9), {_N}, chr(13))), 1200) AS description, concepts AS key_concepts, 1 AS wrong_type, 1 AS unknown_field, 'description,key_concepts' AS retained FROM said s JOIN c USING (conv_id, turn)",
    "contract_outcomes": _values([(n, *j) for n, j in enumerate(JUDGED)], "id, stage, reason, body, removed"),
    "requested_fields": "SELECT conv_id, turn, 'description' AS retained, true AS no_concepts, 'key_concepts' AS not_requested FROM conversations WHERE role = 'assistant'",
    "profile_scopes": f"SELECT CASE lang WHEN 'en' THEN '.en' WHEN 'de' THEN '.de' ELSE '*' END AS scope, CASE lang WHEN 'en' THEN 'description: what it is, in all files' WHEN 'de' THEN concat('description: was es ist', {_N}, 'key_concepts: main ideas') ELSE concat_ws({_N}, 'description: what it is', 'key_concepts: main ideas', 'role_in_system: its part', 'usage_example: how to use it') END AS shape, count(*) AS files FROM documents GROUP BY ALL",
    "profile_selectors": _values([("a.ts", ".ts"), ("A.D.TS", ".d.ts"), (".ts", None), ("x/.d.ts", ".ts"), ("b.d.ts", ".d.ts"), ("dir.ts/c.js", ".js"), ("c.ts.js", ".js"), ("w\\v.ts", ".ts")], "rel, scope"),
    "review_batches": _values([(1, 2, 2, "[documentation/ext:.de] description: was es ist\n[documentation/ext:.de] key_concepts: main ideas"), (2, 2, 1, "[documentation/ext:.en] description: what it is, in all files")], "batch, batches, units, text"),
    "forced_paths": _values([("src/a.py", "src/a.py"), ("./src//b.py", "src/b.py"), ("src\\c.py", "src/c.py"), ("../x.py", None), ("/abs.py", None), ("C:/x.py", None), ("src/../d.py", "d.py"), ("src/../../e.py", None), ("", None), (".", None), (" e.py ", "e.py")], "given, rel"),
    "scope_figures": f"WITH {docs._PLAN} SELECT count(*) AS scanned, count(*) FILTER (doc_id % 3 > 0) AS reachable, count(*) FILTER (doc_id % 3 = 0) AS disconnected, count(*) FILTER (doc_id % 3 <> 1) AS documented, count(*) FILTER (doc_id % 3 = 1) AS excluded, count(*) FILTER (doc_id % 3 = 0 AND route = 'agent') AS paid_disconnected, 3 * count(*) FILTER (doc_id % 3 = 0 AND route = 'agent') AS calls_disconnected FROM planned",
    "run_partition": f"WITH {docs._PLAN}, p AS (SELECT *, route = 'agent' AS a, chars % 3 AS m FROM planned) SELECT count(*) AS selected, count(*) FILTER (NOT a) AS unchanged, 0::BIGINT AS identical, count(*) FILTER (a AND m = 0) AS documented, count(*) FILTER (a AND m = 1) AS failed, count(*) FILTER (a AND m = 2) AS unattempted, 0::BIGINT AS skipped, true AS holds FROM p",
    "strict_objects": _values([(t, n in (0, 6, 8)) for n, t in enumerate(STRICT)], "text, strict"),
    "repeated_symbols": _values([(0, "f=x,g", "f=x,f=x,g,f=x")], "id, collapsed, every"),
    "unattempted_calls": f"WITH {docs._PLAN}, c AS (SELECT row_number() OVER (ORDER BY rel) - 1 AS seq, 'file' AS category, rel FROM planned WHERE route = 'agent') SELECT seq, category, rel FROM c WHERE seq % 4 = 0",
    "ordered_files": f"WITH {docs._FILES} SELECT rel, CASE WHEN doc_id % 5 > 0 THEN -doc_id END AS rank, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS record FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "eligible_dependencies": _values([("a.py", "sdk", "os"), ("b.py", "external", "numpy"), ("a.py", "internal", "b.py")], "rel, type, name"),
    "published_exports": _values([("a.py", "x", 10), ("a.py", "z", 30)], "rel, name, start"),
    "cleaned_objects": _values([(0, "n", "t", 1), (0, "m", "t", 256)], "id, name, type, chars"),
    "symbol_keys": _values([(0, "A b"), (1, "é"), (2, "total"), (3, "Total"), (4, "é")], "id, key"),
    "bounded_lengths": "SELECT doc_id, length(text) > 2000 AS above FROM documents",
    "deduplicated_stream": "SELECT event_id, CAST(user_id AS VARCHAR) AS rel FROM events",
    "latest_states": "SELECT user_id AS rel, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "excluded_files": f"WITH RECURSIVE {graphs._CYCLIC}, r AS (SELECT 2::BIGINT AS n UNION SELECT t.dst FROM r JOIN tree t ON t.src = r.n), o AS (SELECT CAST(k AS VARCHAR) AS rel FROM parts WHERE k NOT IN (SELECT n FROM r)) SELECT rel, (SELECT count(*) FROM o) AS excluded FROM o ORDER BY rel LIMIT 10",
    "scan_report": """WITH p AS (SELECT concat(CASE WHEN doc_id % 2 = 0 THEN 'build/' ELSE '' END, 'f', lpad(CAST(doc_id AS VARCHAR), 8, '0'), '.py') AS rel, n_chars * 200 AS length, doc_id FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'skipped_folder' WHEN length / 1024.0 > 500 THEN 'too_large' END AS kind FROM p),
g AS (SELECT kind, count(*) AS total, sha256('[' || string_agg('"' || sha256(rel) || '"', ',' ORDER BY rel) || ']') AS digest FROM s WHERE kind IS NOT NULL GROUP BY kind)
SELECT kind, rel, CASE WHEN kind = 'too_large' THEN length END AS observed, CASE WHEN kind = 'too_large' THEN 512000::BIGINT END AS bound, total, least(total, 3) AS retained, total - least(total, 3) AS omitted, digest FROM s JOIN g USING (kind) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY rel) <= 3""",
}
