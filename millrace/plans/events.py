"""Queries over events, conversations and facts: queues, answers, ledgers, streams, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import classify as cl
from millrace.operators import diagnostics as dg
from millrace.operators import division as dv
from millrace.operators import enrich as en
from millrace.operators import ledger as lg
from millrace.operators import responses as rs
from millrace.operators import view as vw
from millrace.plans import documents as docs
from millrace.sources import records as rc
from millrace.session import checkpoint_folder, dropped, importable, pinned, table
from millrace.streaming import incremental as inc


def _status():
    return F.element_at(F.array(*[F.lit(s) for s in dg.STATUSES[:4]]), (F.col("event_id") % 4 + 1).cast("int"))


def queue_status_counts(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("rel"), F.col("event_id").alias("seq"), _status().alias("status"))
    return dg.status_counts(dg.last_status(events))


def consecutive_failure_abort(spark, sf):
    outcome = F.when(F.col("event_id") % 7 < 4, "failure").when(F.col("event_id") % 7 == 4, "insufficient").otherwise("success")
    events = table(spark, sf, "events").select((F.col("user_id") % 50).alias("queue"), F.col("event_id").alias("seq"), outcome.alias("outcome"))
    return dg.failure_runs(events, 5)


def _answers(spark, sf) -> DataFrame:
    """props of events as answers, some wrapped in prose or fences, some broken."""
    raw = (
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked.")))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
        .when(F.col("event_id") % 6 == 3, F.lit("no answer"))
        .when(F.col("event_id") % 6 == 4, F.concat("props", F.lit(" }")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", raw.alias("raw"))


def json_candidate(spark, sf):
    return _answers(spark, sf).withColumn("c", rs.json_candidate(F.col("raw"))).select("event_id", "c.outcome", "c.body")


def _items(spark, sf):
    words = table(spark, sf, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.posexplode(F.split("text", "[ ,]")).alias("idx", "item"))
    return words


def clean_lists(spark, sf):
    rows = rs.list_rows(_items(spark, sf), 32, 6)
    return rows.filter("reason IS NULL").select("id", "idx", "value")


def removal_report(spark, sf):
    return rs.list_rows(_items(spark, sf), 32, 6).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"))


def clean_list_arrays(spark, sf):
    said = table(spark, sf, "conversations").filter("role = 'assistant'")
    return said.select("conv_id", "turn", F.array_join(rs.clean_list(F.split("text", "[ ,]"), 16, 6), " ").alias("kept"))


def clean_fixed_arrays(spark, sf):
    said = table(spark, sf, "conversations").filter("role = 'assistant'")
    return said.select("conv_id", "turn", F.array_join(rs.clean_fixed(F.split("text", "[ ,]"), 6), " ").alias("kept"))


def clean_symbol_arrays(spark, sf):
    said = table(spark, sf, "conversations").filter("role = 'assistant'")
    symbols = F.transform(F.split("text", r"\."), lambda s: F.struct(F.split_part(F.trim(s), F.lit(" "), F.lit(1)).alias("name"), s.alias("description")))
    found = rs.clean_symbols(symbols, 5)
    kept = F.transform(found, lambda s: F.concat(s["name"], F.lit("="), s["description"]))
    return said.select("conv_id", "turn", F.size(found).cast("bigint").alias("symbols"), F.array_join(kept, "\n").alias("kept"))


def contract_validation(spark, sf):
    present = F.split("text", "[ .,]+")
    required = F.array(*[F.lit(w) for w in ("the", "and", "of", "nowhere")])
    said = table(spark, sf, "conversations")
    return said.select("conv_id", "turn", F.array_join(rs.missing_fields(required, present), ",").alias("missing"))


def bounded_answers(spark, sf):
    importable(spark)
    said = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.to_json(F.struct(F.col("text").alias("description"), F.split("text", " ").alias("key_concepts"))).alias("answer"))
    return said.select("conv_id", "turn", rs.bounded_json(F.col("answer"), 200).alias("answer"))


def pruned_answers(spark, sf):
    importable(spark)
    rows = [('{"a": null, "b": "", "c": [], "d": {"e": {}}, "f": 0, "g": false, "h": [null, "x", {"i": ""}]}',), ('{"z": {"y": [[]]}}',), ('{"k": "v"}',)]
    return spark.createDataFrame(rows, "answer string").select("answer", rs.pruned_json(F.col("answer")).alias("pruned"))


def terminology(spark, sf):
    importable(spark)
    rows = [
        ("Uses the Data Processing Record table.", "DPR = 1", ""), ("Uses the Data Processing Record table.", "DPR = 1", "Data Processing Record"), ("Uses Data of the Record", "DR", ""),
        ("Data Processing Reporter", "DPR", "Data Processing Report"), ("Data-Processing Record", "DPR", ""), ("all lower", "AL", ""), ("Alpha Beta Gamma", "BG", ""), ("Alpha Beta", "XABY", ""), ("Alpha Beta", "AB", "xAlpha Beta"),
    ]
    return spark.createDataFrame(rows, "value string, source string, evidence string").withColumn("invented", rs.invented_expansion(F.col("value"), F.col("source"), F.col("evidence")))


def usage_examples(spark, sf):
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 3 == 0, "import Your_App; ").otherwise(""), F.col("text")).alias("example"))
    return said.select("conv_id", "turn", rs.usage_example(F.col("example")).alias("example"))


def _facts(spark, sf):
    said = table(spark, sf, "conversations")
    word = F.split_part(F.trim("text"), F.lit(" "), F.lit(1))
    return said.select(F.concat(F.lit("f"), (F.col("conv_id") % 7).cast("string")).alias("rel"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("role").alias("kind"), word.alias("name"), F.lit(None).cast("string").alias("scope"), F.lit("").alias("signature"), F.when(F.col("turn") > 0, F.col("text")).alias("description"))


def ledger_merge(spark, sf):
    found = lg.merged(_facts(spark, sf))
    return found.select("rel", "kind", "name", "first_ord", F.coalesce("description", F.lit("")).alias("description"), F.array_join(F.transform("origins", lambda o: o.cast("string")), ",").alias("origins"))


def fact_occurrences(spark, sf):
    facts = _facts(spark, sf).select("rel", F.lit(0).alias("chunk"), "kind", "name", F.when(F.col("ord") % 2 == 0, "s").alias("signature"), F.lpad(F.col("ord").cast("string"), 12, "0").alias("canonical"))
    return lg.occurrences(facts).select("rel", "canonical", "occurrence")


FACTS = (("a", 0, "f1", "functions", "run", "run(x)", "1"), ("a", 0, "f2", "functions", "run", "", "2"), ("a", 0, "f3", "functions", "A.run", "", "3"), ("a", 0, "f4", "classes", "A", "", "4"), ("a", 0, "f5", "functions", "lost", "", "5"), ("a", 1, "f6", "functions", "run", "", "6"), ("a", 0, "f7", "functions", "run", "", "7"), ("a", 0, "f8", "classes", "A", "", "8"), ("a", 2, "f9", "functions", "any", "", "9"), ("a", 3, "g1", "functions", "part", "", "1"), ("a", 3, "g2", "functions", "lost", "", "2"))
SYMBOLS = (("a", 0, "s1", "functions", "run", "def run(y)", 0), ("a", 0, "s2", "functions", "run", "def run(x)", 10), ("a", 0, "s3", "functions", "A.run", "def run(self)", 20), ("a", 0, "s4", "classes", "A", "class A", 15), ("a", 1, "s5", "functions", "B.run", "def run(self)", 40))


UNITS = (("a", 2, "u1", "functions", "whole", "", 50), ("a", 3, "u2", "functions", "x.part", "", 60), ("a", 3, "u3", "classes", "Y", "", 70))


def scope_allocation(spark, sf):
    importable(spark)
    facts = spark.createDataFrame(list(FACTS), "rel string, chunk int, fact string, kind string, name string, signature string, canonical string")
    symbols = spark.createDataFrame(list(SYMBOLS), "rel string, chunk int, symbol string, kind string, qualified_name string, signature string, start int")
    units = spark.createDataFrame(list(UNITS), "rel string, chunk int, symbol string, kind string, qualified_name string, signature string, start int")
    return lg.allocated(facts, symbols, units)


MODEL = (("a", 0, "functions", "run", "", "runs"), ("a", 1, "functions", "A", "", "a class after all"), ("a", 2, "functions", "run", "run(x)", "runs x"), ("a", 3, "functions", "solo", "", " "), ("a", 4, "functions", "solo", "", "alone"), ("a", 5, "classes", "none", "", "not there"), ("a", 6, "functions", "solo", "", "later"), ("a", 7, "functions", "Box.open", "", "opens"), ("a", 8, "classes", "ns::Inner", "", "inside"), ("a", 9, "functions", "twice", "", "which"))
DECLARED = (("a", "functions", "run", "run(x)", 10), ("a", "functions", "run", "run(y)", 20), ("a", "classes", "A", "", 30), ("a", "functions", "solo", "solo()", 40), ("a", "functions", "Lid.open", "", 50), ("a", "classes", "Inner", "", 60), ("a", "classes", "m.twice", "", 70), ("a", "classes", "n.twice", "", 80))


def reconciliation(spark, sf):
    model = spark.createDataFrame(list(MODEL), "rel string, ord int, bucket string, name string, signature string, description string")
    declared = spark.createDataFrame(list(DECLARED), "rel string, bucket string, name string, signature string, start int")
    return lg.reconciled(model, declared)


CODE = (
    ("a.py", "python", '"""doc\ndef no(): pass\n"""\nclass A:  # class B\n    def run(self): pass\n    async def go(self): pass\nx = "def no2():"\n__all__ = ["A", "x"]\n'),
    ("b.ts", "TypeScript", "/* class No {\n */\nexport default class View {}\nexport const use = (a: number): string => a\nfunction* gen() {}\n// function no() {}\nexport interface Shape {}\nexport { use, gen as made }\nexport const size = 3\n"),
    ("c.js", "javascript", "module.exports = { a, b: 1 }\nvar é = 1; exports.late = 2\nclass Öl {}\nconst f = x => x\nlet n = 5\nexports.é = f\n`\nclass Hidden {}\n` + class_\n"),
    ("d.java", "java", "class No {}\n"), ("e.py", "python", "__all__ = ['a'] + other\n'\'\'\nx'\'\'; y\nclass After: pass\n"), ("f.py", "python", None),
)


def lexical_proof(spark, sf):
    importable(spark)
    return lg.proven(spark.createDataFrame(list(CODE), "rel string, language string, content string"))


def rate_limits(spark, sf):
    messages = [(m,) for m in ("Limit: 10 tokens per min", "TPM exceeded", "rpm", "requests per min and quota", "Daily limit", "RESOURCE_EXHAUSTED", "error 529", "stpm", "Overloaded", "else")]
    return spark.createDataFrame(messages, "message string").withColumn("kind", cl.limit_type(F.col("message"))).withColumn("signalled", cl.signalled(F.col("message"), F.array(F.lit("LIMIT"), F.lit("else"))))


def backoff_ladder(spark, sf):
    base = spark.range(1, 9).select(F.col("id").cast("int").alias("workers"))
    rungs = base.select("workers", F.posexplode(cl.ladder(F.col("workers"))).alias("rung", "level"))
    after = F.when(F.col("workers") % 3 == 0, F.col("workers") * 20)
    return rungs.withColumn("seconds", cl.backoff(F.col("rung"), after, 2.0, 3.0, 60.0))


def failure_verdicts(spark, sf):
    rows = [(i, c, r) for i in (True, False) for c in (True, False) for r in (None, "provider-quota-exhausted", "provider-rate-limited", "provider-authentication-rejected", "provider-input-rejected")]
    frame = spark.createDataFrame(rows, "insufficient boolean, contract boolean, reason string")
    return frame.withColumn("verdict", cl.failure(F.col("insufficient"), F.col("contract"), F.col("reason")))


def feasibility_notes(spark, sf):
    rows = [(t,) for t in ("Describe the whole Repository", "list all files that import it", "usages across other modules", "every known reference to it, all references", "only this file", "repo-wide codebase", "all imports from x", "its callers")]
    units = spark.createDataFrame([(n, "single/file/*", "description", t[0], "only this file") for n, t in enumerate(rows)], "ord int, component string, field string, instruction string, default_instruction string")
    return cl.feasibility_notes(units.unionByName(units.withColumn("ord", F.col("ord") + 100)))


def feasibility_signs(spark, sf):
    return spark.createDataFrame([(t,) for t, _ in SIGNS], "instruction string").withColumn("category", cl.cross_file(F.col("instruction")).getField("category"))


SIGNS = (
    ("look at Every file", "every_file"), ("each  file here", "each_file"), ("list ALL files", "all_files"), ("see another file", "other_file"), ("other files", "other_file"), ("a different file", "different_file"),
    ("across all files", "all_files"), ("across files", "across_files"), ("across the project", "project_scope"), ("the whole project", "project_scope"), ("project wide", "project_scope"), ("the Repository", "repository_scope"),
    ("repo wide", "repository_scope"), ("this codebase", "codebase_scope"), ("other modules", "other_modules"), ("files that import it", "importers"), ("its callers", "callers"), ("usages across it", "cross_file_usages"),
    ("every known reference", "all_references"), ("all imports from x", "all_imports_from"), ("only this file", None), ("everyfile", None), ("small files", None),
)


def provider_choice(spark, sf):
    rows = [(n, m) for n in ("auto", "openai", None) for m in ("claude-x", "Gemini-2", "gpt-x", "")]
    return spark.createDataFrame(rows, "name string, model string").withColumn("provider", cl.provider(F.col("name"), F.col("model")))


def error_summary(spark, sf):
    importable(spark)
    issues = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "error").otherwise("warning").alias("level"), F.col("event_type").alias("message"))
    return dg.severity_digests(issues).select("level", "n", F.coalesce("digest", F.lit("")).alias("messages"))


def correction_counts(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("contract_failure", "attempt", "success", "failure")])
    return dg.corrections(table(spark, sf, "events").select(F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("event")))


def division_figures(spark, sf):
    atoms = dv.line_atoms(docs.files(spark, sf))
    units = atoms.groupBy("rel").agg(F.count(F.lit(1)).alias("units"), F.sum("chars").alias("chars"))
    chunks = dv.packed(docs.files(spark, sf), 2_000).groupBy("rel").agg(F.count(F.lit(1)).alias("chunks"))
    rows = units.join(chunks, "rel").select("rel", F.when(F.col("chars") > 12_000, "divided").otherwise("ordinary").alias("mode"), "units", "chunks", F.when(F.col("chunks") > 10, "chunk-cap").alias("blocked"))
    return dg.division_figures(rows)


def strongest_scope(spark, sf):
    scope = F.element_at(F.array(F.lit("common"), F.lit("extension"), F.lit("file")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("rel"), scope.alias("scope"))
    return dg.strongest_scope(rows, ("common", "extension", "file"))


def prompt_answers(spark, sf):
    """Answers in place of a model: prose instead of an object to a prompt whose digest begins with 0 to 3, and then again if the second does."""
    importable(spark)
    first = docs.files(spark, sf).withColumn("prompt", en.prompt(F.col("rel"), F.col("language"), F.col("content"), 12_000)).select("rel", "prompt")
    return en.corrected(first, _moody).select("rel", "attempts", F.sha2("body", 256).alias("body"))


def _moody(prompts: list[str]) -> list[str]:
    import hashlib

    return [a if hashlib.sha256(p.encode()).hexdigest()[0] > "3" else f"Sorry, {len(p)}" for p, a in zip(prompts, en.echo(prompts), strict=True)]


def agent_bodies(spark, sf):
    return en.agents(docs.files(spark, sf), "triple").select("rel", "agent", "body")


def tree_answers(spark, sf):
    large = docs.files(spark, sf).filter("length(content) > 12000")
    atoms = dv.line_atoms(large).select("rel", "ord", F.col("source").alias("prompt"))
    return en.reduced(atoms, width=5)


def markdown_round_trip(spark, sf):
    importable(spark)
    none = F.lit(None).cast("string")
    records = docs.prior(spark, sf).select("path", "hash", "language", F.concat(F.lit("About "), "path").alias("description"), F.array(F.lit("x"), F.col("language")).alias("key_concepts"), *[F.coalesce(c, none).alias(c) for c in docs.pl.IDENTITY])
    back = rc.from_markdown(rc.to_markdown(records))
    return back.select("path", "hash", "language", "description", F.array_join("key_concepts", ",").alias("key_concepts"), F.col("ordinary_path_identity").alias("identity"))


def cross_document(spark, sf):
    p = docs.prior(spark, sf)
    other = p.withColumn("analysis_mode", F.when(F.crc32("path") % 2 == 0, F.lit("triple")).otherwise(F.col("analysis_mode"))).filter("language <> 'fr'")
    found = rc.disagreements(p.withColumn("analysis_mode", F.when(F.crc32("path") % 2 == 0, F.lit("triple")).otherwise(F.col("analysis_mode"))), other)
    return found.groupBy(F.array_join("fields", ",").alias("fields")).agg(F.count(F.lit(1)).alias("paths"))


def recovery_identity(spark, sf):
    p = docs.prior(spark, sf).withColumn("analysis_mode", F.when(F.col("language") == "de", "triple").otherwise(F.col("analysis_mode")))
    found = rc.recovered(p, {"analysis_revision": "r1", "analysis_mode": "single"})
    return found.groupBy(F.coalesce("mismatch", F.lit("none")).alias("mismatch")).agg(F.count(F.lit(1)).alias("records"))


def recovered_tree(spark, sf):
    ids = table(spark, sf, "orders").select(F.lit("f").alias("rel"), F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_orderkey").alias("k"))
    col = lambda c: F.lit(c).alias(c)
    plan = ids.filter("k % 10 <> 9").select("rel", "node_id", col("identity"), col("input_digest"), col("phase"), F.array(F.lit("c")).alias("child_ids"), F.lit(1).alias("leaves"))
    off = lambda n, c: F.when(F.col("k") % 10 == n, F.lit("other")).otherwise(F.lit(c)).alias(c)
    found = ids.select("rel", "node_id", off(1, "identity"), off(2, "input_digest"), off(3, "phase"), F.array(F.when(F.col("k") % 10 == 4, "d").otherwise("c")).alias("child_ids"), F.when(F.col("k") % 10 == 5, 2).otherwise(1).alias("leaves"), (F.col("k") % 10 != 6).alias("result_ok"))
    return rc.valid_nodes(plan, found).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("nodes"))


def upsert_records(spark, sf):
    p = docs.prior(spark, sf).select("path", "hash")
    new = p.filter("path LIKE 'src1/%'").select("path", F.lit("new").alias("hash"))
    merged = rc.upserted(p, new, "path", p.filter("path LIKE 'src2/%'"))
    return merged.groupBy((F.col("hash") == "new").alias("fresh")).agg(F.count(F.lit(1)).alias("records"))


def file_sections(spark, sf):
    rows = docs.files(spark, sf).select("rel", "language", F.when(F.length("content") > 2000, F.col("content")).alias("description"), F.array(F.col("language")).alias("key_concepts"))
    return vw.file_markdown(rows).select("rel", F.sha2("markdown", 256).alias("digest"))


def run_figures(spark, sf):
    return vw.run_figures(docs.planned(spark, sf))


def incremental_stream(spark, sf):
    """Events as a stream of files: the last hash of each user, written batch by batch."""
    import uuid

    source = table(spark, sf, "events")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/in-{uuid.uuid4().hex}"
    importable(spark)
    source.select(F.col("user_id").cast("string").alias("rel"), F.col("event_id").alias("seq"), F.col("event_type").alias("hash")).repartition(4).write.parquet(f"{folder}/in")
    rows = inc.stream(spark, f"{folder}/in", "rel string, seq long, hash string", 1)
    inc.run_once(rows, uuid.uuid4().hex, inc.changed_only(f"{folder}/out"))
    last = pinned(inc.state(spark, f"{folder}/out").select("rel", "hash", "seq"))
    dropped(spark, folder)
    return last


def windowed_counts(spark, sf):
    import uuid

    """(window_start, event_type, n) of the days that the watermark has closed; append mode gives no open ones."""
    events = inc.stream(spark, sf, table(spark, sf, "events").schema, names="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = inc.windowed(events, "ts", "1 day", "1 day", "event_type")
    return inc.run_once(counts, uuid.uuid4().hex)


NAMES = (
    "queue_status_counts", "consecutive_failure_abort", "json_candidate", "clean_lists", "removal_report", "clean_list_arrays", "clean_fixed_arrays", "clean_symbol_arrays", "contract_validation", "bounded_answers", "pruned_answers",
    "terminology", "usage_examples", "ledger_merge", "fact_occurrences", "scope_allocation", "reconciliation", "lexical_proof", "rate_limits", "backoff_ladder", "failure_verdicts", "feasibility_notes", "feasibility_signs", "provider_choice",
    "error_summary", "correction_counts", "division_figures", "strongest_scope", "prompt_answers", "agent_bodies", "tree_answers", "markdown_round_trip", "cross_document", "recovery_identity", "recovered_tree", "upsert_records",
    "file_sections", "run_figures", "incremental_stream", "windowed_counts",
)
QUERIES = {name: globals()[name] for name in NAMES}

_ITEMS = """items0 AS (SELECT conv_id, turn, concat_ws('-', conv_id, turn) AS id, regexp_split_to_array(text, '[ ,]') AS ws FROM conversations WHERE role = 'assistant'),
items AS (SELECT id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS idx, unnest(ws) AS item FROM items0),
vals AS (SELECT id, idx, left(nullif(trim(item, ' \t\n\r'), ''), 6) AS value FROM items),
firsts AS (SELECT *, value IS NOT NULL AND row_number() OVER (PARTITION BY id, value ORDER BY idx) = 1 AS f FROM vals),
marked AS (SELECT *, CASE WHEN value IS NULL THEN 'invalid_value' WHEN NOT f THEN 'duplicate' WHEN sum(CAST(f AS INT)) OVER (PARTITION BY id ORDER BY idx) > 32 THEN 'item_limit' END AS reason FROM firsts)"""
_ITEMS = _ITEMS.replace("' \t\n\r'", "concat(' ', chr(9), chr(10), chr(13))")
_FACTS = r"""facts AS (SELECT concat('f', conv_id % 7) AS rel, conv_id * 1000 + turn AS ord, role AS kind, trim(regexp_replace(nfc_normalize(split_part(trim(text), ' ', 1)), '\s+', ' ', 'g')) AS name, CASE WHEN turn > 0 THEN nullif(trim(text), '') END AS description FROM conversations)"""

_PROMPT = f"'File: ' || rel || chr(10) || 'Language: ' || language || chr(10) || chr(10) || CASE WHEN chars <= 12000 THEN content ELSE substr(content, 1, 8385) || {docs._MARK} || right(content, 3594) END"
_ECHO = """'{{"description": "' || length({0}) || ' characters, ' || left(sha256({0}), 12) || '", "role_in_system": "", "key_concepts": []}}'"""
_TREE = ",\n".join(
    f"g{n} AS (SELECT rel, ord // 5 AS ord, count(*) AS n, min(answer) AS one, string_agg('- ' || answer, chr(10) ORDER BY ord) AS p FROM a{n - 1} GROUP BY ALL), a{n} AS (SELECT rel, ord, CASE WHEN n = 1 THEN one ELSE {_ECHO.format('p')} END AS answer FROM g{n})"
    for n in range(1, 7)
)

ORACLE_SQL = {
    "queue_status_counts": """WITH l AS (SELECT user_id, max_by(['unchecked', 'in_progress', 'checked', 'failed'][event_id % 4 + 1], event_id) AS status FROM events GROUP BY user_id)
SELECT s.status, count(l.status) AS n FROM (SELECT unnest(['unchecked', 'in_progress', 'checked', 'failed', 'skipped']) AS status) s LEFT JOIN l USING (status) GROUP BY s.status""",
    "consecutive_failure_abort": """WITH e AS (SELECT user_id % 50 AS queue, event_id AS seq, CASE WHEN event_id % 7 < 4 THEN 'failure' WHEN event_id % 7 = 4 THEN 'insufficient' ELSE 'success' END AS outcome FROM events),
i AS (SELECT *, sum(CAST(outcome <> 'failure' AS INT)) OVER (PARTITION BY queue ORDER BY seq) AS island FROM e),
r AS (SELECT *, CAST(sum(CAST(outcome = 'failure' AS INT)) OVER (PARTITION BY queue, island ORDER BY seq) AS BIGINT) AS run FROM i)
SELECT queue, seq, outcome, run, coalesce(max(CAST(run >= 5 AS INT)) OVER (PARTITION BY queue ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted FROM r""",
    "json_candidate": """SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'top_level_not_object' WHEN 3 THEN 'no_json_object' WHEN 4 THEN 'json_parse_error' ELSE 'object' END AS outcome, CASE WHEN event_id % 6 IN (0, 1, 5) THEN props END AS body FROM events""",
    "clean_lists": f"WITH {_ITEMS} SELECT id, idx, value FROM marked WHERE reason IS NULL",
    "removal_report": f"WITH {_ITEMS} SELECT reason, count(*) AS n, max(idx) AS last FROM marked WHERE reason IS NOT NULL GROUP BY reason",
    "clean_list_arrays": f"WITH {_ITEMS}, k AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY idx) AS nth, idx FROM firsts WHERE f QUALIFY nth <= 16) SELECT conv_id, turn, coalesce(string_agg(value, ' ' ORDER BY idx), '') AS kept FROM items0 LEFT JOIN k USING (id) GROUP BY conv_id, turn",
    "clean_fixed_arrays": f"WITH {_ITEMS}, t AS (SELECT id, idx, trim(item, concat(' ', chr(9), chr(10), chr(13))) AS v FROM items), k AS (SELECT id, v, min(idx) AS idx FROM t WHERE length(v) BETWEEN 1 AND 6 GROUP BY ALL) SELECT conv_id, turn, coalesce(string_agg(v, ' ' ORDER BY idx), '') AS kept FROM items0 LEFT JOIN k USING (id) GROUP BY conv_id, turn",
    "clean_symbol_arrays": """WITH s AS (SELECT conv_id, turn, regexp_split_to_array(text, '[.]') AS ss FROM conversations WHERE role = 'assistant'),
x AS (SELECT conv_id, turn, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM s),
v AS (SELECT conv_id, turn, i, left(trim(split_part(trim(s), ' ', 1), concat(' ', chr(9), chr(10), chr(13))), 128) AS name, left(nullif(trim(s, concat(' ', chr(9), chr(10), chr(13))), ''), 300) AS d FROM x),
f AS (SELECT conv_id, turn, name, d, min(i) AS i FROM v WHERE name <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS nth FROM f QUALIFY nth <= 5)
SELECT s.conv_id, s.turn, count(k.name) AS symbols, coalesce(string_agg(k.name || '=' || k.d, chr(10) ORDER BY k.i), '') AS kept FROM s LEFT JOIN k USING (conv_id, turn) GROUP BY ALL""",
    "contract_validation": """SELECT conv_id, turn, array_to_string(list_filter(['the', 'and', 'of', 'nowhere'], lambda w: NOT list_contains(regexp_split_to_array(text, '[ .,]+'), w)), ',') AS missing FROM conversations""",
    "bounded_answers": """WITH a AS (SELECT conv_id, turn, text, string_split(text, ' ') AS ws FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, turn, text, length(CAST(to_json(text) AS VARCHAR)) AS d, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM a),
u AS (SELECT *, sum(length(CAST(to_json(w) AS VARCHAR)) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto FROM n),
k AS (SELECT conv_id, turn, any_value(text) AS text, any_value(d) AS d, list(w ORDER BY i) FILTER (33 + d + upto <= 200) AS kept FROM u GROUP BY conv_id, turn),
t AS (SELECT *, (SELECT max(r.k) FROM (SELECT unnest(range(0, length(text))) AS k) r WHERE 16 + length(CAST(to_json(substr(text, 1, r.k) || chr(10) || '... [truncated] ...' || chr(10)) AS VARCHAR)) <= 200) AS m FROM k)
SELECT conv_id, turn, CASE WHEN kept IS NOT NULL THEN '{"description":' || to_json(text) || ',"key_concepts":' || to_json(kept) || '}' WHEN 16 + d <= 200 THEN '{"description":' || to_json(text) || '}' ELSE '{"description":' || to_json(substr(text, 1, m) || chr(10) || '... [truncated] ...' || chr(10)) || '}' END AS answer FROM t""",
    "pruned_answers": """SELECT * FROM (VALUES ('{"a": null, "b": "", "c": [], "d": {"e": {}}, "f": 0, "g": false, "h": [null, "x", {"i": ""}]}', '{"f":0,"g":false,"h":["x"]}'), ('{"z": {"y": [[]]}}', '{}'), ('{"k": "v"}', '{"k":"v"}')) AS t(answer, pruned)""",
    "terminology": """SELECT * FROM (VALUES ('Uses the Data Processing Record table.', 'DPR = 1', '', true), ('Uses the Data Processing Record table.', 'DPR = 1', 'Data Processing Record', false), ('Uses Data of the Record', 'DR', '', true),
('Data Processing Reporter', 'DPR', 'Data Processing Report', true), ('Data-Processing Record', 'DPR', '', false), ('all lower', 'AL', '', false), ('Alpha Beta Gamma', 'BG', '', true), ('Alpha Beta', 'XABY', '', false), ('Alpha Beta', 'AB', 'xAlpha Beta', true)) AS t(value, source, evidence, invented)""",
    "usage_examples": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS example FROM conversations",
    "ledger_merge": f"WITH {_FACTS} SELECT rel, kind, name, min(ord) AS first_ord, coalesce(min_by(description, ord) FILTER (description IS NOT NULL), '') AS description, array_to_string(list_sort(list_distinct(list(ord))), ',') AS origins FROM facts WHERE name <> '' GROUP BY rel, kind, name",
    "fact_occurrences": f"WITH {_FACTS} SELECT rel, lpad(CAST(ord AS VARCHAR), 12, '0') AS canonical, CAST(row_number() OVER (PARTITION BY rel, kind, name ORDER BY ord % 2 <> 0, lpad(CAST(ord AS VARCHAR), 12, '0')) - 1 AS INTEGER) AS occurrence FROM facts",
    "scope_allocation": "SELECT * FROM (VALUES ('a', 0, 'f1', 's2'), ('a', 0, 'f2', 's1'), ('a', 0, 'f3', 's3'), ('a', 0, 'f4', 's4'), ('a', 0, 'f5', NULL), ('a', 1, 'f6', 's5'), ('a', 0, 'f7', 'scope_0_5'), ('a', 0, 'f8', 's4'), ('a', 2, 'f9', 'u1'), ('a', 3, 'g1', 'u2'), ('a', 3, 'g2', NULL)) AS t(rel, chunk, fact, symbol)",
    "reconciliation": "SELECT * FROM (VALUES ('a', 'functions', 'run', 'run(x)', 10, 'runs x'), ('a', 'functions', 'run', 'run(y)', 20, NULL), ('a', 'classes', 'A', '', 30, 'a class after all'), ('a', 'functions', 'solo', 'solo()', 40, 'alone'), ('a', 'functions', 'Lid.open', '', 50, 'opens'), ('a', 'classes', 'Inner', '', 60, 'inside')) AS t(rel, bucket, name, signature, start, description)",
    "lexical_proof": "SELECT * FROM (VALUES ('a.py', 'classes', 'A', 26), ('a.py', 'functions', 'run', 46), ('a.py', 'functions', 'go', 70), ('a.py', 'exports', 'A', 116), ('a.py', 'exports', 'x', 116), ('b.ts', 'classes', 'View', 18), ('b.ts', 'exports', 'View', 18), ('b.ts', 'functions', 'use', 47), ('b.ts', 'exports', 'use', 47), ('b.ts', 'functions', 'gen', 91), ('b.ts', 'exports', 'made', 156), ('b.ts', 'exports', 'size', 184), ('c.js', 'exports', 'a', 0), ('c.js', 'exports', 'b', 0), ('c.js', 'classes', 'Öl', 58), ('c.js', 'functions', 'f', 71), ('c.js', 'exports', 'é', 98), ('e.py', 'classes', 'After', 36)) AS t(rel, bucket, name, start)",
    "rate_limits": "SELECT * FROM (VALUES ('Limit: 10 tokens per min', 'tpm', true), ('TPM exceeded', 'tpm', false), ('rpm', 'rpm', false), ('requests per min and quota', 'rpm', false), ('Daily limit', 'quota', true), ('RESOURCE_EXHAUSTED', 'quota', false), ('error 529', 'overloaded', false), ('stpm', NULL, false), ('Overloaded', 'overloaded', false), ('else', NULL, true)) AS t(message, kind, signalled)",
    "backoff_ladder": """WITH w AS (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS workers), l AS (SELECT workers, CASE WHEN workers = 1 THEN [1] WHEN workers = 2 THEN [2, 1] WHEN workers = 3 THEN [3, 2, 1] ELSE [workers, workers // 2, 1] END AS ls FROM w),
u AS (SELECT workers, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS rung, CAST(unnest(ls) AS INTEGER) AS level FROM l)
SELECT workers, rung, level, least(60.0::DOUBLE, CASE WHEN workers % 3 = 0 THEN workers * 20.0::DOUBLE ELSE 2.0 * pow(3.0, rung) END) AS seconds FROM u""",
    "failure_verdicts": """WITH p AS (SELECT * FROM (SELECT unnest([true, false]) AS insufficient) CROSS JOIN (SELECT unnest([true, false]) AS contract) CROSS JOIN (SELECT unnest([NULL, 'provider-quota-exhausted', 'provider-rate-limited', 'provider-authentication-rejected', 'provider-input-rejected']) AS reason))
SELECT *, CASE WHEN insufficient THEN 'insufficient_source' WHEN contract THEN 'response_contract_final' WHEN reason = 'provider-quota-exhausted' THEN 'terminal_billing' WHEN reason = 'provider-rate-limited' THEN 'rate_limit' WHEN reason = 'provider-authentication-rejected' THEN 'global' WHEN reason = 'provider-input-rejected' THEN 'input' ELSE 'transient' END AS verdict FROM p""",
    "feasibility_notes": "SELECT ord, 'single/file/* description: asks for ' || shown || ' (' || category || '), but one pass sees one file only' AS note FROM (VALUES (0, 'repository_scope', 'repository/repo-wide'), (1, 'all_files', 'all files'), (2, 'other_modules', 'other modules'), (3, 'all_references', 'all/every references'), (6, 'all_imports_from', 'all imports from'), (7, 'callers', 'callers')) AS t(ord, category, shown)",
    "feasibility_signs": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if c is None else repr(c)})" for t, c in SIGNS) + ") AS t(instruction, category)",
    "provider_choice": """WITH p AS (SELECT * FROM (SELECT unnest(['auto', 'openai', NULL]) AS name) CROSS JOIN (SELECT unnest(['claude-x', 'Gemini-2', 'gpt-x', '']) AS model))
SELECT *, CASE WHEN name = 'openai' THEN 'openai' WHEN lower(model) LIKE 'claude%' THEN 'anthropic' WHEN lower(model) LIKE 'gemini%' THEN 'gemini' ELSE 'openai' END AS provider FROM p""",
    "error_summary": """SELECT CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'warning' END AS level, count(*) AS n, CASE WHEN min(event_id % 5) = 0 THEN sha256(string_agg(event_type, chr(10) ORDER BY event_id)) ELSE '' END AS messages FROM events GROUP BY 1""",
    "correction_counts": "SELECT count(*) FILTER (event_id % 4 = 0) AS contract_failure, count(*) FILTER (event_id % 4 = 1) AS attempt, count(*) FILTER (event_id % 4 = 2) AS success, count(*) FILTER (event_id % 4 = 3) AS failure FROM events",
    "division_figures": f"""WITH RECURSIVE {docs._PACKED}, u AS (SELECT rel, count(*) AS units, sum(chars) AS chars FROM atoms GROUP BY rel), c AS (SELECT rel, count(*) AS chunks FROM chunks GROUP BY rel),
r AS (SELECT CASE WHEN chars > 12000 THEN 'divided' ELSE 'ordinary' END AS mode, units, chunks FROM u JOIN c USING (rel))
SELECT coalesce(mode, 'all') AS mode, count(*) AS files, CAST(sum(units) AS BIGINT) AS units, CAST(sum(chunks) AS BIGINT) AS chunks, count(*) FILTER (chunks > 10) AS blocked FROM r GROUP BY CUBE (mode)""",
    "strongest_scope": """WITH m AS (SELECT user_id, max(event_id % 3) AS s FROM events GROUP BY user_id) SELECT ['common', 'extension', 'file'][s + 1] AS scope, count(*) AS files FROM m GROUP BY 1""",
    "prompt_answers": f"""WITH {docs._FILES}, p AS (SELECT rel, {_PROMPT} AS p FROM files), a AS (SELECT rel, p, left(sha256(p), 1) <= '3' AS bad, p || chr(10) || chr(10) || 'Answer with one JSON object. This was none:' || chr(10) || 'Sorry, ' || length(p) AS q FROM p)
SELECT rel, CASE WHEN bad THEN 2 ELSE 1 END AS attempts, CASE WHEN NOT bad THEN sha256({_ECHO.format('p')}) WHEN left(sha256(q), 1) > '3' THEN sha256({_ECHO.format('q')}) END AS body FROM a""",
    "agent_bodies": f"""WITH {docs._FILES}, p AS (SELECT rel, {_PROMPT} AS p FROM files),
s AS (SELECT rel, 'structure' || chr(10) || p AS s, 'dependency' || chr(10) || p AS d FROM p), a AS (SELECT rel, {_ECHO.format('s')} AS s, {_ECHO.format('d')} AS d FROM s),
k AS (SELECT rel, 'dependency: ' || d || chr(10) || 'structure: ' || s AS k FROM a)
SELECT rel, 'structure' AS agent, s AS body FROM a UNION ALL SELECT rel, 'dependency', d FROM a UNION ALL SELECT rel, 'documentation', {_ECHO.format('k')} FROM k""",
    "tree_answers": f"""WITH {docs._ATOMS}, a0 AS (SELECT rel, ord, {_ECHO.format('source')} AS answer FROM atoms WHERE rel IN (SELECT rel FROM files WHERE chars > 12000)),
{_TREE}
SELECT rel, answer AS body FROM a6""",
    "markdown_round_trip": f"WITH {docs._FILES} SELECT rel AS path, CASE WHEN l.quality = 1 THEN hash ELSE sha256(content || '#') END AS hash, language, 'About ' || rel AS description, 'x,' || language AS key_concepts, CASE WHEN chars >= 0 THEN 'path_' || sha256(rel) END AS identity FROM files JOIN labels l USING (doc_id)",
    "cross_document": "SELECT 'path' AS fields, count(*) AS paths FROM documents JOIN labels USING (doc_id) WHERE lang = 'fr'",
    "recovery_identity": "SELECT CASE WHEN lang = 'de' THEN 'analysis_mode' ELSE 'none' END AS mismatch, count(*) AS records FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "recovered_tree": "SELECT CASE o_orderkey % 10 WHEN 9 THEN 'stale-identity' WHEN 1 THEN 'stale-identity' WHEN 2 THEN 'input-digest-mismatch' WHEN 3 THEN 'stage-mismatch' WHEN 4 THEN 'child-order-mismatch' WHEN 5 THEN 'coverage-mismatch' WHEN 6 THEN 'live-schema-mismatch' ELSE 'valid' END AS reason, count(*) AS nodes FROM orders GROUP BY 1",
    "upsert_records": "SELECT source = 'src1' AS fresh, count(*) AS records FROM documents JOIN labels USING (doc_id) WHERE source <> 'src2' GROUP BY 1",
    "file_sections": f"""WITH {docs._FILES} SELECT rel, sha256(concat_ws(chr(10) || chr(10), '### `' || rel || '`', '**Language:** ' || language, CASE WHEN chars > 2000 THEN '**Description:** ' || content END, '**Key concepts:** ' || language)) AS digest FROM files""",
    "run_figures": f"WITH {docs._PLAN} SELECT count(*) FILTER (route = 'agent') AS documented, count(*) FILTER (route = 'unchanged') AS unchanged, 0::BIGINT AS identical, 0::BIGINT AS skipped, count(*) AS selected FROM planned",
    "incremental_stream": "SELECT CAST(user_id AS VARCHAR) AS rel, max_by(event_type, event_id) AS hash, max(event_id) AS seq FROM events GROUP BY user_id",
    "windowed_counts": "WITH e AS (SELECT date_trunc('day', ts::TIMESTAMP)::TIMESTAMP AS d, event_type FROM events), c AS (SELECT d, event_type, count(*) AS n FROM e GROUP BY d, event_type) SELECT d AS window_start, event_type, n FROM c WHERE d + INTERVAL 2 DAY <= (SELECT max(ts::TIMESTAMP) FROM events)",
}
