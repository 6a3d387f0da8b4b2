"""Queries over the documents table as a collection of files: plans, duplicates, truncation, division."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import diagnostics as dg
from millrace.operators import division as dv
from millrace.operators import graph as gr
from millrace.operators import planning as pl
from millrace.operators import responses as rs
from millrace.operators import view as vw
from millrace.sources.files import document_path, from_documents
from millrace.session import pinned, table

RUN = pl.Run()


def files(spark: SparkSession, sf: str) -> DataFrame:
    return from_documents(table(spark, sf, "documents"))


def prior(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an earlier run: the labelled documents, those of quality 0 with other content."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    joined = pl.expected(docs.select(from_rel(), F.col("lang").alias("language"), F.col("text").alias("content"), "quality"), RUN)
    stale = F.when(F.col("quality") == 1, F.col("hash")).otherwise(F.sha2(F.concat("content", F.lit("#")), 256))
    absent = F.lit(None).cast("string")
    return joined.select(F.col("rel").alias("path"), stale.alias("hash"), "language", *[absent.alias(k) if k == "prompt_profile_digest" else F.col(k) for k in pl.IDENTITY])


def doc_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Document d depends on document d div 10 for d of even tens."""
    d = table(spark, sf, "documents").select("doc_id", from_rel())
    up = d.filter((F.col("doc_id") > 0) & (F.floor(F.col("doc_id") / 10) % 2 == 0)).select(F.col("rel").alias("src"), F.floor(F.col("doc_id") / 10).alias("doc_id"))
    return up.join(d, "doc_id").select("src", F.col("rel").alias("dst"))


def from_rel():
    return document_path()


def planned(spark: SparkSession, sf: str, run: pl.Run = RUN, graph: DataFrame | None = None) -> DataFrame:
    return pl.plan(files(spark, sf), prior(spark, sf), run, graph)


def plan_route_summary(spark, sf):
    return pl.route_summary(planned(spark, sf), RUN)


def plan_propagated(spark, sf):
    forced = pl.Run(forced=("src0/00000020.en", "src0/00000020.de"))
    return planned(spark, sf, forced, doc_edges(spark, sf)).groupBy("route").agg(F.count(F.lit(1)).alias("files"), F.count_if("changed").alias("changed"))


def plan_caps(spark, sf):
    return pl.caps(planned(spark, sf), pl.Run(max_files=100, max_calls=100_000_000))


def plan_partition(spark, sf):
    return pl.partition_holds(planned(spark, sf))


def reuse_anti_join(spark, sf):
    return planned(spark, sf).filter(~F.col("reuse")).select("rel", "hash")


def content_hash_duplicates(spark, sf):
    hashed = files(spark, sf).select("rel", F.sha2("content", 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("rel").alias("first_rel")).filter("copies > 1")


def hash_candidates(spark, sf):
    f = table(spark, sf, "documents").select("doc_id", from_rel(), F.sha2("text", 256).alias("hash"))
    return pl.hash_candidates(f, f.select(F.col("rel").alias("path"), "hash", F.col("doc_id").alias("ord"))).filter("candidate <> rel")


def truncate_head_tail(spark, sf):
    cut = tx.truncated(F.col("text"), 2_000)
    return table(spark, sf, "documents").select("doc_id", F.length(cut).alias("chars"), F.sha2(cut, 256).alias("digest"))


def token_budget_by_source(spark, sf):
    docs = table(spark, sf, "documents").withColumn("t", tx.tokens(F.length("text")))
    return docs.groupBy("source").agg(F.sum("t").alias("tokens"), F.max("t").alias("largest"), F.count_if(F.col("t") > 3_000).alias("above_3000"))


def line_atoms(spark, sf):
    return dv.line_atoms(files(spark, sf)).select("rel", "ord", "chars", "start_byte", "end_byte")


def oversized_route_view(spark, sf):
    return pl.route_view(planned(spark, sf), RUN)


def greedy_chunks(spark, sf):
    return dv.packed(files(spark, sf), 2_000).drop("reason")


def chunk_reasons(spark, sf):
    return dv.packed(files(spark, sf), 2_000).groupBy("reason").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))


def balanced_subdivision(spark, sf):
    large = files(spark, sf).filter(F.length("content") > 2_000).select("rel", F.lit(0).alias("ord"), F.col("content").alias("source"))
    return dv.subdivided(large, 2_000).groupBy("rel").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.length("source")).alias("longest"), F.sum(F.length("source")).alias("chars"))


def capacity_blocks(spark, sf):
    atoms = dv.line_atoms(files(spark, sf)).groupBy("rel").agg(F.count(F.lit(1)).alias("atoms"))
    counts = atoms.select("rel", (F.col("atoms") * 100).alias("atoms"), F.lit(0).alias("symbols"), F.col("atoms").alias("units"), (F.col("atoms") * 5).alias("chunks"), F.lit(1).alias("depth"))
    return dv.capacity(counts).groupBy(F.coalesce("blocked", F.lit("fits")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def reduction_levels(spark, sf):
    leaves = dv.line_atoms(files(spark, sf)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    return leaves.select("rel", F.explode(dv.level_counts(F.col("n"), 5)).alias("l")).select("rel", "l.level", "l.nodes", "l.passed_on")


def reduction_nodes(spark, sf):
    leaves = dv.line_atoms(files(spark, sf)).select("rel", "ord", F.concat(F.lit("leaf"), F.col("ord").cast("string")).alias("node_id"))
    return dv.reduction_tree(leaves, 5).select("rel", "level", "ordinal", F.size("child_ids").alias("children"), F.col("leaves"))


def reduction_coverage(spark, sf):
    leaves = dv.line_atoms(files(spark, sf)).select("rel", "ord", F.concat(F.lit("leaf"), F.col("ord").cast("string")).alias("node_id"))
    return dv.covers(dv.reduction_tree(leaves, 5), leaves).groupBy("holds").agg(F.count(F.lit(1)).alias("files"))


def names_in_chunks(spark, sf):
    """The first words of lines as names at their byte, and the chunks as ranges."""
    atoms = dv.line_atoms(files(spark, sf))
    lines = dv.divided(files(spark, sf).withColumn("language", F.lit("")), 2_000, dv.UNBOUNDED)
    ranges = lines.groupBy("rel", F.col("unit_group").alias("range_id")).agg(F.min("start_byte").alias("start"), F.max("end_byte").alias("end"))
    points = atoms.select("rel", F.col("start_byte").alias("at"), F.regexp_extract("source", "^([A-Za-z]+)", 1).alias("name"), "ord").filter("name <> ''")
    return dv.names_in_ranges(points, ranges).select("rel", "range_id", F.array_join("names", ",").alias("names"))


def breadth_first_quota(spark, sf):
    per = table(spark, sf, "documents").groupBy("source").agg(F.sum(F.floor(F.col("n_chars") / 1000)).cast("bigint").alias("cap"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cap"), "source")))
    return dg.quotas(ranked, 1_500).select("source", "cap", "rank", "quota")


def stream_digest(spark, sf):
    return dg.stream_digest(table(spark, sf, "nation"), F.col("n_name"), "n_nationkey", by=("n_regionkey",))


def folder_rollup(spark, sf):
    rolled = vw.folder_rollup(files(spark, sf))
    return rolled.select("folder", "file_count", F.array_join("languages", ",").alias("languages"), F.sha2(F.array_join("files", "\n"), 256).alias("files_sha256"))


def _concepts(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.col("source").alias("folder"), F.posexplode(F.split("text", "[^A-Za-z]+")).alias("pos", "concept"))
    return words.filter("concept <> ''").select("folder", F.struct("doc_id", "pos").alias("ord"), "concept")


def folder_top_concepts(spark, sf):
    return vw.top_concepts(_concepts(spark, sf))


def folder_summaries(spark, sf):
    top = vw.top_concepts(_concepts(spark, sf)).groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x.concept).alias("concepts"))
    rolled = vw.folder_rollup(files(spark, sf)).join(top, "folder")
    return rolled.select("folder", vw.folder_summary(F.col("folder"), F.col("file_count"), F.col("languages"), F.col("concepts")).alias("summary"))


def source_acronyms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(rs.acronyms(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("acronym"))


def call_manifest(spark, sf):
    leaves = dv.packed(files(spark, sf).filter(F.length("content") > 12_000), 2_000).groupBy("rel").agg(F.count(F.lit(1)).alias("leaves"))
    chunks = leaves.withColumn("reductions", F.lit(1))
    calls = pl.manifest(planned(spark, sf), RUN, chunks)
    return calls.select("seq", "category", "rel", "ordinal")


def manifest_reconciliation(spark, sf):
    calls = pl.manifest(planned(spark, sf), RUN)
    attempts = calls.filter("seq % 3 <> 0").select("call_id").unionByName(calls.filter("seq % 5 = 0").select("call_id")).unionByName(calls.filter("seq < 4").select(F.concat("call_id", F.lit("x")).alias("call_id")))
    return pl.reconciled(calls, attempts)


def worst_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return dg.worst(docs, 7, F.desc("n_chars"), F.asc("doc_id"))


def carry_sweep(spark, sf):
    recovered = files(spark, sf).select("rel").unionByName(spark.createDataFrame([("gone/1.en",), ("gone/2.en",)], "rel string"))
    return pl.carried(recovered, planned(spark, sf))


def closed_tree(spark, sf):
    """Lines as nodes under their tens; lines of fewer than 40 signs are invalid and take their ancestors with them."""
    atoms = pinned(dv.line_atoms(files(spark, sf)).select("rel", "ord", "chars"))  # three kinds of nodes are made of them
    leaves = atoms.select("rel", F.concat(F.lit("l"), F.col("ord").cast("string")).alias("node_id"), F.array().cast("array<string>").alias("child_ids"), (F.col("chars") >= 40).alias("valid"))
    groups = atoms.groupBy("rel", F.floor(F.col("ord") / 10).alias("g")).agg(F.array_sort(F.collect_list(F.concat(F.lit("l"), F.col("ord").cast("string")))).alias("child_ids"))
    parents = groups.select("rel", F.concat(F.lit("g"), F.col("g").cast("string")).alias("node_id"), "child_ids", F.lit(True).alias("valid"))
    tops = groups.groupBy("rel").agg(F.array_sort(F.collect_list(F.concat(F.lit("g"), F.col("g").cast("string")))).alias("child_ids")).select("rel", F.lit("top").alias("node_id"), "child_ids", F.lit(True).alias("valid"))
    kept = gr.closed_subset(leaves.unionByName(parents).unionByName(tops))
    return kept.groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("nodes"))


def path_tree(spark, sf):
    return gr.path_tree(files(spark, sf)).groupBy("depth", "is_file").agg(F.count(F.lit(1)).alias("paths"))


def scan_rules(spark, sf):
    from millrace.sources.files import scan_figures, scanned

    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "ts", "md", "HTML", "go")]), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", "Node_Modules", ".cache", "Docs/old", "lib/docs", "build")]), (F.col("doc_id") % 6 + 1).cast("int"))
    paths = table(spark, sf, "documents").select(F.concat(folder, F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("rel"), (F.col("n_chars") * 200).alias("length"))
    return scan_figures(scanned(paths, ignored=("docs/",), excluded=("src/f0.py",)))


NAMES = (
    "plan_route_summary", "plan_propagated", "plan_caps", "plan_partition", "reuse_anti_join", "content_hash_duplicates", "hash_candidates", "truncate_head_tail", "token_budget_by_source",
    "line_atoms", "oversized_route_view", "greedy_chunks", "chunk_reasons", "balanced_subdivision", "capacity_blocks", "reduction_levels", "reduction_nodes", "reduction_coverage", "names_in_chunks",
    "breadth_first_quota", "stream_digest", "folder_rollup", "folder_top_concepts", "folder_summaries", "source_acronyms", "call_manifest", "manifest_reconciliation", "worst_documents", "carry_sweep",
    "closed_tree", "path_tree", "scan_rules",
)
QUERIES = {name: globals()[name] for name in NAMES}

_FILES = "files AS (SELECT doc_id, concat(source, '/', lpad(CAST(doc_id AS VARCHAR), 8, '0'), '.', lang) AS rel, lang AS language, text AS content, length(text) AS chars, sha256(text) AS hash FROM documents)"
_PLAN = f"""{_FILES},
planned AS (SELECT f.*, coalesce(l.quality = 1, false) AS reuse,
  CASE WHEN coalesce(l.quality = 1, false) THEN 'unchanged' ELSE 'agent' END AS route
  FROM files f LEFT JOIN labels l USING (doc_id))"""
_LINE = r"[^\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])|[^\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]+"
_ATOMS = f"""{_FILES},
cut AS (SELECT rel, regexp_extract_all(content, '{_LINE}') AS ls FROM files),
atoms0 AS (SELECT rel, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS ord, unnest(ls) AS source FROM cut),
atoms AS (SELECT rel, ord, source, CAST(length(source) AS BIGINT) AS chars,
  CAST(sum(strlen(source)) OVER w - strlen(source) AS BIGINT) AS start_byte, CAST(sum(strlen(source)) OVER w AS BIGINT) AS end_byte
  FROM atoms0 WINDOW w AS (PARTITION BY rel ORDER BY ord))"""
_PACKED = f"""{_ATOMS},
pack AS (
  SELECT rel, ord, chars, 0 AS chunk, chars AS total, chars > 2000 AS big FROM atoms WHERE ord = 0
  UNION ALL
  SELECT a.rel, a.ord, a.chars, CASE WHEN a.chars > 2000 OR p.big OR p.total + a.chars > 2000 THEN p.chunk + 1 ELSE p.chunk END,
    CASE WHEN a.chars > 2000 OR p.big OR p.total + a.chars > 2000 THEN a.chars ELSE p.total + a.chars END, a.chars > 2000
  FROM pack p JOIN atoms a ON a.rel = p.rel AND a.ord = p.ord + 1),
chunks AS (SELECT rel, CAST(chunk AS INTEGER) AS chunk, CAST(min(ord) AS INTEGER) AS first_ord, CAST(max(ord) AS INTEGER) AS last_ord, count(*) AS atoms, CAST(sum(chars) AS BIGINT) AS chars, bool_or(big) AS big FROM pack GROUP BY rel, chunk)"""
_LEVELS = """lv AS (
  SELECT rel, n AS total, 1 AS level, CAST(ceil(n / 5.0) AS BIGINT) AS after_, CAST(n % 5 = 1 AS BIGINT) AS single FROM leaves WHERE n > 1
  UNION ALL
  SELECT rel, after_, level + 1, CAST(ceil(after_ / 5.0) AS BIGINT), CAST(after_ % 5 = 1 AS BIGINT) FROM lv WHERE after_ > 1 AND level < 6)"""
_WORDS = """words0 AS (SELECT doc_id, source AS folder, regexp_split_to_array(text, '[^A-Za-z]+') AS ws FROM documents),
words AS (SELECT folder, doc_id * 100000000 + generate_subscripts(ws, 1) - 1 AS ord, unnest(ws) AS concept FROM words0),
counted AS (SELECT folder, concept, count(*) AS n, min(ord) AS first_ FROM words WHERE concept <> '' GROUP BY folder, concept),
top AS (SELECT folder, CAST(row_number() OVER (PARTITION BY folder ORDER BY n DESC, first_) AS INTEGER) AS rank, concept, n FROM counted QUALIFY rank <= 5)"""
_MARK = "chr(10) || '... [truncated] ...' || chr(10)"

ORACLE_SQL = {
    "plan_route_summary": f"""WITH {_PLAN} SELECT route, count(*) AS files, CAST(sum(chars) AS BIGINT) AS chars,
CAST(sum(CASE WHEN route = 'agent' THEN greatest(1, (least(chars, 12000) + 3) // 4) ELSE 0 END) AS BIGINT) AS tokens,
CAST(sum(CASE WHEN route = 'agent' THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM planned GROUP BY route""",
    "plan_propagated": f"""WITH RECURSIVE {_PLAN},
edges AS (SELECT a.rel AS src, b.rel AS dst FROM files a JOIN files b ON b.doc_id = a.doc_id // 10 WHERE a.doc_id > 0 AND (a.doc_id // 10) % 2 = 0),
changed AS (SELECT rel FROM planned WHERE NOT reuse OR rel IN ('src0/00000020.en', 'src0/00000020.de')),
hit AS (SELECT rel FROM changed UNION SELECT e.src FROM hit JOIN edges e ON e.dst = hit.rel),
routed AS (SELECT p.rel, CASE WHEN p.rel NOT IN (SELECT rel FROM hit) THEN 'unchanged' WHEN p.rel IN ('src0/00000020.en', 'src0/00000020.de') THEN 'agent' WHEN p.reuse THEN 'identical' ELSE 'agent' END AS route, p.rel IN (SELECT rel FROM changed) AS changed FROM planned p)
SELECT route, count(*) AS files, count(*) FILTER (changed) AS changed FROM routed GROUP BY route""",
    "plan_caps": f"WITH {_PLAN} SELECT count(*) FILTER (route = 'agent') AS candidates, count(*) FILTER (route = 'agent') AS calls, count(*) FILTER (route = 'agent') > 100 AS files_exceeded, count(*) FILTER (route = 'agent') > 100000000 AS calls_exceeded FROM planned",
    "plan_partition": "SELECT count(*) AS selected, count(*) AS routed, true AS holds FROM documents",
    "reuse_anti_join": f"WITH {_PLAN} SELECT rel, hash FROM planned WHERE NOT reuse",
    "content_hash_duplicates": f"WITH {_FILES} SELECT hash, count(*) AS copies, min(rel) AS first_rel FROM files GROUP BY hash HAVING count(*) > 1",
    "hash_candidates": f"WITH {_FILES} SELECT rel, hash, candidate FROM (SELECT rel, hash, first(rel) OVER (PARTITION BY hash ORDER BY doc_id) AS candidate FROM files) WHERE candidate <> rel",
    "truncate_head_tail": f"""WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE concat(substr(text, 1, CAST(floor((2000 - 21) * 0.7::DOUBLE) AS INT)), {_MARK}, right(text, 2000 - 21 - CAST(floor((2000 - 21) * 0.7::DOUBLE) AS INT))) END AS t FROM documents)
SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM c""",
    "token_budget_by_source": "SELECT source, CAST(sum(greatest(1, (length(text) + 3) // 4)) AS BIGINT) AS tokens, max(greatest(1, (length(text) + 3) // 4)) AS largest, count(*) FILTER (greatest(1, (length(text) + 3) // 4) > 3000) AS above_3000 FROM documents GROUP BY source",
    "line_atoms": f"WITH {_ATOMS} SELECT rel, ord, chars, start_byte, end_byte FROM atoms",
    "oversized_route_view": f"WITH {_PLAN} SELECT rel, chars, 'truncate' AS view, route = 'agent' AS payable FROM planned WHERE chars > 12000",
    "greedy_chunks": f"WITH RECURSIVE {_PACKED} SELECT rel, chunk, first_ord, last_ord, atoms, chars FROM chunks",
    "chunk_reasons": f"""WITH RECURSIVE {_PACKED}, r AS (SELECT *, lead(big) OVER w AS next_big, lead(chunk) OVER w AS nxt FROM chunks WINDOW w AS (PARTITION BY rel ORDER BY chunk))
SELECT CASE WHEN big THEN 'continuation' WHEN nxt IS NULL THEN 'end-of-file' WHEN next_big THEN 'oversized-unit-isolation' ELSE 'source-ceiling' END AS reason, count(*) AS chunks, CAST(sum(chars) AS BIGINT) AS chars FROM r GROUP BY 1""",
    "capacity_blocks": f"""WITH {_ATOMS}, n AS (SELECT rel, count(*) AS atoms FROM atoms GROUP BY rel)
SELECT CASE WHEN atoms * 100 > 4096 THEN 'atom-cap' WHEN atoms * 5 > 256 THEN 'chunk-cap' ELSE 'fits' END AS reason, count(*) AS files FROM n GROUP BY 1""",
    "reduction_levels": f"WITH RECURSIVE {_ATOMS}, leaves AS (SELECT rel, count(*) AS n FROM atoms GROUP BY rel), {_LEVELS} SELECT rel, level, after_ - single AS nodes, single AS passed_on FROM lv",
    "reduction_coverage": "SELECT true AS holds, count(*) AS files FROM documents",
    "names_in_chunks": f"""WITH RECURSIVE {_PACKED},
ranges AS (SELECT c.rel, c.chunk AS range_id, a.start_byte AS s, b.end_byte AS e FROM chunks c JOIN atoms a ON a.rel = c.rel AND a.ord = c.first_ord JOIN atoms b ON b.rel = c.rel AND b.ord = c.last_ord),
points AS (SELECT rel, start_byte AS at_, regexp_extract(source, '^([A-Za-z]+)', 1) AS name, ord FROM atoms),
firsts AS (SELECT r.rel, r.range_id, p.name, min(p.ord) AS ord FROM points p ASOF JOIN ranges r ON p.rel = r.rel AND p.at_ >= r.s WHERE p.at_ < r.e AND p.name <> '' GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY rel, range_id ORDER BY ord, name) AS nth FROM firsts QUALIFY nth <= 32)
SELECT rel, range_id, string_agg(name, ',' ORDER BY nth) AS names FROM top GROUP BY rel, range_id""",
    "breadth_first_quota": """WITH per AS (SELECT source, CAST(sum(n_chars // 1000) AS BIGINT) AS cap FROM documents GROUP BY source),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY cap DESC, source) AS INTEGER) AS rank FROM per),
rounds AS (SELECT source, rank, unnest(range(1, cap + 1)) AS r FROM ranked),
taken AS (SELECT source, row_number() OVER (ORDER BY r, rank) AS nth FROM rounds QUALIFY nth <= 1500)
SELECT ranked.source, cap, rank, CAST(count(taken.source) AS BIGINT) AS quota FROM ranked LEFT JOIN taken USING (source) GROUP BY ALL""",
    "stream_digest": """SELECT n_regionkey, sha256('[' || string_agg('"' || sha256(n_name) || '"', ',' ORDER BY n_nationkey) || ']') AS digest FROM nation GROUP BY n_regionkey""",
    "folder_rollup": f"""WITH {_FILES} SELECT split_part(rel, '/', 1) AS folder, count(*) AS file_count, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages, sha256(string_agg(rel, chr(10) ORDER BY rel)) AS files_sha256 FROM files GROUP BY 1""",
    "folder_top_concepts": f"WITH {_WORDS} SELECT folder, rank, concept, n FROM top",
    "folder_summaries": f"""WITH {_WORDS}, {_FILES}, g AS (SELECT split_part(rel, '/', 1) AS folder, count(*) AS c, array_to_string(list_sort(list_distinct(list(language))), ', ') AS ls FROM files GROUP BY 1),
t AS (SELECT folder, string_agg(concept, ', ' ORDER BY rank) AS cs FROM top GROUP BY folder)
SELECT folder, 'Files under `' || folder || '` (' || c || ' ' || ls || ' file(s)). Common concepts: ' || cs || '.' AS summary FROM g JOIN t USING (folder)""",
    "source_acronyms": """SELECT DISTINCT doc_id, w AS acronym FROM (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Za-z0-9_]+')) AS w FROM documents) WHERE regexp_full_match(w, '[A-Z][A-Z0-9]{1,5}')""",
    "call_manifest": f"""WITH RECURSIVE {_PACKED}, planned AS (SELECT f.*, CASE WHEN coalesce(l.quality = 1, false) THEN 'unchanged' ELSE 'agent' END AS route FROM files f LEFT JOIN labels l USING (doc_id)),
big AS (SELECT c.rel, count(*) AS leaves FROM chunks c JOIN planned p ON p.rel = c.rel WHERE p.chars > 12000 AND p.route = 'agent' GROUP BY c.rel),
calls AS (
  SELECT 0 AS phase, 'file' AS category, rel, 1 AS ordinal FROM planned WHERE route = 'agent' AND rel NOT IN (SELECT rel FROM big)
  UNION ALL SELECT 1, 'leaf', rel, CAST(unnest(range(1, leaves + 1)) AS INTEGER) FROM big
  UNION ALL SELECT 2, 'reduction', rel, 1 FROM big
  UNION ALL SELECT 3, 'synthesis', rel, 1 FROM big)
SELECT row_number() OVER (ORDER BY phase, rel, ordinal) - 1 AS seq, category, rel, ordinal FROM calls""",
    "manifest_reconciliation": f"""WITH {_PLAN}, calls AS (SELECT row_number() OVER (ORDER BY rel) - 1 AS seq FROM planned WHERE route = 'agent'),
tried AS (SELECT seq, CAST(seq % 3 <> 0 AS INT) + CAST(seq % 5 = 0 AS INT) AS n FROM calls)
SELECT count(*) AS planned, count(*) FILTER (n > 0) AS attempted, CAST(sum(greatest(n - 1, 0)) + count(*) FILTER (seq < 4) AS BIGINT) AS additional, count(*) FILTER (n = 0) AS unattempted FROM tried""",
    "worst_documents": "SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total, least((SELECT count(*) FROM documents), 7) AS retained, greatest((SELECT count(*) FROM documents) - 7, 0) AS omitted FROM documents ORDER BY n_chars DESC, doc_id LIMIT 7",
    "carry_sweep": "SELECT unnest(['gone/1.en', 'gone/2.en']) AS rel",
    "closed_tree": f"""WITH {_ATOMS}, g AS (SELECT rel, ord // 10 AS g, bool_and(chars >= 40) AS ok FROM atoms GROUP BY ALL), t AS (SELECT rel, bool_and(ok) AS ok FROM g GROUP BY rel),
n AS (SELECT 'l' AS kind FROM atoms WHERE chars >= 40 UNION ALL SELECT 'g' FROM g WHERE ok UNION ALL SELECT 't' FROM t WHERE ok) SELECT kind, count(*) AS nodes FROM n GROUP BY kind""",
    "path_tree": "SELECT 1 AS depth, false AS is_file, count(DISTINCT source) AS paths FROM documents UNION ALL SELECT 2, true, count(*) FROM documents",
    "scan_rules": """WITH p AS (SELECT doc_id, n_chars * 200 AS length, ['src', 'Node_Modules', '.cache', 'Docs/old', 'lib/docs', 'build'][doc_id % 6 + 1] AS folder, ['py', 'ts', 'md', 'HTML', 'go'][doc_id % 5 + 1] AS ext FROM documents),
k AS (SELECT CASE WHEN folder IN ('Node_Modules', '.cache', 'build') THEN 'skipped_folder' WHEN folder = 'Docs/old' THEN 'ignored' WHEN doc_id = 0 THEN 'generated' WHEN ext = 'md' THEN 'extension' WHEN length / 1024.0 > 500 THEN 'too_large' ELSE 'kept' END AS kind FROM p)
SELECT kind, count(*) AS n FROM k GROUP BY kind""",
}
