"""The project document: its parts as tables, written as JSON or Markdown, and read back.

A document is a table of blocks in order, so a project of any size is rendered where its rows are. The order is
(part, at); the text of all blocks in that order is the document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import graph as gr
from millrace.operators.planning import IDENTITY
from millrace.operators.responses import usage_example
from millrace.session import pinned

# The public fields of a file, of a run, and the parts of a document, in their order.
_SYMBOLS = "array<struct<name:string,description:string>>"
FILE_FIELDS = {
    "hash": "string", "path": "string", "language": "string", "description": "string", "role_in_system": "string", "imports": "array<string>", "functions": _SYMBOLS, "classes": _SYMBOLS,
    "exports": "array<string>", "key_concepts": "array<string>", "usage_example": "string", "reachable_from_entry": "boolean",
    "links": "struct<internal_dependencies:array<string>,imported_by:array<string>,external_dependencies:array<string>,sdk_dependencies:array<string>>",
}
RUN_FIELDS = (
    "entry_file", "entry_source", "documentation_scope", "analysis_mode", "files_scanned", "files_selected", "files_documented_by_llm", "files_failed", "files_unattempted", "files_skipped_insufficient_source",
    "files_reused_unchanged", "files_reused_identical_content", "files_resumed_from_recovery",
)
PARTS = ("last_run", "tree", "folders", "dependency_catalog", "dependency_graph", "files", "errors")
LINKS = (("Internal Dependencies", "internal_dependencies"), ("Imported By", "imported_by"), ("External Dependencies", "external_dependencies"), ("SDK / Standard Library", "sdk_dependencies"))
TITLE = "# Project documentation"


@dataclass
class View:
    """``files`` has FILE_FIELDS (any of them) and may have the keys of IDENTITY; ``folders`` (path, summary, file_count, languages, files),
    ``catalog`` (name, type, used_for, files, file_count), ``edges`` (from, to). ``run`` are figures of RUN_FIELDS."""

    files: DataFrame
    folders: DataFrame | None = None
    catalog: DataFrame | None = None
    edges: DataFrame | None = None
    run: dict[str, object] = field(default_factory=dict)
    errors: str = ""

    def __post_init__(self) -> None:
        if unknown := set(self.run) - set(RUN_FIELDS):
            raise ValueError(f"no figures of a run: {sorted(unknown)}")


def public_files(records: DataFrame, nested: str | None = None) -> DataFrame:
    """Records as public files: known fields only, null where empty, usage examples without placeholders.

    The keys of the identity come from the record itself, else from the struct ``nested``.
    """
    inner = set(records.schema[nested].dataType.fieldNames()) if nested else set()

    def found(name: str, kind: str) -> Column:
        own = [F.col(name)] * (name in records.columns) + [F.col(f"{nested}.{name}")] * (name in inner)
        value = F.coalesce(*own).cast(kind) if own else F.lit(None).cast(kind)
        if kind == "string":
            return F.nullif(usage_example(value) if name == "usage_example" else value, F.lit(""))
        return F.when(F.size(value) > 0, value) if kind.startswith("array") else value

    return records.select(*[found(n, k).alias(n) for n, k in FILE_FIELDS.items()], *[found(k, "string").alias(k) for k in IDENTITY])


def usage_notes(notes: DataFrame) -> DataFrame:
    """(rel, notes): a map from import to what it is used for, of rows (rel, ord, import, used_for); the last note of an import counts."""
    kept = notes.filter("nullif(trim(import), '') IS NOT NULL AND nullif(trim(used_for), '') IS NOT NULL")
    last = kept.groupBy("rel", F.trim("import").alias("import")).agg(F.max_by(F.trim("used_for"), "ord").alias("used_for"))
    return last.groupBy("rel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("import", "used_for")))).alias("notes"))


# ---- JSON


def _tree(files: DataFrame) -> DataFrame:
    return gr.path_tree(files.select(F.col("path").alias("rel"))).withColumn("parts", F.split("path", "/"))


def _items(view: View) -> list[tuple[str, DataFrame]]:
    """The lists of a document: each a table (order, item), item as JSON without empty fields."""
    item = lambda df, order, *cols: df.select(order.alias("order"), F.to_json(F.struct(*cols)).alias("item"))
    whole = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    lists = []
    if view.folders is not None:
        lists.append(("folders", item(view.folders, F.array("path"), "path", "summary", "file_count", whole("languages"), whole("files"))))
    if view.catalog is not None:
        lists.append(("dependency_catalog", item(view.catalog, F.array("type", "name"), "name", "type", F.nullif("used_for", F.lit("")).alias("used_for"), whole("files"), "file_count")))
    if view.edges is not None:
        lists.append(("dependency_graph", item(view.edges, F.array("from", "to"), "from", "to", F.lit("internal_import").alias("type"))))
    files = public_files(view.files)
    return [*lists, ("files", item(files, F.array("path"), *files.columns))]


def json_blocks(view: View) -> DataFrame:
    """(part, at, text): the document as JSON, two spaces a level, its parts in order, lists by their names, empty fields left out."""
    spark = view.files.sparkSession
    run = {k: view.run[k] for k in RUN_FIELDS if k in view.run}
    head = "{\n" + (f'  "last_run": {_indented(json.dumps(run, indent=2, ensure_ascii=False), 2)},\n' if run else "")
    rows = None
    for part, (name, items) in enumerate(_items(view), 1):
        ranked = items.withColumn("part", F.lit(part))
        last = ranked.agg(F.max("order").alias("last"))
        mark = ranked.crossJoin(F.broadcast(last)).withColumn("more", F.col("order") != F.col("last")).drop("last")  # one row
        shown = mark.mapInArrow(_pretty, "part int, order array<string>, text string")
        ends = spark.createDataFrame([(part, [], f'  "{name}": [\n'), (part, None, f"  ]{'' if name == 'files' and not view.errors else ','}\n")], "part int, order array<string>, text string")
        part_rows = shown.withColumn("_end", F.lit(1)).unionByName(ends.withColumn("_end", F.when(F.col("order").isNull(), 2).otherwise(0)))
        rows = part_rows if rows is None else rows.unionByName(part_rows)
    tail = (f'  "errors": {json.dumps(view.errors, ensure_ascii=False)}\n' if view.errors else "") + "}\n"
    ends = spark.createDataFrame([(0, None, head, 0), (99, None, tail, 3)], "part int, order array<string>, text string, _end int")
    return rows.unionByName(ends).select("part", F.struct("_end", "order").alias("at"), "text")


def _indented(text: str, by: int) -> str:
    return text.replace("\n", "\n" + " " * by)


def _pretty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        texts = [f"    {_indented(json.dumps(json.loads(r['item']), indent=2, ensure_ascii=False), 4)}{',' * r['more']}\n" for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r["part"] for r in rows], pa.int32()), pa.array([r["order"] for r in rows], pa.list_(pa.string())), pa.array(texts, pa.string())], names=["part", "order", "text"])


# ---- Markdown


def _bold(title: str, value: Column, between: str = " ") -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"**{title}:**{between}"), value, F.lit("\n\n")))


def _listed(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"**{title}:**\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n")))


def _coded(values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit("`"), x, F.lit("`")))


def _named(symbols: Column) -> Column:
    return F.transform(symbols, lambda s: F.concat(F.lit("`"), s["name"], F.lit("`"), F.when(F.nullif(s["description"], F.lit("")).isNotNull(), F.concat(F.lit(": "), s["description"])).otherwise("")))


def file_section(files: DataFrame) -> Column:
    """The section of a public file; fields that are null have no line."""
    parts = [
        F.concat(F.lit("### "), F.col("path"), F.lit("\n\n")),
        F.concat(F.lit("**Language:** "), F.coalesce("language", F.lit("")), F.lit("  \n\n")),
        F.concat(F.lit("**Reachable from entry:** "), F.when(F.coalesce("reachable_from_entry", F.lit(True)), "Yes").otherwise("No"), F.lit("  \n\n")),
        _bold("Description", F.col("description")), _bold("Role", F.col("role_in_system")), _listed("Imports", _coded(F.col("imports"))),
        *[_listed(title, _coded(F.col(f"links.{name}"))) for title, name in LINKS],
        _listed("Functions", _named(F.col("functions"))), _listed("Classes", _named(F.col("classes"))), _listed("Exports", _coded(F.col("exports"))), _listed("Key Concepts", F.col("key_concepts")),
        F.when(F.col("usage_example").isNotNull(), F.concat(F.lit("**Usage Example:**\n\n```text\n"), F.col("usage_example"), F.lit("\n```\n\n"))),
    ]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def markdown_blocks(view: View) -> DataFrame:
    """(part, at, text): overview, run, tree, folders, dependency map, catalog, files, errors. Each file's section ends with the
    file itself in a comment, so that reading gives it back whole."""
    spark = view.files.sparkSession
    files = public_files(view.files)
    order = lambda *cols: F.array(*cols).cast("array<string>").alias("at")
    block = lambda df, part, at, text: df.select(F.lit(part).alias("part"), at, text.alias("text"))
    fixed = lambda part, text, end="": spark.createDataFrame([(part, [end], text)], "part int, at array<string>, text string")
    tree = _tree(files)
    figures = files.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"))
    tops = tree.filter("depth = 1 AND NOT is_file").agg(F.array_join(F.transform(F.array_sort(F.collect_set("path")), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ").alias("folders"))
    said = lambda c, empty: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(empty))
    overview = F.concat(
        F.lit(f"{TITLE}\n\n## Project Overview\n\n- Entry file: `{view.run.get('entry_file') or 'not specified'}`\n- Files documented: "), F.col("n").cast("string"), F.lit("\n- Languages: "), said("languages", "unknown"),
        F.lit("\n- Folders: "), said("folders", "none"), F.lit("\n\n"),
    )
    run = [("documented by LLM", "files_documented_by_llm"), ("failed", "files_failed"), ("reused (unchanged)", "files_reused_unchanged"), ("reused (identical content)", "files_reused_identical_content")]
    lines = [f"- Files {title}: {view.run.get(name, 0)}\n" for title, name in run]
    lines += [f"- Files resumed from recovery: {view.run['files_resumed_from_recovery']}\n"] if view.run.get("files_resumed_from_recovery") else []
    name = F.element_at("parts", -1)
    branch = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), name, F.when(F.col("is_file"), "\n").otherwise("/\n"))
    blocks = [
        block(figures.crossJoin(tops), 0, order(F.lit("")), overview),  # one row each
        fixed(1, "## Run Summary\n\n" + "".join(lines) + "\n"),
        fixed(2, "## Project Tree\n\n```text\n"), tree.select(F.lit(2).alias("part"), F.concat(F.array(F.lit(" ")), "parts").alias("at"), branch.alias("text")), fixed(3, "```\n\n"),
    ]
    if view.folders is not None:
        text = F.concat(F.lit("### "), "path", F.lit("\n\n"), "summary", F.lit("\n\n- Files: "), F.col("file_count").cast("string"), F.lit("\n"), F.when(F.size("languages") > 0, F.concat(F.lit("- Languages: "), F.array_join("languages", ", "), F.lit("\n"))).otherwise(""), F.lit("\n"))
        blocks += [fixed(4, "## Folder Map\n\n"), block(view.folders, 4, order(F.lit(" "), "path"), text)]
    if view.edges is not None:
        blocks += [fixed(5, "## Dependency Map\n\n"), block(view.edges, 5, order(F.lit(" "), "from", "to"), F.concat(F.lit("- `"), "from", F.lit("` -> `"), "to", F.lit("`\n"))), fixed(6, "\n")]
    if view.catalog is not None:
        text = F.concat(F.lit("### "), "name", F.lit("\n\n- Type: "), "type", F.lit("\n- Used by: "), F.col("file_count").cast("string"), F.lit(" file(s)\n"), F.coalesce(F.concat(F.lit("- Used for: "), F.nullif("used_for", F.lit("")), F.lit("\n")), F.lit("")), F.lit("\n"))
        blocks += [fixed(7, "## Dependency Catalog\n\n"), block(view.catalog, 7, order(F.lit(" "), "type", "name"), text)]
    whole = F.concat(F.lit("<!-- file:"), F.base64(F.encode(F.to_json(F.struct(*files.columns)), "utf-8")), F.lit(" -->\n\n"))
    blocks += [fixed(8, "## Files\n\n"), block(files, 8, order(F.lit(" "), "path"), F.concat(file_section(files), whole))]
    if view.errors:
        blocks.append(fixed(9, f"## Errors\n\n```text\n{view.errors}\n```\n"))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def write(blocks: DataFrame, path: str) -> None:
    """Writes a document in order, under the commit protocol: the parts of the folder, one after the other, are its text.

    Every block ends with a line feed, which is what the writer sets between rows.
    """
    blocks.orderBy("part", "at").select(F.expr("left(text, length(text) - 1)").alias("text")).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): a document of ``write``, its parts joined in order. A document is one text, so it is one row."""
    parts = spark.read.text(path, wholetext=True).select(F.struct(F.col("_metadata.file_name").alias("f"), F.col("value").alias("v")).alias("p"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.v), "").alias("text"))


def _pieces(spark: SparkSession, path: str, between: str | None = None) -> DataFrame:
    """(at, text, first) of what stands between two marks, or two line ends, of the files of ``write``; ``at`` is its place, ``first`` whether it begins a file.

    Splits of a file are read by many tasks. The rows are pinned, as a place counts from where a split begins.
    """
    read = spark.read.text(path, lineSep=between)
    meta = F.col("_metadata")
    rows = pinned(read.select(F.struct(meta["file_name"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at"), F.col("value").alias("text")))
    firsts = rows.groupBy("at.file").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))  # one row a file
    return rows.join(F.broadcast(firsts), "at", "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _inside(rows: DataFrame, begins: Column, ends: Column) -> DataFrame:
    """Rows (at, ...) from the first one that ``begins`` to the next one that ``ends``, this one left out."""
    start = rows.filter(begins).agg(F.min("at").alias("_start"))  # one row each
    bounds = rows.filter(ends).select(F.col("at").alias("_end")).crossJoin(F.broadcast(start)).filter("_end > _start").agg(F.min("_end").alias("_end")).crossJoin(F.broadcast(start))
    return rows.crossJoin(F.broadcast(bounds)).filter((F.col("at") >= F.col("_start")) & F.coalesce(F.col("at") < F.col("_end"), F.lit(True))).drop("_start", "_end")


def stored_chunks(spark: SparkSession, path: str, title: str) -> DataFrame:
    """(body): what stands in a section under each heading of the third level, and before the first one, of a document of ``write``.

    The text never meets in one row: it is read between such headings, and only the places where sections begin are compared. A block of ``write``
    does not go on in another file, so no body does.
    """
    rows = _pieces(spark, path, "\n### ")
    text = tx.normalised_newlines(F.when(F.col("first"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    rows = rows.select("at", F.posexplode(F.split(text, "\n### ")).alias("k", "text"))
    rows = rows.select("at", "k", F.posexplode(F.split("text", r"(?m)(?!\A)^## ")).alias("j", "text")).select(F.struct("at", "k", "j").alias("at"), (F.col("j") > 0).alias("heads"), "text")
    head = F.col("heads") & F.rlike("text", F.lit(rf"\A{re.escape(title)}\n(\n|\z)"))
    body = F.when(F.col("heads"), F.regexp_replace("text", r"\A[^\n]*\n\n?", "")).otherwise(F.col("text"))
    return _inside(rows, head, F.col("heads")).select(body.alias("body")).filter(tx.strip_ascii(F.col("body")) != "")


# ---- reading what Markdown shows


def section(text: Column, title: str) -> Column:
    """What stands between the heading of a title and the next heading."""
    return F.trim(F.regexp_extract(tx.normalised_newlines(text), rf"(?ms)^## {re.escape(title)}\n\n(.*?)(?=^## |\z)", 1))


def bullet(body: Column, label: str) -> Column:
    return F.trim(F.regexp_extract(body, rf"(?m)^- {re.escape(label)}: (.*)$", 1))


def bold(body: Column, label: str) -> Column:
    """The rest of a labelled line."""
    return F.trim(F.regexp_extract(body, rf"(?m)^\*\*{re.escape(label)}:\*\*[ \t]*(.*?)(?:  )?$", 1))


def paragraph(body: Column, label: str) -> Column:
    return tx.strip(F.regexp_extract(body, rf"(?ms)^\*\*{re.escape(label)}:\*\*[ \t]*(.*?)(?=\n\n\*\*|\n\n<!-- file:|\z)", 1))


def bullets(body: Column, label: str, code: bool = False) -> Column:
    """The lines of a labelled list, without the marks of code where they are code."""
    found = F.regexp_extract(body, rf"(?ms)^\*\*{re.escape(label)}:\*\*\n\n(.*?)(?=\n\n\*\*|\n\n<!-- file:|\z)", 1)
    lines = F.filter(F.transform(F.split(found, "\n"), F.trim), lambda x: F.startswith(x, F.lit("- ")))
    values = F.transform(lines, lambda x: F.trim(F.substr(x, F.lit(3))))
    return F.transform(values, lambda x: F.regexp_replace(x, "^`(.*)`$", "$1")) if code else values


def named(body: Column, label: str) -> Column:
    """(name, description) of the lines of a labelled list."""
    one = lambda x: F.struct(
        F.when(F.rlike(x, F.lit("^`[^`]+`(?::|$)")), F.regexp_extract(x, "^`([^`]+)`", 1)).otherwise(x).alias("name"), F.regexp_extract(x, r"^`[^`]+`:\s*(.*)$", 1).alias("description")
    )
    return F.transform(bullets(body, label), one)


def fenced(body: Column, label: str) -> Column:
    return tx.strip(F.regexp_extract(body, rf"(?ms)^\*\*{re.escape(label)}:\*\*\n\n```text\n(.*?)\n```", 1))


def _chunks(text: Column, title: str) -> Column:
    return F.filter(F.split(F.concat(F.lit("\n"), section(text, title)), r"\n### "), lambda c: F.trim(c) != "")


def read_files(documents: DataFrame) -> DataFrame:
    """Public files of documents (text): whole from the comment of their section, else from what the section shows."""
    return files_of(documents.select(F.explode(_chunks(F.col("text"), "Files")).alias("body")))


def files_of(rows: DataFrame) -> DataFrame:
    """Public files of their sections (body)."""
    kind = ", ".join(f"{n} {k}" for n, k in FILE_FIELDS.items()) + ", " + ", ".join(f"{k} string" for k in IDENTITY)
    coded = F.regexp_extract("body", "<!-- file:([A-Za-z0-9+/=\\s]*) -->", 1)
    whole = F.from_json(F.when(coded != "", F.decode(F.unbase64(F.regexp_replace(coded, r"\s", "")), "utf-8")), kind)
    body = F.col("body")
    none = lambda c: F.nullif(c, F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, c)
    links = F.struct(*[bullets(body, title, True).alias(name) for title, name in LINKS])
    any_link = sum((F.size(bullets(body, title, True)) for title, _ in LINKS), F.lit(0)) > 0
    shown = {
        "path": F.trim(F.split_part(body, F.lit("\n"), F.lit(1))), "language": none(bold(body, "Language")), "description": none(paragraph(body, "Description")), "role_in_system": none(paragraph(body, "Role")),
        "imports": some(bullets(body, "Imports", True)), "functions": some(named(body, "Functions")), "classes": some(named(body, "Classes")), "exports": some(bullets(body, "Exports", True)),
        "key_concepts": some(bullets(body, "Key Concepts")), "usage_example": none(fenced(body, "Usage Example")), "reachable_from_entry": F.when(bold(body, "Reachable from entry") != "", bold(body, "Reachable from entry") == "Yes"),
        "links": F.when(any_link, links),
    }
    seen = F.struct(*[shown.get(n, F.lit(None)).cast(k).alias(n) for n, k in FILE_FIELDS.items()], *[F.lit(None).cast("string").alias(k) for k in IDENTITY])
    return rows.select(F.coalesce(whole, seen).alias("r")).select("r.*")


def read_catalog(documents: DataFrame) -> DataFrame:
    """(name, type, file_count, used_for) of documents (text)."""
    return catalog_of(documents.select(F.explode(_chunks(F.col("text"), "Dependency Catalog")).alias("body")))


def catalog_of(rows: DataFrame) -> DataFrame:
    """(name, type, file_count, used_for) of the entries (body) of a catalog."""
    body = F.col("body")
    return rows.select(
        F.trim(F.split_part(body, F.lit("\n"), F.lit(1))).alias("name"), F.coalesce(F.nullif(bullet(body, "Type"), F.lit("")), F.lit("unknown")).alias("type"),
        F.coalesce(F.nullif(F.regexp_extract(bullet(body, "Used by"), r"^(\d+)", 1), F.lit("")).cast("bigint"), F.lit(0)).alias("file_count"), F.nullif(bullet(body, "Used for"), F.lit("")).alias("used_for"),
    )


def read_edges(documents: DataFrame) -> DataFrame:
    """(from, to) of documents (text)."""
    return edges_of(documents.select(F.explode(F.split(section(F.col("text"), "Dependency Map"), "\n")).alias("line")))


def stored_edges(spark: SparkSession, path: str) -> DataFrame:
    """(from, to) of a document of ``write``, read by lines."""
    found = _inside(_pieces(spark, path), F.col("text") == "## Dependency Map", F.startswith("text", F.lit("## ")))
    return edges_of(found.select(F.col("text").alias("line")))


def edges_of(rows: DataFrame) -> DataFrame:
    """(from, to) of the lines of a map."""
    rows = rows.filter(F.rlike("line", F.lit("^- `.+?` -> `.+?`$")))
    return rows.select(F.regexp_extract("line", "^- `(.+?)` -> `(.+?)`$", 1).alias("from"), F.regexp_extract("line", "^- `(.+?)` -> `(.+?)`$", 2).alias("to"))


_READ = ", ".join(f"{n}: {k}" for n, k in {**FILE_FIELDS, **dict.fromkeys(IDENTITY, "string")}.items())


def read_json(documents: DataFrame) -> DataFrame:
    """Public files of JSON documents (text). A document that is no object with files fails the read."""
    parsed = F.from_json("text", f"files array<struct<{_READ}>>").getField("files")
    wrong = F.raise_error(F.lit("no project document")).cast(f"array<struct<{_READ}>>")
    return documents.select(F.explode(F.coalesce(parsed, wrong)).alias("r")).select("r.*")


def figures(view: View) -> DataFrame:
    """One row of what a run did, its missing figures as 0: the summary alone, without the files."""
    row = [view.run.get(n) if n in RUN_FIELDS[:4] else int(view.run.get(n, 0)) for n in RUN_FIELDS]
    return view.files.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{n} {'string' if n in RUN_FIELDS[:4] else 'bigint'}" for n in RUN_FIELDS))
