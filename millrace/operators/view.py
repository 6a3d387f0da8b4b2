"""The project view: links, dependency catalog, folders, run figures, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.classify import NODE_LANGUAGES, dependency

# Words that make a text about a dependency specific.
SPECIFIC = ("project", "application", "app", "api", "database", "route", "screen", "service", "model", "schema", "state")


def folder_rollup(files: DataFrame) -> DataFrame:
    """(folder, file_count, languages, files) by top folder, '.' for the root; sorted, languages without repeats."""
    return files.groupBy(tx.top_folder(F.col("rel")).alias("folder")).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.array_sort(F.collect_set(F.nullif("language", F.lit("")))).alias("languages"),
        F.array_sort(F.collect_list("rel")).alias("files"),
    )


def top_concepts(concepts: DataFrame, most: int = 5) -> DataFrame:
    """(folder, rank, concept, n): most frequent of (folder, ord, concept), ties by first place."""
    counted = concepts.groupBy("folder", "concept").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "first")))
    return ranked.filter(F.col("rank") <= most).select("folder", "rank", "concept", "n")


def folder_summary(folder: Column, count: Column, languages: Column, concepts: Column) -> Column:
    spoken = F.when(F.size(languages) > 0, F.array_join(languages, ", ")).otherwise("source")
    common = F.when(F.size(concepts) > 0, F.concat(F.lit(" Common concepts: "), F.array_join(concepts, ", "), F.lit("."))).otherwise("")
    root = F.concat(F.lit("Root-level "), spoken, F.lit(" files ("), count.cast("string"), F.lit(" file(s))."), common)
    other = F.concat(F.lit("Files under `"), folder, F.lit("` ("), count.cast("string"), F.lit(" "), spoken, F.lit(" file(s))."), common)
    return F.when(folder == ".", root).otherwise(other)


def import_roots(path: Column) -> Column:
    """Names under which Python may import a path: its folders, and its stem unless that is __init__."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    folders = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: (p != "") & (p != ".") & (p != ".."))
    return F.array_distinct(F.concat(folders, F.when((stem != "") & (stem != "__init__"), F.array(stem)).otherwise(F.array().cast("array<string>"))))


def links(unresolved: DataFrame, files: DataFrame, graph: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(rel, kind, canonical), kind external or sdk, of each file's imports that are no project files.

    Names come from the parser; for the Node family from the model (rel, raw), as the parser leaves bare
    packages out; of Dart only dart: and package: imports count. A Python name that is a root of the
    project and of what the file itself imports is the project's own.
    """
    langs = files.select("rel", F.lower("language").alias("language"))
    parsed = unresolved.join(langs, "rel").filter(~F.col("language").isin(*NODE_LANGUAGES))
    parsed = parsed.filter((F.col("language") != "dart") | F.rlike("raw", F.lit("^(?:dart|package):"))).select("rel", "raw", "language")
    if model is not None:
        parsed = parsed.unionByName(model.join(langs, "rel").filter(F.col("language").isin(*NODE_LANGUAGES)).select("rel", "raw", "language"))
    named = parsed.withColumn("d", dependency(F.col("raw"), F.col("language"))).select("rel", "language", "d.kind", "d.canonical").filter("canonical <> ''").distinct()
    roots = files.filter(F.lower("language") == "python").select(F.explode(import_roots(F.col("rel"))).alias("canonical")).distinct()
    own = graph.select(F.col("src").alias("rel"), F.explode(import_roots(F.col("dst"))).alias("canonical")).distinct().join(roots, "canonical", "left_semi")
    false = own.withColumn("language", F.lit("python"))
    return named.join(false, ["rel", "canonical", "language"], "left_anti").select("rel", "kind", "canonical")


def eligible_keys(linked: DataFrame, graph: DataFrame) -> DataFrame:
    """(rel, type, name): what a file's links allow in the catalog."""
    return linked.select("rel", F.col("kind").alias("type"), F.col("canonical").alias("name")).unionByName(graph.select(F.col("src").alias("rel"), F.lit("internal").alias("type"), F.col("dst").alias("name"))).distinct()


def specificity(text: Column) -> Column:
    hits = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in SPECIFIC), F.lit(0))
    return F.struct(hits.alias("hits"), F.length(text).alias("chars"))


def catalog(keys: DataFrame, texts: DataFrame, order: DataFrame) -> DataFrame:
    """(type, name, used_for, files, file_count): dependencies that a text is known for.

    ``keys`` (rel, type, name), ``texts`` (rel, type, name, seq, origin, used_for) with origin update or note,
    ``order`` (rel, ord). Only texts of allowed keys count. An update replaces a less specific text, a note only
    fills a gap. A file of an external or sdk dependency counts from the first file with a text on; files with
    their own text always do; an internal one counts only with an update.
    """
    said = texts.filter(F.nullif(F.trim("used_for"), F.lit("")).isNotNull()).filter("type <> 'internal' OR origin = 'update'")
    said = said.join(keys, ["rel", "type", "name"], "left_semi").join(order, "rel")
    place = F.struct("ord", F.when(F.col("origin") == "update", 0).otherwise(1).alias("late"), "seq")
    per = said.groupBy("type", "name").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "origin", "used_for"))).alias("xs"), F.min("ord").alias("since"))
    start = F.lit("")

    def step(best, x):
        better = (best == "") | ((x["origin"] == "update") & (specificity(x["used_for"]) > specificity(best)))
        return F.when(better, x["used_for"]).otherwise(best)

    best = per.select("type", "name", "since", F.aggregate("xs", start, step).alias("used_for"))
    backing = keys.join(order, "rel").join(best.select("type", "name", "since"), ["type", "name"])
    own = said.select("rel", "type", "name").distinct().withColumn("own", F.lit(True))
    backing = backing.join(own, ["rel", "type", "name"], "left").filter("own OR (type <> 'internal' AND ord >= since)")
    files = backing.groupBy("type", "name").agg(F.array_sort(F.collect_set("rel")).alias("files"))
    return best.join(files, ["type", "name"]).select("type", "name", "used_for", "files", F.size("files").cast("bigint").alias("file_count"))


def file_order(ranked: DataFrame, fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """Records of the selected files (rel, rank): a new one over a prior one, files with neither left out, by rank, then path."""
    both = fresh.select("rel", F.col("record").alias("new")).join(prior.select("rel", F.col("record").alias("old")), "rel", "full")
    return ranked.select("rel", "rank").join(both, "rel").select("rel", "rank", F.coalesce("new", "old").alias("record")).orderBy(F.col("rank").asc_nulls_last(), "rel")


def run_figures(planned: DataFrame) -> DataFrame:
    """One row: documented, unchanged, identical, skipped, selected."""
    of = lambda r: F.count_if(F.col("route") == r)
    return planned.agg(of("agent").alias("documented"), of("unchanged").alias("unchanged"), of("identical").alias("identical"), of("skip").alias("skipped"), F.count(F.lit(1)).alias("selected"))


def file_markdown(files: DataFrame) -> DataFrame:
    """(rel, markdown): the section of each file; empty fields have no line."""
    part = lambda title, value: F.when(F.nullif(value, F.lit("")).isNotNull(), F.concat(F.lit(f"**{title}:** "), value))
    names = part("Key concepts", F.array_join("key_concepts", ", "))
    return files.select("rel", F.concat_ws("\n\n", F.concat(F.lit("### `"), F.col("rel"), F.lit("`")), part("Language", F.col("language")), part("Description", F.col("description")), names).alias("markdown"))


def embedded(view: Column) -> Column:
    """A view inside a Markdown comment, and back: lossless, whatever the text holds."""
    return F.concat(F.lit("<!-- view:"), F.base64(F.encode(view, "utf-8")), F.lit(" -->"))


def from_embedded(markdown: Column) -> Column:
    coded = F.regexp_extract(markdown, r"<!-- view:([A-Za-z0-9+/=\s]*) -->", 1)
    return F.when(coded != "", F.decode(F.unbase64(F.regexp_replace(coded, r"\s", "")), "utf-8"))
