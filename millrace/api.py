"""A run from a folder of sources to a document: plan what is new, answer for it, keep the rest, write the view."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import imports as im
from millrace.operators import cleaning, enrich, graph, planning, project, view
from millrace.session import local_session, pinned
from millrace.sources import files as sources
from millrace.sources import records


@dataclass(frozen=True)
class Config:
    """What a run reads and writes. ``formats`` are json and markdown, at ``out``.json and ``out``.md; the first is read back."""

    root: str
    out: str
    entry: str | None = None
    scope: str = "entry"
    formats: tuple[str, ...] = ("json",)
    ignored: tuple[str, ...] = ()
    run: planning.Run = planning.Run()

    def path(self, kind: str) -> str:
        return f"{self.out}.{'json' if kind == 'json' else 'md'}"


@dataclass
class Result:
    plan: DataFrame
    files: DataFrame
    figures: dict[str, object]


def _imports(files: DataFrame) -> DataFrame:
    found = files.select("rel", F.posexplode(F.coalesce(im.imports(F.col("content"), F.col("language")), F.array().cast("array<string>"))).alias("ord", "raw"))
    return pinned(found)


def prior(spark: SparkSession, config: Config) -> DataFrame:
    """Public files of the last document in the first format, else in the other; none on a first run."""
    found = records.read_either(spark, config.path("json"), config.path("markdown"), config.formats[0])
    if found is None:
        kinds = {**project.FILE_FIELDS, **dict.fromkeys(planning.IDENTITY, "string")}
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return pinned(found)


def analyze(spark: SparkSession, config: Config, complete: enrich.Complete = enrich.echo, dry: bool = False) -> Result:
    """Plans a run over the folder and, unless ``dry``, answers for what has to be done and writes the document.

    A file whose record still holds keeps it and costs no call; an empty one is left out. A call that gives no
    answer after its correction leaves its file failed, without a record, so that the next run asks again.
    """
    files = planning.steady(lambda: sources.read_files(spark, config.root, ignored=config.ignored))
    old = prior(spark, config)
    resolved = pinned(graph.resolve(_imports(files), files))
    edges = pinned(graph.edges(resolved))
    entry = config.entry or sources.entry(files)
    selection = pinned(graph.select_files(edges, files, entry, explicit=config.entry is not None, scope=config.scope))
    planned = pinned(planning.plan(files, old, config.run, edges, selection.filter("documented")))
    counts = {r["route"]: r["n"] for r in planned.groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}
    figures = {
        "entry_file": entry, "entry_source": "explicit" if config.entry else "auto", "documentation_scope": config.scope, "analysis_mode": config.run.mode, "files_scanned": files.count(), "files_selected": planned.count(),
        "files_reused_unchanged": counts.get("unchanged", 0), "files_reused_identical_content": counts.get("identical", 0), "files_skipped_insufficient_source": counts.get("skip", 0),
    }
    if dry:
        return Result(planned, old.limit(0), {**figures, "files_unattempted": counts.get("agent", 0)})
    asked = planned.filter("route = 'agent'").withColumn("prompt", enrich.prompt(F.col("rel"), F.col("language"), F.col("content"), config.run.most_chars)).select("rel", "prompt")
    said = cleaning.contracts(enrich.corrected(asked, complete), "combined", raw="body").select("rel", "contract.*").filter("body IS NOT NULL")
    kinds = {n: k for n, k in project.FILE_FIELDS.items() if n not in ("hash", "path", "language", "imports", "reachable_from_entry", "links")}
    answered = pinned(said.withColumn("r", F.from_json("body", ", ".join(f"{n} {k}" for n, k in kinds.items()))).select("rel", "r.*"))
    figures |= {"files_documented_by_llm": answered.count(), "files_failed": counts.get("agent", 0) - answered.count()}
    fresh = planned.filter("route = 'agent'").join(answered, "rel").select(F.col("rel").alias("path"), "hash", "language", *planning.IDENTITY, *kinds)
    kept = old.join(planned.filter("route IN ('unchanged', 'identical')").select(F.col("rel").alias("path")), "path", "left_semi").select(*fresh.columns)
    whole = pinned(_linked(fresh.unionByName(kept), resolved, edges, files, selection))
    parts = project.View(whole, _folders(files, whole), None, edges.select(F.col("src").alias("from"), F.col("dst").alias("to")), figures)
    for kind in config.formats:
        project.write(project.json_blocks(parts) if kind == "json" else project.markdown_blocks(parts), config.path(kind))
    return Result(planned, parts.files, figures)


def _linked(rows: DataFrame, resolved: DataFrame, edges: DataFrame, files: DataFrame, selection: DataFrame) -> DataFrame:
    """Records with their imports, links and reachability of this run."""
    named = view.links(graph.unresolved(resolved).filter("raw <> ''"), files, edges)
    kind = lambda k, name: named.filter(F.col("kind") == k).groupBy(F.col("rel").alias("path")).agg(F.array_sort(F.collect_set("canonical")).alias(name))
    raws = resolved.groupBy(F.col("rel").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"]).alias("imports"))
    index = graph.edge_indexes(edges).select(F.col("node").alias("path"), F.col("dependencies").alias("internal_dependencies"), F.col("dependents").alias("imported_by"))
    out = rows.join(raws, "path", "left").join(index, "path", "left").join(kind("external", "external_dependencies"), "path", "left").join(kind("sdk", "sdk_dependencies"), "path", "left")
    out = out.join(selection.select(F.col("rel").alias("path"), F.col("reachable").alias("reachable_from_entry")), "path", "left")
    names = [name for _, name in project.LINKS]
    none = F.array().cast("array<string>")
    return out.withColumn("links", F.struct(*[F.coalesce(n, none).alias(n) for n in names])).drop(*names)


def _folders(files: DataFrame, whole: DataFrame) -> DataFrame:
    own = files.join(whole.select(F.col("path").alias("rel")), "rel", "left_semi")
    words = whole.select(view.tx.top_folder(F.col("path")).alias("folder"), "path", F.posexplode(F.coalesce("key_concepts", F.array().cast("array<string>"))).alias("pos", "concept"))
    top = view.top_concepts(words.select("folder", F.struct("path", "pos").alias("ord"), "concept")).groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x["concept"]).alias("concepts"))
    rolled = view.folder_rollup(own).join(top, "folder", "left")
    concepts = F.coalesce("concepts", F.array().cast("array<string>"))
    return rolled.select(F.col("folder").alias("path"), view.folder_summary(F.col("folder"), F.col("file_count"), F.col("languages"), concepts).alias("summary"), "file_count", "languages", "files")


def main(arguments: list[str] | None = None) -> int:
    """python -m millrace ROOT OUT: documents a folder with the local stand-in, or with --dry only says what would be done."""
    ask = argparse.ArgumentParser(prog="millrace")
    ask.add_argument("root")
    ask.add_argument("out")
    ask.add_argument("--entry")
    ask.add_argument("--scope", choices=("entry", "all"), default="entry")
    ask.add_argument("--format", choices=("json", "markdown", "both"), default="json")
    ask.add_argument("--mode", choices=("single", "triple"), default="single")
    ask.add_argument("--dry", action="store_true")
    given = ask.parse_args(arguments)
    formats = ("json", "markdown") if given.format == "both" else (given.format,)
    config = Config(given.root, given.out, given.entry, given.scope, formats, run=replace(planning.Run(), mode=given.mode))
    for name, value in analyze(local_session(), config, dry=given.dry).figures.items():
        print(f"{name}: {value}")
    return 0
