"""Dependency graphs: import resolution, closures, dependency-first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import extension, parent, posix
from millrace.operators.ranking import numbered
from millrace.session import pinned

# Extensions that a project path may end in, tried in sorted order for an import without one.
EXTENSIONS = (".c", ".cpp", ".cs", ".dart", ".go", ".h", ".hpp", ".htm", ".html", ".java", ".js", ".jsx", ".kt", ".py", ".rb", ".rs", ".swift", ".ts", ".tsx")


SMALL_LEVEL = 50_000  # nodes of a level that one task may number; larger levels are numbered by ranges


def _suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^./][^/]*?(\.[^./]+)$", 1)


def candidates(raw: Column, current: Column) -> Column:
    """Paths that an import in a file may mean, before extensions are tried, in order."""
    folder = parent(posix(current))
    beside = lambda p: posix(F.concat(folder, F.lit("/"), p))
    starts = lambda s: F.startswith(raw, F.lit(s))
    level = F.length(raw) - F.length(F.ltrim(raw, F.lit(".")))
    module = F.replace(F.substr(raw, level + 1), F.lit("."), F.lit("/"))
    base = F.aggregate(F.sequence(F.lit(1), F.greatest(level, F.lit(1))), folder, lambda p, i: F.when(i == 1, p).otherwise(parent(p)))
    dotted = F.replace(raw, F.lit("."), F.lit("/"))
    package = F.when(F.contains(raw, F.lit("/")), F.array(posix(F.concat(F.lit("lib/"), F.regexp_extract(raw, r"^[^/]*/(.*)$", 1))))).otherwise(F.array().cast("array<string>"))
    slashed = F.contains(raw, F.lit("/")) | F.contains(raw, F.lit("\\"))
    found = (
        F.when(starts("package:"), package)
        .when(starts("./") | starts("../"), F.array(beside(raw)))
        .when(starts("."), F.array(posix(F.concat(base, F.lit("/"), module))))
        .when(_suffix(raw).isin(*EXTENSIONS) | slashed, F.array(posix(raw), beside(raw)))
        .when(F.contains(raw, F.lit(".")), F.array(posix(dotted), beside(dotted)))
        .otherwise(F.array(posix(raw), beside(raw)))
    )
    return F.filter(F.array_distinct(found), lambda c: c != "")


def variants(candidate: Column) -> Column:
    """A candidate as it is, and if it has no suffix with every extension, as a folder's index, as a package."""
    more = [F.concat(candidate, F.lit(e)) for e in EXTENSIONS] + [F.concat(candidate, F.lit(f"/index{e}")) for e in EXTENSIONS] + [F.concat(candidate, F.lit("/__init__.py"))]
    return F.when(_suffix(candidate) == "", F.array(candidate, *more)).otherwise(F.array(candidate))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, ord, raw, target): the first variant that is a file, case and all; null where none is.

    ``imports`` is (rel, ord, raw), ``files`` has rel. An equi-join on the candidate path, so neither
    side needs to be small; the first hit is a pre-aggregated minimum.
    """
    raw = F.trim("raw")
    tried = imports.withColumn("_try", F.when(raw != "", candidates(raw, F.col("rel"))))
    # candidates and variants are exploded one after the other: as one expression they outgrow a compiled method
    tried = tried.select("rel", "ord", "raw", F.posexplode("_try").alias("_nth", "_base")).select("rel", "ord", "raw", "_nth", F.posexplode(variants(F.col("_base"))).alias("_at", "_path"))
    tried = tried.withColumn("_at", F.struct("_nth", "_at"))
    hits = tried.join(files.select(F.col("rel").alias("_path")).distinct(), "_path").groupBy("rel", "ord").agg(F.min_by("_path", "_at").alias("target"))
    return imports.join(hits, ["rel", "ord"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target IS NOT NULL").select(F.col("rel").alias("src"), F.col("target").alias("dst")).distinct()


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target IS NULL").select("rel", "ord", "raw")


def reverse(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(graph: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, depth): the seeds and all that edges lead to from them. ``seeds`` is (node).

    A frontier is joined with the edges and loses what was seen, round by round; the edges are computed once and every
    round is checkpointed, so plans stay flat and a lost executor costs one round.
    """
    frontier = pinned(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    graph = pinned(graph.select("src", "dst").filter("src <> dst"))
    while (size := frontier.count()) and (most_rounds is None or depth < most_rounds):
        depth += 1
        front = F.broadcast(frontier) if size <= SMALL_LEVEL else frontier
        new = graph.join(front, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = pinned(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = pinned(seen)
    return seen


def reachable(graph: DataFrame, files: DataFrame, entry: str) -> DataFrame:
    """What the entry depends on, itself included; nothing if the entry is no file."""
    return closure(graph, files.filter(F.col("rel") == entry).select(F.col("rel").alias("node")))


def affected(graph: DataFrame, changed: DataFrame) -> DataFrame:
    """What depends on the changed nodes, these included, also those that the graph does not have."""
    return closure(reverse(graph), changed)


def select_files(graph: DataFrame, files: DataFrame, entry: str | None, explicit: bool = False, scope: str = "entry") -> DataFrame:
    """(rel, reachable, documented). What is left out is ``excluded_sample``'s to show. An unknown entry means every file, unless it was asked for: then it is an error."""
    if scope not in ("entry", "all"):
        raise ValueError("scope is 'entry' or 'all'")
    known = entry is not None and files.filter(F.col("rel") == entry).limit(1).count() > 0
    if not known:
        if explicit and entry is not None:
            raise ValueError(f"entry {entry!r} is not among the files")
        return files.select("rel", F.lit(True).alias("reachable"), F.lit(True).alias("documented"))
    reached = reachable(graph, files, entry).select(F.col("node").alias("rel"), F.lit(True).alias("_in"))
    marked = files.select("rel").join(reached, "rel", "left").withColumn("reachable", F.coalesce("_in", F.lit(False)))
    return marked.select("rel", "reachable", (F.col("reachable") | F.lit(scope == "all")).alias("documented"))


def excluded_sample(selection: DataFrame, most: int = 10) -> DataFrame:
    """(rel, excluded): the first ``most`` paths that are not documented, and how many there are."""
    out = selection.filter("NOT documented").select("rel")
    return out.orderBy("rel").limit(most).crossJoin(out.agg(F.count(F.lit(1)).alias("excluded")))


def topological(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level, rank): dependencies first; what lies on a cycle or behind one comes last, by path, with a null level.

    Levels are peeled: a node is due when all it depends on has been. Within a level nodes go by the rank of
    their last dependency, then by path, which is the order of a queue.
    """
    graph = pinned(graph.select("src", "dst").distinct())
    needed = pinned(graph.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("needed")))
    every = pinned(nodes.select("node").unionByName(graph.select(F.col("src").alias("node"))).unionByName(graph.select(F.col("dst").alias("node"))).distinct())
    due = pinned(every.join(needed, "node", "left_anti").withColumn("last", F.lit(-1).cast("bigint")))
    done, level, start, begun = None, 0, 0, None
    while size := due.count():
        if size <= SMALL_LEVEL:
            place = F.row_number().over(Window.orderBy("last", "node")) - 1 + start
            found = due.withColumn("rank", place.cast("bigint"))
        else:
            found = numbered(due, "last", "node", start=start)
        found = found.select("node", F.lit(level).alias("level"), "rank")
        done = found if done is None else done.unionByName(found)
        if level % 16 == 15:
            done = pinned(done)
        level, start = level + 1, start + size
        # a round reads the edges into this level, and writes the nodes of which some dependencies are done
        reached = found.select(F.col("node").alias("dst"), "rank")
        reached = F.broadcast(reached) if size <= SMALL_LEVEL else reached
        hit = graph.join(reached, "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("done"), F.max("rank").alias("last"))
        if begun is not None:
            hit = hit.unionByName(begun).groupBy("node").agg(F.sum("done").alias("done"), F.max("last").alias("last"))
        state = pinned(hit.join(needed, "node").select("node", "done", "last", (F.col("done") == F.col("needed")).alias("due")))
        due, begun = state.filter("due").select("node", "last"), state.filter("NOT due").select("node", "done", "last")
    left = every if done is None else every.join(done, "node", "left_anti")
    rest = numbered(left.withColumn("level", F.lit(None).cast("int")), "node", start=start)
    return rest if done is None else done.unionByName(rest)


def summary(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    every = nodes.select("node").unionByName(graph.select(F.col("src").alias("node"))).unionByName(graph.select(F.col("dst").alias("node"))).distinct()
    return every.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(graph.distinct().agg(F.count(F.lit(1)).alias("edges")))


def edge_indexes(graph: DataFrame) -> DataFrame:
    """(node, dependencies, dependents): sorted, without repeats; a node of no edge is not there."""
    named = graph.filter("src <> '' AND dst <> ''").distinct()
    forward = named.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))
    back = named.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
    none = F.array().cast("array<string>")
    return forward.join(back, "node", "full").select("node", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))


def closed_subset(nodes: DataFrame) -> DataFrame:
    """Nodes (rel, node_id, child_ids, valid) kept only if valid and all their children are, down to the leaves.

    The nodes are computed once; every round of the closure reads them again.
    """
    nodes = pinned(nodes)
    links = nodes.select("rel", "node_id", F.explode("child_ids").alias("child"))
    missing = links.join(nodes.select("rel", F.col("node_id").alias("child")), ["rel", "child"], "left_anti").select("rel", "node_id")
    bad = nodes.filter(~F.coalesce("valid", F.lit(False))).select("rel", "node_id").unionByName(missing)
    key = lambda a, b: F.struct(F.col(a).alias("r"), F.col(b).alias("n"))
    gone = closure(links.select(key("rel", "child").alias("src"), key("rel", "node_id").alias("dst")), bad.select(key("rel", "node_id").alias("node")))
    return nodes.withColumn("_key", key("rel", "node_id")).join(gone.select(F.col("node").alias("_key")), "_key", "left_anti").drop("_key")


def path_tree(files: DataFrame) -> DataFrame:
    """(path, depth, is_file): every folder and file of the tree that the paths make."""
    parts = F.split("rel", "/")
    steps = files.select("rel", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    return steps.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"), "depth", (F.col("depth") == F.size("parts")).alias("is_file")).distinct()


def language_of(path: Column, languages: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.try_element_at(table, extension(path))
