"""What can be kept and what must be done again: identities, the reuse predicate, routes, caps, the call manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import graph as gr
from millrace.operators.ranking import numbered
from millrace.session import pinned

# The keys of a record's identity and what an absent key stands for (null: absent equals absent only).
IDENTITY = {
    "analysis_revision": None, "analysis_mode": None, "max_context_revision": None, "prompt_profile_digest": "none",
    "large_file_identity": None, "split_reuse_contract": None, "ordinary_path_identity": None,
}


@dataclass(frozen=True)
class Run:
    """Settings of a run that decide on reuse and cost."""

    revision: str = "r1"
    mode: str = "single"
    most_chars: int = 12_000
    head_share: float = 0.7
    profile: str = "none"
    propagate: bool = True
    max_files: int = 0
    max_calls: int = 0
    split: bool = False
    forced: tuple[str, ...] = field(default=())

    @property
    def calls_per_file(self) -> int:
        return 3 if self.mode == "triple" else 1


def context_revision(chars: Column, run: Run) -> Column:
    """Names ceiling and head share where a text exceeds the ceiling, else null; the length itself does not matter."""
    shown = f"{run.head_share:.4f}"
    name = f"truncate-v1:max={run.most_chars}:head={shown}" + ("" if float(shown) == run.head_share else f":exact={run.head_share!r}")
    return F.when(chars > run.most_chars, F.lit(name))


def path_identity(rel: Column) -> Column:
    return F.concat(F.lit("path_"), F.sha2(rel, 256))


def expected(files: DataFrame, run: Run) -> DataFrame:
    """Files (rel, language, content) with what a fresh record would carry: hash, chars and every key of IDENTITY."""
    chars = F.length("content")
    split = (chars > run.most_chars) & F.lit(run.split)
    large = F.when(split, tx.domain_id("large", F.lit(run.revision), F.lit(run.most_chars)))
    return files.withColumns({
        "hash": F.sha2("content", 256),
        "chars": chars.cast("bigint"),
        "insufficient": tx.insufficient(F.col("content")),
        "analysis_revision": F.lit(run.revision),
        "analysis_mode": F.lit(run.mode),
        "max_context_revision": F.when(~split, context_revision(chars, run)),
        "prompt_profile_digest": F.lit(run.profile),
        "large_file_identity": large,
        "split_reuse_contract": F.when(split, F.lit("split-v1")),
        "ordinary_path_identity": F.when(~split, path_identity(F.col("rel"))),
    })


def reusable(a: str = "e", b: str = "p") -> Column:
    """Same hash, language and path, and every key of the identity, absent ones as their default."""
    same = (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & (F.col(f"{a}.language") == F.col(f"{b}.language")) & (F.col(f"{a}.rel") == F.col(f"{b}.path"))
    for key, absent in IDENTITY.items():
        left, right = F.col(f"{a}.{key}"), F.col(f"{b}.{key}")
        if absent is not None:
            left, right = F.coalesce(left, F.lit(absent)), F.coalesce(right, F.lit(absent))
        same = same & left.eqNullSafe(right)
    return F.coalesce(same, F.lit(False))


def marked(files: DataFrame, prior: DataFrame, run: Run) -> DataFrame:
    """``expected`` columns and ``reuse``: whether the prior record of the same path may be kept."""
    known = prior.select(F.col("path"), "hash", "language", *IDENTITY)
    joined = expected(files, run).alias("e").join(known.alias("p"), F.col("e.rel") == F.col("p.path"), "left")
    return joined.select("e.*", reusable().alias("reuse"))


def plan(files: DataFrame, prior: DataFrame, run: Run, graph: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """One row a selected file, with ``changed``, ``process`` and ``route`` (skip, agent, identical, unchanged).

    Changed is what cannot be reused, is forced or has no source. With propagation, all that depends on a
    changed file is processed too. An empty source is skipped; a forced or divided file always goes to an
    agent; a processed file whose own record still holds is identical; the rest of the processed need an agent.
    """
    base = marked(files, prior, run)
    if selected is not None:
        base = base.join(selected.select("rel").distinct(), "rel", "left_semi")
    forced = F.col("rel").isin(*run.forced) if run.forced else F.lit(False)
    divided = F.col("large_file_identity").isNotNull()
    base = base.withColumns({"forced": forced, "changed": ~F.col("reuse") | forced | F.col("insufficient")})
    if run.propagate and graph is not None:
        hit = gr.affected(graph, base.filter("changed").select(F.col("rel").alias("node"))).select(F.col("node").alias("rel"), F.lit(True).alias("_hit"))
        base = base.join(hit, "rel", "left").withColumn("process", F.coalesce("_hit", F.lit(False))).drop("_hit")
    else:
        base = base.withColumn("process", F.col("changed"))
    route = (
        F.when(~F.col("process"), "unchanged")
        .when(F.col("insufficient"), "skip")
        .when(forced, "agent")
        .when(divided & ~F.col("reuse"), "agent")
        .when(F.col("reuse"), "identical")
        .otherwise("agent")
    )
    return base.withColumn("route", route)


def steady(read: Callable[[], DataFrame], tries: int = 2) -> DataFrame:
    """Files (rel, content, ...) of ``read``, pinned, and still the same when read again: a plan is made over one state of the source.

    Where a file changed, came or went in between, it is read anew, ``tries`` times in all; then it is an error.
    """
    seen = lambda df: df.select("rel", F.sha2("content", 256).alias("hash"))
    for _ in range(tries):
        files = pinned(read())
        now, then = seen(read()), seen(files)
        if not then.exceptAll(now).unionByName(now.exceptAll(then)).limit(1).count():
            return files
    raise RuntimeError("the source changes while it is read")


def route_summary(planned: DataFrame, run: Run) -> DataFrame:
    """(route, files, chars, tokens, calls) of a plan."""
    sent = F.least(F.col("chars"), F.lit(run.most_chars))
    paid = F.col("route") == "agent"
    return planned.groupBy("route").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("chars").alias("chars"),
        F.sum(F.when(paid, tx.tokens(sent)).otherwise(0)).cast("bigint").alias("tokens"),
        F.sum(F.when(paid, run.calls_per_file).otherwise(0)).cast("bigint").alias("calls"),
    )


def caps(planned: DataFrame, run: Run) -> DataFrame:
    """(candidates, calls, files_exceeded, calls_exceeded): a cap of 0 is none."""
    paid = F.count_if(F.col("route") == "agent")
    return planned.agg(paid.alias("candidates"), (paid * run.calls_per_file).alias("calls")).select(
        "candidates", "calls", ((F.lit(run.max_files) > 0) & (F.col("candidates") > run.max_files)).alias("files_exceeded"), ((F.lit(run.max_calls) > 0) & (F.col("calls") > run.max_calls)).alias("calls_exceeded")
    )


def partition_holds(planned: DataFrame) -> DataFrame:
    """(selected, routed, holds): every selected file has exactly one of the known routes."""
    known = F.col("route").isin("unchanged", "identical", "agent", "skip")
    return planned.agg(F.count(F.lit(1)).alias("selected"), F.count_if(known).alias("routed"), F.countDistinct("rel").alias("distinct_files")).select(
        "selected", "routed", ((F.col("selected") == F.col("routed")) & (F.col("selected") == F.col("distinct_files"))).alias("holds")
    )


def run_partition(planned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(selected, unchanged, identical, documented, failed, unattempted, skipped, holds): every selected file ends in exactly one way.

    ``outcomes`` is (rel, ok) of the files whose calls were made; an agent's file without one is unattempted.
    """
    ends = planned.select("rel", "route").join(outcomes.groupBy("rel").agg(F.bool_and("ok").alias("ok")), "rel", "left")
    agent, route = F.col("route") == "agent", lambda r: F.count_if(F.col("route") == r)
    counted = ends.agg(
        F.count(F.lit(1)).alias("selected"), route("unchanged").alias("unchanged"), route("identical").alias("identical"), F.count_if(agent & F.col("ok")).alias("documented"), F.count_if(agent & ~F.col("ok")).alias("failed"),
        F.count_if(agent & F.col("ok").isNull()).alias("unattempted"), route("skip").alias("skipped"), F.countDistinct("rel").alias("_files"),
    )
    total = sum((F.col(c) for c in ("unchanged", "identical", "documented", "failed", "unattempted", "skipped")), F.lit(0))
    return counted.withColumn("holds", (F.col("selected") == total) & (F.col("selected") == F.col("_files"))).drop("_files")


def route_view(planned: DataFrame, run: Run, blocked: DataFrame | None = None) -> DataFrame:
    """(rel, chars, route, payable) of every file above the ceiling: blocked (with a reason), split or truncate."""
    large = planned.filter(F.col("chars") > run.most_chars)
    reasons = blocked.select("rel", "reason") if blocked is not None else large.select("rel", F.lit(None).cast("string").alias("reason")).limit(0)
    how = F.when(F.col("reason").isNotNull(), "blocked").when(F.lit(run.split), "split").otherwise("truncate")
    return large.join(reasons, "rel", "left").select("rel", "chars", how.alias("view"), ((F.col("route") == "agent") & F.col("reason").isNull()).alias("payable"))


def hash_candidates(files: DataFrame, prior: DataFrame) -> DataFrame:
    """(rel, hash, candidate): first of the prior records (path, hash, ord) with the same content, by their order.

    Where both sides have the keys of the identity and a language, a record counts only if it could be reused but for its path
    and what follows from the path.
    """
    keys = [k for k in ("language", *IDENTITY) if k != "ordinary_path_identity" and k in files.columns and k in prior.columns]
    f, p = files.select("rel", "hash", *keys).alias("f"), prior.select("hash", "path", "ord", *keys).alias("p")
    same = F.col("f.hash") == F.col("p.hash")
    for k in keys:
        absent = F.lit(IDENTITY.get(k))
        same = same & F.coalesce(F.col(f"f.{k}"), absent).eqNullSafe(F.coalesce(F.col(f"p.{k}"), absent))
    return f.join(p, same).groupBy("f.rel", "f.hash").agg(F.min_by("p.path", F.struct("p.ord", "p.path")).alias("candidate"))


def carried(recovered: DataFrame, planned: DataFrame) -> DataFrame:
    """Recovered containers (rel, ...) that the plan does not supersede: neither unchanged nor identical nor in work."""
    used = planned.filter(F.col("route").isin("unchanged", "identical", "agent")).select("rel")
    return recovered.join(used, "rel", "left_anti")


def forced_paths(given: Column) -> Column:
    """Project-relative path of a forced file, null if it leads outside or is absolute."""
    turned = F.replace(F.trim(given), F.lit("\\"), F.lit("/"))
    outside = F.startswith(turned, F.lit("/")) | F.rlike(turned, F.lit("^[A-Za-z]:"))
    depth = F.aggregate(
        F.filter(F.split(turned, "/"), lambda p: (p != "") & (p != ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")),
    )["least"]
    return F.when(~outside & (depth >= 0), F.nullif(tx.posix(turned), F.lit("")))


def manifest(planned: DataFrame, run: Run, chunks: DataFrame | None = None) -> DataFrame:
    """Ordered calls (seq, call_id, category, rel, ordinal): one phase after the other, within a phase by path and ordinal.

    Files that are sent whole cost one call, or three in triple mode; divided files a call a leaf, a call a
    reduction and one synthesis. ``chunks`` is (rel, leaves, reductions).
    """
    paid = planned.filter(F.col("route") == "agent").select("rel")
    whole = paid if chunks is None else paid.join(chunks.select("rel"), "rel", "left_anti")
    calls = whole.select("rel", F.lit(0).alias("phase"), F.lit("file").alias("category"), F.explode(F.sequence(F.lit(1), F.lit(run.calls_per_file))).alias("ordinal"))
    if chunks is not None:
        divided = paid.join(chunks, "rel")
        some = lambda c: F.explode(F.when(F.col(c) > 0, F.sequence(F.lit(1), F.col(c).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("ordinal")
        calls = (
            calls.unionByName(divided.select("rel", F.lit(1).alias("phase"), F.lit("leaf").alias("category"), some("leaves")))
            .unionByName(divided.select("rel", F.lit(2).alias("phase"), F.lit("reduction").alias("category"), some("reductions")))
            .unionByName(divided.select("rel", F.lit(3).alias("phase"), F.lit("synthesis").alias("category"), F.lit(1).alias("ordinal")))
        )
    calls = calls.withColumn("call_id", tx.domain_id("call", F.col("category"), F.col("rel"), F.col("ordinal")))
    return numbered(calls, "phase", "rel", "ordinal", name="seq").drop("phase")


def unattempted(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """Planned calls of which no attempt (call_id) is known."""
    return calls.join(attempts.select("call_id").distinct(), "call_id", "left_anti")


def reconciled(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """(planned, attempted, additional, unattempted): attempts beyond one a planned call are additional."""
    tried = attempts.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))
    both = calls.select("call_id", F.lit(1).alias("p")).join(tried, "call_id", "full")
    return both.agg(
        F.count("p").alias("planned"),
        F.count_if(F.col("p").isNotNull() & F.col("n").isNotNull()).alias("attempted"),
        F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n")).otherwise(F.coalesce(F.col("n"), F.lit(1)) - 1)), F.lit(0)).cast("bigint").alias("additional"),
        F.count_if(F.col("n").isNull()).alias("unattempted"),
    )


def scope_counts(selection: DataFrame, planned: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(scanned, reachable, disconnected, documented, excluded, paid_disconnected, calls_disconnected): of planned ``calls`` (rel) if given."""
    joined = selection.join(planned.select("rel", "route"), "rel", "left")
    if calls is None:
        joined = joined.withColumn("_calls", F.lit(0))
    else:
        joined = joined.join(calls.groupBy("rel").agg(F.count(F.lit(1)).alias("_calls")), "rel", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if("reachable").alias("reachable"),
        F.count_if(~F.col("reachable")).alias("disconnected"),
        F.count_if("documented").alias("documented"),
        F.count_if(~F.col("documented")).alias("excluded"),
        F.count_if(~F.col("reachable") & (F.col("route") == "agent")).alias("paid_disconnected"),
        F.coalesce(F.sum(F.when(~F.col("reachable"), F.col("_calls"))), F.lit(0)).cast("bigint").alias("calls_disconnected"),
    )
