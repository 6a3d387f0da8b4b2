"""Counts, bounded reports, digests, quotas, and the order of events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("unchecked", "in_progress", "checked", "failed", "skipped")


def status_counts(statuses: DataFrame, known: tuple[str, ...] = STATUSES) -> DataFrame:
    """(status, n) of every known status, 0 where none has it."""
    counted = statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = statuses.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in known])).alias("status"))
    return every.join(counted, "status", "left").fillna(0, ["n"])


def last_status(events: DataFrame) -> DataFrame:
    """(rel, status): that of the last event (rel, seq, status)."""
    return events.groupBy("rel").agg(F.max_by("status", "seq").alias("status"))


def failure_runs(events: DataFrame, most: int) -> DataFrame:
    """Events (queue, seq, outcome) with ``run``, the failures in a row up to here, and ``attempted``.

    Success or a skipped source starts again at 0; after the first run of ``most`` nothing is attempted.
    """
    order = Window.partitionBy("queue").orderBy("seq")
    island = F.sum(F.col("outcome").isin("success", "insufficient").cast("int")).over(order)
    runs = events.withColumn("_island", island).withColumn("_bad", (F.col("outcome") == "failure").cast("int"))
    runs = runs.withColumn("run", F.sum("_bad").over(Window.partitionBy("queue", "_island").orderBy("seq")).cast("bigint"))
    before = F.max((F.col("run") >= most).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("attempted", F.coalesce(before, F.lit(0)) == 0).drop("_island", "_bad")


def worst(rows: DataFrame, most: int, *rank: Column) -> DataFrame:
    """The ``most`` first rows by rank, each with how many there are, are kept and are left out."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(*rank).limit(most)
    return top.crossJoin(total).withColumns({"retained": F.least(F.col("total"), F.lit(most)), "omitted": F.greatest(F.col("total") - most, F.lit(0))})


def stream_digest(rows: DataFrame, item: Column, *order: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 of the JSON list of the digests of items in order, repeats included. One group's items meet in one row."""
    own = rows.select(*by, F.struct(*order).alias("o"), F.sha2(item, 256).alias("d"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: F.concat(F.lit('"'), x.d, F.lit('"')))
    return own.groupBy(*by).agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("digest"))


def quotas(groups: DataFrame, budget: int) -> DataFrame:
    """Groups (rank, cap) with ``quota``: one each a round, in rank order, until the budget or the caps are spent.

    Round r costs as many as have a cap of r or more, so the last whole round and the rest follow from counts of
    caps; nothing is laid out one by one.
    """
    caps = groups.groupBy("cap").agg(F.count(F.lit(1)).alias("n"), F.sum("cap").alias("all"))
    upto = Window.orderBy("cap").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("cap").rowsBetween(1, Window.unboundedFollowing)
    spent = caps.withColumn("spent", F.sum("all").over(upto) + F.col("cap") * F.coalesce(F.sum("n").over(after), F.lit(0)))
    spent = spent.withColumn("open", F.coalesce(F.sum("n").over(after), F.lit(0)))
    best = spent.filter(F.col("spent") <= budget).agg(F.max(F.struct("spent", "cap", "open")).alias("m")).select("m.*")
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("cap") > 0).alias("some"))
    base = total.crossJoin(best).select(
        F.coalesce("cap", F.lit(0)).alias("done"), F.coalesce("spent", F.lit(0)).alias("spent"), F.when(F.col("cap").isNull(), F.col("some")).otherwise(F.col("open")).alias("open")
    )
    left = F.lit(budget) - F.col("spent")
    level = base.select((F.col("done") + F.when(F.col("open") > 0, F.floor(left / F.col("open"))).otherwise(0)).cast("bigint").alias("whole"), F.when(F.col("open") > 0, left % F.col("open")).otherwise(0).cast("bigint").alias("rest"))
    joined = groups.crossJoin(F.broadcast(level))  # one row
    more = F.row_number().over(Window.partitionBy((F.col("cap") > F.col("whole"))).orderBy("rank"))
    extra = ((F.col("cap") > F.col("whole")) & (more <= F.col("rest"))).cast("bigint")
    return joined.withColumn("quota", (F.least(F.col("cap"), F.col("whole")) + extra).cast("bigint")).select(*groups.columns, "quota")


def severities(issues: DataFrame) -> DataFrame:
    """(level, n, messages): messages of errors only, in order."""
    error = F.when(F.col("level") == "error", F.struct("seq", "message"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(error)), lambda x: x.message), "\n")
    return issues.groupBy("level").agg(F.count(F.lit(1)).alias("n"), listed.alias("messages")).withColumn("messages", F.when(F.col("level") == "error", F.col("messages")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, some = hashlib.sha256(), False
    for batch in batches:
        for message in batch.column(1).to_pylist():
            if message is not None:
                digest.update(b"\n" * some + message.encode())
                some = True
    yield pa.RecordBatch.from_arrays([pa.array(["error"]), pa.array([digest.hexdigest()])], names=["level", "digest"])


def severity_digests(issues: DataFrame) -> DataFrame:
    """(level, n, digest): of errors, SHA-256 of the messages in order, a line each.

    SHA-256 goes through them one after the other, so one task reads them, sorted, a batch at a time.
    """
    errors = issues.filter("level = 'error'").select("seq", "message").repartition(1).sortWithinPartitions("seq", "message")
    counted = issues.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(errors.mapInArrow(_digest, "level string, digest string"), "level", "left")


def corrections(events: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("event") == kind).alias(kind)
    return events.agg(of("contract_failure"), of("attempt"), of("success"), of("failure"))


def division_figures(files: DataFrame) -> DataFrame:
    """(mode, files, units, chunks, blocked) with a row of totals: files (rel, mode, units, chunks, blocked)."""
    return files.cube("mode").agg(F.count(F.lit(1)).alias("files"), F.sum("units").alias("units"), F.sum("chunks").alias("chunks"), F.count("blocked").alias("blocked")).withColumn("mode", F.coalesce("mode", F.lit("all")))


def strongest_scope(scopes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(scope, files): the strongest scope of each file (rel, scope), counted."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("scope"))
    return scopes.groupBy("rel").agg(F.max_by("scope", rank).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("files"))
