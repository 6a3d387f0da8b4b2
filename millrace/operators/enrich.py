"""The place of the paid call: any function of a batch of prompts, run where the rows are."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.responses import json_candidate
from millrace.session import pinned

REPAIR = "\n\nAnswer with one JSON object. This was none:\n"

Complete = Callable[[list[str]], list[str]]


def echo(prompts: list[str]) -> list[str]:
    """A stand-in without a network: the same prompt always gets the same answer."""
    return [json.dumps({"description": f"{len(p)} characters, {hashlib.sha256(p.encode()).hexdigest()[:12]}", "role_in_system": "", "key_concepts": []}) for p in prompts]


def prompt(rel: Column, language: Column, content: Column, most: int) -> Column:
    return F.format_string("File: %s\nLanguage: %s\n\n%s", rel, language, tx.truncated(content, most))


def completed(rows: DataFrame, complete: Complete = echo, out: str = "answer") -> DataFrame:
    """Adds the answer to ``prompt``, a batch at a time; other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = complete(batch.column(batch.schema.get_field_index("prompt")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, type=pa.string())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{out}` string")


def corrected(rows: DataFrame, complete: Complete = echo, repair: Complete | None = None) -> DataFrame:
    """Answers with their outcome; those that are no object get one second try, with the first answer in the prompt.

    Both stages are pinned: every prompt is paid for once, also where an executor is lost or the result is read again.
    """
    first = pinned(completed(rows, complete)).withColumn("c", json_candidate(F.col("answer")))
    good = first.filter("c.outcome = 'object'").select(*rows.columns, F.col("c.body").alias("body"), F.lit(1).alias("attempts"))
    bad = first.filter("c.outcome <> 'object'").withColumn("prompt", F.concat(F.col("prompt"), F.lit(REPAIR), F.col("answer")))
    again = pinned(completed(bad.select(*rows.columns), repair or complete)).withColumn("c", json_candidate(F.col("answer")))
    return good.unionByName(again.select(*rows.columns, F.col("c.body").alias("body"), F.lit(2).alias("attempts")))


def reduced(chunks: DataFrame, complete: Complete = echo, width: int = 39, levels: int = 6) -> DataFrame:
    """(rel, body): answers over chunks (rel, ord, prompt), joined level by level, ``width`` neighbours at a time.

    A group of one goes up as it is and costs no call; levels end where every file has one answer left. Files that
    have more after the last level are an error. Each level is pinned, so no call is made twice.
    """
    now = pinned(completed(chunks.select("rel", F.col("ord").cast("int").alias("ord"), "prompt"), complete).select("rel", "ord", "answer"))
    for level in range(levels + 1):
        if not now.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
            return now.select("rel", F.col("answer").alias("body"))
        if level == levels:
            break
        members = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), "answer")))
        groups = now.groupBy("rel", F.floor(F.col("ord") / width).cast("int").alias("ord")).agg(members.alias("xs"))
        one = groups.filter("size(xs) = 1").select("rel", "ord", F.col("xs")[0]["answer"].alias("answer"))
        more = groups.filter("size(xs) > 1").select("rel", "ord", F.concat_ws("\n", F.transform("xs", lambda x: F.concat(F.lit("- "), x.answer))).alias("prompt"))
        now = pinned(one.unionByName(completed(more, complete).select("rel", "ord", "answer")))
    raise ValueError(f"more than one answer is left after {levels} levels of {width}")


def agents(files: DataFrame, mode: str = "single", most: int = 12_000, complete: Complete = echo) -> DataFrame:
    """(rel, agent, body): one call a file, or structure and dependency calls and a documentation call over both."""
    base = files.withColumn("prompt", prompt(F.col("rel"), F.col("language"), F.col("content"), most))
    if mode == "single":
        return pinned(completed(base.select("rel", "prompt"), complete).select("rel", F.lit("file").alias("agent"), F.col("answer").alias("body")))
    asked = base.select("rel", F.explode(F.array(F.lit("structure"), F.lit("dependency"))).alias("agent"), "prompt")
    parts = pinned(completed(asked.withColumn("prompt", F.concat("agent", F.lit("\n"), "prompt")), complete).select("rel", "agent", "answer"))
    known = parts.groupBy("rel").agg(F.array_join(F.array_sort(F.collect_list(F.concat("agent", F.lit(": "), "answer"))), "\n").alias("prompt"))
    docs = pinned(completed(known, complete).select("rel", F.lit("documentation").alias("agent"), F.col("answer").alias("body")))
    return parts.select("rel", "agent", F.col("answer").alias("body")).unionByName(docs)
