"""WARC archives: written through Spark's text sink, read back by boundary-chain verification.

A file is cut wherever the version line stands, also inside payloads. Every cut is a candidate record
with the offset of its successor, taken from its length. Tasks follow the successors within their block
of the file, pointers jump from block to block, and what the start of the file does not reach is payload.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.session import checkpoint_folder, pinned

MAGIC = "WARC/1.1\r\n"
_GAP = "\r\n\r\n"
LEAST_SHARED = 1_000  # bytes from which equal payloads are stored once
SMALL = 100_000  # shared payloads up to which their table is broadcast
_ID = "urn:x-page:"


def sha1(payload: Column) -> Column:
    return F.sha1(payload.cast("binary"))


def _header(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: a record a row of (page_id, url, html), without the blank lines that end it.

    Of equal payloads of LEAST_SHARED bytes or more, the largest page_id has the response, others refer to
    it without the payload. Rows of that same id are all responses; null ids come below all others; null
    html is an empty payload; line ends in a url become spaces.
    """
    html = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("n"), sha1(html).alias("digest"))
    shared = (
        sized.filter(F.col("n") >= LEAST_SHARED).groupBy("digest", "n").agg(F.count(F.lit(1)).alias("rows"), F.max("page_id").alias("keeper")).filter("rows > 1 AND keeper IS NOT NULL")
    )
    shared = pinned(shared.select(F.col("digest").alias("d"), F.col("n").alias("m"), "keeper"))
    if shared.count() <= SMALL:
        shared = F.broadcast(shared)
    joined = sized.join(shared, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left")
    revisit = F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), _header(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("keeper")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return joined.select(F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(_GAP), block).alias("value"))


def write_archives(pages: DataFrame, folder: str | None = None) -> str:
    """Writes a file a task, under Spark's commit protocol; gives the folder. Without one, a new one in the shared folder."""
    folder = folder or f"{checkpoint_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records(pages).write.option("lineSep", _GAP).text(folder)
    return folder


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the files between version lines: (file, block, nth, value). Splits of a file are read by many tasks."""
    read = spark.read.option("lineSep", MAGIC).text(folder)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")


def _parsed(chunks: DataFrame) -> DataFrame:
    """What each piece says of itself, if it is a record: its length, its header and the digest of its payload."""
    head = F.substring_index("value", _GAP, 1)
    field = lambda name, form: F.regexp_extract("head", rf"(?:^|\r\n){name}: {form}(?=\r\n|$)", 1)
    cut = chunks.withColumn("head", head).withColumns({
        "size": F.octet_length("value").cast("bigint"),
        "start": F.octet_length("head").cast("bigint") + len(_GAP),
        "length": F.try_to_number(F.nullif(field("Content-Length", r"(\d{1,18})"), F.lit("")), F.lit("999999999999999999")).cast("bigint"),
        "kind": field("WARC-Type", r"(\w+)"),
        "name": field("WARC-Record-ID", rf"<{_ID}(-?\d+|null)>"),
        "keeper": field("WARC-Refers-To", rf"<{_ID}(-?\d+|null)>"),
        "said": field("WARC-Payload-Digest", r"sha1:([0-9a-f]{40})"),
    })
    block = F.substr(F.col("value").cast("binary"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    whole = F.col("length").isNotNull() & (F.col("start") + F.col("length") + len(_GAP) == F.col("size"))
    cut = cut.withColumn("whole", whole).withColumn("bytes", F.when(F.col("whole"), block))
    return cut.withColumns(_payload(F.col("bytes")))


def _payload(block: Column) -> dict[str, Column]:
    """Of a block: the length that its HTTP header gives, the payload's own length, and its digest."""
    text = block.cast("string")
    at = F.octet_length(F.substring_index(text, _GAP, 1)) + len(_GAP)
    body = F.substr(block, at + 1, F.greatest(F.lit(0), F.octet_length(block) - at))
    return {
        "given": F.regexp_extract(F.substring_index(text, _GAP, 1), r"\r\nContent-Length: (\d{1,18})", 1),
        "bytes": F.octet_length(body).cast("bigint"),
        "digest": F.sha1(body),
    }


_CANDIDATE = "file string, block bigint, nth bigint, at bigint, next bigint"


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a block, the first offset outside the block's candidates that its chain comes to."""
    rows = rows.sort_values("at", ascending=False)
    known: dict[int, int] = {}
    ends = []
    for at, follow in zip(rows["at"].tolist(), rows["next"].tolist(), strict=True):
        end = known.get(follow, follow)
        known[at] = end
        ends.append(end)
    return pd.DataFrame({"file": rows["file"], "block": rows["block"], "at": rows["at"], "exit": ends})


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its reached ones lead to."""
    rows = rows.sort_values("at")
    due = set(rows["at"][rows["reached"]].tolist())
    kept = []
    for at, follow in zip(rows["at"].tolist(), rows["next"].tolist(), strict=True):
        kept.append(at in due)
        if kept[-1]:
            due.add(follow)
    return rows[kept][["file", "block", "nth", "at", "next"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, block, nth, at, next) that a chain from offset 0 of their file comes to.

    Chains are contracted inside blocks, each a bounded piece of a file; between blocks the set of reached
    entries grows with pointers that double their length each round, so rounds grow with the logarithm
    of the number of blocks in a file.
    """
    candidates = pinned(candidates)
    exits = pinned(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, block bigint, at bigint, exit bigint"))
    first = exits.filter("at = 0").select("file", "at").distinct()
    entries = exits.select("file", F.col("exit").alias("at")).distinct().unionByName(first).distinct()
    jump = pinned(exits.join(entries, ["file", "at"]).select("file", "at", F.col("exit").alias("to")).distinct())
    reached, known = pinned(first), -1
    while (now := reached.count()) != known:
        known = now
        reached = pinned(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        jump = pinned(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("further")), ["file", "to"]).select("file", "at", F.col("further").alias("to")))
    marked = candidates.join(reached.withColumn("reached", F.lit(True)), ["file", "at"], "left").fillna(False, ["reached"])
    return marked.groupBy("file", "block").applyInPandas(_followed, _CANDIDATE)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the files in ``folder``.

    Payloads that hold version lines, or whole records, are put together again. A payload that is not
    what its record's digest says fails the job. A revisit gives the length and digest of the full payload.
    An empty folder gives no rows, repeated records give a row each; payloads of any length are whole, as a record that
    one read does not hold is joined from its pieces.
    """
    chunks = _chunks(spark, folder)
    slim = pinned(_parsed(chunks).drop("value", "head"))
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("sum"))
    starts = sums.withColumn("from", F.coalesce(F.sum("sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    at = F.col("from") + F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside), F.lit(0)) - len(MAGIC)
    placed = pinned(slim.join(starts, ["file", "block"]).withColumn("at", at).drop("from"))
    follow = F.col("at") + len(MAGIC) + F.col("start") + F.col("length") + len(_GAP)
    candidates = placed.filter("at >= 0").select("file", "block", "nth", "at", F.coalesce(follow, F.lit(-1)).alias("next"))
    chain = pinned(reachable(candidates))
    own = placed.join(chain.select("file", "at", "next"), ["file", "at"])
    whole = own.filter("whole")
    result = _result(whole)
    parted = own.filter("NOT whole")
    if parted.limit(1).count():
        result = result.unionByName(_result(_joined(chunks, placed, own, parted)))
    return result


def _result(found: DataFrame) -> DataFrame:
    page = lambda c: F.try_to_number(F.nullif(F.col(c), F.lit("")), F.lit("S9999999999999999999")).cast("bigint")
    revisit = F.col("kind") == "revisit"
    wrong = F.raise_error(F.concat(F.lit("payload of record "), "name", F.lit(" differs from its digest")))
    return found.select(
        page("name").alias("page_id"),
        F.when(revisit, F.col("given").cast("bigint")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit | (F.col("digest") == F.col("said")), F.col("said")).otherwise(wrong).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, page("keeper")).alias("refers_to"),
    )


def _joined(chunks: DataFrame, placed: DataFrame, own: DataFrame, parted: DataFrame) -> DataFrame:
    """Records whose payload holds version lines, from their pieces: those from their start to their end.

    A record whose pieces are not found again has no digest, which fails the job.
    """
    # in the order of offsets every piece belongs to the last record that began at or before it
    starts = own.select("file", "at", F.col("next").alias("end"), (~F.col("whole")).alias("parted"))
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.join(parted.select("file").distinct(), "file", "left_semi").join(starts, ["file", "at"], "left")
    marked = marked.withColumn("head", F.last(F.when(F.col("end").isNotNull(), F.struct(F.col("at").alias("at"), "end", "parted")), ignorenulls=True).over(upto))
    pieces = marked.filter("head.parted AND at < head.end").select("file", "block", "nth", "size", "at", F.col("head.at").alias("head_at"))
    texts = chunks.join(pieces, ["file", "block", "nth"]).filter(F.octet_length("value") == F.col("size"))
    parts = texts.groupBy("file", "head_at").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = parts.select("file", F.col("head_at").alias("at"), F.array_join(F.transform("parts", lambda p: p.value), MAGIC).alias("value"))
    both = parted.select("file", "at", "start", "length", "kind", "name", "keeper", "said").join(whole, ["file", "at"], "left")
    block = F.substr(F.col("value").cast("binary"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return both.withColumn("bytes", block).withColumns(_payload(F.col("bytes"))).drop("value")
