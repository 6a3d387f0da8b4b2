"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import numbered
from millrace.session import pinned

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_CELL = 8_192
SMALL = 100_000  # sources up to which their table is broadcast
MOST_EPOCHS = 3


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Weights dealt to sources by code point, null last, repeating. One row a source goes through one window."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target``: 100 % of all sizes by weight, at most ``most_epochs`` times a source's size.

    ``sources`` is (source, source_size, weight); a weight of 0 or less gets nothing. Capping and resharing until none is above ends where
    sources are capped in the order of cap over weight, so one pass over that order finds it.
    """
    cap = F.col("source_size") * F.lit(float(most_epochs))
    order = [F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = sources.withColumn("_all", F.sum(F.col("source_size").cast("double")).over(whole))
    nothing = summed.filter("weight <= 0").drop("_all").withColumn("target", F.lit(0.0))
    seen = (
        summed.filter("weight > 0")
        .withColumn("_cap", cap)
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(after))
        .withColumn("_full", F.col("_left") * F.col("weight") >= F.col("_cap") * F.col("_weights"))
    )
    free = ~F.col("_full")
    share = F.first(F.when(free, F.col("_left")), ignorenulls=True).over(everything) * F.col("weight") / F.first(F.when(free, F.col("_weights")), ignorenulls=True).over(everything)
    return seen.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(share)).drop("_cap", "_all", "_left", "_weights", "_full").unionByName(nothing)


def _levels(sources: DataFrame, most_epochs: int) -> DataFrame:
    """``targets`` for sources of any number: caps are met and the rest reshared, a round of sums each, until none is above."""
    cap = (F.col("source_size") * F.lit(float(most_epochs))).alias("_cap")
    own = pinned(sources.withColumns({"_cap": cap, "_weight": F.greatest("weight", F.lit(0.0))}))
    full = (F.col("_weight") > 0) & (F.lit(0.0) * F.col("_cap") == 1)  # none yet
    met, level = -1, 0.0
    while True:
        row = own.agg(
            F.sum(F.col("source_size").cast("double")).alias("all"), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("free"), F.count_if(full).alias("met"),
        ).first()
        if row["met"] == met or not row["free"]:
            break
        met, level = row["met"], (row["all"] - row["caps"]) / row["free"]
        full = F.lit(level) * F.col("_weight") >= F.col("_cap")
    share = F.when(F.col("_weight") <= 0, 0.0).when(full, F.col("_cap")).otherwise(F.lit(level) * F.col("_weight"))
    return own.withColumn("target", share).drop("_cap", "_weight")


def _groups(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, most_epochs: int, seed: int) -> DataFrame:
    """Rows that agree in source, id, text and size as one group (doc_id, source, size, _key, _copies), with what the mix takes of it.

    The last epoch goes through the rows of a source in the order of a hash of id and text: of a group it takes
    ``_full`` copies whole and ``_part`` words of one more.
    """
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col), F.lit("")).alias("_name"), words(F.col(text_col)).alias("size"), key.alias("_key"))
    rows = pinned(slim.groupBy("_none", "_name", "_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("_copies")))
    per_source = pinned(rows.groupBy("_none", "_name").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.ceil(F.count(F.lit(1)) / ROWS_PER_CELL).alias("_cells")))
    known = per_source.select("_none", "_name", "_cells")
    few = known.count() <= SMALL
    if few:
        known = F.broadcast(known)
    place = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * F.col("_cells") / F.lit(1 << 32)).cast("int")
    rows = rows.join(known, ["_none", "_name"]).withColumn("_cell", place).drop("_cells")
    per_cell = rows.groupBy("_none", "_name", "_cell").agg(F.sum(F.col("size") * F.col("_copies")).alias("_size"))
    named = per_source.drop("_cells").withColumn("source", F.when(~F.col("_none"), F.col("_name")))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_w_source"), F.col("weight").cast("double").alias("weight"))
        weighted = named.join(given, F.col("source").eqNullSafe(F.col("_w_source")), "left").drop("_w_source").fillna(0.0, ["weight"])
    elif few:
        weighted = cycle_weights(named, weights)
    else:
        place = (F.col("_nth") % len(weights) + 1).cast("int")
        weighted = numbered(named, "_none", "_name", name="_nth").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).drop("_nth")
    weighted = targets(weighted, most_epochs) if few else _levels(weighted, most_epochs)
    budget = F.floor("target").cast("bigint")
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = weighted.select("_none", "_name", "source_size", "target", F.floor(budget / size).cast("bigint").alias("_epochs"), (budget % size).alias("_rest"))
    before = Window.partitionBy("_none", "_name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size").join(plan, ["_none", "_name"])
    inside = Window.partitionBy("_none", "_name", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(inside), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("size") * F.col("_copies"), F.col("_rest") - prefix)).cast("bigint")
    full = F.when(F.col("size") > 0, F.floor(F.col("_left") / F.col("size"))).otherwise(0).cast("bigint")
    part = F.when(F.col("size") > 0, F.col("_left") % F.col("size")).otherwise(0).cast("bigint")
    found = rows.withColumn("source", F.when(~F.col("_none"), F.col("_name"))).join(offsets, ["_none", "_name", "_cell"]).withColumn("_left", left)
    return found.select("doc_id", "source", "size", "source_size", "target", "_key", "_copies", F.col("_epochs"), full.alias("_full"), part.alias("_part"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: int = MOST_EPOCHS, seed: int = 2) -> DataFrame:
    """What the mix takes of each document: (doc_id, source, size, source_size, target, taken).

    ``weights`` is a table (source, weight) or a cycle of numbers. ``taken`` counts words, repeats
    included: whole epochs take a document whole, the last epoch follows the order of a random hash key
    within the source and is cut at exactly floor(target) words, inside a document if need be, so no
    document exceeds ``most_epochs`` times its size. Null text has size 0; null source is a source;
    rows that agree in id, text and source are one group and interchangeable. An empty table gives an empty result;
    a source that the weight table lacks has weight 0. Reruns agree. Only ids, sources, sizes and keys
    are shuffled; a source is cut into cells by ranges of the key, as many as its rows ask for, so neither a hot
    source nor an id that many rows share meets in one task. Other columns of ``docs``, whatever their names, do not count.
    """
    found = _groups(docs, id_col, text_col, source_col, weights, most_epochs, seed)
    last = F.when(F.col("_at") < F.col("_full"), F.col("size")).when(F.col("_at") == F.col("_full"), F.col("_part")).otherwise(0)
    taken = (F.col("_epochs") * F.col("size") + last).cast("bigint").alias("taken")
    every = lambda df: df.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + ROWS_PER_CELL, F.col("_copies")) - 1)))
    start = F.lit(0).cast("bigint")
    one = every(found.filter(F.col("_copies") <= ROWS_PER_CELL).withColumn("_from", start))
    # the copies of a large group come from many tasks
    blocks = found.filter(F.col("_copies") > ROWS_PER_CELL).withColumn("_from", F.explode(F.sequence(start, F.col("_copies") - 1, F.lit(ROWS_PER_CELL).cast("bigint"))))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = every(blocks.repartition(tasks, "_key", "_from"))
    return one.unionByName(more).select("doc_id", "source", "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: int = MOST_EPOCHS, seed: int = 2) -> DataFrame:
    """The mix itself, with the columns of ``docs`` (doc_id, text, source and any others).

    A document comes as often as ``mix`` takes it whole; the one at a source's cut comes with its first
    words only, as many as are left. Documents without words cost nothing and come once. ``n_chars``, if
    there, follows the text. Rows that agree in doc_id, text and source are told apart only where the cut goes
    through them: then they are numbered in the order in which their tasks hold them. An empty table gives
    an empty result; columns that begin with _mr_ are for this operator.
    """
    found = pinned(_groups(docs, "doc_id", "text", "source", weights, most_epochs, seed))
    amounts = found.select(
        F.col("_key").alias("_mr_key"), F.col("source").alias("_mr_source"), F.col("size").alias("_mr_size"), F.col("_epochs").alias("_mr_epochs"), F.col("_full").alias("_mr_full"),
        F.col("_part").alias("_mr_part"), ((F.col("_copies") > 1) & (F.col("_full") < F.col("_copies")) & (F.col("_full") + F.col("_part") > 0)).alias("_mr_split"),
    )
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text))
    # a hot key has few amounts and many rows: both sides have a plain exchange, which a skewed join can split
    joined = docs.withColumn("_mr_own", key).join(amounts, (F.col("_mr_own") == F.col("_mr_key")) & F.col("source").eqNullSafe(F.col("_mr_source")))
    rows = joined.withColumn("_mr_at", F.lit(0).cast("bigint"))
    if found.filter("_copies > 1 AND _full < _copies AND _full + _part > 0").limit(1).count():
        placed = pinned(joined.filter("_mr_split")).withColumn("_mr_place", F.monotonically_increasing_id())
        nth = numbered(placed, "_mr_key", "_mr_source", "_mr_place", name="_mr_nth")
        first = nth.groupBy("_mr_key", "_mr_source").agg(F.min("_mr_nth").alias("_mr_first")).withColumnsRenamed({"_mr_key": "_mr_k", "_mr_source": "_mr_s"})
        split = nth.join(first, (F.col("_mr_key") == F.col("_mr_k")) & F.col("_mr_source").eqNullSafe(F.col("_mr_s")))
        split = split.withColumn("_mr_at", F.col("_mr_nth") - F.col("_mr_first")).select(*rows.columns)
        rows = rows.filter("NOT _mr_split").unionByName(split)
    else:
        rows = rows.withColumn("_mr_at", F.lit(0).cast("bigint"))
    size = F.col("_mr_size")
    last = F.when(F.col("_mr_split"), F.col("_mr_at") < F.col("_mr_full")).otherwise(F.col("_mr_full") > 0).cast("int")
    whole = F.when(size > 0, F.col("_mr_epochs") + last).otherwise(1).cast("int")
    rest = F.when((size > 0) & (F.col("_mr_at") == F.when(F.col("_mr_split"), F.col("_mr_full")).otherwise(0)) & (last == 0), F.col("_mr_part")).otherwise(0).cast("int")
    copies = F.array_repeat(F.lit(0), whole)
    rows = rows.withColumn("_mr_cut", F.explode(F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)))
    piece = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_mr_cut")), "")
    text = F.when(F.col("_mr_cut") > 0, piece).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_mr_cut") > 0, F.length(piece).cast("bigint")).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(*docs.columns)
