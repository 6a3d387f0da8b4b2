"""Records of earlier runs: read, checked, written back; settings and their overrides."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import project
from millrace.operators.planning import IDENTITY
from millrace.operators.view import embedded, from_embedded

VERSION = 1
FIELDS = "path string, hash string, language string, description string, key_concepts array<string>, " + ", ".join(f"{k} string" for k in IDENTITY)
VIEW = f"marker string, version int, entry string, files array<struct<{', '.join(f.replace(' ', ':', 1) for f in FIELDS.split(', '))}>>"
MARKER = "millrace-view"


def write_json(records: DataFrame, path: str, entry: str | None = None) -> None:
    """One record a line, under the commit protocol: readers see the old table or the new one. Foreign folders are refused."""
    _own(records.sparkSession, path)
    records.select(F.lit(MARKER).alias("marker"), F.lit(VERSION).alias("version"), F.lit(entry).alias("entry"), F.struct(*records.columns).alias("file")).write.mode("overwrite").json(path)


def _own(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(hadoop) and store.listStatus(hadoop):
        kept = spark.read.option("wholetext", False).text(path).filter(~F.contains("value", F.lit(MARKER))).limit(1).count()
        if kept:
            raise ValueError(f"{path} holds what this engine did not write")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of the current version; a line of another version, or one that is no record, fails the read."""
    rows = spark.read.schema(f"marker string, version int, entry string, file struct<{', '.join(f.replace(' ', ':', 1) for f in FIELDS.split(', '))}>").json(path)
    bad = (F.col("marker") != MARKER) | (F.col("version") != VERSION) | F.col("file.path").isNull()
    checked = rows.withColumn("file", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("not a record of this version"))).otherwise(F.col("file")))
    return checked.select("file.*")


def to_markdown(view: DataFrame) -> DataFrame:
    """(path, markdown) with each record embedded, so that reading gives it back whole."""
    body = F.concat_ws("\n\n", F.concat(F.lit("### `"), F.col("path"), F.lit("`")), F.nullif(F.col("description"), F.lit("")))
    return view.select("path", F.concat(body, F.lit("\n\n"), embedded(F.to_json(F.struct(*view.columns)))).alias("markdown"))


def from_markdown(rows: DataFrame) -> DataFrame:
    """Records of ``to_markdown``; where the embedded view is missing, what the visible text says."""
    parsed = F.from_json(from_embedded(F.col("markdown")), FIELDS)
    seen = rows.withColumn("r", parsed)
    visible = F.struct(
        F.regexp_extract("markdown", r"### `([^`]*)`", 1).alias("path"),
        *[F.lit(None).cast("string").alias(c) for c in ("hash", "language")],
        F.nullif(tx.strip(F.regexp_extract("markdown", r"(?s)### `[^`]*`\n\n(.*?)(?:\n\n<!--|\z)", 1)), F.lit("")).alias("description"),
        F.lit(None).cast("array<string>").alias("key_concepts"),
        *[F.lit(None).cast("string").alias(k) for k in IDENTITY],
    )
    return seen.select(F.coalesce("r", visible).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_either(spark: SparkSession, json_path: str | None, markdown_path: str | None, prefer: str = "json") -> DataFrame | None:
    """Public files of an earlier document in the preferred format; the other format counts only where that one is missing.

    A document that is there but cannot be read is an error, not a reason to look at the other. None if neither is there.
    """
    known = {"json": (json_path, project.read_json), "markdown": (markdown_path, project.read_files)}
    for kind in sorted(known, key=lambda k: k != prefer):
        path, read = known[kind]
        if path and exists(spark, path):
            return read(project.read_text(spark, path))
    return None


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, fields) where two documents of one run differ: a path that one lacks, its hash or a key of its identity."""
    keys = ("hash", *IDENTITY)
    left = a.select("path", F.struct(*keys).alias("a"), F.lit(True).alias("in_a"))
    right = b.select("path", F.struct(*keys).alias("b"), F.lit(True).alias("in_b"))
    both = left.join(right, "path", "full")
    differing = F.filter(F.array(*[F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    fields = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), F.array(F.lit("path"))).otherwise(differing)
    return both.select("path", fields.alias("fields")).filter(F.size("fields") > 0)


def recovered(records: DataFrame, identity: Mapping[str, str | None]) -> DataFrame:
    """Records with ``mismatch``: the first key of the run's identity that they differ in, null if they may be used."""
    checks = [F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in identity.items()]
    return records.withColumn("mismatch", F.coalesce(*checks) if checks else F.lit(None).cast("string"))


def valid_nodes(planned: DataFrame, found: DataFrame) -> DataFrame:
    """Recovered tree nodes with ``reason``: the first check that fails, null if the node may be used.

    ``planned`` (rel, node_id, identity, input_digest, phase, child_ids, leaves), ``found`` the same with result_ok.
    """
    p = planned.select("rel", "node_id", *[F.col(c).alias(f"p_{c}") for c in ("identity", "input_digest", "phase", "child_ids", "leaves")], F.lit(True).alias("in_plan"))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    reason = (
        F.when(F.col("in_plan").isNull() | differs("identity"), "stale-identity").when(differs("input_digest"), "input-digest-mismatch").when(differs("phase"), "stage-mismatch")
        .when(differs("child_ids"), "child-order-mismatch").when(differs("leaves"), "coverage-mismatch").when(~F.coalesce("result_ok", F.lit(False)), "live-schema-mismatch")
    )
    return found.join(p, ["rel", "node_id"], "left").withColumn("reason", reason).select(*found.columns, "reason")


def upserted(old: DataFrame, new: DataFrame, key: str | list[str] = "path", gone: DataFrame | None = None) -> DataFrame:
    """A table with new rows over old ones of the same key, and without what is gone. Nodes of a tree have the key [rel, node_id]."""
    keys = [key] if isinstance(key, str) else key
    kept = old.join(new.select(keys), keys, "left_anti").unionByName(new)
    return kept if gone is None else discarded(kept, gone, keys)


def discarded(rows: DataFrame, gone: DataFrame, key: str | list[str] = "path") -> DataFrame:
    """Rows without those of the keys that are gone; a part of the key takes all that belong to it."""
    keys = [key] if isinstance(key, str) else key
    return rows.join(gone.select(keys).distinct(), keys, "left_anti")


def _over_mapping(base: dict, more: Mapping[str, object], less) -> dict:
    """A mapping with more in it and less of it; values that are lists grow and shrink item by item."""
    taken = less if isinstance(less, Mapping) else {}
    gone = () if taken else less
    out = {}
    for key in dict.fromkeys([*base, *more]):
        value = more.get(key, base.get(key))
        if isinstance(value, list | tuple) and isinstance(base.get(key, []), list | tuple):
            value = [x for x in dict.fromkeys([*base.get(key, ()), *value]) if x not in (taken.get(key) or ())]
        if key not in gone:
            out[key] = value
    return out


def resolved(defaults: Mapping[str, object], *layers: Mapping[str, object]) -> dict[str, object]:
    """Settings: layers over defaults, with name_add and name_remove for lists and mappings. Unknown names are errors.

    In a mapping of lists, name_add extends the lists that are there, and name_remove, given as a mapping, takes
    from them; a list of keys takes these out whole.
    """

    def over(base: dict[str, object], layer: Mapping[str, object]) -> dict[str, object]:
        out = dict(base)
        for name, value in layer.items():
            stem = name.removesuffix("_add").removesuffix("_remove")
            if stem not in defaults:
                raise ValueError(f"unknown setting {name!r}")
            if isinstance(value, bool) != isinstance(defaults[stem], bool) and name == stem:
                raise ValueError(f"setting {name!r} has the wrong type")
            if name == stem:
                out[stem] = value
        for stem in defaults:
            more, less = layer.get(f"{stem}_add"), layer.get(f"{stem}_remove")
            if isinstance(out[stem], dict):
                out[stem] = _over_mapping(out[stem], more or {}, less or ())
            elif isinstance(out[stem], list | tuple):
                out[stem] = [x for x in dict.fromkeys([*out[stem], *(more or ())]) if x not in (less or ())]
        return out

    return reduce(over, layers, dict(defaults))
