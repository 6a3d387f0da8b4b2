"""Files as a DataFrame: scan rules over paths, contents read only for what is kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx
from millrace.operators.diagnostics import stream_digest

# Languages by extension, folders that are never scanned, names that may be an entry.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".dart": "dart", ".java": "java", ".cs": "csharp",
    ".html": "html", ".htm": "html", ".kt": "kotlin", ".swift": "swift", ".go": "go", ".rb": "ruby", ".rs": "rust", ".cpp": "cpp", ".c": "c",
    ".h": "c", ".hpp": "cpp",
}
SKIPPED = ("__pycache__", "venv", "env", "myenv", "node_modules", "site-packages", "dist-packages", "dist", "build", "target")
ENTRIES = ("index.html", "main.tsx", "main.ts", "main.js", "main.py", "main.dart", "Main.java", "Program.cs")
MOST_KB = 500


def _prefixes(ignored: tuple[str, ...]) -> list[str]:
    return [p for p in (i.strip().replace("\\", "/").strip("/").lower() for i in ignored) if p]


def _plain(path: str) -> str:
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        parts = parts[:-1] if p == ".." else parts if p in ("", ".") else [*parts, p]
    return "/".join(parts)


def scanned(paths: DataFrame, languages: dict[str, str] | None = None, skip: tuple[str, ...] = SKIPPED, ignored: tuple[str, ...] = (), excluded: tuple[str, ...] = (), most_kb: int = MOST_KB) -> DataFrame:
    """Paths (rel, length) with ``extension``, ``language`` and ``skipped``: why a path is not taken, else null.

    Hidden and skipped folders go by name, case aside; ignored paths by prefix, case aside; generated targets by
    exact path once both are normalised; then the extension, then the size. All are predicates on metadata.
    """
    languages = languages or LANGUAGES
    folders = F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1)
    low = F.lower("rel")
    skipped = F.exists(folders, lambda p: F.startswith(p, F.lit(".")) | F.lower(p).isin(*[s.lower() for s in skip]))
    ignore = F.lit(False)
    for p in _prefixes(ignored):
        ignore = ignore | (low == p) | F.startswith(low, F.lit(p + "/"))
    table = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    ext = tx.extension(F.col("rel"))
    reason = (
        F.when(skipped, "skipped_folder").when(ignore, "ignored").when(tx.posix(F.col("rel")).isin(*[_plain(e) for e in excluded]) if excluded else F.lit(False), "generated")
        .when(~F.coalesce(F.map_contains_key(table, ext), F.lit(False)), "extension").when(F.col("length") / 1024 > most_kb, "too_large")
    )
    return paths.withColumn("extension", ext).withColumn("language", F.try_element_at(table, ext)).withColumn("skipped", reason)


def scan_figures(scan: DataFrame) -> DataFrame:
    return scan.groupBy(F.coalesce("skipped", F.lit("kept")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def scan_details(scan: DataFrame, most: int = 20, most_kb: int = MOST_KB) -> DataFrame:
    """(kind, rel, observed, bound, total, retained, omitted, digest): the first ``most`` paths of each reason, and a digest of them all.

    The digest goes over the paths of a reason in order; their digests, not the paths, meet in one row.
    """
    out = scan.filter("skipped IS NOT NULL").select(F.col("skipped").alias("kind"), "rel", F.col("length").alias("observed"))
    digests = stream_digest(out, F.col("rel"), "rel", by=("kind",))
    totals = out.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    first = out.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("rel"))).filter(F.col("nth") <= most).drop("nth")
    bound = F.when(F.col("kind") == "too_large", F.lit(most_kb * 1024)).cast("bigint").alias("bound")
    retained = F.least(F.col("total"), F.lit(most)).cast("bigint")
    return first.join(totals, "kind").join(digests, "kind").select("kind", "rel", F.when(F.col("kind") == "too_large", F.col("observed")).alias("observed"), bound, "total", retained.alias("retained"), (F.col("total") - retained).alias("omitted"), "digest")


def snapshot(raw: Column) -> Column:
    """(hash, content) of raw bytes: the hash of the bytes as they are, then text without byte order mark, line ends as line feeds."""
    content = tx.normalised_newlines(tx.without_bom(F.make_valid_utf8(raw.cast("string"))))
    return F.struct(F.sha2(raw, 256).alias("hash"), content.alias("content"))


def listed(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, rel, length) of the files below ``root``, from the store's own listing; no file is opened.

    Hidden, skipped and ignored folders are not entered and links are not followed. The listing is the driver's, as that of
    Spark's readers is; unlike theirs it also has the names that begin with an underscore.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = store.makeQualified(path)
    start = len(top.toString().rstrip("/")) + 1
    dropped, low = {s.lower() for s in skip}, tuple(_prefixes(ignored))
    todo, found = [top], []
    while todo:
        for status in store.listStatus(todo.pop()):
            name, whole = status.getPath().getName(), status.getPath().toString()
            rel = whole[start:]
            if status.isSymlink():
                continue
            if status.isFile():
                found.append((whole, rel, status.getLen()))
            elif not name.startswith(".") and name.lower() not in dropped and not any(rel.lower() == p or rel.lower().startswith(p + "/") for p in low):
                todo.append(status.getPath())
    return spark.createDataFrame(found, "path string, rel string, length bigint")


@F.arrow_udf(T.BinaryType())
def _opened(paths: pa.Array) -> pa.Array:
    from pyarrow import fs

    out = []
    for path in paths.to_pylist():
        store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        with store.open_input_stream(name) as file:
            out.append(file.read())
    return pa.array(out, type=pa.binary())


def read_files(spark: SparkSession, root: str, **rules) -> DataFrame:
    """(rel, extension, language, hash, content) of the files below ``root`` that the rules keep.

    Only folders that the scan enters are read, and of these only names with a known extension and sizes within the bound.
    Spark's readers take a name that begins with an underscore for no file: such files the executors open themselves,
    through Arrow's file systems; a store that Arrow does not know is an error.
    """
    scan = scanned(listed(spark, root, rules.get("skip", SKIPPED), rules.get("ignored", ())), **rules)
    kept = scan.filter("skipped IS NULL").select("path", "rel", "extension", "language")
    hidden = F.startswith(F.element_at(F.split("rel", "/"), -1), F.lit("_"))
    folders = [r.folder for r in kept.filter(~hidden).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().collect()]
    own = kept.filter(hidden).withColumn("raw", _opened("path")).select("rel", "extension", "language", "raw")
    if folders:
        suffixes = ",".join(sorted("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in rules.get("languages") or LANGUAGES))
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{{{suffixes}}}").load(folders).filter(F.col("length") <= rules.get("most_kb", MOST_KB) * 1024)
        own = own.unionByName(kept.filter(~hidden).join(found.select("path", F.col("content").alias("raw")), "path").select("rel", "extension", "language", "raw"))
    return own.withColumn("s", snapshot(F.col("raw"))).select("rel", "extension", "language", "s.hash", "s.content")


def entry(files: DataFrame, candidates: tuple[str, ...] = ENTRIES, hint: str | None = None) -> str | None:
    """The hint, which must lie inside the project, if it is a file; else the first candidate that is one."""
    if hint is not None:
        turned = hint.replace("\\", "/")
        parts = [p for p in turned.split("/") if p not in ("", ".")]
        if not parts or turned.startswith("/") or ".." in parts or (len(parts[0]) > 1 and parts[0][1] == ":" and parts[0][0].isalpha()):
            raise ValueError("the entry must be a path inside the project")
        path = "/".join(parts)
        return path if files.filter(F.col("rel") == path).limit(1).count() else None
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("rel"))
    row = files.filter(F.col("rel").isin(*candidates)).agg(F.min_by("rel", order).alias("rel")).first()
    return row["rel"]


def document_path() -> Column:
    """The path of a document; a null part of it is empty, so no document is without a path."""
    parts = [F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("."), F.col("lang")]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("rel")


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: (rel, language, content)."""
    return docs.select(document_path(), F.col("lang").alias("language"), F.col("text").alias("content"))
