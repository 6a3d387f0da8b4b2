"""Facts from many chunks of a file: merged, allocated to declarations, reconciled with the source."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Languages whose names do not differ by case.
CASELESS = ("sql", "pascal", "basic", "fortran")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def _composed(names: pa.Array) -> pa.Array:
    return pa.array([None if n is None else unicodedata.normalize("NFC", n) for n in names.to_pylist()], type=pa.string())


def symbol_key(name: Column, language: Column | None = None) -> Column:
    """Names that are the same: composed, white space as one space, lower case for languages that do not differ by it.

    Names of ASCII signs are composed as they are; only others go to Python.
    """
    odd = F.when(F.rlike(name, F.lit(r"[^\x00-\x7F]")), name)
    key = _squeezed(F.coalesce(_composed(odd), name))
    return key if language is None else F.when(F.lower(language).isin(*CASELESS), F.lower(key)).otherwise(key)


def merged(facts: DataFrame) -> DataFrame:
    """One row a (rel, kind, name, scope, signature) of facts (rel, ord, kind, name, scope, signature, description[, language]).

    Names are one by ``symbol_key``; the first spelling is shown. The first non-empty description counts, in the
    order of ``ord``; origins are the places, in order. A null scope or signature counts as ''.
    """
    key = symbol_key(F.col("name"), F.col("language") if "language" in facts.columns else None)
    keyed = facts.select(
        "rel", "kind", key.alias("key"), _squeezed(F.col("name")).alias("shown"), F.coalesce("scope", F.lit("")).alias("scope"), symbol_key(F.coalesce("signature", F.lit(""))).alias("signature"), "ord", F.nullif(F.trim("description"), F.lit("")).alias("description")
    ).filter("key <> ''")
    return keyed.groupBy("rel", "kind", F.col("key").alias("name_key"), "scope", "signature").agg(
        F.min_by("shown", F.struct("ord", "shown")).alias("name"),
        F.min("ord").alias("first_ord"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("ord"))).alias("description"),
        F.array_sort(F.collect_set("ord")).alias("origins"),
    ).select("rel", "kind", "name", "scope", "signature", "first_ord", "description", "origins")


def occurrences(facts: DataFrame) -> DataFrame:
    """Adds ``occurrence``: how many facts of that kind and name come before, those with a signature first."""
    order = Window.partitionBy("rel", "chunk", "kind", "name").orderBy((F.coalesce(F.col("signature"), F.lit("")) == "").cast("int"), "canonical")
    return facts.withColumn("occurrence", F.row_number().over(order) - 1)


def allocated(facts: DataFrame, symbols: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(rel, chunk, fact, symbol): each fact gets one declaration of its name and kind, each declaration at most one fact.

    Facts with a signature choose first, then by canonical form. Candidates have the qualified name, else
    the short one; a signature narrows them if it is part of any of theirs. Where all of several candidates are taken
    the fact gets a scope of its own (scope_...), a sole one is shared. Without a candidate the units of the chunk (rel, chunk,
    symbol, kind, qualified_name, signature, start) are asked the same way; a chunk of one unit gives that. Greedy within a
    chunk, whose rows are bounded by what one call may answer.
    """
    columns = ["rel", "chunk", "symbol", "kind", "qualified_name", "signature", "start"]
    known = symbols.select(*columns, F.lit(0).alias("tier"))
    if units is not None:
        known = known.unionByName(units.select(*columns, F.lit(1).alias("tier")))

    def allocate(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        squeezed = lambda s: re.sub(r"\s+", "", s or "")
        rows_of = right.sort_values(["start", "symbol"]).to_dict("records")
        taken, rows = set(), []
        for n, f in enumerate(sorted(left.to_dict("records"), key=lambda r: (not (r["signature"] or "").strip(), r["canonical"]))):
            chosen = None
            for tier in (0, 1):
                own = [s for s in rows_of if s["tier"] == tier]
                same = [s for s in own if s["kind"] == f["kind"]]
                near = [s for s in same if s["qualified_name"] == f["name"]] or [s for s in same if (s["qualified_name"] or "").split(".")[-1] == f["name"]]
                if squeezed(f["signature"]):
                    near = [s for s in near if squeezed(f["signature"]) in squeezed(s["signature"])] or near
                free = [s for s in near if s["symbol"] not in taken]
                if near:
                    chosen = free[0]["symbol"] if free else near[0]["symbol"] if len(near) == 1 else f"scope_{key[1]}_{n}"
                elif tier and len(own) == 1:
                    chosen = own[0]["symbol"]
                if chosen is not None:
                    break
            taken.add(chosen)
            rows.append((key[0], key[1], f["fact"], chosen))
        return pd.DataFrame(rows, columns=["rel", "chunk", "fact", "symbol"])

    pairs = facts.groupBy("rel", "chunk").cogroup(known.groupBy("rel", "chunk"))
    return pairs.applyInPandas(allocate, "rel string, chunk int, fact string, symbol string").filter("fact IS NOT NULL")


_LAST = r"(?:::|[./#$\\])"


def reconciled(model: DataFrame, declared: DataFrame) -> DataFrame:
    """(rel, bucket, name, signature, start, description) of the declarations that a model named, all overloads of them.

    A name stands for the declarations of that full name, else for those whose last part is its last part. It counts in its
    own bucket, else in the other if it is declared there once. A description goes to a declaration only if
    that is the only one of the name, or the only one with the signature; the first one wins. ``model`` is (rel, ord,
    bucket, name, signature, description), ``declared`` (rel, bucket, name, signature, start).
    """
    last = lambda c: F.element_at(F.split(c, _LAST), -1)
    d = declared.select("rel", F.col("name").alias("d_name"), F.col("bucket").alias("d_bucket"), F.col("signature").alias("d_signature"), "start")
    full = model.join(d.withColumn("name", F.col("d_name")), ["rel", "name"])
    rest = model.join(declared.select("rel", "name").distinct(), ["rel", "name"], "left_anti").withColumn("_last", last(F.col("name")))
    short = rest.join(d.withColumn("_last", last(F.col("d_name"))), ["rel", "_last"]).drop("_last")
    asked = Window.partitionBy("rel", "ord")
    same = (F.col("bucket") == F.col("d_bucket")).cast("int")
    both = full.unionByName(short).withColumns({"own": F.sum(same).over(asked), "every": F.count(F.lit(1)).over(asked)})
    both = both.filter(((F.col("own") > 0) & (F.col("bucket") == F.col("d_bucket"))) | ((F.col("own") == 0) & (F.col("every") == 1)))
    squeezed = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", "")
    fits = (squeezed("signature") != "") & (squeezed("signature") == squeezed("d_signature"))
    alone = F.when(F.col("own") > 0, F.col("own") == 1).otherwise(F.col("every") == 1)
    isolated = alone | (fits & (F.sum(fits.cast("int")).over(asked) == 1))
    text = F.when(isolated, F.nullif(F.trim("description"), F.lit("")))
    return both.withColumn("text", text).groupBy("rel", F.col("d_bucket").alias("bucket"), F.col("d_name").alias("name"), F.col("d_signature").alias("signature"), "start").agg(
        F.min_by("text", F.when(F.col("text").isNotNull(), F.col("ord"))).alias("description")
    )


def public_exports(exports: DataFrame, proven: DataFrame) -> DataFrame:
    """Exports (rel, name) that the source proves (rel, name, start), in source order."""
    return proven.join(exports.select("rel", "name").distinct(), ["rel", "name"], "left_semi").groupBy("rel", "name").agg(F.min("start").alias("start"))


# Languages whose declarations lines can prove, and the forms that prove them. A name is group 1.
NODE = ("javascript", "jsx", "typescript", "tsx")
_NAME = r"[A-Za-z_$À-￿][\w$À-￿]*"
_EXPORT = r"(?:export\s+(?:default\s+)?)?"
_PYTHON_FORMS = (("functions", re.compile(rf"(?:async\s+)?def\s+({_NAME})\b")), ("classes", re.compile(rf"class\s+({_NAME})\b")))
_NODE_FORMS = (("functions", re.compile(rf"{_EXPORT}(?:async\s+)?function\s*\*?\s*({_NAME})\b")), ("classes", re.compile(rf"{_EXPORT}(?:abstract\s+)?class\s+({_NAME})\b")))
_BINDING = re.compile(rf"{_EXPORT}(?:const|let|var)\s+({_NAME})\s*(?::\s*(?P<kind>[^=]+?)\s*)?=\s*(?P<value>.+)$")
_CALLABLE = re.compile(rf"(?:async\s+)?(?:function\b|(?:\([^)]*\)|{_NAME})\s*(?::[^=]+)?=>)")
_COMPONENT = re.compile(r"(?:React\.)?(?:FC|FunctionComponent|VFC|VoidFunctionComponent)\b")
_NAMED_EXPORT = (
    re.compile(rf"export\s+\*\s+as\s+({_NAME})\s+from\b"), re.compile(rf"export\s+default\s+({_NAME})\s*;?\s*$"),
    re.compile(rf"module\.exports\s*=\s*({_NAME})\s*;?\s*$"), re.compile(rf"(?:module\.)?exports\.({_NAME})\s*="),
)
_EXPORT_LIST, _EXPORT_OBJECT = re.compile(r"export\s+(?:type\s+)?\{([^}]*)\}"), re.compile(r"module\.exports\s*=\s*\{(.*)\}\s*;?\s*$")
_ALL = re.compile(r"(?m)^__all__\s*(?::[^=\n]+)?\s*(?:=|\+=)[ \t]*")
_ALL_ITEMS = r"""([\s,]*+(?:(?:'[A-Za-z_]\w*'|"[A-Za-z_]\w*")[\s,]*+)*+)"""
_ALL_LIST = re.compile(rf"(?:\[{_ALL_ITEMS}\]|\({_ALL_ITEMS}\))[ \t]*+(?:#|;?[ \t]*+$)", re.MULTILINE)
_OPENERS = re.compile(r"""'{3}|"{3}|//|/\*|[#`'"]""")
_LONG = {"'" * 3: "'" * 3, '"' * 3: '"' * 3, "/*": "*/", "`": "`"}


def visible_lines(source: str) -> list[tuple[int, str]]:
    """(byte offset, code) of every line: without comments, and without what strings hold.

    ``#`` and ``//`` end a line in any language. A line that begins inside a block comment or a template shows
    nothing; one that begins inside a long string shows what follows its end.
    """
    out, closing, start = [], None, 0
    for line in source.splitlines(keepends=True):
        body, at, shown = line.rstrip("\r\n"), 0, []
        hidden = closing in ("*/", "`")
        while at < len(body):
            if closing:
                end = body.find(closing, at)
                at, closing = (len(body), closing) if end < 0 else (end + len(closing), None)
                continue
            found = _OPENERS.search(body, at)
            shown.append(body[at : found.start()] if found else body[at:])
            if not found or found.group() in ("#", "//"):
                break
            at = found.end()
            if found.group() in _LONG:
                closing = _LONG[found.group()]
            else:  # a short string ends with its line at the latest
                rest = re.compile(rf"(?:\\.|[^\\{found.group()}])*").match(body, at)
                at = rest.end() + 1
        out.append((start, "" if hidden else "".join(shown)))
        start += len(line.encode())
    return out


def _literal_exports(source: str) -> list[tuple[str, int]]:
    """(name, byte offset) of every ``__all__`` that is a flat list or tuple of plain names; any other form voids them all."""
    found = []
    for head in _ALL.finditer(source):
        value = _ALL_LIST.match(source, head.end())
        if not value:
            return []
        start = len(source[: head.start()].encode())
        found += [(name, start) for name in re.findall(r"\w+", value.group(1) or value.group(2) or "")]
    return found


def _said(code: str) -> tuple[str | None, str, list[str]]:
    """(bucket, name, exported names) of a line of the Node family; no bucket where it declares nothing."""
    own = lambda name: [name] if code.startswith("export") else []
    for bucket, form in _NODE_FORMS:
        if m := form.match(code):
            return bucket, m[1], own(m[1])
    if m := _BINDING.match(code):
        callable_ = _CALLABLE.match(m["value"].strip()) or (m["kind"] and _COMPONENT.match(m["kind"].strip()))
        return ("functions" if callable_ else None), m[1], own(m[1])
    if m := _EXPORT_LIST.match(code):
        names = [part.split(" as ")[-1].strip() for part in m[1].split(",")]
        return None, "", [n for n in names if re.fullmatch(_NAME, n)]
    if m := _EXPORT_OBJECT.match(code):
        members = [re.match(rf"({_NAME})\s*(?::|$)", part.strip()) for part in m[1].split(",")]
        return None, "", [] if "..." in m[1] or "[" in m[1] else [x[1] for x in members if x]
    return None, "", next(([m[1]] for form in _NAMED_EXPORT if (m := form.match(code))), [])


def declarations(source: str, language: str | None) -> list[tuple[str, str, int]]:
    """(bucket, name, byte offset of its line) that lines of code prove; exports in order, each once.

    Only Python and the Node family have such lines; a file of any other language proves nothing.
    """
    lang = (language or "").lower()
    if lang != "python" and lang not in NODE:
        return []
    lines = visible_lines(source)
    found, exports = [], []
    if lang == "python":
        shown = {start for start, code in lines if code.lstrip().startswith("__all__")}
        exports = [(name, start) for name, start in _literal_exports(source) if start in shown]
    for start, code in lines:
        code = code.strip()
        if lang == "python":
            found += [(bucket, m[1], start) for bucket, form in _PYTHON_FORMS if (m := form.match(code))]
            continue
        bucket, name, names = _said(code)
        found += [(bucket, name, start)] if bucket else []
        exports += [(n, start) for n in names]
    first: dict[str, int] = {}
    for name, start in exports:
        first.setdefault(name, start)
    return [*found, *(("exports", name, start) for name, start in first.items())]


def proven(files: DataFrame) -> DataFrame:
    """(rel, bucket, name, start) over files (rel, language, content): what their own lines prove, at its byte."""

    def prove(batches):
        for rows in batches:
            out = [(r.rel, *d) for r in rows.itertuples() for d in declarations(r.content or "", r.language)]
            yield pd.DataFrame(out, columns=["rel", "bucket", "name", "start"])

    return files.select("rel", "language", "content").mapInPandas(prove, "rel string, bucket string, name string, start bigint")
