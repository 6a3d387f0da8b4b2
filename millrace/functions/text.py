"""Column functions over text and paths. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a truncated text carries between head and tail, and the share of the head.
MARKER = "\n... [truncated] ...\n"
HEAD_SHARE = 0.7
#: Every sign that ends a line for Python's splitlines.
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85  "


def strip(text: Column) -> Column:
    """Without white space at both ends, as Python strips it (Unicode, and U+001C to U+001F)."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def strip_ascii(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def normalised_newlines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")


def without_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("﻿")), F.substr(text, F.lit(2))).otherwise(text)


def insufficient(text: Column) -> Column:
    """Empty, or white space only, after one leading byte order mark."""
    return F.coalesce(F.length(strip(without_bom(text))) == 0, F.lit(True))


def bounded_chars(text: Column, ceiling: int) -> Column:
    """Number of characters, exact only where the bytes exceed the ceiling: below, the cheap upper bound does."""
    return F.when(F.octet_length(text) <= ceiling, F.octet_length(text)).otherwise(F.length(text))


def truncated(text: Column, most: int, head_share: float = HEAD_SHARE, marker: str = MARKER) -> Column:
    """Head, marker and tail within ``most`` characters; a text that fits stays as it is."""
    budget = most - len(marker)
    if budget <= 0:
        return F.when(F.length(text) <= most, text).otherwise(F.lit(marker[:most]))
    head = int(budget * head_share)
    tail = budget - head
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(head)), F.lit(marker), F.right(text, F.lit(tail))))


def tokens(chars: Column) -> Column:
    """Estimate of four characters a token: 0 for nothing, 1 at least."""
    return F.when(chars == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((chars + 3) / 4))).cast("bigint")


def lines(text: Column) -> Column:
    """Lines with their ends, as Python's splitlines(keepends=True) gives them."""
    return F.regexp_extract_all(text, F.lit(f"[^{_BREAKS}]*(?:\\r\\n|[{_BREAKS}])|[^{_BREAKS}]+"), F.lit(0))


def posix(path: Column) -> Column:
    """Backslashes turned, empty and '.' parts dropped, '..' folded, never above the root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)

    def fold(done, part):
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def extension(path: Column) -> Column:
    """Lower-case suffix of the last part; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*?(\.[^./]+)$", 1))


def top_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("."))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def bounded(text: Column, most: int) -> Column:
    """Stripped, null when empty, cut to ``most`` after stripping."""
    return F.left(F.nullif(strip_ascii(text), F.lit("")), F.lit(most))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def domain_id(domain: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{domain}_"), digest(*parts))
