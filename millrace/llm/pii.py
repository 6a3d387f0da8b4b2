"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every scan is linear in the text: the patterns are possessive or start at a fixed sign, so long runs of
digits or letters cost nothing extra.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of kinds at one start. The first four are always kept; the others need a score of THRESHOLD.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
THRESHOLD = 0.5
REACH = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: kind: (score of a confirmed span, whole words that raise it, whole words that lower it)
CONTEXT = {
    "email": (0.9, ("mail", "email", "contact", "kontakt", "write", "correo", "courriel"), ("example",)),
    "ip": (0.5, ("ip", "host", "address", "server", "login"), ("version", "release", "section")),
    "card": (0.7, ("card", "visa", "credit", "karte", "kreditkarte", "tarjeta", "carte", "payment"), ("isbn", "order", "serial")),
    "phone": (0.6, ("phone", "telephone", "call", "tel", "mobile", "fax", "telefon"), ("isbn", "order", "serial")),
    "iban": (0.7, ("iban", "bank", "account", "konto", "cuenta", "compte"), ("serial", "sku")),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    """Leftmost matches, found from the '@': what precedes it back to the last match or the first other sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def _ibans(text: str):
    """The longest part of a match that mod-97 confirms, ending where a word ends; then on from its end, or else from the next start."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        end = m.end()
        while end > m.start():
            whole = text[m.start() : end].replace(" ", "")
            if len(whole) < 15:
                break
            if mod97(whole):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


_WORD = re.compile(r"[^\W\d_]+")


def _words_near(text: str, start: int, end: int) -> set[str]:
    """Whole words, lower-cased, within REACH of a span; a word that the reach cuts is read to its end."""
    left, right = max(0, start - REACH), min(len(text), end + REACH)
    while left > 0 and start - left < 2 * REACH and text[left - 1].isalpha():
        left -= 1
    while right < len(text) and right - end < 2 * REACH and text[right].isalpha():
        right += 1
    return set(_WORD.findall(f"{text[left:start]} {text[end:right]}".lower()))


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's own score, 0.2 more beside a word that raises it, 0.3 less beside one that lowers it, 0 to 1."""
    base, good, bad = CONTEXT[kind]
    near = _words_near(text, start, end)
    if not near.isdisjoint(good):
        base += 0.2
    if not near.isdisjoint(bad):
        base -= 0.3
    return round(min(1.0, max(0.0, base)), 2)


def spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, number of kind, end, score) in code points, sorted; base kinds always, others from THRESHOLD."""
    found = []
    for n, kind in enumerate(KINDS) if text else ():
        for start, end in _FINDERS[kind](text):
            s = score(kind, text, start, end)
            if kind in BASE or s >= THRESHOLD:
                found.append((start, n, end, s))
    return sorted(found)


def redact(text: str | None) -> str | None:
    """Spans that overlap become one mark, that of the first kind; spans that only touch keep a mark each."""
    found = spans(text)
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        start, kind, end, _ = found[i]
        i += 1
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


@F.arrow_udf(SPAN_TYPE)
def _span_column(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": KINDS[n], "start": a, "end": b, "score": s} for a, n, b, s in spans(t.as_py())] for t in texts]
    return pa.array(rows, type=_SPAN)


@F.arrow_udf(T.StringType())
def _redacted_column(texts: pa.Array) -> pa.Array:
    return pa.array([redact(t.as_py()) for t in texts], type=pa.string())


def personal_data(text: Column) -> Column:
    """Spans of a text (kind, start, end, score), by start and kind; a null or empty text has none.

    Equal texts have equal spans, whole texts are read however long they are, and an empty table gives an empty column.
    A column function: columns beside it, of whatever name, are not looked at.
    """
    return _span_column(text)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts with a mark in place of every span. Null stays null; ``n_chars``, if there, follows the text.

    Rows stay as many as they are, repeated ones too, an empty table stays empty; other columns, also ones named
    ``spans`` or ``kind``, pass through.
    """
    cleaned = docs.withColumn(text_col, _redacted_column(F.col(text_col)))
    return cleaned.withColumn("n_chars", F.length(text_col).cast("bigint")) if "n_chars" in docs.columns else cleaned


def span_list(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")
