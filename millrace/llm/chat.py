"""Chat formatting: schema fingerprints choose declarative mappings from many layouts to canonical turns.

A record is a struct of optional fields. The hash of its nested field paths selects how its turns are read; the turns are then
written with one template whose control strings cannot be forged by a text, and the bytes that count
for the loss are given as spans. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
_BLOCK = 256


@dataclass(frozen=True)
class Mapping:
    """A layout: the nested fields that make its fingerprint, those that may be missing, and SQL for its turns over ``_mr_r``."""

    name: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = ()

    def variants(self) -> list[str]:
        """Every set of paths that the layout may show, as ``paths_of`` writes them."""
        chosen = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [",".join(sorted({*self.paths, *c})) for c in chosen]


def _turns(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', coalesce({text}, ''))" for role, text in pairs) + ")"


_SPEAKER = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.`from`, '') END"
_TASK = "CASE WHEN coalesce(_mr_r.input, '') = '' THEN _mr_r.instruction ELSE concat(_mr_r.instruction, '\n\n', _mr_r.input) END"
MAPPINGS = (
    Mapping("messages", ("messages",), "transform(_mr_r.messages, m -> named_struct('role', coalesce(m.role, ''), 'text', coalesce(m.content, '')))", ("messages[].content", "messages[].role")),
    Mapping("conversations", ("conversations",), f"transform(_mr_r.conversations, m -> named_struct('role', {_SPEAKER}, 'text', coalesce(m.value, '')))", ("conversations[].from", "conversations[].value")),
    Mapping("prompt and completion", ("completion", "prompt"), _turns(("user", "_mr_r.prompt"), ("assistant", "_mr_r.completion"))),
    Mapping("prompt and response", ("prompt", "response"), _turns(("user", "_mr_r.prompt"), ("assistant", "_mr_r.response"))),
    Mapping("system, prompt and response", ("prompt", "response", "system"), _turns(("system", "_mr_r.system"), ("user", "_mr_r.prompt"), ("assistant", "_mr_r.response"))),
    Mapping("instruction", ("instruction", "output"), _turns(("user", _TASK), ("assistant", "_mr_r.output")), ("input",)),
)

#: Every field that a mapping reads; JSON is parsed with it, whatever its layout.
_TURN = lambda *names: T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("prompt", "completion", "response", "system", "instruction", "input", "output")]
    + [T.StructField("messages", _TURN("role", "content")), T.StructField("conversations", _TURN("from", "value"))]
)


def paths_of(record: Column, kind: T.DataType, path: str = "") -> list[Column]:
    """A column for each nested field of the schema: its path where the record has it, else null."""
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in paths_of(record[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    here = F.when(record.isNotNull(), F.lit(path))
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return [here]

    def inner(name: str) -> Column:
        return F.when(F.exists(record, lambda x: x[name].isNotNull()), F.lit(f"{path}[].{name}"))

    return [here, *(inner(f.name) for f in kind.elementType.fields)]


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def parse_records(json: Column) -> Column:
    """JSON of any layout as a record; what is malformed or not an object becomes null."""
    return F.from_json(json, RECORD, {"mode": "PERMISSIVE", "maxStringLen": "2147483647"})


def escape_text(text: Column) -> Column:
    """A bar after every '<|', so that no text holds a control string; ``unescape_text`` takes it out again."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape_text(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape_text(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _spans(pieces: Column) -> Column:
    """Byte spans (start, end) of the bodies to learn. Offsets add up block by block, so long chats stay cheap."""
    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pieces, b * _BLOCK + 1, _BLOCK))
    length = lambda p: (F.octet_length(p.head) + F.octet_length(p.body) + F.octet_length(F.lit(END))).cast("bigint")

    def inside(block):
        start = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(a, p):
            begin = a["at"] + F.octet_length(p.head)
            span = F.array(F.struct(begin.alias("start"), (begin + F.octet_length(p.body)).alias("end")))
            return F.struct((a["at"] + length(p)).alias("at"), F.when(p.learn, F.concat(a.spans, span)).otherwise(a.spans).alias("spans"))

        return F.aggregate(block, start, step)

    local = F.transform(blocks, inside)
    start = F.struct(zero.alias("at"), F.array().cast("array<array<struct<start:bigint,end:bigint>>>").alias("all"))

    def join(a, b):
        moved = F.transform(b.spans, lambda s: F.struct((s.start + a["at"]).alias("start"), (s.end + a["at"]).alias("end")))
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["all"], F.array(moved)).alias("all"))

    return F.flatten(F.aggregate(local, start, join)["all"])


def format_chats(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``layout``, ``schema_paths``, ``schema_hash``, ``formatted`` and ``loss_spans`` (byte offsets, end exclusive).

    ``record_col`` is a struct with the fields of RECORD (``parse_records`` makes one of JSON). Records that
    are null or of no known layout keep their row, with a null ``layout``, an empty ``formatted`` and no
    spans. A null role or text counts as empty. Every assistant text is learned. Texts may hold control
    strings: they are escaped, and ``read_chats`` gives them back as they were. Other columns pass through; input
    columns of the new names are replaced.
    """
    present = paths_of(F.col(record_col), records.schema[record_col].dataType)
    named = F.concat_ws(",", F.array_sort(F.filter(F.array(*present), lambda p: p.isNotNull())))
    parsed = records.withColumn("schema_paths", named).withColumn("schema_hash", fingerprint(F.col("schema_paths"))).withColumn("_mr_r", F.col(record_col))
    names, cases = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in reversed(mappings):
        chosen = F.lit(False)
        for paths in m.variants():
            chosen = chosen | (F.col("schema_hash") == fingerprint(F.lit(paths)))
        names = F.when(chosen, F.lit(m.name)).otherwise(names)
        cases = F.when(chosen, F.expr(m.turns)).otherwise(cases)
    turns = F.coalesce(cases, F.array().cast("array<struct<role:string,text:string>>"))
    read = parsed.withColumns({"layout": names, "_mr_turns": turns})
    head = lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"))
    pieces = F.transform("_mr_turns", lambda t: F.struct(head(t).alias("head"), escape_text(t.text).alias("body"), (t.role == "assistant").alias("learn")))
    laid = read.withColumn("_mr_pieces", pieces)
    whole = F.concat_ws("", F.transform("_mr_pieces", lambda p: F.concat(p.head, p.body, F.lit(END))))
    spans = F.when(F.size("_mr_pieces") > 0, _let(F.col("_mr_pieces"), _spans)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return laid.withColumns({"formatted": whole, "loss_spans": spans}).drop("_mr_r", "_mr_turns", "_mr_pieces")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text`` (all text under the spans, unescaped), read from the template alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    body = lambda s: F.substr(s, F.lit(len(START) + 1))

    def turn(s):
        return _let(
            F.struct(F.substring_index(body(s), "\n", 1).alias("role"), body(s).alias("all")),
            lambda x: F.struct(unescape_role(x.role).alias("role"), unescape_text(F.substr(x["all"], F.length(x.role) + 2)).alias("text")),
        )

    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
    whole = F.struct(F.col("formatted").cast("binary").alias("bytes"), F.col("loss_spans").alias("spans"))
    cut = lambda w: F.transform(w.spans, lambda s: unescape_text(F.substr(w.bytes, (s.start + 1).cast("int"), (s.end - s.start).cast("int")).cast("string")))
    return formatted.withColumns({"turns": turns, "loss_text": F.concat_ws("", _let(whole, cut))})


def records_from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One record a conversation from rows (key, turn, role, text), in the layout that holds it without loss.

    Rows go by turn, null first, then role and text. A pair of user and assistant becomes prompt and
    completion, with a system turn before them system, prompt and response, all else a list of messages.
    A null role or text becomes empty. A conversation is one value in the end, so its rows meet in one row.
    """
    clean = turns.select(F.col(key).alias("_mr_k"), F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = clean.groupBy("_mr_k").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    roles, text = F.transform("ts", lambda t: t.role), lambda i: F.col("ts")[i]["text"]
    messages = F.transform("ts", lambda t: F.struct(t.role.alias("role"), t.text.alias("content")))
    pair, task = roles == F.array(F.lit("user"), F.lit("assistant")), roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    fields = {
        "prompt": F.when(pair, text(0)).when(task, text(1)),
        "completion": F.when(pair, text(1)),
        "response": F.when(task, text(2)),
        "system": F.when(task, text(0)),
        "messages": F.when(~pair & ~task, messages),
    }
    record = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields])
    return grouped.select(F.col("_mr_k").alias(key), record.alias("record"))
