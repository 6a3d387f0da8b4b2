"""SentencePiece models on the tokenizers library: encoding and decoding of whole texts.

The model file is read field by field (it is a protocol buffer), and the normaliser, the metaspace sign,
the scores and the byte fallback are rebuilt. Byte-pair models get their merges from the scores of the
pieces, unigram models their scores as they are.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters encoded at a time in one call of the library.
CHARS = 1 << 20
#: Units (words with the spaces before them) remembered by a worker.
UNITS = 200_000
THREADS = 2


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message; groups do not occur in these files."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"field of wire type {kind}")
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """Fixed field numbers: ModelProto 1 pieces (1 piece, 2 score, 3 type), 2 trainer (3 model type, 35 byte
    fallback, 40 unknown id), 3 normaliser (2 charsmap, 3 dummy prefix, 4 squeeze spaces, 5 escape spaces)."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            model.pieces.append(own.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            model.kinds.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(_fields(value))
            model.algorithm = own.get(3, UNIGRAM)
            model.byte_fallback = bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(own.get(n, 1)) for n in (3, 4, 5))
    unknown = [i for i, k in enumerate(model.kinds) if k == UNKNOWN]
    model.unknown = unknown[0] if unknown else 0
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every pair of pieces that makes a piece, by the piece's score, best first; pairs of one piece by their ids."""
    ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.scores[i], i, left, right))
    return [(model.pieces[a], model.pieces[b]) for _, _, a, b in sorted(found)]


def splits_at_spaces(model: Model) -> bool:
    """Whether no piece goes on with a space after another sign: then words, each with the spaces before it, stand alone."""
    return not any(SPACE in p.lstrip(SPACE) for p in model.pieces)


def build(model: Model):
    """A tokenizer of the tokenizers library with the model's ids."""
    import tokenizers as t

    vocabulary = list(zip(model.pieces, model.scores, strict=True))
    if model.algorithm == UNIGRAM:
        core = t.models.Unigram(vocabulary, model.unknown, model.byte_fallback)
    elif model.algorithm == BPE:
        ids = {p: i for i, p in enumerate(model.pieces)}
        core = t.models.BPE(vocab=ids, merges=merges(model), unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.algorithm}")
    tokenizer = t.Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(t.normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [t.normalizers.Strip(), t.normalizers.Replace(t.Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(t.normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(t.normalizers.Replace(" ", SPACE))
    tokenizer.normalizer = t.normalizers.Sequence(steps)
    if splits_at_spaces(model):
        tokenizer.pre_tokenizer = t.pre_tokenizers.Split(t.Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    ending = [t.decoders.Replace(SPACE, " ")] if model.escape else []
    ending += [t.decoders.ByteFallback(), t.decoders.Fuse()]
    if model.dummy_prefix:
        ending.append(t.decoders.Strip(" ", 1, 0))
    tokenizer.decoder = t.decoders.Sequence(ending)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHARS signs, so that what the library holds is bounded by that or one text."""
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


_RUNS = re.compile(" +[^ ]*")
_JOINED = 4096


def _units(text: str) -> list[str]:
    """A text with its dummy prefix, cut before each run of spaces; each unit without its first space."""
    if "  " in text or text.startswith(" "):
        return [u[1:] for u in _RUNS.findall(" " + text)]
    return text.split(" ") if text else []


class Coder:
    """Encodes and decodes with a model.

    Where no piece spans a space, the words of a text, each with the spaces before it, are independent:
    every unit is encoded once, many in one call, and remembered. Other models encode whole texts. The ids
    of every whole text are compared with those that the sentencepiece library gives for it.
    """

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = model = parse(data)
        self.tokenizer = build(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_unit = splits_at_spaces(model) and model.dummy_prefix and model.escape and not model.squeeze and not model.charsmap and SPACE in model.pieces
        self.known: dict[str, bytes] = {}
        self.starts = np.array([p.startswith(SPACE) for p in model.pieces])
        self.plain = np.array([k in (NORMAL, USER, BYTE) for k in model.kinds])
        sign = " " if model.escape else SPACE
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, sign).encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.table = pa.array(raw, type=pa.binary())

    def _learn(self, units: list[str]) -> None:
        odd = [u for u in units if not u or SPACE in u or u.startswith(" ")]
        plain = [u for u in units if u and SPACE not in u and not u.startswith(" ")]
        groups = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        lines = [" ".join(g) for g in groups]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<i4")
            cuts = np.append(np.flatnonzero(self.starts[ids]), len(ids)) * 4
            raw = ids.tobytes()
            if len(cuts) != len(group) + 1:
                odd += group
                continue
            self.known.update(zip(group, [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], strict=True))
        for unit, coded in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            ids = coded.ids if unit else [self.model.pieces.index(SPACE)]
            self.known[unit] = np.array(ids, dtype="<i4").tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids of all texts, where each text's end, and whether the sentencepiece library gives the same."""
        values, ends = self.ids(texts)
        return values, ends, self.parity(texts, values, ends)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's end."""
        if not self.by_unit:
            rows = [np.array(c.ids, dtype="<i4").tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            if len(self.known) > UNITS:
                self.known.clear()
            units = [_units(t) for t in texts]
            self._learn([u for u in {u for r in units for u in r} if u not in self.known])
            known = self.known
            rows = [b"".join([known[u] for u in row]) for row in units]
        ends = np.cumsum([0, *map(len, rows)]) // 4
        return np.frombuffer(b"".join(rows), dtype="<i4"), ends.astype(np.int32)

    def parity(self, texts: list[str], values: np.ndarray, ends: np.ndarray) -> list[bool]:
        """Whether the sentencepiece library gives the same ids for each whole text."""
        said = self.library.encode(texts, num_threads=THREADS)
        return [np.array_equal(np.array(ids, dtype="<i4"), values[a:b]) for ids, a, b in zip(said, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, values: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids. Pieces are looked up and joined in Arrow; rows with special ids or broken characters go through the tokenizer."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.table.take(pa.array(values))), b"").to_pylist()
        special = np.flatnonzero(~self.plain[values])
        slow = set(np.searchsorted(ends, special, side="right") - 1) if len(special) else set()
        texts = []
        for i, raw in enumerate(joined):
            try:
                if i in slow:
                    raise UnicodeError
                texts.append((raw[1:] if self.model.dummy_prefix and raw.startswith(b" ") else raw).decode())
            except UnicodeError:
                texts.append(self.tokenizer.decode(values[ends[i] : ends[i + 1]].tolist(), skip_special_tokens=False))
        return texts


@lru_cache(maxsize=2)
def coder(data: bytes) -> Coder:
    return Coder(data)


_IDS = T.ArrayType(T.IntegerType())
_CODED = T.StructType([T.StructField("ids", _IDS), T.StructField("roundtrip", T.BooleanType()), T.StructField("parity", T.BooleanType())])


def model_bytes(path: str) -> bytes:
    """Reads the model on the driver; it goes to the executors with the functions."""
    with open(path, "rb") as file:
        return file.read()


def encoded(text: Column, model: bytes) -> Column:
    """Token ids of a text; null gives null, an empty text no ids."""

    @F.arrow_udf(_IDS)
    def of(texts: pa.Array) -> pa.Array:
        parts = [coder(model).ids(part) for part in _portions([t or "" for t in texts.to_pylist()])]
        lists = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values, ends in parts] or [pa.array([], type=pa.list_(pa.int32()))])
        return pc.if_else(texts.is_null(), None, lists) if texts.null_count else lists

    return of(text)


def decoded(ids: Column, model: bytes) -> Column:
    """The text of token ids; null gives null."""

    @F.arrow_udf(T.StringType())
    def of(rows: pa.Array) -> pa.Array:
        lists = [r or [] for r in rows.to_pylist()]
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        texts = coder(model).decode(np.array([i for r in lists for i in r], dtype=np.int32), ends)
        return pa.array([t if ok else None for t, ok in zip(texts, rows.is_valid().to_pylist(), strict=True)], type=pa.string())

    return of(ids)


def coded(text: Column, model: bytes) -> Column:
    """Ids, whether decoding them gives the text again, and whether the sentencepiece library gives the same ids. Null counts as empty."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("roundtrip", pa.bool_()), ("parity", pa.bool_())])

    @F.arrow_udf(_CODED)
    def of(texts: pa.Array) -> pa.Array:
        ids, back, same = [pa.array([], type=pa.list_(pa.int32()))], [], []
        for part in _portions([t or "" for t in texts.to_pylist()]):
            values, ends, parity = coder(model).encode(part)
            back += [a == b for a, b in zip(part, coder(model).decode(values, ends), strict=True)]
            same += parity
            ids.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(back, type=pa.bool_()), pa.array(same, type=pa.bool_())], fields=list(kind))

    return of(F.coalesce(text, F.lit("")))


def tokenised(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens``, ``roundtrip`` (decoding gives the text again) and ``parity``.

    Null text counts as empty: no ids, a round trip to the empty text. Ids follow the text as it is: control
    strings in it are ordinary text. Input columns of those names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "roundtrip", "parity")]
    found = docs.withColumn("_mr_c", coded(F.col(text_col), model))
    return found.select(
        *kept,
        F.col("_mr_c.ids").alias("token_ids"),
        F.size("_mr_c.ids").cast("bigint").alias("n_tokens"),
        F.col("_mr_c.roundtrip").alias("roundtrip"),
        F.col("_mr_c.parity").alias("parity"),
    )
