import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm import sentencepiece as sp
from millrace.session import table

HARD = ["", " ", "   ", "a ", " a", "a  ", "  x  y ", "\n\t x", "😀 ünï\x00c", "a▁b", "▁▁ x", "<s> hi </s> <unk> <0x41>", "x" * 5000, "日本語テキスト", "a" + " " * 40 + "b", "\r\n\r\n", "é́\U0010ffff", "Word word  Word"]


@pytest.fixture(scope="module")
def model():
    return sp.model_bytes(queries.model_path())


def test_parsed_model_agrees_with_the_library(model):
    parsed, library = sp.parse(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert parsed.pieces == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert parsed.scores == [library.get_score(i) for i in range(library.get_piece_size())]
    assert parsed.algorithm == sp.BPE and parsed.byte_fallback and parsed.unknown == library.unk_id()


def test_ids_and_texts_agree_with_the_library(spark, sf, model):
    texts = HARD + [r.text for r in table(spark, sf, "documents").collect()]
    coder, library = sp.Coder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    values, ends, same = coder.encode(texts)
    want = library.encode(texts)
    assert [values[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want and all(same)
    back = coder.decode(values, ends)
    assert back == library.decode(want) == coder.tokenizer.decode_batch(want, skip_special_tokens=False)
    assert [t for t, b in zip(texts, back, strict=True) if t != b] == ["a▁b", "▁▁ x"]  # the sign for a space


def test_whole_texts_agree_with_units(spark, sf, model):
    texts = HARD + [r.text for r in table(spark, sf, "documents").limit(30).collect()]
    whole = sp.Coder(model)
    whole.by_unit = False
    a, b = whole.encode(texts), sp.Coder(model).encode(texts)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]


def test_special_ids_and_broken_characters(model):
    coder = sp.Coder(model)
    rows = [[1, 2, 0], [3 + 0xFF], [3 + 0xC3, 3 + 0xA9], []]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    got = coder.decode(np.array(sum(rows, []), dtype=np.int32), ends)
    assert got[2:] == ["é", ""] and got[1] == "�"


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += (bytes([number << 3]) if number < 16 else bytes([(number << 3 & 127) | 128, number >> 4])) + bytes([value])
    return out


def test_unigram_models():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.0, 1), ("b", -2.5, 1), ("ab", -1.5, 1), ("▁ab", -4.0, 1), ("a", -3.0, 1)]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1)))) + _message((3, _message((3, 1), (4, 0), (5, 1))))
    model = sp.parse(data)
    assert (model.algorithm, model.squeeze, model.dummy_prefix) == (sp.UNIGRAM, False, True)
    coder, library = sp.Coder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab a", "aab b", "b", ""]
    values, ends, same = coder.encode(texts)
    assert [values[x:y].tolist() for x, y in zip(ends, ends[1:], strict=False)] == library.encode(texts) and all(same)


def test_query_and_odd_rows(spark, sf, odd_docs, model):
    rows = queries.op1_sentencepiece(spark, sf).collect()
    assert len(rows) == 200 and all(r.roundtrip and r.parity and r.n_tokens == len(r.token_ids) for r in rows)
    out = sp.tokenised(odd_docs.withColumn("parity", F.lit("clash")), model).collect()
    assert len(out) == odd_docs.count() and all(r.roundtrip and r.parity is True for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert sp.tokenised(odd_docs.limit(0), model).count() == 0


def test_columns(spark, model):
    frame = spark.createDataFrame([(t,) for t in ["a b", None, ""]], "t string").withColumn("ids", sp.encoded(F.col("t"), model))
    rows = frame.withColumn("back", sp.decoded(F.col("ids"), model)).collect()
    assert [(r.ids is None, r.back) for r in rows] == [(False, "a b"), (True, None), (False, "")]
