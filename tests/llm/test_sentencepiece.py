import os
import random
import struct

import pytest
from conftest_llm import ODD, frame
from normlake.llm import sentencepiece_codec as codec

pytestmark = pytest.mark.skipif(not os.path.exists(codec.MODEL), reason="no model file")


def reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


def texts():
    r = random.Random(9)
    return ["", " ", "  ", "a  b", " lead", "trail ", "\n\t x", "日本語 テキスト", "\U0001f642 x", "\x00", "a" * 4000, "a▁b"] + ["".join(r.choice("ab 1é日\n\U0001f642.▁") for _ in range(r.randint(0, 60))) for _ in range(500)]


def test_pieces_and_round_trip(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts())]
    encoded = codec.encode(frame(spark, rows)).cache()
    own = {r.doc_id: r for r in encoded.collect()}
    for (i, text, *_), ids in zip(rows, reference().encode(texts())):
        assert list(own[i].ids) == ids and own[i].parity and own[i].n_tokens == len(ids)
        assert own[i].round_trip == ("▁" not in text)
    back = {r.doc_id: r.text for r in codec.decode(encoded).collect()}
    assert all(back[i] == text for i, text, *_ in rows if "▁" not in text)


def test_odd_rows(odd, nothing):
    got = codec.encode(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ODD) and all(r.parity and r.round_trip for r in got)
    assert codec.encode(nothing).collect() == [] and codec.decode(codec.encode(nothing)).collect() == []


def test_whole_texts_give_the_same(spark):
    loaded = codec._loaded(codec.MODEL, 1)
    whole, word = codec.ByText(*loaded), codec.ByWord(*loaded)
    some = texts()[:80]
    a, b = whole.encode(some), word.encode(some)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2, len(value)]) + value


def test_unigram_model_against_the_reference():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in
              (("▁", -3.0), ("a", -2.5), ("b", -2.6), ("c", -4.0), ("ab", -2.9), ("▁a", -2.2), ("bc", -3.1), ("▁abc", -6.5), ("cab", -5.0))]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    raw += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    model = codec.read_model(raw)
    assert model.kind == codec.UNIGRAM and len(model.pieces) == len(pieces)
    tokenizer, ref = codec.build(model), sentencepiece.SentencePieceProcessor(model_proto=raw)
    r = random.Random(1)
    for _ in range(300):
        text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4)))
        assert tokenizer.encode(text, add_special_tokens=False).ids == ref.encode(text), text
