import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import LONG, ODD, frame
from tokenizers import Tokenizer

from normlake.llm import bpe_codec
from normlake.llm.bpe_codec import Chunks, assemble, codec, decode, encode

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
WORDS = ["the", "quick", "don't", "we'll", "I've", "  ", "\n\n", "\t", " \n ", "!!!", "...", "123", "4567", "日本語", "Ünïcode", "🙂", "<|endoftext|>", "<|endof", "text|>", "<|", " ", "　",
         "'", "'s", "'re", "x" * 300, " " * 50, "é", "\x00"]


def plain(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def assembled(texts, tool):
    chunks = Chunks(pa.chunked_array([texts], pa.string()))
    hashes = np.unique(chunks.hashes)
    codes = chunks.encode(tool, hashes)
    flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32)
    ids, size = assemble(tool, chunks, hashes, flat, np.array([len(c) for c in codes], dtype=np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])], chunks


def made(r, n=200, longest=400):
    shared = ["".join(r.choice(WORDS) + r.choice(["", " "]) for _ in range(300)) for _ in range(3)]
    out = []
    for _ in range(n):
        t = "".join(r.choice(WORDS) + r.choice(["", " ", " "]) for _ in range(r.randint(0, longest)))
        out.append(t + r.choice(shared)[r.randint(0, 200):] + t[: r.randint(0, 50)] if r.random() < 0.5 else t)
    return out


@pytest.mark.parametrize("bits,least", [(10, 128), (6, 1), (4, 1), (3, 40)])
def test_joins_are_exact(monkeypatch, bits, least):
    """Also with cuts so dense that windows hold several chunks and chunks are shorter than a word."""
    monkeypatch.setattr(bpe_codec, "BITS", bits)
    monkeypatch.setattr(bpe_codec, "LEAST", least)
    texts = made(random.Random(bits)) + ["", "a" * 5000, " " * 5000, "\n" * 3000 + "x", "ab" * 4000, "<|endoftext|>" * 300, "' " * 2000 + "'re" * 1000, LONG]
    got, chunks = assembled(texts, codec(PATH))
    assert got == plain(texts)
    assert bits > 9 or len(chunks.first) > 20 * len(texts) / least


def test_shared_passages_make_equal_chunks():
    r = random.Random(4)
    passage = " ".join(f"word{r.randint(0, 5000)}" for _ in range(3000))
    one, two = (set(Chunks(pa.chunked_array([[p + passage]])).hashes.tolist()) for p in ("", "other words in front "))
    assert len(one & two) >= 0.8 * len(one) and len(one) > 10


def test_equal_hashes_of_other_chunks_do_no_harm(monkeypatch):
    monkeypatch.setattr(bpe_codec, "_hash_piece", lambda data, first, last: np.arange(len(first), dtype=np.uint64) % np.uint64(7))
    texts = made(random.Random(9), 40, 1500)
    assert assembled(texts, codec(PATH))[0] == plain(texts)


def test_rows(spark):
    texts = made(random.Random(2), 60, 800)
    rows = [(i, t.replace("\x00", ""), "en", "s") for i, t in enumerate(texts)] + [(100 + i, texts[3].replace("\x00", ""), "en", "s") for i in range(80)]
    got = {r["doc_id"]: r for r in decode(encode(frame(spark, rows), PATH), PATH).collect()}
    assert len(got) == len(rows)
    for (doc_id, text, *_), ids in zip(rows, plain([t for _, t, *_ in rows])):
        assert got[doc_id]["ids"] == ids and got[doc_id]["n_tokens"] == len(ids) and got[doc_id]["decoded"] == text


def test_bytes_and_text_at_once(odd):
    plainly = {(str(r["doc_id"]), r["n_tokens"], np.array(r["ids"], dtype="<u4").tobytes(), r["decoded"]) for r in decode(encode(odd, PATH), PATH).collect()}
    assert {(str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in encode(odd, PATH, as_bytes=True, with_text=True).collect()} == plainly


def test_odd_rows(odd):
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in decode(encode(odd, PATH), PATH).collect())
    assert got == sorted((str(i), ids, t or "") for (i, t, *_), ids in zip(ODD, plain([t or "" for _, t, *_ in ODD])))


def test_empty_table(nothing):
    assert decode(encode(nothing, PATH), PATH).collect() == []


def test_decode_as_the_library(spark):
    library, r = Tokenizer.from_file(PATH), random.Random(6)
    lists = [[r.randint(0, 50_256) for _ in range(r.randint(0, 40))] for _ in range(300)] + [[50_256, 1, 50_256], []]
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate(lists)] + [(-1, None), (-2, [70_000, -3, 1])], "n int, ids array<int>")
    got = {row["n"]: row["decoded"] for row in decode(df, PATH).collect()}
    assert got.pop(-1) == "" and got.pop(-2) == library.decode([1], skip_special_tokens=False)
    assert [got[i] for i in range(len(lists))] == [library.decode(ids, skip_special_tokens=False) for ids in lists]


def test_both_libraries_agree_on_settled_texts():
    """Every character that is left to tiktoken, among letters, digits, signs and blanks; and long words of random letters."""
    tool, r = codec(PATH), random.Random(8)
    settled = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and not bpe_codec._UNSETTLED.search(chr(c))]
    texts = [f"a{c}1{c} {c}b {c}{c}!{c}\n{c} 'll{c}'s {c} 2{c}z" for c in settled]
    texts += ["".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 300))) for _ in range(3000)]
    assert tool.plain is not None and all(tool._settled(t) for t in texts)
    assert [ids.tolist() for ids in tool.encode(texts)] == plain(texts)


def test_other_kinds_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        codec(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
