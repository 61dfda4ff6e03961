"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random
import struct

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from memspark.llm.piece_codec import Codec, encode_digest, encode_texts, read_vocabulary  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a" * 3000, "ab" * 2000, " " * 700, "=" * 333, "x" + " " * 37 + "y", "\x00", "\U0001f600" * 20, "▁▁", " \n ", "no space at end "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, text):
    ids = [1, *library.encode(text or ""), 2]
    return ids, library.decode(ids)


def test_random_texts_match_library(library):
    codec, rng = Codec(read_vocabulary(MODEL)), random.Random(7)
    bits = ["a", "b", "e", "th", " ", " ", "  ", "\n", "é", "ß", "▁", "中", "文", "\U0001f600", "\x00", "‍", "👍🏽", "1", "{}", "ing", "    ", "\t", "\r\n", "̈", "ﷺ", "--"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids, back = expected(library, text)
        coded = codec(text)
        assert list(struct.unpack(f"<{len(coded) // 4}I", coded)) == ids, repr(text[:80])
        assert codec.decode(coded) == back.encode()


def test_query_over_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in encode_digest(docs, MODEL).collect()}
    for doc in docs.collect():
        ids, back = expected(library, doc.text)
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(None, None, "i"), (1, "a b", None), (1, "a b", None), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_texts(df, MODEL).collect()
    assert len(out) == 4 and all(r.decoded == (r.text or "") for r in out)
    assert out[0].asDict()["ids"] == struct.pack("<2I", 1, 2)
    assert encode_texts(df.limit(0), MODEL).count() == 0


def test_very_long_runs_of_spaces(library):
    codec = Codec(read_vocabulary(MODEL))
    for text in (" " * 100_000, "x" + " " * 99_999 + "y", "x " + "▁" * 16_017, *(" " * n for n in range(25, 60))):
        coded = codec(text)
        assert list(struct.unpack(f"<{len(coded) // 4}I", coded)) == [1, *library.encode(text), 2]
        assert codec.decode(coded).decode() == library.decode(library.encode(text))
