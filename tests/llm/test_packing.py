import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldledger.llm import packing


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more).repartition(3)


def check(rows, pieces, window):
    tokenizer = packing.default_tokenizer()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    pieces = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    at = 0
    for p in pieces:  # the stream has no gap and no sequence is longer than the window
        assert p["sequence_id"] * window + p["offset"] == at
        assert p["offset"] + p["length"] <= window
        at += p["length"]
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for key, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[key], key=lambda p: p["start"])
        assert [p["start"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own])[:-1])
        assert sum(p["length"] for p in own) == len(ids) == own[0]["doc_tokens"]
        for p in own:
            cut = ids[p["start"]:p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    assert set(by_doc) == {k for k, _ in rows}


@pytest.mark.parametrize("window", [4, 1024])
def test_pieces(spark, window):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "long word " * 3000), (5, "Ünïcode <|endoftext|> x"), (6, "a b c")]
    rows += [(10 + i, f"text number {i} " * (i % 7)) for i in range(60)]
    out = packing.digests(packing.pack(frame(spark, rows), window=window)).collect()
    check(rows, [r.asDict() for r in out], window)


def test_empty_table_and_extra_columns(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "x", 5, 7)], "doc_id long, text string, start int, ids int")
    assert [r["length"] for r in packing.pack(docs).collect()] == [2]


def test_padding():
    assert [packing.padded_length(n) for n in (1, 3, 512, 700, 1024)] == [1, 1024, 512, 1024, 1024]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_tokenizer_file(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert packing.encoder(path)([text])[0] == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if text else True


def test_ids_on_documents(spark, sf):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r[0]]
    assert packing.encoder(path)(texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
