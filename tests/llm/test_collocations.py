import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from fieldledger.llm import collocations as C
from fieldledger.llm.bitmap import bitmap, has


def plain(rows, support, most):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    gone = set()
    for (lang, p), f in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                if 100 * f >= 80 * found[lang, p[i:i + n]]:
                    gone.add((lang, p[i:i + n]))
    out = []
    for lang in {k[0] for k in found}:
        mine = []
        for (x, p), a in found.items():
            if x == lang and (x, p) not in gone:
                cuts = [(int(Fraction(2000000 * a, counts[x, p[:k]] + counts[x, p[k:]])), k) for k in range(1, len(p))]
                score, k = min(cuts)
                mine.append((-score, -a, " ".join(p).encode(), counts[x, p[:k]], counts[x, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, documents=120):
    draw = random.Random(seed)
    words = ["a", "B", "c", "É", "é", "dd", "e e", "\x1c", "x\x00y", "😀", "f"]
    rows = []
    for _ in range(documents):
        text = "".join(draw.choices(words, [30, 20, 10, 3, 3, 5, 2, 2, 2, 2, 9])[0] + draw.choice(["  ", " ", " ", "\t", " ", ". ", ",", "\n", "\r\n", " ;"])
                       for _ in range(draw.randrange(60)))
        rows.append((text, draw.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), (" \n,", "fr")] + [("The same line of words.", "en")] * 40


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")
    return sorted(map(tuple, C.collocations(docs.repartition(11), **more).collect()))


@pytest.mark.parametrize("support, most", [(5, 2000), (30, 7), (1, 50)])
def test_against_plain_counts(spark, monkeypatch, support, most):
    monkeypatch.setattr(C, "BLOCK", 300)
    rows = corpus(support)
    assert run(spark, rows, support=support, most=most) == plain(rows, support, most)


def test_full_bitmaps_add_candidates_only(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(C, "has", lambda whole, keys: np.ones(len(keys), bool))
    monkeypatch.setattr(C, "RANK_PARTS", 3)
    assert run(spark, rows, support=6) == plain(rows, 6, 2000)


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 50)
    rows = [(" ".join(f"w{i % 7}" + ("." if i % 11 == 0 else "") for i in range(20000)), "en"), ("long " * 30000, "de")]
    assert run(spark, rows) == plain(rows, 30, 2000)


def test_one_shard_may_hold_all_and_none(spark):
    rows = [("a b c d", "en")] * 29 + [("q r s", "de")] * 30
    assert run(spark, rows) == plain(rows, 30, 2000) and len(run(spark, rows)) == 1


def test_local_supports_sum_below_the_support(spark):
    totals = [("en", i, 13) for i in range(7)] + [("en", 7, 9), ("de", 0, 7)] + [("fr", i, 1) for i in range(60)]
    rows = C.local_supports(spark.createDataFrame(totals, "lang string, shard int, f long"), 30).collect()
    assert sorted(r["least"] for r in rows) == sorted([4] * 7 + [3] + [30] + [1] * 60) and len({r["cell"] for r in rows}) == len(totals)


def test_empty_table(spark):
    assert run(spark, [(None, None)]) == []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(docs).count() == 0


def test_large_products_are_exact(spark):
    a, f = 6_000_000_000_000_001, 9_000_000_000_000_003
    words = spark.createDataFrame([("en", b"a", f), ("en", b"b", f + 4)], "lang string, word binary, f long")
    phrases = spark.createDataFrame([("en", b"a b", 2, a)], "lang string, phrase binary, words int, a long")
    assert C.scored(words, phrases).first()["score"] == 2000000 * a // (2 * f + 4)


def test_bitmap_misses_no_key(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 3000)
    frame = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "key long")
    for bits in (4, 16, 22):
        whole = bitmap(frame, "key", bits)
        assert has(whole, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 3000).view(np.uint64)
    assert has(whole, other).mean() < 0.02


def test_blocks_hold_no_object_per_word():
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"word{i}" for i in range(200_000)).encode()
    tracemalloc.start()
    for batch in (pa.record_batch({"text": pa.array([text] * 3, pa.binary()), "lang": pa.array(["en", "de", "en"])}),):
        n = sum(len(b.key) for b in C.blocks(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / n
    tracemalloc.stop()
    assert n >= 600_000 and peak < 100


def test_texts_of_equal_keys_are_told_apart():
    words = [b"a", b"abcdefgh", b"abcdefghi", b"a\x00", "é".encode(), b"z" * 600, b"z" * 599 + b"y"]
    draw = random.Random(4)
    tokens = draw.choices(words, k=500)
    block = C.Block()
    block.add("en", b"  ".join(tokens[:250]) + b" \n ")
    block.add("de", b"a")
    block.add("en", b" " + b" ".join(tokens[250:]))
    block.close()
    (first, at), (second, rest) = block.by_language(np.flatnonzero(block.word))
    assert [block.names[first], block.names[second], len(at), len(rest)] == ["en", "de", 500, 1]
    for size in (1, 2):
        places = np.array([i for i in at if i + size <= len(block.word) and block.word[i:i + size].all() and i + size - 1 <= at[-1]])
        start, length, n = block.texts_of(places, np.zeros(len(places), np.uint64), size)
        got = Counter()
        for text, k in zip(C.gathered(block.data, start, length).to_pylist(), n.tolist()):
            got[text] += k
        assert got == Counter(b" ".join(x[i:i + size]) for x in (tokens[:250], tokens[250:]) for i in range(len(x) - size + 1))
    same = C.hashes(block.data, block.start, block.length)
    assert len(set(same[block.word].tolist())) == len(words)
