import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldledger.llm import ctw
from fieldledger.llm.common import fold
from pyspark.sql import functions as F


def lkt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)


def model(train, depth):
    """node (context, bits) -> counts; children by context; weights by recursion."""
    counts = defaultdict(lambda: [0, 0])
    below = defaultdict(set)
    for text in train:
        padded = ctw.END * depth + text
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                context = padded[i - d:i]
                prefix = 1
                for k in range(7, -1, -1):
                    bit = padded[i] >> k & 1
                    counts[context, prefix][bit] += 1
                    if d < depth:
                        below[context, prefix].add((padded[i - d - 1:i], prefix))
                    prefix = prefix * 2 + bit
    known = {}

    def weighted(node):
        if node not in known:
            own = lkt(*counts.get(node, (0, 0)))
            if len(node[0]) == depth:
                known[node] = (own, 1.0)
            else:
                rest = sum(weighted(x)[0] for x in below.get(node, ()))
                top = max(own, rest)
                both = top + math.log(math.exp(own - top) + math.exp(rest - top))
                known[node] = (both - math.log(2), math.exp(own - both))
        return known[node]

    def p_one(context, prefix, d=0):
        node = (context[depth - d:], prefix)
        a, b = counts.get(node, (0, 0))
        own = (b + .5) / (a + b + 1)
        if d == depth:
            return own
        stop = weighted(node)[1]
        return stop * own + (1 - stop) * p_one(context, prefix, d + 1)

    def score(text):
        padded, total = ctw.END * depth + text, 0.0
        for i in range(depth, len(padded)):
            prefix = 1
            for k in range(7, -1, -1):
                bit = padded[i] >> k & 1
                p = p_one(padded[i - depth:i], prefix)
                total += math.log10(p if bit else 1 - p)
                prefix = prefix * 2 + bit
        return total

    return score


TEXTS = ["the cat sat on the mat", "The cat\tsat on a  hat", "the dog sat", None, "", "dogs and cats and dogs", "unheard wörds zzz",
         "the cat sat on the mat", "a rat ate that " * 30, "Completely other", "the mat", "cat cat"]


@pytest.mark.parametrize("hot", [True, False])
def test_against_plain_recursion(spark, monkeypatch, hot):
    if not hot:
        monkeypatch.setattr(ctw, "HOT_WORDS", 2)
        monkeypatch.setattr(ctw, "HOT_GRAMS", 3)
        monkeypatch.setattr(ctw, "HELD", 20)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    depth = 2
    got = {r["doc_id"]: r for r in ctw.scores(docs, fold(F.col("doc_id"), 3) != 0, depth=depth).collect()}
    held = {r[0]: r[1] for r in docs.select("doc_id", fold(F.col("doc_id"), 3) == 0).collect()}
    texts = {i: ctw.normal(t) for i, t in enumerate(TEXTS)}
    train = [t for i, t in texts.items() if not held[i]]
    assert 0 < len(train) < len(TEXTS)
    score = model(train, depth)
    c = Counter(w for t in train for w in [*t.split(), b"\n"])
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r, words = got[i], [*t.split(), b"\n"]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(words), n)
        assert r["n_known"] == sum(c[w] > 0 for w in words) and r["n_bytes"] == len(t)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in words), rel=1e-9)
        assert r["score"] == pytest.approx(score(t), rel=1e-7)
    assert len(got) == len(TEXTS)


def test_no_training_rows_empty_table_repeated_rows(spark):
    schema = "doc_id long, text string, n long, gram string"
    docs = spark.createDataFrame([(1, "ab", 1, "x")] * 2, schema)
    for r in ctw.scores(docs, F.lit(False)).collect():
        assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0
        assert r["score"] == pytest.approx(3 * 8 * math.log10(.5))
    assert ctw.scores(docs, F.lit(True)).count() == 2
    assert ctw.scores(spark.createDataFrame([], schema), F.lit(True)).count() == 0


def test_log_gamma():
    x = np.array([.5, 1, 1.5, 3, 10.5, 1e4, 1e8])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-8)


def test_hot_table(monkeypatch):
    monkeypatch.setattr(ctw, "SLOTS", 8)
    draw = np.random.default_rng(1)
    gram = draw.choice(1 << 40, 400, replace=False).astype(np.uint64)
    value = draw.normal(size=400)
    keys, values = ctw.hot_table(gram, value)
    hit, found = ctw.looked_up(np.append(gram, np.uint64(5)), keys, values)
    assert not hit[-1] and hit[:15].all() and 128 < hit.sum() <= 256
    assert np.allclose(found[:-1], np.where(hit[:-1], value, 0))


def test_default_depth_mixes_contexts_of_5_bytes(spark):
    train = ["abcdex", "zbcdey"] * 5  # the last byte follows from the fifth before it
    docs = spark.createDataFrame(list(enumerate([*train, "abcdex", "abcdey"])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.scores(docs, F.col("doc_id") < len(train)).collect()}
    score = model([ctw.normal(t) for t in train], 5)
    assert got[10] == pytest.approx(score(b"abcdex\n"), rel=1e-7) and got[11] == pytest.approx(score(b"abcdey\n"), rel=1e-7)
    assert got[10] > got[11]


def test_grams_per_text_whatever_fits_one_number():
    """Text and gram as one number, in runs of texts where they do not fit, against plain counting."""
    draw = np.random.default_rng(4)
    owner = np.sort(draw.integers(0, 9, 400))
    gram = draw.integers(0, 6, 400).astype(np.uint64)
    want = Counter(zip(owner.tolist(), gram.tolist()))
    for bits in (48, 62, 63, 64):
        g, o, n = ctw.per_text(gram, owner, 9, bits)
        assert list(zip(o.tolist(), g.tolist())) == sorted(want) and dict(zip(zip(o.tolist(), g.tolist()), n.tolist())) == want
    assert [len(x) for x in ctw.per_text(gram[:0], owner[:0], 9, 48)] == [0, 0, 0]
