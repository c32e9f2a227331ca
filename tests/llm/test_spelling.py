import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldledger.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int"


def plain(rows, noise=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        if around[w]:
            best = min(around[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), words[form[w]] if w in form else None))
    return sorted(out)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, S.variants(docs, **more).collect()))


def corpus(seed):
    draw = random.Random(seed)
    letters = "abcdeéüÀ×ÿ"
    words = ["".join(draw.choices(letters, k=draw.randrange(6, 10))) for _ in range(40)]
    for w in list(words):
        for _ in range(6):
            at, c = draw.randrange(len(w)), draw.choice(letters)
            words.append(draw.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]]))
    weights = [draw.choice([1, 1, 2, 6, 30, 150]) for _ in words]
    rows = [(i, draw.choice([" ", "-", "Ā", "ß "]).join(draw.choices(words, weights, k=150))) for i in range(60)]
    return rows + [(None, words[0].upper()), (7, rows[7][1]), (8, None), (9, ""), (10, "aa aaaaaa " * 3000)]


@pytest.mark.parametrize("noise", [199, 3])
def test_against_all_pairs(spark, noise):
    rows = corpus(noise)
    want = plain(rows, noise)
    assert got(spark, rows, noise=noise) == want
    assert any(r[4] for r in want) and any(r[1] for r in want)


def test_few_symbols_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 20)
    monkeypatch.setattr(S, "has", lambda whole, keys: np.ones(len(keys), bool))
    monkeypatch.setattr(S, "TALLY", 10)
    rows = corpus(5)
    assert got(spark, rows) == plain(rows)


def test_chains_ties_and_empty(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    rows = [(i, " ".join([w] * 5**(k + 1))) for k, w in enumerate(chain) for i in (k,)]
    rows += [(20 + i, "zzzzzx zzzzzy " * 30 + "zzzzzz " * 6) for i in range(1)]
    want = plain(rows, 10**9)
    assert got(spark, rows, noise=10**9) == want
    found = {w: (form, root) for w, form, root, *_ in want}
    assert found["aaaaaa"] == ("aaaaab", "aaabbb") and found["zzzzzz"] == ("zzzzzx", "zzzzzx")
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []


def test_neighbourhoods_hold_each_string_once():
    draw = random.Random(1)
    for length in (1, 2, 5, 9):
        symbols = range(S.SYMBOLS)
        letter = {int(S._SYMBOL[c]): c for c in range(97, 123)}
        word = [letter[draw.choice(sorted(letter))] for _ in range(length)]
        w = tuple(int(S._SYMBOL[c]) for c in word)
        want = {w} | {w[:i] + w[i + 1:] for i in range(length)} | {w[:i] + (s,) + w[i + 1:] for i in range(length) for s in symbols}
        want |= {w[:i] + (s,) + w[i:] for i in range(length + 1) for s in symbols}
        keys = np.concatenate([k for _, k in S.neighbourhood(np.array([word], np.uint8))])
        assert len(keys) == len(want) == len(set(keys.tolist()))
        for i in range(length):  # what a neighbour is reduced to is in the neighbourhood
            for c in letter.values():
                for other in (word[:i] + [c] + word[i:], word[:i] + [c] + word[i + 1:]):
                    assert S.reduced(np.array([other], np.uint8))[0] in keys


def test_no_join_sends_a_side_whole(spark):
    """The files of a vocabulary take a few MB where its rows fill the driver's memory, so no side goes by the size of its files."""
    vocab = spark.createDataFrame([("aaaaaa", 30, 1), ("aaaaab", 6, 2)], "word string, n long, key long")
    docs = spark.createDataFrame([(1, "aaaaaa aaaaab " * 9, "x", 1)], SCHEMA)
    forms = spark.createDataFrame([("aaaaaa", "aaaaab", 3125), ("aaaaab", "aaaabb", 15625)], "word string, form string, form_n long")
    for made in (S.near_pairs(vocab), S.variants(docs), S.roots(forms)):
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
