import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldledger.llm import count_viterbi as C, gumbel_sampling as G, unigram as U

VOCAB = U.vocabulary(U.default_model())
TEXTS = [None, "", "a", "hello world", "two  spaces", "line\nfeed\n\n end ", "ünï 😀 漢字 x", "▁sign", "tab\tand nul \x00 in",
         "the quick brown fox " * 40, "averyverylongwordwithoutanyspace" * 60]


def reference():
    """The same vocabulary in a public unigram tokenizer."""
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), *zip(VOCAB.pieces, VOCAB.scores.tolist())]
    vocab += [(f"<0x{b:02X}>", float(VOCAB.scores.min())) for b in range(256)]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


REFERENCE = reference()


def tokens_of(text):
    return len(REFERENCE.encode((" " + text).replace(" ", U.SPACE), add_special_tokens=False).ids) if text else 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_counts_are_the_tokenizers(text):
    assert C.counted([text], C.Counts(VOCAB))[0][0] == tokens_of(text)


def test_counts_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    for r in C.token_counts(docs).collect():
        assert r["n_tokens"] == tokens_of(texts[r["doc_id"]] or "")


def test_ties_take_the_earliest_start():
    vocab = U.Vocabulary([(10, "a"), (11, "b"), (12, "ab"), (13, "ba"), (14, "aba")], list(range(256)))
    vocab.scores = np.array([-2.0, -2.0, -3.0, -3.0, -5.0])
    # aba: a+ba, ab+a and aba all cost 5; the last piece that starts first wins
    score, count, _ = U.best_paths(U.lattice(vocab, ["aba", "abab"]))
    assert score.tolist() == [-5.0, -6.0] and count.tolist() == [1, 2]


def test_cases_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_tokens string")
    got = [tuple(r)[:2] for r in C.token_counts(docs).collect()]
    assert sorted(got) == sorted([(i, tokens_of(t or "")) for i, t in enumerate(TEXTS)] * 2)
    assert C.token_counts(docs.limit(0)).count() == 0


def segmentations(vocab, text, alpha):
    """All segmentations of a short text with their probabilities."""
    whole = (" " + text).replace(" ", U.SPACE)
    known = {p: k for k, p in enumerate(vocab.pieces)}
    out = {}

    def go(at, ids, score):
        if at == len(whole):
            out[tuple(ids)] = score
            return
        single = whole[at] in known
        for end in range(at + 1, len(whole) + 1):
            k = known.get(whole[at:end])
            if k is not None:
                go(end, [*ids, int(vocab.ids[k])], score + alpha * vocab.scores[k])
        if not single:
            go(at + 1, [*ids, *(int(vocab.byte_ids[b]) for b in whole[at].encode())], score + alpha * vocab.unknown)

    go(0, [], 0.0)
    total = math.log(sum(math.exp(s) for s in out.values()))
    return {k: s - total for k, s in out.items()}


@pytest.mark.parametrize("text", ["tenö", "at to"])
def test_samples_follow_the_distribution(text):
    alpha, n = 0.3, 6000
    exact = segmentations(VOCAB, text, alpha)
    found = G.sampled(VOCAB, [text] * n, [7919 * i + 1 for i in range(n)], 3, alpha)
    first, pairs, inclusion = {}, {}, {}
    for samples in found:
        keys = [tuple(s["ids"].tolist()) for s in samples]
        assert len(set(keys)) == 3 and all(s["log_prob"] == pytest.approx(exact[k], abs=1e-9) for s, k in zip(samples, keys))
        assert samples[0]["perturbed"] > samples[1]["perturbed"] > samples[2]["perturbed"]
        first[keys[0]] = first.get(keys[0], 0) + 1
        pairs[tuple(keys[:2])] = pairs.get(tuple(keys[:2]), 0) + 1
        for s, k in zip(samples, keys):  # inverse inclusion weights estimate a count of 1 for every segmentation
            inclusion[k] = inclusion.get(k, 0) + 1 / s["inclusion"]
    for k, lp in exact.items():
        p = math.exp(lp)
        assert abs(first.get(k, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        if p > .02:
            assert inclusion[k] / n == pytest.approx(1, abs=.25)
    for a, b in itertools.permutations(list(exact)[:12], 2):  # without replacement: p(a) p(b) / (1 - p(a))
        p = math.exp(exact[a]) * math.exp(exact[b]) / (1 - math.exp(exact[a]))
        assert abs(pairs.get((a, b), 0) / n - p) < 5 * math.sqrt(p / n) + 2e-3


def test_all_segmentations_are_found_once():
    for text in ("at", "at tö a"):
        exact = segmentations(VOCAB, text, 1.0)
        [samples] = G.sampled(VOCAB, [text], [5], 5000, 1.0)
        found = {tuple(s["ids"].tolist()): s["log_prob"] for s in samples}
        assert set(found) == set(exact) and len(samples) == len(exact)
        assert all(v == pytest.approx(exact[k], abs=1e-9) for k, v in found.items())
        assert all(s["inclusion"] == 1 for s in samples)


def test_round_trip_and_seeds(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, sample int")
    one = G.decode(G.sample(docs.repartition(1))).collect()
    two = G.decode(G.sample(docs.repartition(5))).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    texts = {i: (t or "").replace(U.SPACE, " ") for i, t in enumerate(TEXTS)}
    assert all(r["text"] == texts[r["doc_id"]] for r in one) and len(one) > 4 * len(TEXTS) - 12
    assert G.sample(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_decode_inverts(text):
    for s in next(G.sampled(VOCAB, [text], [1], 3, .5)):
        assert VOCAB.decode(s["ids"].tolist()) == text.replace(U.SPACE, " ")


def test_tree_finds_what_the_automaton_finds():
    draw = random.Random(3)
    pieces = sorted({"".join(draw.choices("ab▁é😀", k=draw.randrange(1, 7))) for _ in range(300)})
    vocab = U.Vocabulary(list(enumerate(pieces)), list(range(1000, 1256)))
    for joined in ("", "a", "\x00", "".join(draw.choices("ab▁é😀\x00x", k=5000))):
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        assert sorted(zip(*map(np.ndarray.tolist, vocab.found(codes)))) == sorted(zip(*map(np.ndarray.tolist, vocab.matches(joined))))
