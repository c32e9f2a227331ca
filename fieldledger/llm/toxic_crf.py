"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document, the field needs them per word. A cue is a character n-gram (with word
edges) that occurs in so many more toxic than clean training documents than chance allows, corrected for
the number of n-grams looked at; words of toxic documents that hold a cue are the labelled toxic tokens.
The field has two states; its emissions are the hashed n-grams of a word and the identities of its
neighbours. Forward-backward runs over whole texts: the words of many documents are one chain that starts
anew at each document, computed in blocks whose transfer matrices are combined.

A document's score is its largest marginal, calibrated on the training documents; offending offsets are
runs of words with marginal 0.5 or more.

Training rows: at most TOXIC and CLEAN documents of up to LONGEST characters, by hash of the key. Null and
empty texts have no span and the score of a marginal of 0. Without training rows of both classes all
scores are 0. Repeated rows are scored one by one. Clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mixed, slices, with_fields

TOXIC = 800
CLEAN = 3200
LONGEST = 8192
BITS = 17
ORDERS = (3, 4, 5, 6)
CUE_ORDERS = (4, 5, 6)
CUE_BITS = 22
WINDOW = 24
EPOCHS = 8
FLOOR = 1e-9
WORD = re.compile(r"[^ \t-\r]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; the n-grams cover what case and punctuation leave."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def grams(words: list[bytes], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash place) of every n-gram of each word between the edges ^ and $."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buffer = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8)
    size = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(len(buffer))  # bytes to the word's end, this one included
    rows, places = [], []
    gram = np.zeros(len(buffer), np.uint64)
    for order in range(1, max(orders) + 1):
        gram = gram[:len(buffer) - order + 1] * np.uint64(0x100000001B3) + buffer[order - 1:] + np.uint64(order)
        if order in orders:
            inside = left[:len(gram)] >= order
            rows.append(owner[:len(gram)][inside])
            places.append(mixed(gram[inside]) >> np.uint64(64 - bits))
    return np.concatenate(rows), np.concatenate(places).astype(np.int64)


def identities(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - BITS) for w in words), np.int64, len(words))


@dataclass
class Model:
    gram: np.ndarray        # toxic against clean, by n-gram place
    before: np.ndarray      # by identity of the word before
    after: np.ndarray       # by identity of the word after
    bias: float
    step: np.ndarray        # 2 x 2 log weights of (state, next state)
    calibration: tuple[float, float] = (1.0, 0.0)


def emissions(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct word: its own log weight, and what it adds to the next and to the previous word."""
    rows, places = grams(words)
    own = np.bincount(rows, model.gram[places], len(words)) + model.bias
    who = identities(words)
    return own, model.before[who], model.after[who]


def marginals(logits: np.ndarray, starts: np.ndarray, step: np.ndarray,
              block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) of each word, expected number of each pair of neighbouring states).
    logits: toxic against clean; starts: True at the first word of a document."""
    n = len(logits)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    rows = -(-n // block)
    pad = rows * block - n
    shift = np.append(logits, np.zeros(pad))
    top = np.maximum(shift, 0)
    emit = np.exp(np.stack([-top, shift - top], axis=1)).reshape(rows, block, 2)
    fresh = np.append(starts, np.ones(pad, bool)).reshape(rows, block)
    base = np.exp(step)
    # transfer[t] takes the message at t - 1 to t; a start forgets what came before
    move = np.broadcast_to(base, (rows, block, 2, 2)).copy()
    move[fresh] = 0.5
    into = move * emit[:, :, None, :]

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(axis=tuple(range(1, x.ndim)), keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(2), (rows, 2, 2))
    for t in range(block):
        product = scaled(product @ into[:, t])
    enter, leave = np.empty((rows, 2)), np.empty((rows, 2))
    message = np.full(2, 0.5)
    for r in range(rows):
        enter[r] = message
        message = message @ product[r]
        message = message / message.sum()
    message = np.ones(2)
    for r in range(rows - 1, -1, -1):
        leave[r] = message
        message = product[r] @ message
        message = message / message.sum()
    previous, forward, state = np.empty((rows, block, 2)), np.empty((rows, block, 2)), enter
    for t in range(block):
        previous[:, t] = state
        state = scaled((state[:, None, :] @ into[:, t])[:, 0])
        forward[:, t] = state
    backward, state = np.empty((rows, block, 2)), leave
    for t in range(block - 1, -1, -1):
        backward[:, t] = state
        state = scaled((into[:, t] @ state[:, :, None])[:, :, 0])
    both = forward * backward
    pairs = previous[..., :, None] * into * backward[..., None, :]
    pairs = pairs[~fresh]
    pairs = (pairs / np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
    return (both[:, :, 1] / np.maximum(both.sum(axis=2), 1e-300)).reshape(-1)[:n], pairs


def chain(model: Model, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of every word of all documents in order, offset of each document's first word, expected pairs)."""
    at: dict[bytes, int] = {}
    index = np.array([at.setdefault(w, len(at)) for words in documents for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in documents])]).astype(np.int64)
    if not len(index):
        return np.zeros(0), offsets, np.zeros((2, 2))
    own, before, after = emissions(model, list(at))
    logits = own[index]
    first = np.zeros(len(index) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    logits[1:] += np.where(first[1:], 0, before[index[:-1]])
    logits[:-1] += np.where(first[1:], 0, after[index[1:]])
    p, pairs = marginals(logits, first, model.step)
    return p, offsets, pairs


def cues(toxic: list[list[bytes]], clean: list[list[bytes]]) -> np.ndarray:
    """Which n-gram places (of CUE_ORDERS, hashed to CUE_BITS) occur in more toxic documents than chance allows."""

    def counted(documents: list[list[bytes]]) -> np.ndarray:
        total = np.zeros(1 << CUE_BITS, np.int32)
        for a in range(0, len(documents), 200):
            part = documents[a:a + 200]
            at: dict[bytes, int] = {}
            index = [np.unique([at.setdefault(w, len(at)) for w in words]) for words in part if words]
            rows, places = grams(list(at), CUE_ORDERS, CUE_BITS)
            places = places[np.argsort(rows, kind="stable")]
            size = np.bincount(rows, minlength=len(at))
            first = np.cumsum(size) - size
            for words in index:
                many = size[words]
                ends = np.cumsum(many)
                total[np.unique(places[np.repeat(first[words] - (ends - many), many) + np.arange(ends[-1])])] += 1
        return total

    bad, good = counted(toxic), counted(clean)
    prior = len(toxic) / (len(toxic) + len(clean))
    need = np.log(np.count_nonzero(bad) + 1) + 3
    n = np.maximum(bad + good, 1)
    rate = bad / n
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = n * (rate * np.log(rate / prior) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - prior)), 0))
    return (rate >= 0.9) & (surprise > need)


def holding(words: list[bytes], found: np.ndarray) -> np.ndarray:
    """Whether each word has a cue."""
    rows, places = grams(words, CUE_ORDERS, CUE_BITS)
    return np.bincount(rows, found[places], len(words)) > 0


def _windows(toxic: list[list[bytes]], clean: list[list[bytes]], found: np.ndarray) -> tuple[list, list]:
    """Stretches of WINDOW words with their labels: around toxic words, and as many from clean documents."""
    texts, labels = [], []
    for words in toxic:
        flags = holding(words, found).tolist()
        done = 0
        for i, flag in enumerate(flags):
            if flag and i >= done:
                a = max(0, i - WINDOW // 3)
                texts.append(words[a:a + WINDOW])
                labels.append(flags[a:a + WINDOW])
                done = a + WINDOW
    most = max(2 * len(texts), 200)
    for k, words in enumerate(clean):
        if len(texts) >= 3 * most or not words:
            continue
        a = (k * 7919) % max(1, len(words) - WINDOW)
        texts.append(words[a:a + WINDOW])
        labels.append([False] * len(texts[-1]))
    return texts, labels


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """The field from documents with labels 0 and 1: cues, labelled tokens, gradient steps (AdaGrad) on the
    log-likelihood of the label sequences, calibration of the document score."""
    documents = [words_of(t) for t in texts]
    toxic = [d for d, y in zip(documents, labels) if y == 1]
    clean = [d for d, y in zip(documents, labels) if y == 0]
    if not toxic or not clean:
        return None
    windows, flags = _windows(toxic, clean, cues(toxic, clean))
    size = 1 << BITS
    model = Model(np.zeros(size), np.zeros(size), np.zeros(size), -3.0, np.zeros((2, 2)))
    heat = [np.full(size, 1e-2), np.full(size, 1e-2), np.full(size, 1e-2), 1e-2, np.full((2, 2), 1e-2)]
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        turn = order.permutation(len(windows))
        for a in range(0, len(turn), 512):
            part = [windows[i] for i in turn[a:a + 512]]
            truth = np.concatenate([flags[i] for i in turn[a:a + 512]]).astype(float)
            at: dict[bytes, int] = {}
            index = np.array([at.setdefault(w, len(at)) for words in part for w in words])
            rows, places = grams(list(at))
            who = identities(list(at))
            guess, offsets, pairs = chain(model, part)
            error = truth - guess
            first = np.zeros(len(index), bool)
            first[offsets[:-1]] = True
            per_word = np.bincount(index, error, len(at))
            near = np.where(first[1:], 0, 1)
            gradients = [
                np.bincount(places, per_word[rows], size),
                np.bincount(who[index[:-1]], error[1:] * near, size),
                np.bincount(who[index[1:]], error[:-1] * near, size),
                float(error.sum()),
                _pair_counts(truth, first) - pairs]
            values = [model.gram, model.before, model.after, model.bias, model.step]
            for k, (g, rate) in enumerate(zip(gradients, (0.3, 0.03, 0.03, 0.1, 0.1))):
                g = g / len(part) - 1e-5 * values[k]
                heat[k] = heat[k] + g * g
                values[k] = values[k] + rate * g / np.sqrt(heat[k])
            model = Model(*values)
    logit = np.concatenate([peaks(model, documents[i:i + 500]) for i in range(0, len(documents), 500)])
    return Model(model.gram.astype(np.float32), model.before.astype(np.float32), model.after.astype(np.float32),
                 model.bias, model.step, _platt(logit, np.array(labels, float)))


def _pair_counts(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of (state, next state) pairs inside the documents."""
    a, b = p[:-1][~first[1:]], p[1:][~first[1:]]
    return np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])


def peaks(model: Model, documents: list[list[bytes]]) -> np.ndarray:
    """Log odds of each document's largest marginal."""
    p, offsets, _ = chain(model, documents)
    top = np.full(len(documents), FLOOR)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        top[some] = np.maximum.reduceat(p, offsets[some])
    top = np.clip(top, FLOOR, 1 - FLOOR)
    return np.log(top / (1 - top))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve through (x, y), a little ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        gradient = np.array([((y - p) * x).sum() - 1e-2 * a, (y - p).sum()])
        hessian = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        move = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        a, b = a + move[0], b + move[1]
    return max(0.0, float(a)), float(b)


def document_score(model: Model | None, logit: np.ndarray) -> np.ndarray:
    if model is None:
        return np.zeros(len(logit))
    a, b = model.calibration
    return 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model | None:
    """Fit on a bounded sample of labelled documents: a count per class, then the labels whose hash is below the
    class's share. They are so few that they are broadcast to the documents."""
    known = labels.where(usable & F.col(label).isin(0, 1)).select(F.col(key), F.col(label).alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30))
    limit = {1: TOXIC, 0: CLEAN}
    share = F.when(F.col("_y") == 1, F.lit(min(1 << 30, (TOXIC << 30) // counts[1]))).otherwise(
        F.lit(min(1 << 30, (CLEAN << 30) // counts[0])))
    drawn = known.where(draw < share).dropDuplicates([key]).limit(2 * (TOXIC + CLEAN))
    rows = docs.where(F.length(text) <= LONGEST).select(key, text).join(F.broadcast(drawn), key)
    found = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0], r[1]))
    found = list({r[1]: r for r in found}.values())  # copies would count as evidence again and again
    kept = [r for y in (0, 1) for r in [x for x in found if x[2] == y][:2 * limit[y]]]
    return fit([r[1] for r in kept], [r[2] for r in kept])


def score(docs: DataFrame, model: Model | None, text: str = "text", spans: bool = False) -> DataFrame:
    """docs with score (0 to 1) and, if asked for, spans: array of (begin, end, score) in code points of the text,
    end exclusive, each a run of words with marginal 0.5 or more and the largest of them."""
    kept = [c for c in docs.columns if c not in ("score", "spans")]
    rows = docs.select(*kept)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def runs(t: str | None, p: np.ndarray) -> list:
        out: list = []
        if (p >= 0.5).any():
            for m, (i, x) in zip(WORD.finditer(t), enumerate(p)):
                if x >= 0.5 and out and out[-1]["last"] == i - 1:
                    out[-1].update(end=m.end(), last=i, score=max(out[-1]["score"], float(x)))
                elif x >= 0.5:
                    out.append({"begin": m.start(), "end": m.end(), "score": float(x), "last": i})
        return [{k: x[k] for k in ("begin", "end", "score")} for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = part.column(text).to_pylist()
                documents = [words_of(t) for t in texts] if model else []
                logit = peaks(model, documents) if model else np.zeros(len(texts))
                made = [pa.array(document_score(model, logit), pa.float64())]
                if spans:
                    p, offsets, _ = chain(model, documents) if model else (np.zeros(0), np.zeros(len(texts) + 1, int), None)
                    made.append(pa.array([runs(t, p[offsets[i]:offsets[i + 1]]) for i, t in enumerate(texts)], span_type))
                yield pa.RecordBatch.from_arrays([*part.columns, *made],
                                                 names=[*part.schema.names, "score", "spans"][:len(part.schema.names) + len(made)])

    more = "score double" + ", spans array<struct<begin:bigint,end:bigint,score:double>>" * spans
    return rows.mapInArrow(run, with_fields(rows.schema, more))
