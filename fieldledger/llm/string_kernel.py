"""Language of a text by a string kernel.

The kernel of two texts is the blended spectrum with presence: the number of character n-grams (1 to 4)
that both hold, divided by the geometric mean of how many each holds. Landmark texts give the Nystroem
map of a text (its kernel with every landmark, times the inverse root of the landmarks' own kernel
matrix), and one-versus-rest kernel ridge regression is linear in it. A text is scored in segments of
SEGMENT characters, as many as it has; the score of a language is the mean over segments by length. Each
batch of segments costs two matrix products.

n-grams are hashed into DIMENSIONS places. Training rows are a bounded sample: about `per_class`
documents of each language, chosen by a hash of the key, one segment of each.

Null texts and texts without a letter get `und` and score 0. Equal scores: the language first in
alphabetical order. Without any training row all texts are `und`. Repeated rows are scored one by one.
Columns of the input that clash with lang_pred and score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import mixed, slices, with_fields

ORDERS = (1, 2, 3, 4)
DIMENSIONS = 4096
SEGMENT = 512
LANDMARKS = 192
PER_CLASS = 400
RIDGE = 0.05
UNKNOWN = "und"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def presence(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments x DIMENSIONS presence matrix, segment lengths) of one text; the last segment may be shorter."""
    n = len(codes)
    segments = max(1, -(-n // SEGMENT))
    seen = np.zeros((segments, DIMENSIONS), np.float32)
    at = np.arange(n) // SEGMENT * DIMENSIONS
    gram = np.zeros(n, np.uint64)
    flat = seen.reshape(-1)
    for order in ORDERS:
        if n < order:
            break
        gram = gram[:n - order + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1:] + np.uint64(order)
        place = mixed(gram) >> np.uint64(64 - 12)
        flat[at[:n - order + 1] + place.astype(np.int64)] = 1
    return seen, np.diff(np.append(np.arange(segments) * SEGMENT, n))


def normalized(seen: np.ndarray) -> np.ndarray:
    return seen / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, segments: np.ndarray) -> np.ndarray:
        """(segments, languages): kernel with the landmarks, then one-versus-rest weights."""
        return normalized(segments) @ self.landmarks.T @ self.weights + self.bias


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression on Nystroem features. Landmarks are taken in turn from the
    languages, in the order given."""
    if not texts:
        return None
    languages = sorted(set(labels))
    phi = normalized(np.concatenate([presence(code_points(t[:SEGMENT]))[0][:1] for t in texts]))
    turn: dict[str, int] = {}
    order = []
    for i, label in enumerate(labels):
        order.append((turn.get(label, 0), i))
        turn[label] = turn.get(label, 0) + 1
    chosen = phi[[i for _, i in sorted(order)[:landmarks]]]
    values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = phi @ chosen.T @ root
    target = (np.array(labels)[:, None] == np.array(languages)).astype(np.float64)
    weight = np.array([1 / turn[x] for x in labels])[:, None]  # every language counts the same
    weight = weight / weight.sum()
    center, mean = (features * weight).sum(axis=0), (target * weight).sum(axis=0)
    x, y = features - center, target - mean
    solved = np.linalg.solve(x.T @ (x * weight) + ridge / 100 * np.eye(x.shape[1]), x.T @ (y * weight))
    return Model(languages, chosen.astype(np.float32), (root @ solved).astype(np.float32),
                 (mean - center @ solved).astype(np.float32))


def sample(docs: DataFrame, usable: Column, key: str, text: str, label: str, per_class: int = PER_CLASS) -> tuple:
    """(texts, labels) of about per_class usable rows of each label: a count per label, then the rows whose hash
    is below the label's share. The driver receives one segment of at most 2 * per_class rows of a label."""
    rows = docs.where(usable & F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 30))
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col(label) == name, F.lit(min(1 << 30, (per_class << 30) // n))).otherwise(share)
    # one segment from a place that depends on the key, so that beginnings do not dominate
    span = F.greatest(F.length(text) - SEGMENT, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64(F.col(key), F.lit(13)), span) + 1).cast("int")
    drawn = rows.where(draw < share).select(F.substring(F.col(text), start, F.lit(SEGMENT)).alias("t"), F.col(label))
    found, have = [], {}
    for t, name in sorted((tuple(r) for r in drawn.collect()), key=lambda r: (xxhash.xxh3_64_intdigest(r[0]), r[1])):
        have[name] = have.get(name, 0) + 1
        if have[name] <= 2 * per_class and any(map(str.isalpha, t)):
            found.append((t, name))
    return [t for t, _ in found], [name for _, name in found]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1, the mean one-versus-rest value of the predicted language)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def one(texts: list) -> tuple[list, list]:
        model = shared.value
        names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
        todo = [i for i, t in enumerate(texts) if t and model and any(map(str.isalpha, t))]
        if not todo:
            return names, list(values)
        total = np.zeros((len(texts), len(model.languages)))
        length = np.zeros(len(texts))
        for group in _groups((i, part) for i in todo for part in _parts(code_points(texts[i]))):
            made = [presence(part) for _, part in group]
            scores = model.scores(np.concatenate([seen for seen, _ in made]))
            owner = np.concatenate([np.full(len(sizes), i) for (i, _), (_, sizes) in zip(group, made)])
            sizes = np.concatenate([sizes for _, sizes in made])
            np.add.at(total, owner, scores * sizes[:, None])
            np.add.at(length, owner, sizes)
        for i in todo:
            mean = total[i] / length[i]
            best = int(mean.argmax())
            names[i], values[i] = model.languages[best], min(1.0, max(0.0, float(mean[best])))
        return names, list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                names, values = one(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(values, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, with_fields(rows.schema, "lang_pred string, score double"))


def _parts(codes: np.ndarray, most: int = 256 * SEGMENT) -> Iterator[np.ndarray]:
    """A very long text in whole segments, so that its presence matrix stays small."""
    for a in range(0, len(codes), most):
        yield codes[a:a + most]


def _groups(parts: Iterator[tuple], most: int = 512 * SEGMENT) -> Iterator[list]:
    """Runs of (owner, codes) with about `most` characters together."""
    group, size = [], 0
    for i, part in parts:
        if group and size + len(part) > most:
            yield group
            group, size = [], 0
        group.append((i, part))
        size += max(len(part), SEGMENT)
    if group:
        yield group


def train(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    return fit(*sample(docs, usable, key, text, label))
