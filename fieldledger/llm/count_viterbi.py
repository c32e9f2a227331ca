"""Token counts by a count-only Viterbi: per distinct chunk, an automaton lists the vocabulary's matches and
dynamic programming carries the best score and the number of ids; no segmentation is kept.

Null and empty texts have 0 tokens and score 0. Equal scores: see unigram.best_paths. Repeated rows are
counted one by one. Columns of the input that clash with n_tokens and score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import unigram
from .common import slices, with_fields

#: Distinct chunks whose results a task remembers, and how many characters are solved at once.
REMEMBERED = 300_000
AT_ONCE = 400_000


class Counts(dict):
    """chunk -> (number of ids, score)."""

    def __init__(self, vocab: unigram.Vocabulary):
        super().__init__()
        self.vocab = vocab

    def learn(self, found: set[str]) -> None:
        new = [c for c in found if c not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(found)
        part, size = [], 0
        for i, c in enumerate(new):
            part.append(c)
            size += len(c)
            if size >= AT_ONCE or i == len(new) - 1:
                score, count, _ = unigram.best_paths(unigram.lattice(self.vocab, part))
                self.update(zip(part, zip(count.tolist(), score.tolist())))
                part, size = [], 0


def counted(texts: list[str | None], known: Counts) -> tuple[np.ndarray, np.ndarray]:
    parts = [unigram.chunks(t) for t in texts]
    known.learn({c for p in parts for c in p})
    both = [(sum(known[c][0] for c in p), sum(known[c][1] for c in p)) for p in parts]
    return np.array([n for n, _ in both], np.int64), np.array([float(s) for _, s in both])


def token_counts(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens and score (log-probability of the best segmentation)."""
    model = model or unigram.default_model()
    rows = docs.select(*(c for c in docs.columns if c not in ("n_tokens", "score")))
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(unigram.vocabulary(model))
        for batch in batches:
            for part in slices(batch, text):
                count, score = counted(part.column(text).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(count), pa.array(score)],
                                                 names=[*kept, "n_tokens", "score"])

    return rows.mapInArrow(run, with_fields(rows.select(*kept).schema, "n_tokens long, score double"))
