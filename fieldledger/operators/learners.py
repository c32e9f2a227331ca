"""Learners that use all dimensions at once: the contraction network. Tree ensembles are in trees.py."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import noise as N
from ..session import cut_lineage
from .trees import TreeSpec  # noqa: F401  (its place in earlier versions)


@dataclass
class Network:
    """x and a sine/cosine embedding of t through two hidden layers."""

    weights: list
    embed: int

    @staticmethod
    def create(dims: int, hidden: int, embed: int, seed: int) -> "Network":
        import numpy as np

        rng = np.random.default_rng(seed)
        sizes = [dims + embed, hidden, hidden, dims]
        weights = []
        for a, b in zip(sizes, sizes[1:]):
            bound = 1.0 / a ** 0.5
            weights += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        return Network(weights, embed)

    def inputs(self, x, t):
        import numpy as np

        freq = np.exp(-np.log(10000.0) * np.arange(self.embed // 2) / (self.embed // 2))
        angle = t[:, None] * freq
        return np.hstack([x, np.sin(angle), np.cos(angle)])

    def forward(self, x, t):
        import numpy as np

        w = self.weights
        a0 = self.inputs(x, t)
        a1 = np.maximum(a0 @ w[0] + w[1], 0.0)
        a2 = np.maximum(a1 @ w[2] + w[3], 0.0)
        return a0, a1, a2, a2 @ w[4] + w[5]

    def gradient(self, x, t):
        """Sum over rows of the gradient of the mean squared error to -x, and the summed loss."""
        w = self.weights
        a0, a1, a2, y = self.forward(x, t)
        gap = y + x
        g3 = 2.0 * gap / x.shape[1]
        g2 = (g3 @ w[4].T) * (a2 > 0)
        g1 = (g2 @ w[2].T) * (a1 > 0)
        return [a0.T @ g1, g1.sum(0), a1.T @ g2, g2.sum(0), a2.T @ g3, g3.sum(0)], float((gap ** 2).mean(1).sum())


#: Rows that go through the network at a time; their activations stay in a core's cache.
BLOCK = 1_024


def _rows(column):
    """A column of arrays of numbers, which are equally long, as a matrix."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sum_gradients(rows: DataFrame, net: Network, features: str, time: str, lanes: int = 32):
    """Gradient over all rows: one partial per task, added in `lanes` groups, then on the driver.
    What reaches the driver is `lanes` times the network, whatever the data."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    shapes = [w.shape for w in net.weights]
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def partial(batches):
        total, loss, n = None, 0.0, 0
        for batch in batches:
            x = _rows(batch.column(0))
            t = batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), BLOCK):
                grads, part_loss = shared.value.gradient(x[i:i + BLOCK], t[i:i + BLOCK])
                total = grads if total is None else [a + b for a, b in zip(total, grads)]
                loss, n = loss + part_loss, n + len(x[i:i + BLOCK])
        if n:
            flat = np.concatenate([g.ravel() for g in total])
            yield pa.RecordBatch.from_pydict(
                {"lane": pa.array([hash(flat[0]) % lanes], pa.int32()), "n": [n], "loss": [loss], "g": [flat.tobytes()]})

    def add(pdf):
        g = np.sum([np.frombuffer(v) for v in pdf["g"]], axis=0)
        return pd.DataFrame({"n": [pdf["n"].sum()], "loss": [pdf["loss"].sum()], "g": [g.tobytes()]})

    parts = rows.select(features, time).mapInArrow(partial, "lane int, n long, loss double, g binary")
    sums = parts.groupBy("lane").applyInPandas(add, "n long, loss double, g binary").collect()
    shared.destroy()
    n = sum(r["n"] for r in sums)
    flat = np.sum([np.frombuffer(r["g"]) for r in sums], axis=0) / max(n, 1)
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(flat[at:at + size].reshape(shape))
        at += size
    return out, sum(r["loss"] for r in sums) / max(n, 1)


def fit_contraction_network(df: DataFrame, key: str, features: str, dims: int, epochs: int = 100,
                            n_batch: int = 1, rate: float = 0.001, hidden: int = 256, embed: int = 128,
                            seed: int = 0) -> tuple[Network, list[float]]:
    """Adam on mean squared error to -x at hash-drawn times. The rows are written once, laid out by hash batch; each step is a job
    that reads the files of its batch only. Returns the network and the loss per step."""
    import numpy as np

    net = Network.create(dims, hidden, embed, seed)
    m = [np.zeros_like(w) for w in net.weights]
    v = [np.zeros_like(w) for w in net.weights]
    losses, step = [], 0
    batch = (F.conv(F.substring(F.md5(N.noise_key(F.col(key), "batch", seed)), 1, 8), 16, 10).cast("long") % n_batch)
    # a step works on all rows of its batch: they lie in files for all cores
    files = 4 * df.sparkSession.sparkContext.defaultParallelism // n_batch
    rows = cut_lineage(df.select(key, features, batch.cast("int").alias("_b")), "batches", "_b", files)
    for epoch in range(epochs):
        for b in range(n_batch):
            step += 1
            part = rows.where(F.col("_b") == b).withColumn("_t", N.hash_uniform(N.noise_key(F.col(key), "time", seed, epoch)))
            grads, loss = _sum_gradients(part, net, features, "_t")
            losses.append(loss)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                m_hat, v_hat = m[i] / (1 - 0.9 ** step), v[i] / (1 - 0.999 ** step)
                net.weights[i] = net.weights[i] - rate * m_hat / (np.sqrt(v_hat) + 1e-8)
    return net, losses


def score_network(df: DataFrame, key: str, features: str, net: Network, which: str, n_t: int = 20) -> DataFrame:
    """key, score of the contraction network; Arrow batches, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pandas as pd

        def field(x, t):
            return shared.value.forward(x, np.full(len(x), t))[-1]

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[features].to_numpy()).astype("float64")
            if which == "decision":
                value = np.sqrt(((field(x, 1.0) + x) ** 2).sum(1))
            else:
                value = np.zeros(len(x))
                for i in range(n_t // 2):
                    t = i / (n_t - 1)
                    y = (1 - t) * x
                    if which == "deviation":
                        value += ((-y - field(y, t)) ** 2).sum(1)
                    else:
                        for _ in range(n_t - 1 - i):
                            y = y + field(y, t) / (n_t - 1)
                            t += 1.0 / (n_t - 1)
                        value += (y ** 2).sum(1)
            yield pd.DataFrame({key: pdf[key], "score": value})

    return df.select(key, features).mapInPandas(run, f"{key} {key_type}, score double")
