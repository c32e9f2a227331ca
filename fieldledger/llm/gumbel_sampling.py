"""Sampled segmentations without replacement: Gumbel top-k by a perturbed A-star search over the lattice.

A text's segmentations have probability proportional to exp(ALPHA * score). The search keeps sets of
segmentations, each with its mass and the largest perturbed log-probability inside it. The set with the largest
value is taken, its maximum is drawn from the top down along the lattice, and what remains of the set becomes sets of
its own, their values Gumbels of their masses below the value just taken. The first k maxima are k distinct
segmentations, in order of their perturbed log-probabilities; the (k+1)th value gives each its inclusion probability.

The search has two levels. No piece crosses a chunk (a word, with the spaces before it), so a text's
lattice is a row of chunk lattices, whose masses and edge probabilities are computed once per distinct chunk. A set is
a common beginning of whole chunks and the segmentations that the next chunk must not have; its mass is that of
the beginning times what those leave of the chunk. Only the chunk where a set is entered is searched edge by edge. A text
holds one value per chunk, and of a path only the part behind the chunk where it leaves the path it comes from.

Randomness is a function of the row key, the seed and the place in the text: the same on every run and
every partitioning; a null key draws unlike an empty one. Null and empty texts have one segmentation, the empty one; a
text with fewer than k segmentations returns all of them with inclusion probability 1. Repeated rows give equal samples.
Texts are worked on in slices of about TEXT_BYTES; a longer text is a slice of its own. U+2581, which pieces write for a
space, is read as a space: it comes back as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import unigram
from .common import mixed, slices, with_fields

SAMPLES = 4
ALPHA = 0.5
TEXT_BYTES = 2 << 20


class Sampler:
    """Lattice of the distinct chunks of some texts with the mass behind every node."""

    def __init__(self, vocab: unigram.Vocabulary, strings: list[str], alpha: float):
        self.vocab, self.lat = vocab, unigram.lattice(vocab, strings, tree=True)
        lat = self.lat
        score = alpha * lat.score
        behind = np.zeros(lat.nodes)  # log of the summed mass of all ways to the end
        owner = np.repeat(np.arange(len(lat.last)), np.diff(np.searchsorted(lat.start, lat.last), prepend=0))
        order, edges = unigram.by_place(lat.start, lat.first[owner])
        for place in range(len(edges) - 2, -1, -1):
            e = order[edges[place]:edges[place + 1]]
            if not len(e):
                continue
            value, start = score[e] + behind[lat.end[e]], lat.start[e]
            head = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
            top = np.maximum.reduceat(value, head)
            group = np.cumsum(np.append(True, start[1:] != start[:-1])) - 1
            behind[start[head]] = top + np.log(np.add.reduceat(np.exp(value - top[group]), head))
        self.log_p = score + behind[lat.end] - behind[lat.start]
        p = np.exp(self.log_p)
        head = np.flatnonzero(np.append(True, lat.start[1:] != lat.start[:-1])) if len(p) else np.zeros(0, np.int64)
        self.head = np.zeros(lat.nodes + 1, np.int64)
        self.head[lat.start[head]] = head
        self.size = np.bincount(lat.start, minlength=lat.nodes)
        size = np.diff(np.append(head, len(p)))
        total = np.cumsum(p)
        before = np.repeat(np.concatenate([[0.0], total])[head], size)
        self.upto = (total - before) / np.repeat(np.add.reduceat(p, head), size) if len(p) else p
        self.upto[np.append(head[1:], len(p)) - 1] = 2.0  # a node's last edge takes all that is left
        # ids of every edge, one after the other
        many = lat.width
        self.pool_at = np.cumsum(many) - many
        self.pool = np.repeat(np.where(lat.piece < 0, 0, vocab.ids[lat.piece]), many)
        for e in np.flatnonzero(lat.piece < 0):
            raw = chr(lat.code[e]).encode("utf-8", "surrogatepass")
            self.pool[self.pool_at[e]:self.pool_at[e] + len(raw)] = vocab.byte_ids[list(raw)]

    def walk(self, node: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each node to its stop: (walker, edge, log-probability before the edge) of every step, in order of walker and step."""
        who, taken, ahead = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        spread = np.array([0x9E3779B97F4A7C15], np.uint64)
        live, step = np.flatnonzero(node < stop), 0
        node, stop, seed, reach = node[live], stop[live], seed[live], np.zeros(len(live))
        while len(live):
            draw = (mixed(seed + spread * np.uint64(step)) >> np.uint64(11)).astype(float) * 2.0**-53
            edge = self.head[node]
            above = np.flatnonzero(self.upto[edge] <= draw)
            while len(above):
                edge[above] += 1
                above = above[self.upto[edge[above]] <= draw[above]]
            who.append(live)
            taken.append(edge)
            ahead.append(reach)
            node = self.lat.end[edge]
            going = np.flatnonzero(node < stop)
            reach = (reach + self.log_p[edge])[going]
            live, node, stop, seed = live[going], node[going], stop[going], seed[going]
            step += 1
        steps = np.repeat(np.arange(len(who)) - 1, [len(x) for x in who])
        who, taken, ahead = np.concatenate(who), np.concatenate(taken), np.concatenate(ahead)
        # every walker takes its steps one after the other, so their number gives each its place
        counts = np.bincount(who)
        at = (np.cumsum(counts) - counts)[who] + steps
        taken_at, ahead_at = np.empty_like(taken), np.empty_like(ahead)
        taken_at[at], ahead_at[at] = taken, ahead
        return np.repeat(np.arange(len(counts)), counts), taken_at, ahead_at

    def ids(self, edges: np.ndarray) -> np.ndarray:
        many = self.lat.width[edges]
        ends = np.cumsum(many)
        return self.pool[np.repeat(self.pool_at[edges] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]

    def _from(self, node: int) -> range:
        first = int(self.head[node])
        return range(first, first + int(self.size[node]))

    def left(self, node: int, barred: list[tuple[int, ...]]) -> float:
        """The mass behind a node without the barred ways to the end; a sum of what leaves each of them, so that little is exact."""
        total = 0.0
        for e in self._from(node):
            rests = [b[1:] for b in barred if b[0] == e]
            if not rests:
                total += math.exp(self.log_p[e])
            elif all(rests):  # all ways through an edge end at one node, so no way is the beginning of another
                total += math.exp(self.log_p[e]) * self.left(int(self.lat.end[e]), rests)
        return total

    def avoid(self, chunk: int, barred: list[tuple[int, ...]], seed: int) -> np.ndarray:
        """A way through the chunk that is not barred, in proportion to its mass."""
        node, stop, out = int(self.lat.first[chunk]), int(self.lat.last[chunk]), []
        while node < stop:
            options, weight = self._from(node), []
            for e in options:
                rests = [b[1:] for b in barred if b[0] == e]
                share = 1.0 if not rests else self.left(int(self.lat.end[e]), rests) if all(rests) else 0.0
                weight.append(math.exp(self.log_p[e]) * share)
            seed = xxhash.xxh3_64_intdigest(seed.to_bytes(8, "little"))
            u, at = (seed >> 11) * 2.0**-53 * sum(weight), -1
            for i, w in enumerate(weight):
                if w > 0:
                    at, u = i, u - w
                    if u < 0:
                        break
            out.append(options[at])
            node, barred = int(self.lat.end[out[-1]]), [b[1:] for b in barred if b[0] == out[-1]]
        return np.array(out, np.int64)


def _below(log_mass: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values of the given log masses, each conditioned to lie below top."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        value = log_mass - np.log(np.exp(np.minimum(log_mass - top, 700)) - np.log(u))
    return np.where(np.isneginf(log_mass), -np.inf, np.minimum(value, top))


def _salt(kind: int, turn: int) -> int:
    """Streams of random numbers: kind 1 the top, 2 the values of a path, 3 the way around what is barred, 4 the walks."""
    return kind << 32 | turn


def _uniform(seed: int, salt: int, n: int) -> np.ndarray:
    x = mixed(mixed(np.array([salt], np.uint64)) + np.uint64(seed) + np.arange(n, dtype=np.uint64))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


@dataclass
class _Path:
    """A segmentation that was found: it follows `parent` up to chunk `first`, from there it has edges of its own."""

    parent: int
    first: int
    edges: np.ndarray        # of the chunks from first on
    counts: np.ndarray       # edges of each of these chunks
    log_p: np.ndarray        # log-probability of each of these chunks
    before: float            # log-probability of the chunks in front
    barred: list             # segmentations of chunk `first` that the sets of this path must not have
    value: np.ndarray        # largest perturbed value of the set that leaves at each chunk
    top: float

    def way(self, at: int) -> tuple[int, ...]:
        """The edges of its at-th own chunk."""
        start = int(self.counts[:at].sum())
        return tuple(self.edges[start:start + int(self.counts[at])].tolist())


class _Text:
    """The search in one text: segmentations found and, for each, the sets that leave it at its chunks."""

    def __init__(self, places: np.ndarray, seed: int):
        self.places, self.seed = places, seed
        self.paths: list[_Path] = []
        self.top = float(-np.log(-np.log(_uniform(seed, _salt(1, 0), 1)[0])))

    def next_value(self) -> tuple[float, int, int]:
        found = [(float(p.value.max()), k, int(p.value.argmax())) for k, p in enumerate(self.paths)]
        return max(found, default=(-np.inf, 0, 0))

    def branch(self, sampler: Sampler) -> tuple[int, int, np.ndarray, float, list] | None:
        """Take the set with the largest value: (parent, chunk where it leaves, its edges there, log-probability before, barred there)."""
        value, k, at = self.next_value()
        if np.isneginf(value):
            return None
        path = self.paths[k]
        # barred at the first chunk includes the path's own way there
        barred = list(path.barred) if at == 0 and path.barred else [path.way(at)]
        chunk = path.first + at
        seed = xxhash.xxh3_64_intdigest(_salt(3, len(self.paths)).to_bytes(8, "little"), self.seed)
        way = sampler.avoid(int(self.places[chunk]), barred, seed)
        path.value[at] = -np.inf  # what is left of the set goes to the new path
        self.top = value
        return k, chunk, way, path.before + float(path.log_p[:at].sum()), [*barred, tuple(way.tolist())]

    def edges(self, k: int) -> np.ndarray:
        """All edges of a path."""
        parts, end = [], len(self.places)
        while k >= 0:
            path = self.paths[k]
            parts.append(path.edges[:int(path.counts[:end - path.first].sum())])
            k, end = path.parent, path.first
        return np.concatenate(parts[::-1]).astype(np.int64)

    def log_prob(self, k: int) -> float:
        return self.paths[k].before + float(self.paths[k].log_p.sum())


class _Numbers(dict):
    def __missing__(self, chunk: str) -> int:
        value = self[chunk] = len(self)
        return value


def _with_ways(sampler: Sampler, todo: list[tuple], edge: np.ndarray, counts: np.ndarray, ahead: np.ndarray, sizes: np.ndarray) -> tuple:
    """The walks of the texts with the way through the chunk in front of each."""
    ends, edges, many, reach, a = np.concatenate([[0], np.cumsum(counts)]), [], [], [], 0
    for (_, _, _, way, _, _), size in zip(todo, sizes.tolist()):
        log_p = sampler.log_p[way]
        edges += [way, edge[ends[a]:ends[a + size]]]
        many += [np.array([len(way)]), counts[a:a + size]]
        reach += [np.cumsum(log_p) - log_p, ahead[ends[a]:ends[a + size]]]
        a += size
    return np.concatenate(edges), np.concatenate(many), np.concatenate(reach), sizes + 1


def _add(sampler: Sampler, todo: list[tuple], edges: np.ndarray, counts: np.ndarray, ahead: np.ndarray, sizes: list[int]) -> None:
    """A path for each text of todo, found with the value of its search's top: edges and, per chunk, their counts, one text after the other."""
    log_p = sampler.log_p[edges]
    start = np.cumsum(counts) - counts
    other = np.where(sampler.size[sampler.lat.start[edges]] > 1, -np.expm1(np.minimum(log_p, 0.0)), 0.0)
    leaving, per_chunk = np.add.reduceat(np.exp(ahead) * other, start), np.add.reduceat(log_p, start)
    ends = np.cumsum(sizes)
    for (s, _, first, _, _, barred), end, size in zip(todo, ends, sizes):
        if len(barred) > 1:
            leaving[end - size] = sampler.left(int(sampler.lat.first[s.places[first]]), barred)
    with np.errstate(divide="ignore"):
        mass = np.log(leaving)
    for (_, _, _, _, before, _), end, size in zip(todo, ends, sizes):
        own = per_chunk[end - size:end]
        mass[end - size:end] += before + np.cumsum(own) - own
    base = mixed(np.array([_salt(2, len(s.paths)) for s, *_ in todo], np.uint64)) + np.array([s.seed for s, *_ in todo], np.uint64)
    draw = np.repeat(base, sizes) + (np.arange(len(counts)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
    value = _below(mass, np.repeat([s.top for s, *_ in todo], sizes), ((mixed(draw) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
    edges, counts, at = edges.astype(np.int32), counts.astype(np.int32), np.append(start, len(edges))
    for (s, parent, first, _, before, barred), end, size in zip(todo, ends, sizes):
        a = end - size
        s.paths.append(_Path(parent, first, edges[at[a]:at[end]], counts[a:end], per_chunk[a:end], before, barred, value[a:end], s.top))


def sampled(vocab: unigram.Vocabulary, texts: list[str | None], seeds: list[int], k: int, alpha: float) -> Iterator[list[dict]]:
    """For each text its k segmentations: ids, log_prob, perturbed, inclusion (probability)."""
    at = _Numbers()
    places = [np.fromiter(map(at.__getitem__, c), np.int32, len(c)) for c in map(unigram.chunks, texts)]
    sampler = Sampler(vocab, list(at), alpha) if at else None
    searches = [_Text(p, s) for p, s in zip(places, seeds)]
    full = [s for s in searches if len(s.places)]
    todo = [(s, -1, 0, None, 0.0, []) for s in full]
    for turn in range(k):
        if turn:
            todo = [(s, *b) for s in full if len(s.paths) == turn and (b := s.branch(sampler)) is not None]
        if not todo:
            break
        # the chunk where a set leaves has its way already; the chunks behind it are walked
        free = [first + (parent >= 0) for _, parent, first, *_ in todo]
        own = np.concatenate([s.places[f:] for (s, *_), f in zip(todo, free)]).astype(np.int64)
        sizes = np.array([len(s.places) - f for (s, *_), f in zip(todo, free)])
        salt = mixed(np.array([_salt(4, turn)], np.uint64))[0] ^ np.array([s.seed for s, *_ in todo], np.uint64)
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes - free, sizes)
        seed = mixed(place.astype(np.uint64) + np.repeat(salt, sizes))
        who, edge, ahead = sampler.walk(sampler.lat.first[own], sampler.lat.last[own], seed)
        counts = np.bincount(who, minlength=len(own))
        del own, place, seed, who
        if turn:
            edge, counts, ahead, sizes = _with_ways(sampler, todo, edge, counts, ahead, sizes)
        _add(sampler, todo, edge, counts, ahead, sizes.tolist())
    for s in searches:
        if not s.paths:
            yield [{"ids": np.zeros(0, np.int64), "log_prob": 0.0, "perturbed": s.top, "inclusion": 1.0}]
            continue
        limit = s.next_value()[0]
        yield [{"ids": sampler.ids(s.edges(i)), "log_prob": s.log_prob(i), "perturbed": p.top,
                "inclusion": float(-np.expm1(-np.exp(min(700.0, s.log_prob(i) - limit))))} for i, p in enumerate(s.paths)]


def sample(docs: DataFrame, model: str | None = None, k: int = SAMPLES, alpha: float = ALPHA, seed: int = 0, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """key, sample (0 first), log_prob, perturbed, inclusion, ids (32-bit little-endian): k rows per document."""
    model = model or unigram.default_model()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(key).cast("string").alias("_seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = unigram.vocabulary(model)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                seeds = [xxhash.xxh3_64_intdigest("null" if x is None else "=" + x, seed) for x in part.column("_seed").to_pylist()]
                flat = [(row, i, x["log_prob"], x["perturbed"], x["inclusion"], x["ids"].astype("<u4").tobytes())
                        for row, found in enumerate(sampled(vocab, part.column("text").to_pylist(), seeds, k, alpha)) for i, x in enumerate(found)]
                row, number, *values, ids = zip(*flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), *(pa.array(v, pa.float64()) for v in values),
                     pa.array(ids, pa.binary())], names=["doc_id", "sample", "log_prob", "perturbed", "inclusion", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, sample int, log_prob double, perturbed double, inclusion double, ids binary")


def decode(samples: DataFrame, model: str | None = None) -> DataFrame:
    """samples with `text`, put together from the ids."""
    model = model or unigram.default_model()
    rows = samples.select(*(c for c in samples.columns if c != "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = unigram.vocabulary(model)
        for batch in batches:
            for part in slices(batch, "ids"):
                made = [vocab.decode(np.frombuffer(x.as_buffer(), "<u4").tolist()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, "text"])

    return rows.mapInArrow(run, with_fields(rows.schema, "text string"))
