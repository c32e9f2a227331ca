"""A unigram vocabulary over the pieces of a SentencePiece model, and lattices of many strings at once.

Scores: the model file ranks its pieces but is no unigram model, so a piece of rank r (0 for the first
that is no control or byte piece) has log-probability -log(r + SHIFT) less the logarithm of their sum.
A character that no single-character piece covers costs the smallest score less UNKNOWN_COST and becomes
its UTF-8 bytes as byte pieces.

A text is written with U+2581 for spaces and one in front. No piece has that sign after another
character, and no piece has a line feed, so the lattice falls apart into chunks: a run of signs with what
follows, or a line feed. Chunks are solved once per distinct string.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np

SHIFT = 2.7
#: Distance between the smallest score and that of an unknown character, as unigram tokenizers have it: fixed value.
UNKNOWN_COST = 10.0
SPACE = "▁"
CHUNK = re.compile(" +[^ \n]*|\n|[^ \n]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Vocabulary:
    """Pieces, scores, byte pieces and the automaton that finds all pieces in a string."""

    def __init__(self, pieces: list[tuple[int, str]], byte_ids: list[int]):
        self.ids = np.array([i for i, _ in pieces], np.int64)
        self.pieces = [p for _, p in pieces]
        weight = 1 / (np.arange(len(pieces)) + SHIFT)
        self.scores = np.log(weight / weight.sum())
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.longest = int(self.lengths.max())
        self._table = None
        self.unknown = float(self.scores.min() - UNKNOWN_COST)
        self.byte_ids = np.array(byte_ids, np.int64)
        self._automaton = None
        self.surface: dict[int, bytes] = {int(i): p.replace(SPACE, " ").encode() for i, p in pieces}
        self.surface.update({i: bytes([b]) for b, i in enumerate(byte_ids)})

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [(i, model.id_to_piece(i)) for i in every
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return Vocabulary(plain, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for k, p in enumerate(self.pieces):
                self._automaton.add_word(p, k)
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece."""
        flat = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        return flat[:, 0] + 1 - self.lengths[flat[:, 1]], flat[:, 1]

    def _tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Prefixes of the pieces as a table from (prefix, next character) to a longer prefix: keys, prefixes, the piece of each
        prefix (-1: none) and the bits of the table's size."""
        nodes, piece = {}, [-1]
        for k, p in enumerate(self.pieces):
            at = 0
            for c in p:
                step = at << 21 | ord(c)
                if (to := nodes.get(step)) is None:
                    to = nodes[step] = len(piece)
                    piece.append(-1)
                at = to
            piece[at] = k
        bits = max(4, (8 * len(nodes)).bit_length())
        keys, to = np.full(1 << bits, -1), np.zeros(1 << bits, np.int32)
        want, value = np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes))
        slot = _slot(want, bits)
        while len(want):  # into the first free slot, one of those that want the same
            free = np.flatnonzero(keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            keys[slot[free[first]]], to[slot[free[first]]] = want[free[first]], value[free[first]]
            rest = np.ones(len(want), bool)
            rest[free[first]] = False
            want, value, slot = want[rest], value[rest], (slot[rest] + 1) & ((1 << bits) - 1)
        return keys, to, np.array(piece, np.int32), bits

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece among code points, as `matches` finds them: all places step down the
        tree of prefixes together."""
        if self._table is None:
            self._table = self._tree()
        keys, to, piece_of, bits = self._table
        mask, size = (1 << bits) - 1, len(codes)
        place, node = np.arange(size), np.zeros(size, np.int64)
        starts, pieces = [], []
        for depth in range(self.longest):
            inside = np.flatnonzero(place < size - depth)
            if len(inside) < len(place):
                place, node = place[inside], node[inside]
            step = node << 21 | codes[place + depth]
            slot = _slot(step, bits)
            have = keys[slot]
            open_ = np.flatnonzero((have != step) & (have >= 0))
            while len(open_):
                slot[open_] = (slot[open_] + 1) & mask
                have = keys[slot[open_]]
                open_ = open_[(have != step[open_]) & (have >= 0)]
            hit = np.flatnonzero(keys[slot] == step)
            if not len(hit):
                break
            place, node = place[hit], to[slot[hit]].astype(np.int64)
            piece = piece_of[node]
            whole = np.flatnonzero(piece >= 0)
            starts.append(place[whole])
            pieces.append(piece[whole].astype(np.int64))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *pieces])

    def decode(self, ids) -> str:
        """The text of a sequence of ids; inverse of every segmentation of a text."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")[1:]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def chunks(text: str | None) -> list[str]:
    """The independent parts of a text's lattice, spaces not yet replaced; their concatenation is " " + text."""
    return CHUNK.findall(" " + text.replace(SPACE, " ")) if text else []


@dataclass
class Lattice:
    """Edges of many strings. String k has its nodes at first[k] .. last[k]; an edge goes from `start` to `end`,
    with `piece` -1 for an unknown character, whose code point is in `code`."""

    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    code: np.ndarray
    score: np.ndarray
    width: np.ndarray  # ids that the edge stands for

    @property
    def nodes(self) -> int:
        return int(self.last[-1]) + 1 if len(self.last) else 0


def _utf8_width(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def lattice(vocab: Vocabulary, strings: list[str], tree: bool = False) -> Lattice:
    """All edges, in order of their start node, the longest first; pieces are found by the automaton, or by the tree of prefixes."""
    joined = "\x00".join(strings).replace(" ", SPACE) + "\x00"
    sizes = np.array([len(s) for s in strings], np.int64)
    last = np.cumsum(sizes + 1) - 1
    first = last - sizes
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    start, piece = vocab.found(codes) if tree else vocab.matches(joined)
    bare = np.ones(len(codes), bool)
    bare[last] = False
    bare[start[vocab.lengths[piece] == 1]] = False
    alone = np.flatnonzero(bare)
    start = np.concatenate([start, alone])
    piece = np.concatenate([piece, np.full(len(alone), -1)])
    length = np.where(piece < 0, 1, vocab.lengths[piece])
    order = np.argsort(start * (vocab.longest + 1) - length)
    start, piece, length = start[order], piece[order], length[order]
    code = codes[start]
    return Lattice(first, last, start, start + length, piece, code,
                   np.where(piece < 0, vocab.unknown, vocab.scores[piece]),
                   np.where(piece < 0, _utf8_width(code), 1))


def by_place(place: np.ndarray, owner_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of edges by place inside their string, and where each place begins in that order."""
    inside = place - owner_first
    if len(inside) and inside.max() < 1 << 16:
        inside = inside.astype(np.uint16)  # sorted by counting
    order = np.argsort(inside, kind="stable")
    counts = np.bincount(inside, minlength=1)
    return order, np.concatenate([[0], np.cumsum(counts)])


def best_paths(lat: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi over all strings together: (score, number of ids) of each string's best path, and the edge that
    enters each node on its best path (-1: none). Of equal scores the path whose last piece starts first wins,
    as where starts are scanned from the left and only a greater score replaces one."""
    best, count = np.zeros(lat.nodes), np.zeros(lat.nodes, np.int64)
    into = np.full(lat.nodes, -1)
    owner = np.searchsorted(lat.last, lat.start)
    # edges by end place; within one end node by start, earliest first
    length = lat.end - lat.start
    ranked = np.argsort(lat.end * (int(length.max(initial=0)) + 1) - length)
    order, edges = by_place(lat.end[ranked], lat.first[owner[ranked]])
    order = ranked[order]
    for place in range(1, len(edges) - 1):
        e = order[edges[place]:edges[place + 1]]
        if not len(e):
            continue
        value, end = best[lat.start[e]] + lat.score[e], lat.end[e]
        head = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        top = np.maximum.reduceat(value, head)
        group = np.cumsum(np.append(True, end[1:] != end[:-1])) - 1
        hit = np.flatnonzero(value == top[group])
        hit = hit[np.append(True, group[hit][1:] != group[hit][:-1])]
        win = e[hit]
        best[lat.end[win]], into[lat.end[win]] = value[hit], win
        count[lat.end[win]] = count[lat.start[win]] + lat.width[win]
    return best[lat.last], count[lat.last], into
