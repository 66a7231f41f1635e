"""Sampled SentencePiece encoding and lossless decoding.

Forward filtering: at each place of a word the log sum of the scores of all segmentations up to it. Backward sampling:
from the word's end, a piece is drawn with its share of that sum, until the start. Scores are those of a unigram model
with Zipf's weights over the vocabulary's ranks, times `ALPHA`. Draws are a hash of seed, row key, place of the word in
the text and step, so a row's segmentation depends on nothing else. Words that were seen keep their lattice in memory
(`CACHED` states, then the memory is cleared) until their partition ends.

Decoding is lossless: a leading space is added before encoding and taken off after, characters without a piece become
bytes, and so does the space mark itself where a text holds it.

Cases: a null text has null pieces and decodes to null; an empty one has none and decodes to empty; rows with equal keys
and texts get equal pieces; a null key is a key of its own; columns named like the results are replaced; empty tables work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assay.llm import kit, pieces

ALPHA, SEED = 1.0, 11
CACHED = 2_000_000
SLICE_BYTES = 500_000


class _Ids(dict):
    """Numbers of words in the order they were met; those met since `new` was emptied are in it."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Lattices:
    """Sampling tables of the words seen: states are places in words; an edge is a piece that ends there."""

    def __init__(self, v: pieces.Vocabulary, alpha: float) -> None:
        self.v = v
        rank = {i: r for r, i in enumerate(sorted((i for i, _ in v.normal.values()), key=lambda i: -dict_score(v, i)))}
        logs = np.log(np.arange(1, len(rank) + 1))
        total = np.log(np.exp(-logs).sum())
        self.score = np.zeros(len(v.pieces))
        for i, r in rank.items():
            self.score[i] = -alpha * (logs[r] + total)
        self.unknown = alpha * -(logs[-1] + total + pieces.UNKNOWN)
        self.single = np.zeros(0x110000, dtype=bool)
        self.single[[ord(x) for x in v.single]] = True
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids()
        self.first = np.zeros(0, dtype=np.int32)  # state of each word's start
        self.last = np.zeros(0, dtype=np.int32)  # and of its end
        self.edge = np.zeros(0, dtype=np.int32)  # first edge of each state
        self.share = np.zeros(0, dtype=np.float32)  # cumulative share of each edge within its state
        self.piece = np.zeros(0, dtype=np.int32)  # id, or -1 - code point of an unknown character
        self.back = np.zeros(0, dtype=np.int32)  # state the edge comes from

    def word_ids(self, words: list[str]) -> np.ndarray:
        if len(self.edge) > CACHED:
            self.clear()
        out = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        if self.ids.new:
            self._add(self.ids.new)
            self.ids.new = []
        return out

    def _add(self, new: list[str]) -> None:
        """Forward filtering of new words, all of them side by side, place after place."""
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        text = "\n".join(new) + "\n"  # no piece holds a line break
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        end, size, piece = self.v.matches(codes)
        inside = np.ones(len(codes), dtype=bool)
        inside[starts + sizes] = False
        lone = np.flatnonzero(inside & ~self.single[codes])
        if len(lone):
            end, size, piece = np.concatenate([end, lone]), np.concatenate([size, np.ones_like(lone)]), np.concatenate([piece, -1 - codes[lone]])
            order = np.argsort(end, kind="stable")
            end, size, piece = end[order], size[order], piece[order]
        end = end + 1  # places of text; state p is the place before its p-th character
        back = end - size
        score = np.where(piece >= 0, self.score[np.maximum(piece, 0)], self.unknown)
        new_state = np.flatnonzero(np.diff(end, prepend=-1))  # edges are in the order of their ends, the longest first
        n = np.diff(np.append(new_state, len(end)))
        state = end[new_state]
        depth = state - np.repeat(starts, sizes)  # every place inside a word ends an edge
        alpha = np.zeros(len(codes) + 1)
        by_depth = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(depth[by_depth], prepend=0)), len(depth))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s = by_depth[a:b]
            first = np.cumsum(n[s]) - n[s]
            e = np.repeat(new_state[s] - first, n[s]) + np.arange(n[s].sum())
            x = alpha[back[e]] + score[e]
            top = np.maximum.reduceat(x, first)
            alpha[state[s]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n[s])), first))
        share = np.exp(alpha[back] + score - alpha[end])
        for k in range(1, int(n.max(initial=1))):  # state by state, so a word's shares don't depend on others
            at = new_state[n > k] + k
            share[at] += share[at - 1]
        share[new_state + n - 1] = np.inf
        base, edges = len(self.edge), len(self.share)
        edge = np.zeros(len(codes) + 1, dtype=np.int32)
        edge[state] = new_state + edges
        self.edge = np.concatenate([self.edge, edge])
        self.share = np.concatenate([self.share, share.astype(np.float32)])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])
        self.back = np.concatenate([self.back, (base + back).astype(np.int32)])
        self.first = np.concatenate([self.first, (base + starts).astype(np.int32)])
        self.last = np.concatenate([self.last, (base + starts + sizes).astype(np.int32)])

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words one after another (unknown characters as bytes), and how many each word has."""
        first, state = self.first[words], self.last[words]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(len(words))
        draws = seeds
        while len(live):
            draws = kit.mixed(draws)
            u = (draws >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.edge[state]
            later = np.flatnonzero(self.share[edge] <= u)
            while len(later):
                edge[later] += 1
                later = later[self.share[edge[later]] <= u[later]]
            steps.append((live, self.piece[edge]))
            state = self.back[edge]
            on = state > first
            live, state, draws, first = live[on], state[on], draws[on], first[on]
        n = np.zeros(len(words), dtype=np.int64)
        for at, _ in steps:
            n[at] += 1
        out = np.zeros(int(n.sum()), dtype=np.int64)
        ends = np.cumsum(n)
        for k, (at, piece) in enumerate(steps):
            out[ends[at] - 1 - k] = piece
        return self._bytes(out, n)

    def _bytes(self, out: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lone = np.flatnonzero(out < 0)
        if not len(lone):
            return out, n
        encoded = [[self.v.bytes[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in out[lone].tolist()]
        width = np.ones(len(out), dtype=np.int64)
        width[lone] = [len(x) for x in encoded]
        wide = np.repeat(out, width)
        wide[np.repeat(out < 0, width)] = [b for x in encoded for b in x]
        of = np.repeat(np.arange(len(n)), n)
        return wide, np.bincount(of, weights=width, minlength=len(n)).astype(np.int64)


def dict_score(v: pieces.Vocabulary, i: int) -> float:
    return v.normal[v.pieces[i].replace(pieces.MARK, " ")][1]


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(repr(key), seed)


def encode_texts(keys: list[object], texts: list[str | None], lattices: Lattices, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts one after another, and how many each has."""
    split = [pieces.words(t) if t else [] for t in texts]
    flat = [w for x in split for w in x]
    n = np.array([len(x) for x in split], dtype=np.int64)
    row = np.array([row_seed(k, seed) for k in keys], dtype=np.uint64)
    of = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    ids, per_word = lattices.sample(lattices.word_ids(flat), kit.mixed(row[of] ^ kit.mixed(place)))
    return ids, np.bincount(of, weights=per_word, minlength=len(texts)).astype(np.int64)


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """The text of pieces, without the leading space that encoding adds."""
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def byte_table(v: pieces.Vocabulary) -> list[bytes]:
    table = [p.replace(pieces.MARK, " ").encode() for p in v.pieces]
    for b, i in enumerate(v.bytes):
        table[i] = bytes([b])
    return table


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = pieces.DEFAULT, alpha: float = ALPHA, seed: int = SEED, check: bool = False) -> DataFrame:
    """df with piece_ids, a sampled segmentation of each text; if check, with whether they decode to the text, as `lossless`."""
    kept: list[Lattices] = []
    tables: list[list[bytes]] = []

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        if not kept:
            kept.append(Lattices(pieces.vocabulary(model), alpha))
            tables.append(byte_table(kept[0].v))
        texts = batch.column(text).to_pylist()
        ids, n = encode_texts(batch.column(key).to_pylist(), texts, kept[0], seed)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        ids = ids.astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array([t is None for t in texts]))]
        if check:
            same = [None if t is None else t == (decode_ids(ids[a:b].tolist(), tables[0]) if b > a else "") for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            out.append(pa.array(same, pa.bool_()))
        return out

    def done() -> None:
        kept.clear()
        tables.clear()

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *([T.StructField("lossless", T.BooleanType())] if check else [])]
    return kit.append(df, fields, text, work, SLICE_BYTES, done)


def decode(df: DataFrame, ids: str = "piece_ids", model: str = pieces.DEFAULT, to: str = "decoded") -> DataFrame:
    """df with the text of each row's pieces."""
    tables: list[list[bytes]] = []

    def run(batches):
        if not tables:
            tables.append(byte_table(pieces.vocabulary(model)))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [None if x is None else decode_ids(x, tables[0]) if x else "" for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=names)

    base = df.drop(*([to] if to in df.columns else []))
    names = [*base.columns, to]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(to, T.StringType())]))
