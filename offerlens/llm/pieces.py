"""Operator 10, SentencePiece encoding and decoding: sampled segmentations over the piece lattice.

Forward filtering gives each position of a text the total weight of the ways to reach it; backward sampling
then draws the pieces from the end. A text's blanks are the vocabulary's word marks, one blank goes before it,
and a character without a piece becomes its bytes. The vocabulary's pieces are ranked, not weighted, so a
piece of rank r weighs (r + OFFSET) ** -alpha (Zipf); a character spelt in bytes weighs as the last rank does.

No piece holds a blank after another character, nor a line feed, nor a letter beside one of the marks that
the vocabulary never joins to letters; there every segmentation has a boundary, the lattice falls apart into
stretches, and the forward weights of a stretch are worked out once for all its occurrences. Draws are a
function of (seed, row key, stretch number, step), so results don't hang on partitions or on retries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common

ALPHA = 1.0
OFFSET = 10.0
SEED = 10
MAX_NODES = 1_500_000
SHORT = 40
_MARK = "▁"
_MARKS = ".,!?;:*$%&#|"


def _cut(x):
    """A probability in units of 2**-32, at most one less than one."""
    return np.minimum(np.floor(np.asarray(x) * 2.0**32), 2.0**32 - 1).astype(np.int64)


def _sums_within(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums of p within the groups that begin at first, each group by itself."""
    out, stop = p.copy(), np.append(first[1:], len(p))
    at = first + 1
    while True:
        on = at < stop
        at, stop = at[on], stop[on]
        if not len(at):
            return out
        out[at] += out[at - 1]
        at = at + 1


class Pieces:
    """The vocabulary, and the sampling tables of stretches met so far.

    Node base + i stands for position i of a stretch. Its incoming edges are neighbours in `key`, with the node they come
    from and the piece they bring; the node -1 is the start. A key is the node in the upper 32 bits and the cumulative
    probability, summed within the node, in units of 2**-32: the same stretch has the same cuts whatever was learnt before.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.raw = [b""] * n
        byte_id = [-1] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece.replace(_MARK, " ")] = i
                self.raw[i] = piece.replace(_MARK, " ").encode()
        if min(byte_id) < 0:
            raise ValueError("the vocabulary has no byte pieces, so not every text can be spelt")
        self.byte_id = byte_id
        self.first = min(self.ids.values())
        self.weight = {p: (i - self.first + OFFSET) ** -alpha for p, i in self.ids.items()}
        self.rare = float(n) ** -alpha
        self.longest = max(map(len, self.ids))
        crossing = {c for p in self.ids for a, b in zip(p, p[1:]) for c in (a, b) if {a, b} & set(_MARKS) and c not in _MARKS and re.match(r"[^\W\d_]", c)}
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.ids):
            raise ValueError("pieces across words are not supported")
        letter = rf"[^\W\d_{re.escape(''.join(sorted(crossing)))}]" if crossing else r"[^\W\d_]"
        self.stretch = re.compile(rf" *{letter}+(?=[ \n{re.escape(_MARKS)}]|$)| *[^ \n]+| +|\n").findall
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self._table()
        self.forget()

    def forget(self) -> None:
        self.end: dict[str, int] = {}
        self.nodes, self.n_edges = 0, 0
        self.key, self.prev, self.piece = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _store(self, key: np.ndarray, prev: np.ndarray, piece: np.ndarray, nodes: int) -> None:
        m = self.n_edges + len(key)
        if m > len(self.key):
            grow = max(m, 2 * len(self.key))
            self.key, self.prev, self.piece = (np.concatenate([x, np.zeros(grow - len(x), x.dtype)]) for x in (self.key, self.prev, self.piece))
        for store, fresh in ((self.key, key), (self.prev, prev), (self.piece, piece)):
            store[self.n_edges : m] = fresh
        self.n_edges, self.nodes = m, nodes

    def _table(self) -> None:
        """Pieces by the hash of their characters: a slot each, and a second table for those that share one."""
        names = list(self.ids)
        h = np.zeros(len(names), np.uint64)
        for i, p in enumerate(names):
            x = 0
            for c in p:
                x = (x * common.BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            h[i] = x
        self.hashes, self.hashed_ids = h, np.array([self.ids[p] for p in names], np.int64)
        self.hashed_weight = np.array([self.weight[p] for p in names])
        self.slot = [np.full(1 << 20, -1, np.int32), np.full(1 << 20, -1, np.int32)]
        left = np.arange(len(names))
        for k in range(2):
            at = self._slots(h[left], k)
            self.slot[k][at[::-1]] = left[::-1]
            left = left[self.slot[k][at] != left]
        self.crowded = {names[i] for i in left}

    @staticmethod
    def _slots(h: np.ndarray, k: int) -> np.ndarray:
        return ((h * (common.MIX_1, common.MIX_2)[k]) >> np.uint64(44)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index into hashes, or -1."""
        i = self.slot[0][self._slots(h, 0)]
        i[(i >= 0) & (self.hashes[i] != h)] = -2
        rest = np.flatnonzero(i == -2)
        j = self.slot[1][self._slots(h[rest], 1)]
        i[rest] = np.where((j >= 0) & (self.hashes[j] == h[rest]), j, -1)
        return i

    def learn(self, stretches: list[str]) -> None:
        """Forward filtering of new stretches: short ones side by side, the others one by one."""
        if self.crowded:  # pieces that neither table holds; none in practice
            self._learn_each(stretches)
            return
        short = [s for s in stretches if len(s) <= SHORT]
        self._learn_each([s for s in stretches if len(s) > SHORT])
        if not short:
            return
        cp = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        size = np.fromiter(map(len, short), np.int64, len(short))
        known = self._find(cp) >= 0
        stop = np.cumsum(size)
        whole = np.bitwise_and.reduceat(known, stop - size)
        if not whole.all():
            self._learn_each([s for s, ok in zip(short, whole.tolist()) if not ok])
            short = [s for s, ok in zip(short, whole.tolist()) if ok]
            if not short:
                return
            cp, size = cp[np.repeat(whole, size)], size[whole]
            stop = np.cumsum(size)
        room = np.repeat(stop, size) - np.arange(len(cp))  # characters from here to the stretch's end
        off = np.repeat(size, size) - room
        h, at = np.zeros(len(cp), np.uint64), np.arange(len(cp))
        starts, ends, found = [], [], []
        for n in range(1, min(self.longest, int(size.max())) + 1):
            at = at[room[at] >= n]
            h[at] = h[at] * np.uint64(common.BASE) + cp[at + n - 1]
            i = self._find(h[at])
            hit = np.flatnonzero(i >= 0)
            starts.append(at[hit])
            ends.append(at[hit] + n - 1)
            found.append(i[hit])
        start, end, i = np.concatenate(starts), np.concatenate(ends), np.concatenate(found)
        order = np.argsort(end, kind="stable")
        start, end, i = start[order], end[order], i[order]
        head, before = off[start] == 0, np.maximum(start - 1, 0)
        w = self.hashed_weight[i]
        forward = np.zeros(len(cp))
        by_place = np.argsort(off[end].astype(np.uint8), kind="stable")
        bounds = np.searchsorted(off[end][by_place], np.arange(int(size.max()) + 1))
        for p in range(int(size.max())):
            e = by_place[bounds[p] : bounds[p + 1]]
            v = np.where(head[e], 1.0, forward[before[e]]) * w[e]
            first = np.flatnonzero(np.concatenate([[True], end[e][1:] != end[e][:-1]]))
            forward[end[e][first]] = np.add.reduceat(v, first)
        p = np.where(head, 1.0, forward[before]) * w / forward[end]
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        last = np.append(first[1:], len(p)) - 1
        key = ((self.nodes + end) << 32) + _cut(_sums_within(p, first))
        key[last] = (self.nodes + end[last] + 1) << 32
        nodes = self.nodes
        self._store(key, np.where(head, -1, nodes + before), self.hashed_ids[i], nodes + len(cp))
        self.end.update(zip(short, (nodes + stop - 1).tolist()))

    def _learn_each(self, stretches: list[str]) -> None:
        """Forward filtering of stretches of any length and of any characters, one by one."""
        key, prev, piece = [], [], []
        weight, ids, longest, rare, node = self.weight.get, self.ids, self.longest, self.rare, self.nodes
        for s in stretches:
            forward, base = [1.0], node
            place = [-1]  # the node of each position
            for i in range(1, len(s) + 1):
                total, inward = 0.0, []
                for j in range(max(0, i - longest), i):
                    w = weight(s[j:i])
                    if w is not None:
                        total += forward[j] * w
                        inward.append((total, place[j], ids[s[j:i]]))
                if s[i - 1] not in ids:
                    data, at = s[i - 1].encode("utf-8", "replace"), place[i - 1]
                    total += forward[i - 1] * rare
                    for b in data[:-1]:
                        key.append((node + 1) << 32)
                        prev.append(at)
                        piece.append(self.byte_id[b])
                        at = node
                        node += 1
                    inward.append((total, at, self.byte_id[data[-1]]))
                for t, p, k in inward[:-1]:
                    key.append((node << 32) + min(int(t / total * 2.0**32), 2**32 - 1))
                    prev.append(p)
                    piece.append(k)
                key.append((node + 1) << 32)
                prev.append(inward[-1][1])
                piece.append(inward[-1][2])
                place.append(node)
                node += 1
                forward.append(total)
                if total < 1e-200:
                    forward[-longest:] = [x * 1e200 for x in forward[-longest:]]
            self.end[s] = node - 1
        self._store(np.array(key, np.int64), np.array(prev, np.int64), np.array(piece, np.int64), node)

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts in a row, and n+1 offsets."""
        split = [self.stretch(" " + t) for t in texts]
        new = set().union(*split) - self.end.keys()
        if self.nodes > MAX_NODES:
            self.forget()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        count = np.array([len(x) for x in split], np.int64)
        end = self.end.__getitem__
        at = np.fromiter((end(s) for x in split for s in x), np.int64, int(count.sum()))
        first = np.cumsum(count) - count
        state = np.repeat(keys, count) + (np.arange(len(at)) - np.repeat(first, count)).astype(np.uint64) * common.MIX_1
        key = self.key[: self.n_edges]
        live, steps, taken, step = np.arange(len(at)), [], np.zeros(len(at), np.int64), 0
        while len(live):
            state = state + common.MIX_2
            u = (common.mixed(state) >> np.uint64(32)).astype(np.int64)
            edge = np.searchsorted(key, (at.astype(np.int64) << 32) + u, "right")
            steps.append((live, self.piece[edge]))
            step += 1
            at = self.prev[edge]
            on = at >= 0
            taken[live[~on]] = step
            live, at, state = live[on], at[on], state[on]
        stop = np.cumsum(taken)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (which, ids) in enumerate(steps):
            out[stop[which] - 1 - k] = ids
        edges = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
        return out, edges

    def text(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the id lists that at bounds: the pieces' bytes, without the blank that encoding put first."""
        size = self.size[ids]
        stop = np.cumsum(size)
        data = self.flat[np.repeat(self.at[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)].tobytes()
        edges = np.concatenate([[0], stop])[at].tolist()
        out = []
        for a, b in zip(edges, edges[1:]):
            t = data[a:b].decode("utf-8", "replace")
            out.append(t[1:] if t[:1] == " " else t)
        return out


_known: dict[tuple[str, float], Pieces] = {}


def pieces_at(path: str, alpha: float) -> Pieces:
    """One per Python worker, so that later tasks find the stretches of earlier ones."""
    if (path, alpha) not in _known:
        _known[path, alpha] = Pieces(path, alpha)
    return _known[path, alpha]


def row_keys(names: list[str], seed: int) -> np.ndarray:
    """A 64-bit key of each row's name."""
    data = np.frombuffer("".join(names).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in names])]).astype(np.int64)
    up, down = common.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return common.mixed((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + np.uint64(seed))


def encode(docs: DataFrame, model_path: str, row_key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and ids (array<int>), one sampled segmentation of every whole text.

    A null text gives null ids, an empty text none. Equal row keys with equal texts give equal ids; a null row key
    counts as the empty one. An empty table gives none; columns not in keep are left out.
    """
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.coalesce(F.col(row_key).cast("string"), F.lit("")).alias("__key"), F.col("text").cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_at(model_path, alpha)
        for batch in batches:
            for first, stop, _, _ in common.text_blocks(batch, "__text"):
                part = batch.slice(first, stop - first)
                texts = part.column("__text")
                ids, at = table.sample([x or "" for x in texts.to_pylist()], row_keys(part.column("__key").to_pylist(), seed))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                if texts.null_count:
                    lists = pa.compute.if_else(texts.is_null(), pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [lists], names=[*keep, "ids"])

    return source.mapInArrow(run, f"{head}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and text, decoded from ids; null ids give a null text."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_at(model_path, ALPHA)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column("ids")
                size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                texts = pa.array(table.text(ids, at), pa.string())
                if lists.null_count:
                    texts = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [texts], names=[*keep, "text"])

    return encoded.select(*dict.fromkeys((*keep, "ids"))).mapInArrow(run, f"{head}, text string")
