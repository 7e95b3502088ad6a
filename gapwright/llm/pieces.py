"""N-best SentencePiece segmentation: forward Viterbi scores guide a backward A* search."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import slices

#: Where the public vocabulary lies; a parameter of every entry point.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose segmentations a worker remembers, and some more while it works on a slice.
MEMORY = 60_000
#: Bits of a cost that count pieces.
COUNT_BITS = 32
#: Stands for what no segmentation costs.
NO_GAP = 1 << 62
#: A vocabulary beyond this many pieces is not sent to the workers.
MAX_PIECES = 2_000_000


@dataclass
class Vocabulary:
    """Pieces (spaces as spaces) with id and cost; byte pieces; bytes of each id.

    A cost is the negative score times ``scale``, shifted, plus one a piece: sums
    are exact, and equal scores go to fewer pieces.
    """

    cost: dict[str, tuple[int, int]]
    byte_ids: list[int]
    text_of: list[bytes]
    unknown_cost: int
    scale: int = 1000
    prefixes: dict[str, tuple[int, int] | None] = field(init=False)
    cutter: re.Pattern = field(init=False)

    def __post_init__(self):
        if len(self.cost) > MAX_PIECES:
            raise ValueError("the vocabulary is too large to send to every worker")
        # every beginning of a piece, so that a look-up knows when to stop
        self.prefixes = {p[:n]: None for p in self.cost for n in range(1, len(p))} | self.cost
        inner_space = any(re.search(r"[^ ] ", p) for p in self.cost)
        used = set().union(*self.cost) if self.cost else set()
        lone = "".join(re.escape(c) for c in "\n\r\t" if c not in used)
        # no piece reaches over these cuts, so each part is a lattice of its own
        self.cutter = re.compile(r"(?s).+" if inner_space else rf" *[^ {lone}]+| +|[{lone}]" if lone else r" *[^ ]+| +")


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Reads a SentencePiece model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    # as fine as the costs of the longest words that are solved side by side fit 64 bits
    most = max(1.0, *map(abs, scores)) + 10
    scale = next(s for s in (10**6, 10**5, 10**4, 10**3, 100, 10, 1) if s == 1 or most * s * SideBySide.LONGEST < 1 << 62 - COUNT_BITS)
    cost, text_of = {}, []
    byte_ids = [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            text_of.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text_of.append(b"")
        else:
            plain = piece.replace("▁", " ")
            cost[plain] = (i, _cost(scores[i], scale))
            text_of.append(plain.encode())
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces, so it cannot give every text back")
    return Vocabulary(cost, byte_ids, text_of, _cost(min(scores) - 10, scale), scale)


def _cost(score: float, scale: int) -> int:
    return (round(-score * scale) << COUNT_BITS) + 1


def score_of(cost: int, v: Vocabulary) -> float:
    """The score of a path from its cost."""
    return -(cost >> COUNT_BITS) / v.scale


Edge = tuple[int, int, tuple[int, ...] | int, int]


def forward(text: str, v: Vocabulary) -> tuple[list[Edge], list[int]]:
    """All edges (start, end, id or ids, cost) by start, and the least cost from the start to every place.

    A character that no piece covers alone may always be spelt in bytes.
    """
    get, n = v.prefixes.get, len(text)
    best: list[int] = [0] + [1 << 200] * n
    edges: list[Edge] = []
    for s in range(n):
        base = best[s]
        if text[s] not in v.cost:
            spelt = text[s].encode("utf-8", "surrogatepass")
            cost = v.unknown_cost + len(spelt) - 1
            edges.append((s, s + 1, tuple(v.byte_ids[b] for b in spelt), cost))
            best[s + 1] = min(best[s + 1], base + cost)
        for e in range(s + 1, n + 1):
            found = get(text[s:e], 0)
            if found is None:
                continue
            if found == 0:
                break
            piece, cost = found
            edges.append((s, e, piece, cost))
            if base + cost < best[e]:
                best[e] = base + cost
    return edges, best


def nbest(text: str, n: int, v: Vocabulary) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best segmentations (cost, ids) of a text, best first; all if fewer.

    Forward: the least cost from the start to every place.  Backward: A* from
    the end with these as the exact rest, so paths leave the queue in order of
    their full cost.  Of equal costs those further on come first.
    """
    edges, best = forward(text, v)
    ends: list[list[Edge]] = [[] for _ in best]
    for edge in edges:
        ends[edge[1]].append(edge)
    queue = [(best[-1], len(text), 0, 0, None)]
    found, count = [], 0
    while queue and len(found) < n:
        total, at, _, done, tail = heapq.heappop(queue)
        if not at:
            found.append((total, _spelt(tail)))
            continue
        for s, _, piece, c in ends[at]:
            count += 1
            heapq.heappush(queue, (done + c + best[s], s, count, done + c, (piece, tail)))
    return found


def _spelt(tail: tuple | None) -> tuple[int, ...]:
    ids: list[int] = []
    while tail is not None:
        piece, tail = tail
        ids.extend(piece if type(piece) is tuple else (piece,))
    return tuple(ids)


def best_and_gap(text: str, v: Vocabulary) -> tuple[int, tuple[int, ...], int]:
    """Cost and ids of the best segmentation, and what the second best costs more (-1: there is none).

    The backward A* search with exact forward costs as its rest, until the first
    path is out: of the edges into a place on it one keeps the total (of
    several, the furthest on leaves the queue first), so each is expanded right
    away.  The second best is then the least total left in the queue.
    """
    edges, best = forward(text, v)
    ends: list[list[Edge]] = [[] for _ in best]
    for edge in edges:
        ends[edge[1]].append(edge)
    at, tail, queued = len(text), None, -1
    while at:
        onward = None
        for s, _, piece, c in ends[at]:
            extra = best[s] + c - best[at]
            if not extra and onward is None:
                onward = (s, (piece, tail))
            elif queued < 0 or extra < queued:
                queued = extra
        at, tail = onward
    return best[-1], _spelt(tail), queued


def combine(parts: list[list[int]], n: int) -> list[tuple[int, list[int]]]:
    """The ``n`` least sums that take one of each part's sorted values: (sum, chosen)."""
    if any(not p for p in parts):
        return []
    start = (0,) * len(parts)
    queue, seen, found = [(sum(p[0] for p in parts), start)], {start}, []
    while queue and len(found) < n:
        total, chosen = heapq.heappop(queue)
        found.append((total, list(chosen)))
        for i, k in enumerate(chosen):
            if k + 1 < len(parts[i]):
                after = (*chosen[:i], k + 1, *chosen[i + 1 :])
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(queue, (total - parts[i][k] + parts[i][k + 1], after))
    return found


class SideBySide:
    """``best_and_gap`` of many short words at once, over a dense trie of the pieces.

    The trie holds the pieces whose characters are among the 255 most frequent
    in the vocabulary; ``fits`` tells which words need no others.
    """

    LONGEST = 24
    AT_ONCE = 20_000

    def __init__(self, v: Vocabulary):
        often: dict[str, int] = {}
        for piece in v.cost:
            for c in piece:
                often[c] = often.get(c, 0) + 1
        chars = sorted((c for c in often if c in v.cost), key=lambda c: (-often[c], c))[:255]
        self.cls = np.zeros(0x110000, dtype=np.uint8)
        for k, c in enumerate(chars):
            self.cls[ord(c)] = k + 1
        rank = {c: k + 1 for k, c in enumerate(chars)}
        nodes: dict[str, int] = {"": 0}
        links = []
        for piece in v.cost:
            if not all(c in rank for c in piece):
                continue
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    links.append((nodes[piece[: n - 1]], rank[piece[n - 1]], nodes[piece[:n]]))
        self.next = np.zeros((len(nodes), 256), dtype=np.int32)
        if links:
            at, cls, to = np.array(links).T
            self.next[at, cls] = to
        self.cost = np.full(len(nodes), -1, dtype=np.int64)
        self.id = np.zeros(len(nodes), dtype=np.int32)
        for text, node in nodes.items():
            if text in v.cost:
                self.id[node], self.cost[node] = v.cost[text]

    def fits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words, their lengths, their characters' classes as a padded matrix)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        cls = self.cls[np.minimum(points, 0x10FFFF)]
        starts = np.cumsum(lengths) - lengths
        ok = (lengths > 0) & (lengths <= self.LONGEST)
        ok &= np.minimum.reduceat(np.append(cls, 1), np.minimum(starts, len(cls))) > 0 if len(words) else ok
        which = np.flatnonzero(ok)
        which = which[np.argsort(-lengths[which], kind="stable")]
        size = lengths[which]
        grid = np.zeros((len(which), self.LONGEST + 1), dtype=np.uint8)
        row = np.repeat(np.arange(len(which)), size)
        col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        grid[row, col] = cls[starts[which][row] + col]
        return which, size, grid

    def solve(self, size: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cost, gap, ids flat, ids a word) of words, longest first."""
        m, longest = len(size), int(size[0])
        far = np.int64(1) << 62
        best = np.full((m, longest + 1), far)
        best[:, 0] = 0
        edges = []
        for s in range(longest):
            at = np.arange(np.searchsorted(-size, -s, side="left"))
            node, e = self.next[0, grid[at, s]], s
            while len(at):
                e += 1
                alive = node > 0
                at, node = at[alive], node[alive]
                cost = self.cost[node]
                here = np.flatnonzero(cost >= 0)
                if len(here):
                    i, c = at[here], cost[here]
                    best[i, e] = np.minimum(best[i, e], best[i, s] + c)
                    edges.append((s, e, i, c, node[here]))
                more = size[at] > e
                at, node = at[more], node[more]
                node = self.next[node, grid[at, e]]
        # backward, as in best_and_gap: the place of every word on its path moves on from end to end
        ends: list[list[tuple]] = [[] for _ in range(longest + 1)]
        for s, e, i, c, node in edges:
            ends[e].append((s, i, c, node))
        at, other = size.copy(), np.full(m, far)
        by, seen = np.zeros((m, longest + 1), dtype=np.int32), np.zeros((m, longest + 1), dtype=bool)
        for e in range(longest, 0, -1):
            here = at == e
            seen[:, e] = here
            done = ~here
            for s, i, c, node in ends[e]:
                on = here[i]
                i, c, node = i[on], c[on], node[on]
                extra = best[i, s] + c - best[i, e]
                onward = (extra == 0) & ~done[i]
                j = i[onward]
                done[j], at[j], by[j, e] = True, s, self.id[node[onward]]
                j = i[~onward]
                other[j] = np.minimum(other[j], extra[~onward])
        return best[np.arange(m), size], np.where(other < far, other, -1), by[seen], seen.sum(axis=1)


class Segmenter:
    """Segments whole texts, remembering the parts between cuts.

    Of each part: the score and the pieces of its best cost, what the second
    best costs more, and where its ids lie.
    """

    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n = v, n
        self.known: dict[str, int] = {}
        self.many = SideBySide(v)
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.texts: list[str] = []
        self.spelt, self.first, self.count = array("i"), array("q", [0]), array("q")
        self.score, self.weight, self.gap = array("q"), array("q"), array("q")
        self.searched: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def _learn(self, texts: list[str], score: np.ndarray, weight: np.ndarray, gap: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        start, at = len(self.texts), self.first[-1]
        self.known.update(zip(texts, range(start, start + len(texts)), strict=True))
        self.texts += texts
        self.spelt.frombytes(ids.astype("<i4").tobytes())
        for mine, new in ((self.score, score), (self.weight, weight), (self.gap, gap), (self.count, count), (self.first, at + np.cumsum(count))):
            mine.frombytes(np.asarray(new, dtype=np.int64).tobytes())

    def _part(self, text: str) -> None:
        cost, ids, gap = best_and_gap(text, self.v)
        low = (1 << COUNT_BITS) - 1
        gap = NO_GAP if gap < 0 else min(gap, NO_GAP)
        self._learn([text], np.array([cost >> COUNT_BITS]), np.array([cost & low]), np.array([gap]), np.array(ids), np.array([len(ids)]))

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The parts of many texts; new ones are learned side by side."""
        if len(self.known) > MEMORY:
            self.clear()
        cut = self.v.cutter.findall
        parts = [cut(" " + text) if text else [] for text in texts]
        words = list(set().union(*parts).difference(self.known))
        which, size, grid = self.many.fits(words)
        for a in range(0, len(which), SideBySide.AT_ONCE):
            part = slice(a, a + SideBySide.AT_ONCE)
            cost, gap, ids, count = self.many.solve(size[part], grid[part])
            chosen = [words[k] for k in which[part].tolist()]
            self._learn(chosen, cost >> COUNT_BITS, cost & ((1 << COUNT_BITS) - 1), np.where(gap < 0, NO_GAP, gap), ids, count)
        for k in np.setdiff1d(np.arange(len(words)), which).tolist():
            self._part(words[k])
        return parts

    def ways(self, found: list[str]) -> list[tuple[int, np.ndarray]]:
        """Of prepared parts: the n best segmentations (cost, ids as int32), best first; all if fewer."""
        if not found:
            return [(0, np.zeros(0, dtype="<i4"))]
        view = lambda x, kind=np.int64: np.frombuffer(x, dtype=kind)
        parts = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        count = view(self.count)[parts]
        ends = np.cumsum(count)
        ids = view(self.spelt, "<i4")[np.repeat(view(self.first)[parts] - ends + count, count) + np.arange(ends[-1])]
        base = (int(view(self.score)[parts].sum()) << COUNT_BITS) + int(view(self.weight)[parts].sum())
        if self.n == 1:
            return [(base, ids)]
        out = []
        for extra, other in self._others(parts, view(self.gap)[parts]):
            now = ids
            for k in sorted(other, reverse=True):
                now = np.concatenate([now[: ends[k] - count[k]], np.array(other[k], dtype="<i4"), now[ends[k] :]])
            out.append((base + extra, now))
        return out

    def _others(self, parts: np.ndarray, gaps: np.ndarray) -> list[tuple[int, dict[int, tuple[int, ...]]]]:
        """The n best ways beyond the best: (extra cost, other ids by part).

        Only the n - 1 parts with the least second-best gaps can matter (the
        first ones on ties): any other change has that many cheaper ones ahead of it.
        """
        few = range(len(gaps))
        if len(gaps) > self.n - 1:
            edge = np.partition(gaps, self.n - 2)[self.n - 2]
            few = np.concatenate([np.flatnonzero(gaps < edge), np.flatnonzero(gaps == edge)])[: self.n - 1].tolist()
        paths = [self._paths(int(parts[k])) for k in few]
        values = [[c - p[0][0] for c, _ in p] for p in paths]
        return [(total, {few[j]: paths[j][x][1] for j, x in enumerate(chosen) if x}) for total, chosen in combine(values, self.n)]

    def _paths(self, part: int) -> list[tuple[int, tuple[int, ...]]]:
        if part not in self.searched:
            if len(self.searched) > MEMORY // 4:
                self.searched.clear()
            self.searched[part] = nbest(self.texts[part], self.n, self.v)
        return self.searched[part]

    def all(self, text: str) -> list[tuple[int, list[int]]]:
        """The n best segmentations (cost, ids) of a whole text; an empty text has one of no pieces."""
        return [(cost, ids.tolist()) for cost, ids in self.ways(self.prepare([text])[0])]


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of a segmentation: pieces joined, the leading space dropped."""
    return b"".join(map(v.text_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


_kept: list[tuple[Vocabulary, Segmenter]] = []


def _segmenter(v: Vocabulary, n: int) -> Segmenter:
    """The worker's segmenter for an equal vocabulary: its memory outlives a task."""
    for seen, segmenter in _kept:
        if segmenter.n == n and (seen is v or (len(seen.cost) == len(v.cost) and seen.cost == v.cost)):
            return segmenter
    del _kept[:]
    _kept.append((v, Segmenter(v, n)))
    return _kept[0][1]


def encode(docs: DataFrame, v: Vocabulary, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segmentations): the n best of each whole text, array<struct<score, ids>>.

    An empty text has one segmentation of no pieces; a null text has null.  Ids
    may be null or repeated; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(v)
    struct = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _segmenter(sent.value, n)
        for part in slices(batches, "text", 2 << 20):
            out = [None if t is None else [{"score": score_of(c, s.v), "ids": ids} for c, ids in s.all(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, struct)], ["doc_id", "segmentations"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, segmentations array<struct<score double, ids array<int>>>")


def decode_column(encoded: DataFrame, v: Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with ``text_col`` spelt from ``ids_col`` (null for null)."""
    sent = encoded.sparkSession.sparkContext.broadcast(v)

    @F.pandas_udf("string")
    def spell(ids):
        return ids.map(lambda x: None if x is None else decode(list(x), sent.value))

    return encoded.withColumn(text_col, spell(ids_col))


def digest(docs: DataFrame, v: Vocabulary, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, scores, round_trip, nbest_sha256) of each whole text.

    scores and nbest_sha256 are those of the n best segmentations, best first;
    digests are of their ids as little-endian int32, ids_sha256 the best one's;
    round_trip tells whether that decodes to the very text.  A null text counts
    as empty, with no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _segmenter(sent.value, n)
        for part in slices(batches, "text", 2 << 20):
            count, sha, scores, same = [], [], [], []
            texts = part.column("text").to_pylist()
            for text, parts in zip(texts, s.prepare(texts), strict=True):
                ways = s.ways(parts)
                found = ways[0][1]
                count.append(len(found))
                sha.append([hashlib.sha256(ids.tobytes()).hexdigest() for _, ids in ways])
                scores.append([score_of(c, s.v) for c, _ in ways])
                same.append(decode(found.tolist(), s.v) == (text or ""))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(count, pa.int64()), pa.array([x[0] for x in sha], pa.string()), pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_()), pa.array(sha, pa.list_(pa.string()))],
                ["doc_id", "n_pieces", "ids_sha256", "scores", "round_trip", "nbest_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces bigint, ids_sha256 string, scores array<double>, round_trip boolean, nbest_sha256 array<string>")
