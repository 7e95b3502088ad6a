"""Benchmark passages in texts, in any order: greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import bare_words, discard, hash_words, mix, slices, split_words, written

#: Shortest tile, in words: also the length of a seed.
TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bytes of benchmark text matched in one pass; more items make more passes.
BLOCK_BYTES = 32 << 20


#: Fixed value: an odd factor, so that it has an inverse modulo 2**64.
FACTOR = 0x100000001B3


def karp_rabin(tokens: np.ndarray, size: int) -> np.ndarray:
    """The running hash of every window of ``size`` token hashes."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            out = out * np.uint64(FACTOR) + tokens[i : i + n]
        return mix(out)
    # a window's sum of token * factor**place, brought to the same power
    power, inverse = np.full(len(tokens), FACTOR, np.uint64), np.full(len(tokens), pow(FACTOR, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * np.multiply.accumulate(power))))
    return mix((sums[size:] - sums[:-size]) * np.multiply.accumulate(inverse)[:n])


def _matches_of(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (place in text, place in item, words) of at least ``size`` free words, by running hashes."""
    windows = []
    for words, free in ((text, free_text), (item, free_item)):
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[size:] == taken[:-size]) if len(words) >= size else np.zeros(0, int)
        windows.append((at, karp_rabin(words, size)[at]))
    (t, ht), (i, hi) = windows
    order = np.argsort(hi, kind="stable")
    i, hi = i[order], hi[order]
    low, high = np.searchsorted(hi, ht, "left"), np.searchsorted(hi, ht, "right")
    n = high - low
    t = np.repeat(t, n)
    if not len(t):
        return []
    i = i[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(t))]
    # windows that follow each other on a diagonal are one match
    order = np.lexsort((t, t - i))
    t, i = t[order], i[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (np.diff(t - i) != 0) | (np.diff(t) != 1)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(t))) + size - 1
    found = zip(t[first].tolist(), i[first].tolist(), sizes.tolist(), strict=True)
    return [(a, b, n) for a, b, n in found if (text[a : a + n] == item[b : b + n]).all()]


def tile(text: np.ndarray, item: np.ndarray, shortest: int = TILE, usable: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, words), longest first.

    Running Karp-Rabin greedy string tiling: matches of at least so many words
    are found by running hashes of unmarked windows and marked from the longest
    on (then by place in the text and in the item); one that meets marked words
    falls apart into its unmarked stretches.  The search length falls by half
    until it is ``shortest``.  ``usable`` tells which words of the text some
    seed covers; no other can be in a tile.
    """
    if usable is None:
        usable = np.ones(len(text), dtype=bool)
    # usable stretches, with one unusable word between them
    origin = np.flatnonzero(usable | np.concatenate(([False], usable[:-1])))
    text, free_text = text[origin], usable[origin]
    free_item = np.ones(len(item), dtype=bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], free_text, [False])).astype(np.int8)))
    longest = int((edges[1::2] - edges[::2]).max(initial=0))
    size, tiles = max(shortest, min(len(item), longest)), []
    while True:
        queue = [(-n, t, i) for t, i, n in _matches_of(text, item, free_text, free_item, size)]
        heapq.heapify(queue)
        while queue:
            n, t, i = heapq.heappop(queue)
            n = -n
            free = free_text[t : t + n] & free_item[i : i + n]
            if free.all():
                free_text[t : t + n] = free_item[i : i + n] = False
                tiles.append((int(origin[t]), i, n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8))).tolist()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= size:
                    heapq.heappush(queue, (a - b, t + a, i + a))
        if size == shortest:
            return tiles
        size = max(shortest, size // 2)


class Index:
    """Benchmark items and the running hashes of all their seeds, in an inverted index."""

    def __init__(self, ids: list, texts: list[str | None], shortest: int, coverage: float):
        words = split_words(pa.array(texts, pa.string()))
        hashed = hash_words(bare_words(words.vocab))[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        self.ids, self.shortest, self.tokens, self.offsets = ids, shortest, hashed, words.offsets
        seeds = karp_rabin(hashed, shortest)
        at = np.arange(len(seeds))
        owner = np.searchsorted(words.offsets, at, side="right") - 1
        inside = at + shortest <= words.offsets[owner + 1]
        at, owner, seeds = at[inside], owner[inside], seeds[inside]
        order = np.argsort(seeds, kind="stable")
        self.owner, seeds, place = owner[order], seeds[order], at[order]
        new = np.ones(len(seeds), dtype=bool)
        new[1:] = seeds[1:] != seeds[:-1]
        self.hashes, self.first = seeds[new], np.append(np.flatnonzero(new), len(seeds))
        # the entry of the seed one word before in the same item; the last place stands for none
        where = np.full(len(hashed) + 1, len(seeds))
        where[place] = np.arange(len(seeds))
        before = where[place - 1]
        self.before = np.where(place > self.offsets[self.owner], before, len(seeds))
        self.need = coverage * words.lengths
        self._hit = np.zeros(len(seeds) + 1, dtype=bool)
        self._cover = np.zeros(len(words.lengths), dtype=np.int64)

    def item(self, k: int) -> np.ndarray:
        return self.tokens[self.offsets[k] : self.offsets[k + 1]]

    def candidates(self, which: np.ndarray) -> np.ndarray:
        """Items whose seeds among ``which`` (places in ``hashes``) cover enough words to be found.

        A seed adds all its words, or one if the seed before it is there too;
        every entry of the index is met once at most, however often the text
        repeats a seed and however many items share it.
        """
        low, n = self.first[which], self.first[which + 1] - self.first[which]
        entries = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        self._hit[entries] = True
        owner = self.owner[entries]
        np.add.at(self._cover, owner, np.where(self._hit[self.before[entries]], 1, self.shortest))
        found = np.unique(owner[self._cover[owner] >= self.need[owner]])
        self._hit[entries], self._cover[owner] = False, 0
        return found


def _matches(part: pa.RecordBatch, index: Index, coverage: float) -> pa.RecordBatch | None:
    shortest = index.shortest
    words = split_words(part.column("text"))
    if len(words.codes) < shortest or not len(index.hashes):
        return None
    tokens = hash_words(bare_words(words.vocab))[words.codes]
    seeds = karp_rabin(tokens, shortest)
    at = np.minimum(np.searchsorted(index.hashes, seeds), len(index.hashes) - 1)
    hit = np.flatnonzero(index.hashes[at] == seeds)
    row = np.searchsorted(words.offsets, hit, side="right") - 1
    inside = hit + shortest <= words.offsets[row + 1]
    hit, row = hit[inside], row[inside]
    found = []
    for group in np.split(hit, np.flatnonzero(np.diff(row)) + 1) if len(hit) else []:
        r = int(np.searchsorted(words.offsets, group[0], side="right") - 1)
        begin = int(words.offsets[r])
        text = tokens[begin : int(words.offsets[r + 1])]
        for k in index.candidates(np.unique(at[group])).tolist():
            item = index.item(k)
            shared = group[np.isin(seeds[group], karp_rabin(item, shortest))] - begin
            edges = np.bincount(shared, minlength=len(text) + 1) - np.bincount(shared + shortest, minlength=len(text) + 1)
            tiles = tile(text, item, shortest, np.cumsum(edges[:-1]) > 0)
            covered = sum(n for _, _, n in tiles)
            if tiles and covered >= coverage * len(item):
                found.append((r, index.ids[k], covered / len(item), covered, len(tiles), min(t for t, _, _ in tiles), max(t + n for t, _, n in tiles)))
    if not found:
        return None
    owner, ids, share, covered, count, first, last = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").take(pa.array(owner)), pa.array(ids), pa.array(share), pa.array(covered, pa.int32()), pa.array(count, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
        ["doc_id", "item_id", "coverage", "covered", "tiles", "first_word", "end_word"],
    )


def _items(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(texts, blocks): distinct texts of the benchmark with the ids that have them, and how many
    blocks of about ``block_bytes`` they make.  Equal texts are matched once, however often they come."""
    items = benchmark.select("item_id", "text").where("text is not null")
    texts = written(items.groupBy("text").agg(F.count("*").alias("rows")), "benchmark_texts")
    return texts, max(1, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, covered, tiles, first_word, end_word): texts that hold an item.

    Words are compared in lower case without punctuation at their ends.  A row
    stands for one input row and one item whose words are covered by
    non-overlapping tiles of at least ``shortest`` words to ``coverage`` or
    more, in whatever order the tiles come.  Items of fewer words than a tile,
    null or empty texts match nothing; null ids are returned as they are, and
    repeated rows or items each give their own rows.  Other columns, whatever
    their names, are not looked at.

    The benchmark's size is summed up first.  Its distinct texts are matched in
    blocks of about ``block_bytes``, each sent to the workers whole, so that
    what they and the driver hold stays bounded however large it is.  Found texts then get their ids by a join, for which the matches of
    a text come together in parts that Spark can split.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    items, blocks = _items(benchmark, block_bytes)
    texts = docs.select("doc_id", "text").where("text is not null")
    schema = f"doc_id {kind}, text_key string, coverage double, covered int, tiles int, first_word int, end_word int"

    def match(block: int) -> tuple[DataFrame, Broadcast]:
        table = items.where(F.expr(f"pmod(xxhash64(text), {blocks}) = {block}")).select("text", F.md5("text").alias("key")).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((table["key"].to_pylist(), table["text"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(*sent.value, shortest, coverage)
            for part in slices(batches, "text"):
                found = _matches(part, index, coverage)
                if found is not None:
                    yield found.rename_columns([*found.schema.names[:1], "text_key", *found.schema.names[2:]])

        return texts.mapInArrow(run, schema), sent

    out, _ = match(0) if blocks == 1 else (None, None)
    for block in range(blocks if blocks > 1 else 0):
        found, sent = match(block)
        found = written(found, "matches")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    discard(items)
    ids = benchmark.where("text is not null").select("item_id", F.md5("text").alias("text_key"))
    return out.join(ids, "text_key").select("doc_id", "item_id", "coverage", "covered", "tiles", "first_word", "end_word")


def clean(docs: DataFrame, benchmark: DataFrame, shortest: int = TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows with a null text stay.

    Each block of the benchmark is one more pass over the rows that are left;
    nothing is joined or shuffled.  Between passes what is left is written, so
    that the driver holds one block at a time.
    """
    items, blocks = _items(benchmark, block_bytes)

    def keep(rows: DataFrame, block: int) -> tuple[DataFrame, Broadcast]:
        table = items.where(F.expr(f"pmod(xxhash64(text), {blocks}) = {block}")).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(table["text"].to_pylist())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(list(range(len(sent.value))), sent.value, shortest, coverage)
            for part in slices(batches, "text"):
                numbered = pa.RecordBatch.from_arrays([pa.array(range(part.num_rows)), part.column("text")], ["doc_id", "text"])
                found = _matches(numbered, index, coverage)
                kept = np.ones(part.num_rows, dtype=bool)
                if found is not None:
                    kept[np.asarray(found.column("doc_id"))] = False
                yield part.filter(pa.array(kept))

        return rows.mapInArrow(run, docs.schema), sent

    kept, past = docs, None
    for block in range(blocks - 1):
        left, sent = keep(kept, block)
        kept = written(left, "clean_rows")
        sent.destroy()
        if past is not None:
            discard(past)
        past = kept
    left, _ = keep(kept, blocks - 1)
    discard(items)
    return left
