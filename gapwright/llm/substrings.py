"""Repeated passages: recompression names consistent symbols, shared ones are verified.

Every text is rewritten in rounds.  A round names runs of a symbol, then pairs
of neighbours (left class, right class); the classes and the names are hashes,
so all tasks give equal content equal names without exchanging any.  A symbol
also carries the words that decide that it stands there at all.  If these lie
within a window, every occurrence of the window holds the symbol at the same
place: it is interior and consistent.  Each window is led by its best interior
symbol of the highest level, and only windows under a symbol that several
documents share are compared, by 126-bit content hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import discard, hash_words, mix, slices, split_words, written

WINDOW = 50
LEVELS = 6
#: Words rewritten at once; longer texts are cut into pieces that overlap by a window.
PIECE = 1 << 17
#: Texts that a worker gets at once.
BATCH_ROWS = 1000

Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _salted(round_: int, kind: int) -> np.uint64:
    return np.uint64((round_ * 4 + kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _runs(level: Level, words: np.ndarray, round_: int) -> Level:
    """Names maximal runs.  A run's neighbour is known to differ from its
    adjoining word alone, unless that word agrees; then from all it rests on."""
    name, start, stop, need_from, need_to, piece = level
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(name)) - 1
    count = last - first + 1
    a, b = start[first], stop[last]
    left = np.minimum(need_from[first], a - 1)
    before = np.maximum(first - 1, 0)
    inside = (first > 0) & (piece[before] == piece[first])
    alike = inside & (words[np.maximum(a - 1, 0)] == words[stop[first] - 1])
    left = np.where(alike, need_from[before], left)
    right = np.maximum(need_to[last], b + 1)
    after = np.minimum(last + 1, len(name) - 1)
    inside = (last < len(name) - 1) & (piece[after] == piece[last])
    alike = inside & (words[np.minimum(b, len(words) - 1)] == words[start[last]])
    right = np.where(alike, need_to[after], right)
    named = name[first]
    long = count > 1
    named[long] = mix(named[long] ^ mix(count[long].astype(np.uint64) + _salted(round_, 0)))
    return named, a, b, left, right, piece[first]


def _pairs(level: Level, round_: int) -> Level:
    """Names pairs of a left-class symbol and a right-class symbol.

    A pair rests on its two symbols; a single left one also on its right
    neighbour, a single right one on its left neighbour.
    """
    name, start, stop, need_from, need_to, piece = level
    n = len(name)
    right_class = (mix(name ^ _salted(round_, 1)) & np.uint64(1)).astype(bool)
    joined = np.zeros(n, dtype=bool)  # with the next one
    joined[:-1] = ~right_class[:-1] & right_class[1:] & (piece[:-1] == piece[1:])
    taken = np.zeros(n, dtype=bool)
    taken[1:] = joined[:-1]
    left, right = need_from.copy(), need_to.copy()
    same_before = np.zeros(n, dtype=bool)
    same_before[1:] = piece[1:] == piece[:-1]
    same_after = np.zeros(n, dtype=bool)
    same_after[:-1] = same_before[1:]
    alone = ~joined & ~taken
    at = np.flatnonzero(alone & ~right_class)
    right[at] = np.where(same_after[at], need_to[np.minimum(at + 1, n - 1)], np.maximum(need_to[at], stop[at] + 1))
    at = np.flatnonzero(alone & right_class)
    left[at] = np.where(same_before[at], need_from[at - 1], np.minimum(need_from[at], start[at] - 1))
    named, ends = name.copy(), stop.copy()
    at = np.flatnonzero(joined)
    named[at] = mix(mix(name[at] ^ _salted(round_, 2)) + np.uint64(3) * name[at + 1])
    ends[at], right[at] = stop[at + 1], need_to[at + 1]
    keep = ~taken
    return named[keep], start[keep], ends[keep], left[keep], right[keep], piece[keep]


def recompress(words: np.ndarray, piece: np.ndarray, levels: int = LEVELS) -> list[Level]:
    """Levels of (name, first word, end, needed from, needed to, piece), words first.

    The needed range is what must recur for the symbol to recur; it leaves the
    piece where the piece's border decides.
    """
    at = np.arange(len(words), dtype=np.int64)
    found: list[Level] = [(words, at, at + 1, at, at + 1, piece)]
    for round_ in range(levels):
        found.append(_pairs(_runs(found[-1], words, round_), round_))
    return found


def leaders(levels: list[Level], window: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window (its first word): level, symbol, first word and name of its leader.

    The leader is the interior symbol of the highest level that has one: the
    longest (up to 15 words), then the greatest hash, then the leftmost.
    """
    level_of = np.full(len(window), -1, dtype=np.int64)
    symbol = np.zeros(len(window), dtype=np.int64)
    start_of = np.zeros(len(window), dtype=np.int64)
    name_of = np.zeros(len(window), dtype=np.uint64)
    words = len(levels[0][0])
    for k in range(len(levels) - 1, -1, -1):
        name, start, stop, need_from, need_to, _ = levels[k]
        open_ = np.flatnonzero(level_of < 0)
        if not len(open_):
            break
        p = window[open_]
        low = np.cumsum(np.bincount(need_from + 1, minlength=words + 2))[p]
        high = np.cumsum(np.bincount(need_to, minlength=words + 2))[p + size]
        some = high > low
        open_, low, high = open_[some], low[some], high[some]
        if not len(open_):
            continue
        new = np.ones(len(open_), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.cumsum(new) - 1
        low, high = low[new], high[new]
        rank = (np.minimum(stop - start, 15).astype(np.uint64) << np.uint64(60)) | (mix(name) >> np.uint64(4))
        depth = np.floor(np.log2(high - low)).astype(np.int64)
        best, table = low.copy(), np.arange(len(name))
        for d in range(int(depth.max()) + 1):
            if d:
                step = 1 << (d - 1)
                a, b = table[:-step], table[step:]
                table = np.where(rank[a] >= rank[b], a, b)
            at = np.flatnonzero(depth == d)
            a, b = table[low[at]], table[high[at] - (1 << d)]
            best[at] = np.where(rank[a] >= rank[b], a, b)
        chosen = best[group]
        level_of[open_], symbol[open_] = k, chosen
        start_of[open_] = start[chosen]
        name_of[open_] = mix(name[chosen] + _salted(k, 3))
    return level_of, symbol, start_of, name_of


#: Two primes below 2**31, and the bases of the hashes modulo them.
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525))


@cache
def _powers(prime: int, base: int, bits: int) -> np.ndarray:
    """base**k modulo a prime, for 2**bits places."""
    out = np.ones(1 << bits, dtype=np.uint64)
    for k in range(bits):
        n = 1 << k
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, prime)) % np.uint64(prime)
    return out


class Rolling:
    """126-bit content hashes of word ranges.

    The first half is a polynomial hash modulo 2**64, the second two modulo
    primes: word patterns that defeat powers of two leave these apart.
    """

    def __init__(self, vocab_hashes: tuple[np.ndarray, np.ndarray], codes: np.ndarray):
        n, (one, two), factor = len(codes) + 1, vocab_hashes, 0x9E3779B97F4A7C15
        power, inverse = np.full(n, factor, np.uint64), np.full(n, pow(factor, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(one[codes] * power[:-1], out=sums[1:])
        self.first, self.others, bits = (sums, inverse), [], max(1, n.bit_length())
        for (prime, base), shift in zip(PRIMES, (0, 32), strict=True):
            sums = np.zeros(n, dtype=np.uint64)
            small = (two >> np.uint64(shift) & np.uint64(0xFFFFFFFF)) % np.uint64(prime)
            np.cumsum(small[codes] * _powers(prime, base, bits)[: n - 1] % np.uint64(prime), out=sums[1:])
            self.others.append((sums, _powers(prime, pow(base, -1, prime), bits), np.uint64(prime)))

    def of(self, start: np.ndarray, stop: np.ndarray, extra: np.ndarray | int = 0) -> list[np.ndarray]:
        salt = np.asarray(extra).astype(np.uint64)
        a, b = ((sums[stop] - sums[start]) % prime * inverse[start] % prime for sums, inverse, prime in self.others)
        sums, inverse = self.first
        return [mix((sums[stop] - sums[start]) * inverse[start] + salt), mix((a << np.uint64(31) | b) + salt)]


def _hashed(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = vocab.to_pylist()
    return hash_words(values, 1), hash_words(values, 2)


def _pieces(lengths: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces: (word index, piece, row of each piece, first word within its row)."""
    index, number, rows, firsts, total = [], [], [], [], 0
    for row in np.flatnonzero(lengths >= window).tolist():
        n = int(lengths[row])
        for first in range(0, max(1, n - window + 1), PIECE):
            stop = min(n, first + PIECE + window - 1)
            index.append(np.arange(offsets[row] + first, offsets[row] + stop))
            number.append(np.full(stop - first, len(rows)))
            rows.append(row)
            firsts.append(first)
            total += stop - first
            if total >= PIECE:
                yield np.concatenate(index), np.concatenate(number), np.array(rows), np.array(firsts)
                index, number, rows, firsts, total = [], [], [], [], 0
    if rows:
        yield np.concatenate(index), np.concatenate(number), np.array(rows), np.array(firsts)


def _anchors(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """(sym, h1, h2, doc_id, dkey, p, n): windows p .. p + n - 1 led by one symbol.

    They start at most ``near`` words before the symbol, or all start further
    before it; sym hashes the symbol and the words that all of these hold (the
    symbol's first and those after it, or those before it).  The other hashes
    are of all their words and of the symbol's place among them.
    """
    near = window * 5 // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            words = split_words(part.column("text"))
            one, two = _hashed(words.vocab)
            for index, piece, rows, firsts in _pieces(words.lengths, words.offsets, window):
                codes = words.codes[index]
                ends = np.cumsum(np.bincount(piece))
                at = np.arange(len(codes))
                starts = at[at + window <= ends[piece]]
                levels = recompress(one[codes], piece)
                level, symbol, start, name = leaders(levels, starts, window)
                far = start - starts > near
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (level[1:] != level[:-1]) | (symbol[1:] != symbol[:-1]) | (starts[1:] != starts[:-1] + 1) | (far[1:] != far[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(starts)))
                p, a, far = starts[first], start[first], far[first]
                rolling = Rolling((one, two), codes)
                h1, h2 = rolling.of(p, p + count - 1 + window, a - p)
                sym = rolling.of(np.where(far, a - near - 1, a), np.where(far, a, a + window - near), name[first])[0]
                owner = pa.array(rows[piece[p]])
                begin = np.cumsum(np.bincount(piece)) - np.bincount(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sym.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                        part.column("doc_id").take(owner), part.column("dkey").take(owner),
                        pa.array((p - begin[piece[p]] + firsts[piece[p]]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    ["sym", "h1", "h2", "doc_id", "dkey", "p", "n"],
                )

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "dkey", "text")
    return rows.mapInArrow(run, f"sym bigint, h1 bigint, h2 bigint, doc_id {kind}, dkey bigint, p int, n int")


def _removed(gone: list[tuple[int, int]], words: list[bytes], window: int) -> tuple[int, str]:
    """Words covered by the windows (first, count), and the digest of the others."""
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for p, n in gone:
        cover[p] += 1
        cover[p + n + window - 1] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    kept = words if not covered.any() else [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
    return int(covered.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per input row.

    A word goes if a window of ``window`` words covers it whose words also
    start a window in a row with a smaller id; all windows are judged on the
    input.  A null text has no words.  A row with a null id is neither ahead of
    any other nor behind one, so it loses nothing.  Rows of equal id do not
    remove each other's windows, and equal rows get equal results.  Other
    columns, whatever their names, are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("dkey", F.xxhash64("text"))
    anchors = written(_anchors(docs, kind, window), "anchors", BATCH_ROWS)

    # a symbol of one document only is dropped: most are
    spread = anchors.groupBy("sym").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # sums that a join on their own key needs are written first: over an exchange of
    # its own, Spark can split a symbol that a third of all rows hold
    spread = written(spread.select("sym"), "shared_symbols")
    every, anchors = anchors, written(anchors.join(spread, "sym", "left_semi"), "shared_anchors")
    discard(every, spread)

    # equal surroundings: the smallest id keeps its windows, all others lose theirs
    context = ["sym", "h1", "h2"]
    firsts = anchors.groupBy(*context).agg(F.min("doc_id").alias("first"))
    several = firsts.groupBy("sym").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("sym")
    several = written(several, "several_contexts")
    firsts = written(firsts.join(several.withColumn("ask", F.lit(True)), "sym", "left"), "contexts")
    discard(several)
    flagged = anchors.join(firsts, context).where("doc_id > first or ask")
    flagged = flagged.select("doc_id", "dkey", F.struct("p", "n", (F.col("doc_id") > F.col("first")).alias("gone")).alias("x"))
    # repeated rows give the same windows more than once
    flags = flagged.groupBy("doc_id", "dkey").agg(F.collect_set("x").alias("flags"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("p", pa.int32()), ("n", pa.int32())]))
        for part in slices(batches, "text", 2 << 20):
            out: dict[str, list] = {x: [] for x in ("n_words", "n_removed", "kept_sha256", "text", "gone", "ask")}
            for text, found in zip(part.column("text").to_pylist(), part.column("flags").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = [(x["p"], x["n"]) for x in found or () if x["gone"]]
                ask = [(x["p"], x["n"]) for x in found or () if not x["gone"]]
                removed, digest = _removed(gone, words, window)
                later = bool(ask)
                out["n_words"].append(len(words))
                out["n_removed"].append(removed)
                out["kept_sha256"].append(digest)
                out["text"].append(text if later else None)
                out["gone"].append([{"p": p, "n": n} for p, n in gone] if later else None)
                out["ask"].append([{"p": p, "n": n} for p, n in ask] if later else None)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pair, pair)
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("dkey"), *arrays], ["doc_id", "dkey", *out])

    spans = "array<struct<p int, n int>>"
    schema = f"doc_id {kind}, dkey bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, gone {spans}, ask {spans}"
    settled = written(docs.join(flags, ["doc_id", "dkey"], "left").select("doc_id", "dkey", "text", "flags").mapInArrow(settle, schema), "settled", BATCH_ROWS)
    discard(anchors, firsts)

    # the others share a symbol but not its whole surroundings: compare window by window
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            words = split_words(part.column("text"))
            rolling = Rolling(_hashed(words.vocab), words.codes)
            rows, starts = [], []
            for row, ask in enumerate(part.column("ask").to_pylist()):
                for x in ask:
                    rows.append(np.full(x["n"], row))
                    starts.append(np.arange(x["p"], x["p"] + x["n"]))
            row, p = np.concatenate(rows), np.concatenate(starts)
            at = words.offsets[row] + p
            h1, h2 = rolling.of(at, at + window)
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column("doc_id").take(owner), part.column("dkey").take(owner), pa.array(p.astype(np.int32))],
                ["h1", "h2", "doc_id", "dkey", "p"],
            )

    open_ = settled.where("text is not null")
    asked = open_.select("doc_id", "dkey", "text", "ask").mapInArrow(windows, f"h1 bigint, h2 bigint, doc_id {kind}, dkey bigint, p int")
    asked = written(asked, "windows", BATCH_ROWS)
    least = written(asked.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "first_windows")
    lost = asked.join(least, ["h1", "h2"]).where("doc_id > first").groupBy("doc_id", "dkey").agg(F.collect_set("p").alias("lost"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            removed, digests = [], []
            for text, gone, lost in zip(*(part.column(c).to_pylist() for c in ("text", "gone", "lost")), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n, digest = _removed([(x["p"], x["n"]) for x in gone] + [(p, 1) for p in lost or ()], words, window)
                removed.append(n)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    ended = open_.join(lost, ["doc_id", "dkey"], "left").select("doc_id", "n_words", "text", "gone", "lost")
    ended = ended.mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    return settled.where("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(ended)
