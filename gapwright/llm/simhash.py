"""SimHash near-duplicates: pigeonring candidates, exact Hamming links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import discard, free_names, slices, written
from gapwright.llm.components import connected

#: Bit ranges of the five ring segments of a 64-bit fingerprint.
RING = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
#: Fingerprints of one key that a task compares; larger keys are cut into blocks.
BLOCK = 20_000


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a whole text, unsigned.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; each shingle of
    ``width`` words, repeats included, votes with its XXH64.  Fewer words make
    one shingle; no word (or null) gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    votes = np.zeros(64, dtype=np.int64)
    count = len(words) - width + 1
    for at in range(0, count, 1 << 16):
        stop = min(count, at + (1 << 16))
        pairs = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], seed) for i, j in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, tkey, fp) per input row: a hash that tells texts of one id apart,
    and the fingerprint as a signed bigint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.fromiter((simhash(t, width) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), pa.array(found.view(np.int64))], ["doc_id", "tkey", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, tkey bigint, fp bigint")


def _segment(i: int) -> np.uint64:
    low, high = RING[i % len(RING)]
    return np.uint64(((1 << high) - 1) ^ ((1 << low) - 1))


#: Which two of the four halves of the second and third segment a key holds.
HALVES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def chain_keys(fp: str = "fp") -> F.Column:
    """Ring keys of a fingerprint, as an array of bigint.

    Two fingerprints with at most 4 differing bits have a segment from which
    every chain of l segments differs in at most floor(4 l / 5) bits: none in
    the first, at most one in the first two, at most two in the first three.
    So they agree on that segment, on a half of the second, and, if not on
    both, on a half of the third; each such choice makes a key of some 26 bits.
    """
    keys = []
    for i in range(len(RING)):
        low, high = RING[i]
        halves = []
        for a, b in (RING[(i + 1) % len(RING)], RING[(i + 2) % len(RING)]):
            halves += [(a, (a + b) // 2), ((a + b) // 2, b)]
        cut = lambda a, b: f"(shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)"
        for h, (x, y) in enumerate(HALVES):
            keys.append(F.expr(f"shiftleft({cut(low, high)}, 20) | shiftleft({cut(*halves[x])}, 12) | shiftleft({cut(*halves[y])}, 5) | {len(HALVES) * i + h}L"))
    return F.array(*keys)


def _chained(diff: np.ndarray, start: int, budget: int) -> np.ndarray:
    """Pigeonring: which differences keep every chain from ``start`` within its share."""
    ok = np.ones(len(diff), dtype=bool)
    total = np.zeros(len(diff), dtype=np.uint8)
    for step in range(len(RING)):
        total = total + np.bitwise_count(diff & _segment(start + step))
        ok &= total <= (step + 1) * budget // len(RING)
    return ok


def _stars(fps: np.ndarray, start: int, budget: int) -> list[tuple[int, int]]:
    """Star edges (hub, node) of the links among distinct ``fps`` of one key.

    Breadth-first search: what is reached is never compared again, so a dense
    group costs about as many comparisons as it has members.
    """
    rest, edges = fps, []
    while len(rest):
        hub, rest = rest[0], rest[1:]
        queue = [hub]
        while queue and len(rest):
            near = rest ^ queue.pop()
            hit = _chained(near, start, budget)
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                queue.extend(found)
                edges.extend((int(hub), int(x)) for x in found)
    return edges


def _forest(a: list[int], b: list[int]) -> np.ndarray:
    """Places of edges that join what the ones before them have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _links(budget: int):
    """mapInArrow over rows (key, part, fp) that arrive sorted by (key, part)."""

    def flush(keys: np.ndarray, parts: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edges_a, edges_b = [], []
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(keys)))
        group = np.cumsum(new) - 1
        small = sizes[group] <= 8
        for step in range(1, 8):
            left = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if len(keys) > step else np.zeros(0, int)
            if not len(left):
                break
            diff = fps[left] ^ fps[left + step]
            lead = ((keys[left] & 31) // len(HALVES)).astype(np.int64)
            for i in range(len(RING)):
                of = lead == i
                if of.any():
                    hit = left[of][_chained(diff[of], i, budget)]
                    edges_a.append(fps[hit])
                    edges_b.append(fps[hit + step])
        for g in np.flatnonzero(sizes > 8):
            at, n = starts[g], sizes[g]
            found = _stars(np.unique(fps[at : at + n]), int(keys[at] & 31) // len(HALVES), budget)
            if found:
                both = np.array(found, dtype=np.uint64)
                edges_a.append(both[:, 0])
                edges_b.append(both[:, 1])
        a = np.concatenate(edges_a) if edges_a else np.zeros(0, np.uint64)
        b = np.concatenate(edges_b) if edges_b else np.zeros(0, np.uint64)
        keep = _forest(a.tolist(), b.tolist())
        return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64))
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (now[0][0], now[1][0])):
                done = [*held, tuple(x[:cut] for x in now)]
                yield flush(*(np.concatenate([d[i] for d in done]) for i in range(3)))
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield flush(*(np.concatenate([d[i] for d in held]) for i in range(3)))

    return run


def near_links(prints: DataFrame, budget: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all distinct ``fp`` linked within ``budget`` bits.

    Of the keys of one batch only a spanning forest of their links is kept, so a
    large group of near copies gives at most one edge a member and key and not
    all pairs; the components are those of all links.  A key with more than ``block``
    fingerprints is cut into blocks whose pairs are compared by separate tasks.
    """
    if budget > 4:
        raise ValueError("the ring of five segments serves at most 4 differing bits")
    spark = prints.sparkSession
    keyed = prints.select("fp").distinct().select(F.explode(chain_keys()).alias("key"), "fp")
    hot = keyed.groupBy("key").count().where(F.col("count") > block)
    hot = written(hot.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot_keys")
    if hot.isEmpty():
        discard(hot)
        dealt = keyed.select("key", F.lit(0).alias("part"), "fp")
    else:
        own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
        cells = F.expr("transform(sequence(0, blocks - 1), j -> least(j, own) * blocks + greatest(j, own))")
        cut = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        dealt = cut.select("key", F.explode(cells).alias("part"), "fp")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "fp")
    return rows.mapInArrow(_links(budget), "a bigint, b bigint").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """(doc_id, tkey, fp, root, component_id) per input row; root is the least
    fingerprint of the class, component_id its least id."""
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    roots = connected(near_links(prints, budget))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = written(known, "print_roots")
    # written first: over an exchange of its own, Spark can split the root of a large class
    class_id = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "class_ids")
    named = known.join(class_id, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per input row.

    component_id is the smallest id reachable through links of at most
    ``budget`` differing bits, the row's own included.  A null text counts as
    empty (fingerprint zero, linked like any other).  A null id takes part but
    is never the smallest; a group of null ids only has a null component_id.
    Repeated rows come back as often as they went in.  Other columns, whatever
    their names, are not looked at.
    """
    found = classes(docs, id_col, text_col, budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """One row of each group of near copies, all columns: that of the smallest
    id (a null id only if the group has no other); of several texts with that
    id the one of the least fingerprint, then the least hash; of equal rows one.

    Texts are not sent to Python again: the rows to keep are found by id and
    hash of the text in a semi-join.
    """
    found = written(classes(docs, id_col, text_col, budget).select("doc_id", "tkey", "fp", "root"), "classes")
    own, first_id, first_key = free_names(docs, "own", "first_id", "first_key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "tkey")
    first = found.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias(first_id), F.col("x.tkey").alias(first_key))
    first = written(first, "first_rows")
    repeated = not found.groupBy("doc_id", "tkey").count().where("count > 1").isEmpty()
    discard(found)
    marked = docs.withColumn(own, F.xxhash64(F.col(f"`{text_col}`")))
    kept = marked.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col(first_id)) & (F.col(own) == F.col(first_key)), "left_semi")
    if repeated:
        # each task keeps one of its equal rows before any are exchanged
        kept = kept.dropDuplicates([id_col, own])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
