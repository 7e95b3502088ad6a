"""Exact inner-product search over a pivot-distance index.

The largest inner product becomes the least distance once every vector gets
one more coordinate, sqrt(M - |x|^2) with M the largest squared norm (a query
gets 0).  Vectors are keyed by their nearest pivot and their distance to it;
for a query at distance d from the pivot and a known k-th score, only the
annulus d - t .. d + t can hold better ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwright.llm.common import discard, written

#: Pivots, and the most vectors (by hash of the id) that they are fitted on; every row is indexed.
PIVOTS, FIT_ROWS = 64, 4096
#: Most and fewest vectors of one block, and vectors of one step outwards.
BLOCK, LEAST_BLOCK, STEP = 8192, 256, 512
#: Bytes of queries that meet a block in one task; more are dealt into shares.
QUERY_BYTES = 32 << 20
#: Most distance rings of a pivot; fuller rings are dealt into shares.
RINGS = 64


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Rows of int64, short ones padded with zeros."""
    sizes = np.asarray(pc.list_value_length(values), dtype=np.int64)
    out = np.zeros((len(values), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(values.flatten())
    return out


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): components floor(scale * x); rows with a null id, a null
    vector, or a null or non-finite component are left out.  A component whose
    product does not fit 64 bits is an error."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.expr("forall(x, e -> e is not null and not isnan(cast(e as double)) and abs(cast(e as double)) < double('infinity'))"))
    floor = f"floor({scale} * cast(e as double))"
    checked = f"if(abs({scale} * cast(e as double)) < 9e18D, {floor}, cast(raise_error('a component leaves 64 bits') as bigint))"
    return rows.select("vec_id", F.expr(f"transform(x, e -> {checked})").alias("v"))


def _norms(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def fit_pivots(sample: np.ndarray, ceiling: float, count: int, rounds: int = 5) -> np.ndarray:
    """Pivots in the widened space: a farthest-first start, then a few means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] + 1))
    wide = np.concatenate([sample, np.sqrt(np.maximum(ceiling - _norms(sample), 0))[:, None]], axis=1).astype(np.float64)
    chosen = [int(np.argmax(_norms(wide - wide.mean(axis=0))))]
    gap = _norms(wide - wide[chosen[0]])
    while len(chosen) < min(count, len(wide)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _norms(wide - wide[chosen[-1]]))
    pivots = wide[chosen]
    for _ in range(rounds):
        near = _distances(wide, pivots).argmin(axis=1)
        pivots = np.stack([wide[near == k].mean(axis=0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


def _distances(wide: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = _norms(wide)[:, None] + _norms(pivots)[None, :] - 2 * wide @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _reach(score: float, norm: float, ceiling: float) -> float:
    """The widened distance at which that score lies, with slack for rounding."""
    return float(np.sqrt(max(norm + ceiling - 2 * score, 0.0)) * (1 + 1e-9) + 1e-3) if np.isfinite(score) else np.inf


def expand(q: np.ndarray, own: object, at: float, floor_: float, ids: np.ndarray, dist: np.ndarray, x: np.ndarray, k: int, ceiling: float) -> list[tuple[int, object]]:
    """The k best (score, id) of a block sorted by distance, own id excluded.

    Walks outwards from the query's distance ``at`` in steps and stops on a
    side once the triangle inequality rules out the rest of it.  ``floor_`` is
    a score that k other candidates are known to reach.
    """
    norm = float((q.astype(np.float64) ** 2).sum())
    best: list[tuple[int, object]] = []
    left = right = int(np.searchsorted(dist, at))
    reach = _reach(floor_, norm, ceiling)
    while True:
        down = at - dist[left - 1] if left > 0 else np.inf
        up = dist[right] - at if right < len(dist) else np.inf
        if min(down, up) > reach or (left == 0 and right == len(dist)):
            return best
        if down <= up:
            a, b = max(0, left - STEP), left
            left = a
        else:
            a, b = right, min(len(dist), right + STEP)
            right = b
        scores = x[a:b] @ q
        least = best[-1][0] if len(best) == k else floor_
        hit = np.flatnonzero((scores >= least) & (ids[a:b] != own)) if np.isfinite(least) else np.flatnonzero(ids[a:b] != own)
        if len(hit) > 4 * k:  # only the best can matter; ties at the edge stay
            edge = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
            hit = hit[scores[hit] >= edge]
        if len(hit):
            best = sorted([*best, *((int(scores[h]), ids[a + h]) for h in hit)], key=lambda z: (-z[0], z[1]))[:k]
            if len(best) == k:
                reach = min(reach, _reach(best[-1][0], norm, ceiling))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Components become floor(scale * x).  Queries are rows whose id is divisible
    by ``every``; candidates are all rows of another id.  Ties go to the smaller
    id; a query with fewer candidates has fewer ranks.  Rows with a null id, a
    null vector or a null or non-finite component take no part; components that
    a shorter vector lacks count as zero; equal rows count once.  Other columns
    are not looked at.

    Of equal vectors only the k + 1 least ids can be among a query's k best, so
    others are left out of the index before it is dealt out.  Scores that could
    leave 64 bits are an error.

    A query meets the rings of a pivot that its annulus reaches, and no others
    are ever paired with it: which these are follows from the ring borders
    alone, of which there are at most PIVOTS x RINGS.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = written(quantised(vectors, scale, id_col, vector_col).distinct(), "vectors")
    sizes = rows.agg(F.max(F.size("v")), F.max(F.expr("aggregate(v, 0L, (m, e) -> greatest(m, abs(e)))")), F.count("*")).first()
    width, peak, total = max(1, sizes[0] or 0), sizes[1] or 0, sizes[2]
    if peak**2 * width >= 1 << 63:
        raise ValueError(f"scores of components up to {peak} may not fit 64 bits")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            most = max(most, float(_norms(_matrix(batch.column(0), width)).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    ceiling = rows.select("v").mapInArrow(norms, "most double").agg(F.max("most")).first()[0] or 0.0
    exact = np.float64 if peak**2 * width < 1 << 53 else np.int64  # sums stay exact
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()["v"].combine_chunks()
    pivots = fit_pivots(_matrix(sample, width), ceiling, PIVOTS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.float64)
            wide = np.concatenate([x, np.sqrt(np.maximum(ceiling - _norms(x), 0))[:, None]], axis=1)
            dist = _distances(wide, pivots)
            near = dist.argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(x)), near])], ["vec_id", "v", "pivot", "dist"]
            )

    vector = "v array<bigint>"
    first = rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    placed = written(first.select("vec_id", "v").mapInArrow(place, f"vec_id {kind}, {vector}, pivot int, dist double"), "placed")

    # blocks: quantiles of the distance within each pivot, small enough for every task to get several
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = min(BLOCK, max(LEAST_BLOCK, total // (4 * tasks)))
    sized = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("dist", [i / RINGS for i in range(RINGS)], 2000).alias("edges"))
    cuts = F.expr(f"least({RINGS}, cast(ceil(n / {block}) as int))")
    cut = placed.join(F.broadcast(sized.withColumn("cuts", cuts)), "pivot")  # one row a pivot: at most PIVOTS
    ring = F.expr(f"cast(floor((size(filter(edges, e -> e <= dist)) - 1) * cuts / {RINGS}) as int)")
    cut = cut.withColumn("ring", F.greatest(ring, F.lit(0)))
    # a ring beyond the block size is dealt into shares by hash
    shares = F.expr(f"greatest(1, cast(ceil(n / cuts / {block}) as int))")
    cut = cut.withColumn("shares", shares).withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), shares) as int)"))
    data = written(cut.select("pivot", "ring", "part", "shares", "dist", "vec_id", "v"), "blocks")
    discard(placed)
    found = data.groupBy("pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("shares").alias("shares")).toArrow()  # at most PIVOTS x RINGS
    rings = {c: np.asarray(found[c]) for c in ("pivot", "ring", "low", "high", "shares")}

    def asked(seeding: bool):
        """Pairs queries with a first block near them, or with all others in reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column("v"), width).astype(np.float64)
                floors = batch.column("floor").to_pylist()
                at = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)[:, rings["pivot"]]
                gap = np.maximum(np.maximum(rings["low"] - at, at - rings["high"]), 0)
                home = np.lexsort((gap, at), axis=1)[:, 0] if gap.shape[1] else np.zeros(0, int)
                if seeding:
                    i, j = np.arange(len(q)), home
                else:
                    norm = _norms(q)
                    reach = np.array([_reach(-np.inf if f is None else f, n, ceiling) for f, n in zip(floors, norm, strict=True)])
                    wanted = gap <= reach[:, None]
                    wanted[np.arange(len(q)), home] &= rings["shares"][home] > 1  # its first share is known
                    i, j = np.nonzero(wanted)
                many = rings["shares"][j]
                first = np.repeat(np.cumsum(many) - many, many)
                i, j = np.repeat(i, many), np.repeat(j, many)
                part = np.arange(len(i)) - first
                own_home = home[i] == j
                keep = part == 0 if seeding else ~own_home | (part > 0)
                i, j, part = i[keep], j[keep], part[keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(i)) for c in ("query_id", "v", "floor")]
                    + [pa.array(rings[c][j], pa.int32()) for c in ("pivot", "ring")] + [pa.array(part, pa.int32()), pa.array(at[i, j])],
                    ["query_id", "v", "floor", "pivot", "ring", "part", "at"],
                )

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("dist")
            x = _matrix(left["v"].combine_chunks(), width).astype(exact)
            ids, dist = np.asarray(left["vec_id"]), np.asarray(left["dist"])
            q = _matrix(right["q"].combine_chunks(), width).astype(exact)
            for i, (own, at, floor_) in enumerate(zip(*(right[c].to_pylist() for c in ("query_id", "at", "floor")), strict=True)):
                found = expand(q[i], own, at, -np.inf if floor_ is None else floor_, ids, dist, x, k, ceiling)
                out.extend((own, int(v) if not isinstance(v, str) else v, s) for s, v in found)
        columns = list(zip(*out, strict=True)) or [[], [], []]
        types = [right.schema.field("query_id").type] * 2 + [pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "vec_id", "score"])

    lane = ["pivot", "ring", "part", "lane"]

    def searched(pairs: DataFrame) -> DataFrame:
        """A block meets its queries; one that very many ask is copied for each lane of them."""
        load = pairs.groupBy("pivot", "ring", "part").agg(F.count("*").alias("n"))
        load = load.select("pivot", "ring", "part", F.expr(f"cast(ceil(n / {max(1, QUERY_BYTES // (8 * width))}) as int)").alias("lanes"))
        load = written(load, "block_load")
        left = data.join(load, ["pivot", "ring", "part"]).withColumn("lane", F.explode(F.expr("sequence(0, lanes - 1)")))
        right = pairs.join(load, ["pivot", "ring", "part"]).withColumn("lane", F.expr("cast(pmod(xxhash64(query_id, 1), lanes) as int)")).withColumnRenamed("v", "q")
        left = left.select(*lane, "dist", "vec_id", "v")
        return left.groupBy(*lane).cogroup(right.select(*lane, "query_id", "q", "at", "floor").groupBy(*lane)).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score bigint")

    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    pairs = f"query_id {kind}, {vector}, floor double, pivot int, ring int, part int, at double"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # first round: one block near the query gives a score to beat
    home = written(queries.withColumn("floor", F.lit(None).cast("double")).select("query_id", "v", "floor").mapInArrow(asked(True), pairs), "homes")
    seeds = written(searched(home), "seeds")
    floors = seeds.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = written(floors.select("query_id", F.col("floor").cast("double").alias("floor")), "floors")
    rest = written(queries.join(floors, "query_id", "left").select("query_id", "v", "floor").mapInArrow(asked(False), pairs), "pairs")
    discard(home, floors)
    found = seeds.unionByName(searched(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
