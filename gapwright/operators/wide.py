"""Imputation when nearly every row has a mask of its own: many columns, many lags.

Sums by mask no longer compress such a table.  The training rows are sent to
the workers instead, in parts if they are many, and each batch of rows to fill
solves its own patterns against all of them, so neither the masks nor the
models are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.operators import masks
from gapwright.operators.columns import Encoding
from gapwright.operators.rectangle import EXHAUST, all_sets, best_prefix, bits, depth, kinds
from gapwright.operators.ridge import Ridge, from_gram
from gapwright.operators.tree import GiniTree

#: Bytes of training rows that workers hold at once.  A larger table goes to them in parts that are read one by one.
MATRIX_BYTES = 192 << 20
#: Tasks among which the rows of one mask are dealt.
SHARES = 8
#: Bytes of such a part, and of the sums that a worker gathers over the parts in one pass.
PART_BYTES = 32 << 20


def encoded(df: DataFrame, encoding: Encoding) -> DataFrame:
    """(z): encoded rows, NaN where missing."""
    return df.select(F.array(*(F.coalesce(v, F.lit(float("nan"))) for v in encoding.values())).alias("z"))


def training_parts(df: DataFrame, encoding: Encoding, total: int, limit_bytes: int | None = None, part_bytes: int | None = None) -> list:
    """All encoded rows: one array, or broadcasts of about ``part_bytes`` that pass the driver one by one."""
    e = len(encoding.features)
    values = encoded(df, encoding)
    if 8 * e * total <= (MATRIX_BYTES if limit_bytes is None else limit_bytes):
        return [np.asarray(values.toArrow()["z"].combine_chunks().flatten(), dtype=float).reshape(-1, e)]
    rows = max(1, (PART_BYTES if part_bytes is None else part_bytes) // (8 * e))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.asarray(batch.column("z").flatten(), dtype=float).reshape(-1, e)
            for at in range(0, len(z), rows):
                yield pa.RecordBatch.from_arrays([pa.array([z[at : at + rows].tobytes()], pa.binary())], ["z"])

    parts, held, n = [], [], 0
    for r in values.mapInArrow(pack, "z binary").toLocalIterator():
        held.append(np.frombuffer(r["z"]).reshape(-1, e))
        n += len(held[-1])
        if n >= rows:
            parts.append(df.sparkSession.sparkContext.broadcast(np.concatenate(held)))
            held, n = [], 0
    if held:
        parts.append(df.sparkSession.sparkContext.broadcast(np.concatenate(held)))
    return parts


def _pair_sums(z: np.ndarray) -> np.ndarray:
    """Of every pair of columns: rows with both, the first one's sum over these, the sum of products."""
    seen, z = (~np.isnan(z)).astype(float), np.nan_to_num(z)
    return np.stack([seen.T @ seen, z.T @ seen, z.T @ z])


def pair_relevance(df: DataFrame, encoding: Encoding, targets: list[int], total: int, parts: list) -> np.ndarray:
    """As ``relevance``, from sums of all pairs of columns over all rows: by the tasks, or of the one array that ``parts`` is."""
    e = len(encoding.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, e, e))
        for batch in batches:
            sums += _pair_sums(np.asarray(batch.column("z").flatten(), dtype=float).reshape(batch.num_rows, e))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], ["at", "x"])

    if isinstance(parts[0], np.ndarray):
        shared, by, cross = _pair_sums(parts[0])
    else:
        found = encoded(df, encoding).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros(3 * e * e)
        sums[np.asarray(found["at"])] = np.asarray(found["x"])
        shared, by, cross = sums.reshape(3, e, e)
    mean = np.diag(by) / np.maximum(np.diag(shared), 1)
    dev = cross - mean[None, :] * by - mean[:, None] * by.T + shared * np.outer(mean, mean)
    var = np.where(np.diag(dev) > 1e-12 * np.maximum(1, np.diag(cross)), np.diag(dev), np.nan)
    with np.errstate(invalid="ignore"):
        return (shared / max(1, total) * np.abs(dev) / np.sqrt(np.outer(var, var)))[targets]


@dataclass
class Target:
    """One column to fill: its place, its candidate features in column order, and how."""

    place: int
    features: np.ndarray
    numeric: bool


class WideModel:
    """Solves patterns of missing features against all training rows.

    The rows and columns of a model are those of the way by masks: all rows
    that lack none of the usable features, or, if these are fewer than
    ``min_rows``, the block that ``rectangle`` finds.  A tree gets at most
    ``tree_rows`` of them.  A worker holds the rows once for all targets.
    """

    def __init__(self, parts: list, targets: list[Target], alpha: float, fit_intercept: bool, min_rows: int, tree_rows: int):
        self.parts, self.targets, self.alpha, self.fit_intercept, self.min_rows, self.tree_rows = parts, targets, alpha, fit_intercept, min_rows, tree_rows
        self.ready: dict[int, tuple] = {}
        self.shared: tuple | None = None

    def __getstate__(self):
        # broadcasts reach the workers beside the model
        return self.__dict__ | {"ready": {}, "shared": None, "parts": self.parts if len(self.parts) == 1 and isinstance(self.parts[0], np.ndarray) else []}

    def _rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(features filled with 0, which are missing) of all training rows held here."""
        if self.shared is None:
            lacks = np.isnan(self.parts[0])
            self.shared, self.parts = (np.nan_to_num(self.parts[0]), lacks), []
        return self.shared

    def _search(self, t: Target, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a pattern: its kinds of columns with gaps from least to most missing, their widths, its columns without gaps."""
        kind, first, lacks = self.ready[t.place]
        own = kind[usable]
        gaps = np.unique(own[lacks[own] > 0])
        gaps = gaps[np.argsort(lacks[gaps], kind="stable")] if len(gaps) > EXHAUST else gaps
        return gaps, np.array([(own == k).sum() for k in gaps], dtype=float), usable[lacks[own] == 0]

    def _columns(self, t: Target, usable: np.ndarray, gaps: np.ndarray, free: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([free, usable[np.isin(self.ready[t.place][0][usable], gaps[chosen])]]))

    def _block(self, t: Target, usable: np.ndarray, lacks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, rows) to train a pattern on."""
        gaps, width, free = self._search(t, usable)
        holes = lacks[:, self.ready[t.place][1][gaps]]
        full = ~holes.any(axis=1)
        if full.sum() >= self.min_rows or not len(gaps):
            return usable, full
        if len(gaps) <= EXHAUST:
            chosen = all_sets(np.bincount(holes @ bits(len(gaps)), minlength=1 << len(gaps)), width, float(len(free)), self.min_rows)
            rows = ~holes[:, chosen].any(axis=1)
        else:
            far = depth(holes)
            kept = best_prefix(np.bincount(far, minlength=len(gaps) + 1), width, float(len(free)), self.min_rows)
            chosen, rows = np.arange(len(gaps)) < kept, far >= kept
        return self._columns(t, usable, gaps, free, chosen), rows

    @staticmethod
    def _training(t: Target, parts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(features filled with 0, which are missing, target values) of one part after the other."""
        for part in parts:
            z = part.value
            z = z[~np.isnan(z[:, t.place])]
            # a worker keeps one part at a time
            vars(part).pop("_value", None)
            x = z[:, t.features]
            yield np.nan_to_num(x), np.isnan(x), z[:, t.place]

    def _know(self, t: Target, parts: list) -> None:
        """Kinds of columns by their gaps over all parts (a column's kind is told by a hash of its bits)."""
        hashed, lacks = np.zeros(len(t.features), dtype=np.uint64), 0
        for _, gaps, _ in self._training(t, parts):
            said = [xxhash.xxh3_64_intdigest(row.tobytes()) for row in np.ascontiguousarray(np.packbits(gaps, axis=0).T)]
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + np.array(said, dtype=np.uint64)
            lacks = lacks + gaps.sum(axis=0)
        kind, first = kinds(np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).T)
        self.ready[t.place] = kind, first, np.asarray(lacks)[first]

    def _guess(self, t: Target, z: np.ndarray, patterns: list[tuple[np.ndarray, np.ndarray]], parts: list, guess: np.ndarray) -> None:
        """Fills ``guess`` for (rows, usable features) by two passes over the parts: rows complete, then their sums."""
        searched = [self._search(t, usable) for _, usable in patterns]
        first = self.ready[t.place][1]
        small = [len(g) <= EXHAUST for g, _, _ in searched]
        counts = [np.zeros(1 << len(g) if s else len(g) + 1, dtype=np.int64) for (g, _, _), s in zip(searched, small, strict=True)]
        for _, lacks, _ in self._training(t, parts):
            for (g, _, _), s, n in zip(searched, small, counts, strict=True):
                holes = lacks[:, first[g]]
                n += np.bincount(holes @ bits(len(g)) if s else depth(holes), minlength=len(n))
        chosen, rows = [], {}
        for (_, usable), (g, width, free), s, n in zip(patterns, searched, small, counts, strict=True):
            full = n[0] if s else n[-1]
            if full >= self.min_rows or not len(g):
                c = usable
            elif s:
                c = self._columns(t, usable, g, free, all_sets(n, width, float(len(free)), self.min_rows))
            else:
                c = self._columns(t, usable, g, free, np.arange(len(g)) < best_prefix(n, width, float(len(free)), self.min_rows))
            chosen.append(tuple(c.tolist()))
            rows[chosen[-1]] = 0
        sums: dict[tuple, object] = {c: 0.0 if t.numeric else [] for c in rows if c}
        for x, lacks, y in self._training(t, parts):
            for c in sums:
                at = np.flatnonzero(~lacks[:, list(c)].any(axis=1))
                if t.numeric:
                    xy = np.concatenate([x[np.ix_(at, c)], y[at, None], np.ones((len(at), 1))], axis=1)
                    sums[c] = sums[c] + xy.T @ xy
                else:
                    at = at[: self.tree_rows - rows[c]]
                    sums[c].append((x[np.ix_(at, c)], y[at]))
                rows[c] += len(at)
        for (at, _), c in zip(patterns, chosen, strict=True):
            if not rows[c]:
                continue
            features = z[np.ix_(at, t.features[list(c)])]
            if t.numeric:
                coef, intercept = from_gram(sums[c][None], len(c), np.arange(len(c) + 1)[None] < len(c), self.alpha, self.fit_intercept)
                guess[at] = features @ coef[0, :-1] + intercept[0]
            else:
                guess[at] = GiniTree().fit(*(np.concatenate(v) for v in zip(*sums[c], strict=True))).predict(features)

    def _held(self, t: Target, z: np.ndarray, patterns: list[tuple[np.ndarray, np.ndarray]], guess: np.ndarray) -> None:
        """As ``_guess`` where a worker holds all training rows."""
        filled, missing = self._rows()
        with_target = np.flatnonzero(~missing[:, t.place])
        lacks = missing[with_target][:, t.features]
        if t.place not in self.ready:
            kind, first = kinds(lacks)
            self.ready[t.place] = kind, first, lacks[:, first].sum(axis=0)
        solved: dict[bytes, object] = {}
        for at, usable in patterns:
            columns, rows = self._block(t, usable, lacks)
            if not rows.any() or not len(columns):
                continue
            key = columns.tobytes() + np.packbits(rows).tobytes()
            if key not in solved:
                chosen = with_target[rows] if t.numeric else with_target[rows][: self.tree_rows]
                model = Ridge(self.alpha, self.fit_intercept) if t.numeric else GiniTree()
                solved[key] = model.fit(filled[np.ix_(chosen, t.features[columns])], filled[chosen, t.place])
            guess[at] = solved[key].predict(z[np.ix_(at, t.features[columns])])

    def fill(self, z: np.ndarray, parts: list | None = None) -> dict[int, np.ndarray]:
        """Predictions by target (NaN where no model reaches) for rows of encoded values."""
        out = {}
        gaps = np.isnan(z)
        for t in self.targets:
            guess = out[t.place] = np.full(len(z), np.nan)
            want = np.flatnonzero(gaps[:, t.place])
            if not len(want) or not len(t.features):
                continue
            patterns, which = np.unique(np.packbits(gaps[want][:, t.features], axis=1), axis=0, return_inverse=True)
            asked = [want[which.ravel() == k] for k in range(len(patterns))]
            asked = [(at, u) for at in asked if len(u := np.flatnonzero(~gaps[at[0], t.features]))]
            if not parts:
                self._held(t, z, asked, guess)
                continue
            if t.place not in self.ready:
                self._know(t, parts)
            sets = 1 << min(EXHAUST, len(self.ready[t.place][1]))
            step = max(1, PART_BYTES // (8 * max(sets, (len(t.features) + 2) ** 2)))
            for a in range(0, len(asked), step):
                self._guess(t, z, asked[a : a + step], parts, guess)
        return out


def predict(marked: DataFrame, encoding: Encoding, model: WideModel, names: dict[int, str], z_name: str) -> DataFrame:
    """Adds a double column by target place.  Rows are dealt by their mask first, in
    ``SHARES`` for one that very many rows have, so that few batches solve a pattern."""
    from pyspark.sql import types as T

    spark = marked.sparkSession
    sent = spark.sparkContext.broadcast(model)
    parts = [] if isinstance(model.parts[0], np.ndarray) else model.parts
    values = F.array(*(F.coalesce(v, F.lit(float("nan"))) for v in encoding.values()))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pattern = masks.mask(encoding.schema, encoding.sources)
    rows = marked.withColumn(z_name, values).repartition(tasks, F.xxhash64(pattern), F.pmod(F.xxhash64(F.col(z_name)), F.lit(SHARES)))
    schema = T.StructType([*marked.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.asarray(batch.column(z_name).flatten(), dtype=float).reshape(batch.num_rows, -1)
            found = sent.value.fill(z, parts)
            kept = [i for i, n in enumerate(batch.schema.names) if n != z_name]
            arrays = [batch.column(i) for i in kept] + [pa.array(found[p], mask=np.isnan(found[p])) for p in names]
            fields = [batch.schema.field(i) for i in kept] + [pa.field(n, pa.float64()) for n in names.values()]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return rows.mapInArrow(run, schema)
