"""Imputation of mixed tables: one model for each target and missingness pattern."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwright.errors import GapTypeError, GapValueError
from gapwright.functions.cells import is_numeric, missing, restore
from gapwright.operators import masks
from gapwright.operators.columns import Encoding, encode, label
from gapwright.operators.elm import RandomLayerRidge
from gapwright.operators.moments import DRIVER_BYTES, SQL_FEATURES, Moments, collect
from gapwright.operators.numbering import numbered
from gapwright.operators.profile import ColumnProfile, TableProfile, check_schema, profile_all
from gapwright.operators.rectangle import largest
from gapwright.operators.persist import Saved
from gapwright.operators.relevance import how_many, nearest, relevance
from gapwright.operators.ridge import Ridge, from_gram, roll_up
from gapwright.operators.tree import GiniTree, walk
from gapwright.operators.wide import Target, WideModel, pair_relevance, predict, training_parts

#: A model table up to this size is broadcast to the join on masks; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20
#: Trees and custom classifiers are fitted on at most so many rows with the target observed, by hash of the row.
FIT_ROWS = 100_000
#: Bytes of hidden units' sums that one pass over the table gathers.
PASS_BYTES = 64 << 20
#: Up to so many of them are fitted by the driver itself.
FEW_FITS = 4
#: Up to so many row keys stand in the predicate; more are joined.
FEW_ROWS = 200


def free_prefix(columns: Iterable[str]) -> str:
    """A beginning that no column name has, for columns that are added and dropped again."""
    own = "__"
    while any(c.lower().startswith(own) for c in columns):
        own += "_"
    return own


@dataclass
class Fitted:
    """Everything that applying needs: no row of the fitted table."""

    encoding: Encoding
    profiles: dict[str, ColumnProfile]
    targets: list[str]
    models: dict[int, dict[str, tuple]]
    keys: dict[int, int | str]
    fills: dict[str, object]
    features: dict[str, list[str]]
    objects: dict[str, list] = field(default_factory=dict)
    depth: int = 4
    wide: WideModel | None = None

    def features_table(self, spark) -> DataFrame:
        """(target, features): which features each target's models may use."""
        return spark.createDataFrame(list(self.features.items()), "target string, features array<string>")

    def _model_table(self, df: DataFrame, names: list[str], own: str) -> DataFrame:
        ridge = pa.struct([("intercept", pa.float64()), ("coef", pa.list_(pa.float64()))])
        tree = pa.struct([("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("leaf", pa.list_(pa.int32()))])
        shown = [m for m, found in self.models.items() if any(t in found for t in names)]
        columns, fields = [pa.array([self.keys[m] for m in shown], pa.string() if len(self.encoding.sources) > masks.WORD else pa.int64())], [f"{own}mask"]
        for i, t in enumerate(names):
            kind = ridge if is_numeric(self.encoding.schema[t].dataType) else tree
            parts = [f.name for f in kind]
            found = [self.models[m].get(t) for m in shown]
            columns.append(pa.array([None if x is None else dict(zip(parts, x, strict=True)) for x in found], kind))
            fields.append(f"{own}m{i}")
        table = df.sparkSession.createDataFrame(pa.table(columns, names=fields))
        return F.broadcast(table) if sum(c.nbytes for c in columns) <= BROADCAST_BYTES else table

    def apply(self, df: DataFrame, selected: Column | None = None) -> DataFrame:
        """As ``apply_beside``, for a table of just the fitted columns."""
        if df.schema.simpleString() != self.encoding.schema.simpleString():
            raise GapValueError("the table has other columns or types than the one that was fitted")
        return self.apply_beside(df, selected)

    def apply_beside(self, df: DataFrame, selected: Column | None = None) -> DataFrame:
        """``df`` with missing, selected cells of the targets filled; also for a stream.

        Rows meet their models in a join on the mask; observed cells and all
        other columns are returned as they are.  A mask without a model, as a
        stream may bring, is filled by the mean or the mode.
        """
        order, chosen = df.columns, F.lit(True) if selected is None else selected
        own = free_prefix(order)
        marked = df.withColumn(f"{own}sel", chosen).withColumn(f"{own}mask", masks.mask(df.schema, self.encoding.sources))
        plain = [t for t in self.targets if t not in self.objects and t in self.encoding.sources]
        values = [F.coalesce(v, F.lit(0.0)) for v in self.encoding.values()]
        if any(t in found for found in self.models.values() for t in plain):
            marked = marked.join(self._model_table(df, plain, own), f"{own}mask", "left")
            # each feature is computed once a row, whatever the number of targets
            marked = marked.select("*", *(v.alias(f"{own}z{j}") for j, v in enumerate(values)))
        else:
            plain = []
        guessed: dict[str, str] = {}
        if self.wide and self.wide.targets:
            places = {self.encoding.target(t): t for t in self.targets if t in self.encoding.sources}
            guessed = {places[x.place]: f"{own}w{x.place}" for x in self.wide.targets}
            marked = predict(marked, self.encoding, self.wide, {x.place: f"{own}w{x.place}" for x in self.wide.targets}, f"{own}z")
        if any(t in self.objects for t in self.targets):
            marked = self._predict_objects(marked.withColumn(f"{own}z", F.array(*values)), own)
        out = {}
        for t in self.targets:
            kind = df.schema[t].dataType
            found: list[Column] = []
            if t in guessed:
                found.append(self._back(F.col(guessed[t]), t, kind))
            elif t in self.objects:
                found.append(self._back(F.col(f"{own}p{self.targets.index(t)}"), t, kind))
            elif t in plain:
                m = F.col(f"{own}m{plain.index(t)}")
                if is_numeric(kind):
                    name, use = f"{own}m{plain.index(t)}", set(self.features.get(t, ()))
                    terms = [f"get({name}.coef, {j}) * {own}z{j}" for j, f in enumerate(self.encoding.features) if f.name in use]
                    found.append(self._back(F.expr(" + ".join([f"{name}.intercept", *terms])), t, kind))
                else:
                    zs = F.array(*(F.col(f"{own}z{j}") for j in range(len(values))))
                    found.append(self._back(walk(zs, m["feature"], m["threshold"], m["leaf"], self.depth), t, kind))
            if self.fills.get(t) is not None:
                fill = F.lit(self.fills[t])
                found.append(restore(fill, kind) if is_numeric(kind) else fill.cast(kind))
            if found:
                out[t] = F.when(F.col(f"{own}sel") & missing(t, kind), F.coalesce(*found, F.col(f"`{t}`"))).otherwise(F.col(f"`{t}`"))
        return marked.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in order))

    def _back(self, value: Column, target: str, kind: T.DataType) -> Column:
        if not is_numeric(kind):
            return label(value, self.encoding.categories[target], kind)
        i = self.encoding.target(target)
        return restore(value * self.encoding.scale[i] + self.encoding.shift[i], kind)

    def _predict_objects(self, marked: DataFrame, own: str) -> DataFrame:
        """Adds predictions of estimator objects, batch by batch."""
        schema = T.StructType([*marked.schema.fields, *(T.StructField(f"{own}p{i}", T.DoubleType()) for i, t in enumerate(self.targets) if t in self.objects)])
        names, targets, where = marked.columns, self.targets, {self.keys[m]: m for m in self.keys}
        sent = marked.sparkSession.sparkContext.broadcast(cloudpickle.dumps({t: (x, {m: f[t][0] for m, f in self.models.items() if t in f}) for t, x in self.objects.items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted = pickle.loads(sent.value)
            for batch in batches:
                arrays = list(batch.columns)
                z = np.asarray(batch.column(f"{own}z").flatten()).reshape(batch.num_rows, -1)
                rows = batch.column(f"{own}mask").to_pylist()
                for i, t in enumerate(targets):
                    if t not in fitted:
                        continue
                    objects, by_mask = fitted[t]
                    out = np.full(batch.num_rows, np.nan)
                    which = np.array([by_mask.get(where.get(k), -1) for k in rows])
                    for n in np.unique(which[which >= 0]).tolist():
                        model, columns = objects[n]
                        at = which == n
                        out[at] = np.asarray(model.predict(z[at][:, columns]), dtype=float)
                    arrays.append(pa.array(out, mask=np.isnan(out)))
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*batch.schema, *(pa.field(f"{own}p{i}", pa.float64()) for i, t in enumerate(targets) if t in fitted)]))

        return marked.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


class TableImputer(Transformer, Saved):
    """Fills missing cells from models of the other columns.

    For each target and each pattern of missing features, a model is fitted on
    the rows that are complete for that pattern: ridge for numbers (all from
    one aggregate of sums by mask), a depth-4 tree for labels, or any object
    with fit(X, y) and predict(X).  With fewer than ``min_samples_train`` such
    rows the largest complete block of rows and columns serves; cells that no
    model reaches get the mean or the mode (``fallback="simple"``) or stay.
    Label columns of more values than features can be made of (``MAX_CATEGORIES``)
    are no features and have the mode for a model.  ``rng`` seeds the ELM's units
    and the choice of the ``fit_rows`` rows that a classifier sees.
    Predictions never feed other models, so targets do not depend on order.
    """

    def __init__(self, regressor: object = "ridge", classifier: object = "tree", min_samples_train: int | None = None, fallback: str | None = "simple",
                 scoring: object = "default", alpha: float = 0.01, fit_intercept: bool = True, categories: dict[str, list] | None = None,
                 fit_rows: int = FIT_ROWS, verbose: int = 0, rng: int | None = None):
        super().__init__()
        if fallback not in ("simple", None):
            raise GapValueError("fallback must be 'simple' or None")
        if scoring != "default" and not callable(scoring):
            raise GapValueError("scoring must be 'default' or a callable")
        if isinstance(regressor, str) and regressor not in ("ridge", "elm"):
            raise GapValueError("regressor must be 'ridge', 'elm' or an object with fit and predict")
        if isinstance(classifier, str) and classifier != "tree":
            raise GapValueError("classifier must be 'tree' or an object with fit and predict")
        if type(regressor) is Ridge:
            alpha, fit_intercept, regressor = regressor.alpha, regressor.fit_intercept, "ridge"
        if rng is not None and (isinstance(rng, bool) or not isinstance(rng, int) or rng < 0):
            raise GapValueError("rng must be None or an integer of 0 or more")
        self.rng = rng or 0
        self.regressor = RandomLayerRidge(random_state=self.rng) if regressor == "elm" else regressor
        self.classifier, self.fallback, self.scoring = classifier, fallback, scoring
        self.min_samples = 20 if min_samples_train is None else min_samples_train
        self.alpha, self.fit_intercept, self.categories, self.fit_rows, self.verbose = alpha, fit_intercept, categories or {}, fit_rows, verbose
        self.imputation_features_: dict[str, list[str]] = {}
        self._given = {
            "regressor": regressor, "classifier": classifier, "min_samples_train": min_samples_train, "fallback": fallback, "scoring": scoring,
            "alpha": alpha, "fit_intercept": fit_intercept, "categories": categories, "fit_rows": fit_rows, "verbose": verbose, "rng": rng,
        }

    def get_params(self) -> dict[str, object]:
        return dict(self._given)

    def set_params(self, **params: object) -> TableImputer:
        """Changes parameters; all that follows from them is checked and derived again."""
        unknown = sorted(set(params) - set(self._given))
        if unknown:
            raise GapValueError(f"unknown parameters: {unknown}")
        self.__init__(**(self._given | params))
        return self

    # -- selectors

    @staticmethod
    def _targets(df: DataFrame, cols: Iterable[str | int] | str | int | None) -> list[str]:
        if cols is None:
            return df.columns
        wanted = [cols] if isinstance(cols, (str, int)) else list(cols)
        names = [df.columns[c] if isinstance(c, (int, np.integer)) and not isinstance(c, bool) and 0 <= c < len(df.columns) else c for c in wanted]
        unknown = [c for c in names if c not in df.columns]
        if unknown:
            raise GapValueError(f"unknown columns: {unknown}")
        return [c for c in df.columns if c in names]

    @staticmethod
    def _rows(df: DataFrame, rows: Column | dict | None) -> tuple[DataFrame, Column | None]:
        """The table and a predicate: as given, or for {key column: values} whether the row's
        key is one of them (unknown values are an error), for more than ``FEW_ROWS`` by a
        column that is joined on; or for {"order": columns, "at": places} by row number."""
        if rows is None or isinstance(rows, Column):
            return df, rows
        if isinstance(rows, dict) and set(rows) == {"order", "at"}:
            return TableImputer._rows_at(df, rows["order"], rows["at"])
        if not isinstance(rows, dict) or len(rows) != 1:
            raise GapTypeError('rows must be a boolean column, {key column: values}, or {"order": columns, "at": places}')
        (key, values), values = next(iter(rows.items())), list(next(iter(rows.values())))
        if key not in df.columns:
            raise GapValueError(f"unknown columns: {[key]}")
        wanted = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(key, df.schema[key].dataType)])).distinct()
        small = sum(len(str(v)) + 16 for v in values) <= BROADCAST_BYTES
        wanted = F.broadcast(wanted) if small else wanted
        unknown = wanted.join(df.select(key).distinct(), key, "left_anti").limit(5).collect()
        if unknown:
            raise GapValueError(f"unknown rows: {[r[0] for r in unknown]}")
        if len(values) <= FEW_ROWS:
            return df, F.col(f"`{key}`").isin(values)
        flag = f"{free_prefix(df.columns)}wanted"
        return df.join(wanted.withColumn(flag, F.lit(True)), key, "left").select(*(F.col(f"`{c}`") for c in df.columns), flag), F.col(flag).isNotNull()

    @staticmethod
    def _rows_at(df: DataFrame, order: object, at: Iterable[int]) -> tuple[DataFrame, Column]:
        """Rows by their places (negative ones from the end) in the order of some columns."""
        order, at = [order] if isinstance(order, str) else list(order), list(at)
        unknown = [c for c in order if c not in df.columns]
        if unknown:
            raise GapValueError(f"unknown columns: {unknown}")
        if any(isinstance(i, bool) or not isinstance(i, (int, np.integer)) for i in at):
            raise GapTypeError("places must be integers")
        number = f"{free_prefix(df.columns)}row"
        marked, total = numbered(df, order, number)
        if any(not -total <= i < total for i in at):
            raise GapValueError(f"places must lie between {-total} and {total - 1}")
        places = sorted({int(i) % total for i in at})
        if len(places) <= FEW_ROWS:
            return marked, F.col(number).isin(places)
        flag, wanted = f"{number}_wanted", df.sparkSession.createDataFrame(pa.table([pa.array(places, pa.int64())], names=[number]))
        wanted = F.broadcast(wanted) if 8 * len(places) <= BROADCAST_BYTES else wanted
        return marked.join(wanted.withColumn(flag, F.lit(True)), number, "left"), F.col(flag).isNotNull()

    # -- fitting

    def fit_table(self, df: DataFrame, rows: Column | dict | None = None, cols: object = None, n_nearest_features: int | float | None = None, normalize: bool = True, beside: Iterable[str] = (), droppable: Iterable[str] = ()) -> Fitted:
        """Models for a table; see ``impute``.  Columns named in ``beside`` are no
        part of it, but ``rows`` may speak of them; those in ``droppable`` are
        left out if they hold no value at all."""
        all_columns, df = df, df.drop(*beside)
        check_schema(df)
        targets = self._targets(df, cols)
        all_columns, selected = self._rows(all_columns, rows)
        return self._fit(all_columns, df, selected, targets, n_nearest_features, normalize, droppable)

    def _fit(self, all_columns: DataFrame, df: DataFrame, selected: Column | None, targets: list[str], n_nearest_features: int | float | None, normalize: bool, droppable: Iterable[str] = ()) -> Fitted:
        if self.verbose:
            df.sparkSession.sparkContext.setJobDescription("profile the columns")
        found = profile_all(df, with_masks=len(df.columns) > SQL_FEATURES)
        profiles = found.columns
        df = df.drop(*(c for c in droppable if not profiles[c].count))
        e = encode(df, profiles, normalize, self.fit_intercept, self.categories)
        if self._is_wide(df, e, found):
            return self._fit_wide(df, e, found, targets, n_nearest_features)
        if self.verbose:
            df.sparkSession.sparkContext.setJobDescription("sum products by missingness mask")
        m = collect(all_columns, e, selected)
        targets = [t for t in targets if t in e.sources or t in e.loose]
        active = [t for t in targets if t in e.sources and profiles[t].count and any(mask & e.bit(e.target(t)) and n for mask, n in zip(m.masks, m.selected, strict=True))]
        k = how_many(n_nearest_features, len(e.features))
        places = [e.target(t) for t in active]
        if k is not None and active:
            score = relevance(m, e, places) if self.scoring == "default" else np.asarray(self.scoring(m, e, places), dtype=float)
            if score.shape != (len(places), len(e.features)):
                raise GapValueError(f"scoring must return {len(places)} x {len(e.features)} scores")
        models: dict[int, dict[str, tuple]] = {}
        features: dict[str, list[str]] = {}
        objects: dict[str, list] = {}
        for i, t in enumerate(active):
            own = [j for j, f in enumerate(e.features) if f.source != t]
            own = own if k is None else nearest(score[i], places[i], own, k)
            features[t] = [e.features[j].name for j in own]
            numeric = is_numeric(df.schema[t].dataType)
            plans = self._plans(m, e, t, own)
            if numeric and self.regressor == "ridge":
                self._ridge(m, e, t, plans, models)
            else:
                self._objects(df, m, e, t, plans, models, objects, numeric)
        fills = self._fills(df, targets, profiles) if self.fallback else {}
        self.imputation_features_ = features
        return Fitted(e, profiles, targets, models, dict(zip(m.masks, m.keys, strict=True)), fills, features, objects)

    def _is_wide(self, df: DataFrame, e: Encoding, found: TableProfile) -> bool:
        """Whether sums by mask would not fit the driver: then rows are solved where they are.

        Estimator objects and scoring callables always take the way by masks.
        """
        if self.regressor != "ridge" or self.classifier != "tree" or self.scoring != "default" or len(e.features) <= SQL_FEATURES:
            return False
        if len(e.sources) > masks.WORD:
            return True
        distinct = found.masks
        if distinct is None:
            distinct = df.agg(F.approx_count_distinct(masks.mask(e.schema, e.sources), 0.05)).first()[0]
        return 1.2 * distinct * 8 * (len(e.features) + 1) ** 2 > DRIVER_BYTES // 4

    def _fit_wide(self, df: DataFrame, e: Encoding, found: TableProfile, targets: list[str], n_nearest: int | float | None) -> Fitted:
        """As ``fit_table`` for wide tables.  Features that are missing nowhere the
        target is, or everywhere, are handled by the patterns of each row."""
        profiles = found.columns
        parts = training_parts(df, e, found.rows)
        k = how_many(n_nearest, len(e.features))
        active = [t for t in targets if t in e.sources and profiles[t].count]
        places = [e.target(t) for t in active]
        score = pair_relevance(df, e, places, found.rows, parts) if k is not None else None
        features, models = {}, []
        for i, t in enumerate(active):
            own = [j for j, f in enumerate(e.features) if f.source != t]
            own = own if k is None else nearest(score[i], places[i], own, k)
            features[t] = [e.features[j].name for j in own]
            models.append(Target(places[i], np.array(own, dtype=int), is_numeric(df.schema[t].dataType)))
        self.imputation_features_ = features
        wide = WideModel(parts, models, self.alpha, self.fit_intercept, self.min_samples, self.fit_rows)
        fills = self._fills(df, targets, profiles) if self.fallback else {}
        return Fitted(e, profiles, [t for t in targets if t in e.sources or t in e.loose], {}, {}, fills, features, wide=wide)

    def _plans(self, m: Moments, e: Encoding, target: str, own: list[int]) -> list[tuple[int, tuple[int, ...], int]]:
        """(mask, features, needed bits) of each pattern of selected rows that a model can serve."""
        bit = e.bit(e.target(target))
        values = masks.vector(m.masks, len(e.sources))
        sources = sorted({e.features[j].source for j in own}, key=e.sources.index)
        if not sources or not len(values):
            return []
        source_bits = masks.vector([1 << e.sources.index(s) for s in sources], len(e.sources))
        lacks = ~masks.admitted(values, source_bits).T
        with_target = masks.admitted(values, masks.vector([bit], len(e.sources)))[0]
        width = np.array([sum(e.features[j].source == s for j in own) for s in sources], dtype=float)
        wanted = np.flatnonzero(~with_target & (m.selected > 0) & (~lacks).any(axis=1))
        if not len(wanted):
            return []
        usable, which = np.unique(~lacks[wanted], axis=0, return_inverse=True)
        whole = [int(b) for b in source_bits]
        need = [bit | sum(b for b, y in zip(whole, row, strict=True) if y) for row in usable.tolist()]
        complete = np.concatenate([masks.admitted(values, masks.vector(need[a : a + 1024], len(e.sources))) @ m.rows for a in range(0, len(need), 1024)])
        by_source = [[j for j in own if e.features[j].source == s] for s in sources]
        plans: list[tuple[tuple[int, ...], int]] = []
        for keep, bits, rows in zip(usable, need, complete, strict=True):
            if rows < self.min_samples:
                at = np.flatnonzero(keep)
                kept = largest(lacks[with_target][:, at], m.rows[with_target], width[at], self.min_samples)
                keep = np.zeros(len(sources), dtype=bool)
                keep[at[kept]] = True
                bits = bit | sum(b for b, y in zip(whole, keep.tolist(), strict=True) if y)
                rows = m.rows[masks.admitted(values, masks.vector([bits], len(e.sources)))[0]].sum() if keep.any() else 0
            use = sorted(j for columns, y in zip(by_source, keep.tolist(), strict=True) if y for j in columns) if rows else []
            plans.append((tuple(use), bits))
        return [(m.masks[i], *plans[k]) for i, k in zip(wanted.tolist(), which.ravel().tolist(), strict=True) if plans[k][0]]

    def _ridge(self, m: Moments, e: Encoding, target: str, plans: list, models: dict) -> None:
        """One solve for all distinct (features, rows) of a target."""
        if not plans:
            return
        place = e.target(target)
        distinct = list(dict.fromkeys((use, need) for _, use, need in plans))
        use = np.zeros((len(distinct), len(e.features)), dtype=bool)
        for r, (columns, _) in enumerate(distinct):
            use[r, list(columns)] = True
        gram = roll_up(masks.vector(m.masks, len(e.sources)), masks.vector([n for _, n in distinct], len(e.sources)), m.gram)
        coef, intercept = from_gram(gram, place, use, self.alpha, self.fit_intercept)
        where = {key: r for r, key in enumerate(distinct)}
        for mask, columns, need in plans:
            r = where[columns, need]
            models.setdefault(mask, {})[target] = (float(intercept[r]), [float(x) for x in coef[r]])

    def _objects(self, df: DataFrame, m: Moments, e: Encoding, target: str, plans: list, models: dict, objects: dict, numeric: bool) -> None:
        """Trees and custom estimators, one for each distinct (features, rows) of a target."""
        if not plans:
            return
        place = e.target(target)
        rows = df.where(~missing(target, df.schema[target].dataType))
        distinct = list(dict.fromkeys((use, need) for _, use, need in plans))
        if numeric:
            fitted = self._regressors(rows, m, e, place, distinct)
        else:
            rows = rows.select(masks.mask(df.schema, e.sources).alias("mask"), *(v.alias(f"z{i}") for i, v in enumerate(e.values())))
            table = rows.orderBy(F.xxhash64(*rows.columns, F.lit(self.rng)), *(c for c in rows.columns if c != "mask")).limit(self.fit_rows).toArrow()
            z = np.stack([np.asarray(table[f"z{i}"].fill_null(0.0), dtype=float) for i in range(len(e.features))], axis=1)
            seen = masks.vector([masks.as_int(x) for x in table["mask"].to_pylist()], len(e.sources))
            fitted = self._fit_all(df, z, seen, place, distinct, len(e.sources))
        known: dict[tuple, object] = {}
        for key, model in zip(distinct, fitted, strict=True):
            if model is not None and not isinstance(model, tuple):
                objects.setdefault(target, []).append((model, list(key[0])))
                model = (len(objects[target]) - 1,)
            known[key] = model
        for mask, use, need in plans:
            if known[use, need] is not None:
                models.setdefault(mask, {})[target] = known[use, need]

    def _regressors(self, rows: DataFrame, m: Moments, e: Encoding, place: int, distinct: list) -> list:
        """A regressor for each (features, needed bits), fitted on every row that lacks none of them.

        Ridge and the random layer need sums only; any other object gets its rows.
        """
        columns = len(e.sources)
        values, need = masks.vector(m.masks, columns), masks.vector([n for _, n in distinct], columns)
        way = getattr(self.regressor.fit, "__func__", None)
        if way is Ridge.fit:
            return self._ridge_objects(values, need, m, place, distinct)
        z = F.array(*(F.coalesce(v, F.lit(0.0)) for v in e.values())).alias("z")
        rows = rows.select(masks.mask(e.schema, e.sources).alias("mask"), z)
        if way is RandomLayerRidge.fit:
            return self._layer_objects(rows, values, need, m, place, distinct, columns)
        return self._own_objects(rows, values, need, m, place, distinct)

    def _new(self) -> object:
        return pickle.loads(cloudpickle.dumps(self.regressor))

    def _ridge_objects(self, values: np.ndarray, need: np.ndarray, m: Moments, place: int, distinct: list) -> list:
        use = np.zeros((len(distinct), m.gram.shape[1] - 1), dtype=bool)
        for r, (columns, _) in enumerate(distinct):
            use[r, list(columns)] = True
        coef, intercept = from_gram(roll_up(values, need, m.gram), place, use, self.regressor.alpha, self.regressor.fit_intercept)
        made = [self._new() for _ in distinct]
        for model, row, start, (columns, _) in zip(made, coef, intercept, distinct, strict=True):
            model.coef_, model.intercept_ = row[list(columns)], float(start)
        return made

    def _layer_objects(self, rows: DataFrame, values: np.ndarray, need: np.ndarray, m: Moments, place: int, distinct: list, columns: int) -> list:
        """As many (features, needed bits) in one pass over the rows as their sums allow."""
        step = max(1, PASS_BYTES // (8 * (self.regressor.n_features + 2) ** 2))
        made: list = []
        for a in range(0, len(distinct), step):
            part = need[a : a + step]
            complete = masks.admitted(values, part) @ m.rows
            wanted = [(use, self.regressor.width(int(n))) for (use, _), n in zip(distinct[a : a + step], complete, strict=True)]

            def which(batch: pa.RecordBatch, part: np.ndarray = part) -> list[np.ndarray]:
                coded = batch.column("mask").dictionary_encode()
                seen = masks.vector([masks.as_int(x) for x in coded.dictionary.to_pylist()], columns)
                return list(masks.admitted(seen, part)[:, np.asarray(coded.indices)])

            made += [self._new().solve(gram) for gram in self.regressor.sums(rows, place, wanted, which)]
        return made

    def _own_objects(self, rows: DataFrame, values: np.ndarray, need: np.ndarray, m: Moments, place: int, distinct: list) -> list:
        """Each task fits one (features, needed bits) after the other, on all rows of each, in order of their hash."""
        plan, group = np.nonzero(masks.admitted(values, need))
        keys = pa.array([m.keys[g] for g in group.tolist()], pa.string() if isinstance(m.keys[0], str) else pa.int64())
        spark = rows.sparkSession
        served = spark.createDataFrame(pa.table([keys, pa.array(plan, pa.int32())], names=["mask", "plan"]))
        tasks = min(len(distinct), 4 * spark.sparkContext.defaultParallelism)
        given = rows.join(served, "mask").select("plan", "mask", "z").repartitionByRange(tasks, "plan").sortWithinPartitions("plan", F.xxhash64("mask", "z"), "z")
        packed = cloudpickle.dumps(self.regressor)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []

            def fitted() -> pa.RecordBatch:
                model, z = pickle.loads(packed), np.concatenate(held)
                held.clear()
                model.fit(z[:, :-1], z[:, -1])
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([cloudpickle.dumps(model)], pa.binary())], ["plan", "model"])

            for batch in batches:
                plans = np.asarray(batch.column("plan"))
                z = np.asarray(batch.column("z").flatten(), dtype=float).reshape(batch.num_rows, -1)
                for p in np.unique(plans).tolist():
                    if held and p != now:
                        yield fitted()
                    now = p
                    held.append(z[plans == p][:, [*distinct[p][0], place]])
            if held:
                yield fitted()

        found = given.mapInArrow(run, "plan int, model binary").toArrow()
        by_plan = dict(zip(found["plan"].to_pylist(), found["model"].to_pylist(), strict=True))
        return [pickle.loads(by_plan[i]) if i in by_plan else None for i in range(len(distinct))]

    def _fit_all(self, df: DataFrame, z: np.ndarray, seen: np.ndarray, place: int, distinct: list, columns: int) -> list:
        """A model (or None) for each (features, needed bits); many are fitted by the tasks of a job."""

        def fit(use: tuple[int, ...], need: int, z: np.ndarray, seen: np.ndarray) -> object:
            at = masks.admitted(seen, masks.vector([need], columns))[0]
            return self._one(z[at][:, list(use)], z[at, place], use) if at.any() else None

        if len(distinct) <= FEW_FITS:
            return [fit(use, need, z, seen) for use, need in distinct]
        spark = df.sparkSession
        sent = spark.sparkContext.broadcast((z, seen))
        packed = cloudpickle.dumps(fit)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, (z, seen) = pickle.loads(packed), sent.value
            for batch in batches:
                made = [cloudpickle.dumps(one(*distinct[i], z, seen)) for i in batch.column("i").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(made, pa.binary())], ["i", "model"])

        tasks = min(len(distinct), 4 * spark.sparkContext.defaultParallelism)
        found = spark.range(len(distinct)).select(F.col("id").cast("int").alias("i")).repartition(tasks).mapInArrow(run, "i int, model binary").toArrow()
        by_place = dict(zip(found["i"].to_pylist(), found["model"].to_pylist(), strict=True))
        return [pickle.loads(by_place[i]) for i in range(len(distinct))]

    def _one(self, X: np.ndarray, y: np.ndarray, use: tuple[int, ...]) -> object:
        if self.classifier == "tree":
            tree = GiniTree().fit(X, y)
            return [int(use[f]) if f >= 0 else -1 for f in tree.feature.tolist()], tree.threshold.tolist(), tree.leaf.tolist()
        classes = np.unique(y)
        if len(classes) == 1:
            return _Constant(float(classes[0]))
        model = pickle.loads(cloudpickle.dumps(self.classifier))
        model.fit(X, y.astype(np.int64))
        return model

    def _fills(self, df: DataFrame, targets: list[str], profiles: dict[str, ColumnProfile]) -> dict[str, object]:
        fills: dict[str, object] = {t: profiles[t].mean for t in targets if is_numeric(df.schema[t].dataType) and profiles[t].count}
        labels = [t for t in targets if not is_numeric(df.schema[t].dataType) and profiles[t].count]
        if labels:
            row = df.agg(*(F.expr(f"mode() within group (order by `{t}`)").alias(t) for t in labels)).first()
            fills |= {t: row[t] for t in labels}
        return fills

    # -- public calls

    def impute(self, df: DataFrame, rows: Column | dict | None = None, cols: object = None, n_nearest_features: int | float | None = None, normalize: bool = True) -> DataFrame:
        """``df`` filled: ``cols`` (names or places) in ``rows`` (a predicate,
        {key column: values}, or {"order": columns, "at": places in that
        order}), from the ``n_nearest_features`` best features."""
        check_schema(df)
        targets = self._targets(df, cols)
        marked, selected = self._rows(df, rows)
        fitted = self._fit(marked, df, selected, targets, n_nearest_features, normalize)
        return fitted.apply_beside(marked, selected).select(*(F.col(f"`{c}`") for c in df.columns))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.impute(df)


class _Constant:
    """Predicts one code."""

    def __init__(self, value: float):
        self.value = value

    def predict(self, X: np.ndarray) -> np.ndarray:
        return np.full(len(X), self.value)
