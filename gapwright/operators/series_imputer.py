"""Imputation of time series: grid, short gaps, lags and calendar, then the table imputer."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.errors import GapTypeError, GapValueError
from gapwright.functions.cells import is_numeric
from gapwright.operators.gaps import check_gap, interpolate
from gapwright.operators.persist import Saved
from gapwright.operators.profile import check_schema
from gapwright.operators.table_imputer import TableImputer
from gapwright.operators.timefeatures import add_calendar, add_lags, check_lags, free_name, lag_names
from gapwright.operators.timegrid import check_time, regularise


class SeriesImputer(Transformer, Saved):
    """Rebuilds a regular grid, interpolates gaps of at most
    ``interpolate_gaps_less_than`` points, adds lags (positive: past) and
    calendar features, and imputes the original columns.

    Without lags and calendar features it is the table imputer on the grid.
    Other keywords are those of ``TableImputer``.
    """

    def __init__(self, time_col: str, lags: object = (1,), step: int | str | None = None, add_time_features: bool = True, interpolate_gaps_less_than: int | None = None, **table):
        super().__init__()
        if not isinstance(time_col, str):
            raise GapTypeError("the time column must be given by name")
        self.time_col, self.lags, self.step, self.calendar = time_col, check_lags(lags), step, add_time_features
        self.longest = None if interpolate_gaps_less_than is None else check_gap(interpolate_gaps_less_than)
        self.table = TableImputer(**table)
        self._given = {"time_col": time_col, "lags": lags, "step": step, "add_time_features": add_time_features, "interpolate_gaps_less_than": interpolate_gaps_less_than}

    def get_params(self) -> dict[str, object]:
        return self._given | self.table.get_params()

    def set_params(self, **params: object) -> SeriesImputer:
        """Changes parameters; the inner table imputer is built anew."""
        unknown = sorted(set(params) - set(self.get_params()))
        if unknown:
            raise GapValueError(f"unknown parameters: {unknown}")
        self.__init__(**(self.get_params() | params))
        return self

    @property
    def imputation_features_(self) -> dict[str, list[str]]:
        return self.table.imputation_features_

    def _time(self, value: object) -> Column:
        return F.lit(str(value)).cast("timestamp_ntz") if not isinstance(value, Column) else value

    def impute(self, df: DataFrame, rows: object = None, cols: object = None, n_nearest_features: int | float | None = None,
               normalize: bool = True, before: object = None, after: object = None) -> DataFrame:
        """The series on its grid, filled.

        ``rows`` are grid ordinals or times, or a predicate (over columns whose
        names do not begin with two underscores, but for the grid's ``__ord``),
        and take the place of ``before`` and ``after`` (both strict).
        """
        check_time(df, self.time_col)
        check_schema(df.drop(self.time_col))
        clash = [c for c in df.columns if c.startswith("__")]
        if clash:
            return self._shielded(df, clash, rows, cols, n_nearest_features, normalize, before, after)
        names = [c for c in df.columns if c != self.time_col]
        grid = regularise(df, self.time_col, self.step)
        numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
        if self.longest:
            grid = interpolate(grid, numeric, self.longest)
        features = grid
        made = list(lag_names(names, self.lags))
        features = add_lags(features, names, self.lags) if self.lags else features
        if self.calendar:
            features, extra = add_calendar(features, self.time_col)
            made += extra
        targets = TableImputer._targets(df.drop(self.time_col), cols) if cols is not None else names
        chosen, beside = self._selected(rows, before, after), (self.time_col, "__ord")
        fitted = self.table.fit_table(features, chosen, targets, n_nearest_features, normalize, beside, made)
        return fitted.apply_beside(features, chosen).select(*(F.col(f"`{c}`") for c in df.columns))

    def _shielded(self, df: DataFrame, clash: list[str], rows: object, cols: object, n_nearest: int | float | None, normalize: bool, before: object, after: object) -> DataFrame:
        """As ``impute`` for columns named as the grid's own ones may be: they have other names meanwhile."""
        other: dict[str, str] = {}
        for c in clash:
            other[c] = free_name(f"own{c}", [*df.columns, *other.values()])
        inner = SeriesImputer(**(self.get_params() | {"time_col": other.get(self.time_col, self.time_col)}))
        if cols is not None:
            wanted = [cols] if isinstance(cols, (str, int)) else list(cols)
            cols = [other.get(c, c) if isinstance(c, str) else c for c in wanted]
        out = inner.impute(df.withColumnsRenamed(other), rows, cols, n_nearest, normalize, before, after)
        back = {v: k for k, v in other.items()}
        self.table.imputation_features_ = {back.get(t, t): f for t, f in inner.imputation_features_.items()}
        return out.withColumnsRenamed(back)

    def _selected(self, rows: object, before: object, after: object) -> Column | None:
        t = F.col(f"`{self.time_col}`")
        if isinstance(rows, Column):
            return rows
        if rows is not None:
            listed = list(rows)
            if all(isinstance(r, int) and not isinstance(r, bool) for r in listed):
                return F.col("__ord").isin(listed)
            return t.cast("timestamp_ntz").isin([self._time(r) for r in listed])
        chosen = None
        for bound, test in ((before, lambda b: t.cast("timestamp_ntz") < b), (after, lambda b: t.cast("timestamp_ntz") > b)):
            if bound is not None:
                chosen = test(self._time(bound)) if chosen is None else chosen & test(self._time(bound))
        return chosen

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.impute(df)

