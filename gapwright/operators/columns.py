"""Encoded features of a mixed table: numbers, ordinal codes and one-hot columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwright.errors import GapValueError
from gapwright.functions.cells import is_label, is_numeric, missing, number, number_sql
from gapwright.operators.profile import ColumnProfile

#: A label column of more distinct values gives no features: each value would be one.
MAX_CATEGORIES = 1000


@dataclass
class Feature:
    name: str
    source: str
    kind: str  # number, code or dummy
    category: object = None


@dataclass
class Encoding:
    """Features in order; categories by label column; shift and scale of each feature."""

    schema: T.StructType
    sources: list[str]
    features: list[Feature]
    categories: dict[str, list]
    shift: list[float]
    scale: list[float]
    #: Label columns of too many values, which are neither features nor have models.
    loose: list[str] = field(default_factory=list)

    def raw(self, f: Feature) -> Column:
        """The encoded cell, NULL where its source is missing (also for one-hot columns)."""
        kind = self.schema[f.source].dataType
        if f.kind == "number":
            return number(f.source, kind)
        c = F.col(f"`{f.source}`")
        if f.kind == "dummy":
            return (c == F.lit(f.category)).cast("double")
        return code(c, self.categories[f.source]).cast("double")

    def values(self) -> list[Column]:
        """All features, shifted and scaled, NULL where missing."""
        return [self._value(i, f) for i, f in enumerate(self.features)]

    def _value(self, i: int, f: Feature) -> Column:
        if f.kind != "number" or (not self.shift[i] and self.scale[i] == 1.0):
            return self.raw(f)
        return F.expr(f"({number_sql(f.source, self.schema[f.source].dataType)} - double({self.shift[i]!r})) / double({self.scale[i]!r})")

    def target(self, source: str) -> int:
        return next(i for i, f in enumerate(self.features) if f.source == source and f.kind != "dummy")

    def bit(self, i: int) -> int:
        return 1 << self.sources.index(self.features[i].source)


def code(c: Column, categories: list) -> Column:
    """The place of a label among its categories; NULL for any other value."""
    if not categories:
        return F.lit(None).cast("int")
    place = F.array_position(F.array(*(F.lit(k) for k in categories)), c)
    return F.when(place > 0, place - 1).cast("int")


def label(codes: Column, categories: list, kind: T.DataType) -> Column:
    """The label of a code."""
    if not categories:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.array(*(F.lit(k) for k in categories)), (F.rint(codes.cast("double")) + 1).cast("int")).cast(kind)


def many_labels(df: DataFrame, names: list[str], limit: int = MAX_CATEGORIES) -> list[str]:
    """Which columns have more than ``limit`` distinct labels, give or take the error of the estimate."""
    if not names:
        return []
    sizes = df.agg(*(F.approx_count_distinct(F.col(f"`{n}`"), 0.02).alias(n) for n in names)).first()
    return [n for n in names if sizes[n] > 1.1 * limit]


def discover(df: DataFrame, names: list[str], limit: int = MAX_CATEGORIES) -> dict[str, list]:
    """Sorted distinct labels of each column, in one aggregate behind a check of their number."""
    if not names:
        return {}
    wide = many_labels(df, names, limit)
    if wide:
        raise GapValueError(f"columns {', '.join(wide)} have more than {limit} labels")
    found = df.agg(*(F.array_sort(F.collect_set(F.col(f"`{n}`"))).alias(n) for n in names)).first()
    return {n: list(found[n] or []) for n in names}


def one_hot(df: DataFrame, name: str, categories: list | None = None) -> DataFrame:
    """Adds {name}_{category} columns of 0 and 1, NULL where the label is missing."""
    labels = categories if categories is not None else discover(df, [name])[name]
    return df.withColumns({f"{name}_{k}": (F.col(f"`{name}`") == F.lit(k)).cast("int") for k in labels})


def encode(df: DataFrame, profiles: dict[str, ColumnProfile], normalize: bool, centre: bool, declared: dict[str, list] | None = None) -> Encoding:
    """Plans the features of a table.

    A number gives itself; a label its code and then one column a category.
    With ``normalize`` numbers are standardised; else they are only centred, if
    ``centre`` (a model with an intercept does not notice).  Undeclared label
    columns of more than ``MAX_CATEGORIES`` values stand aside.
    """
    declared = declared or {}
    sources, features, shift, scale = [], [], [], []
    open_ = [f.name for f in df.schema.fields if is_label(f.dataType) and f.name not in declared]
    loose = many_labels(df, open_)
    found = df.agg(*(F.array_sort(F.collect_set(F.col(f"`{n}`"))).alias(n) for n in open_ if n not in loose)).first() if set(open_) - set(loose) else {}
    categories = {n: list(found[n] or []) for n in open_ if n not in loose} | {k: list(v) for k, v in declared.items()}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NullType) or f.name in loose:
            continue
        sources.append(f.name)
        if is_numeric(f.dataType):
            p = profiles[f.name]
            features.append(Feature(f.name, f.name, "number"))
            shift.append(p.mean if normalize or centre else 0.0)
            scale.append(p.scale if normalize else 1.0)
            continue
        own = [Feature(f.name, f.name, "code"), *(Feature(f"{f.name}_{k}", f.name, "dummy", k) for k in categories[f.name])]
        features += own
        shift += [0.0] * len(own)
        scale += [1.0] * len(own)
    return Encoding(df.schema, sources, features, categories, shift, scale, loose)


def missing_of(df: DataFrame, name: str) -> Column:
    return missing(name, df.schema[name].dataType)
