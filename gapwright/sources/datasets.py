"""Public benchmark files: how each is read; the files themselves lie in a folder of the user's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.errors import GapValueError
from gapwright.functions.cells import is_numeric
from gapwright.operators.timegrid import regularise
from gapwright.sources.tables import checked_file, read_csv, slice_rows, synthetic_mixed, zeros_missing

HOUR, FIVE_MINUTES = 3_600_000_000, 300_000_000


@dataclass
class Dataset:
    """A delimited file: its name and checksum, its columns, and for a series its time and grid.

    ``time`` is one column or the parts year, month, day, hour.  Labels are
    read as text.  ``shape`` keeps the first rows and value columns only.
    """

    file: str
    md5: str | None = None
    sep: str = ","
    names: list[str] | None = None
    drop: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    time: list[str] = field(default_factory=list)
    step: int | None = None
    zero_missing: bool = False
    shape: tuple[int, int] | None = None
    call: dict = field(default_factory=dict)
    make: Callable[[SparkSession], DataFrame] | None = None

    @property
    def kind(self) -> str:
        return "series" if self.time else "table"

    def load(self, spark: SparkSession, folder: str, check: bool = True) -> DataFrame:
        """The table, or the series on its grid with its time first, in a column ``time``.

        With ``check`` a local file must have the known checksum.
        """
        if self.make:
            return self.make(spark)
        path = f"{folder.rstrip('/')}/{self.file}"
        if check and self.md5 and "://" not in path:
            checked_file(path, self.md5, "md5")
        df = read_csv(spark, path, None, self.sep, self.names is None, "NA")
        if self.names:
            if len(self.names) != len(df.columns):
                raise GapValueError(f"{self.file} has {len(df.columns)} columns and not {len(self.names)}")
            df = df.toDF(*self.names)
        if self.time:
            df = self._on_grid(df)
        df = df.drop(*self.drop)
        df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in self.labels})
        if self.zero_missing:
            df = zeros_missing(df)
        if self.shape:
            rows, columns = self.shape
            if self.time:
                values = [c for c in df.columns if c != "time"][:columns]
                return slice_rows(df, "time", rows, ["time", *values])
            df = df.limit(rows).select(*(f"`{c}`" for c in df.columns[:columns]))
        return df

    def _on_grid(self, df: DataFrame) -> DataFrame:
        first = F.col(f"`{self.time[0]}`")
        at = F.to_timestamp_ntz(first.cast("string")) if len(self.time) == 1 else F.make_timestamp_ntz(*(F.col(f"`{c}`").cast("int") for c in self.time), F.lit(0), F.lit(0.0))
        values = [F.col(f"`{c}`") for c in df.columns if c not in self.time]
        df = df.select(at.alias("time"), *values)
        # whole numbers have gaps on the grid, and are measurements
        df = df.withColumns({f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema.fields if f.name != "time" and is_numeric(f.dataType)})
        return regularise(df, "time", self.step).drop("__ord")


#: Files, checksums and columns of public datasets.
DATASETS: dict[str, Dataset] = {
    "titanic": Dataset("titanic.csv", "56f29cc0b807cb970a914ed075227f94"),
    "wine_quality_red": Dataset("winequality-red.csv", "2daeecee174368f8a33b82c8cccae3a5", sep=";"),
    "spambase": Dataset("spambase.data", "e7368d48fa690b0331a09b430d55fb6a", names=[*(f"f{i}" for i in range(57)), "spam"], drop=["spam"]),
    "letter_recognition": Dataset("letter-recognition.data", "6a2d740def5d13ea6096272546f6d41e", names=["letter", *(f"f{i}" for i in range(1, 17))], labels=["letter"]),
    "abalone": Dataset(
        "abalone.data", "a769fd0119787cac09158fe08971e480", labels=["sex"],
        names=["sex", "length", "diameter", "height", "whole", "shucked", "viscera", "shell", "rings"],
    ),
    "ionosphere": Dataset("ionosphere.data", "85649e5fb5b15fb9dab726c400be61fe", names=[*(f"f{i}" for i in range(34)), "class"], labels=["class"]),
    "pems_bay": Dataset("PEMS-BAY.csv", "c8dea58987a5882e946217c22fdb8256", time=["_c0"], step=FIVE_MINUTES, shape=(8064, 60), call={"n_nearest_features": 100}),
    "metr_la": Dataset("METR-LA.csv", "7c463fcbd28ecc6c9cd93e1ca120aaaa", time=["_c0"], step=FIVE_MINUTES, zero_missing=True, shape=(8064, 60), call={"n_nearest_features": 100}),
    "beijing_pm25": Dataset(
        "PRSA_data_2010.1.1-2014.12.31.csv", "83d51a811a081df89e691643af0edb29", time=["year", "month", "day", "hour"], step=HOUR, drop=["No"], labels=["cbwd"],
    ),
    "etth1": Dataset("ETTh1.csv", "8381763947c85f4be6ac456c508460d6", time=["date"], step=HOUR),
    "synthetic_mixed": Dataset("", make=synthetic_mixed),
}
