"""Dense matrices as cells (r, c, v): 32-bit integers (default 0) or floats (default NaN), Pearson best match, merging.

Indices are 0-based; cells outside the dimensions are dropped. Stored cells are sparse. An integer cell never written
reads as 0, a float cell as NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import saturate_int


@dataclass(frozen=True)
class Matrix:
    rows: int
    cols: int
    kind: str = "int"

    def __post_init__(self):
        if self.rows < 1 or self.cols < 1:
            raise ValueError("rows and cols must be at least 1")
        if self.kind not in ("int", "float"):
            raise ValueError("kind must be int or float")

    def configuration(self) -> dict[str, int | str]:
        return {"rows": self.rows, "cols": self.cols, "kind": self.kind}

    def _check(self, row: int) -> None:
        if not 0 <= row < self.rows:
            raise ValueError("invalid row")

    def _inside(self, cells: DataFrame) -> DataFrame:
        return cells.where(F.col("r").between(0, self.rows - 1) & F.col("c").between(0, self.cols - 1) & F.col("v").isNotNull())

    def _sum(self, v: Column) -> Column:
        """Integers saturate; floats skip NaN, and a cell of NaN only stays NaN. Float sums are taken in double, then rounded once."""
        if self.kind == "int":
            return saturate_int(F.sum(v.cast("bigint")))
        return F.coalesce(F.sum(F.when(~F.isnan(v), v.cast("double"))), F.lit(float("nan"))).cast("float")

    def build(self, events: DataFrame) -> DataFrame:
        """events (r, c, v), each added to its cell."""
        return self._inside(events).groupBy("r", "c").agg(self._sum(F.col("v")).alias("v"))

    def set(self, events: DataFrame, seq: str = "seq") -> DataFrame:
        """events (seq, r, c, v): the last of each cell."""
        return self._inside(events).groupBy("r", "c").agg(F.max_by(F.col("v").cast(self.kind), F.col(seq)).alias("v"))

    def get(self, cells: DataFrame, row: int, col: int) -> DataFrame:
        self._check(row)
        if not 0 <= col < self.cols:
            raise ValueError("invalid col")
        default = F.lit(0) if self.kind == "int" else F.lit(float("nan")).cast("float")
        return cells.where((F.col("r") == row) & (F.col("c") == col)).agg(F.coalesce(F.max("v"), default).alias("value"))

    def rows_as_arrays(self, cells: DataFrame) -> DataFrame:
        """r, values: dense arrays of the rows with any cell; a map of the cells is read in column order."""
        default = F.lit(0) if self.kind == "int" else F.lit(float("nan")).cast("float")
        by_col = F.map_from_entries(F.collect_list(F.struct("c", "v")))
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.cols - 1)), lambda c: F.coalesce(F.try_element_at(F.col("cells"), c), default))
        return cells.groupBy("r").agg(by_col.alias("cells")).select("r", dense.alias("values"))

    def row(self, cells: DataFrame, row: int) -> DataFrame:
        self._check(row)
        return self.rows_as_arrays(cells.where(F.col("r") == row)).select("values")

    def clear_row(self, cells: DataFrame, row: int) -> DataFrame:
        self._check(row)
        return cells.where(F.col("r") != row)

    def sums(self, cells: DataFrame) -> DataFrame:
        """r, sum of each row with any cell; NaN is skipped."""
        v = F.col("v").cast("bigint") if self.kind == "int" else F.nanvl(F.col("v"), F.lit(0.0).cast("float")).cast("double")
        return cells.groupBy("r").agg(F.sum(v).alias("sum"))

    def sum(self, cells: DataFrame, row: int) -> DataFrame:
        self._check(row)
        return cells.where(F.col("r") == row).agg(F.coalesce(F.sum(F.nanvl(F.col("v").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("sum"))

    def correlations(self, cells: DataFrame, row: int) -> DataFrame:
        """r, pcc of each other row with a row; null where either is constant.

        One pass: the row's own cells (as many as columns) are broadcast as a side of that size; every other row's sums come
        from one aggregation. Cells never written and NaN count as 0 in sums, and as columns in the mean.
        """
        self._check(row)
        v = F.nanvl(F.col("v").cast("double"), F.lit(0.0))
        # float: NaN cells leave the count of the mean and deviation
        n = F.lit(float(self.cols))
        x = cells.select("r", "c", v.alias("x"))
        target = x.where(F.col("r") == row).select("c", F.col("x").alias("y"))
        target = F.broadcast(target) if self.cols <= 1_000_000 else target
        t = x.where(F.col("r") == row).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("ty"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("tyy"))
        sums = x.where(F.col("r") != row).join(target, "c", "left").groupBy("r").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("sxy"))
        top = n * F.col("sxy") - F.col("sx") * F.col("ty")
        spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("tyy") - F.col("ty") * F.col("ty"))
        return sums.join(F.broadcast(t)).select("r", F.try_divide(top, F.sqrt(F.when(spread > 0, spread))).alias("pcc"))

    def best_match(self, cells: DataFrame, row: int, mode: str = "max", compat: bool = False) -> DataFrame:
        """pcc, closest: the most (or least) correlated other row, the lowest of equals; no row if there is none.

        compat: in mode min, a constant row anywhere means no match, as it counts as correlated at minus infinity.
        """
        if mode not in ("max", "min"):
            raise ValueError("mode must be max or min")
        found = self.correlations(cells, row)
        order = F.struct("pcc", -F.col("r")) if mode == "max" else F.struct("pcc", "r")
        best = (F.max if mode == "max" else F.min)(F.when(F.col("pcc").isNotNull(), order))
        out = found.agg(best.alias("b"), F.count_if(F.col("pcc").isNull()).alias("constant"), F.count("*").alias("others"))
        if compat and mode == "min":
            out = out.where((F.col("constant") == 0) & (F.col("others") == self.rows - 1))
        return out.where("b is not null").select(F.col("b.pcc").alias("pcc"), (-F.col("b")["col2"] if mode == "max" else F.col("b.r")).cast("int").alias("closest"))

    def merge_add(self, cells: DataFrame, other: DataFrame, of: Matrix) -> DataFrame:
        """Adds the part of another matrix that both have."""
        self._same(of)
        both = cells.select("r", "c", "v").unionByName(self._inside(other).select("r", "c", "v"))
        return both.groupBy("r", "c").agg(self._sum(F.col("v")).alias("v"))

    def merge_set(self, cells: DataFrame, other: DataFrame, of: Matrix) -> DataFrame:
        """Overwrites the part that both have, with unwritten cells too (0 or NaN: here, no cell)."""
        self._same(of)
        rows, cols = min(self.rows, of.rows), min(self.cols, of.cols)
        outside = cells.where((F.col("r") >= rows) | (F.col("c") >= cols)).select("r", "c", "v")
        return outside.unionByName(self._inside(other).select("r", "c", "v"))

    def _same(self, of: Matrix) -> None:
        if self.kind != of.kind:
            raise ValueError("matrices must be of one kind")
