"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypolake.operators.lineage import cut


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by ``order`` (which must break ties). An aggregation with map-side combine: no window, so a hot key is not gathered in one task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def pivot_max(df: DataFrame, keys: Sequence[str], names: Sequence[str], value: str = "value_numeric", label: str = "dimension") -> DataFrame:
    """Long to wide in one aggregation: the largest value of each label."""
    return df.where(F.col(label).isin(*names)).groupBy(*keys).agg(*[F.max(F.when(F.col(label) == n, F.col(value))).alias(n) for n in names])


def count_if(condition: Column) -> Column:
    """COUNT(*) FILTER (WHERE condition); a null condition does not count."""
    return F.count(F.when(condition, 1))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent(a: Column, b: Column, digits: int = 1) -> Column:
    return F.round(100.0 * a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)


@dataclass(frozen=True)
class Test:
    """A threshold test on one column: ge, lt, true or false."""

    label: str
    category: str
    column: str
    op: str = "ge"
    threshold: float | None = None

    def flag(self) -> Column:
        c = F.col(self.column)
        return {"ge": lambda: c >= self.threshold, "lt": lambda: c < self.threshold, "true": lambda: c.eqNullSafe(F.lit(True)), "false": lambda: c.eqNullSafe(F.lit(False))}[self.op]()

    def sql(self) -> str:
        """The same flag as SQL, for comparison."""
        return {"ge": f"({self.column} >= {self.threshold})", "lt": f"({self.column} < {self.threshold})", "true": f"({self.column} IS TRUE)", "false": f"({self.column} IS FALSE)"}[self.op]


def explode_tests(df: DataFrame, tests: Sequence[Test], keep: Sequence[str], flag: str = "supported", **literals: str) -> DataFrame:
    """A row for each test and each row of df whose tested value is known: one scan instead of a union of one for each test."""
    items = [F.when(F.col(t.column).isNotNull(), F.struct(F.lit(t.label).alias("dimension"), F.lit(t.category).alias("category"), t.flag().alias(flag))) for t in tests]
    out = df.select(*keep, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("t"))
    return out.select(*keep, "t.dimension", "t.category", f"t.{flag}", *[F.lit(v).alias(k) for k, v in literals.items()])


def distinct_joined(column: str, separator: str = "|") -> Column:
    """STRING_AGG(DISTINCT column, separator ORDER BY column)."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def distinct_joined_of(column: str, values: Sequence[str], separator: str = "|") -> Column:
    """distinct_joined for a column with a known list of at most 63 values: the set is a number, so the aggregation hashes and needs no list for each group."""
    ordered = sorted(values)
    bit = F.lit(0).cast("long")
    for i, v in enumerate(ordered):
        bit = F.when(F.col(column) == v, F.lit(1 << i).cast("long")).otherwise(bit)
    found = F.bit_or(bit)
    return F.array_join(F.array(*[F.when(found.bitwiseAND(1 << i) != 0, v) for i, v in enumerate(ordered)]), separator)


def with_exclusive_sum(df: DataFrame, keys: Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of a key that lie strictly before ``at``."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def with_running_totals(df: DataFrame, by: Sequence[str], at: str, values: Sequence[str], width: float, descending: bool = False) -> DataFrame:
    """Adds before_<value>: the sum of the value over the rows of a group that come before in order of the number ``at`` (whose values are distinct in a group). Rows are dealt by ranges of ``width``, so one large group is not sorted in one task; only the ranges' sums are."""
    from pyspark.sql import Window

    order = F.desc if descending else F.asc
    bucket = F.floor(F.col(at) / width).alias("_bucket")
    rows = df.withColumn("_bucket", bucket)
    past = Window.partitionBy(*by).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values]).select(*by, "_bucket", *[F.coalesce(F.sum(f"_s_{v}").over(past), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy(*by, "_bucket").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    on = None
    a, b = local.alias("a"), starts.alias("b")
    for c in (*by, "_bucket"):
        part = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = part if on is None else on & part
    return a.join(b, on).select("a.*", *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"before_{v}") for v in values]).drop("_bucket", *[f"_l_{v}" for v in values])


def with_rank(df: DataFrame, order: Sequence[Column], name: str, buckets: int = 64) -> DataFrame:
    """Global rank from 1 by ``order`` without a single-partition window: rows are dealt into ranges (which are fixed by a checkpoint), and each range's numbers start after those of the ranges before it."""
    from pyspark.sql import Window

    ranged = cut(df.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_i", within).join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_i")).cast("long")).drop("_part", "_i", "_start")
