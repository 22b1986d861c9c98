"""Order-dependent columns that survive hot keys.

A window partitioned by a key alone puts every row of a hot key into one task.  Here the rows are
cut into chunks of the order (key hash, order columns) instead: the cut points come from a sample,
so a hot key is spread over as many chunks as it needs.  Up to `COARSE` chunks have literal cut
points; more are cut in two levels, cells by literal points and each cell by points of its own, found
on the executors, so the number of chunks follows the rows.  Windows then run per (chunk, key), and
what a chunk needs from the chunks before it travels in a carry table.  Only keys that a cut point
falls into can need a carry, so that table holds at most two rows per chunk; it is broadcast up to
`SMALL_CARRY` chunks, and joined by (chunk, key) beyond.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from eventflow.session import written

CHUNK = "__chunk"
EDGE = "__edge"

CHUNK_ROWS = 2_000_000
COARSE = 1_024
SMALL_CARRY = 50_000
SMALL_CUTS = 1_000_000
SAMPLES_PER_CHUNK = 20


def _as_long(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "date":
        return F.unix_date(F.col(name)).cast("bigint")
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.col(name).cast("bigint")
    raise TypeError(f"order column {name} must be an integer, date or timestamp, not {kind}")


@dataclass(frozen=True)
class Ordered:
    """Rows with a chunk number, and the same for just the keys that cross a cut point."""

    rows: DataFrame
    crossing: DataFrame | None
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunks: int

    def window(self) -> WindowSpec:
        """Per (chunk, key), in order."""
        return Window.partitionBy(CHUNK, *self.keys).orderBy(*self.order)

    def _each(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        crossing = None if self.crossing is None else change(self.crossing)
        return replace(self, rows=change(self.rows), crossing=crossing)

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        """Add columns that look at one row, or at one `window()`."""
        return self._each(lambda df: df.withColumns(columns))

    def result(self) -> DataFrame:
        """The rows without the bookkeeping columns."""
        return self.rows.drop(CHUNK, EDGE)

    def carry(self, totals: dict[str, Column], before: dict[str, Callable[[WindowSpec], Column]]) -> Ordered:
        """Attach to each row what the earlier chunks of its key hold.

        `totals` are aggregates per (chunk, key); `before` turns them into columns over the
        window of all earlier chunks of the key.  With one chunk the columns are null.
        """
        if self.crossing is None:
            return self.with_columns({name: F.lit(None) for name in before})
        earlier = (Window.partitionBy(*self.keys).orderBy(CHUNK)
                   .rowsBetween(Window.unboundedPreceding, -1))
        table = (self.crossing.groupBy(CHUNK, *self.keys)
                 .agg(*[c.alias(n) for n, c in totals.items()])
                 .select(CHUNK, *self.keys, *[f(earlier).alias(n) for n, f in before.items()]))
        return self.attach(table)

    def attach(self, table: DataFrame) -> Ordered:
        """Join a table of one row per (chunk, crossing key) to the rows."""
        added = [c for c in table.columns if c not in (CHUNK, *self.keys)]
        table = table.select(*[F.col(c).alias(f"__r_{c}") for c in (CHUNK, *self.keys)], *added)

        def join(df: DataFrame) -> DataFrame:
            match = F.lit(True)
            for c in (CHUNK, *self.keys):
                match = match & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
            # at most two rows per chunk: see the module text
            joined = df.join(F.broadcast(table) if self.chunks <= SMALL_CARRY else table, match, "left")
            return joined.drop(*[f"__r_{c}" for c in (CHUNK, *self.keys)])

        return self._each(join)

    def row_number(self, name: str) -> Ordered:
        """1-based position within the key."""
        out = self.with_columns({name: F.row_number().over(self.window()).cast("bigint")})
        out = out.carry({"__n": F.count(F.lit(1))}, {"__before": lambda w: F.sum("__n").over(w)})
        return out._each(lambda df: df.withColumn(
            name, F.col(name) + F.coalesce(F.col("__before").cast("bigint"), F.lit(0))).drop("__before"))

    def running_sum(self, source: str, name: str) -> Ordered:
        """Sum of an integer column from the key's first row to this one."""
        w = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = self.with_columns({name: F.sum(source).over(w)})
        out = out.carry({"__n": F.sum(source)}, {"__before": lambda v: F.sum("__n").over(v)})
        return out._each(lambda df: df.withColumn(
            name, F.col(name) + F.coalesce(F.col("__before").cast("bigint"), F.lit(0))).drop("__before"))

    def lag(self, sources: dict[str, str]) -> Ordered:
        """Values of the previous row of the key; null on the key's first row."""
        w = self.window()
        kinds = dict(self.rows.dtypes)
        out = self.with_columns({
            "__first": F.row_number().over(w) == 1,
            **{name: F.lag(source).over(w) for name, source in sources.items()}})
        position = F.struct(*self.order)
        out = out.carry(
            {f"__t_{n}": F.max_by(F.struct(s), position) for n, s in sources.items()},
            {f"__c_{n}": (lambda n: lambda v: F.last(f"__t_{n}").over(v))(n) for n in sources})
        if self.crossing is None:
            picked = {}
        else:
            picked = {n: F.when(F.col("__first"), F.col(f"__c_{n}")[s].cast(kinds[s])).otherwise(F.col(n))
                      for n, s in sources.items()}
        return out._each(lambda df: df.withColumns(picked).drop("__first", *[f"__c_{n}" for n in sources]))

    def last_value(self, source: str, name: str) -> Ordered:
        """The latest non-null value of the key up to this row."""
        kind = dict(self.rows.dtypes)[source]
        w = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = self.with_columns({name: F.last(source, ignorenulls=True).over(w)})
        position = F.when(F.col(source).isNotNull(), F.struct(*self.order))
        out = out.carry({"__t": F.max_by(source, position)},
                        {"__before": lambda v: F.last("__t", ignorenulls=True).over(v)})
        return out._each(lambda df: df.withColumn(
            name, F.coalesce(F.col(name), F.col("__before").cast(kind))).drop("__before"))


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int = CHUNK_ROWS,
            at_most: int | None = None) -> Ordered:
    """Cut `df` into chunks of about `chunk_rows` rows in the order (key hash, `order`).

    Runs a count, unless `at_most` bounds the number of rows, and, above one chunk, a sample of
    the key and order columns.  The order should be unique within a key.
    """
    total = df.count() if at_most is None else at_most
    chunks = math.ceil(total / chunk_rows)
    plain = Ordered(df.withColumn(CHUNK, F.lit(0)).withColumn(EDGE, F.lit(False)), None, tuple(keys), tuple(order), 1)
    if chunks <= 1:
        return plain
    key_hash = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    place = [key_hash, *[F.coalesce(_as_long(df, c), F.lit(-2**63)) for c in order]]
    names = [f"p{i}" for i in range(len(place))]
    here = F.struct(*[c.alias(n) for c, n in zip(place, names)])
    kind = "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>"
    cells = min(chunks, COARSE)
    fraction = min(1.0, 2 * SAMPLES_PER_CHUNK * cells / total)
    # bounded: about 2 * SAMPLES_PER_CHUNK * COARSE rows of a few longs at most
    sample = sorted(tuple(r) for r in
                    df.select(*[c.alias(n) for c, n in zip(place, names)]).sample(fraction, seed=17).collect())
    cuts = sorted({sample[len(sample) * i // cells] for i in range(1, cells)}) if sample else []
    if not cuts:
        return plain
    bounds = F.from_json(F.lit(json.dumps([dict(zip(names, cut)) for cut in cuts])), kind)
    cell = count_not_after(bounds, F.lit(len(cuts)), here, len(cuts))
    if chunks > COARSE:
        return _fine(df, keys, order, here, key_hash, bounds, cell, len(cuts) + 1, chunks, total, kind)
    near = lambda at: F.coalesce(F.get(bounds, at)["p0"] == key_hash, F.lit(False))
    rows = df.withColumn(CHUNK, cell).withColumn(EDGE, near(F.col(CHUNK) - 1) | near(F.col(CHUNK)))
    return Ordered(rows, rows.filter(EDGE), tuple(keys), tuple(order), len(cuts) + 1)


def _fine(df: DataFrame, keys: Sequence[str], order: Sequence[str], here: Column, key_hash: Column, bounds: Column, cell: Column,
          cells: int, chunks: int, total: int, kind: str) -> Ordered:
    """Cells cut further, each at points of its own.

    A cell's points are those of a sample of its rows, gathered where the cell is; a row of the table holds those of one cell, and the cut
    points around it.  The table is written, so that every use of the rows sees the same points.
    """
    per_cell = math.ceil(chunks / cells)
    sampled = df.select(cell.alias("cell"), here.alias("here")).sample(min(1.0, 2 * SAMPLES_PER_CHUNK * chunks / total), seed=18)
    # about 2 * SAMPLES_PER_CHUNK * per_cell entries a group
    points = sampled.groupBy("cell").agg(F.sort_array(F.collect_list("here")).alias("sample"))
    picked = F.transform(F.sequence(F.lit(1), F.lit(max(1, per_cell - 1))),
                         lambda i: F.get("sample", F.floor(F.size("sample") * i / per_cell).cast("int")))
    inner = F.array_sort(F.array_distinct(F.array_compact(picked))) if per_cell > 1 else F.array().cast(kind)
    edges = F.concat(F.filter(F.array(F.get(bounds, F.col("cell") - 1)), lambda x: x.isNotNull()), inner)
    points = written(points.select("cell", F.array_distinct(edges).alias("from")), "cuts")
    # a cell may be short of points; its first chunk begins at the cell's own cut
    sizes = {r["cell"]: r.n for r in points.select("cell", F.size("from").alias("n")).collect()}  # at most COARSE rows
    first, at = {}, 0
    for number in range(cells):
        first[number] = at
        at += max(1, sizes.get(number, 1) + (number == 0))
    starts = df.sparkSession.createDataFrame(list(first.items()), "__cell int, __start int")
    table = starts.join(points.select(F.col("cell").alias("__cell"), F.col("from").alias("__from")), "__cell", "left").select(
        "__cell", "__start", F.coalesce("__from", F.array().cast(kind)).alias("__from"))
    # a few longs a chunk
    joined = df.withColumn("__cell", cell).join(F.broadcast(table) if chunks <= SMALL_CUTS else table, "__cell", "left")
    passed = count_not_after(F.col("__from"), F.size("__from"), here, max(sizes.values(), default=0) + 1)
    rows = joined.withColumn("__passed", passed)
    # in the first cell no point is passed before its first chunk, in others the cell's own is
    inside = F.greatest(F.col("__passed") - F.when(F.col("__cell") == 0, 0).otherwise(1), F.lit(0))
    below = F.coalesce(F.get("__from", F.col("__passed") - 1), F.get(bounds, F.col("__cell") - 1))
    above = F.coalesce(F.get("__from", F.col("__passed")), F.get(bounds, F.col("__cell")))
    edge = F.coalesce(below["p0"] == key_hash, F.lit(False)) | F.coalesce(above["p0"] == key_hash, F.lit(False))
    rows = rows.withColumn(CHUNK, F.col("__start") + inside).withColumn(EDGE, edge).drop("__cell", "__start", "__from", "__passed")
    return Ordered(rows, rows.filter(EDGE), tuple(keys), tuple(order), at)


def count_not_after(bounds: Column, n: Column, here: Column, most: int) -> Column:
    """How many of the sorted `bounds` (`n` of them, at most `most`) are not after `here`, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def step(found: Column, width: Column) -> Column:
        probe = found + width
        return F.when((probe <= n) & (F.get(bounds, probe - 1) <= here), probe).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)
