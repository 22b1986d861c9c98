"""What has happened before each chunk of a key, when chunk summaries are combined as a tree.

A key may go over very many chunks, so its summaries are no group of their own.  They are combined `FAN` at a time, level by
level, until one is left per key; on the way back each node hands its first child the state it got, and each further child that
state moved on by the children before it.  No task holds more than `FAN` summaries of a key at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from eventflow.operators.ordered import CHUNK, CHUNK_ROWS, ordered
from eventflow.session import written

FAN = 16
UP = "__up"


def arrow_schema(spark, schema: StructType | str) -> pa.Schema:
    """The Arrow schema that Spark expects of rows of `schema`."""
    return spark.createDataFrame([], schema).toArrow().schema


def states_before(nodes: DataFrame, keys: Sequence[str], chunks: int, state: str, combine: Callable[[list[dict]], dict],
                  advance: Callable[[dict | None, dict], dict], fan: int = FAN) -> DataFrame:
    """(chunk, keys, state fields) with the state before each chunk; null fields before a key's first chunk.

    `nodes` is a written table of (chunk, keys, summary fields), at most one row per chunk and key.  `combine` makes one summary
    of several that follow each other, `advance` moves a state (None at the start of a key) on by a summary.
    """
    spark, keys = nodes.sparkSession, list(keys)
    fields = [f for f in nodes.schema.names if f not in (CHUNK, *keys)]
    node_schema = arrow_schema(spark, nodes.schema)
    states = StructType.fromDDL(state)
    out_type = StructType([nodes.schema[CHUNK], *[nodes.schema[k] for k in keys], *states.fields])
    out_schema = arrow_schema(spark, out_type)

    def rows_of(group: pa.Table) -> list[dict]:
        return group.sort_by(CHUNK).to_pylist()

    def up(group: pa.Table) -> pa.Table:
        rows = rows_of(group)
        whole = combine([{f: r[f] for f in fields} for r in rows])
        return pa.Table.from_pylist([{CHUNK: rows[0][UP], **{k: rows[0][k] for k in keys}, **whole}], node_schema)

    def down(group: pa.Table) -> pa.Table:
        out, now = [], None
        for i, row in enumerate(rows_of(group)):
            if i == 0 and row["__known"]:
                now = {s: row[f"__s_{s}"] for s in states.names}
            out.append({CHUNK: row[CHUNK], **{k: row[k] for k in keys}, **(now or dict.fromkeys(states.names))})
            now = advance(now, {f: row[f] for f in fields})
        return pa.Table.from_pylist(out, out_schema)

    parent = F.floor(F.col(CHUNK) / fan).cast("int")
    levels, span = [nodes], chunks
    while span > fan:
        level = levels[-1].withColumn(UP, parent).groupBy(UP, *keys).applyInArrow(up, nodes.schema)
        levels.append(written(level, "prefix"))
        span = -(-span // fan)
    before = None
    for level in reversed(levels):
        rows = level.withColumn(UP, parent)
        if before is None:
            rows = rows.withColumns({"__known": F.lit(False), **{f"__s_{f.name}": F.lit(None).cast(f.dataType) for f in states}})
        else:
            above = before.select(F.col(CHUNK).alias("__of"), *[F.col(k).alias(f"__k_{k}") for k in keys],
                                  F.col(states.names[0]).isNotNull().alias("__known"), *[F.col(s).alias(f"__s_{s}") for s in states.names])
            match = F.col(UP) == F.col("__of")
            for k in keys:
                match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
            rows = rows.join(above, match).drop("__of", *[f"__k_{k}" for k in keys])
        before = rows.groupBy(UP, *keys).applyInArrow(down, out_type)
    return before


@dataclass(frozen=True)
class Walk:
    """A running state over rows in order.

    `start` is the state before the first row, and neutral for `combine`.  `step` takes a state and some rows that follow each other
    (as an Arrow batch) and gives the state after them and the output columns for them, in the order of `outputs`.
    `combine` is associative: the state after two runs of rows from the states after each of them from the start.
    """

    start: tuple
    step: Callable[[tuple, pa.RecordBatch], tuple[tuple, Sequence]]
    combine: Callable[[tuple, tuple], tuple]
    state: str
    outputs: str


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int, bool]]:
    """(begin, end, whether a key of a chunk begins) of the rows that belong together."""
    firsts = [i for i, first in enumerate(batch.column("__first").to_pylist()) if first]
    edges = sorted({0, *firsts, len(batch)})
    begins = set(firsts)
    return [(a, b, a in begins) for a, b in zip(edges, edges[1:])]


def scan_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], walk: Walk, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`df` with the output columns of `walk`, run over each key's rows in `order` (unique within a key).

    The rows are cut into chunks; each chunk of a key that goes over several is folded alone, the states are combined as a tree,
    and then all chunks are walked at the same time, each from the state before it.  So a key of any size is spread over tasks, and
    the result is that of one walk.  Null keys are a key; an empty table gives no rows.
    """
    spark, keys = df.sparkSession, list(keys)
    scan = ordered(df, keys, order, chunk_rows)
    scan = scan.with_columns({"__first": F.row_number().over(scan.window()) == 1})
    names = StructType.fromDDL(walk.state).names
    outputs = StructType.fromDDL(walk.outputs)
    given = [c for c in df.columns if c not in outputs.names]
    if scan.crossing is not None:
        nodes_type = StructType([scan.crossing.schema[CHUNK], *[df.schema[k] for k in keys], *StructType.fromDDL(walk.state).fields])
        nodes_schema = arrow_schema(spark, nodes_type)

        def fold(batches):
            state, place = None, None

            def summary() -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([{**place, **dict(zip(names, state))}], nodes_schema)

            for batch in batches:
                for begin, end, first in _runs(batch):
                    if first:
                        if place is not None:
                            yield summary()
                        state, place = walk.start, batch.slice(begin, 1).select([CHUNK, *keys]).to_pylist()[0]
                    state, _ = walk.step(state, batch.slice(begin, end - begin))
            if place is not None:
                yield summary()

        tuple_of = lambda row: tuple(row[n] for n in names)

        def combine(rows: list[dict]) -> dict:
            whole = walk.start
            for row in rows:
                whole = walk.combine(whole, tuple_of(row))
            return dict(zip(names, whole))

        nodes = written(scan.crossing.drop(*[c for c in ("__edge",) if c in scan.crossing.columns]).mapInArrow(fold, nodes_type), "folds")
        before = states_before(nodes, keys, scan.chunks, walk.state, combine,
                               lambda state, row: combine(([state] if state else []) + [row]))
        scan = scan.attach(before.select(CHUNK, *keys, F.lit(True).alias("__given"), *[F.col(n).alias(f"__s_{n}") for n in names]))
    else:
        scan = scan.with_columns({"__given": F.lit(False), **{f"__s_{f.name}": F.lit(None).cast(f.dataType) for f in StructType.fromDDL(walk.state)}})
    out_type = StructType([*[df.schema[c] for c in given], *outputs.fields])
    out_schema = arrow_schema(spark, outputs)

    def run(batches):
        state = walk.start
        for batch in batches:
            columns = [[] for _ in outputs.names]
            for begin, end, first in _runs(batch):
                if first:
                    row = batch.slice(begin, 1).to_pylist()[0]
                    known = row["__given"] and any(row[f"__s_{n}"] is not None for n in names)
                    state = tuple(row[f"__s_{n}"] for n in names) if known else walk.start
                state, made = walk.step(state, batch.slice(begin, end - begin))
                for column, values in zip(columns, made):
                    column.append(values)
            arrays = [pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v, out_schema.field(i).type) for v in column])
                      if column else pa.array([], out_schema.field(i).type) for i, column in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], *arrays], names=[*given, *outputs.names])

    return scan.rows.drop(CHUNK, "__edge").mapInArrow(run, out_type)
