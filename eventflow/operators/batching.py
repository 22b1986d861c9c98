"""Size-or-timeout batches over ordered events.

A batch opens at its first event.  It closes when it holds `size` events, and an event that comes
`timeout` or more after the first event opens the next one.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from eventflow.functions.durations import duration_text_us
from eventflow.operators.ordered import CHUNK, CHUNK_ROWS, EDGE, Ordered, ordered
from eventflow.operators.prefix import arrow_schema, states_before
from eventflow.session import written

DEFAULT_SIZE = 10
DEFAULT_TIMEOUT = "1s"
WALK_ROWS = 1_000_000
LONG_AGO = -(2**63)

_OPEN = ("__open_us", "__open_n", "__open_no")


def assign_batches(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], size: int = DEFAULT_SIZE,
                   timeout: str | None = DEFAULT_TIMEOUT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `batch_no` (from 0 per key), `batch_id` (unique) and `pos` (from 0 in the batch).

    Events of a key are in (`ts`, `tie`) order; `tie` makes the order unique.  Without a timeout
    this is a row number.  With one, each batch depends on the one before, so each task walks its
    rows; a key that is spread over several chunks is walked chunk by chunk at the same time, after
    a first pass that tells how each chunk ends for each way it can begin (`Passage`).  Passages are
    combined as a tree, so no task holds more than a few of them, each with at most `size` entries.
    """
    if size < 1:
        raise ValueError("batch size must be 1 or higher")
    scan = ordered(df, keys, [ts, *tie], chunk_rows)
    if timeout is None:
        at = F.col("__n") - 1
        out = scan.row_number("__n").result()
        out = out.withColumns({"batch_no": F.floor(at / size).cast("bigint"), "pos": (at % size).cast("int")}).drop("__n")
    else:
        out = _walk(scan, ts, size, duration_text_us(timeout))
    return out.withColumn("batch_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys],
                                                  F.col("batch_no").cast("string")))


def assign_poll_batches(df: DataFrame, cycle: str, ts: str, tie: Sequence[str], size: int,
                        max_wait: str | None = None, one_over: bool = False,
                        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Batches within poll cycles: the end of a cycle flushes.

    `one_over` lets a batch hold one event more than `size`.
    """
    return assign_batches(df, [cycle], ts, tie, size + 1 if one_over else size, max_wait, chunk_rows)


def _walk(scan: Ordered, ts: str, size: int, timeout_us: int) -> DataFrame:
    scan = scan.with_columns({"__us": F.unix_micros(F.col(ts).cast("timestamp")),
                              "__first": F.row_number().over(scan.window()) == 1})
    if scan.crossing is not None:
        scan = scan.attach(_openings(scan, size, timeout_us))
    else:
        scan = scan.with_columns({c: F.lit(None).cast("bigint") for c in _OPEN})
    columns = [c for c in scan.rows.columns if not c.startswith("__")]
    schema = T.StructType([*[scan.rows.schema[c] for c in columns],
                           T.StructField("batch_no", T.LongType()), T.StructField("pos", T.IntegerType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, held, number = 0, size, -1
        for batch in batches:
            first = batch.column("__first").to_pylist()
            times = batch.column("__us").to_pylist()
            starts = list(zip(*[batch.column(c).to_pylist() for c in _OPEN]))
            numbers, places = [], []
            for i, now in enumerate(times):
                if first[i]:
                    opened, held, number = starts[i] if starts[i][0] is not None else (0, size, -1)
                if held >= size or now - opened >= timeout_us:
                    opened, held, number = now, 0, number + 1
                numbers.append(number)
                places.append(held)
                held += 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(numbers, pa.int64()), pa.array(places, pa.int32())],
                names=[*columns, "batch_no", "pos"])

    # rows arrive in the order of the window above, group by group
    return scan.rows.drop(CHUNK, EDGE).mapInArrow(walk, schema)


@dataclass(frozen=True)
class Passage:
    """A chunk (or several) as a function from the batch that is open before it to the one that is open after it.

    What happens depends on how many of the first rows the open batch still takes.  Numbers of rows with the same outcome are one
    entry: taken at least `at` rows, the last of which came at `head`, the batch open at the end was opened at `us`, holds `held`
    and is the `begun`-th that began here.  A batch that takes all `n` rows, the last of which came at `last`, goes on.
    """

    n: int
    last: int
    at: np.ndarray
    head: np.ndarray
    us: np.ndarray
    held: np.ndarray
    begun: np.ndarray

    LISTS = ("at", "head", "us", "held", "begun")

    @classmethod
    def of_row(cls, row: Mapping) -> Passage:
        return cls(row["n"], row["last"], *[np.asarray(row[c], np.int64) for c in cls.LISTS])

    def as_row(self) -> dict:
        return {"n": self.n, "last": self.last, **{c: getattr(self, c) for c in self.LISTS}}

    @classmethod
    def merged(cls, n: int, last: int, at, head, us, held, begun) -> Passage:
        """Neighbours with the same outcome become one."""
        new = np.append(True, (us[1:] != us[:-1]) | (held[1:] != held[:-1]) | (begun[1:] != begun[:-1]))
        return cls(int(n), int(last), at[new], head[new], us[new], held[new], begun[new])

    @classmethod
    def of_times(cls, times: np.ndarray, size: int, timeout_us: int) -> Passage:
        """The passage of rows at sorted times."""
        n = len(times)
        # from the back: where the batches that begin at a row end up, and how many they are
        last, begun = array("q", bytes(8 * n)), array("q", bytes(8 * n))
        for high in range(n, 0, -WALK_ROWS):
            low = max(0, high - WALK_ROWS)
            part = times[low:high]
            after = np.minimum(np.arange(low, high) + size, np.searchsorted(times, part + timeout_us, side="left"))
            for i, j in zip(range(high - 1, low - 1, -1), after[::-1].tolist()):
                if j >= n:
                    last[i], begun[i] = i, 1
                else:
                    last[i], begun[i] = last[j], begun[j] + 1
        taken = np.arange(min(size, n))
        ends = np.frombuffer(last, np.int64)[taken]
        head = np.append(LONG_AGO, times[taken[:-1]])
        return cls.merged(n, times[-1], taken, head, times[ends], n - ends, np.frombuffer(begun, np.int64)[taken])

    def after(self, us: np.ndarray, held: np.ndarray, begun: np.ndarray, size: int, timeout_us: int) -> tuple[np.ndarray, ...]:
        """Batches open before it to batches open after it."""
        room, due = size - held, us + timeout_us
        whole = (self.n <= room) & (self.last < due)
        k = np.minimum(np.searchsorted(self.at, room, "right"), np.searchsorted(self.head, due, "left")) - 1
        return (np.where(whole, us, self.us[k]), np.where(whole, held + self.n, self.held[k]), np.where(whole, begun, begun + self.begun[k]))

    def then(self, other: Passage, size: int, timeout_us: int) -> Passage:
        """Both, one after the other."""
        outcome = other.after(self.us, self.held, self.begun, size, timeout_us)
        # an open batch that takes all rows of this one goes on in the other
        more = self.n + other.at < size
        head = np.append(self.last, other.head[1:])
        parts = [(self.at, self.n + other.at), (self.head, head), (outcome[0], other.us), (outcome[1], other.held), (outcome[2], other.begun)]
        return Passage.merged(self.n + other.n, other.last, *[np.append(a, b[more]) for a, b in parts])


def _openings(scan: Ordered, size: int, timeout_us: int) -> DataFrame:
    """The batch that is open when each chunk of a crossing key begins."""
    keys = list(scan.keys)
    fields = [T.StructField("n", T.LongType()), T.StructField("last", T.LongType()),
              *[T.StructField(c, T.ArrayType(T.LongType())) for c in Passage.LISTS]]
    nodes_type = T.StructType([T.StructField(CHUNK, T.IntegerType()), *[scan.crossing.schema[k] for k in keys], *fields])
    nodes_schema = arrow_schema(scan.rows.sparkSession, nodes_type)

    def passage(group: pa.Table) -> pa.Table:
        # a chunk of one key, at most about `chunk_rows` rows
        times = np.sort(group.column("__us").to_numpy())
        place = group.slice(0, 1).select([CHUNK, *keys]).to_pylist()[0]
        return pa.Table.from_pylist([{**place, **Passage.of_times(times, size, timeout_us).as_row()}], nodes_schema)

    def combine(rows: list[dict]) -> dict:
        whole, *rest = map(Passage.of_row, rows)
        for other in rest:
            whole = whole.then(other, size, timeout_us)
        return whole.as_row()

    def advance(state: dict | None, row: dict) -> dict:
        passed = Passage.of_row(row)
        if state is None:  # the first row opens a batch
            return dict(zip(_OPEN, (int(passed.us[0]), int(passed.held[0]), int(passed.begun[0]) - 1)))
        out = passed.after(*[np.array([state[c]], np.int64) for c in _OPEN], size, timeout_us)
        return dict(zip(_OPEN, (int(x[0]) for x in out)))

    chunks = scan.crossing.select(CHUNK, *keys, "__us").groupBy(CHUNK, *keys).applyInArrow(passage, nodes_type)
    state = ", ".join(f"{c} bigint" for c in _OPEN)
    return states_before(written(chunks, "passages"), keys, scan.chunks, state, combine, advance)
