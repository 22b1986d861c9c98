"""Hard negatives by a BOND scan: vectors lie in columns, one per dimension.  For each anchor the columns are read in falling
magnitude of its components; what the unread columns can still add, by their least and greatest values, shrinks the bitmap of
candidates, until the rows left are those whose exact scores decide the windows.

Scores are integers, and floats hold them exactly as long as they stay below 2^53; beyond that the columns are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SLOT_ROWS = 16_384  # rows that a task holds in columns
PART_ANCHORS = 4_096  # anchors that it scans for
STEPS = (16, 32, 40, 48, 56)  # dimensions read when bounds are looked at; they are too wide before
FEW = 64  # candidates left that are scored without further bounds


def usable(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, q) of the rows that take part; equal ones count once."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    scaled = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fits = lambda q: F.when(F.abs(q) < 2**31, q.cast("int")).otherwise(F.raise_error(F.lit("a scaled component is over 31 bits")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(whole)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.transform(F.transform(vector, scaled), fits).alias("q")).dropDuplicates()


class Columns:
    """Rows of a slot, sorted by label, as one column per dimension; shorter vectors are filled with 0."""

    def __init__(self, table: pa.Table, dims: int, most: int) -> None:
        labels = table.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        self.labels, self.ids = labels[order], table.column("id").to_numpy()[order]
        rows = matrix(table, dims)[order]
        bound = dims * most * int(np.abs(rows).max(initial=0))
        self.kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
        self.values = np.ascontiguousarray(rows.T).astype(self.kind)
        self.least, self.greatest = self.values.min(axis=1), self.values.max(axis=1)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


def matrix(table: pa.Table, dims: int) -> np.ndarray:
    """Vectors as rows of `dims` numbers."""
    lists = table.column("q").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def scan(columns: Columns, anchor: np.ndarray, candidates: np.ndarray, windows: Sequence[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, with exact scores, among which are the first `k` of each window (least, greatest score), ties included."""
    anchor = anchor.astype(columns.kind)
    order = np.argsort(-np.abs(anchor), kind="stable")
    one, other = anchor * columns.least, anchor * columns.greatest
    # what the columns from a place in the order on can add at least and at most
    least, most = (np.append(np.cumsum(f(one, other)[order][::-1])[::-1], 0) for f in (np.minimum, np.maximum))
    scores = np.zeros(len(candidates), columns.kind)
    read, dims = 0, len(order)
    for step in [*(s for s in STEPS if s < dims), dims]:
        now = order[read:step] if len(candidates) > FEW else order[read:]
        scores = scores + anchor[now] @ columns.values[np.ix_(now, candidates)]
        read += len(now)
        if read == dims or not len(candidates):
            break
        low, high = scores + least[read], scores + most[read]
        keep = np.zeros(len(candidates), bool)
        for floor, ceiling in windows:
            sure = low[(low >= floor) & (high <= ceiling)]
            # k rows are sure to be in the window with at least this score
            need = max(floor, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else floor
            keep |= (high >= need) & (low <= ceiling)
        candidates, scores = candidates[keep], scores[keep]
    return candidates, scores


def first(columns: Columns, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Ids and scores of the first `k` rows: higher scores, then smaller ids."""
    if len(rows) > 4 * k:  # only rows from the k-th score up can be among them
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[near], scores[near]
    ids = columns.ids[rows]
    best = sorted(zip((-int(s) for s in scores), ids.tolist()))[:k]
    return [i for _, i in best], [-s for s, _ in best]


def _prepared(rows: pa.Table, anchors: pa.Table) -> tuple[Columns, np.ndarray] | None:
    if not rows.num_rows or not anchors.num_rows:
        return None
    dims = max(int(np.diff(t.column("q").combine_chunks().offsets.to_numpy()).max()) for t in (rows, anchors))
    queries = matrix(anchors, max(1, dims))
    return Columns(rows, max(1, dims), int(np.abs(queries).max(initial=0))), queries


def _table(columns: Sequence[str], rows: list[tuple]) -> pa.Table:
    data = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(columns, data)})


POSITIVE = ("anchor", "anchor_id", "positive_id", "positive_score")
NEGATIVE = (*POSITIVE, "place", "negative_id", "negative_score")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", slot_rows: int = SLOT_ROWS,
                   part_anchors: int = PART_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `is_anchor` holds.

    Each component counts as ``floor(scale * x)``; a score is the integer inner product, higher is nearer, ties go to the
    smaller id.  An anchor's positives are its first `positives` rows of its label and another id.  For each, the first
    `negatives` rows of other labels come out whose score is `low` to `high` percent of the positive's.

    Rows without id, label or vector, or with a null or non-finite component, take no part.  Rows equal in id, label and
    scaled vector count once; rows of one id that differ each count.  Shorter vectors are filled with 0, a scaled component over 31 bits is an
    error, an empty table gives no rows, and other columns are not read.

    Anchors meet all rows in cells of a grid, `slot_rows` rows by `part_anchors` anchors, each a task's memory; a cell gives
    at most `positives` or `negatives` rows per anchor and window, so nothing grows with a label or a group of copies.
    """
    rows = vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False)))
    own = stored(usable(rows, scale, vec_id, vector, label), "vectors")
    asked = stored(usable(rows.filter("__anchor"), scale, vec_id, vector, label).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    slots, parts = max(1, -(-own.count() // slot_rows)), max(1, -(-asked.count() // part_anchors))
    place = lambda *c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    cells = own.select("*", place("id", "q", n=slots).alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def grid(anchors: DataFrame, fn, names: Sequence[str]) -> DataFrame:
        dealt = anchors.select("*", place("anchor", n=parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        return (cells.groupBy("slot", "part").cogroup(dealt.groupBy("slot", "part"))
                .applyInArrow(fn, ", ".join(f"{n} bigint" for n in names)))

    def find_positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if (ready := _prepared(rows, anchors)) is not None:
            columns, queries = ready
            for number, name, of, query in zip(*(anchors.column(c).to_pylist() for c in ("anchor", "id", "label")), queries):
                begin, end = columns.of_label(of)
                others = np.arange(begin, end)[columns.ids[begin:end] != name]
                ids, scores = first(columns, *scan(columns, query, others, [(-math.inf, math.inf)], positives), positives)
                found += [(number, name, i, s) for i, s in zip(ids, scores)]
        return _table(POSITIVE, found)

    def find_negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if (ready := _prepared(rows, anchors)) is not None:
            columns, queries = ready
            wanted = anchors.column("wanted").to_pylist()
            for number, name, of, pairs, query in zip(*(anchors.column(c).to_pylist() for c in ("anchor", "id", "label")), wanted, queries):
                begin, end = columns.of_label(of)
                others = np.concatenate([np.arange(begin), np.arange(end, len(columns.ids))])
                windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in pairs]
                real = [w for w in windows if w[0] <= w[1]]
                if not real:
                    continue
                left, scores = scan(columns, query, others, sorted(set(real)), negatives)
                for pair, (floor, ceiling) in zip(pairs, windows):
                    inside = (scores >= floor) & (scores <= ceiling)
                    ids, values = first(columns, left[inside], scores[inside], negatives)
                    found += [(number, name, pair["positive_id"], pair["positive_score"], pair["place"], i, s) for i, s in zip(ids, values)]
        return _table(NEGATIVE, found)

    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = grid(asked, find_positives, POSITIVE).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    # at most `positives` entries each
    wanted = near.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("wanted"))
    pairs = grid(asked.join(wanted, "anchor"), find_negatives, NEGATIVE)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
