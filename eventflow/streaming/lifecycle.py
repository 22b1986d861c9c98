"""Stateful streams whose state goes away: pending and stuck events, and answers that a waiter still waits for.

State is kept for event positions or batches, changed by the rows in order of time, and deleted by timers of the event time, so that it
holds what is open and what came within the watermark's delay, however long the stream runs.  Positions or batches of a bucket share one
state, an Arrow table, and one timer, the earliest of theirs: a call handles all of them as columns, whatever their keys look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventflow.functions.durations import duration_text_us
from eventflow.operators.delivery import POSITION
from eventflow.session import keyed_state

DELAY = "10m"
BUCKETS = 1024  # states of a stream at most; fixed for as long as a checkpoint is used
BLOCK_BITS = 10  # 2^10 neighbouring offsets are in one bucket, so that rows that come together meet in few states
FOLD_ROWS = 1_000_000  # rows of a bucket that a task holds before it joins them to the positions
NONE = 2**63 - 1  # a time or number that is not there; as a time later than any
STATE = "held binary"
CHANGES = "topic string, shard_id int, offset bigint, change string, us bigint"
HELD = pa.schema([("topic", pa.string()), ("shard_id", pa.int64()), ("offset", pa.int64()), ("received", pa.int64()), ("acked", pa.int64()),
                  ("told", pa.bool_())])
TOLD, KNOWN, MET = 1, 2, 4  # of a position before this micro-batch: found stuck, received, received and acked


def _packed(schema: pa.Schema, columns: dict) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.table(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked(schema: pa.Schema, data: bytes | None) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(pa.py_buffer(data)).read_all() if data else schema.empty_table()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _wake(state: GroupState, due: np.ndarray) -> None:
    """A timer for the earliest of `due` (microseconds, all after the watermark; NONE: no timer)."""
    first = int(due.min(initial=NONE))
    if first != NONE:  # whole milliseconds, never before the time; a timer goes off when the watermark has passed it
        state.setTimeoutTimestamp(max(-(-first // 1000) - 1, 1))


def _codes(values: np.ndarray, known: dict) -> np.ndarray:
    """Numbers of values, the same ones in every call with the same `known`."""
    codes, names = pd.factorize(values, use_na_sentinel=False)
    return np.array([known.setdefault(None if n != n else n, len(known)) for n in names], np.int64)[codes]


def _positions(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row per (topic number, shard, offset), with its earliest times received and acked, and what it was before."""
    topic, shard, offset, received, acked, was = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((offset, shard, topic))
    topic, shard, offset = topic[order], shard[order], offset[order]
    first = np.flatnonzero(np.r_[True, (topic[1:] != topic[:-1]) | (shard[1:] != shard[:-1]) | (offset[1:] != offset[:-1])][:len(order)])
    return (topic[first], shard[first], offset[first], np.minimum.reduceat(received[order], first), np.minimum.reduceat(acked[order], first),
            np.bitwise_or.reduceat(was[order], first)) if len(first) else (topic, shard, offset, received, acked, was)


def event_changes(events: DataFrame, acks: DataFrame, timeout: str | None = None, delay: str = DELAY) -> DataFrame:
    """(topic, shard_id, offset, change, ts) of events and acks (both with `ts`) as they meet.

    ``pending``: an event was received and is not acked; ``settled``: a pending event was acked; ``stuck``: it was not acked within
    `timeout` (once, when the watermark gets there or a late ack comes).  An event whose ack is there already gives no other change.  So the
    changes of a position add up to whether it is pending: 1 for each ``pending``, -1 for each ``settled``.

    A position's state is deleted `delay` after event and ack have met, or after an ack without event; repeated rows are known until
    then.  Rows without a full position or a time are left out.  Append mode.
    """
    keyed_state(events.sparkSession)
    limit, keep = duration_text_us(timeout) if timeout else None, duration_text_us(delay)

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The positions of a bucket: each is received, perhaps acked, perhaps found stuck, then forgotten."""
        now, topics = state.getCurrentWatermarkMs() * 1000, {}
        held = _unpacked(HELD, state.get[0] if state.exists else None)
        known, met = held["received"] != NONE, (held["received"] != NONE) & (held["acked"] != NONE)
        rows = [(_codes(held["topic"], topics), held["shard_id"], held["offset"], held["received"], held["acked"],
                 (held["told"] * TOLD | known * KNOWN | met * MET).astype(np.int8))]
        for part in () if state.hasTimedOut else parts:
            us, is_ack = part["us"].to_numpy(), part["acked"].to_numpy(bool)
            rows.append((_codes(part["topic"].to_numpy(), topics), part["shard_id"].to_numpy(np.int64), part["offset"].to_numpy(),
                         np.where(is_ack, NONE, us), np.where(is_ack, us, NONE), np.zeros(len(part), np.int8)))
            if sum(len(r[0]) for r in rows[1:]) >= FOLD_ROWS:
                rows = [_positions(rows)]
        topic, shard, offset, received, acked, was = _positions(rows)
        names, told, known, met = np.array(list(topics), object), was & TOLD != 0, was & KNOWN != 0, was & MET != 0
        has_event, has_ack = received != NONE, acked != NONE
        stuck_at = np.where(has_event, received + limit, NONE) if limit is not None else np.full(len(offset), NONE)
        changes = []

        def change(name: str, which: np.ndarray, us: np.ndarray) -> None:
            if which.any():
                changes.append(pd.DataFrame({"topic": names[topic[which]], "shard_id": shard[which].astype(np.int32), "offset": offset[which],
                                             "change": name, "us": us[which]}))

        late = has_event & has_ack & ~met & ~told & (limit is not None) & (acked >= stuck_at)
        change("stuck", late, stuck_at)
        change("settled", has_event & has_ack & ~met & known, acked)
        change("pending", has_event & ~has_ack & ~known, received)
        overdue = has_event & ~has_ack & ~told & (stuck_at <= now)
        change("stuck", overdue, stuck_at)
        told = told | late | overdue

        # copies that come a little later are still known, an ack may wait for its event
        until = np.where(has_ack, np.maximum(np.where(has_event, received, acked), acked) + keep, NONE)
        stay = until > now
        if stay.any():
            state.update((_packed(HELD, {"topic": names[topic[stay]], "shard_id": shard[stay], "offset": offset[stay], "received": received[stay],
                                         "acked": acked[stay], "told": told[stay]}),))
            _wake(state, np.where(has_ack, until, np.where(told, NONE, stuck_at))[stay])
        elif state.exists:
            state.remove()
        yield from changes

    whole = F.col("topic").isNotNull() & F.col("shard_id").isNotNull() & F.col("offset").isNotNull() & F.col("ts").isNotNull()
    side = lambda df, acked: df.filter(whole).select(*POSITION, F.col("ts").alias("at"), F.lit(acked).alias("acked"))
    rows = side(events, False).unionByName(side(acks, True)).withWatermark("at", f"{keep} microseconds").select(
        "topic", "shard_id", F.col("offset").cast("bigint").alias("offset"), "at", "acked", F.unix_micros("at").alias("us"))
    bucket = F.pmod(F.xxhash64("topic", "shard_id", F.shiftright("offset", BLOCK_BITS)), F.lit(BUCKETS)).cast("int")
    out = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        take, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*POSITION, "change", F.timestamp_micros("us").alias("ts"))


def pending_now(changes: DataFrame) -> DataFrame:
    """The pending positions, from written changes."""
    step = F.when(F.col("change") == "pending", 1).when(F.col("change") == "settled", -1).otherwise(0)
    return changes.groupBy(*POSITION).agg(F.sum(step).alias("n")).filter("n > 0").drop("n")


OUTCOMES = "batch_id string, event_id string, outcome string, status_code int"
TIMED_OUT = 408  # fixed value
WAITS = pa.schema([("batch_id", pa.string()), ("event_id", pa.string()), ("known", pa.int64()), ("answered", pa.int64()), ("status", pa.int64()),
                   ("failed", pa.bool_()), ("done", pa.bool_())])
BROKEN = pa.schema([("batch_id", pa.string()), ("broken", pa.int64())])


def _first(which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that rows of `which` name, and the first row that names each."""
    rows = np.flatnonzero(which)
    places, first = np.unique(place[rows], return_index=True)
    return places, rows[first]


def correlate_stream(events: DataFrame, responses: DataFrame, timeout: str, delay: str = DELAY, batch: str = "batch_id") -> DataFrame:
    """(batch_id, event_id, outcome, status_code) as a waiter sees it; events and responses have `ts`.

    An event waits `timeout` from its time.  ``success`` or ``failure`` with the first answer in that time; ``failure`` without a status
    when the whole batch fails first (a response without event id, with an error); else ``timeout`` with status 408 when the watermark
    gets there, and later answers are dropped.  An answer to an event that is not known within `delay` is an ``orphan``.
    Other responses without event id are dropped, and so are rows without a batch or a time.  Rows of one micro-batch count in the
    order of time, those of one time in the order event, answers by `answer_no`, failed batch.  A batch's state is deleted `delay` after its last wait has ended.  Append mode.
    """
    keyed_state(events.sparkSession)
    limit, keep = duration_text_us(timeout), duration_text_us(delay)

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The batches of a bucket: their events are waiting, answered, failed with the batch, or timed out."""
        now = state.getCurrentWatermarkMs() * 1000
        waits, lost = (_unpacked(s, d) for s, d in zip((WAITS, BROKEN), state.get if state.exists else (None, None)))
        rows = None if state.hasTimedOut else pd.concat(list(parts), ignore_index=True)
        if rows is None:
            rows = pd.DataFrame({c: np.zeros(0, object if c.endswith("_id") else np.int64) for c in (
                "batch_id", "event_id", "us", "side", "status_code", "failed", "answer_no")})
        us, side, failed, status = (rows[c].to_numpy(t) for c, t in (("us", np.int64), ("side", np.int64), ("failed", bool), ("status_code", np.int64)))
        batch_ids, event_ids = rows["batch_id"].to_numpy(object), rows["event_id"].to_numpy(object)
        unnamed = np.array([not e for e in event_ids], bool)
        order = np.lexsort((rows["answer_no"].to_numpy(np.int64), unnamed, side, us))
        us, side, failed, status, unnamed, batch_ids, event_ids = (a[order] for a in (us, side, failed, status, unnamed, batch_ids, event_ids))

        # numbers of the batches, and of the events that rows or the state name: those held come first
        batches, names, pairs = {}, {}, {}
        old, named = len(waits["known"]), (side == 0) | ~unnamed
        wait_batch, lost_batch, row_batch = _codes(waits["batch_id"], batches), _codes(lost["batch_id"], batches), _codes(batch_ids, batches)
        pair = np.concatenate([wait_batch, row_batch[named]]) + len(batches) * np.concatenate([
            _codes(waits["event_id"], names), _codes(event_ids[named], names)])
        place, found = pd.factorize(pair)
        of_batch, of_name = found % len(batches), found // len(batches)
        batch_names, event_names = np.array(list(batches), object), np.array([*names, None], object)[:-1]
        row_place = np.full(len(us), -1)
        row_place[named] = place[old:]

        # the first time of each kind, and the row it came with: -1 if held, the number of rows if there is none
        n, more = len(us), len(found) - old
        known, answered, code, bad, done = (np.concatenate([waits[c], np.full(more, v)]) for c, v in (
            ("known", NONE), ("answered", NONE), ("status", NONE), ("failed", False), ("done", False)))
        broken = np.full(len(batches), NONE)
        broken[lost_batch] = lost["broken"]
        known_at, answered_at, broken_at = (np.where(t == NONE, n, -1) for t in (known, answered, broken))

        def set_first(which: np.ndarray, places: np.ndarray, at: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]) -> None:
            p, r = _first(which, places)
            p, r = p[at[p] == n], r[at[p] == n]
            for column, values in columns:
                column[p] = values[r]
            at[p] = r

        set_first(side == 0, row_place, known_at, (known, us))
        set_first((side == 1) & ~unnamed, row_place, answered_at, (answered, us), (code, status), (bad, failed))
        set_first((side == 1) & unnamed & failed, row_batch, broken_at, (broken, us))

        # an answer or a failed batch in time ends the wait, at the row that brings the two together
        ends = np.where(known == NONE, -NONE, known + np.where(known == NONE, 0, limit))
        lost_us, lost_at = broken[of_batch], broken_at[of_batch]
        has_answer, has_lost = answered < ends, lost_us < ends
        end_at = np.minimum(np.where(has_answer, np.maximum(known_at, answered_at), n), np.where(has_lost, np.maximum(known_at, lost_at), n))
        ended = ~done & (end_at < n)
        by_answer = has_answer & (answered_at <= end_at) & ~(has_lost & (lost_at <= end_at) & (lost_us < answered))
        done = done | ended

        outcomes = []

        def outcome(name: str, which: np.ndarray, codes: np.ndarray | int) -> None:
            if which.any():
                codes = codes[which] if isinstance(codes, np.ndarray) else np.full(which.sum(), codes)
                outcomes.append(pd.DataFrame({"batch_id": batch_names[of_batch[which]], "event_id": event_names[of_name[which]], "outcome": name,
                                              "status_code": np.where(codes == NONE, None, codes)}))

        outcome("success", ended & by_answer & ~bad, code)
        outcome("failure", ended & by_answer & bad, code)
        outcome("failure", ended & ~by_answer, NONE)

        # what the watermark has reached: waits time out, answers nobody waited for and ended waits are forgotten
        def due() -> np.ndarray:
            return np.where(known == NONE, answered + np.where(known == NONE, keep, 0), known + np.where(known == NONE, 0, limit + keep * done))

        outcome("orphan", (known == NONE) & (due() <= now), code)
        overdue = (known != NONE) & ~done & (due() <= now)
        outcome("timeout", overdue, TIMED_OUT)
        done = done | overdue
        until = due()
        stay = until > now
        in_use = np.zeros(len(batches), bool)
        in_use[of_batch[stay]] = True
        lost_until = np.where(broken == NONE, NONE, broken + np.where(broken == NONE, 0, limit + keep))
        lost_stay = (broken != NONE) & (in_use | (lost_until > now))
        if stay.any() or lost_stay.any():
            state.update((_packed(WAITS, {
                "batch_id": batch_names[of_batch[stay]], "event_id": event_names[of_name[stay]], "known": known[stay], "answered": answered[stay],
                "status": code[stay], "failed": bad[stay], "done": done[stay]}),
                _packed(BROKEN, {"batch_id": batch_names[lost_stay], "broken": broken[lost_stay]})))
            _wake(state, np.concatenate([until[stay], lost_until[lost_stay & ~in_use]]))
        elif state.exists:
            state.remove()
        yield from outcomes

    known = events.select(F.col(batch).alias("batch_id"), "event_id", "ts", F.lit(0).alias("side"), F.lit(None).cast("int").alias("status_code"),
                          F.lit(False).alias("failed"), F.lit(0).alias("answer_no"))
    said = responses.select(F.col(batch).alias("batch_id"), "event_id", "ts", F.lit(1).alias("side"), F.col("status_code").cast("int").alias("status_code"),
                            F.col("error").isNotNull().alias("failed"), F.col("answer_no").cast("int").alias("answer_no"))
    rows = known.unionByName(said).filter("batch_id is not null and ts is not null").withWatermark("ts", f"{keep} microseconds").withColumns({
        "us": F.unix_micros("ts"), "bucket": F.pmod(F.xxhash64("batch_id"), F.lit(BUCKETS)).cast("int"),
        "status_code": F.coalesce(F.col("status_code").cast("bigint"), F.lit(NONE)), "answer_no": F.coalesce("answer_no", F.lit(0))})
    return rows.groupBy("bucket").applyInPandasWithState(take, OUTCOMES, "waits binary, broken binary", "append", GroupStateTimeout.EventTimeTimeout)
