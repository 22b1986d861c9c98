"""Streams with state that goes away, over several micro-batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventflow.operators import delivery as D
from eventflow.sources import sinks, streams
from eventflow.streaming import lifecycle

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "topic string, shard_id int, offset bigint, ts timestamp, acked boolean"
WAITS = "batch_id string, event_id string, ts timestamp, status_code int, error string, answer_no int, side int"


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, folder, parts, schema, make):
    """The parts as files that come one by one; (rows that came out, state rows after each micro-batch)."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def stream():
        return streams.open_stream(spark, {"kind": "landing", "attributes": {"path": f"{folder}/in", "maxFilesPerTrigger": 1}}, schema)

    out = make(stream)
    query = sinks.run_once(sinks.write_batches(out, f"{folder}/out", f"{folder}/state"))
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(out.schema).parquet(f"{folder}/out/batch=*"), state


def changes(stream, **options):
    return lifecycle.event_changes(stream().filter("not acked"), stream().filter("acked"), **options)


def test_state_stays_flat(spark, folder):
    """Twenty micro-batches of events that are acked soon: the state holds the last ones only, the pending ones are the batch form's."""
    parts = []
    for b in range(20):
        events = [("t", i % 2, b * 50 + i, at(b * 60 + i), False) for i in range(50)]
        acks = [("t", i % 2, b * 50 + i, at(b * 60 + i + 1), True) for i in range(50) if i % 25 != 7]
        parts.append(events + acks)
    got, state = run(spark, folder, parts, EVENTS, lambda s: changes(s, delay="30s"))
    table = spark.createDataFrame([r for p in parts for r in p], EVENTS)
    want = D.pending(table.filter("not acked"), table.filter("acked"))
    left = sorted(r.offset for r in lifecycle.pending_now(got).collect())
    assert left == sorted(r.offset for r in want.collect()) and len(left) == 40
    # without deletion it would hold 1,000 positions; 40 stay pending, the rest is of the last batches
    assert len(state) >= 20 and max(state) < 500 and state[-1] <= 40 + 150


def test_early_acks_repeats_and_stuck_events(spark, folder):
    parts = [
        [("t", 0, 1, at(0), True), ("t", 0, 2, at(0), False), ("t", 0, 3, at(1), False), (None, 0, 9, at(1), False)],
        [("t", 0, 1, at(5), False), ("t", 0, 2, at(6), True), ("t", 0, 2, at(7), False), ("t", 0, 2, at(7), True)],
        [("t", 0, 4, at(500), False)], [("t", 0, 3, at(501), True)], [("t", 0, 5, at(2000), False)], [("t", 0, 6, at(2001), False)]]
    got, _ = run(spark, folder, parts, EVENTS, lambda s: changes(s, timeout="2m", delay="10s"))
    rows = sorted((r.offset, r.change, int(r.ts.timestamp() - START.timestamp())) for r in got.collect())
    assert rows == [(2, "pending", 0), (2, "settled", 6), (3, "pending", 1), (3, "settled", 501), (3, "stuck", 121), (4, "pending", 500),
                    (4, "stuck", 620), (5, "pending", 2000), (6, "pending", 2001)]
    assert sorted(r.offset for r in lifecycle.pending_now(got).collect()) == [4, 5, 6]


def answered(stream, **options):
    return lifecycle.correlate_stream(stream().filter("side = 0"), stream().filter("side = 1"), **options)


def event(batch, name, t):
    return (batch, name, at(t), None, None, None, 0)


def answer(batch, name, t, status=200, error=None, no=0):
    return (batch, name, at(t), status, error, no, 1)


def test_waiters(spark, folder):
    parts = [
        [answer("a", "early", 0), event("a", "plain", 1), event("a", "bad", 1), event("a", "slow", 1), event("a", "never", 1), answer("a", "", 2)],
        [event("a", "early", 3), answer("a", "plain", 4, 201, None, 1), answer("a", "plain", 4, 202, None, 0), answer("a", "bad", 5, 400, "no")],
        [answer("a", "plain", 6, 500, "later"), answer("a", "who", 6, 299), event("b", "x", 10), event("b", "y", 11), answer("b", "x", 12)],
        [answer("b", None, 13, 500, "whole batch"), event("b", "z", 20), answer("b", "y", 21)],
        [answer("a", "slow", 70)], [event("c", "end", 4000)], [event("c", "end2", 4001)]]
    got, state = run(spark, folder, parts, WAITS, lambda s: answered(s, timeout="1m", delay="10s"))
    assert {(r.batch_id, r.event_id): (r.outcome, r.status_code) for r in got.collect()} == {
        ("a", "early"): ("success", 200), ("a", "plain"): ("success", 202), ("a", "bad"): ("failure", 400), ("a", "slow"): ("timeout", 408),
        ("a", "never"): ("timeout", 408), ("a", "who"): ("orphan", 299), ("b", "x"): ("success", 200), ("b", "y"): ("failure", None),
        ("b", "z"): ("failure", None)}
    assert got.count() == 9 and state[-1] <= 8  # only what is left of the last batch, timers included


def test_waiting_state_stays_flat(spark, folder):
    parts = [[event(f"b{b}", str(i), b * 100 + i) for i in range(20)] + [answer(f"b{b}", str(i), b * 100 + i + 1) for i in range(20) if i % 5] for b in range(20)]
    got, state = run(spark, folder, parts, WAITS, lambda s: answered(s, timeout="1m", delay="30s"))
    assert max(state) < 200 and got.filter("outcome = 'success'").count() == 20 * 16
    assert got.filter("outcome = 'timeout'").count() >= 17 * 4


@pytest.mark.parametrize("limit", [None, "1m"])
def test_one_batch_is_the_batch_form(spark, folder, limit):
    rows = [("t", i % 3, i, at(i), False) for i in range(200)] + [("t", i % 3, i, at(i + 5), True) for i in range(200) if i % 4]
    got, _ = run(spark, folder, [rows], EVENTS, lambda s: changes(s, timeout=limit))
    assert got.filter("change = 'pending'").count() == 50 and lifecycle.pending_now(got).count() == 50


def test_sessions_with_another_state_store(spark, folder):
    """In a session made elsewhere the default store has no room for several states; the operators ask for one that has."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, before.replace("RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"))
    try:
        got, _ = run(spark, f"{folder}/a", [[("t", 0, 1, at(0), False), ("t", 0, 2, at(0), False), ("t", 0, 2, at(5), True)]], EVENTS, changes)
        assert [r.offset for r in lifecycle.pending_now(got).collect()] == [1]
        spark.conf.set(key, before.replace("RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"))
        got, _ = run(spark, f"{folder}/b", [[event("a", "x", 1), answer("a", "x", 2)]], WAITS, lambda s: answered(s, timeout="1m"))
        assert [tuple(r) for r in got.collect()] == [("a", "x", "success", 200)]
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("limit", [None, "1m"])
def test_positions_share_states(spark, folder, limit):
    """Thousands of open positions whose offsets lie far apart are held in a bounded number of states, each with one timer at most."""
    dice = random.Random(5)
    offsets = dice.sample(range(-2**61, 2**61), 4000)
    rows = [("t", i % 3, o, at(0), False) for i, o in enumerate(offsets)] + [("t", i % 3, o, at(9), True) for i, o in enumerate(offsets) if i % 4]
    got, state = run(spark, folder, [rows, [("u", 0, 1, at(4000), False)]], EVENTS, lambda s: changes(s, timeout=limit))
    assert max(state) <= lifecycle.BUCKETS
    found = {c: sorted(r.offset for r in got.collect() if r.change == c and r.topic == "t") for c in ("pending", "stuck", "settled")}
    open_ones = sorted(o for i, o in enumerate(offsets) if not i % 4)
    assert found == {"pending": open_ones, "stuck": open_ones if limit else [], "settled": []}


def life_by_row(parts, limit, keep):
    """The changes of `event_changes`, one position and row at a time; no row is late."""
    lives, out, mark, seen = {}, [], 0, 0

    def wake():
        for key, (received, acked, told) in list(lives.items()):
            if acked is not None:
                if max(received or acked, acked) + keep <= mark:
                    del lives[key]
            elif not told and received + limit <= mark:
                lives[key] = received, acked, True
                out.append((*key, "stuck", received + limit))

    for part in [*parts, []]:
        for key in {r[:3] for r in part}:
            received, acked, told = lives.get(key, (None, None, False))
            knew, met = received is not None, received is not None and acked is not None
            for t in [r[3] for r in part if r[:3] == key and not r[4]]:
                received = t if received is None else min(received, t)
            for t in [r[3] for r in part if r[:3] == key and r[4]]:
                acked = t if acked is None else min(acked, t)
            if received is not None and acked is not None and not met:
                if not told and acked >= received + limit:
                    told = True
                    out.append((*key, "stuck", received + limit))
                if knew:
                    out.append((*key, "settled", acked))
            elif received is not None and acked is None and not knew:
                out.append((*key, "pending", received))
            lives[key] = received, acked, told
        wake()
        seen = max([seen, *[r[3] for r in part]])
        mark = max(mark, seen - keep)
    return sorted(out)


def test_random_rows_are_as_one_by_one(spark, folder):
    """Repeated rows, acks before and long after their event, positions that come again when they are forgotten."""
    dice = random.Random(11)
    parts = [[(dice.choice("ab"), dice.randrange(2), dice.choice([-3, 1, 2, 5, 1024, 10**12]), b * 60 + dice.randrange(100), dice.random() < 0.4)
              for _ in range(12)] for b in range(8)]
    rows = [[(*r[:3], at(r[3]), r[4]) for r in part] for part in parts]
    got, _ = run(spark, folder, rows, EVENTS, lambda s: changes(s, timeout="70s", delay="200s"))
    found = [(r.topic, r.shard_id, r.offset, r.change, int(r.ts.timestamp() - START.timestamp())) for r in got.collect()]
    assert sorted(found) == life_by_row(parts, 70, 200)


def test_batches_share_states(spark, folder):
    """The events of thousands of batches are held in a bounded number of states."""
    parts = [[event(f"b{b}", str(i), b % 7) for b in range(3000) for i in range(2)] + [answer(f"b{b}", "0", 8, 200 + b % 3) for b in range(3000)]
             + [answer(f"b{b}", None, 9, 500, "bad batch") for b in range(0, 3000, 3)], [event("c", "end", 4000)], [event("c", "end2", 4001)]]
    got, state = run(spark, folder, parts, WAITS, lambda s: answered(s, timeout="1m", delay="10s"))
    assert max(state) <= lifecycle.BUCKETS and state[-1] == 1
    assert {(r.batch_id, r.event_id, r.outcome, r.status_code) for r in got.collect()} == {
        (f"b{b}", "0", "success", 200 + b % 3) for b in range(3000)} | {
        (f"b{b}", "1", *(("timeout", 408) if b % 3 else ("failure", None))) for b in range(3000)}


def outcomes_by_row(parts, limit, keep):
    """The outcomes of `correlate_stream`, one row at a time; no row is late."""
    waits, broken, out, mark, seen = {}, {}, [], 0, 0

    def look(key):
        known, said, status, failed, done = waits[key]
        first = [t for t in (said, broken.get(key[0])) if t is not None and known is not None and not done and t < known + limit]
        if first:
            waits[key][4] = True
            by_answer = said is not None and said == min(first)
            out.append((*key, "failure" if failed or not by_answer else "success", status if by_answer else None))

    for part in [*parts, []]:
        for b, name, t, status, error, no, side in sorted(part, key=lambda r: (r[2], r[6], not r[1], r[5] or 0)):
            if side == 0 or name:
                wait = waits.setdefault((b, name), [None, None, None, None, False])
                if side == 0 and wait[0] is None:
                    wait[0] = t
                elif side and wait[1] is None:
                    wait[1:4] = t, status, error is not None
                look((b, name))
            elif error is not None and b not in broken:
                broken[b] = t
                for key in waits:
                    if key[0] == b:
                        look(key)
        for key, (known, said, status, _, done) in list(waits.items()):
            if known is None and said + keep <= mark:
                out.append((*key, "orphan", status))
                del waits[key]
            elif known is not None and known + limit <= mark:
                if not done:
                    out.append((*key, "timeout", 408))
                    waits[key][4] = True
                if known + limit + keep <= mark:
                    del waits[key]
        for b, t in list(broken.items()):
            if t + limit + keep <= mark and not any(key[0] == b for key in waits):
                del broken[b]
        seen = max([seen, *[r[2] for r in part]])
        mark = max(mark, seen - keep)
    return sorted(out, key=str)


def test_random_answers_are_as_one_by_one(spark, folder):
    """Answers before and after their events, repeated, for no event, failed batches at any time, batches that come again."""
    dice = random.Random(3)
    parts = []
    for b in range(8):
        part = []
        for k in range(60):
            # no two rows of a batch at one time differ in their answer only
            row = (dice.choice("pqrstu"), dice.choice("abcdefghijkl"), b * 60 + dice.randrange(100))
            kind = dice.random()
            if kind < 0.5:
                part.append((*row, None, None, None, 0))
            elif kind < 0.97:
                part.append((*row, 200 + b * 60 + k if k % 9 else None, "bad" if k % 3 == 0 else None, k, 1))
            else:
                part.append((row[0], dice.choice([None, ""]), row[2], 500, "bad batch" if k % 4 else None, k, 1))
        parts.append(part)
    rows = [[(r[0], r[1], at(r[2]), *r[3:]) for r in part] for part in parts]
    got, _ = run(spark, folder, rows, WAITS, lambda s: answered(s, timeout="30s", delay="150s"))
    want = outcomes_by_row(parts, 30, 150)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {o[2] for o in want} == {"success", "failure", "timeout", "orphan"}
