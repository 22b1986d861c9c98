"""Log reports of lines made up here; what is wanted follows from the rules, written out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventflow.functions import logtext as L
from eventflow.operators import logs as O


def record(clock, level, message, name=None, **more):
    return json.dumps({"level": level, "time": f"2031-07-09T{clock}Z", "message": message, **({"name": name} if name else {}), **more})


KNOWN, IGNORED = L.KNOWN_FAILURES[0], L.IGNORED_SUBSTRINGS[0]

CASES = {
    # errors of the first worker, or of none, are brief; those of other workers are not
    "workers": (
        [record("04:05:06.007", "error", "Basket is empty", "processor.cron.w0.shop"), record("04:05:06.008", "warning", "Basket is torn", "processor.cron.w3.shop"),
         record("04:05:07.100", "warn", "Price is odd", **{"with": {"worker_id": "0", "item": "pear"}}),
         record("04:05:07.200", "error", "Price is gone", **{"with": {"worker_id": "12"}}), record("04:05:08.000", "info", "Shop opens")],
        ["[04:05:06.007] (E) Basket is empty", "[04:05:06.008] (W) Basket is torn", '[04:05:07.100] (W) Price is odd [item="pear" || worker_id="0"]',
         '[04:05:07.200] (E) Price is gone [worker_id="12"]', "[04:05:08.000] (I) Shop opens"],
        ["Basket is empty", 'Price is odd [item="pear" || worker_id="0"]']),
    # raw lines are brief up to a panic
    "panic": (
        ["till drawer stuck", record("21:00:00.500", "error", "Till fails", code="T7"), "panic: Wrapper lost its till", "frame one", "  frame two"],
        ["till drawer stuck", '[21:00:00.500] (E) Till fails [code="T7"]', "panic: Wrapper lost its till", "frame one", "  frame two"],
        ["till drawer stuck", 'Till fails [code="T7"]']),
    # or up to a call stack
    "stack": (
        [record("09:10:11.120", "debug", "Looking for scales", more="tries=4"), "Error - no scales on port 9", " at scales.c line 3", "Call stack:", "weigh()", ""],
        ["[09:10:11.120] (D) Looking for scales [tries=4]", "Error - no scales on port 9", " at scales.c line 3", "Call stack:", "weigh()", ""],
        ["Error - no scales on port 9", " at scales.c line 3"]),
    # texts that are left out of the brief part, and texts that are in it on any level
    "texts": (
        [record("13:14:15.160", "error", f"{IGNORED} of the scales", reason=None, state="cold"), record("13:14:15.170", "debug", f"scales: {KNOWN}"),
         record("13:14:15.180", "debug", "scales: warm")],
        [f'[13:14:15.160] (E) {IGNORED} of the scales [state="cold"]', f"[13:14:15.170] (D) scales: {KNOWN}", "[13:14:15.180] (D) scales: warm"],
        [f"scales: {KNOWN}"]),
    # equal lines that follow each other in the brief part are one, though others lie between them in the log
    "repeats": (
        [record("23:59:59.001", "debug", m, "processor.queue.q.client") for m in (f"till 1: {KNOWN}", "asking till 2", f"till 1: {KNOWN}", "asking till 3", f"till 1: {KNOWN}")]
        + [record("23:59:59.900", "error", "No till answers", tried="3"), "given up", "given up"],
        [f"[23:59:59.001] (D) {m}" for m in (f"till 1: {KNOWN}", "asking till 2", f"till 1: {KNOWN}", "asking till 3", f"till 1: {KNOWN}")]
        + ['[23:59:59.900] (E) No till answers [tried="3"]', "given up", "given up"],
        [f"[repeated 3 times] till 1: {KNOWN}", 'No till answers [tried="3"]', "[repeated 2 times] given up"]),
}


@pytest.mark.parametrize("chunk_rows", [3, 100_000])
def test_reports(spark, chunk_rows):
    rows = [(name, i, line) for name, (lines, _, _) in CASES.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "stream string, seq long, line string").repartition(5)
    got = {}
    for r in sorted(O.log_report(df, chunk_rows=chunk_rows).collect(), key=lambda r: r.seq):
        got.setdefault((r.stream, r.part), []).append(r.text)
    for name, (_, formatted, brief) in CASES.items():
        assert got[(name, "formatted")] == formatted
        assert got[(name, "brief")] == brief


@pytest.mark.parametrize("line,want", [
    ('l{"time": 1582805404805.9, "level": "info", "message": "m"}', "[12:10:04.805] (I) m"),
    ('{"time": "2020-02-27T14:10:04+0200", "level": "warning", "message": "m"},', "[14:10:04.000] (W) m"),
    ('{"time": "2020-02-27T14:10:04.123456+02:00", "level": "warning", "message": "m", "more": {"b": "2", "a": "1"}}',
     "[14:10:04.123] (W) m [a=1 || b=2]"),
    ('{"time": "2020-02-27T14:10:04Z", "level": "error", "message": "m", "more": "x", "err": "e", "n": 5, "z": "q"}',
     '[14:10:04.000] (E) m [x || err="e" || z="q"]'),
    ('{"time": "2020-02-27T14:10:04Z", "level": "error", "message": "m", "with": {}}', "[14:10:04.000] (E) m []"),
    ('{"time": "2020-02-27T14:10:04Z", "level": "error", "message": "m", "with": {"a": "1"}, "more": "lost"}',
     '[14:10:04.000] (E) m [a="1"]'),
    ('{"time": "2020-02-27T14:10:04Z", "level": "error", "message": "m", "more": ""}', "[14:10:04.000] (E) m")])
def test_formatted_lines(spark, line, want):
    row = O.parse_logs(spark.createDataFrame([(line,)], "line string")).first()
    assert not row.raw and row.formatted == want


@pytest.mark.parametrize("line", [
    "plain", "", "l", "[1, 2]", '"text"', '{"level":"error","message":"no time"}', '{"time":"2020-02-27T14:10:04Z","message":"no level"}',
    '{"time":"2020-02-27T14:10:04Z","level":"error"}', '{"time":"yesterday","level":"error","message":"m"}',
    '{"time":"2020-02-27T14:10:04Z","level":"error","message":"m","with":{"n":1}}',
    '{"time":"2020-02-27T14:10:04Z","level":"error","message":"m","with":"text"}',
    '{"time":"2020-02-27T14:10:04Z","level":3,"message":"m"}', '{"time":"2020-02-27T14:10:04Z","level":"error","message":"m"'])
def test_raw_lines(spark, line):
    row = O.parse_logs(spark.createDataFrame([(line,)], "line string")).first()
    assert row.raw and row.formatted == line and row.level is None


def test_worker_from_name(spark):
    names = [("processor.http.w5.python.logger", "5"), ("processor.http", ""), ("processor.kafka.group.w7.x", "roup"),
             ("other.http.w5.x", ""), (None, "")]
    df = spark.createDataFrame(names, "n string, want string")
    got = df.select("*", L.worker_id(F.lit(None).cast("string"), F.col("n")).alias("w")).collect()
    assert all(r.w == r.want for r in got)
    assert df.select(L.worker_id(F.lit("9"), F.col("n")).alias("w")).first().w == "9"


@pytest.mark.parametrize("chunk_rows", [5, 100_000])
def test_repeats_of_a_long_run(spark, chunk_rows):
    """One value repeated over many chunks is one run."""
    df = spark.range(300).select(F.lit("s").alias("k"), F.col("id").alias("seq"), F.when(
        F.col("id") < 10, F.col("id").cast("string")).when(F.col("id") < 290, "same").otherwise(None).alias("v"))
    rows = sorted(O.collapse_repeats(df, ["k"], "seq", "v", chunk_rows).collect(), key=lambda r: r.seq)
    assert [r.repeats for r in rows] == [1] * 10 + [280, 10]
    assert rows[10].collapsed == "[repeated 280 times] same" and rows[3].collapsed == "3"


def test_levels(spark):
    df = spark.createDataFrame([(x,) for x in ("Debug", "Info", "Warn", "Error")], "level string")
    assert [r.level for r in O.filter_level(df, "debug").collect()] == ["Debug", "Info", "Warn", "Error"]
    assert [r.level for r in O.filter_level(df, "warn").collect()] == ["Warn", "Error"]
    pairs = [("critical", "error"), ("FATAL", "error"), ("warning", "warn"), ("info", "info"), ("trace", "debug")]
    got = spark.createDataFrame(pairs, "l string, want string").select("want", L.normalize_level(F.col("l")).alias("n")).collect()
    assert all(r.n == r.want for r in got)


def test_event_logs_limit(spark):
    # 2 brackets + text: 4095 bytes stay, 4096 go
    df = spark.createDataFrame([("a", 2, "2"), ("a", 1, "1"), ("b", 1, "x" * 4093), ("c", 1, "x" * 4094)],
                               "event_id string, seq int, entry string")
    got = {r.event_id: r.logs for r in O.event_logs(df).collect()}
    assert got["a"] == "[1,2]" and len(got["b"]) == 4095 and "c" not in got


def test_hot_event_is_left_out_early(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("event_id"),
                                    F.col("id").alias("seq"), F.lit("abc").alias("entry"))
    out = O.event_logs(df)
    assert out.count() == 20_000 and out.filter("event_id = -1").count() == 0
