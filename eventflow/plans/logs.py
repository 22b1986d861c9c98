"""Log analytics over lines derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.functions import logtext as L
from eventflow.operators import logs as O
from eventflow.plans import chunked, query
from eventflow.plans.tables import events, spread, table


def log_lines(spark, sf_dir):
    """One line per event: records of several layouts, raw lines, and now and then a panic."""
    n = F.col("event_id") % 10
    worker = (F.col("event_id") % 3).cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def line(template, *parts):
        return F.format_string(template, *parts)

    text = (F.when(F.col("event_id") % 997 == 500, F.lit("panic: Wrapper process exited"))
            .when(n == 0, line('{"level":"error","time":"%s","name":"processor.http.w%s.python.logger","message":"Failed %s"}',
                               iso, worker, F.col("topic")))
            .when(n == 1, line('l{"datetime": "%s", "level": "warning", "message": "slow", "with": {"worker_id": "%s", "a": "%s"}}',
                               F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), worker, F.col("topic")))
            .when(n == 2, F.concat(F.lit("Error - raw "), "topic"))
            .when(n == 3, line('{"level":"debug","time":%s,"name":"p","message":"tick","more":"num=%s"},',
                               F.unix_millis("ts").cast("string"), F.col("event_id").cast("string")))
            .when(n == 4, line('{"level":"info","time":"%s","message":"Failed to connect to broker","err":"%s","n":1}',
                               iso, F.col("topic")))
            .when(n == 5, line('{"level":"error","time":"%s","message":"bad","with":{"n":1}}', iso))
            .when(n == 6, F.lit('{"level":"error","message":"no time"}'))
            .when(n == 7, line('{"level":"error","time":"%s","message":"Unexpected termination of child process","status":"x"}', iso))
            .when(n == 8, line('{"level":"warn","time":"%s+0200","message":"offset","more":{"b":"2","a":"1"}}',
                               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")))
            .otherwise(line('{"level":"error","time":"%s","message":"same"}', iso)))
    # parsing is the costly part, so a small input is spread before it
    return spread(events(spark, sf_dir)).select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"),
                                                text.alias("line"))


# what the lines above must parse to
PARSED = """src AS (SELECT user_id AS stream, event_id AS seq, event_type AS topic, ts, CAST(event_id % 3 AS VARCHAR) AS w,
  CASE WHEN event_id % 997 = 500 THEN 10 ELSE event_id % 10 END AS n, strftime(ts, '%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS clock,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events),
parsed AS (SELECT *, n IN (2, 5, 6, 10) AS raw,
  list_value('error', 'warning', NULL, 'debug', 'info', NULL, NULL, 'error', 'warn', 'error', NULL)[n + 1] AS level,
  CASE n WHEN 0 THEN 'Failed ' || topic WHEN 1 THEN 'slow' WHEN 3 THEN 'tick' WHEN 4 THEN 'Failed to connect to broker'
    WHEN 7 THEN 'Unexpected termination of child process' WHEN 8 THEN 'offset' WHEN 9 THEN 'same' END AS message,
  CASE WHEN n IN (0, 1) THEN w WHEN n IN (2, 5, 6, 10) THEN NULL ELSE '' END AS worker,
  CASE n WHEN 0 THEN 'Failed ' || topic WHEN 1 THEN 'slow [a="' || topic || '" || worker_id="' || w || '"]'
    WHEN 3 THEN 'tick [num=' || seq || ']' WHEN 4 THEN 'Failed to connect to broker [err="' || topic || '"]'
    WHEN 7 THEN 'Unexpected termination of child process [status="x"]' WHEN 8 THEN 'offset [a=1 || b=2]'
    WHEN 9 THEN 'same' END AS text,
  CASE n WHEN 2 THEN 'Error - raw ' || topic WHEN 5 THEN '{"level":"error","time":"' || iso || '","message":"bad","with":{"n":1}}'
    WHEN 6 THEN '{"level":"error","message":"no time"}' WHEN 10 THEN 'panic: Wrapper process exited' END AS raw_line,
  CASE WHEN n IN (0, 1) THEN w = '0' WHEN n IN (4, 8, 9) THEN true WHEN n IN (3, 7) THEN false END AS brief FROM src),
lined AS (SELECT *, CASE WHEN raw THEN raw_line ELSE '[' || clock || '] (' || upper(level[1]) || ') ' || text END AS formatted FROM parsed)"""


@query("l1_parse_logs", f"""WITH {PARSED} SELECT stream, seq, raw, level, message FROM lined""")
def _l1(spark, sf_dir):
    return O.parse_logs(log_lines(spark, sf_dir)).select("stream", "seq", "raw", "level", "message")


@query("l2_log_time", """
SELECT event_id, epoch_us(ts) // 1000 * 1000 AS millis, epoch_us(ts) // 1000 * 1000 AS layout, epoch_us(date_trunc('second', ts)) AS zulu,
  epoch_us(date_trunc('second', ts)) - 7200000000 AS shifted, CAST(NULL AS BIGINT) AS junk FROM events""")
def _l2(spark, sf_dir):
    def us(text):
        return F.unix_micros(L.log_time(text))

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return events(spark, sf_dir).select(
        "event_id", us(F.unix_millis("ts").cast("string")).alias("millis"),
        us(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")).alias("layout"), us(F.concat(iso, F.lit("Z"))).alias("zulu"),
        us(F.concat(iso, F.lit("+0200"))).alias("shifted"), us(F.col("topic")).alias("junk"))


@query("l3_worker_id", f"""WITH {PARSED} SELECT stream, seq, worker FROM lined""")
def _l3(spark, sf_dir):
    return O.parse_logs(log_lines(spark, sf_dir)).select("stream", "seq", "worker")


@query("l4_message_and_args", f"""WITH {PARSED} SELECT stream, seq, text FROM lined""")
def _l4(spark, sf_dir):
    return O.parse_logs(log_lines(spark, sf_dir)).select("stream", "seq", "text")


@query("l5_format_line", f"""WITH {PARSED} SELECT stream, seq, formatted FROM lined""")
def _l5(spark, sf_dir):
    return O.parse_logs(log_lines(spark, sf_dir)).select("stream", "seq", "formatted")


@query("l6_is_brief", f"""WITH {PARSED} SELECT stream, seq, brief FROM lined""")
def _l6(spark, sf_dir):
    return O.parse_logs(log_lines(spark, sf_dir)).select("stream", "seq", "brief")


@query("l7_suppress_after_panic", f"""WITH {PARSED}
SELECT stream, seq, raw AND coalesce(max(CASE WHEN n = 10 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq), 0) = 0 AS brief_raw
FROM lined""")
def _l7(spark, sf_dir):
    return O.suppress_after_panic(O.parse_logs(log_lines(spark, sf_dir))).select("stream", "seq", "brief_raw")


@query("l8_collapse_repeats", """
WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS begins FROM events),
r AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, min(event_id) AS event_id, count(*) AS repeats, any_value(event_type) AS event_type,
  CASE WHEN count(*) > 1 THEN '[repeated ' || count(*) || ' times] ' ELSE '' END || any_value(event_type) AS collapsed
FROM r GROUP BY user_id, run""")
def _l8(spark, sf_dir, **chunks):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return O.collapse_repeats(rows, ["user_id"], "event_id", "event_type", **chunks)


chunked("l8_collapse_repeats", _l8)


@query("l9_log_report", f"""WITH {PARSED}, stopped AS (
  SELECT *, max(CASE WHEN n = 10 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) = 1 AS stop FROM lined),
short AS (SELECT stream, seq, coalesce(text, raw_line) AS line FROM stopped WHERE coalesce(brief, false) OR raw AND NOT stop),
f AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY stream ORDER BY seq) THEN 0 ELSE 1 END AS begins FROM short),
r AS (SELECT *, sum(begins) OVER (PARTITION BY stream ORDER BY seq) AS run FROM f)
SELECT stream, 'formatted' AS part, seq, formatted AS text FROM lined
UNION ALL SELECT stream, 'brief', min(seq), CASE WHEN count(*) > 1 THEN '[repeated ' || count(*) || ' times] ' ELSE '' END || any_value(line)
FROM r GROUP BY stream, run""")
def _l9(spark, sf_dir, **chunks):
    return O.log_report(log_lines(spark, sf_dir), **chunks)


chunked("l9_log_report", _l9)


LEVELS = ("error", "critical", "fatal", "warning", "info", "debug", "trace")


@query("l10_levels", """WITH e AS (SELECT event_id,
  list_value('error', 'critical', 'fatal', 'warning', 'info', 'debug', 'trace')[1 + event_id % 7] AS level FROM events)
SELECT event_id, level, CASE WHEN level = 'warning' THEN 'warn' ELSE 'error' END AS normal FROM e
WHERE level IN ('error', 'critical', 'fatal', 'warning')""")
def _l10(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.get(
        F.array(*[F.lit(x) for x in LEVELS]), (F.col("event_id") % 7).cast("int")).alias("level"))
    return O.filter_level(rows, "warn").withColumn("normal", L.normalize_level(F.col("level")))


@query("l11_event_logs", """WITH e AS (SELECT event_id // 40 AS event_id, event_id AS seq,
  '{"m":"' || event_type || repeat('x', CAST(event_id % 40 * ((event_id // 40) % 10) AS INTEGER)) || '"}' AS entry FROM events),
a AS (SELECT event_id, '[' || string_agg(entry, ',' ORDER BY seq) || ']' AS logs FROM e GROUP BY event_id)
SELECT event_id, logs FROM a WHERE strlen(logs) < 4096""")
def _l11(spark, sf_dir):
    group = F.floor(F.col("event_id") / 40).cast("bigint")
    rows = events(spark, sf_dir).select(group.alias("event_id"), F.col("event_id").alias("seq"), F.concat(
        F.lit('{"m":"'), "topic", F.repeat(F.lit("x"), (F.col("event_id") % 40 * (group % 10)).cast("int")),
        F.lit('"}')).alias("entry"))
    return O.event_logs(rows)
