"""Schedules: cron expressions and fixed intervals as ticks, and missed ticks.

All times are UTC.  A cron day is a set of seconds; its days follow from month, day of month and
day of week.  So the ticks before a point in time are a count per day plus a count within the day,
and neither needs the ticks themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventflow.functions.durations import duration_text_us

# fixed values: schedule names and field names
DESCRIPTORS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
               "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()

DAY_SECONDS = 86_400
TICK_BLOCK = 100_000


@dataclass(frozen=True)
class Cron:
    """Field sets of a cron expression; a starred day field does not restrict."""

    seconds: tuple[int, ...]
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]
    any_day: bool
    any_weekday: bool

    @property
    def per_day(self) -> int:
        return len(self.seconds) * len(self.minutes) * len(self.hours)

    def runs_on(self, day: Column) -> Column:
        """Whether a date is in the schedule.  Two restricted day fields are alternatives."""
        in_days = F.dayofmonth(day).isin(list(self.days))
        in_week = (F.dayofweek(day) - 1).isin(list(self.weekdays))
        days = in_days & in_week if self.any_day or self.any_weekday else in_days | in_week
        return F.month(day).isin(list(self.months)) & days


@dataclass(frozen=True)
class Interval:
    """A fixed delay."""

    micros: int


def _field(text: str, low: int, high: int, names: list[str] | None = None, base: int = 0) -> tuple[tuple[int, ...], bool]:
    def number(word: str) -> int:
        if names and word.lower() in names:
            return names.index(word.lower()) + base
        value = int(word)
        if not low <= value <= high:
            raise ValueError(f"value out of range in cron field: {text}")
        return value

    found: set[int] = set()
    star = False
    for part in text.split(","):
        span, slash, step_text = part.partition("/")
        step = int(step_text) if slash else 1
        if step <= 0:
            raise ValueError(f"bad step in cron field: {text}")
        if span in ("*", "?"):
            first, last = low, high
            star = star or not slash or step == 1
        elif "-" in span:
            first, last = (number(w) for w in span.split("-", 1))
        else:
            first = number(span)
            last = high if slash else first
        if first > last:
            raise ValueError(f"bad range in cron field: {text}")
        found.update(range(first, last + 1, step))
    return tuple(sorted(found)), star


def parse_schedule(spec: str) -> Cron | Interval:
    """A cron expression (5 fields, or 6 with seconds first, or ``@`` names) or a duration.

    A lone ``*`` for the seconds of six fields means second 0.
    """
    spec = spec.strip()
    if spec.startswith("@every "):
        return Interval(duration_text_us(spec[len("@every "):].strip()))
    spec = DESCRIPTORS.get(spec, spec)
    fields = spec.split()
    if len(fields) == 1:
        return Interval(duration_text_us(spec))
    if len(fields) == 6 and fields[0] == "*":
        fields[0] = "0"
    if len(fields) == 5:
        fields = ["0", *fields]
    if len(fields) != 6:
        raise ValueError(f"bad schedule: {spec!r}")
    days, any_day = _field(fields[3], 1, 31)
    weekdays, any_weekday = _field(fields[5], 0, 7, WEEKDAYS)
    return Cron(_field(fields[0], 0, 59)[0], _field(fields[1], 0, 59)[0], _field(fields[2], 0, 23)[0], days,
                _field(fields[4], 1, 12, MONTHS, 1)[0], tuple(sorted({d % 7 for d in weekdays})), any_day, any_weekday)


def ticks_between(df: DataFrame, spec: str, start: str, end: str, name: str = "tick") -> DataFrame:
    """One row per row of `df` and tick in (`start`, `end`], added as `name`.

    Intervals count from `start`.  Cron ticks are made day by day, only for days in the schedule.
    """
    schedule = parse_schedule(spec)
    start_us, end_us = F.unix_micros(start), F.unix_micros(end)
    if isinstance(schedule, Interval):
        # block by block, so that no row makes one long array
        count = F.floor((end_us - start_us) / schedule.micros).cast("bigint")
        blocks = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / TICK_BLOCK).cast("bigint")))
        rows = df.withColumns({"__count": count, "__block": F.explode(blocks)})
        first = F.col("__block") * TICK_BLOCK
        rows = rows.withColumn("__n", F.explode(F.sequence(first + 1, F.least(first + TICK_BLOCK, F.col("__count")))))
        return rows.withColumn(name, F.timestamp_micros(start_us + F.col("__n") * schedule.micros)).drop(
            "__count", "__block", "__n")
    first, last = F.to_date(start), F.to_date(end)
    rows = df.withColumn("__day", F.explode(F.when(first <= last, F.sequence(first, last))))
    rows = rows.filter(schedule.runs_on(F.col("__day")))
    for column, values, scale in (("__h", schedule.hours, 3600), ("__m", schedule.minutes, 60), ("__s", schedule.seconds, 1)):
        rows = rows.withColumn(column, F.explode(F.array(*[F.lit(v * scale) for v in values])))
    at = F.unix_date("__day").cast("bigint") * DAY_SECONDS + F.col("__h") + F.col("__m") + F.col("__s")
    rows = rows.withColumn(name, F.timestamp_seconds(at)).drop("__day", "__h", "__m", "__s")
    return rows.filter((F.col(name) > F.col(start)) & (F.col(name) <= F.col(end)))


def ticks(spark: SparkSession, spec: str, start: datetime, end: datetime) -> DataFrame:
    """Ticks of a schedule in (`start`, `end`]: column `tick`.

    The range is cut by day over the partitions for cron, by number for an interval.
    """
    schedule = parse_schedule(spec)
    if isinstance(schedule, Interval):
        micros = round((end - start).total_seconds() * 1e6)
        at = F.unix_micros(F.lit(start)) + (F.col("id") + 1) * schedule.micros
        return spark.range(max(0, micros // schedule.micros)).select(F.timestamp_micros(at).alias("tick"))
    days = spark.range((end.date() - start.date()).days + 1).select(
        F.date_add(F.lit(start.date()), F.col("id").cast("int")).alias("day"))
    bounds = days.select(F.greatest(F.timestamp_seconds(F.unix_date("day").cast("bigint") * DAY_SECONDS)
                                    - F.expr("INTERVAL 1 SECOND"), F.lit(start)).alias("start"),
                         F.least(F.timestamp_seconds((F.unix_date("day").cast("bigint") + 1) * DAY_SECONDS)
                                 - F.expr("INTERVAL 1 SECOND"), F.lit(end)).alias("end"))
    return ticks_between(bounds, spec, "start", "end").select("tick")


def _rank_in_day(schedule: Cron, second: Column) -> Column:
    """How many ticks of a day are at or before `second` of the day."""
    def below(values: tuple[int, ...], value: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v < value))

    hour, minute, sec = F.floor(second / 3600), F.floor(second / 60) % 60, second % 60
    n_min, n_sec = len(schedule.minutes), len(schedule.seconds)
    in_hour = F.when(hour.isin(list(schedule.hours)), F.lit(1)).otherwise(0)
    in_minute = F.when(minute.isin(list(schedule.minutes)), F.lit(1)).otherwise(0)
    return (below(schedule.hours, hour) * n_min * n_sec
            + in_hour * (below(schedule.minutes, minute) * n_sec + in_minute * below(schedule.seconds, sec + 1)))


def _second_at(schedule: Cron, rank: Column) -> Column:
    """Second of the day of the tick with 0-based `rank`."""
    def pick(values: tuple[int, ...], index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))

    n_min, n_sec = len(schedule.minutes), len(schedule.seconds)
    return (pick(schedule.hours, F.floor(rank / (n_min * n_sec))) * 3600
            + pick(schedule.minutes, F.floor(rank / n_sec) % n_min) * 60 + pick(schedule.seconds, rank % n_sec))


def missed_ticks(runs: DataFrame, spec: str, now: datetime, last_run: str = "last_run",
                 due: bool = False) -> DataFrame:
    """Add `missed`, `delay_us` and `next_run` to each last run.

    The first tick after the last run is due; each further tick before `now` makes one missed.
    With a miss the event fires at once (delay 0, all misses in one run); otherwise the delay is
    the time to the due tick, which is negative if that one has just passed.  With `due` the
    column holds the time the event was due instead, and every tick after it counts.
    """
    schedule = parse_schedule(spec)
    now_col = F.lit(now).cast("timestamp")
    if isinstance(schedule, Interval):
        elapsed = F.unix_micros(now_col) - F.unix_micros(last_run)
        out = runs.withColumns({
            "__passed": F.ceil(elapsed / F.lit(schedule.micros)).cast("bigint") - 1,
            "next_run": F.timestamp_micros(F.unix_micros(last_run) + schedule.micros)})
    else:
        out = _passed_cron(runs, schedule, now, last_run)
    if due:
        out = out.withColumn("next_run", F.col(last_run))
    missed = F.greatest(F.col("__passed") - (0 if due else 1), F.lit(0)).cast("bigint")
    wait = F.unix_micros("next_run") - F.unix_micros(now_col)
    return (out.withColumn("missed", missed).drop("__passed")
            .withColumn("delay_us", F.when(F.col("missed") > 0, F.lit(0)).otherwise(wait).cast("bigint")))


def _passed_cron(runs: DataFrame, schedule: Cron, now: datetime, last_run: str) -> DataFrame:
    """Add `__passed`, the ticks after the last run and before `now`, and `next_run`."""
    earliest = runs.agg(F.min(F.to_date(last_run))).first()[0] or now.date()
    # one row per day from the oldest run to five years past now: thousands of rows, whatever the runs hold
    calendar = _calendar(runs.sparkSession, schedule, min(earliest, now.date()), now.date() + timedelta(days=366 * 5))
    base = runs.withColumns({"__day": F.to_date(last_run), "__second": F.unix_seconds(last_run) % DAY_SECONDS})
    joined = base.join(F.broadcast(calendar), F.col("__day") == F.col("day"), "left")
    rank = F.col("before") + F.when(F.col("on"), _rank_in_day(schedule, F.col("__second"))).otherwise(0)
    today = calendar.filter(F.col("day") == F.lit(now.date())).first()
    at = now.hour * 3600 + now.minute * 60 + now.second
    until = at if now.microsecond else at - 1  # a tick at now itself has not passed
    in_day = sum(1 for h in schedule.hours for m in schedule.minutes for s in schedule.seconds
                 if h * 3600 + m * 60 + s <= until) if today["on"] else 0
    counted = joined.withColumn("__rank", rank).drop("day", "on", "before")
    tick_days = F.broadcast(calendar.filter("on").select(
        F.col("day").alias("__next_day"), F.col("before").alias("__next_before")))
    target = F.floor(F.col("__rank") / schedule.per_day) * schedule.per_day
    found = counted.join(tick_days, target == F.col("__next_before"), "left")
    second = _second_at(schedule, F.col("__rank") - F.col("__next_before"))
    return found.withColumns({
        "__passed": F.lit(today["before"] + in_day) - F.col("__rank"),
        "next_run": F.timestamp_seconds(F.unix_date("__next_day").cast("bigint") * DAY_SECONDS + second),
    }).drop("__day", "__second", "__rank", "__next_day", "__next_before")


def _calendar(spark: SparkSession, schedule: Cron, first: date, last: date) -> DataFrame:
    """Each day with whether the schedule runs on it and how many ticks lie before it."""
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    days = spark.range((last - first).days + 1).select(day.alias("day"))
    # one row per calendar day: a window without partitions is a few thousand rows here
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    marked = days.withColumn("on", schedule.runs_on(F.col("day")))
    return marked.withColumn("before", (F.coalesce(F.sum(F.col("on").cast("bigint")).over(earlier), F.lit(0))
                                        * schedule.per_day).cast("bigint"))
