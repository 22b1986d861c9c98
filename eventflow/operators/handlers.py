"""User handlers over events: per event, per batch, as a program, and what their answers mean."""

from __future__ import annotations

import asyncio
import copy
import json
import subprocess
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from eventflow.functions.durations import duration_text_us
from eventflow.functions.maps import entries_any_case, entry_any_case
from eventflow.schema import ENVELOPE, RESPONSE

NO_ACK_HEADER = "X-Stream-No-Ack"

_ARROW_RESPONSE = pa.schema([
    ("event_id", pa.string()), ("status_code", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()),
    ("headers", pa.map_(pa.string(), pa.string())), ("no_ack", pa.bool_()), ("error", pa.string()),
    ("duration_ms", pa.float64())])


class Event:
    """What a handler sees of one row.

    Attributes are id, body, headers, fields, content_type, method, path, url, topic, shard_id,
    num_shards, offset, timestamp, trigger_kind, trigger_name, trigger_class, type, type_version,
    version and size.
    Those of a table row are read from its Arrow batch when first asked for.
    """

    # fixed values: attributes of an event made by hand
    DEFAULTS = {"id": None, "body": b"", "content_type": None, "method": None, "path": None, "url": None, "topic": None,
                "shard_id": None, "num_shards": None, "offset": None, "timestamp": None, "trigger_kind": None,
                "trigger_name": None, "trigger_class": None, "type": None, "type_version": None, "version": None, "size": None}

    def __init__(self, **attributes: Any):
        self.__dict__.update({**self.DEFAULTS, "headers": {}, "fields": {}, **attributes})

    @classmethod
    def of_row(cls, columns: _Columns, row: int) -> Event:
        """The event of a row of a batch."""
        event = cls.__new__(cls)
        event.__dict__.update(_columns=columns, _row=row)
        return event

    def __getattr__(self, name: str) -> Any:
        # only asked for names that are not set yet
        if name.startswith("_") or "_columns" not in self.__dict__:
            raise AttributeError(name)
        value = self._columns.attribute(name, self._row)
        self.__dict__[name] = value
        return value


class _Columns:
    """A batch's columns as lists, each made when first needed."""

    def __init__(self, batch: pa.RecordBatch):
        self._batch = batch
        self._names = set(batch.schema.names)
        self._lists: dict[str, list] = {}

    def values(self, name: str) -> list | None:
        if name not in self._names:
            return None
        if name not in self._lists:
            self._lists[name] = self._batch.column(name).to_pylist()
        return self._lists[name]

    def value(self, name: str, row: int) -> Any:
        values = self.values(name)
        return None if values is None else values[row]

    def attribute(self, name: str, row: int) -> Any:
        if name in ("headers", "fields"):
            return dict(self.value(name, row) or [])
        if name == "body":
            object_text = self.value("body_object", row)
            return json.loads(object_text) if object_text else (self.value("body", row) or b"")
        if name == "timestamp":
            return self.value("ts", row)
        if name not in Event.DEFAULTS:
            raise AttributeError(name)
        return self.value(name, row)


@dataclass
class Response:
    """A full answer of a handler."""

    body: Any = ""
    status_code: int = 200
    content_type: str = "text/plain"
    headers: dict = field(default_factory=dict)
    event_id: str | None = None


class Context:
    """Per task state of a handler: `user_data`, and calls to other handlers."""

    def __init__(self, registry: Mapping[str, Callable] | None = None):
        self.user_data: dict = {}
        self._registry = dict(registry or {})
        self.loop: asyncio.AbstractEventLoop | None = None

    def call(self, name: str, event: Event) -> Response:
        """Run another handler on an event and give its answer; its exceptions pass through."""
        answer = self._registry[name](self, event)
        # a coroutine cannot wait for its own loop
        return _as_response(_finished(answer, None if self.loop is None or self.loop.is_running() else self.loop))


def _finished(answer: Any, loop: asyncio.AbstractEventLoop | None = None) -> Any:
    """What a coroutine gives, run on the task's own loop, so that what one event opens serves the next."""
    if not asyncio.iscoroutine(answer):
        return answer
    return loop.run_until_complete(answer) if loop else asyncio.run(answer)


def _task_context(registry: Mapping[str, Callable] | None, init_context: Callable | None) -> Context:
    """The context of one task, with a loop that all its coroutines share."""
    context = Context(registry)
    context.loop = asyncio.new_event_loop()
    if init_context is not None:
        _finished(init_context(context), context.loop)
    return context


def _is_response(answer: Any) -> bool:
    # by shape: a handler's module may come with its own import of this class
    return hasattr(answer, "status_code") and hasattr(answer, "body")


def _as_response(answer: Any) -> Response:
    if _is_response(answer):
        return answer
    if isinstance(answer, tuple) and len(answer) == 2:
        status, rest = answer
        out = copy.copy(_as_response(rest))  # the handler may answer with one object again and again
        out.status_code = status
        return out
    if isinstance(answer, dict):
        return Response(json.dumps(answer), content_type="application/json")
    if answer is None:
        return Response("")
    return Response(answer if isinstance(answer, (str, bytes)) else json.dumps(answer))


class _Answers:
    """Answers of a batch, gathered by column."""

    def __init__(self):
        self.rows: list[int] = []
        self.ids: list[str | None] = []
        self.status: list[int] = []
        self.kinds: list[str] = []
        self.bodies: list[bytes] = []
        self.headers: list[list] = []
        self.no_ack: list[bool] = []
        self.errors: list[str | None] = []
        self.durations: list[float] = []

    def add(self, row: int, event_id: str | None, answer: Any) -> None:
        r = _as_response(answer)
        body = r.body
        if isinstance(body, (dict, list)):
            body = json.dumps(body)
        if isinstance(body, str):
            body = body.encode()
        elif not isinstance(body, bytes):
            body = bytes(body) if isinstance(body, (bytearray, memoryview)) else str(body).encode()
        self._put(row, event_id, int(r.status_code), r.content_type, body,
                  [(str(k), str(v)) for k, v in r.headers.items()], r.headers.get(NO_ACK_HEADER) is True, None)

    def add_failure(self, row: int, event_id: str | None, exc: Exception) -> None:
        text = f'Exception caught in handler - "{exc}"'
        self._put(row, event_id, 500, "text/plain", text.encode(), [], False, str(exc) or type(exc).__name__)

    def _put(self, row, event_id, status, kind, body, headers, no_ack, error) -> None:
        self.rows.append(row)
        self.ids.append(event_id)
        self.status.append(status)
        self.kinds.append(kind)
        self.bodies.append(body)
        self.headers.append(headers)
        self.no_ack.append(no_ack)
        self.errors.append(error)

    def __len__(self) -> int:
        return len(self.rows)

    def cut(self, length: int) -> None:
        """Forget the answers after the first `length`."""
        for values in (self.rows, self.ids, self.status, self.kinds, self.bodies, self.headers, self.no_ack, self.errors):
            del values[length:]

    def took(self, seconds: float) -> None:
        """Give the answers since the last call the time of theirs."""
        self.durations += [seconds * 1000.0] * (len(self.rows) - len(self.durations))

    def arrays(self) -> list[pa.Array]:
        columns = (self.ids, self.status, self.kinds, self.bodies, self.headers, self.no_ack, self.errors, self.durations)
        return [pa.array(values, f.type) for values, f in zip(columns, _ARROW_RESPONSE)]


def _handler_input(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The event columns a handler can see, with objects as JSON text, and `keep`."""
    seen = [c for c in ENVELOPE.names if c in df.columns and c not in keep]
    return df.select(*keep, *[F.to_json("body_object").alias(c) if c == "body_object" else F.col(c) for c in seen])


def map_handler(df: DataFrame, handler: Callable, init_context: Callable | None = None,
                keep: Sequence[str] = (), registry: Mapping[str, Callable] | None = None) -> DataFrame:
    """Run `handler(context, event)` for each event; the rows of its answers, with `keep` columns.

    `init_context(context)` runs once per task.  Answers: text or bytes (status 200), a dict (JSON),
    (status, answer), a `Response`, or a list of these (one row each).  Coroutines, `init_context` too,
    are awaited on one loop per task.  An exception becomes a row with status 500, and the job goes
    on.  `duration_ms` is the time of the call, failed ones included.  Results may be produced again when a task is retried.
    """
    rows = _handler_input(df, keep)
    schema = T.StructType([*[df.schema[k] for k in keep], *RESPONSE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = _task_context(registry, init_context)
        for batch in batches:
            columns, out = _Columns(batch), _Answers()
            ids = columns.values("id") or [None] * batch.num_rows
            for i in range(batch.num_rows):
                before, began = len(out), time.perf_counter()
                try:
                    answer = _finished(handler(context, Event.of_row(columns, i)), context.loop)
                    for item in answer if isinstance(answer, list) else (answer,):
                        out.add(i, ids[i], item)
                except Exception as exc:  # the handler's failure is its answer
                    out.cut(before)
                    out.add_failure(i, ids[i], exc)
                out.took(time.perf_counter() - began)
            places = pa.array(out.rows, pa.int64())
            kept = [batch.column(k).take(places) for k in keep]
            yield pa.RecordBatch.from_arrays(kept + out.arrays(), names=schema.names)

    return rows.mapInArrow(run, schema)


def map_batches(df: DataFrame, handler: Callable, init_context: Callable | None = None,
                batch: str = "batch_id", pos: str = "pos", registry: Mapping[str, Callable] | None = None) -> DataFrame:
    """Run `handler(context, events)` once per batch; one row per item of the list it returns.

    Items are like answers of `map_handler`; a `Response` names its event by `event_id`.  `answer_no`
    is the item's place.  An exception gives one row without event id, with `error` set.  Batches
    are of limited size (see `batching`), so a batch is held in one task.
    """
    rows = _handler_input(df, [batch, pos])
    placed = rows.repartition(batch).sortWithinPartitions(batch, pos)
    schema = T.StructType([df.schema[batch], T.StructField("answer_no", T.IntegerType()), *RESPONSE])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = _task_context(registry, init_context)
        key, events, key_type = None, [], None

        def answer(keys: list, out: _Answers) -> None:
            before, began = len(out), time.perf_counter()
            try:
                for i, item in enumerate(_finished(handler(context, events), context.loop)):
                    out.add(i, item.event_id if _is_response(item) else None, item)
            except Exception as exc:  # the whole batch failed
                out.cut(before)
                out.add_failure(0, None, exc)
            out.took(time.perf_counter() - began)
            keys += [key] * (len(out) - before)

        def made(keys: list, out: _Answers) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(out.rows, pa.int32()), *out.arrays()], names=schema.names)

        for part in parts:
            key_type = part.schema.field(batch).type
            columns, keys, out = _Columns(part), [], _Answers()
            for i, here in enumerate(columns.values(batch)):
                if events and here != key:
                    answer(keys, out)
                    events = []
                key = here
                events.append(Event.of_row(columns, i))
            yield made(keys, out)
        if events:
            keys, out = [], _Answers()
            answer(keys, out)
            yield made(keys, out)

    return placed.mapInArrow(run, schema)


def correlate(events: DataFrame, responses: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Match the responses of batches to their events by id.

    Gives (batch, event_id, outcome, status_code): ``success``, ``failure`` (the response has an
    error, or its whole batch has), ``no_response``, or ``orphan`` for a response to an unknown
    event.  Responses with an empty id are dropped; of several for one event the first counts.
    """
    # plain numbers and flags, so that the aggregate hashes instead of sorting
    first = responses.filter(F.coalesce("event_id", F.lit("")) != "").groupBy(batch, "event_id").agg(
        F.min_by("status_code", "answer_no").alias("status_code"),
        F.min_by(F.col("error").isNotNull(), "answer_no").alias("__failed"))
    broken = (responses.filter((F.coalesce("event_id", F.lit("")) == "") & F.col("error").isNotNull())
              .select(batch).distinct().withColumn("__broken", F.lit(True)))
    known = events.select(batch, "event_id").withColumn("__known", F.lit(True))
    joined = known.join(first, [batch, "event_id"], "full_outer").join(broken, batch, "left")
    outcome = (F.when(F.col("__known").isNull(), "orphan").when(F.col("__broken"), "failure")
               .when(F.col("__failed").isNull(), "no_response").when(F.col("__failed"), "failure")
               .otherwise("success"))
    return joined.select(batch, "event_id", outcome.alias("outcome"), "status_code")


# fixed values: submit errors that mean no worker was free
NO_WORKER_ERRORS = ("No available workers", "All workers are terminated")


def with_status(df: DataFrame) -> DataFrame:
    """Set `status_code` from errors: no worker 503, other submit errors 500, a process error its
    own `error_status` or 500; without an error the given status or 200."""
    submit, process = F.col("submit_error"), F.col("process_error")
    return df.withColumn("status_code", F.when(submit.isin(*NO_WORKER_ERRORS), 503).when(submit.isNotNull(), 500)
                         .when(process.isNotNull(), F.coalesce("error_status", F.lit(500)))
                         .otherwise(F.coalesce("status_code", F.lit(200))))


# fixed values: event attributes that a program finds in its environment
SHELL_ENVIRONMENT = ("id", "content_type", "path", "url", "method", "shard_id", "num_shards", "topic", "offset", "type",
                     "type_version", "version", "trigger_class", "trigger_kind", "trigger_name")


def shell_handler(df: DataFrame, command: str, args: Sequence[str] = (), arguments_header: str | None = None,
                  keep: Sequence[str] = (), timeout: float | None = None, env: Mapping[str, str] | None = None,
                  response_headers: Mapping[str, str] | None = None) -> DataFrame:
    """Run a program for each event: the body is its input, the output is the answer.

    An object body is its JSON text.  The environment is `env` and the event's attributes, as EVENT_ID, EVENT_PATH and so on,
    with EVENT_TIMESTAMP as RFC 3339 in UTC.  With `timeout` (seconds; none by default) a program that takes longer is ended
    and gives status 408 with what it has written.  `args` is a list and no shell reads it; with `arguments_header`
    that header's text, split at spaces, replaces it.  Output and errors are one text; a non-zero
    exit gives status 500 with that text.
    """
    base = {"PATH": "/usr/local/bin:/usr/bin:/bin", **(env or {})}

    def handler(context: Context, event: Event) -> Response:
        given = event.headers.get(arguments_header) if arguments_header else None
        arguments = given.split(" ") if given else list(args)
        own = {f"EVENT_{n.upper()}": str(getattr(event, n)) for n in SHELL_ENVIRONMENT if getattr(event, n) is not None}
        if event.timestamp is not None:
            own["EVENT_TIMESTAMP"] = event.timestamp.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        headers = dict(response_headers or {})
        given_body = event.body if event.body is None or isinstance(event.body, bytes) else json.dumps(event.body).encode()
        try:
            done = subprocess.run([command, *arguments], input=given_body, stdout=subprocess.PIPE, stderr=subprocess.STDOUT,
                                  timeout=timeout, env={**base, **own})
        except subprocess.TimeoutExpired as late:
            return Response(late.stdout or b"", 408, headers=headers)
        if done.returncode != 0:
            return Response(f"exit status {done.returncode}\n".encode() + done.stdout, 500, headers=headers)
        return Response(done.stdout, headers=headers)

    return map_handler(df, handler, keep=keep)


def call(df: DataFrame, registry: Mapping[str, Callable], name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Run one handler of a registry over events; it may call the others through its context."""
    return map_handler(df, registry[name], keep=keep, registry=registry)


def apply_timeout(df: DataFrame, limit: str, elapsed_ms: str = "duration_ms") -> DataFrame:
    """Events that took longer than `limit` get status 408 and outcome ``timeout``; others stay."""
    late = F.col(elapsed_ms) * 1000 > duration_text_us(limit)
    return df.withColumns({"status_code": F.when(late, 408).otherwise(F.col("status_code")),
                           "outcome": F.when(late, "timeout").otherwise(F.col("outcome"))})


# fixed values: admission defaults
CORS_METHODS = ("HEAD", "GET", "POST", "PUT", "DELETE", "OPTIONS", "PATCH")
CORS_HEADERS = ("Accept", "Content-Length", "Content-Type", "Authorization")
MAX_BODY_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class Cors:
    """Which origins, methods and headers may ask."""

    origins: Sequence[str] = ("*",)
    methods: Sequence[str] = CORS_METHODS
    headers: Sequence[str] = CORS_HEADERS
    preflight_method: str = "OPTIONS"


def admit(df: DataFrame, cors: Cors | None = None, max_body: int = MAX_BODY_BYTES) -> DataFrame:
    """Add `admitted`, `reason` and `status` to request rows (method, headers in any case, body).

    A preflight (the preflight method with a requested method) is answered by 200 or 400.  Another
    request is refused without a status for its origin, and with 413 for its body.
    """
    df = df.withColumn("__asked", entries_any_case("headers", "Origin", "Access-Control-Request-"))

    def head(name: str):
        return entry_any_case(F.col("__asked"), name)

    def one_of(value, allowed: Sequence[str]):
        return F.lower(value).isin([a.lower() for a in allowed])

    too_large = F.coalesce(F.octet_length("body"), F.lit(0)) > max_body
    preflight, origin_ok, method_ok, headers_ok = F.lit(False), F.lit(True), F.lit(True), F.lit(True)
    if cors is not None:
        origin, wanted, asked = head("Origin"), head("Access-Control-Request-Method"), head("Access-Control-Request-Headers")
        preflight = (F.col("method") == cors.preflight_method) & (wanted != "")
        origin_ok = (origin != "") & (F.lit("*" in cors.origins) | one_of(origin, cors.origins))
        method_ok = (wanted == cors.preflight_method) | one_of(wanted, cors.methods)
        headers_ok = (asked == "") | F.forall(F.split(asked, ", "), lambda h: one_of(h, cors.headers))
    reason = (F.when(too_large, "body").when(~origin_ok, "origin").when(preflight & ~method_ok, "method")
              .when(preflight & ~headers_ok, "headers"))
    df = df.withColumns({"reason": reason, "__preflight": preflight})
    status = (F.when(F.col("reason") == "body", 413).when(F.col("__preflight") & F.col("reason").isNull(), 200)
              .when(F.col("__preflight"), 400))
    return df.withColumns({"admitted": F.col("reason").isNull(), "status": status}).drop("__preflight", "__asked")
