"""Chat formatting: records of many layouts become canonical turns, and turns become marked text with a loss mask.

The nested field paths of a record, hashed, are its schema fingerprint; a fingerprint selects a declarative mapping.  Main
path: DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<turn:bigint,role:string,text:string>"


class Layout(NamedTuple):
    """A layout: its field paths (``[]`` goes into a list), and what it says about turns.

    `rows`: one turn a row, as (conversation, order, role, text) columns.  `items`: one list of turns, as (list, role, text).
    `fields`: one field a turn, as (role, field) in order; null fields give no turn.
    """

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout("speakers", ("conversations", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout("instruction with input and system", ("system", "instruction", "input", "output"),
           fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction with input", ("instruction", "input", "output"),
           fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt and completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all fields of a nested type."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    if not isinstance(kind, T.StructType):
        return []
    named = [(f"{at}.{f.name}" if at else f.name, f.dataType) for f in kind.fields]
    return [p for here, inner in named for p in (here, *field_paths(inner, here))]


def select_layout(paths, layouts=LAYOUTS) -> Layout | None:
    """The layout with the fingerprint of the paths that any layout knows; else the first, by number of paths, that is contained."""
    known = {p for layout in layouts for p in layout.paths}
    of = {fingerprint(layout.paths): layout for layout in layouts}
    here = set(paths) & known
    if exact := of.get(fingerprint(here)):
        return exact
    return next((x for x in sorted(layouts, key=lambda x: -len(x.paths)) if here.issuperset(x.paths)), None)


def _turn(turn: Column, role: Column, text: Column) -> Column:
    return F.struct(turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _named(role: Column) -> Column:
    named = F.coalesce(*[F.when(role == k, v) for k, v in ROLES.items()], role)
    return named


def _from_fields(layout: Layout, value) -> Column:
    turns = [F.when(value(f).isNotNull(), _turn(F.lit(i), F.lit(role), value(f))) for i, (role, f) in enumerate(layout.fields)]
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def _from_items(layout: Layout, items: Column, value) -> Column:
    _, role, text = layout.items
    turns = F.transform(items, lambda m, i: _turn(i, _named(value(m, role)), value(m, text)))
    return F.coalesce(turns, F.array().cast(f"array<{TURN}>"))


def canonical_rows(records: DataFrame, conv_id: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turns, layout) of records whose columns are typed; the table's field paths select the mapping.

    Turns are (turn, role, text), null role or text as empty.  Turn rows are gathered by conversation and sorted by turn, role
    and text, null turns first, repeated rows kept; the rows without conversation are one conversation.  Columns that no layout
    knows are not read.  A table of no known layout raises.
    """
    layout = select_layout(field_paths(records.schema), layouts)
    if layout is None:
        raise ValueError(f"no layout for the fields {field_paths(records.schema)}")
    if layout.rows:
        conv, turn, role, text = (F.col(f"`{c}`") for c in layout.rows)
        gathered = records.select(conv.alias("conv_id"), _turn(turn, role, text).alias("t")).groupBy("conv_id").agg(
            F.sort_array(F.collect_list("t")).alias("turns"))
        return gathered.withColumn("layout", F.lit(layout.name))
    turns = _from_items(layout, F.col(layout.items[0]), lambda m, f: m[f]) if layout.items else _from_fields(layout, F.col)
    return records.select(F.col(conv_id) if conv_id else F.monotonically_increasing_id().alias("conv_id"),
                          turns.cast(f"array<{TURN}>").alias("turns"), F.lit(layout.name).alias("layout"))


def json_fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON document: its variant schema without the leaf types."""
    shape = F.schema_of_variant(record)
    return F.sha2(F.regexp_replace(shape, ": (STRING|BIGINT|BOOLEAN|DOUBLE|DECIMAL\\([0-9,]*\\)|VOID|VARIANT)", ""), 256)


def _shape(layout: Layout) -> str:
    """The variant schema, without leaf types, of a record that has just the paths of the layout."""
    lists = {p.split("[].")[0]: sorted(q.split("[].")[1] for q in layout.paths if q.startswith(p + "[].")) for p in layout.paths if "[]" not in p}
    return "OBJECT<" + ", ".join(k + (f": ARRAY<OBJECT<{', '.join(v)}>>" if v else "") for k, v in sorted(lists.items())) + ">"


def canonical_json(records: DataFrame, json: str, conv_id: str, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turns, layout) of JSON documents, each by its own fingerprint.

    A document of no known fingerprint (more fields, say) takes the first layout, by number of paths, whose top fields it has;
    one that fits none, or is no JSON or null, has no turns and a null layout, but its row stays.
    """
    usable = sorted((x for x in layouts if not x.rows), key=lambda x: -len(x.paths))
    doc = F.col("doc__")
    frame = records.select(F.col(conv_id).alias("conv_id"), F.try_parse_json(F.col(json)).alias("doc__"))
    frame = frame.withColumn("print__", json_fingerprint(doc))

    def turns(layout: Layout) -> Column:
        if layout.items:
            items = F.try_variant_get(doc, f"$.{layout.items[0]}", "array<variant>")
            return _from_items(layout, items, lambda m, f: F.try_variant_get(m, f"$.{f}", "string"))
        return _from_fields(layout, lambda f: F.try_variant_get(doc, f"$.{f}", "string"))

    def has(layout: Layout) -> Column:
        tops = [p for p in layout.paths if "[]" not in p]
        return F.forall(F.array(*[F.try_variant_get(doc, f"$.{p}", "variant").isNotNull() for p in tops]), lambda x: x)

    prints = {layout.name: hashlib.sha256(_shape(layout).encode()).hexdigest() for layout in usable}
    chosen = F.coalesce(*[F.when(F.col("print__") == prints[x.name], x.name) for x in usable], *[F.when(has(x), x.name) for x in usable])
    frame = frame.withColumn("layout", chosen)
    picked = F.coalesce(*[F.when(F.col("layout") == x.name, turns(x).cast(f"array<{TURN}>")) for x in usable], F.array().cast(f"array<{TURN}>"))
    return frame.select("conv_id", picked.alias("turns"), "layout")


def escape(text: Column, line: bool = False) -> Column:
    """No ``<|`` is left in the result, and no line feed if `line`; `unescape` gives the text back."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text: Column, line: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if line else text
    return F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _joined(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def format_chat(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """`turns` (conv_id, turns, ...) with `formatted` and `segments`, its parts in order as (text, loss).

    A turn is ``<|im_start|>role`` line feed, text, ``<|im_end|>`` line feed, with role and text escaped.  Loss is on the texts
    of the role `learn`, and on nothing else.  A conversation without turns is empty text.
    """
    def parts(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(F.concat(F.lit(START), escape(t["role"], True), F.lit("\n")), F.lit(False)),
                       part(escape(t["text"]), t["role"] == learn), part(F.lit(END + "\n"), F.lit(False)))

    out = turns.withColumn("segments", F.flatten(F.transform("turns", parts)))
    return out.withColumn("formatted", _joined(F.transform("segments", lambda s: s["text"])))


def parse_chat(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        at = F.char_length(role) + 2
        text = F.substr(part, at, F.char_length(part) - at + 1 - len(END + "\n"))
        return F.struct(unescape(role, True).alias("role"), unescape(text).alias("text"))

    marked = F.split(formatted, START.replace("|", "\\|"))
    return F.transform(F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))), turn)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: their turns, and the text under the loss mask."""
    read = formatted.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("back"),
                            _joined(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))).alias("learnt"))
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(_joined(lines), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
