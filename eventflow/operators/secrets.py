"""Secrets of configuration documents: taking them out, putting them back, finding references.

The documents are JSON texts of any shape, so a small walk over each document runs in Arrow
batches.  A document is one row; its secrets are never more than the row holds.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

REFERENCE = "$ref:"

# fixed values: paths of sensitive values
SENSITIVE_PATHS = (
    r"^/spec/build/codeentryattributes/password$",
    r"^/spec/build/codeentryattributes/s3secretaccesskey$",
    r"^/spec/build/codeentryattributes/s3sessiontoken$",
    r"^/spec/build/codeentryattributes/headers/authorization$",
    r"^/spec/build/codeentryattributes/headers/x-.+-session-key$",
    r"^/spec/volumes\[\d+\]/volume/volumesource/flexvolume/options/accesskey$",
    r"^/spec/volumes\[\d+\]/volume/flexvolume/options/accesskey$",
    r"^/spec/triggers/.+/password$",
    r"^/spec/triggers/.+/secret$",
    r"^/spec/triggers/.+/attributes/password$",
    r"^/spec/triggers/.+/attributes/accesskeyid$",
    r"^/spec/triggers/.+/attributes/secretaccesskey$",
    r"^/spec/triggers/.+/attributes/cacert$",
    r"^/spec/triggers/.+/attributes/accesskey$",
    r"^/spec/triggers/.+/attributes/accesscertificate$",
    r"^/spec/triggers/.+/attributes/sasl/password$",
    r"^/spec/triggers/.+/attributes/sasl/oauth/clientsecret$",
    r"^/metadata/annotations/.+/kafka-ca-cert$",
    r"^/metadata/annotations/.+/kafka-access-key$",
    r"^/metadata/annotations/.+/kafka-access-cert$",
    r"^/metadata/annotations/.+/kafka-sasl-password$",
    r"^/metadata/annotations/.+/kafka-sasl-oauth-client-secret$",
    r"^/metadata/annotations/.+/kafka-sasl-oauth-token-url$",
)


class Paths:
    """Patterns of paths as a trie over their literal first steps, carried down a walk.

    A pattern ``^/a/b/c.+`` hangs below the steps a and b, with the literal start ``c`` of its next step; one that is not of this
    form may match anywhere.  Below a step that no pattern goes on with, nothing has to be looked at, and a leaf is searched only
    for the patterns that may still match.
    """

    def __init__(self, patterns: Sequence[str]) -> None:
        self.patterns = tuple(patterns)
        self.root: dict = {}
        self.searches: dict[frozenset, Callable[[str], bool]] = {}
        anywhere = set()
        for number, pattern in enumerate(self.patterns):
            if not pattern.startswith("^/") or set("|()") & set(pattern):
                anywhere.add(number)
                continue
            steps, node = pattern[2:].split("/"), self.root
            while len(steps) > 1 and re.fullmatch("[A-Za-z0-9_-]+", steps[0]):
                node = node.setdefault("next", {}).setdefault(steps.pop(0).lower(), {})
            start = re.match("[A-Za-z0-9_-]*", steps[0])[0]
            if steps[0][len(start):len(start) + 1] in ("*", "?", "{"):  # the last letter may be missing
                start = start[:-1]
            node.setdefault("here", []).append((start.lower(), number))
        self.begin = ([self.root], frozenset(anywhere), "")

    def down(self, state: tuple, key: str) -> tuple[list[dict], frozenset, str]:
        """The nodes, the patterns that may match, and the step not yet taken, below a key; a key may hold slashes."""
        nodes, live, step = state
        for piece in key.split("/"):
            if step:
                nodes = [child for node in nodes for name, child in self.children(node, step)]
            live = live.union(*[[n for start, n in node.get("here", ()) if not piece.isascii() or piece.lower().startswith(start)] for node in nodes])
            step = piece
            if not step:  # an empty step is no literal one
                nodes = []
        return nodes, live, step

    @staticmethod
    def children(node: dict, step: str) -> list[tuple[str, dict]]:
        following = node.get("next", {})
        if step.isascii():
            child = following.get(step.lower())
            return [(step, child)] if child else []
        return [(name, child) for name, child in following.items() if re.fullmatch(name, step, re.IGNORECASE)]

    def dead(self, state: tuple) -> bool:
        nodes, live, step = state
        return not live and not any(child for node in nodes for child in self.children(node, step))

    def matches(self, state: tuple, path: str) -> bool:
        live = state[1]
        if live not in self.searches:
            compiled = [re.compile(self.patterns[n], re.IGNORECASE) for n in sorted(live)]
            self.searches[live] = lambda text: any(c.search(text) for c in compiled)
        return self.searches[live](path)


def _walk(node: Any, path: str, leaf: Callable[[str, Any], Any], paths: Paths | None = None, state: tuple | None = None) -> Any:
    """A copy of a JSON tree with each leaf replaced by ``leaf(path, value)``; with `paths`, only leaves that one of these matches."""
    if paths is not None:
        state = state or paths.begin
        if path and paths.dead(state):
            return node
    if isinstance(node, dict):
        return {k: _walk(v, f"{path}/{k}", leaf, paths, paths and paths.down(state, k)) for k, v in node.items()}
    if isinstance(node, list):
        # an index goes on with the step it stands behind, which is then no literal one
        inside = paths and ([], state[1], "")
        return [_walk(v, f"{path}[{i}]", leaf, paths, inside) for i, v in enumerate(node)]
    return leaf(path, node) if paths is None or paths.matches(state, path) else node


def _parsed(text: str) -> tuple[Any, str | None]:
    """A document's tree, or what is wrong with it."""
    try:
        return json.loads(text), None
    except ValueError as exc:
        return None, f"malformed document: {exc}"


def _map_documents(df: DataFrame, column: str, needs: Sequence[str], added: list[tuple[str, T.DataType, pa.DataType]],
                   change: Callable[..., tuple]) -> DataFrame:
    """Replace `column` and add columns by ``change(text, *needs)`` for each row; `needs` are dropped."""
    kept = [c for c in df.columns if c not in needs and c not in [n for n, _, _ in added]]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t, _ in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [batch.column(c).to_pylist() for c in (column, *needs)]
            made = list(zip(*[change(*row) for row in zip(*inputs)])) or [[] for _ in range(1 + len(added))]
            columns = [pa.array(made[0], pa.string()) if c == column else batch.column(c) for c in kept]
            extra = [pa.array(values, kind) for values, (_, _, kind) in zip(made[1:], added)]
            yield pa.RecordBatch.from_arrays(columns + extra, names=schema.names)

    return df.mapInArrow(run, schema)


def scrub(df: DataFrame, patterns: Sequence[str] = SENSITIVE_PATHS, existing: DataFrame | None = None,
          key: str = "name", column: str = "config") -> tuple[DataFrame, DataFrame]:
    """Replace sensitive values by references: (redacted documents, secrets).

    A leaf whose path (``/a/b[0]/c``) matches a pattern, in any case, becomes ``$ref:`` plus the
    path in lower case.  Empty texts and references stay.  Secrets are rows (key, secret_key, value
    as JSON); `existing` ones are kept unless there is a new value.  A document that does not parse
    is replaced by null, as it may hold anything, and `config_error` says so.  Each of the two frames walks the documents when it
    is used: a written table between them would leave the secrets in the shared folder.
    """
    paths = Paths(patterns)

    def change(text: str | None) -> tuple:
        if text is None:
            return None, [], None
        tree, error = _parsed(text)
        if error is not None:
            return None, [], error
        found: dict[str, str] = {}

        def leaf(path: str, value: Any) -> Any:
            if value is None or value == "":
                return value
            if isinstance(value, str) and value.startswith(REFERENCE):
                return value
            reference = REFERENCE + path.lower()
            found[reference] = json.dumps(value)
            return reference

        redacted = _walk(tree, "", leaf, paths)
        return json.dumps(redacted), list(found.items()), None

    walked = _map_documents(df, column, (), [(
        "__secrets", T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())),
        ("config_error", T.StringType(), pa.string())], change)
    fresh = walked.select(key, F.explode("__secrets").alias("secret_key", "value"))
    if existing is not None:
        old = existing.select(key, "secret_key", "value", F.lit(0).alias("__new"))
        both = fresh.withColumn("__new", F.lit(1)).unionByName(old)
        fresh = both.groupBy(key, "secret_key").agg(F.max_by("value", "__new").alias("value"))
    return walked.drop("__secrets"), fresh


def restore(df: DataFrame, secrets: DataFrame, key: str = "name", column: str = "config") -> DataFrame:
    """Put the secrets back where the references are; a reference without a secret stays, as does a text that does not parse."""
    # a document's secrets come from that one document, so the group is as small as a row
    held = secrets.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("secret_key", "value"))).alias("__held"))

    def change(text: str | None, held: list | None) -> tuple:
        if text is None:
            return (None,)
        values = dict(held or [])
        tree, error = _parsed(text)
        if error is not None:
            return (text,)

        def leaf(path: str, value: Any) -> Any:
            if isinstance(value, str) and value.startswith(REFERENCE) and value in values:
                return json.loads(values[value])
            return value

        return (json.dumps(_walk(tree, "", leaf)),)

    return _map_documents(df.join(held, key, "left"), column, ("__held",), [], change).select(*df.columns)


def has_refs(df: DataFrame, patterns: Sequence[str] = SENSITIVE_PATHS, column: str = "config") -> DataFrame:
    """Add `has_refs`: whether a sensitive path holds a reference; null for a text that does not parse."""
    paths = Paths(patterns)

    def change(text: str | None) -> tuple:
        seen = []

        def leaf(path: str, value: Any) -> Any:
            if isinstance(value, str) and value.startswith(REFERENCE):
                seen.append(path)
            return value

        if text is not None:
            tree, error = _parsed(text)
            if error is not None:
                return text, None
            _walk(tree, "", leaf, paths)
        return text, bool(seen)

    return _map_documents(df, column, (), [("has_refs", T.BooleanType(), pa.bool_())], change)


def encode_secret_key(path: str, prefix: str) -> str:
    """Name of a secret for places that allow only letters, digits and underscores."""
    return prefix + base64.b64encode(path.encode()).decode().replace("=", "_")


def decode_secret_key(name: str, prefix: str) -> str:
    """The inverse of `encode_secret_key`."""
    return base64.b64decode(name.removeprefix(prefix).replace("_", "=")).decode()


def encoded_key(column: str, prefix: str):
    """`encode_secret_key` as a column."""
    return F.concat(F.lit(prefix), F.replace(F.base64(F.col(column).cast("binary")), F.lit("="), F.lit("_")))
