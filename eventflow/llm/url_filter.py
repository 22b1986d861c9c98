"""URL filters: a trie over reversed host labels, and per host a trie over path segments; the longest matching rule decides."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built, stored

URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BLOCK_RULES = 1_000_000  # rules that a worker holds at once
RESULT = "host string, path string, labels int, reach int, blocks boolean, rule string"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    found = URL.search(url) if url is not None else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


class PathTrie:
    """Path prefixes by segment.  A rule ends inside a segment, so each node keeps the beginnings of segments that end rules there."""

    def __init__(self) -> None:
        self.below: dict[str, PathTrie] = {}
        self.ends: dict[str, Rule] = {}

    def add(self, rule: Rule) -> None:
        *whole, rest = rule.path.split("/")
        node = self
        for segment in whole:
            node = node.below.setdefault(segment, PathTrie())
        known = node.ends.get(rest)
        if known is None or rule.verdict == "block":
            node.ends[rest] = rule

    def longest(self, path: str) -> Rule | None:
        node, best = self, None
        for segment in path.split("/"):
            fitting = [e for e in node.ends if segment.startswith(e)]
            if fitting:
                best = node.ends[max(fitting, key=len)]
            node = node.below.get(segment)
            if node is None:
                break
        return best


class HostTrie:
    """Rules by host labels from the right; a rule fits its host and all subdomains."""

    def __init__(self, rules: Iterable[Rule] = ()) -> None:
        self.below: dict[str, HostTrie] = {}
        self.paths: PathTrie | None = None
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        node = self
        for label in reversed(rule.host.translate(LOWER).split(".")):
            node = node.below.setdefault(label, HostTrie())
        node.paths = node.paths or PathTrie()
        node.paths.add(rule)

    def longest(self, host: str, path: str) -> Rule | None:
        """The rule with the most host labels, and of those the longest path; of two equal rules a block."""
        node, best = self, None
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            best = (node.paths and node.paths.longest(path)) or best
        return best


def _trie(rules: list[tuple]) -> HostTrie:
    return HostTrie(Rule(*r) for r in rules)


def filter_urls(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """`pages` with host, path, rule (host and path of the deciding rule, else null) and verdict.

    A null url or one without ``://`` has empty host and path and gets the default, as has a url that no rule fits.  Rows are
    kept as they are, repeated ones too; columns of `pages` named like the four new ones are replaced.  The rules go to the
    tasks in blocks of `block_rules`, one pass (and one written table between passes) for each; the best rule of all decides.
    """
    listed = [Rule(*r) for r in rules]
    blocks = [listed[i:i + block_rules] for i in range(0, len(listed), block_rules)] or [[]]
    names = ["host", "path", "rule", "verdict"]
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    out = pages.select(*kept, F.col(url).alias("url__"), F.lit(None).cast(f"struct<{RESULT}>").alias("judged__"))
    for k, block in enumerate(blocks):
        if k:
            out = stored(out, "judged")
        now = _judge(pages.sparkSession.sparkContext.broadcast([tuple(r) for r in block]))(F.col("url__"))
        out = out.withColumn("now__", now) if k else out.withColumn("judged__", now)
        if k:  # more host labels, then the longer path, then a block
            best = F.greatest(*[F.struct(*[F.col(c)[f].alias(f) for f in ("labels", "reach", "blocks", "rule")]) for c in ("judged__", "now__")])
            out = out.withColumn("judged__", F.struct(F.col("judged__.host"), F.col("judged__.path"), *[best[f].alias(f) for f in ("labels", "reach", "blocks", "rule")]))
            out = out.drop("now__")
    verdict = F.when(F.col("judged__.blocks"), "block").when(F.col("judged__.rule").isNotNull(), "allow").otherwise(default)
    return out.select(*kept, *[F.col(f"judged__.{n}").alias(n) for n in names[:3]], verdict.alias("verdict"))


def _judge(sent):
    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = built(_trie, sent)
        for urls in batches:
            rows = []
            for text in urls:
                host, path = split_url(text)
                rule = trie.longest(host, path)
                rows.append((host, path, *((rule.host.count(".") + 1, len(rule.path), rule.verdict == "block", rule.host + rule.path) if rule else (-1, -1, False, None))))
            yield pd.DataFrame(rows, columns=["host", "path", "labels", "reach", "blocks", "rule"]).astype({"rule": object})

    return judge
