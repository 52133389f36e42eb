"""URL filter: a trie over reversed host labels and path segments, longest match wins.

The trie is broadcast while it has at most ``BROADCAST_RULES`` rules.  A larger table of
rules is joined instead: every url meets the rules of its host's suffixes by equality.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparvane.llm.common import map_batches

BROADCAST_RULES = 200_000
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str  # from the first "/" on

    @property
    def text(self) -> str:
        return self.host + self.path


class Trie:
    """Nodes are dicts: a host label or, below the mark "/", a path segment leads on.

    A rule ends in a whole segment or in the beginning of one (under ``None``).
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.lower().split(".")):
                node = node.setdefault(("h", label), {})
            *segments, last = rule.path.split("/")
            for segment in segments:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault(None, {})
            other = ends.get(last)
            if other is None or rule.verdict == BLOCK:  # the same rule both ways: block
                ends[last] = rule

    def find(self, host: str, path: str) -> Rule | None:
        """The rule with the longest host that fits, of these the one with the longest path."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            best = self._along(node, segments) or best
        return best

    @staticmethod
    def _along(node: dict, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            ends = node.get(None)
            if ends:
                fits = [end for end in ends if segment.startswith(end)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get(("p", segment))
            if node is None:
                return best
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host from the first "://" to "/", "?" or "#", A-Z lower-cased; path to "?" or "#"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min(i for i in (rest.find("/"), rest.find("?"), rest.find("#"), len(rest)) if i >= 0)
    path = rest[end:]
    stop = min(i for i in (path.find("?"), path.find("#"), len(path)) if i >= 0)
    return rest[:end].translate(_LOWER), path[:stop]


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url``).

    ``rules``: a list, or a DataFrame (verdict, host, path), which is broadcast only if
    it holds at most ``BROADCAST_RULES`` rows.  A null url, or one without "://", has an
    empty host and path and gets the default.  Repeated rows and null ids keep a row
    each; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    if isinstance(rules, DataFrame):
        first = rules.select("verdict", "host", "path").limit(BROADCAST_RULES + 1).collect()
        if len(first) > BROADCAST_RULES:
            return _judge_by_join(pages, rules, default)
        rules = [Rule(*r) for r in first]
    if len(rules) > BROADCAST_RULES:
        return _judge_by_join(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def work():
        trie = shared.value

        def step(batch: dict) -> dict:
            parts = [split_url(url) for url in batch["url"].to_pylist()]
            found = [trie.find(*x) for x in parts]
            return {
                "page_id": batch["page_id"],
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": [r and r.text for r in found],
                "verdict": [r.verdict if r else default for r in found],
            }

        return step

    return map_batches(pages, work, "page_id long, host string, path string, rule string, verdict string")


def _judge_by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equality join on host suffixes, for rules beyond the broadcast's bound."""
    found = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    pages = pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id",
        F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit("")).alias("path"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.select(F.lower("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("said"), F.concat("host", "path").alias("text"))
    hits = (
        pages.select("row", "path", F.explode(suffixes).alias("suffix"))
        .join(rules, "suffix").filter(F.col("path").startswith(F.col("start")))
        .groupBy("row").agg(F.max(F.struct(F.length("suffix").alias("a"), F.length("start").alias("b"), (F.col("said") == BLOCK).alias("c"), "text", "said")).alias("best"))
    )
    return pages.join(hits, "row", "left").select("page_id", "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))
