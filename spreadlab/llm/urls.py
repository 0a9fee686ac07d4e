"""Allow and block rules for URLs in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import ascii_lower

# Rules up to this number are broadcast as one trie; more are joined.
TRIE_RULES = 100_000


class Rule(NamedTuple):
    """``verdict`` for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested nodes: host labels from the last to the first, below ``"/"`` the whole path segments.

    A node holds under ``None`` its rules as (last incomplete segment, rule), longest first.
    """
    root: dict = {}
    for rule in rules:
        *segments, rest = rule.path.split("/")
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        for segment in segments:
            node = node.setdefault(segment, {})
        node.setdefault(None, []).append((rest, rule))
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [below for key, below in node.items() if key is not None]
        if None in node:
            node[None].sort(key=lambda x: (-len(x[0]), x[1].verdict != "block"))
    return root


def longest(trie: dict, host: str, path: str) -> Rule | None:
    """The fitting rule with the most host labels, among those the one with the longest path; block before allow."""
    segments, found, node = path.split("/"), None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        at = node.get("/")
        deepest = None
        for segment in segments:
            if at is None:
                break
            deepest = next((rule for rest, rule in at.get(None, ()) if segment.startswith(rest)), deepest)
            at = at.get(segment)
        found = deepest or found
    return found


def _by_trie(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("verdict string, rule string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [longest(trie.value, host, path) for host, path in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"verdict": [r and r.verdict for r in found], "rule": [r and r.host + r.path for r in found]}, dtype=object)

    return urls.withColumn("found", judge("host", "path")).select("id", "host", "path", F.col("found.rule"), F.col("found.verdict"))


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same verdicts from a join on (host suffix, whole leading segments), for rule sets of any size."""
    leading = F.regexp_extract("rule_path", r"^(.*/)?", 0)
    keyed = rules.select("verdict", F.col("host").alias("suffix"), F.col("path").alias("rule_path")).withColumn("stem", leading)
    keyed = keyed.where(F.col("suffix").isNotNull())
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    stems = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    )
    pairs = urls.select("host", "path").distinct()
    known = pairs.select("host", "path", F.explode(suffixes).alias("suffix")).join(keyed.select("suffix").distinct(), "suffix", "left_semi")
    tried = known.select("host", "path", "suffix", F.explode(stems).alias("stem"))
    fits = tried.join(keyed, ["suffix", "stem"]).where(F.startswith("path", "rule_path"))
    rank = F.struct(F.size(F.split("suffix", r"\.")), F.length("rule_path"), "verdict", F.concat("suffix", "rule_path").alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return urls.join(best, ["host", "path"], "left").select("id", "host", "path", "rule", "verdict")


def judge(
    pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow", url: str = "url", page_id: str = "page_id", trie_rules: int = TRIE_RULES
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A rule fits its host and all subdomains where the path of the URL starts with the
    rule's path. The longest wins: more host labels first, then the longer path; of
    equal rules block wins. Without a rule the verdict is ``default`` and rule is null.
    A null URL and one without ``://`` have an empty host and path. ``rules`` is a list,
    or a table (verdict, host, path) of any size: up to ``trie_rules`` are broadcast as
    a trie, more are joined. Repeated rows and ids stay; other columns are not read.
    """
    urls = pages.select(F.col(page_id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        first = [Rule(*r) for r in rules.where(F.col("host").isNotNull()).select("verdict", "host", F.coalesce("path", F.lit(""))).limit(trie_rules + 1).collect()]
    else:
        first = [Rule(*r) for r in rules]
    if len(first) <= trie_rules:
        found = _by_trie(urls, first)
    else:
        whole = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(first, "verdict string, host string, path string")
        found = _by_join(urls, whole.select("verdict", "host", F.coalesce("path", F.lit("")).alias("path")))
    return found.select(F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
