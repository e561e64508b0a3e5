"""URL filters: a trie over reversed host labels and path segments, longest match wins.

A rule is (verdict, host, path).  It fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path; the path prefix may end inside a segment.  Of the rules that fit, the longest (host and
path characters together) wins; at equal length the one with the longer host, then a block before an allow.

Rules are given by the caller and broadcast as one trie; MAX_RULE_BYTES bounds what is broadcast.  Larger rule sets
are matched by `judge_by_join`, which joins on host suffixes and needs no broadcast.

Edge cases: a null URL or one without "://" has empty host and path and fits no rule; an empty host fits none; an empty
path does not start with "/"; no fitting rule gives rule null and the default verdict; repeated URLs are judged alike;
an empty table gives an empty result; existing columns named like the outputs are replaced.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

MAX_RULE_BYTES = 64 << 20
Rule = tuple[str, str, str]


def parse_rule(text: str) -> tuple[str, str]:
    """"org/a/b" is host org, path /a/b."""
    host, slash, path = text.partition("/")
    return host.lower(), slash + path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return ascii_lower(host), path


def trie_of(rules: Iterable[Rule]) -> list:
    """Nodes are [children by host label, children by path segment, rules that end in a partial segment]."""
    root: list = [{}, {}, []]
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or (path and path[0] != "/"):
            raise ValueError(f"not a rule: {verdict!r}, {host!r}, {path!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node[0].setdefault(label, [{}, {}, []])
        whole = path.split("/")  # "/en/1" is "", "en" in full and "1" as a prefix; "" has no segment in full
        for segment in whole[:-1]:
            node = node[1].setdefault(segment, [{}, {}, []])
        node[2].append((whole[-1], (len(host) + len(path), len(host), verdict == "block"), host + path, verdict))
    return root


def longest(root: list, host: str, path: str) -> tuple[str | None, str | None]:
    """Rule and verdict of the longest match."""
    best: tuple = ((), None, None)
    node, labels = root, host.split(".") if host else []
    segments = path.split("/")
    while labels and (node := node[0].get(labels.pop())):
        at, i = node, 0
        while at:
            for prefix, *found in at[2]:
                if segments[i].startswith(prefix) and tuple(found[0]) > best[0]:
                    best = tuple(found)
            at = at[1].get(segments[i]) if i + 1 < len(segments) else None
            i += 1
    return best[1:]


def _with_parts(df: DataFrame, url: str) -> DataFrame:
    host, path = parts(F.col(url))
    return df.withColumns({"host": host, "path": path})


def judge(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """df with columns host, path, rule, verdict."""
    rules = list(rules)
    if sum(len(h) + len(p) + 100 for _, h, p in rules) > max_rule_bytes:
        return judge_by_join(df, df.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), url, default)
    trie = df.sparkSession.sparkContext.broadcast(trie_of(rules))  # plain lists and dicts

    @F.pandas_udf("rule string, verdict string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [longest(trie.value, h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame([(r, v or default) for r, v in found], columns=["rule", "verdict"], dtype=object)

    df = _with_parts(df, url).withColumn("__match", match("host", "path"))
    return df.withColumns({"rule": F.col("__match.rule"), "verdict": F.col("__match.verdict")}).drop("__match")


def judge_by_join(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """judge() for any number of rules: distinct (host, path) are joined with rules(verdict, host, path) on host suffixes."""
    df = _with_parts(df, url)
    labels = F.split("host", "[.]")
    seen = df.select("host", "path").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("verdict").alias("__verdict"))
    fit = seen.where("host <> ''").withColumn("__host", F.explode(suffixes)).join(rules, "__host").where(F.col("path").startswith(F.col("__path")))
    blocks = (F.col("__verdict") == "block").alias("blocks")
    rank = F.struct((F.length("__host") + F.length("__path")).alias("n"), F.length("__host").alias("n_host"), blocks, F.concat("__host", "__path").alias("rule"), "__verdict")
    best = fit.groupBy("host", "path").agg(F.max(rank).alias("__best"))
    out = df.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.__verdict", F.lit(default))}).drop("__best")
