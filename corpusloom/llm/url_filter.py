"""URL filter: pattern rules, each kept under its rarest literal token.

A rule is `host/path` with an action. It fits its host and every subdomain if the url's path starts with the rule's
path; `*` stands for any text inside a label or path. A url's tokens (host labels, path segments) fetch the rules kept
under them, and only those run their regular expression. Of the fitting rules the longest wins, then the smallest text.

Rule sets up to MAX_BROADCAST_BYTES go to every executor; larger ones are joined by token, with tokens that many urls ask
for dealt over several tasks. Both ways judge by the same regular expressions in the same engine.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import MAX_BROADCAST_BYTES, ascii_lower


@dataclass(frozen=True)
class Rule:
    text: str
    action: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where `://` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(host: str, path: str) -> set[str]:
    """Host labels as `h.label`, whole path segments as `p/segment`."""
    return {f"h.{x}" for x in host.split(".") if x} | {f"p/{x}" for x in path.split("/") if x}


def literals(rule: str) -> set[str]:
    """The tokens that every url the rule fits must have."""
    host, slash, path = rule.partition("/")
    whole = path.split("/")[:-1]  # the last segment may go on in the url
    return {f"h.{x}" for x in host.split(".") if x and "*" not in x} | {f"p/{x}" for x in whole if x and "*" not in x}


def pattern(rule: str) -> str:
    """The rule as a regular expression over host + path (the first `/` begins the path)."""
    host, slash, path = rule.partition("/")
    inside = "[^./]*".join(re.escape(x) for x in host.split("*"))
    behind = ".*".join(re.escape(x) for x in path.split("*"))
    return f"^(?:[^/]*\\.)?{inside}" + (f"/{behind}" if slash else "(?=/|$)")


class RuleIndex:
    """Rules by rarest literal token, rarity counted over the rules; rules without any are tried for all urls."""

    def __init__(self, rules: Sequence[Rule]):
        rules = sorted(set(rules), key=lambda r: (r.text, r.action))
        found = [literals(r.text) for r in rules]
        count = Counter(t for own in found for t in own)
        self.by_token: dict[str, list[tuple[int, str, str, re.Pattern]]] = {}
        for rule, own in zip(rules, found, strict=True):
            key = min(own, key=lambda t: (count[t], -len(t), t), default="")
            self.by_token.setdefault(key, []).append((-len(rule.text), rule.text, rule.action, re.compile(pattern(rule.text), re.S)))
        self.everywhere = self.by_token.get("", [])

    def rows(self) -> list[tuple[str, str, str, str]]:
        return [(token, rule[1], rule[2], rule[3].pattern) for token, own in self.by_token.items() for rule in own]

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        subject, best = host + path, None
        for own in [self.everywhere, *map(self.by_token.get, tokens(host, path))]:
            for rule in own or ():
                if (best is None or rule[:2] < best[:2]) and rule[3].match(subject):
                    best = rule
        return (None, None) if best is None else best[1:3]


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with `host`, `path`, `rule` (null if none fits) and `verdict` (the rule's action, else `default`).

    A null or broken url has empty host and path. Every row keeps its own verdict, repeated rows too; columns of the
    same names in df are replaced. An empty table or rule set is no special case; urls of any length are judged whole.
    """
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    if sum(2 * len(r.text) + len(r.action) + 500 for r in rules) > max_bytes:
        return _by_join(df, RuleIndex(rules).rows(), default)
    index = df.sparkSession.sparkContext.broadcast(RuleIndex(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        own = index.value
        return pd.DataFrame([own.judge(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"], dtype=object)

    df = df.withColumn("_judged", judge("host", "path"))
    return df.withColumns({"rule": F.col("_judged.rule"), "verdict": F.coalesce(F.col("_judged.verdict"), F.lit(default))}).drop("_judged")


HOT = 50_000  # urls that ask for one token in one task


@functools.lru_cache(maxsize=100_000)
def _compiled(text: str) -> re.Pattern:
    return re.compile(text, re.S)


def _by_join(df: DataFrame, rows: list, default: str) -> DataFrame:
    """The same with the rules as a table: each distinct url is judged once and meets its rules by token.

    Rules without a token meet every url; they are few and go to every executor in blocks of bounded size.
    """
    spark = df.sparkSession
    everywhere, keyed = [r for r in rows if not r[0]], [r for r in rows if r[0]]
    schema = "token string, rule string, action string, pattern string"
    rules = spark.createDataFrame(keyed, schema)
    urls = df.select("host", "path").distinct()
    label = F.transform(F.split("host", "\\."), lambda x: F.concat(F.lit("h."), x))
    segment = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p/"), x))
    asked = urls.withColumn("token", F.explode(F.array_distinct(F.concat(label, segment))))
    times = asked.join(rules.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts"))
    rules = rules.join(times, "token").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.join(times, "token").withColumn("part", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int"))
    met = asked.join(rules.drop("parts"), ["token", "part"]).select("host", "path", "rule", "action", "pattern")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_compiled(x).match(h + p) is not None for h, p, x in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["host", "path", "rule", "action"]).filter(pa.array(keep, pa.bool_()))

    fitting = met.mapInArrow(fits, "host string, path string, rule string, action string")
    for i in range(0, len(everywhere), 100_000):
        block = spark.sparkContext.broadcast(everywhere[i : i + 100_000])

        def lone(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own = sorted(((-len(r), r, action, _compiled(x)) for _, r, action, x in block.value), key=lambda x: x[:3])
            for batch in batches:
                for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    best = next((x for x in own if x[3].match(h + p)), None)
                    if best:
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (h, p, best[1], best[2])], names=["host", "path", "rule", "action"])

        fitting = fitting.unionByName(urls.mapInArrow(lone, "host string, path string, rule string, action string"))
    order = F.struct(-F.length("rule"), "rule", "action")
    best = fitting.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.min(order).alias("_best"))
    joined = df.drop("rule", "verdict").join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return joined.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.action"), F.lit(default))}).drop("_host", "_path", "_best")
