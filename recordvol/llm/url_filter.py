"""URL filters: pattern rules found through the rarest literal token of each rule.

A rule is written for a host and a path prefix. Its literal tokens are whole host labels and
whole path segments. How often each of these occurs in the URLs is counted, the rarest one
becomes the rule's index token, and a URL only runs the regular expressions of rules whose
index token it contains. Everything is a DataFrame expression; no Python runs on executors.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and
gets the default verdict; repeated rows are judged one by one; an empty table gives no rows;
columns of the input are never read except the URL, so clashing names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules the index is a literal inside the plan; beyond it is a table that is joined.
MAX_INLINE_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """`action` for `host`, its subdomains and paths that start with `path`."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Java regular expression over host + path."""
        quoted = "\\Q" + self.name.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return "(?s)^(?:[^/]*\\.)?" + quoted

    @property
    def tokens(self) -> list[str]:
        """Whole labels and segments, which every URL that fits must contain."""
        segments = self.path.split("/")[1:-1]  # what follows the last slash may be part of a segment
        return sorted({f"h:{x}" for x in self.host.split(".")} | {f"p:{x}" for x in segments})


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring_index(F.get(F.split(url, "://", 2), F.lit(1)), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + 1)
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and path segments, marked with where they stand."""
    return F.array_distinct(
        F.concat(
            F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x)),
        )
    )


def rarest_tokens(judged: DataFrame, rules: Sequence[Rule]) -> dict[Rule, str]:
    """For each rule its token that the fewest URLs contain, ties to the smaller token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    hits = judged.select(F.explode(F.array_intersect("_rv_tokens", F.lit(wanted))).alias("token"))
    counts = {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}  # tokens of rules only
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules if r.tokens}


def _fitting(candidates: Column, text: Column) -> Column:
    """The longest rule among the candidates whose expression fits; a block wins an exact tie."""
    fits = F.filter(candidates, lambda c: F.regexp_like(text, c["pattern"]))
    return F.get(F.sort_array(fits, asc=False), F.lit(0))


def _as_literal(rule: Rule) -> Column:
    return F.struct(
        F.lit(len(rule.name)).alias("size"), F.lit(rule.action).alias("action"), F.lit(rule.name).alias("rule"), F.lit(rule.pattern).alias("pattern")
    )


def judge(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", inline: int = MAX_INLINE_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to pages (columns of these names are replaced).

    Up to `inline` rules ride in the plan as a map from index token to rules: one narrow stage
    without a shuffle, so a host with a third of all rows costs nothing extra. More rules become
    a table joined on the token of each URL, in which only distinct (host, path) pairs take part.
    """
    rules = sorted({r for r in rules}, key=lambda r: (r.name, r.action))
    host, path = split_url(F.col(url))
    out = pages.withColumns({"_rv_host": host, "_rv_path": path})
    out = out.withColumn("_rv_tokens", url_tokens(F.col("_rv_host"), F.col("_rv_path")))
    index = rarest_tokens(out, rules)
    text = F.concat("_rv_host", "_rv_path")
    if len(rules) <= inline:
        found = _inline(rules, index, text)
        out = out.withColumn("_rv_rule", found)
    else:
        out = _joined(out, rules, index, text)
    out = out.drop("host", "path", "rule", "verdict")
    return out.withColumns(
        {
            "host": F.col("_rv_host"),
            "path": F.col("_rv_path"),
            "rule": F.col("_rv_rule")["rule"],
            "verdict": F.coalesce(F.col("_rv_rule")["action"], F.lit(default)),
        }
    ).drop("_rv_host", "_rv_path", "_rv_tokens", "_rv_rule")


def _inline(rules: Sequence[Rule], index: dict[Rule, str], text: Column) -> Column:
    by_token: dict[str, list[Rule]] = {}
    for r in rules:
        by_token.setdefault(index.get(r, ""), []).append(r)
    always = by_token.pop("", [])
    none = F.filter(F.array(_as_literal(Rule("", "", ""))), lambda c: F.lit(False))  # empty, of the right type
    parts = [F.array(*map(_as_literal, always))] if always else []
    if by_token:
        items = [x for t, rs in sorted(by_token.items()) for x in (F.lit(t), F.array(*map(_as_literal, rs)))]
        table = F.create_map(*items)
        known = F.array_intersect("_rv_tokens", F.lit(sorted(by_token)))
        parts.append(F.flatten(F.transform(known, lambda t: F.element_at(table, t))))
    return _fitting(F.concat(*parts) if parts else none, text)


def _joined(out: DataFrame, rules: Sequence[Rule], index: dict[Rule, str], text: Column) -> DataFrame:
    """The same through a join: each distinct URL meets the rules of its tokens, and the best rule comes back."""
    spark = out.sparkSession
    rows = [(index.get(r, "*"), len(r.name), r.action, r.name, r.pattern) for r in rules]
    table = spark.createDataFrame(rows, "token string, size int, action string, rule string, pattern string")
    rule = F.struct("size", "action", "rule", "pattern")
    urls = out.select("_rv_host", "_rv_path", "_rv_tokens").distinct()
    tokens = F.explode(F.array_append("_rv_tokens", F.lit("*"))).alias("token")
    best = (
        urls.select("_rv_host", "_rv_path", tokens)
        .join(table, "token")
        .where(F.regexp_like(text, F.col("pattern")))
        .groupBy("_rv_host", "_rv_path")
        .agg(F.max(rule).alias("_rv_rule"))
    )
    return out.join(best, ["_rv_host", "_rv_path"], "left")


def compiled(rules: Iterable[Rule]) -> list[re.Pattern]:
    """The same expressions for Python callers, as used by the tests."""
    return [re.compile(r"(?s)^(?:[^/]*\.)?" + re.escape(r.name)) for r in rules]
