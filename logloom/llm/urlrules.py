"""URL filtering by pattern rules that are indexed by their rarest literal token, in DataFrame expressions only.

The literal tokens (runs of letters and digits) that every URL it fits must hold are read off a rule's pattern. Among them
the one that the fewest pages hold, counted over all pages, is its index entry; a URL's tokens fetch the rules of those
entries, and only these run their regular expressions; patterns without such a token are tried on every URL. Host rules (a host with all subdomains, and the beginning of a path) decide first,
the longest of them; without one a URL is blocked if a block pattern fits it.

Equal hosts and paths are judged once. Nulls and URLs without `://` have an empty host and path and are allowed; a repeated
row gives a row each time, an empty table none, and a URL of any length is judged whole. Columns named as the results are refused.
"""

from __future__ import annotations

import re
from re import _parser as sre

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host and beginning of the path)
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: (name, pattern over host and path)
BLOCK_PATTERNS = [
    ("gambling-casino", r"^(?:[^/]*[.-])?casino[.-]"),
    ("gambling-bets", r"^(?:[^/]*[.-])?bets[.-]"),
    ("pharmacy", r"^(?:[^/]*\.)?cheap-pills\."),
    ("tracking", r"^(?:[^/]*\.)?ads-track\."),
    ("adult", r"^(?:[^/]*[.-])?(?:xxx)[.-]"),
    ("login-form", r"/(?:wp-login|wp-admin)(?:[./]|$)"),
]
TOKEN_GAP = r"[^0-9a-z\x80-\x{10FFFF}]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(common.lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), TOKEN_GAP), ""))


def is_token(char: int) -> bool:
    return char >= 128 or chr(char).lower() in "0123456789abcdefghijklmnopqrstuvwxyz"


def inlined(nodes) -> list:  # noqa: ANN001
    """A parsed sequence with the contents of its groups in their places."""
    return [x for op, arg in nodes for x in (inlined(arg[3]) if op is sre.SUBPATTERN else [(op, arg)])]


def edge(node: tuple, last: bool) -> tuple[set[str], bool]:
    """What the last (or first) character may be that a node matches, `token`, `gap` or the `end` of the text, and whether it
    may match nothing."""
    op, arg = node
    if op is sre.LITERAL:
        return {"token" if is_token(arg) else "gap"}, False
    if op is sre.IN and all(kind is sre.LITERAL and not is_token(x) for kind, x in arg):
        return {"gap"}, False
    if op is sre.AT and arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END_STRING):
        return {"end"}, False
    if op is sre.AT and arg is sre.AT_END:  # also before a last line feed, which is no token
        return {"end", "gap"}, False
    if op is sre.MAX_REPEAT:
        kinds, empty = edges(inlined(arg[2]), last)
        return kinds, empty or arg[0] == 0
    if op is sre.BRANCH:
        sides = [edges(inlined(x), last) for x in arg[1]]
        return set().union(*(k for k, _ in sides)), any(e for _, e in sides)
    return {"token"}, False  # any other node may match anything


def edges(nodes: list, last: bool) -> tuple[set[str], bool]:
    kinds: set[str] = set()
    for node in reversed(nodes) if last else nodes:
        own, empty = edge(node, last)
        kinds |= own
        if not empty:
            return kinds, False
    return kinds, True


def needed(nodes: list, before: set[str], after: set[str]) -> set[str]:
    """Whole tokens that every match of a sequence holds, with gaps or ends of the text around them."""
    out, i = set(), 0
    while i < len(nodes):
        op, arg = nodes[i]
        j = i
        while j < len(nodes) and nodes[j][0] is sre.LITERAL and is_token(nodes[j][1]):
            j += 1
        stop = max(j, i + 1)
        (left, open_left), (right, open_right) = edges(nodes[:i], True), edges(nodes[stop:], False)
        left, right = left | before if open_left else left, right | after if open_right else right
        if j > i and "token" not in left | right:
            out.add("".join(chr(x) for _, x in nodes[i:j]).lower())
        elif op is sre.BRANCH:
            out |= set.intersection(*(needed(inlined(x), left, right) for x in arg[1]))
        i = stop
    return out


def tokens_of_pattern(pattern: str) -> list[str]:
    """The tokens that a pattern needs; a text in which it is found may go on on either side. Patterns that only Java knows
    have none."""
    try:
        return sorted(needed(inlined(sre.parse(pattern)), {"token"}, {"token"}))
    except re.error:
        return []


def host_rule(verdict: str, rule: str) -> tuple[str, str, list[str], str, bool]:
    """A host rule as a pattern over host and path."""
    return rule, rf"^(?:[^/]*\.)?\Q{rule}\E", tokens_of_pattern(r"^(?:[^/]*\.)?" + re.escape(rule)), verdict, True


def rules_table(spark: SparkSession, host_rules: list[tuple[str, str]] = HOST_RULES, patterns: list[tuple[str, str]] = BLOCK_PATTERNS) -> DataFrame:
    rows = [host_rule(v, r) for v, r in host_rules] + [(n, p, tokens_of_pattern(p), "block", False) for n, p in patterns]
    return spark.createDataFrame(rows, "rule string, pattern string, tokens array<string>, verdict string, by_host boolean")


def indexed(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """rules with `token`, the one of their tokens that the fewest rows of seen (token) hold; of none, it is null."""
    wanted = rules.select("rule", "pattern", "verdict", "by_host", F.explode_outer("tokens").alias("token"))
    counts = seen.join(common.sized(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    counted = wanted.join(counts, "token", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return counted.groupBy("rule", "pattern", "verdict", "by_host").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and the names of block patterns that fit."""
    host, path = host_and_path(F.col(url))
    taken = [c for c in ("host", "path", "rule", "verdict", "patterns") if c in pages.columns]
    if taken:
        raise ValueError(f"columns {taken} are the result's own; rename them first")
    pages = pages.withColumns({"host": host, "path": path})
    places = pages.select("host", "path").distinct()
    held = places.select("host", "path", F.explode_outer(tokens_of(F.concat("host", "path"))).alias("token"))
    index = common.table(indexed(rules, held.select("token").where("token is not null")), "url-rules")
    fetched = held.join(common.sized(index.where("token is not null")), "token").select("host", "path", "rule", "pattern", "verdict", "by_host")
    fit = fetched.where(F.regexp(F.concat("host", "path"), F.col("pattern"))).drop("pattern")
    everywhere = index.where("token is null").collect()  # of the given rules, those without a token; one expression for each
    if everywhere:
        tried = [F.when(F.regexp(F.concat("host", "path"), F.lit(r["pattern"])), F.struct(*(F.lit(r[c]).alias(c) for c in ("rule", "verdict", "by_host")))) for r in everywhere]
        always = places.select("host", "path", F.explode_outer(F.array_compact(F.array(*tried))).alias("r")).where("r is not null")
        fit = fit.unionByName(always.select("host", "path", "r.rule", "r.verdict", "r.by_host"))
    rule = F.max(F.when(F.col("by_host"), F.struct(F.length("rule").alias("n"), "rule", "verdict")))
    names = F.array_sort(F.collect_set(F.when(~F.col("by_host"), F.col("rule"))))
    found = fit.groupBy("host", "path").agg(rule.alias("best"), names.alias("patterns"))
    out = pages.join(found, ["host", "path"], "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.size("patterns") > 0, "block").otherwise("allow"))
    return out.withColumns({"rule": F.col("best.rule"), "verdict": verdict}).drop("best")


def op4(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), rules_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = lambda rule: f"regexp_matches(host, '(^|\\.){re.escape(rule.split('/')[0])}$') AND starts_with(path, '/{rule.split('/', 1)[1]}')"
    longest = sorted(HOST_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest)
    patterns = " OR ".join(f"regexp_matches(host || path, '{p}')" for _, p in BLOCK_PATTERNS)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{common.UPPER}', '{common.UPPER.lower()}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict FROM h
"""


ORACLE = _oracle()
