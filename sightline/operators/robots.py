"""Robots policies: parsing, and replaying them over requested paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RULES = "policy STRING, agent STRING, allow BOOLEAN, pattern STRING, regex STRING, specificity INT, line INT"


def path_regex(pattern: str) -> tuple[str, int]:
    """The regular expression of a rule's path, and its specificity: its bytes without wildcards and end mark."""
    body = pattern[:-1] if pattern.endswith("$") else pattern
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + ("$" if pattern.endswith("$") else ""), len(body.replace("*", "").encode())


def parse_policy(text: str, policy: str = "policy") -> list[tuple]:
    """Rules of one robots file as rows of rule_table: consecutive agent lines share the rules that follow."""
    rows: list[tuple] = []
    agents: list[str] = []
    open_agents = False
    for number, raw in enumerate(re.split(r"\r\n?|\n", text), 1):
        field, colon, value = raw.partition("#")[0].strip().partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not open_agents:
                agents, open_agents = [], True
            if value:
                agents.append(value.lower())
        elif field in ("allow", "disallow") and (agents or open_agents):
            open_agents = False
            if not value.startswith("/"):
                rows += [(policy, a, None, None, None, None, number) for a in agents]
                continue
            expression, specificity = path_regex(value)
            rows += [(policy, a, field == "allow", value, expression, specificity, number) for a in agents]
    return rows


def rule_table(spark: SparkSession, policies: dict[str, str]) -> DataFrame:
    """Rules of named robots files; an agent with no usable rule keeps one row with a null pattern."""
    return spark.createDataFrame([r for name, text in policies.items() for r in parse_policy(text, name)], _RULES)


def fetch_state(status: Column) -> Column:
    """What a robots file's response means: `rules` (2xx, they hold), `redirect` (3xx, to be followed), `allow-all` (4xx), `deny-all` (anything else, null included)."""
    return F.when(status.between(200, 299), "rules").when(status.isin(301, 302, 303, 307, 308), "redirect").when(status.between(400, 499), "allow-all").otherwise("deny-all")


def replay(paths: DataFrame, tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(policy, token, path, allowed, pattern, line): what each policy says of each crawler's paths.

    `paths` has token and path; `tokens` token. A crawler obeys the groups whose agent its token contains, else those
    of *. The most specific matching rule holds, an allow rule before a disallow rule of equal length; without a matching rule
    the path is allowed, as is /robots.txt. Policies and tokens are reference lists and are broadcast.
    """
    policies = rules.select("policy").distinct()
    named = rules.where("agent <> '*'")
    pairs = tokens.select("token").distinct().join(F.broadcast(named.select("policy", "agent").distinct()), F.contains(F.lower("token"), F.col("agent"))).select("policy", "token", "agent")
    star = tokens.select("token").distinct().join(F.broadcast(policies)).join(pairs.select("policy", "token").distinct(), ["policy", "token"], "left_anti").select("policy", "token", F.lit("*").alias("agent"))
    own = pairs.unionByName(star).join(rules, ["policy", "agent"], "left")
    per_token = own.groupBy("policy", "token").agg(F.collect_set(F.when(F.col("pattern").isNotNull(), F.struct("specificity", "allow", "pattern", "line", "regex"))).alias("rules"))
    asked = paths.where("token IS NOT NULL AND path IS NOT NULL").select("token", "path").distinct().join(F.broadcast(per_token), "token")
    hits = F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["specificity"], r["allow"], (-r["line"]).alias("first"), r["pattern"].alias("pattern"))))
    out = asked.withColumn("_b", F.when(F.col("path") != "/robots.txt", best))
    return out.select("policy", "token", "path", F.coalesce(F.col("_b.allow"), F.lit(True)).alias("allowed"), F.col("_b.pattern").alias("pattern"), (-F.col("_b.first")).alias("line"))


def compare_replays(replayed: DataFrame, baseline: str, current: str) -> DataFrame:
    """(token, path, change): newly-blocked, newly-allowed, rule-change or unchanged between two policies."""
    side = lambda p, n: replayed.where(F.col("policy") == p).select("token", "path", F.col("allowed").alias(f"{n}_allowed"), F.col("pattern").alias(f"{n}_pattern"))
    both = side(baseline, "b").join(side(current, "c"), ["token", "path"], "full")
    change = F.when(F.col("b_allowed") & ~F.col("c_allowed"), "newly-blocked").when(~F.col("b_allowed") & F.col("c_allowed"), "newly-allowed").when(~F.col("b_pattern").eqNullSafe(F.col("c_pattern")), "rule-change").otherwise("unchanged")
    return both.select("token", "path", change.alias("change"))
