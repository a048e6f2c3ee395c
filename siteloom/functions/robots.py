"""robots.txt: rules of the section for all agents, and the longest match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_robots(body: Column) -> Column:
    """array<struct<rule, allow>>; names of directives are matched as written, the last agent line before a rule decides."""
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    none = F.array().cast("array<struct<rule:string,allow:boolean>>")
    rule = lambda x, name, ok: F.struct(F.trim(F.substr(x, F.lit(len(name) + 1))).alias("rule"), F.lit(ok).alias("allow"))

    def step(acc, x):
        agent = x.startswith("User-agent:")
        on = F.when(agent, F.trim(F.substr(x, F.lit(12))) == "*").otherwise(acc["on"])
        found = F.when(x.startswith("Disallow:"), rule(x, "Disallow:", False)).when(x.startswith("Allow:"), rule(x, "Allow:", True))
        take = acc["on"] & found.isNotNull() & (found["rule"] != "")
        return F.struct(on.alias("on"), F.when(F.coalesce(take, F.lit(False)), F.array_append(acc["rules"], found)).otherwise(acc["rules"]).alias("rules"))

    return F.aggregate(lines, F.struct(F.lit(False).alias("on"), none.alias("rules")), step, lambda acc: acc["rules"])


def is_allowed(path: Column, rules: Column) -> Column:
    """The longest prefix decides, a tie allows, no match allows."""
    hits = F.filter(rules, lambda r: path.startswith(r["rule"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def with_allowed(links: DataFrame, robots: DataFrame, site: str = "site", path: str = "path") -> DataFrame:
    """Adds allowed to links; robots(site, body) has a row per site, so each link meets its own site's rules alone."""
    rules = robots.select(F.col("site").alias("_site"), parse_robots(F.col("body")).alias("_rules"))
    joined = links.join(rules, links[site] == rules["_site"], "left")
    return joined.withColumn("allowed", F.coalesce(is_allowed(F.col(path), F.col("_rules")), F.lit(True))).drop("_site", "_rules")
