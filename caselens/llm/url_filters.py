"""2. URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IN_PLAN = 200  # rules that go into the plan as a literal index; more of them are joined


@dataclass(frozen=True)
class Rule:
    """pattern is searched in host + path, and only if all literal tokens stand there; the longest named rule wins."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None
    rank: int = 0


def host_rule(verdict: str, name: str) -> Rule:
    """A rule such as example.net/en/: the host or a subdomain of it, with a path that starts like this."""
    return Rule(rf"^(?:[^/]*\.)?{re.escape(name)}", tuple(t for t in re.split(r"[^a-z0-9]+", name) if t), verdict, name, len(name))


#: The rules of the query.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Patterns for urls that no host rule fits; any match blocks.
PATTERNS = (
    Rule(r"(?:^|[./-])spam-[a-z0-9-]*\.", ("spam",), "block"),
    Rule(r"(?:^|[./-])casino-[a-z0-9-]*\.", ("casino",), "block"),
    Rule(r"(?:^|\.)ads-track\.", ("ads", "track"), "block"),
)
RULES = (*(host_rule(*r) for r in HOST_RULES), *PATTERNS)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """The rules by the literal token of theirs that the fewest urls have, counted over all urls."""
    words = sorted({t for r in rules for t in r.tokens})
    if not words:
        return {}
    # one pass with one counter a token; tokens come from the rules, in blocks of a fixed size
    count = {}
    for i in range(0, len(words), 500):
        block = words[i : i + 500]
        got = urls.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, block)))).alias("t")).groupBy("t").count().collect()
        count |= {r["t"]: r["count"] for r in got}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), t)), []).append(r)
    return index


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", in_plan: int = IN_PLAN) -> DataFrame:
    """One row for each input row: page_id, host, path, rule, verdict.

    A url's tokens (runs of a-z and 0-9 of host and path) fetch the rules indexed under them, and
    only those run their pattern. The named rule of the highest rank gives rule and verdict; without one, rule
    is null, and any other pattern that matches gives its verdict (block before allow), else the default.
    Null urls and those without :// have empty host and path, and get the default. Repeated rows and ids stay as they are.
    """
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    urls = urls.withColumn("tokens", F.array_distinct(F.filter(F.split(F.lower(subject), "[^a-z0-9]+"), lambda t: t != "")))
    bare = [r for r in rules if not r.tokens]
    index = rarest(urls, tuple(r for r in rules if r.tokens))
    rows = [(t, r.pattern, r.verdict, r.name, r.rank) for t, rs in index.items() for r in rs]
    shape = "array<struct<token: string, pattern: string, verdict: string, name: string, rank: int>>"
    if len(rules) <= in_plan:
        literal = lambda rs: F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("token", "pattern", "verdict", "name", "rank")))) for r in rs)).cast(shape)
        pairs = [x for t in index for x in (F.lit(t), literal([r for r in rows if r[0] == t]))]
        fetched = F.flatten(F.transform(F.filter("tokens", lambda t: F.array_contains(F.array(*map(F.lit, index)), t)), lambda t: F.try_element_at(F.create_map(*pairs), t))) if pairs else F.array().cast(shape)
        fetched = F.concat(fetched, literal([("", r.pattern, r.verdict, r.name, r.rank) for r in bare])) if bare else fetched
        judged = urls.withColumn("s", subject).withColumn("fetched", fetched).withColumn("hits", F.expr("filter(fetched, r -> s rlike r.pattern)"))
    else:
        # too many for the plan: distinct host-path pairs meet the rules in a join on the token
        table = urls.sparkSession.createDataFrame(rows + [(None, r.pattern, r.verdict, r.name, r.rank) for r in bare], "token string, pattern string, verdict string, name string, rank int")
        keyed = urls.select("host", "path", "tokens").distinct().select("host", "path", F.explode("tokens").alias("token"))
        met = keyed.join(table, "token").where("concat(host, path) rlike pattern")
        # a pair's hits are bounded by the rules
        hits = met.groupBy("host", "path").agg(F.collect_list(F.struct("token", "pattern", "verdict", "name", "rank")).alias("hits"))
        judged = urls.join(hits, ["host", "path"], "left")
        for r in bare:
            judged = judged.withColumn("hits", F.when(F.concat("host", "path").rlike(r.pattern), F.concat(F.coalesce("hits", F.array().cast(shape)), F.array(F.struct(F.lit("").alias("token"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).cast("string").alias("name"), F.lit(r.rank).alias("rank"))).cast(shape))).otherwise(F.col("hits")))
    judged = judged.withColumn("best", F.expr("array_max(transform(filter(hits, r -> r.name is not null), r -> named_struct('rank', r.rank, 'name', r.name, 'verdict', r.verdict)))"))
    other = F.expr("array_max(transform(filter(hits, r -> r.name is null), r -> r.verdict))")  # block sorts after allow
    return judged.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", other, F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLE_SQL = {
    "op2_url_filters": r"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r as (
  select page_id, host, path,
         case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
              when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
              when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
              when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from p
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when regexp_matches(host || path, '(^|[./-])(spam|casino)-[a-z0-9-]*\.') or regexp_matches(host || path, '(^|\.)ads-track\.') then 'block'
            else 'allow' end as verdict
from r"""
}
