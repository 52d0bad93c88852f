"""URL filters: pattern rules, each indexed by its rarest literal token.

A rule's tokens are the runs of letters and digits that a matching url must
hold as whole tokens. The one that the fewest urls of the table hold is the
rule's key; a url's tokens fetch the rules under them, and only those run
their regular expression. Rules without a token are tried on every url.

Site rules name a host and a path prefix, fit subdomains too, and the longest
decides. Where none fits, a url is blocked if a pattern rule matches it.

Defined cases: a null url or one without ``://`` has empty host and path and is
judged by patterns only (a null one is allowed); repeated rows each return one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: verdict, host, path
SITES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: ``*`` matches anything, ``^`` one character that is no letter or digit, or the end
PATTERNS = (
    "^ads^", "^adserver^", "^doubleclick^", "^banner^", "^popup^", "^casino^", "^bets^", "^porn^", "^xxx^", "^adult^",
    "^pills^", "^spam^", "^login^", "^cart^", "?*session=", "^track*^click^",
)

#: rules are broadcast up to this many, and joined by shuffle beyond
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    site: bool
    regex: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str) -> Rule:
    whole = re.findall(r"[a-z0-9]+", host.lower())
    inner = re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(host + path, verdict, True, rf"^(?:[^/]*\.)?{_quote(host.lower() + path)}", tuple(whole + [t.lower() for t in inner] if path else whole[:-1]))


def pattern_rule(pattern: str) -> Rule:
    regex = "".join({"*": ".*", "^": "(?:[^a-z0-9]|$)"}.get(c) or _quote(c) for c in pattern.lower())
    tokens = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern.lower())
    return Rule(pattern, "block", False, regex, tuple(tokens))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def url_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return urls.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", path)


def judge_urls(urls: DataFrame, sites=SITES, patterns=PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the first that blocks, by name) of every row of (page_id, url)."""
    spark = urls.sparkSession
    rules = [site_rule(*s) for s in sites] + [pattern_rule(p) for p in patterns]
    parts = url_parts(urls.select("page_id", "url"))
    # equal urls get equal verdicts, so each distinct url is judged once
    texts = parts.where("url is not null").select("url", "host", "path").distinct()
    texts = texts.withColumn("site", F.concat("host", "path")).withColumn("lowered", F.lower("url"))
    tokens = texts.select("url", "site", "lowered", F.explode(F.array_distinct(F.split("lowered", "[^a-z0-9]+"))).alias("token")).where("token <> ''")
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = {r.token: r["count"] for r in tokens.where(F.col("token").isin(wanted)).groupBy("token").count().collect()} if wanted else {}
    schema = "name string, verdict string, is_site boolean, regex string, token string"
    keyed, loose = [], []
    for r in rules:
        row = (r.name, r.verdict, r.site, r.regex)
        (keyed.append((*row, min(r.tokens, key=lambda t: (seen.get(t, 0), t)))) if r.tokens else loose.append(r))
    index = spark.createDataFrame(keyed, schema)
    if len(keyed) <= BROADCAST_RULES:
        index = F.broadcast(index)
    target = F.when(F.col("is_site"), F.col("site")).otherwise(F.col("lowered"))
    hits = tokens.join(index, "token").where(F.rlike(target, F.col("regex"))).select("url", "name", "verdict", "is_site")
    if loose:
        # rules without a token are tried on every url, all of them in one pass
        tried = [F.when((F.col("site") if r.site else F.col("lowered")).rlike(r.regex), F.struct(*[F.lit(v).alias(n) for n, v in (("name", r.name), ("verdict", r.verdict), ("is_site", r.site))])) for r in loose]
        hits = hits.unionByName(texts.select("url", F.explode(F.array_compact(F.array(*tried))).alias("hit")).select("url", "hit.*"))
    best = hits.groupBy(F.col("url").alias("hit_url")).agg(
        F.max(F.when(F.col("is_site"), F.struct(F.length("name").alias("size"), "name", "verdict"))).alias("top"),
        F.min(F.when(~F.col("is_site"), F.col("name"))).alias("pattern"),
    )
    # rows without a url have no rule to look up: in the join they would all meet in one task
    out = parts.where("url is not null").join(best, parts.url == best.hit_url, "left").drop("hit_url")
    none = {f.name: F.lit(None).cast(f.dataType) for f in best.schema.fields if f.name != "hit_url"}
    out = out.unionByName(parts.where("url is null").withColumns(none))
    verdict = F.coalesce(F.col("top.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("top.name").alias("rule"), verdict.alias("verdict"), "pattern")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SITES)
    blocks = ", ".join("('{}', '{}')".format(p, pattern_rule(p).regex.replace("'", "''")) for p in PATTERNS)
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}), patterns(name, regex) AS (VALUES {blocks}),
cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM cut)
SELECT p.page_id, p.host, p.path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)),
    CASE WHEN EXISTS (SELECT 1 FROM patterns WHERE regexp_matches(lower(p.url), regex)) THEN 'block' ELSE 'allow' END) AS verdict,
  (SELECT min(name) FROM patterns WHERE regexp_matches(lower(p.url), regex)) AS pattern
FROM parts p"""


SQL = _sql()
