"""URL filter by association rules.

A list of (host, path) rules judges the urls that it fits: a rule fits its host and all
subdomains if the url's path starts with the rule's; the longest fitting rule wins. Its
verdicts label those urls. From them Spark's FP-growth mines the token combinations that go
with a verdict; combinations below ``MIN_SUPPORT`` (share of the labelled urls that hold the
tokens and have the verdict) or ``MIN_CONFIDENCE`` are pruned, so are those that a part of
their tokens predicts with no less confidence.

The mined rules judge the other urls through an inverted index, token -> rules: the tokens of
a url are joined to the index and a rule matches if all its tokens were met. Urls with the
same tokens are matched once. The best match (confidence, support, fewer tokens, then the
tokens' order) gives the verdict; without a match it is ``DEFAULT``.

A url has at most nine tokens by construction, so frequent combinations are bounded by the
support; what FP-growth brings to the driver are frequent single tokens, at most 9 / MIN_SUPPORT.

Defined results: a url that is null or has no "://" has empty host and path and only the
tokens of an empty url; repeated rows and null page_ids each return a row; without labelled
urls every other verdict is DEFAULT; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohort.llm.common import cut

#: (host, path, verdict), fixed by the contract
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.005, 0.7, "allow"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, tokens)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = pages.select(F.col("page_id").cast("long").alias("page_id"),
                      F.translate(F.when(at > 0, F.substr(url, F.lit(1), at - 1)).otherwise(""), upper, lower).alias("scheme"),
                      F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower).alias("host"),
                      F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"), rest.alias("rest"))
    names = F.split("host", "\\.")
    first = F.regexp_extract("path", "^/([^/]*)", 1)
    ext = F.regexp_extract("path", r"[.]([a-z0-9]{1,5})\z", 1)
    key = F.regexp_extract("rest", "^[^?#]*[?]([^=&#]*)", 1)
    tokens = F.array(F.concat(F.lit("scheme="), "scheme"),
                     F.concat(F.lit("tld="), F.element_at(names, -1)),
                     F.when(F.size(names) > 1, F.concat(F.lit("dom="), F.element_at(names, -2), F.lit("."), F.element_at(names, -1))),
                     F.when(F.size(names) > 2, F.concat(F.lit("sub="), F.element_at(names, 1))),
                     F.when((first != "") & ~first.rlike("^[0-9]+([.]|\\z)"), F.concat(F.lit("dir="), first)),
                     F.when(ext != "", F.concat(F.lit("ext="), ext)),
                     F.when((F.length("path") > 1) & F.endswith("path", F.lit("/")), F.lit("slash")),
                     F.when(key != "", F.concat(F.lit("query="), key)),
                     F.when(F.contains("rest", F.lit("#")), F.lit("fragment")))
    return df.select("page_id", "host", "path", F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("tokens"))


def listed(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and listed: the longest fitting rule and its verdict, or nulls."""
    rule = listed_ = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, listed_ = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(listed_)
    return urls.withColumn("rule", rule).withColumn("listed", listed_)


def mined(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The pruned rules (rule_id, antecedent, verdict, confidence, support) mined from urls (tokens, listed)."""
    from pyspark.ml.fpm import FPGrowth
    label = F.concat(F.lit("verdict="), "listed")
    labelled = urls.where("listed IS NOT NULL").select(F.concat("tokens", F.array(label)).alias("items"))
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return urls.sparkSession.createDataFrame([], f"rule_id long, {schema}")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled)
    found = (model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit("verdict=")))
             .select(F.array_sort("antecedent").alias("antecedent"), F.expr("substring(consequent[0], 9)").alias("verdict"), "confidence", "support"))
    found = cut(found)
    # a rule goes if a proper part of its tokens has the verdict with no less confidence
    part = found.select(F.explode("antecedent").alias("token"), F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    worse = (found.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
             .join(part, ["token", "verdict"])
             .where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("of_part") >= F.col("confidence")))
             .select("antecedent", "verdict").distinct())
    left = found.join(worse, ["antecedent", "verdict"], "left_anti")
    return left.withColumn("rule_id", F.xxhash64("antecedent", "verdict"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict, antecedent) for the distinct token sets of urls that a mined rule matches."""
    index = rules.select(F.explode("antecedent").alias("token"), "rule_id", F.size("antecedent").alias("needs"), "verdict", "confidence", "support", "antecedent")
    sets = urls.select("tokens").distinct()
    met = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
           .groupBy("tokens", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("needs", "verdict", "confidence", "support", "antecedent")).alias("r"))
           .where(F.col("n") == F.col("r.needs")))
    best = F.min(F.struct((-F.col("r.confidence")).alias("c"), (-F.col("r.support")).alias("s"), F.col("r.needs"), F.concat_ws(" ", "r.antecedent").alias("a"), F.col("r.verdict")))
    return met.groupBy("tokens").agg(best.alias("b")).select("tokens", F.col("b.verdict").alias("verdict"), F.col("b.a").alias("antecedent"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """The contract's columns: page_id, host, path, rule, verdict; and mined_rule, the tokens that decided."""
    urls = cut(listed(parsed(pages), rules))
    best = matched(urls.where("listed IS NULL"), mined(urls)).select(F.col("tokens"), F.col("verdict").alias("guess"), F.col("antecedent").alias("by"))
    known = urls.where("listed IS NOT NULL").select("page_id", "host", "path", "rule", F.col("listed").alias("verdict"), F.lit(None).cast("string").alias("mined_rule"))
    guessed = urls.where("listed IS NULL").join(best, "tokens", "left").select("page_id", "host", "path", "rule", F.coalesce("guess", F.lit(DEFAULT)).alias("verdict"), F.col("by").alias("mined_rule"))
    return known.unionByName(guessed)


def oracle() -> str:
    """The same result by DuckDB: all token combinations of the labelled urls are counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    by = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f + f"'{h}{p}'" for f, (h, p, _) in zip(fits, by)) + " END"
    verdict = "CASE " + " ".join(f + f"'{v}'" for f, (_, _, v) in zip(fits, by)) + " END"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
b AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(substr(url, 1, pos - 1), '{upper}', '{lower}') ELSE '' END AS scheme,
             CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM a),
c AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, string_split(host, '.') AS names, regexp_extract(path, '^/([^/]*)', 1) AS dir1, regexp_extract(path, '[.]([a-z0-9]{{1,5}})\\z', 1) AS ext,
             regexp_extract(rest, '^[^?#]*[?]([^=&#]*)', 1) AS qkey, {rule} AS rule, {verdict} AS listed FROM c),
e AS (SELECT row_number() OVER () AS rid, page_id, host, path, rule, listed, list_sort(list_distinct(list_filter([
        'scheme=' || scheme, 'tld=' || names[-1],
        CASE WHEN len(names) > 1 THEN 'dom=' || names[-2] || '.' || names[-1] END,
        CASE WHEN len(names) > 2 THEN 'sub=' || names[1] END,
        CASE WHEN dir1 <> '' AND NOT regexp_matches(dir1, '^[0-9]+([.]|\\z)') THEN 'dir=' || dir1 END,
        CASE WHEN ext <> '' THEN 'ext=' || ext END, CASE WHEN length(path) > 1 AND ends_with(path, '/') THEN 'slash' END,
        CASE WHEN qkey <> '' THEN 'query=' || qkey END, CASE WHEN contains(rest, '#') THEN 'fragment' END], lambda x: x IS NOT NULL))) AS tokens FROM d),
t AS (SELECT tokens, listed, count(*) AS cnt FROM e WHERE listed IS NOT NULL GROUP BY ALL),
s AS (SELECT list_filter(tokens, lambda x, i: ((mask >> (i - 1)) & 1) = 1) AS ante, listed, cnt FROM (SELECT *, unnest(range(1, 1 << len(tokens))) AS mask FROM t)),
g AS (SELECT ante, sum(cnt) AS n, coalesce(sum(cnt) FILTER (listed = 'allow'), 0) AS n_allow, coalesce(sum(cnt) FILTER (listed = 'block'), 0) AS n_block FROM s GROUP BY ante),
f AS (SELECT ante, 'allow' AS verdict, n_allow AS k, n_allow::DOUBLE / n AS conf FROM g UNION ALL SELECT ante, 'block', n_block, n_block::DOUBLE / n FROM g),
r AS (SELECT * FROM f WHERE k >= greatest(1, ceil({MIN_SUPPORT}::DOUBLE * (SELECT count(*) FROM e WHERE listed IS NOT NULL))) AND conf >= {MIN_CONFIDENCE}::DOUBLE),
p AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.verdict = r.verdict AND len(q.ante) < len(r.ante) AND list_has_all(r.ante, q.ante) AND q.conf >= r.conf)),
m AS (SELECT s.rid, p.verdict, array_to_string(p.ante, ' ') AS by_, row_number() OVER (PARTITION BY s.rid ORDER BY p.conf DESC, p.k DESC, len(p.ante), array_to_string(p.ante, ' ')) AS o
      FROM e s JOIN p ON list_has_all(s.tokens, p.ante) WHERE s.listed IS NULL)
SELECT page_id, host, path, rule, coalesce(listed, m.verdict, '{DEFAULT}') AS verdict, m.by_ AS mined_rule
FROM e LEFT JOIN m ON e.rid = m.rid AND m.o = 1"""
