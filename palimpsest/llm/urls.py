"""URL filter: allow and block rules by host and path, then association rules over URL tokens.

mine_rules(labelled) runs Spark's FP-growth over the token sets of labelled urls, each with its label as one more
item, and keeps the rules {tokens} -> block and {tokens} -> allow, of any number of tokens, that pass support and
confidence: of the urls with the tokens, MIN_LIFT times as many must have the verdict as of all. judge(urls, fixed, mined)
matches both kinds of rule natively: a mined rule is indexed under its rarest token only, a url looks up its tokens there,
and the rest of the rule is then checked on the url's own token array. Of the mined rules that fit, the one of highest
lift decides; of equal ones allow.

Tokens of a url: label=<host label>, dir=<path segment, digits as #>, ext=<file ending>, key=<query key>.

Defined cases. Null url or no "://": host and path are empty, no fixed rule fits, the method's verdict is allow, as
it has no tokens. Repeated urls: judged once per distinct token set, every row returned. Several fixed rules: the
longest host + path wins; ties: allow before block. No labels: no mined rules, all allow. Labels of one kind only: no rule has a lift above 1, all allow. Very long
urls: all their tokens count.
Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import literal_table, saved, skew_join, table

# Verdict, host, path.
FIXED_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Share of labelled urls, and their number, that must hold a rule's tokens and the verdict, and how much more frequent than
#: among all urls the verdict must be among those.
MIN_SUPPORT, MIN_COUNT, MIN_LIFT = 0.005, 20, 1.35


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]"""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tokens_of(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda x: x != "")
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), x))
    every = F.concat(
        named("label", labels),
        named("dir", segments),
        named("ext", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        named("key", keys),
    )
    return F.coalesce(F.when(host != "", F.array_sort(F.array_distinct(every))), F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT) -> DataFrame:
    """labelled: url, blocked boolean. Returns items array<string>, verdict, confidence, lift, n (labelled urls) of
    {items} -> verdict, and token, the rarest item."""
    tagged = labelled.where("blocked is not null").select(tokens_of(F.col("url")).alias("tokens"), F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))
    baskets = saved(tagged.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"), "verdict"), "baskets")
    counts = {r["verdict"]: r["count"] for r in baskets.groupBy("verdict").count().collect()}
    n = sum(counts.values())
    least = max(min_support * n, min_count)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(n, 1) * (1 - 1e-9))).fit(baskets)
    found = saved(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    verdicts = F.filter("items", lambda x: x.startswith("verdict="))
    sets = found.where(F.size(verdicts) == 0).select("items", F.col("freq").alias("with_items"))
    both = found.where((F.size(verdicts) == 1) & (F.size("items") > 1)).select(F.array_except("items", verdicts).alias("items"), F.substring_index(verdicts[0], "=", -1).alias("verdict"), F.col("freq").alias("n"))
    share = F.when(F.col("verdict") == "block", F.lit(counts.get("block", 0) / max(n, 1))).otherwise(F.lit(counts.get("allow", 0) / max(n, 1)))
    rules = both.join(sets, "items").select("items", "verdict", (F.col("n") / F.col("with_items")).alias("confidence"), "n")
    rules = rules.withColumn("lift", F.col("confidence") / share).where((F.col("lift") >= min_lift) & (F.col("n") >= least))
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("with_items").alias("held"))
    rarest = rules.select("items", "verdict", F.explode("items").alias("token")).join(single, "token").groupBy("items", "verdict").agg(F.min_by("token", F.struct("held", "token")).alias("token"))
    return saved(rules.join(rarest, ["items", "verdict"]).select("items", "verdict", "confidence", "lift", "n", "token"), "rules")


def judge(urls: DataFrame, fixed: DataFrame, mined: DataFrame) -> DataFrame:
    """urls: page_id, url. Returns page_id, host, path, rule (host/path of the fixed rule, or null), verdict,
    confidence (of the mined rule of highest lift that fits, or null)."""
    tokens = tokens_of(F.col("url"))
    seen = saved(urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens.alias("tokens"), F.to_json(tokens).alias("kind")), "urls")
    # Mined rules: by distinct token sets, so that a hot host is looked up once per kind of url.
    sets = saved(seen.where(F.size("tokens") > 0).select("kind", "tokens").distinct().select("kind", "tokens", F.explode("tokens").alias("token")), "kinds")
    rules = mined.select("token", "items", "lift", "confidence", F.col("verdict").alias("mined"))
    hit = skew_join(sets, rules, "token", "kind").where(F.size(F.array_except("items", "tokens")) == 0)
    hit = hit.groupBy("kind").agg(F.max(F.struct("lift", (F.col("mined") == "allow").alias("allow"), "confidence", "mined")).alias("best_mined"))
    # Fixed rules: a host suffix equals the rule's host, the path starts with the rule's path. Few distinct hosts need a look-up.
    fixed = fixed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    hosts = seen.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("rule_host"))
    of_host = hosts.join(fixed, "rule_host").groupBy("host").agg(F.collect_set(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"))).alias("rules"))
    seen = skew_join(skew_join(seen, hit, "kind", "page_id", "left").drop("kind", "tokens"), of_host, "host", "page_id", "left")
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    best = F.element_at(F.array_sort(fits, lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"]).when(a["verdict"] < b["verdict"], -1).when(a["verdict"] > b["verdict"], 1).otherwise(0)), 1)
    out = seen.withColumn("best", F.when(F.size(F.coalesce(fits, F.array().cast("array<struct<size:int,verdict:string,rule:string,path:string>>"))) > 0, best))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "best_mined.mined", F.lit("allow")).alias("verdict"), F.col("best_mined.confidence").alias("confidence"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page; rules are mined from pages whose id has a label: low quality or toxic means block."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    fixed = literal_table(spark, ("verdict", "host", "path"), FIXED_RULES)
    return judge(pages, fixed, mine_rules(pages.join(labels, "page_id")))


QUERIES = {"op7_url_rules": op7_url_rules}
ORACLE_SQL = {
    "op7_url_rules": r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) ELSE '' END AS path FROM pages),
raw_ AS (
  SELECT page_id, 'label=' AS kind, unnest(string_split(host, '.')) AS x FROM p
  UNION ALL SELECT page_id, 'dir=', unnest(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/')) FROM p
  UNION ALL SELECT page_id, 'ext=', regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) FROM p
  UNION ALL SELECT page_id, 'key=', string_split(k, '=')[1] FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS k FROM p) q),
token AS (SELECT DISTINCT page_id, kind || x AS t FROM raw_ JOIN p USING (page_id) WHERE x <> '' AND host <> ''),
known AS (SELECT p.page_id, quality = 0 OR toxic = 1 AS blocked FROM p JOIN labels ON doc_id = p.page_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
bag AS (SELECT page_id, list(t ORDER BY t) AS ts FROM token GROUP BY page_id),
combo AS (
  SELECT list_filter(ts, lambda t, i: (m >> (i - 1)) & 1 = 1) AS items, blocked
  FROM (SELECT ts, blocked, unnest(range(1, (1::BIGINT << len(ts)))) AS m FROM bag JOIN known USING (page_id))),
counted AS (SELECT items, blocked, count(*) AS n FROM combo GROUP BY items, blocked),
rule AS (
  SELECT items, CASE WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, n / sum(n) OVER (PARTITION BY items) AS confidence, n,
    (SELECT count(*) FILTER (WHERE k.blocked = counted.blocked) / count(*) FROM known k) AS share FROM counted),
good AS (SELECT items, verdict, confidence, confidence / share AS lift FROM rule WHERE n >= greatest(0.005 * (SELECT count(*) FROM known), 20) AND confidence / share >= 1.35),
hit AS (
  SELECT page_id, arg_max(verdict, (lift, CASE verdict WHEN 'allow' THEN 1 ELSE 0 END, confidence)) AS mined, arg_max(confidence, (lift, CASE verdict WHEN 'allow' THEN 1 ELSE 0 END, confidence)) AS confidence
  FROM bag JOIN good ON list_has_all(ts, items) GROUP BY page_id),
fixed(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN fixed ON (host = h OR suffix(host, '.' || h)) AND prefix(path, q) GROUP BY page_id)
SELECT p.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule, coalesce(best.verdict, mined, 'allow') AS verdict, hit.confidence
FROM p LEFT JOIN best USING (page_id) LEFT JOIN hit USING (page_id)""",
}
