"""URL filtering by rules: a list of host and path rules first, then mined ones.

Spark's FP-growth mines, from labelled URLs, which combinations of URL tokens go
with bad pages. Rules below a support, confidence or lift go. What is left is matched
by an inverted index: each rule stands under its rarest token, a URL asks for the
rules of the tokens it has, and a rule that has all its tokens there blocks.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import settle

BAD = "label=bad"
#: (verdict, host, path) in force before any mined rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    named = F.regexp_extract(_after_scheme(url), r"(?s)\A([^/?#]*)", 1)
    return F.coalesce(F.translate(named, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, sorted: domain (last two labels), further host labels, path segments, names of query fields, fragment. Segments with a digit name single pages and are none."""
    h, p, behind = host(url), path(url), F.coalesce(_after_scheme(url), F.lit(""))
    labels = F.split(h, r"\.")
    query = F.split(F.regexp_extract(behind, r"\?([^#]*)", 1), "&")
    parts = F.concat(
        F.array(F.concat(F.lit("d="), F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."))),
        F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("h="), x)),
        F.transform(F.filter(F.split(p, "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p="), x)),
        F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1))),
        F.transform(F.filter(F.array(F.regexp_extract(behind, "(?s)#(.*)", 1)), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("f="), x)),
    )
    return F.array_sort(F.array_distinct(parts))


def mine(labelled: DataFrame, *, min_support: float = 0.002, min_count: int = 25, min_confidence: float = 0.9, min_lift: float = 1.5) -> DataFrame:
    """(antecedent, support, confidence, lift) of rules that end in BAD. labelled: (tokens, bad boolean), one row for each labelled URL.

    min_support is a share of the labelled rows, so the number of frequent token sets
    follows the share and not the number of rows; min_count keeps small tables from
    making rules of single pages.
    """
    baskets = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    n = baskets.count()
    if n < min_count:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, support double, confidence double, lift double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    return found.select(F.array_sort("antecedent").alias("antecedent"), "support", "confidence", "lift")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the distinct token sets (column tokens) in which a rule has all its tokens."""
    spread = rules.select("antecedent", F.explode("antecedent").alias("token"))
    often = spread.groupBy("token").agg(F.count("*").alias("often"))
    index = spread.join(often, "token").groupBy("antecedent").agg(F.min(F.struct("often", "token"))["token"].alias("token"))
    asked = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    return asked.where(F.size(F.array_except("antecedent", "tokens")) == 0).select("tokens").distinct()


def judge(pages: DataFrame, labelled: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, **mining: float) -> DataFrame:
    """(id_col, host, path, rule, mined, verdict) for every page; the listed rule's verdict, else block where a mined rule matches, else allow.

    mined: whether a mined rule matches the URL, listed or not.

    labelled: (url, bad boolean), rows without either go. A null URL, or one without "://",
    has an empty host and path and is judged like any other. Repeated rows are judged each;
    empty tables give empty results, and without labels nothing is mined. Other columns
    are not read.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    learnt = labelled.where("url is not null and bad is not null").select(tokens(F.col("url")).alias("tokens"), "bad")
    blocked = settle(matched(rows.select("tokens").distinct(), settle(mine(learnt, **mining), "url-rules")), "url-blocked").withColumn("hit", F.lit(True))
    listed = rule(F.col("host"), F.col("path"), rules)
    rows = rows.join(blocked, "tokens", "left").withColumn("listed", listed)
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    mined = F.coalesce("hit", F.lit(False)).alias("mined")
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("listed.rule").alias("rule"), mined, verdict.alias("verdict"))


def listed_urls(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """(url, bad) of every URL: bad where the listed rules block it. What no rule names counts as good, so
    only combinations that hardly any good URL has become rules, and these reach the URLs that no rule names."""
    url = pages[url_col].cast("string")
    listed = rule(host(url), path(url), rules)
    return pages.where(url.isNotNull()).select(url.alias("url"), F.coalesce(listed["verdict"] == "block", F.lit(False)).alias("bad"))


SQL = r"""
WITH cut AS (SELECT page_id, url, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS b FROM pages),
named AS (SELECT page_id, url, b, translate(regexp_extract(b, '(?s)\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(b, '(?s)\A[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed AS (SELECT *, string_split(host, '.') AS labels FROM named),
tokened AS (SELECT *, list_sort(list_distinct(
    ['d=' || array_to_string(labels[greatest(len(labels) - 1, 1):len(labels)], '.')]
    || list_transform(labels[1:greatest(len(labels) - 2, 0)], lambda x: 'h=' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'p=' || x)
    || list_transform(list_filter(string_split(regexp_extract(b, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'q=' || string_split(x, '=')[1])
    || list_transform(list_filter([regexp_extract(b, '(?s)#(.*)', 1)], lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'f=' || x))) AS tokens FROM listed),
named_by AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM tokened),
learnt AS (SELECT tokens, coalesce(rule IN ('example.com/en/', 'net/es/', 'net/fr/'), false) AS bad FROM named_by WHERE url IS NOT NULL),
size AS (SELECT count(*) AS n, count(*) FILTER (bad) AS bad FROM learnt),
subsets AS (SELECT list_transform(list_filter(generate_series(1, len(tokens)), lambda i: (mask >> (i - 1)::INTEGER) & 1 = 1), lambda i: tokens[i]) AS items, bad FROM learnt, unnest(generate_series(1, (1 << len(tokens)::INTEGER) - 1)) m(mask)),
rules AS (SELECT items FROM subsets, size GROUP BY items, size.n, size.bad
  HAVING size.n >= 25 AND count(*) FILTER (subsets.bad) >= ceil(greatest(0.002::DOUBLE, 25::DOUBLE / size.n) * size.n) AND (count(*) FILTER (subsets.bad))::DOUBLE / count(*) >= 0.9
    AND (count(*) FILTER (subsets.bad))::DOUBLE / count(*) / (size.bad::DOUBLE / size.n) >= 1.5),
hits AS (SELECT DISTINCT tokens, true AS hit FROM tokened WHERE EXISTS (SELECT 1 FROM rules WHERE list_has_all(tokens, items))),
judged AS (SELECT n.*, coalesce(h.hit, false) AS mined FROM named_by n LEFT JOIN hits h ON h.tokens = n.tokens)
SELECT page_id, host, path, rule, mined,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mined THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
