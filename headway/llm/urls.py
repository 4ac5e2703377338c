"""URL filters: listed rules for hosts and paths, and association rules that Spark's FP-growth mines from labels.

A listed rule (host, path) fits its host and all its subdomains where the URL's path starts with the rule's; the longest
that fits decides. Other URLs are judged by mined rules: token combinations that, among labelled URLs, come with bad ones
often enough (support) and mostly (confidence). A mined rule that holds a smaller one of no less confidence is left out.
Mined rules stand in an inverted index under their rarest token; distinct token sets of URLs look up their tokens there
and check the whole rule. Everything is built of DataFrame operations and Spark's own FP-growth.

Defined cases: a null URL, or one without "://", has an empty host and path and no tokens, and is allowed. Rows are kept as
they are, repeated ones and those with a null page_id too; an empty table gives no rows; other columns are ignored. Long URLs are
read whole. Without labels nothing is mined. Equally long listed rules that fit one URL are the same rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import stage, table

#: (host, path, verdict) of the listed rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Mined rules hold so many tokens at most, and come with so many bad labelled URLs at least: a number of rows, and a part of all.
TOKENS, ROWS, SUPPORT = 3, 20, 0.001
#: The part of the labelled URLs with a rule's tokens that must be bad.
CONFIDENCE = 0.8
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first "://" and the next "/", "?" or "#", A-Z lower-cased, and the path up to "?" or "#"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """rule and verdict of the longest listed rule that fits, null if none does. The list is a parameter, so it stands in the plan."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted: scheme, host labels, path segments with digits as one sign, query parts, fragment."""
    at = F.instr(url, "://")
    host, path = host_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#([\s\S]*)", 1)
    kind = lambda k, parts: F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(F.lit(f"{k}:"), t))
    parts = [
        kind("scheme", F.array(F.translate(F.substring(url, F.lit(1), at - 1), _UPPER, _LOWER))), kind("host", F.split(host, r"\.")),
        kind("path", F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "0"))), kind("query", F.split(query, "&")), kind("fragment", F.array(fragment)),
    ]
    return F.when(at > 0, F.array_sort(F.array_distinct(F.concat(*parts)))).otherwise(F.array().cast("array<string>"))


def article(url: Column) -> Column:
    """The number that a page's path gives for its article: its first digits after a slash, null if there are none."""
    digits = F.regexp_extract(host_path(url)[1], "/([0-9]{1,18})", 1)
    return F.when(digits != "", digits).cast("long")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and bad of each page whose article has a label; of low quality or toxic in any of its labels is bad."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("article")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    urls = pages.select(article(F.col("url")).alias("article"), tokens(F.col("url")).alias("tokens"))
    return urls.where("article IS NOT NULL").join(known, "article").select("tokens", "bad")


def mined(rows: DataFrame, size: int = TOKENS, least: int = ROWS, part: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule (sorted tokens), confidence and anchor of each mined rule, from rows of tokens and bad."""
    rows = stage(rows)
    n = rows.count()
    spark = rows.sparkSession
    none = spark.createDataFrame([], "rule array<string>, confidence double, anchor string")
    if not n or least > n:
        return none
    items = rows.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    # half a row less, so that rounding doesn't ask for one more
    model = FPGrowth(itemsCol="items", minSupport=max(part, (least - 0.5) / n), minConfidence=confidence).fit(items)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.size("antecedent") <= size))
    found = stage(found.select(F.array_sort("antecedent").alias("rule"), "confidence"))
    return stage(pruned(found, rows))


def pruned(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Rules that hold no smaller rule of no less confidence, each with its rarest token (then the least) as its anchor."""
    # a rule of so few tokens has few subsets: they are looked up by their text
    whole = found.withColumn("key", _key("rule"))
    parts = whole.select("key", F.col("confidence").alias("own"), F.explode(_subsets(F.col("rule"))).alias("part")).select("key", "own", _key("part").alias("part"))
    smaller = whole.select(F.col("key").alias("part"), "confidence")
    beaten = parts.join(smaller, "part").where("confidence >= own").select("key").distinct()
    kept = whole.join(beaten, "key", "left_anti")
    common = rows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    rare = kept.select("key", F.explode("rule").alias("token")).join(common, "token").groupBy("key").agg(F.min_by("token", F.struct("count", "token")).alias("anchor"))
    return kept.join(rare, "key").select("rule", "confidence", "anchor")


def _key(column: str) -> Column:
    return F.concat_ws("\x01", column)


def _subsets(rule: Column) -> Column:
    """Proper, non-empty subsets of a sorted array, each picked by the bits of a number."""
    masks = F.sequence(F.lit(1), F.greatest(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(rule)) - 2))
    pick = lambda m: F.filter(rule, lambda t, i: F.getbit(m.cast("long"), i) == 1)
    return F.when(F.size(rule) > 1, F.transform(masks, pick)).otherwise(F.array().cast("array<array<string>>"))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """key and the most confident rule (then the shortest, then by its text) of each token set, from key and tokens: an
    inverted index of the rules' rarest tokens, and a check of the whole rule."""
    met = sets.select("key", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor").where(F.size(F.array_except("rule", "tokens")) == 0)
    return met.groupBy("key").agg(F.min_by("rule", F.struct(-F.col("confidence"), F.size("rule"), F.col("rule"))).alias("mined"))


def judged(pages: DataFrame, rules: DataFrame, fixed=RULES) -> DataFrame:
    """page_id, url, host, path, rule, mined and verdict of each page. Token sets are matched once, however many pages share
    one; what matched is joined back to the pages that no listed rule decides."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", listed(F.col("host"), F.col("path"), fixed))
    rows = rows.withColumn("key", F.when(F.col("fit").isNull(), F.concat_ws("\x01", tokens(F.col("url")))))
    sets = rows.where("key <> ''").groupBy("key").agg(F.lit(1).alias("one")).select("key", F.split("key", "\x01").alias("tokens"))
    # pages that a listed rule decides are not dealt out: their key would be one
    out = rows.where("key IS NOT NULL").join(matched(sets, rules), "key", "left").unionByName(rows.where("key IS NULL").withColumn("mined", F.lit(None).cast("array<string>")))
    verdict = F.coalesce("fit.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), "mined", verdict.alias("verdict"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the listed rule that fits its URL, and the verdict: that rule's, else the mined rules'."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mined(labelled(pages, table(spark, sf_dir, "labels")))
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same, with all combinations of up to three tokens of each labelled URL counted."""
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    at = "instr(url, '://')"
    kind = lambda k, parts: f"list_transform(list_filter({parts}, lambda t: t <> ''), lambda t: '{k}:' || t)"
    fixed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""WITH u AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(CASE WHEN {at} > 0 THEN substring(url, {at} + 3) END, '') AS rest FROM pages),
      p AS (SELECT r, page_id, url, {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
      t AS MATERIALIZED (SELECT *, CASE WHEN {at} > 0 THEN list_sort(list_distinct(list_concat({kind('scheme', f"[{lower.format(f'substring(url, 1, {at} - 1)')}]")}, {kind('host', "string_split(host, '.')")},
        {kind('path', "list_transform(string_split(path, '/'), lambda s: regexp_replace(s, '[0-9]+', '0', 'g'))")}, {kind('query', "string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&')")},
        {kind('fragment', "[regexp_extract(url, '#([\\s\\S]*)', 1)]")}))) ELSE [] END AS tokens FROM p),
      l AS MATERIALIZED (SELECT t.r, tokens, bad FROM t JOIN (SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id) k
        ON k.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT)),
      one AS MATERIALIZED (SELECT r, bad, unnest(tokens) AS x FROM l),
      sets AS (SELECT [x] AS rule, bad FROM one UNION ALL SELECT [a.x, b.x], a.bad FROM one a JOIN one b ON a.r = b.r AND a.x < b.x
        UNION ALL SELECT [a.x, b.x, c.x], a.bad FROM one a JOIN one b ON a.r = b.r AND a.x < b.x JOIN one c ON c.r = b.r AND b.x < c.x),
      rules AS MATERIALIZED (SELECT rule FROM sets GROUP BY rule HAVING count(*) FILTER (bad) >= greatest({ROWS}, ceil({SUPPORT}e0 * (SELECT count(*) FROM l)))
        AND count(*) FILTER (bad) / CAST(count(*) AS DOUBLE) >= {CONFIDENCE}e0),
      f AS (SELECT r, max_by(v, length(h || q)) AS v, max_by(h || q, length(h || q)) AS rule FROM t, (VALUES {fixed}) AS x(h, q, v) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r),
      m AS (SELECT DISTINCT t.r FROM t, rules WHERE list_has_all(t.tokens, rules.rule))
      SELECT page_id, host, path, f.rule, coalesce(f.v, CASE WHEN m.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM t LEFT JOIN f USING (r) LEFT JOIN m ON m.r = t.r"""


QUERIES = {"op12_url_rules": op12_url_rules}
ORACLES = {"op12_url_rules": _sql()}
