"""URL filter: a rule list first, then association rules mined from labels.

Host and path are cut out of the url; the longest fitting rule of the list decides.  For
the other pages, FP-growth mines combinations of url tokens (host labels, top
domain, first path segment, scheme, parameter names) with a bad label over the
labelled pages.  A combination has to stand on at least ``LEAST_COUNT`` bad pages and on ``MIN_SUPPORT`` of them,
so the support follows the bad pages, however few of all pages they are.  Before mining, tokens on too
few bad pages go, since no rule can hold them, and tokens that stand on exactly the same labelled pages
(such as the many parameter names of one site) become one item: their combinations say the same and
would be exponentially many.  Rules are pruned by support, confidence and lift, and by shorter
rules that say the same.  An inverted index from token to rules matches
them: distinct token sets are joined to it token by token, and a rule fires where as many
items hit as it has.  A page is blocked if a mined rule fires, else allowed.

Labels are those of the document with the page's identifier: bad if quality is
0 or toxic is 1.  All of it is DataFrame code and Spark's own FP-growth.

Defined results.  A null url or one without ``://`` has empty host and path, no rule
and verdict allow.  Null and repeated page_id values are passed on, one result per row.
Repeated labels count as bad if one of them is.  Urls of any length are read whole.  Rules of equal confidence (ties) all
count; of those that imply each other the shorter stays.  An empty table gives an empty result; without labels nothing is mined.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import staged

# The rule list, verdict by host and path prefix.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Least share of the bad labelled pages, and least number of them, that a rule stands on.
MIN_SUPPORT = 0.02
LEAST_COUNT = 5
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.5
BAD = "\x01bad"
#: Up to so many token sets in which a rule fires (some hundred bytes each) are broadcast.
BROADCAST_SETS = 50_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# Fixed value: host and path after the first "://".
CUT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, CUT, 1), _UPPER, _UPPER.lower()), F.regexp_extract(text, CUT, 2)


def listed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a domain above it, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, sorted; empty where there is no host."""
    labels = F.split(host, r"\.")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^#?]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    first = F.regexp_extract(path, r"^/+([^/]+)", 1)
    every = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.array(F.concat(F.lit("t:"), F.element_at(labels, -1)), F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        F.when(first != "", F.array(F.concat(F.lit("p:"), first))).otherwise(F.array().cast("array<string>")),
        names,
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def mine(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_no, tokens, confidence, support, lift) for bad pages, pruned, and the
    members (item, token) of the items that stand in their tokens.

    pages has page_id and tokens.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = pages.sparkSession
    none = spark.createDataFrame([], "rule_no long, tokens array<string>, confidence double, lift double, support double")
    truth = (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
        .where("bad is not null")
    )
    rows = pages.where(F.size("tokens") > 0).join(truth, F.col("page_id").cast("long") == F.col("id"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), "bad", "tokens"), "baskets")
    size = rows.agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).first()
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    least = max(LEAST_COUNT, int(-(-MIN_SUPPORT * (size["bad"] or 0) // 1)))
    if (size["bad"] or 0) < least:
        return none, spark.createDataFrame([], "item string, token string")
    # Two hashes of the set of pages tell whether two tokens stand on the same ones.
    seen = each.groupBy("token").agg(
        F.count("*").alias("n"), F.sum("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(7))).alias("b")
    ).where(F.col("n_bad") >= least)
    items = seen.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    members = staged(seen.join(items, ["n", "a", "b"]).select("item", "token"), "items")
    chosen = each.join(members.where("item = token").select("token"), "token").groupBy("row").agg(F.collect_list("token").alias("x"))
    some = F.coalesce("x", F.array().cast("array<string>"))
    baskets = staged(rows.select("row", "bad").join(chosen, "row", "left").select(F.when(F.col("bad") == 1, F.array_append(some, F.lit(BAD))).otherwise(some).alias("items")), "baskets")
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / size["n"], minConfidence=MIN_CONFIDENCE).fit(baskets).associationRules
    rules = found.where(F.array_contains("consequent", BAD) & (F.col("lift") >= MIN_LIFT)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support"
    )
    rules = staged(rules, "rules")
    # A rule goes where a rule with fewer of the same tokens is as sure: joined on the
    # first token that they share, not on everything.
    one = rules.select(F.col("tokens").alias("t"), F.col("confidence").alias("c"), F.explode("tokens").alias("x"))
    less = rules.select(F.col("tokens").alias("u"), F.col("confidence").alias("d"), F.get("tokens", F.lit(0)).alias("x"))
    implied = one.join(less, "x").where((F.size("u") < F.size("t")) & (F.size(F.array_except("u", "t")) == 0) & (F.col("d") >= F.col("c")))
    kept = rules.join(implied.select(F.col("t").alias("tokens")).distinct(), "tokens", "left_anti")
    return kept.select(F.xxhash64("tokens").alias("rule_no"), "tokens", "confidence", "lift", "support"), members


def fired(pages: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """The distinct token sets in which a rule fires, by an inverted index."""
    index = rules.select("rule_no", F.size("tokens").alias("size"), F.explode("tokens").alias("item")).join(members, "item")
    sets = pages.select("tokens").distinct().where(F.size("tokens") > 0)
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").select("tokens", "rule_no", "size", "item").distinct()
    counted = hits.groupBy("tokens", "rule_no", "size").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") == F.col("size")).select("tokens").distinct()


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (whether a mined rule fired)."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", listed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    found, members = mine(rows, labels)
    mined = staged(found, "mined")
    if mined.isEmpty():
        rows = rows.withColumn("mined", F.lit(False))
    else:
        hit = staged(fired(rows, mined, members), "fired").withColumn("hit", F.lit(True))
        few = hit.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
        rows = rows.join(F.broadcast(hit) if few else hit, "tokens", "left").withColumn("mined", F.coalesce("hit", F.lit(False)))
    listed = F.lit(None).cast("string")
    for rule, verdict in rules:
        listed = F.when(F.col("rule") == rule, verdict).otherwise(listed)
    verdict = F.coalesce(listed, F.when(F.col("mined"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined")
