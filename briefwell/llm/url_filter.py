"""URL filters: fixed host and path rules, then association rules mined from labelled URLs. DataFrame operations and FP-growth only."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path prefix)
UrlRule = tuple[str, str, str]
#: URLs with the same items are dealt to this many salted keys when their outcome is joined back.
SALTS = 32


def url_host(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of host, path and query names, told apart by a prefix; numbers are left out."""
    host = F.transform(F.split(url_host(url), "[.:]"), lambda x: F.concat(F.lit("host:"), x))
    path = F.transform(F.split(F.lower(url_path(url)), "[^\\p{L}\\p{N}]+"), lambda x: F.concat(F.lit("path:"), x))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query:"), F.lower(x)))
    return F.array_distinct(F.filter(F.concat(host, path, query), lambda x: ~x.rlike(":[0-9]*$")))


def listed_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null. A rule fits its host and all subdomains if the path starts with its path."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fit = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    found = F.array(*[F.when(fit(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))])
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _with_items(rows: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """(key, items): the sorted distinct items of each row of (key, tokens); rows without one are left out."""
    each = rows.select(key, F.explode("tokens").alias("token")).join(F.broadcast(items), "token")
    return each.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _contained(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (with ``items``) joined to each of the ``rules`` (with ``needs``) all of whose items they hold.

    Rules sit in an inverted index under their rarest item (by how many rules and sets hold it), so a set meets only
    rules one of whose rarest items it has; the other items are then tested on its own array.
    """
    each = rules.select("rule_id", F.explode("needs").alias("item"))
    held = each.select("rule_id", "item").unionByName(sets.select(F.lit(None).cast("long").alias("rule_id"), F.explode("items").alias("item")))
    frequent = held.groupBy("item").agg(F.count("*").alias("n"))
    rarest = each.join(frequent, "item").groupBy("rule_id").agg(F.min(F.struct("n", "item"))["item"].alias("item"))
    index = rules.join(rarest, "rule_id")
    return sets.withColumn("item", F.explode("items")).join(index, "item").filter(F.size(F.array_except("needs", "items")) == 0).drop("item")


def mine_block_rules(urls: DataFrame, labels: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, min_known: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The items (token, item) and the rules (rule_id, needs, bad, support, confidence, known) that mark URLs as unwanted.

    ``urls``: (id, url); ``labels``: (id, bad boolean). Tokens that occur in just the same URLs are one item:
    a rule asks for one token of each of its items, which is what all the rules over single tokens come to. FP-growth
    runs over the items of bad URLs only; what it finds is then counted in the others. Kept are the itemsets that
    ``min_support`` of all labelled URLs hold and are bad by, and of whose labelled URLs ``min_confidence`` are bad. Labels
    need not be a fair sample: where hardly any URL that a rule matches is labelled, its confidence says nothing. So a rule
    must also be ``known``: the share of labelled URLs among all it matches is at least ``min_known`` times that share among all URLs. At most
    (tokens of a URL) / ``min_support`` tokens are that frequent, which bounds the items that tasks are sent. Null
    labels are left out; without labelled or without bad rows there are no items and no rules.
    """
    spark = urls.sparkSession
    joined = urls.join(labels.filter(F.col("bad").isNotNull()), "id", "left").select(F.monotonically_increasing_id().alias("basket"), url_tokens(F.col("url")).alias("tokens"), "bad")
    baskets = materialize(joined, "url-baskets")
    n_all, n, n_bad = baskets.agg(F.count("*"), F.count("bad"), F.count(F.when(F.col("bad"), 1))).first()
    least = max(1, math.ceil(n * min_support - 1e-9))
    # Two sums of hash halves and the count tell the set of baskets of a token.
    half = lambda bits: F.sum(F.shiftrightunsigned(F.shiftleft(F.xxhash64("basket"), 32 - bits), 32))
    of_token = baskets.select("basket", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("m"), F.count(F.when(F.col("bad"), 1)).alias("m_bad"), half(0).alias("s"), half(32).alias("t"))
    frequent = materialize(of_token.filter(F.col("m_bad") >= least), "url-tokens")
    items = materialize(frequent.join(frequent.groupBy("m", "s", "t").agg(F.min("token").alias("item")), ["m", "s", "t"]).select("token", "item"), "url-items")
    if not n_bad or items.isEmpty():
        return items, spark.createDataFrame([], "rule_id long, needs array<string>, bad long, support double, confidence double, known double")
    found = materialize(_with_items(baskets, "basket", items).join(baskets.select("basket", "bad"), "basket"), "url-itemsets")
    bad = found.filter("bad").select("items").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    mined = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / bad.count()), minConfidence=1.0).fit(bad).freqItemsets
    sets = materialize(mined.select(F.array_sort("items").alias("needs"), F.col("freq").alias("bad")).withColumn("rule_id", F.xxhash64("needs")), "url-frequent")
    others = found.filter(~F.coalesce("bad", F.lit(False))).groupBy("items").agg(F.count("bad").alias("g"), F.count(F.when(F.col("bad").isNull(), 1)).alias("u"))
    met = _contained(others, sets).groupBy("rule_id").agg(F.sum("g").alias("good"), F.sum("u").alias("unknown"))
    rules = sets.join(met, "rule_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "unknown")})
    labelled = F.col("bad") + F.col("good")
    is_known = labelled * n_all * 100 >= (labelled + F.col("unknown")) * n * round(min_known * 100)  # in whole numbers
    rules = rules.filter(is_known).select("rule_id", "needs", "bad", (F.col("bad") / F.lit(n)).alias("support"), (F.col("bad") / labelled).alias("confidence"), (labelled / (labelled + F.col("unknown"))).alias("known"))
    return items, materialize(rules.filter(F.col("confidence") >= min_confidence), "url-rules")


def matched_rules(urls: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_items, mined_confidence) for each distinct URL that some rule matches: the rule of highest confidence, then fewest items, then first items in order.

    URLs with the same items are judged once; the outcome comes back by salted keys, as very many may have the same.
    """
    own = _with_items(urls.select("url").distinct().select("url", url_tokens(F.col("url")).alias("tokens")), "url", items)
    own = materialize(own, "url-own-items")
    met = _contained(own.select("items").distinct(), rules)
    best = met.groupBy("items").agg(F.max_by(F.struct("needs", "confidence"), F.struct("confidence", -F.size("needs"), F.col("bad"), F.col("rule_id"))).alias("m"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    return own.join(best, ["items", "salt"]).select("url", F.col("m.needs").alias("mined_items"), F.col("m.confidence").alias("mined_confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """Every row with host, path, rule, verdict (allow or block), mined_items, mined_confidence.

    A listed rule decides; where none fits, a page is blocked if a mined rule matches its URL, else allowed. A null URL
    has an empty host and path, no tokens, and is allowed. Repeated rows repeat and count in mining as often as they are
    labelled. Other columns are not read. ``labels``: (id, bad).
    """
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    urls = own.select(F.col("_id").alias("id"), F.col("_url").alias("url")).filter(F.col("url").isNotNull())
    found = matched_rules(urls, *mine_block_rules(urls, labels, **mining)).withColumnRenamed("url", "_key")
    joined = own.join(found, own["_url"] == found["_key"], "left")
    judged = joined.withColumn("host", url_host(F.col("_url"))).withColumn("path", url_path(F.col("_url")))
    judged = judged.withColumn("_rule", listed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("mined_items").isNotNull(), "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "mined_items", "mined_confidence")


def listed_labels(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Labels (id, bad) of the pages that a listed rule decides: bad if it blocks."""
    found = listed_rule(url_host(F.col(url_col)), url_path(F.col(url_col)), rules)["verdict"]
    return pages.select(F.col(id_col).alias("id"), (found == "block").alias("bad")).filter(F.col("bad").isNotNull())
