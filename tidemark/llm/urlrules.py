"""URL filter by association rules over URL tokens (operator 3); native expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path) of the fixed rules.
FIXED_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of a labelled transaction; no URL token starts with "=".
BAD, GOOD = "=bad", "=good"


@dataclass(frozen=True)
class Mining:
    """Parameters of the rules: pruned by support, confidence, lift and significance."""

    min_support: float = 0.002
    #: Labelled pages that a rule needs at least, whatever their share.
    min_pages: int = 20
    min_confidence: float = 0.5
    min_lift: float = 1.2
    #: The chance, at most, that any rule at all passes where labels don't depend on URLs.
    max_chance: float = 0.01
    #: Beyond so many rules the index is joined by shuffle instead of broadcast.
    broadcast_rows: int = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = FIXED_RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent of it; else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, path segments and names of query fields.

    Digits are replaced by one ``0``, so that numbered pages share a token.  A null URL has none.
    """
    plain = F.regexp_replace(F.translate(url, _UPPER, _LOWER), "[0-9]+", "0")
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(plain, r"(?s)^(.*?)://", 1)))
    labels = F.transform(F.split(host_of(plain), r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path_of(plain), "/"), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(plain, r"(?s)^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.split(query, "[&;]"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "(?s)^([^=]*)", 1)))
    every = F.concat(scheme, labels, parts, fields)
    kept = F.filter(F.array_distinct(every), lambda x: F.length(x) > 2)
    return F.coalesce(kept, F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(tokens, confidence, lift, post) of the rules from token sets to bad pages; ``post`` is the rarest token.

    A page is labelled by the row of its id: bad if toxic is 1 or quality is 0, where one of
    repeated labels is enough.  Pages without a label, or with a null id, aren't mined.

    All tokens of a URL count.  Those below the support can be in no rule and are left out.  Those
    that the same pages hold are mined as one item, so that a repeated long URL has few subsets; a rule with
    such an item stands for one with each of its tokens, and those with more of them, which say no more, are left out.

    A rule is kept if so many bad pages among its own are too unlikely for a coin of the base rate: n pages of which a share c is bad
    have a chance of at most exp(-n * D), where D is the relative entropy of c and the base rate, and all sets that were counted
    together must stay below ``max_chance``.  Rules of equal confidence are all kept.
    """
    from .common import saved

    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    known = pages.select("page_id", url_tokens(F.col("url")).alias("tokens")).join(marks, "page_id")
    known = saved(known.select(F.monotonically_increasing_id().alias("row"), "tokens", F.when(F.col("bad") == 1, BAD).otherwise(GOOD).alias("mark")))
    total, bads = known.agg(F.count("*"), F.count(F.when(F.col("mark") == BAD, 1))).first()
    least = max(mining.min_pages, mining.min_support * total)
    if not least <= bads < total:
        return pages.sparkSession.createDataFrame([], "tokens array<string>, confidence double, lift double, post string")
    prints = [F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)]
    frequent = saved(known.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *prints).where(F.col("n") >= least))
    alike = frequent.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    joined = F.concat_ws(",", F.transform("members", lambda x: F.hex(x.cast("binary"))))
    # at most as many tokens as an average URL has, divided by the support
    item_of = F.broadcast(saved(alike.select(joined.alias("item"), F.explode("members").alias("token"))))
    parts = known.select("row", F.explode(F.concat("tokens", F.array("mark"))).alias("token")).join(item_of, "token", "left")
    own = F.coalesce("item", F.when(F.col("token").isin(BAD, GOOD), F.col("token")))
    baskets = parts.groupBy("row").agg(F.collect_set(own).alias("items")).select("items")
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=mining.min_confidence).fit(baskets)
    tested = model.freqItemsets.where(~F.array_contains("items", BAD) & ~F.array_contains("items", GOOD)).count()
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & ~F.array_contains("antecedent", GOOD))
    rules = rules.where((F.col("confidence") >= mining.min_confidence) & (F.col("lift") >= mining.min_lift) & (F.size("antecedent") > 0))
    base, c = bads / total, F.col("confidence")
    apart = c * F.log(c / base) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - base))).otherwise(0.0)
    chance = math.log(max(1, tested) / mining.max_chance)
    rules = rules.where((c > base) & (F.col("support") * total / c * apart >= chance))
    none = F.array(F.array().cast("array<string>"))
    grown = lambda sets, item: F.flatten(F.transform(sets, lambda x: F.transform(F.split(item, ","), lambda t: F.array_append(x, F.unhex(t).cast("string")))))
    tokens = F.explode(F.aggregate("antecedent", none, grown))
    rules = rules.select(tokens.alias("tokens"), "confidence", "lift").withColumn("tokens", F.array_sort("tokens"))
    rare = rules.select("tokens", "confidence", "lift", F.explode("tokens").alias("token")).join(F.broadcast(frequent.select("token", "n")), "token")
    return rare.groupBy("tokens", "confidence", "lift").agg(F.min_by("token", F.struct("n", "token")).alias("post"))


def matched(pages: DataFrame, rules: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(url, confidence) of the distinct URLs that hold all tokens of a rule; by the best rule.

    The rules are an inverted index, each under its rarest token: a URL's tokens look up the rules, and
    a rule fires when the URL has all of its other tokens too.
    """
    index = rules.select("confidence", F.col("tokens").alias("need"), F.col("post").alias("token"))
    if index.count() <= mining.broadcast_rows:
        index = F.broadcast(index)
    urls = pages.where("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fired = met.where(F.size(F.array_except("need", "tokens")) == 0)
    return fired.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of every row of (page_id, url).

    A fixed rule decides first; else a page is blocked if a mined rule fires, and
    ``confidence`` is that rule's.  A null URL, or one without ``://``, has an empty host and path, no
    rule, and is allowed unless a mined rule fires.  Repeated rows are judged alike, long URLs whole; without
    labels nothing is mined; other columns are not read.
    """
    from .common import saved

    hits = matched(pages, saved(mine(pages, labels, mining)), mining).withColumnRenamed("url", "_hit")
    # rows without a URL match nothing, and are dealt by their id
    key = F.coalesce("url", F.concat(F.lit("\x00"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = pages.select("page_id", "url", key.alias("_url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.join(hits, (F.col("_url") == F.col("_hit")) & F.col("url").isNotNull(), "left").withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
    own = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", own).alias("verdict"), "confidence")
