"""URL filtering: fixed rules for hosts and paths, then association rules mined from labelled URLs.

FP-growth mines combinations of URL tokens that go with the bad label; rules below a confidence or support are pruned,
and so are those of which a part is as confident. Each rule is filed under its rarest token, and a URL meets only the
rules filed under one of its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import BROADCAST_ROWS, reliable, small, table

#: Fixed rules (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: A mined rule holds for so many bad URLs at least, however many are labelled (a caller may ask for a part of all labelled
#: ones besides), and its confidence is at least this even at the lower end of an interval of so many deviations: many
#: combinations are tried, and labels that do not depend on URLs must not make one.
MIN_CONFIDENCE, MIN_COUNT, MIN_SUPPORT, DEVIATIONS = 0.6, 20, 0.0, 3.0
#: Combinations that bad URLs may have on average, and in all besides, before FP-growth leaves those of less support to
#: the search that skips what cannot be a rule. The rules are the same either way.
COMBINATIONS, COMBINATIONS_BESIDES = 4096, 1 << 20
#: The label's item; no token begins with this character.
BAD = "!bad"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits, as written, and its verdict; null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host and the last two together, segments of the path with digits as 0,
    the last segment's ending, keys of the query, and if there is a fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    steps = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    ending = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "^([A-Za-z]+)://", 1))),
        F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
        F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))),
        F.transform(steps, lambda x: F.concat(F.lit("step:"), x)),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def lower_confidence(bad: Column, n: Column, z: float = DEVIATIONS) -> Column:
    """The lower end of Wilson's interval for the share of bad ones."""
    p = bad / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _filed(sets: DataFrame, items: DataFrame, m: int) -> DataFrame:
    """Sets of items (tokens) with key, their rarest item, and all, their items' tokens."""
    rarest = (
        sets.select("tokens", F.explode("tokens").alias("item")).join(small(items.select("item", "n", "members"), m), "item")
        .groupBy("tokens").agg(F.min(F.struct("n", "item")).alias("m"), F.collect_list("members").alias("all")).select("tokens", F.col("m.item").alias("key"), "all")
    )
    return reliable(sets.join(rarest, "tokens"))


def _grouped(baskets: DataFrame) -> DataFrame:
    return baskets.groupBy("items").agg(F.count("*").alias("_n"))


def _counted(sets: DataFrame, baskets: DataFrame, name: str) -> DataFrame:
    """How many of the baskets (items, _n) have all of a set's items; a basket meets the sets filed under its items."""
    filed = small(sets.select("tokens", "key"), sets.count())
    return (
        baskets.select("items", "_n", F.explode("items").alias("key")).join(filed, "key")
        .filter(F.size(F.array_except("tokens", "items")) == 0).groupBy("tokens").agg(F.sum("_n").alias(name))
    )


def _grown(bad: DataFrame, good: DataFrame, items: DataFrame, m: int, need: int) -> Iterator[DataFrame]:
    """Frequent itemsets (tokens, bad) of two items, of three and so on, without those that cannot be rules.

    A rule is more confident than each of its parts, so every part of it is in some good URL and is in fewer URLs than
    the part's own parts are: else the item that makes no difference would make none in the rule either. A set is
    counted only if all its parts are such, which drops no rule and no part of one.
    """
    # few baskets may meet many sets: they are dealt over all cores
    cores = items.sparkSession.sparkContext.defaultParallelism
    bad, good = (reliable(_grouped(x).repartition(cores)) for x in (bad, good))
    pairs = bad.select(F.explode("items").alias("a"), "items", "_n").select("a", F.explode("items").alias("b"), "_n").filter("a < b")
    sets = pairs.groupBy("a", "b").agg(F.sum("_n").alias("bad")).filter(F.col("bad") >= need).select(F.array("a", "b").alias("tokens"), "bad")
    before = items.select(F.array("item").alias("tokens"), "n")
    while True:
        sets = _filed(sets, items, m)
        yield sets.select("tokens", "bad")
        counted = sets.join(_counted(sets, good, "good"), "tokens").withColumn("n", F.col("bad") + F.col("good"))
        parts = counted.select(F.col("tokens").alias("_whole"), "n", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("tokens"))
        same = parts.join(before.select("tokens", F.col("n").alias("_part")), "tokens").filter("n = _part").select(F.col("_whole").alias("tokens"))
        open_ = reliable(counted.join(same, "tokens", "left_anti").select("tokens", "n"))
        if open_.isEmpty():
            return
        k = F.size("tokens")
        ends = open_.select(F.slice("tokens", F.lit(1), k - 1).alias("head"), F.element_at("tokens", -1).alias("last"))
        two = ends.join(ends.select("head", F.col("last").alias("other")), "head").filter("last < other").select(F.concat("head", F.array("last", "other")).alias("_whole"))
        parts = two.select("_whole", F.explode(F.transform("_whole", lambda x: F.array_remove("_whole", x))).alias("tokens"))
        whole = parts.join(open_, "tokens").groupBy("_whole").agg(F.count("*").alias("_n")).filter(F.size("_whole") == F.col("_n"))
        sets = _filed(whole.select(F.col("_whole").alias("tokens")), items, m)
        sets = sets.join(_counted(sets, bad, "bad").filter(F.col("bad") >= need), "tokens").select("tokens", "bad")
        before = open_


def _combinations(bad: DataFrame, good: DataFrame, items: DataFrame, m: int, need: int) -> DataFrame:
    """Itemsets (tokens, bad) of two and more items with need bad URLs: all that are rules, and all parts of these.

    bad and good are the baskets (items) of bad and other URLs. A basket of w frequent items has 2**w combinations.
    FP-growth asks for as much support, need or more, as leaves a bounded number of them on average; sets of less support
    are then grown item by item. Which way a set is found changes no rule.
    """
    own = reliable(bad)
    rows = own.count()
    steps = [need << k for k in range(0, max(1, rows // need).bit_length())]
    counts = own.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    tall = own.withColumn("at", F.monotonically_increasing_id()).select("at", F.explode("items").alias("item"))
    some = reliable(counts.filter(F.col("n") >= need))
    widths = tall.join(small(some, some.count()), "item").groupBy("at").agg(*(F.count_if(F.col("n") >= t).alias(f"w{k}") for k, t in enumerate(steps)))
    sums = widths.agg(*(F.coalesce(F.sum(F.pow(F.lit(2.0), f"w{k}")), F.lit(0.0)).alias(f"w{k}") for k in range(len(steps)))).first()
    least = next((t for k, t in enumerate(steps) if sums[k] <= COMBINATIONS * rows + COMBINATIONS_BESIDES), None)
    found = []
    if least:
        mined = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, rows))).fit(own).freqItemsets
        found.append(mined.filter(F.size("items") > 1).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad")))
    if least != need:
        found.extend(x.filter(F.col("bad") < (least or 1 << 62)) for x in _grown(own, good, items, m, need))
    return reduce(DataFrame.unionByName, found)


def mine(labelled: DataFrame, tokens_col: str = "tokens", bad_col: str = "bad", support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, count: int = MIN_COUNT) -> DataFrame:
    """Rules (tokens, confidence, support, all, key) that predict the bad label, for each key of a rule a row.

    A rule needs count bad URLs (and support of all labelled ones, if asked for), so every token of it has as many.
    Itemsets are therefore mined from the bad URLs' tokens that do, and are then counted in the other URLs. Tokens that
    are in the same labelled URLs are one item under the smallest one's name: a rule with two of them says no more than
    one with either, and all has a rule's items as lists of tokens, of each of which a URL needs one. A token of bad URLs
    only leaves nothing to add, so it is in no combination; a rule with a part that is as confident is left out. A rule
    is filed under the tokens of its rarest item.
    """
    own = reliable(labelled.select(F.col(tokens_col).alias("tokens"), F.col(bad_col).alias("bad")).withColumn("at", F.monotonically_increasing_id()))
    n, n_bad = own.agg(F.count("*"), F.count_if("bad")).first()
    need = max(1, count, math.ceil(support * n))
    seen = own.select("at", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    same = [F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("at")).alias("h"), F.bit_xor(F.xxhash64("at", F.lit(1))).alias("h2")]
    by = seen.groupBy("token").agg(*same).filter(F.col("n_bad") >= need)
    items = reliable(by.groupBy("n", "n_bad", "h", "h2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")))
    m = items.count()
    if n_bad < need or not m:
        return own.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double, all array<array<string>>, key string")
    single = items.select(F.array("item").alias("tokens"), F.col("n_bad").alias("bad"))
    some = small(items.filter("n_bad < n").select("item"), m)
    baskets = reliable(
        seen.withColumnRenamed("token", "item").join(some, "item").groupBy("at", "bad").agg(F.array_sort(F.collect_list("item")).alias("items")).drop("at")
    )
    sets = single.unionByName(_combinations(baskets.filter("bad").select("items"), baskets.filter("not bad").select("items"), items, m, need))
    sets = _filed(reliable(sets), items, m)
    good = _counted(sets, _grouped(baskets.filter("not bad")), "good")
    total = F.col("bad") + F.coalesce("good", F.lit(0))
    judged = sets.join(good, "tokens", "left").withColumns({"confidence": F.col("bad") / total, "lower": lower_confidence(F.col("bad"), total)})
    judged = reliable(judged.drop("good"))
    parts = judged.filter(F.size("tokens") > 1).select(F.col("tokens").alias("_whole"), F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("tokens"))
    best = parts.join(judged.select("tokens", "confidence"), "tokens").groupBy("_whole").agg(F.max("confidence").alias("_part"))
    rules = judged.filter(F.col("lower") >= confidence).join(best, F.col("tokens") == F.col("_whole"), "left").filter("_part is null or confidence > _part")
    keyed = rules.join(small(items.select(F.col("item").alias("key"), "members"), m), "key")
    return reliable(keyed.select("tokens", "confidence", (F.col("bad") / n).alias("support"), "all", F.explode("members").alias("key")))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, count: int = MIN_COUNT) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, mined (the best mined rule's confidence, or null).

    labels has (id, bad); ids that are null or not in pages teach nothing. A url that is null or has no :// has an
    empty host and path and no tokens but its scheme's, so it is allowed. Repeated rows and rows with one id are judged
    each for itself; a verdict depends on the url alone, however long it is: all its tokens count. Columns beyond the
    two named are ignored, whatever their names. An empty table of pages gives an empty result; without labels only the
    fixed rules block.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    known = labels.filter("bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    found = mine(own.filter("url is not null").join(known, "id").select(url_tokens(F.col("url")).alias("tokens"), "bad"), support=support, confidence=confidence, count=count)
    n = found.count()
    index = found.select("all", "confidence", "key")
    index = F.broadcast(index) if n <= BROADCAST_ROWS else index

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    fixed = own.withColumns({"host": host, "path": path}).withColumns({"rule": name, "fixed": verdict})
    # the urls that a mined rule fits; every other url stays out of the join's table
    hits = (
        fixed.filter("rule is null and url is not null").select("url", url_tokens(F.col("url")).alias("tokens"))
        .select("url", "tokens", F.explode("tokens").alias("key")).join(index, "key")
        .filter(F.forall("all", lambda x: F.arrays_overlap(x, F.col("tokens"))))
        .groupBy("url").agg(F.max("confidence").alias("mined"))
    )
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    open_ = F.col("rule").isNull() & F.col("url").isNotNull()
    judged = fixed.filter(open_).join(hits, "url", "left").unionByName(fixed.filter(~open_).withColumn("mined", F.lit(None).cast("double")))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), "mined"
    )


def op3_url_filters(spark, sf_dir):
    """A label is bad if it says low quality or toxic; pages and labels share their numbers."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = (F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), labels.select(F.col("doc_id").alias("id"), bad.alias("bad")))


#: The fixed rules and the default, which is all that is left where no rule is mined, as on the bundled tables.
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) f(fh, fp, verdict)),
m AS (SELECT page_id, max_by({'rule': fh || fp, 'verdict': verdict}, length(fh || fp)) AS r FROM h JOIN f ON (host = fh OR suffix(host, '.' || fh)) AND prefix(path, fp) GROUP BY page_id)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict, CAST(NULL AS DOUBLE) AS mined FROM h LEFT JOIN m USING (page_id)
"""
