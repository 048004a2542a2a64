"""Operator 6: URL filters, with DataFrame functions only.

Given rules (host, path) decide the urls they fit, longest rule first. Any other url is judged by association rules:
Spark's FP-growth mines combinations of URL tokens that come with bad labels; rules are pruned by support, confidence and
lift and matched through an inverted index from token to rules.

Tokens that stand in exactly the same labelled urls are one item when mining, and tokens of all urls none: both would
only multiply combinations that say the same. A url has such an item if it has any of its tokens.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: verdict, host and path of each given rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BAD = "\x00bad"
#: Least share and number of labelled urls with a rule's tokens that are bad, least share of bad ones among those with its tokens, and how many times the share among all that must be.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 10, 0.6, 1.5
#: Maps that the inverted index is dealt to for each 8 of its tokens; a map is searched one by one.
_EACH = 8
Rule = tuple[list[list[str]], float]


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_az(host), path


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: host labels, directories of the path, kind of its last part, names of query fields."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("p:"), lower_az(x)))
    last = F.regexp_replace(F.element_at(parts, -1), "[0-9]+", "0")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    fields = F.transform(F.split(query, "[&;]"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    every = F.concat(labels, folders, F.array(F.concat(F.lit("l:"), lower_az(last)), F.concat(F.lit("s:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1))), fields)
    return F.array_distinct(F.filter(every, lambda x: F.length(x) > 2))


def items_of(baskets: DataFrame) -> DataFrame:
    """(token, item) for the tokens of baskets (id, t, bad): the least of the tokens that stand in exactly the same baskets. Tokens of every basket are left out."""
    n = baskets.count()
    each = baskets.select("id", F.explode("t").alias("token"))
    # Two hashes of all baskets' numbers together tell sets apart; exclusive or can't overflow.
    key = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"k{k}") for k in (1, 2)]
    sets = each.groupBy("token").agg(F.count("*").alias("n"), *key).where(F.col("n") < n)
    least = sets.groupBy("n", "k1", "k2").agg(F.min("token").alias("item"))
    return sets.join(least, ["n", "k1", "k2"]).select("token", "item")


def mine_rules(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT) -> list[Rule]:
    """(items, confidence) of the rules "these items -> bad" over rows (url, bad); an item is the list of its tokens, any of which makes it.

    Rules are pruned by support, confidence and lift; rules of which a part is as confident say nothing more and go. Only
    items that some bad urls have often enough can be in a rule, so only those are mined. Support bounds the number of
    rules, which is why they may be brought to the driver. Null urls count for nothing; no labelled urls, or only bad or
    good ones, give no rules.
    """
    host, path = host_path(F.col("url"))
    t = urls.where("url is not null and bad is not null").select(F.monotonically_increasing_id().alias("id"), tokens(host, path, F.col("url")).alias("t"), "bad")
    t = materialise(t, "urls")
    total = t.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    if not total["bad"] or total["bad"] == total["n"]:
        return []
    least = max(min_count, math.ceil(min_support * total["n"]))
    named = materialise(items_of(t), "items")
    each = t.select("id", "bad", F.explode("t").alias("token")).join(named, "token").select("id", "bad", "item").distinct()
    often = each.where("bad").groupBy("item").count().where(F.col("count") >= least).select("item")
    each = each.join(F.broadcast(often), "item")  # at most bad tokens / least rows
    baskets = materialise(each.groupBy("id", "bad").agg(F.collect_list("item").alias("items")).select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    rows = baskets.count()
    if not rows:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / rows), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("confidence") >= min_lift * total["bad"] / total["n"]))
    got = sorted(((sorted(r.antecedent), r.confidence) for r in rules.select("antecedent", "confidence").collect()), key=lambda x: (len(x[0]), x[0]))
    kept: list[tuple[list[str], float]] = []
    by: dict[str, list[int]] = {}  # what is kept, by first item
    for a, c in got:
        items = set(a)
        if not any(kept[k][1] >= c and items.issuperset(kept[k][0]) for x in a for k in by.get(x, ())):
            by.setdefault(a[0], []).append(len(kept))
            kept.append((a, c))
    wanted = sorted({x for a, _ in kept for x in a})
    members: dict[str, list[str]] = {}
    for r in named.where(F.col("item").isin(wanted)).collect() if wanted else ():
        members.setdefault(r.item, []).append(r.token)
    return [([sorted(members[x]) for x in a], c) for a, c in sorted(kept)]


def inverted_index(rules: Sequence[Rule]) -> tuple[Column, int]:
    """Token -> numbers of (rule, item in it), as an array of maps dealt by the token's hash, and how many maps there are."""
    index: dict[str, list[int]] = {}
    for k, (items, _) in enumerate(rules):
        for i, item in enumerate(items):
            for x in item:
                index.setdefault(x, []).append(k << 8 | i)
    count = max(1, len(index) // _EACH)
    maps: list[dict] = [{} for _ in range(count)]
    for x, found in index.items():
        maps[zlib.crc32(x.encode()) % count][x] = found
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<int>>>"), count


def fixed_index(rules: Sequence[tuple[str, str]]) -> Column:
    """host -> array of (length, rule, path, verdict)."""
    by: dict[str, list] = {}
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        by.setdefault(host, []).append({"n": len(rule), "rule": rule, "path": "/" + path, "verdict": verdict})
    return F.from_json(F.lit(json.dumps(by)), "map<string,array<struct<n:int,rule:string,path:string,verdict:string>>>")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], mined: Sequence[Rule], keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule (null where none fits), verdict: one row per page, in one scan without a shuffle.

    Null and malformed urls have an empty host and path, fit no rule, and are allowed. Repeated rows are judged alike;
    very long urls are read whole; of rules of one length the greater text wins; an empty table gives no rows. Of other
    columns only ``keep`` is read, so their names can't clash.
    """
    host, path = host_path(F.col("url"))
    p = pages.select(F.struct(*[F.col(c) for c in keep]).alias("_kept"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    labels = F.split(F.col("host"), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = fixed_index(rules)
    fits = F.filter(F.flatten(F.transform(endings, lambda e: F.coalesce(known[e], F.from_json(F.lit("[]"), "array<struct<n:int,rule:string,path:string,verdict:string>>")))), lambda r: F.startswith(F.col("path"), r["path"]))
    p = p.withColumn("best", F.array_max(fits))
    verdict = F.lit("allow")
    if mined:
        maps, count = inverted_index(mined)
        found = lambda x: F.element_at(maps, (F.crc32(x.cast("binary")) % count + 1).cast("int"))[x]
        hits = F.flatten(F.filter(F.transform(tokens(F.col("host"), F.col("path"), F.col("url")), found), lambda h: h.isNotNull()))
        p = p.withColumn("hits", F.array_distinct(hits))
        lengths = F.from_json(F.lit(json.dumps([len(items) for items, _ in mined])), "array<int>")
        rule_of = lambda h: F.shiftright(h, 8)
        whole = F.exists("hits", lambda h: F.size(F.filter("hits", lambda g: rule_of(g) == rule_of(h))) == F.element_at(lengths, rule_of(h) + 1))
        verdict = F.when(whole, "block").otherwise("allow")
    return p.select(*[F.col(f"_kept.{c}") for c in keep], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", verdict).alias("verdict"))
