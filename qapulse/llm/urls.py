"""URL filters by association rules, in DataFrame functions alone.

A URL is cut into tokens: each label and each domain suffix of its host, each segment of its path (a run of digits is ``0``), the
ending of its last segment, the names of its query, whether it has a fragment. Spark's FP-growth mines, from labelled URLs, the
combinations of tokens that come with the label *block*. Rules below ``SUPPORT`` (share of the labelled URLs, and ``LEAST`` of them) or ``CONFIDENCE`` go, and so does
a rule that adds tokens to another one without being surer. Rules are indexed by their rarest token: a URL looks
up its own tokens, and the rules found there are tested whole. A URL that a rule fits is blocked, all others are allowed.

Mining reads all labelled URLs with all their tokens. FP-growth gets, for each URL and each of its tokens as a rule's rarest, the
commoner tokens that do not always come with it (a host has its suffixes and labels): the rules it leaves out would go anyway, and
combinations grow with the tokens that are independent of each other.

A fixed rule (host, path, verdict) goes before: it fits its host and all subdomains where the URL's path starts with its own;
the longest wins (of equal ones that of the longer host). Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: then
up to ``?``, ``#`` or the end. Null, or no ``://``: both empty, no tokens, allowed. A URL is labelled by the number in its
path, the last one: it names a document. A document with any label toxic or of low quality is to be blocked.
Repeated rows get the same verdict each; no pages give no rows, no labels no mined rules.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qapulse.llm.shared import stash

#: Host, path and verdict of the fixed rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT, LEAST, CONFIDENCE = 0.001, 10, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
_BLOCK = "verdict=block"
_MARK = "\n"  # between key and token of an item


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the rest from ``?`` or ``#`` on."""
    host, path, rest = (F.coalesce(F.regexp_extract(url, _PARTS, n), F.lit("")) for n in (1, 2, 3))
    return F.translate(host, _UPPER, _LOWER), path, rest


def fixed(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the last one that fits stands
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """The different tokens of a URL, sorted."""
    def named(kind: str, found: Column) -> Column:
        return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    segments = F.transform(F.split(F.translate(path, _UPPER, _LOWER), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.transform(F.split(F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    anchor = F.when(F.instr(rest, "#") > 0, F.lit("yes")).otherwise(F.lit(""))
    every = F.concat(
        named("label=", labels), named("domain=", suffixes), named("segment=", segments), named("ending=", F.array(ending)),
        named("query=", query), named("fragment=", F.array(anchor)),
    )
    return F.array_sort(F.array_distinct(every))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, block) of each page whose document has a label. ``pages`` needs path and tokens; ``labels`` doc_id, quality, toxic."""
    number = F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1)
    kind = labels.schema["doc_id"].dataType.simpleString()
    block = (F.coalesce(F.col("toxic"), F.lit(0)) != 0) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = labels.where("toxic is not null or quality is not null").groupBy("doc_id").agg(F.max(block).alias("block"))
    return pages.select("tokens", number.try_cast(kind).alias("doc_id")).join(known, "doc_id").select("tokens", "block")


def conditional(examples: DataFrame, counts: DataFrame) -> DataFrame:
    """key, block, items: the part of each example that FP-growth mines for rules with this rarest token.

    ``items`` are the example's commoner tokens of ``counts``, each marked by the key, but for those that every example with the key
    has: with them a rule is as sure as without, so it would go.
    """
    rows = examples.withColumn("row", F.monotonically_increasing_id()).select("row", "block", F.explode("tokens").alias("token"))
    rows = rows.join(counts.select("token", "n"), "token").groupBy("row", "block")
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    rows = rows.select("block", F.posexplode("held").alias("at", "own"), "held")
    rows = rows.select("block", F.col("own.token").alias("key"), F.col("own.n").alias("n"), F.expr("slice(held, at + 2, size(held)).token").alias("rest"))
    rows = stash(rows, "conditional")
    always = rows.select("key", "n", F.explode("rest").alias("token")).groupBy("key", "n", "token").agg(F.count("*").alias("both"))
    always = always.where("both = n").groupBy("key").agg(F.collect_set("token").alias("always"))
    left = F.array_except("rest", F.coalesce("always", F.array().cast("array<string>")))
    items = F.transform(left, lambda token: F.concat("key", F.lit(_MARK), token))
    return rows.join(always, "key", "left").select("key", "block", items.alias("items"))


def mine(
    examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, most: int | None = None
) -> DataFrame:
    """rule, antecedent (sorted tokens), key (its rarest token), confidence and support of what FP-growth finds in (tokens, block).

    All tokens of all examples are mined; ``most`` is a limit of earlier versions and has no effect.
    """
    examples = stash(examples, "labelled-urls")
    total = examples.count()
    # As FP-growth counts: a rule needs so many blocked examples, so each of its tokens does.
    enough = max(1, math.ceil(min(1.0, max(support, least / max(1, total))) * total))
    counts = examples.select("block", F.explode("tokens").alias("token")).groupBy("token")
    counts = counts.agg(F.count("*").alias("n"), F.sum(F.col("block").cast("bigint")).alias("blocked"))
    counts = stash(counts.where(F.col("blocked") >= enough), "tokens")
    sure = F.col("blocked").cast("double") / F.col("n")
    alone = counts.where(sure >= confidence).select(F.array("token").alias("antecedent"), sure.alias("confidence"), F.col("blocked").alias("times"))
    # A token that is sure by itself makes no other rule surer.
    baskets = conditional(examples, counts.where(F.col("blocked") < F.col("n"))).where(F.size("items") > 0)
    baskets = stash(baskets.select(F.concat("items", F.when(F.col("block"), F.array(F.lit(_BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")), "baskets")
    n = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (enough - 0.5) / n), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _BLOCK))
    marked = F.concat(
        F.array(F.split_part(F.col("antecedent")[0], F.lit(_MARK), F.lit(1))),
        F.transform("antecedent", lambda item: F.split_part(item, F.lit(_MARK), F.lit(2))),
    )
    found = found.select(marked.alias("antecedent"), "confidence", F.round(F.col("support") * n).cast("bigint").alias("times")).unionByName(alone)
    found = found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("times") / F.lit(float(max(1, total)))).alias("support"))
    found = stash(found.withColumn("rule", F.array_join("antecedent", " & ")), "mined")
    rarest = found.select("rule", F.explode("antecedent").alias("token")).join(counts.select("token", "n"), "token")
    rarest = rarest.groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("key"))
    found = stash(found.join(rarest, "rule"), "indexed")
    # A rule goes if one with a part of its tokens is as sure: rules look each other up as URLs do.
    wider = found.select("key", F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    asked = found.select("rule", "antecedent", "confidence", F.explode("antecedent").alias("key"))
    weak = asked.join(wider, "key").where(
        (F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)
    )
    return stash(found.join(weak.select("rule").distinct(), "rule", "left_anti"), "rules")


def fitting(found: DataFrame, mined: DataFrame) -> DataFrame:
    """tokens and the surest mined rule (reason, confidence) for each different set of ``tokens`` that a rule fits."""
    sets = found.select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("key")).join(mined, "key")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "rule")).alias("best")
    return hits.groupBy("tokens").agg(best).select("tokens", F.col("best.rule").alias("reason"), "best.confidence")


def judge(
    pages: DataFrame, labels: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST
) -> DataFrame:
    """page_id, host, path, rule, verdict, reason (mined rule that fits, if any) and its confidence for each row of ``pages``."""
    host, path, rest = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    cut = cut.select("page_id", "host", "path", tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"))
    mined = mine(labelled(cut, labels), support, confidence, least)
    found = cut.join(fitting(cut, mined), "tokens", "left")
    rule, verdict = fixed(F.col("host"), F.col("path"), rules)
    mined_verdict = F.when(F.col("reason").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"), "reason", "confidence")


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "labels"))
    return judge(pages, labels).drop("confidence")
