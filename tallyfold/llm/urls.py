"""URL filters by association rules.

Labelled URLs are sets of tokens (host, domain, folder, file extension, query keys). FP-growth mines the token sets that come
often with a label, in rows and in share of the label's rows; those whose share of the label is surely above that of all rows become rules. A rule matches
a URL that has all of its tokens: an inverted index leads from a token to the rules with it, and the rules whose tokens are all met are counted out. Of
the matching rules the one that surely raises its label's share the most decides. Fixed rules (host, path) come before any of them.

A URL has at most four tokens besides its query keys, and any number of keys. So sets hold at most one key: sets without one are mined from a basket
for each URL, sets with one from a basket for each URL and key. What is mined then grows with the keys, not with their subsets.

Rules and URLs are joined by token and grouped by (URL, rule) with partial sums; equal URLs are judged once.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import saved, table

#: (host, path, verdict): a rule fits its host and all below it, where the path begins with its own.
FIXED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_ROWS = 5
#: Of the rows of its label, a set has this share at least.
MIN_SHARE = 1e-4
SIGNIFICANCE = 0.05
DEFAULT = "allow"
_LABEL, _KEY = "label=", "query="


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def parsed(urls: DataFrame) -> DataFrame:
    """With host and path, from ``url``; both empty for NULL and for URLs without ``://``."""
    return urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))


def tokens() -> Column:
    """The distinct tokens of a parsed URL: its host, its last two labels, first folder, file extension and query keys.

    Each part gives one token (a query one a key), so that a URL has few subsets. Runs of digits are one sign, so ids do not make tokens of
    their own.
    """
    labels = F.split("host", r"\.")
    folder = F.regexp_extract(F.regexp_replace("path", r"\d+", "#"), r"^/([^/]*)/", 1)
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit(_KEY), F.regexp_extract(x, "^([^=]*)", 1)))
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), "."))
    parts = [("host=", F.when(F.size(labels) > 2, F.col("host"))), ("domain=", domain), ("folder=", F.nullif(folder, F.lit(""))), ("extension=", F.nullif(extension, F.lit("")))]
    return F.array_distinct(F.concat(F.array_compact(F.array(*(F.concat(F.lit(name), value) for name, value in parts))), keys))


def _candidates(baskets: DataFrame, with_key: bool, at_least: int) -> DataFrame:
    """(items, verdict, together, rows): the token sets that come with a verdict in ``at_least`` rows, and the rows they come in at all.

    Of sets mined from baskets of a key each only those with the key count: they come once in each of their rows.
    """
    n = baskets.count()
    if not n:
        return baskets.sparkSession.createDataFrame([], "items array<string>, verdict string, together double, rows double")
    # A set and a label come together in so many baskets; half a basket less, so that rounding drops none.
    rules = FPGrowth(itemsCol="items", minSupport=min(1.0, (at_least - 0.5) / n), minConfidence=0.0).fit(baskets).associationRules
    said = F.col("consequent")[0]
    kept = said.startswith(_LABEL) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL))
    kept &= F.exists("antecedent", lambda x: x.startswith(_KEY)) if with_key else F.lit(True)
    together = F.round(F.col("support") * n)
    return rules.where(kept).select(F.array_sort("antecedent").alias("items"), F.substring(said, len(_LABEL) + 1, 1000).alias("verdict"), together.alias("together"), F.round(together / F.col("confidence")).alias("rows"))


def mined(labelled: DataFrame, rows_at_least: int = MIN_ROWS, significance: float = SIGNIFICANCE, share_at_least: float = MIN_SHARE) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support, lift) from (url, verdict); rows without a verdict are left out.

    A token set needs ``rows_at_least`` rows of a label and ``share_at_least`` of its rows. It becomes a rule if the lower end of the confidence
    interval (Wilson's) is above the label's share of all rows; ``significance`` is shared out over all sets that are tried. ``lift`` is
    that lower end over that share.
    """
    rows = parsed(labelled.where("verdict is not null").select("url", "verdict"))
    rows = saved(rows.select(tokens().alias("tokens"), "verdict"), "baskets")
    labels = rows.groupBy("verdict").agg(F.count("*").alias("of_label")).withColumn("n", F.sum("of_label").over(Window.partitionBy()))
    labels = saved(labels.withColumn("least", F.greatest(F.lit(rows_at_least), F.ceil(F.col("of_label") * share_at_least))), "labels")
    least = labels.agg(F.min("least")).first()[0] or rows_at_least
    label = F.array(F.concat(F.lit(_LABEL), "verdict"))
    place, keys = F.filter("tokens", lambda x: ~x.startswith(_KEY)), F.filter("tokens", lambda x: x.startswith(_KEY))
    plain = saved(rows.select(F.concat(place, label).alias("items")), "plain-baskets")
    keyed = saved(rows.select(F.explode(keys).alias("key"), place.alias("place"), label.alias("label")).select(F.concat(F.array("key"), "place", "label").alias("items")), "keyed-baskets")
    tried = saved(_candidates(plain, False, least).unionByName(_candidates(keyed, True, least)), "tried")
    z = NormalDist().inv_cdf(1 - significance / max(1, tried.count()))
    frequent = tried.join(labels, "verdict").where("together >= least")
    base, p, m = F.col("of_label") / F.col("n"), F.col("together") / F.col("rows"), F.col("rows")
    low = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    useful = frequent.withColumn("surely", low / base).where("surely > 1")
    return saved(useful.select(F.array_join("items", " & ").alias("rule_id"), "items", "verdict", p.alias("confidence"), (F.col("together") / F.col("n")).alias("support"), F.col("surely").alias("lift")), "rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, method_rule, method_verdict, confidence): the best rule of each distinct URL that has one."""
    index = saved(rules.select(F.explode("items").alias("token"), "rule_id", F.size("items").alias("size"), "verdict", "confidence", "support", "lift"), "rule_index")
    met = urls.select("url", F.explode(tokens()).alias("token")).join(index, "token")
    whole = met.groupBy("url", "rule_id", "verdict", "confidence", "support", "lift", "size").agg(F.count("*").alias("n")).where("n = size")
    best = F.max(F.struct("lift", "confidence", "support", F.col("verdict"), "rule_id"))
    return whole.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule_id").alias("method_rule"), F.col("best.verdict").alias("method_verdict"), F.col("best.confidence").alias("confidence"))


def fixed_rule(fixed: Sequence[tuple[str, str, str]] = FIXED) -> tuple[Column, Column]:
    """The longest fixed rule that fits a parsed URL, and its verdict; NULL if none does."""

    def first(value) -> Column:
        cases = []
        for host, path, verdict in sorted(fixed, key=lambda r: -len(r[0] + r[1])):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            cases.append(F.when(fits, F.lit(value(host, path, verdict))))
        return F.coalesce(*cases) if cases else F.lit(None).cast("string")

    return first(lambda host, path, _: host + path), first(lambda _, __, verdict: verdict)


def judged(urls: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str, str]] = FIXED) -> DataFrame:
    """``urls`` with host, path, rule, verdict, method_rule and confidence (columns of these names are replaced).

    ``rule`` is the fixed rule, which decides; else the method's best rule does; else the verdict is ``allow``. NULL URLs and URLs
    without ``://`` have an empty host and path and fit no fixed rule. Repeated URLs get one verdict. Without labels there
    are no mined rules. An empty table stays empty.
    """
    rows = parsed(urls.drop("host", "path", "rule", "verdict", "method_rule", "method_verdict", "confidence"))
    found = saved(matched(rows.select("url", "host", "path").where("url is not null").distinct(), mined(labelled)), "matched")
    rule, verdict = fixed_rule(fixed)
    packed = rows.select(F.struct("*").alias("row"), "url", "host", "path").join(found, "url", "left")
    decided = F.coalesce(verdict, "method_verdict", F.lit(DEFAULT))
    return packed.select("row.*", rule.alias("rule"), decided.alias("verdict"), "method_rule", "confidence")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict) of the pages whose document has a label: low quality is blocked. Contrary labels of an id: the worst counts."""
    worst = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return pages.select("page_id", "url").join(worst, F.col("page_id") == F.col("doc_id")).select("url", F.when(F.col("quality") > 0, "allow").otherwise("block").alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, page_labels(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op5_urls": op5_urls}
ORACLE: dict[str, str] = {}
