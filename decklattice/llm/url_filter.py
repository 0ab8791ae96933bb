"""URL filters: fixed host rules, and association rules that FP-growth mines from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A rule needs this share of the labelled pages, this confidence and this lift.
SUPPORT, CONFIDENCE, LIFT = 0.01, 0.6, 1.5
#: Rules up to this number are broadcast; more are joined in a shuffle, pages dealt out by SALTS.
MOST_BROADCAST, SALTS = 50_000, 32
BAD = "\x00bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to / ? # or end, A-Z lower-cased; path up to ? # or end."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: runs of letters, digits and inner hyphens, lower-cased."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}-]+"), ""))


def fixed_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` from (rule, verdict) pairs; a rule is ``host/path``.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest
    wins, of equal ones the first by code points. The list is a parameter of the caller, matched as
    one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, action in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (rule_id, items, confidence, support) from (url, bad): token sets that point to bad pages.

    All labelled pages count, those with a null label do not. FP-growth finds the frequent sets of
    URL tokens together with the label; rules that conclude the label are kept if confident and well
    above the base rate, and dropped if a rule with fewer tokens is as confident. No labelled page,
    or none that is bad, gives no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where(F.col("bad").isNotNull()).select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array())).alias("items"))
    rows = rows.where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= lift))
    found = found.select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    token = found.select(F.col("items").alias("small"), F.col("confidence").alias("small_confidence"), F.element_at("items", 1).alias("token"))
    spread = found.withColumn("token", F.explode("items"))
    contained = (F.size("small") < F.size("items")) & (F.size(F.array_except("small", "items")) == 0) & (F.col("small_confidence") >= F.col("confidence"))
    weaker = spread.join(token, "token").where(contained).select("items").distinct()
    return found.join(weaker, "items", "left_anti").withColumn("rule_id", F.xxhash64("items"))


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """(url, bad) of every page with a URL: 1 where a fixed rule blocks it, else 0.

    Fixed rules are what is known of a URL for sure. As labels they let mining carry them on to
    hosts and paths that no rule names, where the tokens of most such pages are blocked. Pages that
    no rule fits count as good, so tokens that only happen to stand in a rule do not become one. Null
    URLs have no label; repeated rows count each.
    """
    host, path = host_and_path(F.col(url_col))
    known = fixed_rules(pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), host.alias("host"), path.alias("path")), rules)
    return known.select("url", F.coalesce((F.col("rule_verdict") == "block").cast("int"), F.lit(0)).alias("bad"))


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_items, confidence) of the most confident rule of each page of (key, tokens).

    Inverted index: each rule is filed under that of its tokens which the fewest pages have, so a
    page meets only rules of its own rare tokens; a rule counts if the page has all its tokens. Of
    equally confident rules the greatest by its tokens counts. Up to MOST_BROADCAST rules go to
    every task; with more of them the pages of a token are dealt out to SALTS parts, so that a token
    of very many pages is no single task. Without rules there are no rows.
    """
    rules = rules.select("rule_id", "items", "confidence")
    spread = pages.select("key", "tokens", F.explode("tokens").alias("token"))
    met = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    token = rules.select("rule_id", "items", "confidence", F.explode("items").alias("token")).join(met, "token", "left").fillna(0, ["n"])
    filed = token.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("least"), F.first("items").alias("items"), F.first("confidence").alias("confidence"))
    index = materialise(filed.select(F.col("least.token").alias("token"), "items", "confidence"), "url-rules")
    if index.count() <= MOST_BROADCAST:
        met = spread.join(F.broadcast(index), "token")
    else:
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        met = spread.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS).cast("long"))).join(index.withColumn("salt", F.explode(salts)), ["token", "salt"])
    met = met.where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct(F.col("confidence"), F.array_join("items", " ").alias("items")))
    return met.groupBy("key").agg(best.alias("best")).select("key", F.col("best.items").alias("rule_items"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) of every row of ``pages``.

    ``labelled`` has (url, bad). The verdict is that of the fixed rule that fits, else ``block``
    where a mined rule matches, else ``allow``. A null URL, or one without ``://``, has an empty
    host and path and no fixed rule; its tokens still count. Repeated rows are judged each; without
    labels, or where no set of tokens is a rule, nothing is mined and pages that no fixed rule fits
    are allowed; empty tables give no rows; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    mined = materialise(mine(labelled), "url-mined")
    urls = pages.select(F.col(url_col).alias("url")).where(F.col(url_col).isNotNull()).distinct()
    matched = match(urls.select(F.col("url").alias("key"), tokens_of(F.col("url")).alias("tokens")), mined)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = fixed_rules(rows, rules).join(matched.withColumnRenamed("key", "url"), "url", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("rule_items").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("rule_items").alias("mined_rule"), "confidence")
