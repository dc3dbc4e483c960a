"""URL filters: rules first, then gradient-boosted trees over lexical features.

A rule fits its host and all subdomains if the url's path starts with the
rule's path; the longest fitting rule decides.  Urls that a rule decides are
the labelled ones; trees are fitted on a sample of them of about
``TRAIN_ROWS`` rows, taken by a hash of the url, and judge the rest.

Features (all computed by DataFrame functions): lengths of url, host and path,
depth, digit and hyphen ratios, character entropy, labels of the host,
parameters and their length, and for the host's last label and last two labels
the share of blocked among their labelled urls and their share of all labelled
urls, both counted over every labelled url (equal ones once).  Suffix tables are
joined, and broadcast only where they measure under ``BROADCAST_BYTES``.

Defined cases: a null url, or one without ``://``, has empty host and path and
no rule; with no labelled urls, or only one kind of them, the method gives that
kind to all (allow if there are none).  Equal urls get equal verdicts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.llm.common import ascii_lower, stored

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRAIN_ROWS = 20_000
BROADCAST_BYTES = 16 << 20
TREES, DEPTH = 20, 4
FEATURES = ("f_len", "f_host", "f_path", "f_depth", "f_digit", "f_hyphen", "f_entropy", "f_labels", "f_params",
            "f_query", "f_tld_rate", "f_tld_n", "f_dom_rate", "f_dom_n")


def with_parts(pages: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path`` (empty for null or without ``://``)."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))) \
        .withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def fitting_rule(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict (null without one)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one is laid over the shorter
        host, path = name.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _count(c: Column, what: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, what, ""))).cast("double")


def with_features(pages: DataFrame, url: str) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path``; suffixes as ``tld`` and ``dom``."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = F.transform(chars, lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return pages.withColumns({
        "f_len": F.length(u).cast("double"), "f_host": F.length("host").cast("double"),
        "f_path": F.length("path").cast("double"), "f_depth": _count(F.col("path"), "/"),
        "f_digit": _count(u, "[0-9]") / n, "f_hyphen": _count(F.col("host"), "-"), "f_entropy": entropy,
        "f_labels": _count(F.col("host"), r"\."), "f_params": _count(query, "="),
        "f_query": F.length(query).cast("double"),
        "tld": F.substring_index("host", ".", -1), "dom": F.substring_index("host", ".", -2)})


def _suffix_rates(urls: DataFrame, by: str, prior: float, total: int) -> DataFrame:
    """Share of blocked, drawn towards the prior, and share of all labelled urls; a row per suffix."""
    t = stored(urls.groupBy(by).agg(
        ((F.sum("label") + 10.0 * prior) / (F.count("*") + 10.0)).alias(f"f_{by}_rate"),
        (F.count("*") / F.lit(float(total))).alias(f"f_{by}_n")))
    size = t.agg(F.sum(F.octet_length(by) + 64)).first()[0] or 0
    return F.broadcast(t) if size <= BROADCAST_BYTES else t


def _with_suffixes(d: DataFrame, tables: dict[str, DataFrame], prior: float) -> DataFrame:
    for by, t in tables.items():
        d = d.join(t, by, "left").na.fill({f"f_{by}_rate": prior, f"f_{by}_n": 0.0})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(d)


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES,
                train_rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """``(page_id, host, path, rule, verdict, p_block)``; ``p_block`` is the trees' probability."""
    rule, verdict = fitting_rule(rules)
    d = with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url")
    d = d.withColumn("rule", rule).withColumn("said", verdict)
    labelled = d.where(F.col("rule").isNotNull()).select(
        "url", "host", "path", (F.col("said") == "block").cast("double").alias("label"))
    # equal urls have equal parts and verdicts: one of each is enough, and a hot url weighs no more than another
    suffixes = stored(labelled.select("url", F.substring_index("host", ".", -1).alias("tld"),
                                      F.substring_index("host", ".", -2).alias("dom"), "label").dropDuplicates(["url"]).drop("url"))
    known = suffixes.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    prior = float(known["p"] or 0.0)
    keep = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, train_rows / max(known["n"], 1)) * (1 << 30))
    train = stored(with_features(labelled.where(keep).dropDuplicates(["url"]), "url")
                   .drop("path").coalesce(4))
    seen = train.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    scored = with_features(d, "url")
    if seen["n"] and 0.0 < seen["p"] < 1.0:
        tables = {by: _suffix_rates(suffixes, by, prior, known["n"]) for by in ("tld", "dom")}
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32,
                              seed=seed).fit(_with_suffixes(train, tables, prior).select("features", "label"))
        scored = model.transform(_with_suffixes(scored, tables, prior)) \
            .withColumn("p_block", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("p_block", F.lit(prior))
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "p_block")


def url_report(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)
