"""URL filter: path rules first, gradient-boosted trees on lexical features for the rest."""

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.tables import small, written
from nearshelf.llm.text import lowered, total

# Verdict, rule (host up to the first slash, then the path's beginning).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "hyphens", "entropy", "n_parameters",
            "query_length", "secure", "suffix_pages", "suffix_hosts", "suffix_share"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return lowered(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the host or a parent of it and whose path begins the path; null
    if none fits. Of equally long rules the first in the alphabet counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(s: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.split(s, "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: (F.size(chars) - F.size(F.array_remove(chars, c))) / n)
    return -total(F.transform(share, lambda p: p * F.log2(p)))


def url_features(pages: DataFrame, *, url: str = "url") -> DataFrame:
    """pages with host, path and the columns of FEATURES. Suffix statistics (the host's last
    two labels: pages, hosts, share of all pages) are counted over all pages."""
    host, path = url_parts(F.col(url))
    df = pages.withColumns({"host": host, "path": path, "_url": F.coalesce(F.col(url).cast("string"), F.lit(""))})
    df = df.withColumn("_suffix", F.substring_index("host", ".", -2))
    hosts = df.groupBy("_suffix", "host").agg(F.count("*").alias("n"))
    suffixes = written(hosts.groupBy("_suffix").agg(F.sum("n").alias("_pages"), F.count("*").alias("_hosts")), "url-suffixes")
    all_pages = suffixes.agg(F.coalesce(F.sum("_pages"), F.lit(1))).first()[0]
    query = F.regexp_extract("_url", r"(?s)\?([^#]*)", 1)
    length = F.length("_url").cast("double")
    return df.join(small(suffixes), "_suffix", "left").withColumns({
        "url_length": length,
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": (length - F.length(F.regexp_replace("_url", "[0-9]", ""))) / F.greatest(length, F.lit(1.0)),
        "hyphens": (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double"),
        "entropy": _entropy(F.concat("host", "path")),
        "n_parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "query_length": F.length(query).cast("double"),
        "secure": F.startswith(F.lower("_url"), F.lit("https://")).cast("double"),
        "suffix_pages": F.log1p(F.col("_pages").cast("double")),
        "suffix_hosts": F.log1p(F.col("_hosts").cast("double")),
        "suffix_share": F.col("_pages") / all_pages,
    }).drop("_url", "_suffix", "_pages", "_hosts")


def filter_urls(pages: DataFrame, *, labels: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, fit_rows: int = 20_000,
                trees: int = 12, depth: int = 4, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every page.

    The rule's verdict counts where one fits. Elsewhere the verdict is that of boosted
    trees (block from 0.5 on), fitted on labelled URLs: those of labels (url, blocked 0
    or 1) and the pages that a rule decides, fit_rows of them at most, those with the
    smallest hash of host and path. block_score is the trees' probability, null where
    there was nothing to fit: without labelled URLs pages are allowed, with labels of
    one kind only that kind is the verdict.

    Null or empty urls and urls without :// have empty host and path, fit no rule and
    are judged like any other. One row comes out per row that goes in.
    """
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    table = written(url_features(df).withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules)), "url-features")
    known = table.where(F.col("_rule").isNotNull()).withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    known = known.select("host", "path", "label", *FEATURES)
    if labels is not None:
        given = labels.where("blocked IS NOT NULL").select(F.lit(None).cast("bigint").alias("page_id"), "url", F.col("blocked").cast("double").alias("label"))
        known = known.unionByName(url_features(given).select("host", "path", "label", *FEATURES))
    order = [F.xxhash64("host", "path"), "host", "path", "label", *FEATURES]
    sample = written(known.orderBy(*order).limit(fit_rows), "url-sample")
    kinds = [r["label"] for r in sample.select("label").distinct().orderBy("label").collect()]
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    if len(kinds) == 2:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, labelCol="label").fit(vectors.transform(sample))
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(vectors.transform(table)).withColumn("block_score", F.get(vector_to_array("probability"), F.lit(1)))
        method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    else:
        scored = table.withColumn("block_score", F.lit(None).cast("double"))
        method = F.lit("block" if kinds == [1.0] else "allow")
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "block_score")
