"""Soft-membership mixing: rates for documents so that expected domain totals meet target weights.

A classifier fitted on the labels table gives every document a posterior over
domains. Projected gradient steps then fit rates: a step needs one sum per domain
over all documents, and the new rates are an expression of the old ones.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.tables import written
from nearshelf.llm.text import words

#: Target share of tokens per domain; a domain of weight 0 is left out.
WEIGHTS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("poor")


#: Plain steps before Newton steps; passes of these at most; weight of gaps against changes of rates in them.
PLAIN, PASSES, SOFT = 8, 60, 1e6

#: Longer words also count by so many first letters.
STEM = 4
STYLE = ["_upper", "_marks", "_digits", "_distinct"]


def _described(docs: DataFrame) -> DataFrame:
    """Adds n_tokens (words), _terms (the set of lower-cased words without marks, and of stems) and shares of upper-case
    letters, marks and digits among the characters and of distinct words."""
    df = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumns({
        "n_tokens": F.size(words(F.col("_t"))).cast("bigint"),
        "_words": F.array_distinct(F.array_remove(F.split(F.lower("_t"), r"[^\p{L}\p{N}]+"), "")),
        "_rest": F.regexp_replace("_t", r"[a-z\x20\x09-\x0D\p{Ll}]+", ""),
    })
    stems = F.array_distinct(F.transform(F.filter("_words", lambda w: F.length(w) > STEM), lambda w: F.substring(w, 1, STEM)))
    df = df.withColumn("_terms", F.concat("_words", F.transform(stems, lambda w: F.concat(w, F.lit("*")))))
    n = F.greatest(F.length("_t"), F.lit(1))
    return df.withColumns({
        "_upper": F.length(F.regexp_replace("_rest", r"[^\p{Lu}]+", "")) / n,
        "_marks": F.length(F.regexp_replace("_rest", r"[\p{L}\p{N}]+", "")) / n,
        "_digits": F.length(F.regexp_replace("_rest", r"[^0-9]+", "")) / n,
        "_distinct": F.size("_words") / F.greatest(F.col("n_tokens"), F.lit(1)),
    }).drop("_t", "_rest", "_words")


def _telling_terms(sample: DataFrame, terms: int, least: int) -> list[str]:
    """The terms words of least documents or more whose documents' labels differ most from all labels, by chi-square."""
    per = sample.groupBy("label").agg(F.count("*").alias("of_label"))
    n = sample.count()
    held = sample.select("label", F.explode("_terms").alias("term")).groupBy("term", "label").agg(F.count("*").alias("seen"))
    whole = held.groupBy("term").agg(F.sum("seen").alias("held")).where(F.col("held") >= least)
    expected = F.col("held") * F.col("of_label") / float(n)
    # A label in which the word is never seen adds its expected count, as do all together.
    score = F.sum(F.pow(F.col("seen") - expected, F.lit(2)) / expected - expected) + F.first("held")
    rows = held.join(whole, "term").join(F.broadcast(per), "label").groupBy("term").agg(score.alias("score"))
    return [r["term"] for r in rows.orderBy(F.desc("score"), "term").limit(terms).collect()]


def domain_posteriors(docs: DataFrame, labels: DataFrame, *, domains: list[str], carry: Sequence[str] = (), fit_rows: int = 8_000,
                      terms: int = 300, least: int = 20) -> DataFrame:
    """doc_id, carry, n_tokens, posterior (one probability per domain, in order) of every row of docs.

    A multinomial logistic regression on shares of characters and the terms most telling
    words, fitted on fit_rows labelled documents at most, those with the smallest hash of
    their doc_id; a word must stand in least of them. Labels without quality are left
    out; of several for one document, toxic and low quality prevail. Without labelled
    documents all domains are equally likely, with one kind of label that kind is sure.
    """
    docs = docs.select("doc_id", *carry, "text")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    of = (F.array_position(F.array(*map(F.lit, domains)), label_domain(F.col("quality"), F.col("toxic"))) - 1).cast("double")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", of.alias("label")).where("label >= 0")
    # fit_rows rows: a broadcast of bounded size.
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "mix-labels")
    sample = written(_described(docs.join(F.broadcast(chosen), "doc_id")).select("doc_id", "label", "_terms", *STYLE).dropDuplicates(["doc_id"]), "mix-sample")
    kinds = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(kinds) < 2:
        even = [1.0 / len(domains)] * len(domains) if not kinds else [float(k in kinds) for k in range(len(domains))]
        return _described(docs).select("doc_id", *carry, "n_tokens", F.array(*map(F.lit, even)).alias("posterior"))
    counted = CountVectorizerModel.from_vocabulary(_telling_terms(sample, terms, least) or [" "], "_terms", "_counted")
    vector = VectorAssembler(inputCols=[*STYLE, "_counted"], outputCol="features")
    model = LogisticRegression(family="multinomial", maxIter=50, regParam=0.001).fit(vector.transform(counted.transform(sample.orderBy("doc_id").coalesce(1))))
    out = model.transform(vector.transform(counted.transform(_described(docs)))).withColumn("posterior", vector_to_array("probability"))
    width = model.numClasses
    padded = F.concat("posterior", F.array(*[F.lit(0.0)] * (len(domains) - width))) if width < len(domains) else F.col("posterior")
    return out.select("doc_id", *carry, "n_tokens", padded.alias("posterior"))


def _sums(state: DataFrame, terms: Sequence[Column]) -> list[float]:
    return [float(x) for x in state.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(str(k)) for k, x in enumerate(terms)]).first()]


def _nearest(state: DataFrame, p: list[Column], aim: list[float], sizes: list[float], axes: np.ndarray, soft: float, passes: int, tolerance: float) -> Column:
    """The rates nearest to those of state, in the metric of tokens, at which expected totals are aim, as far as they can.

    They are max(_floor, rate - p * pull) for one pull, which minimises a convex function of
    its few coordinates along axes: Newton steps, halved where they do not descend. A pass
    over the rows gives value, slope and curvature. soft weighs gaps that cannot be closed.
    """
    t, (n, m) = F.col("n_tokens").cast("double"), axes.shape
    ridge, want = np.diag(sizes) / soft, np.array(aim)

    def rate(pull):
        return F.when(F.col("_free"), F.greatest("_floor", F.col("rate") - sum((x * F.lit(float(v)) for x, v in zip(p, pull)), F.lit(0.0)))).otherwise(0.0)

    def measured(at):
        pull = axes @ at
        r = rate(pull)
        moved = r - F.col("rate")
        both = F.when(F.col("_free") & (r > F.col("_floor")), t).otherwise(0.0)
        pairs = [(j, k) for j in range(n) for k in range(j, n)]
        # The Lagrangian at its best rates, with its sign changed.
        value = F.when(F.col("_free"), -t * (moved * moved / 2 + r * sum((x * F.lit(float(v)) for x, v in zip(p, pull)), F.lit(0.0)))).otherwise(0.0)
        found = _sums(state, [value, *[t * x * r for x in p], *[both * p[j] * p[k] for j, k in pairs]])
        bend = np.zeros((n, n))
        for (j, k), x in zip(pairs, found[1 + n:]):
            bend[j, k] = bend[k, j] = x
        slope = want - np.array(found[1:1 + n]) + ridge @ pull
        return found[0] + want @ pull + pull @ ridge @ pull / 2, axes.T @ slope, axes.T @ (bend + ridge) @ axes

    at = np.zeros(m)
    value, slope, bend = measured(at)
    passes -= 1
    while passes > 0 and np.abs(slope).max(initial=0.0) > tolerance:
        step, part = -np.linalg.lstsq(bend, slope, rcond=None)[0], 1.0
        while passes > 0:
            passes -= 1
            there = measured(at + part * step)
            if there[0] <= value + 1e-4 * part * (slope @ step) + 1e-12 * abs(value):
                at, (value, slope, bend) = at + part * step, there
                break
            part /= 2
    return rate(axes @ at)


def fit_rates(members: DataFrame, weights: Mapping[str, float], *, tokens: int | None = None, whole: str | None = None, steps: int = 40,
              every: int = 8, tolerance: float = 1e-4) -> DataFrame:
    """members (n_tokens, posterior and any other columns) with rate.

    Minimises the squared gaps between expected domain totals and their targets (weight
    times tokens; by default all tokens of members), each divided by the domain's size,
    over rates of 0 or more. A domain of weight 0 takes no part: documents most likely of
    it have rate 0, and what little the others may have of it is not fitted.
    From rate 1 on, steps follow the projected gradient in the metric of document
    tokens, in which the step of length 1 never overshoots. They end when no gap is over
    tolerance times tokens, or after PLAIN of them (steps, if less); Newton steps on one number
    per domain do the rest. Rates are written every few steps. A gap that stays over
    tolerance is warned of: the posteriors do not allow the targets.
    If whole names a domain of weight over 0, documents most likely of it have rate 1 or
    more, and tokens are raised so far that its target is its size or more, and further
    if the targets cannot be met otherwise.
    """
    names, n = list(weights), len(weights)
    total_weight = sum(weights.values()) or 1.0
    p = [F.get("posterior", F.lit(k)) for k in range(n)]
    likely = F.array_position(F.col("posterior"), F.array_max("posterior")) - 1
    barred = likely.isin([k for k, name in enumerate(names) if weights[name] == 0])
    kept_whole = whole is not None and weights[whole] > 0
    floor = F.when(likely == names.index(whole), 1.0).otherwise(0.0) if kept_whole else F.lit(0.0)
    state = written(members.drop("rate", "_free", "_floor").withColumns({
        "_free": ~F.coalesce(barred, F.lit(False)), "_floor": F.coalesce(floor, F.lit(0.0)), "rate": F.lit(1.0)}), "mix-members")
    sizes = _sums(state, [F.col("n_tokens") * x for x in p])
    everything = sum(sizes)
    asked = float(tokens if tokens is not None else everything)
    if kept_whole:
        asked = max(asked, sizes[names.index(whole)] * total_weight / weights[whole])
    aim = [weights[name] / total_weight * asked for name in names]
    enough = tolerance * max(everything, 1.0)

    def gaps_at(rate: Column, aim: list[float]) -> list[float]:
        return [(have - want) * (want > 0) for have, want in zip(_sums(state, [F.col("n_tokens") * x * rate for x in p]), aim)]

    rate = F.when(F.col("_free"), F.col("rate")).otherwise(0.0)
    for step in range(1, min(steps, PLAIN) + 1):
        gaps = gaps_at(rate, aim)
        if max(map(abs, gaps), default=0.0) <= enough:
            break
        pull = sum((x * F.lit(gap / size) for x, gap, size in zip(p, gaps, sizes) if size > 0), F.lit(0.0))
        rate = F.when(F.col("_free"), F.greatest("_floor", rate - pull)).otherwise(0.0)
        if step % every == 0:
            state = written(state.withColumn("rate", rate), "mix-members")
            rate = F.col("rate")
    else:
        fitted = [k for k in range(n) if aim[k] > 0 and sizes[k] > 0]
        if fitted:
            q, size, share = [p[k] for k in fitted], [sizes[k] for k in fitted], np.array([weights[names[k]] for k in fitted])
            state = written(state.withColumn("rate", F.when(F.col("_free"), F.greatest("_floor", F.lit(1.0))).otherwise(0.0)), "mix-members")
            rate = _nearest(state, q, [aim[k] for k in fitted], size, np.eye(len(q)), SOFT, PASSES, enough / 10)
            gaps = gaps_at(rate, aim)
            if kept_whole and max(map(abs, gaps)) > enough:
                # The total is free: a pull at right angles to the weights.
                axes = np.linalg.svd(share[None, :])[2][1:].T
                rate = _nearest(state, q, [0.0] * len(q), size, axes, SOFT, PASSES, enough / 10)
                have = _sums(state, [F.col("n_tokens") * x * rate for x in p])
                asked = sum(have[k] for k in fitted) * total_weight / share.sum()
                aim = [weights[name] / total_weight * asked for name in names]
                gaps = gaps_at(rate, aim)
            if max(map(abs, gaps)) > enough:
                warnings.warn(f"expected domain totals miss their targets by {dict(zip(names, gaps))} of {everything} tokens", stacklevel=2)
    return state.withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("_free", "_floor")


def mix_sources(docs: DataFrame, labels: DataFrame, *, weights: Mapping[str, float] = WEIGHTS, tokens: int | None = None,
                whole: str | None = None, carry: Sequence[str] = (), fit_rows: int = 8_000, terms: int = 300, least: int = 20) -> DataFrame:
    """doc_id, carry, n_tokens, posterior, domain (the most likely), rate, kept.

    kept draws the document with probability min(rate, 1), by a hash of its doc_id; a
    rate over 1 asks for repeated reading. One row comes out per row that goes in;
    rows with one doc_id draw alike. A null or empty text has no tokens and counts for
    nothing in the totals. No row, no result.
    """
    domains = list(weights)
    members = domain_posteriors(docs, labels, domains=domains, carry=carry, fit_rows=fit_rows, terms=terms, least=least)
    rated = fit_rates(members, weights, tokens=tokens, whole=whole)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    domain = F.get(F.array(*map(F.lit, domains)), (F.array_position(F.col("posterior"), F.array_max("posterior")) - 1).cast("int"))
    return rated.select("doc_id", *carry, "n_tokens", "posterior", domain.alias("domain"), "rate", (draw < F.col("rate")).alias("kept"))
