"""Secret scan: trigram index first, regular expressions on what it leaves.

Boolean trigram queries are derived from each expression. Postings of the asked
trigrams are gathered over all documents and intersected per alternative; only the
documents left are searched. An expression without a mandatory trigram is run on all.
"""

from __future__ import annotations

import re._parser as regex_tree
from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearshelf.functions.text import let
from nearshelf.llm.tables import small, written

SPAN = "struct<start:bigint,order:int,end:bigint,kind:string,ok:boolean>"
#: Matches of one text that are gathered at a time.
TOGETHER = 200


class Rule(NamedTuple):
    """kind, expression (Java and Python syntax in common), length that a group must have."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base expressions, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published forms of keys.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
)
#: A class of more characters than this ends a literal run.
CHOICES = 5


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which every match has in full; None if some match needs no trigram."""
    def run(nodes, states):
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                states = {step(s, chr(arg)) for s in states}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= CHOICES:
                states = {step(s, chr(c)) for s, (_, c) in product(states, arg)}
            elif name == "SUBPATTERN":
                states = run(arg[3], states)
            elif name == "BRANCH":
                states = set().union(*(run(b, states) for b in arg[1]))
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                if (low, high) == (0, 1):
                    states = states | run(inner, states)
                else:
                    for _ in range(min(low, 3)):
                        states = run(inner, states)
                    if low != high or low > 3:
                        states = {(grams, "") for grams, _ in states}
            else:
                states = {(grams, "") for grams, _ in states}
        return states

    def step(state, c):
        grams, tail = state
        tail = (tail + c.lower())[-3:]
        return (grams | {tail} if len(tail) == 3 else grams), tail

    found = {grams for grams, _ in run(regex_tree.parse(pattern), {(frozenset(), "")})}
    least = [g for g in found if not any(h < g for h in found)]
    return None if frozenset() in least else sorted(least, key=sorted)


def trigram_postings(docs: DataFrame, grams: Sequence[str], *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """gram, doc_id: which documents hold which of the asked trigrams, whatever their case."""
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text).cast("string")).alias("low"))
    return low.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains("low", g))).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, kinds: documents that some rule's trigram query selects."""
    asked = [(r.kind, n, g, len(grams)) for r in rules for n, grams in enumerate(trigram_query(r.pattern) or []) for g in grams]
    spark = docs.sparkSession
    query = spark.createDataFrame(asked, "kind string, way int, gram string, need int")  # as many rows as the rules have trigrams
    postings = trigram_postings(docs, sorted({a[2] for a in asked}), text=text, doc_id=doc_id)
    hits = postings.distinct().join(F.broadcast(query), "gram").groupBy("doc_id", "kind", "way", "need").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == F.col("need")).groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the matches that are long enough, as (start, order, end, kind), by code points."""
    pattern, kind = F.lit(rule.pattern), f"array<{SPAN}>"
    none = F.array().cast(kind)

    def walk(rest: Column, found: Column, judged: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            start = a["at"] + F.coalesce(F.get(rest, i), F.lit(0))
            end = start + F.coalesce(F.get(found, i), F.lit(0))
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"),
                            (F.get(judged, i) >= rule.least).alias("ok"))
            return F.struct(end.alias("at"), F.array_append(a["spans"], span).cast(kind).alias("spans"))

        def some(a: Column, k: Column) -> Column:
            here = F.sequence(k * TOGETHER, F.least(k * TOGETHER + TOGETHER, F.size(found)) - 1)
            part = F.aggregate(here, F.struct(a["at"].alias("at"), none.alias("spans")), one)
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(a["spans"], F.filter(p["spans"], lambda s: s["ok"])).cast(kind).alias("spans")))

        # An array grows by copies, so matches are gathered some at a time.
        groups = F.sequence(F.lit(0), ((F.size(found) - 1) / TOGETHER).cast("int"))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
        return F.aggregate(groups, start, lambda a, k: F.coalesce(some(a, k), start))["spans"]

    def lengths(parts: Column) -> Column:
        return F.transform(parts, lambda x: F.length(x).cast("bigint"))

    # Each of them is made once per text, not once per match.
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    walked = let(lengths(found), lambda f: F.when(F.size(f) == 0, none).otherwise(
        let(lengths(F.split(text, rule.pattern)), lambda r: let(
            lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))), lambda j: walk(r, f, j)))))
    return F.coalesce(walked, none)


def scan_secrets(docs: DataFrame, *, base: Sequence[Rule] = BASE, more: Sequence[Rule] = MORE,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base_spans, spans: sorted arrays of (start, order, end, kind, ok), ends exclusive, in code points.

    Matches of one kind don't overlap, the leftmost counts; those whose group is too
    short are dropped. base_spans has the base kinds, spans all kinds. One row comes
    out per row that goes in. Null text counts as empty; rows with one doc_id, or with
    none, share their candidate rules and are still judged each on its own text. The work on
    a very long text grows with its length and matches, not with their product.
    """
    rules = [*base, *more]
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    left = written(candidates(docs, indexed), "secret-candidates").withColumnRenamed("doc_id", "_id")
    df = docs.join(small(left), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast(f"array<{SPAN}>")
    for n, r in enumerate(rules):
        spans = _spans(F.col("text"), r, n)
        if r in indexed:
            spans = F.when(F.array_contains("kinds", r.kind), spans).otherwise(none)
        df = df.withColumn(f"_{n}", spans)
    parts = [f"_{n}" for n in range(len(rules))]
    return df.select("doc_id", F.array_sort(F.concat(*parts[:len(base)])).alias("base_spans"), F.array_sort(F.concat(*parts)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
