"""Benchmark decontamination: test items in a BM25 index, every training passage a query by block-max WAND.

An item's scores are divided by what its own text would score, so one threshold
fits all. The index of a part of the items of bounded size goes to every task;
a larger benchmark takes several passes.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.tables import written
from nearshelf.llm.worker import kept

TERM = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Words of items in one index, and postings between two block maxima.
PART_WORDS, BLOCK = 500_000, 32
GRAM = 3


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Terms of all sentences but the last, and of the last; an item of one sentence is a question without answer."""
    parts = [terms(p) for p in SENTENCE.split(text)]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return (parts or [[]])[0], []
    return [t for p in parts[:-1] for t in p], parts[-1]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


class ImpactIndex:
    """Postings by term: items in order with their share of the item's own score, and the most of every block."""

    def __init__(self, items: list[tuple], n_items: int, mean_length: float, k1: float, b: float, common: float):
        """items: (id, question terms, answer terms, {term: items that hold it})."""
        self.ids = [i for i, *_ in items]
        self.question = [grams(q) for _, q, *_ in items]
        self.answer = [grams(a) for _, _, a, _ in items]
        self.longest = max((len(q) + len(a) for _, q, a, _ in items), default=0)
        lists: dict[str, list] = {}
        for n, (_, q, a, held) in enumerate(items):
            words = q + a
            weight = {}
            for t in set(words):
                tf, idf = words.count(t), math.log(1 + (n_items - held[t] + 0.5) / (held[t] + 0.5))
                weight[t] = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean_length))
            own = sum(weight.values())
            for t, x in weight.items():
                lists.setdefault(t, []).append((n, x / own))
        self.number = {t: k for k, t in enumerate(lists)}
        self.items = [[n for n, _ in p] for p in lists.values()]
        self.impact = [[x for _, x in p] for p in lists.values()]
        self.block = [[max(x[a:a + BLOCK]) for a in range(0, len(x), BLOCK)] for x in self.impact]
        self.top = np.array([max(x) for x in self.impact] or [0.0])
        # Of every item, the terms that most items hold may add common of its score at most; a passage
        # that reaches the bound holds the rest of it in the other, essential terms.
        held, least_left, essential = [len(x) for x in self.items], [], [[] for _ in self.items]
        for n, (_, q, a, _) in enumerate(items):
            so_far, rare = 0.0, False
            for t in sorted({self.number[w] for w in q + a}, key=lambda t: (-held[t], t)):
                x = self.impact[t][bisect_left(self.items[t], n)]
                rare = rare or so_far + x > common
                if rare:
                    essential[t].append((n, x))
                else:
                    so_far += x
            least_left.append(so_far)
        self.slack = np.array(least_left or [0.0])
        self.essential_size = np.array([len(e) for e in essential] or [0])
        self.essential_from = np.cumsum(self.essential_size) - self.essential_size
        flat = [x for e in essential for x in e]
        self.essential_item = np.array([n for n, _ in flat], np.int64)
        self.essential_impact = np.array([x for _, x in flat])

    def search(self, asked: list[int], least: float) -> list[tuple[int, float]]:
        """Items that score least or more for a set of terms, in order."""
        least -= 1e-9
        at, out = dict.fromkeys(asked, 0), []
        while at:
            order = sorted(at, key=lambda t: self.items[t][at[t]])
            bound, pivot = 0.0, None
            for k, t in enumerate(order):
                bound += self.top[t]
                if bound >= least:
                    pivot = self.items[t][at[t]]
                    break
            if pivot is None:
                break
            before = [t for t in order if self.items[t][at[t]] <= pivot]
            places = {t: self._seek(t, at[t], pivot) for t in before}
            in_block = sum(self.block[t][p // BLOCK] for t, p in places.items() if p < len(self.items[t]))
            if in_block >= least:
                score = sum(self.impact[t][p] for t, p in places.items() if p < len(self.items[t]) and self.items[t][p] == pivot)
                if score >= least:
                    out.append((pivot, score))
                go = pivot + 1
            else:
                # Nothing up to the end of the nearest block, or before the next list begins, can reach the bound.
                ends = [self.items[t][min((p // BLOCK + 1) * BLOCK, len(self.items[t])) - 1] + 1 for t, p in places.items() if p < len(self.items[t])]
                rest = [self.items[t][at[t]] for t in order[len(before):]]
                go = max(pivot + 1, min(ends + rest, default=pivot + 1))
            for t in before:
                at[t] = self._seek(t, places[t], go)
                if at[t] >= len(self.items[t]):
                    del at[t]
        return out

    def _seek(self, t: int, p: int, item: int) -> int:
        held = self.items[t]
        while p < len(held) and held[p] < item:
            p = p + BLOCK if p + BLOCK < len(held) and held[p + BLOCK] <= item else p + 1
        return p

    def passages(self, words: list[str], least: float) -> Iterator[tuple[int, list[int]]]:
        """(first word, terms) of the passages that may reach the bound by some item's essential terms. Passages are
        twice as long as the longest item and begin every such length, so each item-long stretch lies in one."""
        step, number, n = max(1, self.longest), self.number, len(self.slack)
        known = np.array([number.get(w, -1) for w in words], np.int64)
        place = np.flatnonzero(known >= 0)
        place = place[self.essential_size[known[place]] > 0]
        if not len(place):
            return
        window, term, width = place // step, known[place], len(self.top)
        pairs = np.unique(np.concatenate((window * width + term, (window - 1)[window > 0] * width + term[window > 0])))
        window, term = pairs // width, pairs % width
        size = self.essential_size[term]
        at = np.repeat(self.essential_from[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both, place = np.unique(np.repeat(window, size) * n + self.essential_item[at], return_inverse=True)
        bound = np.bincount(place, weights=self.essential_impact[at]) + self.slack[both % n]
        for k in np.unique(both[bound >= least - 1e-9] // n).tolist():
            yield k * step, np.unique(known[k * step:(k + 2) * step]).tolist()

    def matches(self, text: str, least: float, least_question: float, least_answer: float) -> dict[int, tuple[float, float, float]]:
        """Item -> best (score, question overlap, answer overlap) of its verified passages."""
        words, found = terms(text), {}
        for first, asked in self.passages(words, least):
            held = None
            for item, score in self.search([t for t in asked if t >= 0], least):
                held = held or grams_of(words[first:first + 2 * max(1, self.longest)])
                q = overlap(self.question[item], held)
                a = overlap(self.answer[item], held)
                if q >= least_question and a >= least_answer:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return found


def grams_of(words: list[str]) -> set[tuple[str, ...]]:
    """All runs of up to GRAM words."""
    return {tuple(words[i:i + n]) for n in range(1, GRAM + 1) for i in range(len(words) - n + 1)}


def overlap(part: set, held: set) -> float:
    """Share of an item's part that a passage holds; 1 for an empty part."""
    return len(part & held) / len(part) if part else 1.0


def _item_terms(batches):
    import pandas as pd

    for batch in batches:
        pairs = [question_and_answer(t) for t in batch["text"]]
        yield pd.DataFrame({"item_id": batch["item_id"], "question": [q for q, _ in pairs], "answer": [a for _, a in pairs]})


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, least_question: float = 0.7, least_answer: float = 0.5,
                       min_item_words: int = 5, k1: float = 1.2, b: float = 0.75, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every test item found in a document.

    Words are compared lower-cased, without marks. A passage of a document retrieves all
    items whose BM25 score for its words is at least least of the item's score for its own
    words. A hit stands if the passage holds least_question of the three-word runs of
    the item's question (all sentences but the last) and least_answer of those of its
    answer (the last sentence). The best hit per document and item is returned.

    Null and empty texts match nothing; items with fewer than min_item_words words are
    left out. Rows with one doc_id (or none) count as one document, items with one
    item_id and other text as two of that id. No item or no row, no result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    items = items.mapInPandas(_item_terms, "item_id bigint, question array<string>, answer array<string>")
    items = written(items.where(F.size("question") + F.size("answer") >= min_item_words), "benchmark-terms")
    words = F.concat("question", "answer")
    n_items, n_words = items.agg(F.count("*"), F.coalesce(F.sum(F.size(words)), F.lit(0))).first()
    parts = max(1, math.ceil(n_words / PART_WORDS))
    keyed = items.withColumn("row", F.xxhash64("item_id", "question", "answer"))
    each = keyed.select("row", F.explode(F.array_distinct(words)).alias("term"))
    held = each.join(each.groupBy("term").agg(F.count("*").alias("n")), "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("held"))
    prepared = written(keyed.join(held, "row"), "benchmark-index")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    out = None
    for part in range(parts):
        # About PART_WORDS words of items at a time, whatever the benchmark's size.
        rows = prepared.where(F.pmod("row", F.lit(parts)) == part).orderBy("item_id", "row").collect() if n_items else []
        shared = spark.sparkContext.broadcast([(r["item_id"], r["question"], r["answer"], r["held"]) for r in rows])

        def scan(batches, shared=shared, key=("items", uuid.uuid4().hex)):
            import pandas as pd

            index = kept(key, lambda: ImpactIndex(shared.value, n_items, n_words / max(1, n_items), k1, b, 0.6 * least))
            for batch in batches:
                hits = [(d, index.ids[i], *x) for d, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()) if t
                        for i, x in index.matches(t, least, least_question, least_answer).items()]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = narrow.mapInPandas(scan, f"doc_id {kind}, item_id bigint, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct(F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
