"""Language identification by unigram pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary. Every language has a probability per
piece; the probability of a word is the sum over all ways to cut it into pieces, by
the forward algorithm, run once per distinct word of a batch on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from nearshelf.llm.batches import slices
from nearshelf.llm.tables import small, written
from nearshelf.llm.worker import kept

#: Words of more letters (the mark included) are summed one by one, their forward values kept in range on the way,
#: with the pieces of so many places looked up at a time.
LONG, PLACES = 49, 100_000
MARK = "▁"
#: Probability of a letter outside the vocabulary, and what a letter's probability is scaled by to stay in range.
FLOOR, SCALE = 1e-7, 500.0
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 250_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letter_pieces(model: str) -> tuple[list[str], object]:
    """Pieces of letters, with or without the mark of a word's beginning, and the model."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=model)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return sorted({p for p in pieces if p.removeprefix(MARK).isalpha() or p == MARK}), processor


class Pieces:
    """Vocabulary pieces by a rolling hash of their letters."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        codes = [self._code(p) for p in pieces]
        order = np.argsort(np.array(codes, np.uint64))
        self.codes = np.array(codes, np.uint64)[order]
        self.of = order
        self.sizes = np.array([len(p) for p in pieces])

    @staticmethod
    def _code(piece: str) -> int:
        code = 0
        for c in piece:
            code = (code * int(MULTIPLIER) + ord(c) + 1) & (2**64 - 1)
        return code

    def log_likelihoods(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Natural logarithms, one row per word and one column per language; probability: (pieces, languages), scaled."""
        out = np.zeros((len(words), probability.shape[1]))
        sizes = np.array([len(w) for w in words])
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self._long(words[k], probability)
        for size in np.unique(sizes[sizes <= LONG]):
            for some in np.array_split(np.flatnonzero(sizes == size), max(1, (sizes == size).sum() * size // 500_000)):
                letters = np.array([words[k] for k in some], f"U{size}").view(np.uint32).reshape(len(some), size).astype(np.uint64)
                ahead = np.zeros((size + 1, len(some), probability.shape[1]))
                ahead[0] = 1.0
                for i in range(size):
                    code = np.zeros(len(some), np.uint64)
                    for n in range(1, min(self.longest, size - i) + 1):
                        code = code * MULTIPLIER + letters[:, i + n - 1] + np.uint64(1)
                        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                        hit = self.codes[at] == code
                        if hit.any():
                            ahead[i + n][hit] += ahead[i][hit] * probability[self.of[at[hit]]]
                        if n == 1 and not hit.all():
                            ahead[i + 1][~hit] += ahead[i][~hit] * (FLOOR * SCALE)
                out[some] = np.log(ahead[size]) - size * np.log(SCALE)
        return out

    def _long(self, word: str, probability: np.ndarray) -> np.ndarray:
        """The same for one word of any length, holding the forward values of the next places only."""
        langs = probability.shape[1]
        unknown, none = len(probability), len(probability) + 1
        table = np.vstack((probability, np.full((1, langs), FLOOR * SCALE), np.zeros((1, langs))))
        letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        ahead, scale = np.zeros((self.longest + 1, langs)), np.zeros(langs)
        ahead[0] = 1.0
        for a in range(0, len(letters), PLACES):
            size = min(PLACES, len(letters) - a)
            piece = np.full((size, self.longest), none)
            code = np.zeros(size, np.uint64)
            for n in range(1, self.longest + 1):
                code = code[:len(letters) - a - n + 1]
                code = code * MULTIPLIER + letters[a + n - 1:a + n - 1 + len(code)] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                piece[:len(code), n - 1] = np.where(self.codes[at] == code, self.of[at], unknown if n == 1 else none)
            for i in range(size):
                ahead[1:] += ahead[0] * table[piece[i]]
                ahead[:-1] = ahead[1:]
                ahead[-1] = 0.0
                if i % 32 == 31:
                    most = ahead.max(0)
                    ahead /= most
                    scale += np.log(most)
        return np.log(ahead[0]) + scale - len(letters) * np.log(SCALE)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: a fifth by crc32 of the doc_id, and rows without one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def learn_pieces(docs: DataFrame, *, model: str, docs_per_language: int = 1_500, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """lang, piece, n: how often the vocabulary's own segmentation of a language's words has a piece.

    Learned from docs_per_language documents of each language at most, those with the
    smallest hash of their doc_id, never from held-out ones.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    ids = rows.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id")).distinct()
    # Ranked among the ids of a slice of the hashes first, so that no task holds all ids of a language.
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = ids.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    for keys in (["lang", "_salt"], ["lang"]):
        first = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= docs_per_language)
    ids = written(ids.select("lang", "doc_id"), "language-sample")
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    narrow = rows.join(small(ids), ["lang", "doc_id"])

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pandas as pd
        import regex

        pieces, processor = kept(("pieces", model), lambda: letter_pieces(model))
        known, word = set(pieces), regex.compile(r"\p{L}+")
        for batch in batches:
            seen: dict[str, Counter] = {}
            for name, t in zip(batch["lang"], batch["text"]):
                seen.setdefault(name, Counter()).update(word.findall(t.lower()))
            for name, words in seen.items():
                total: Counter = Counter()
                for pieces_of, n in zip(processor.encode(list(words), out_type=str), words.values()):
                    for p in pieces_of:
                        total[p] += n
                total = {p: n for p, n in total.items() if p in known}
                yield pd.DataFrame({"lang": name, "piece": list(total), "n": list(total.values())})

    return narrow.select("lang", "text").mapInPandas(count, "lang string, piece string, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def identify_language(docs: DataFrame, *, model: str, docs_per_language: int = 1_500, smoothing: float = 0.1,
                      text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    lang_pred is the learned language under which the whole text's letters, lower-cased
    and in words, are most likely; of equally likely ones the first in the alphabet.
    score is its posterior probability with equal priors. Runs of letters of any length
    are summed over all their segmentations. Null texts and texts without a
    letter are und with score 0, as is everything if no document has a language to learn.
    model names a sentencepiece file that every worker can open. Only text is used to
    predict; one row comes out per row that goes in.
    """
    # One number per piece and language: bounded by the vocabulary.
    counts = learn_pieces(docs, model=model, docs_per_language=docs_per_language, text=text, lang=lang, doc_id=doc_id).collect()
    languages = sorted({r["lang"] for r in counts})
    pieces, _ = letter_pieces(model)
    place = {p: k for k, p in enumerate(pieces)}
    table = np.full((len(pieces), len(languages)), smoothing)
    for r in counts:
        table[place[r["piece"]], languages.index(r["lang"])] += r["n"]
    table /= table.sum(0, keepdims=True) if languages else 1.0
    table *= np.power(SCALE, [len(p) for p in pieces])[:, None]
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, table))
    kind = docs.schema[doc_id].dataType.simpleString()

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces, languages, table = shared.value
        finder, numbers, logs = Pieces(pieces), {}, np.zeros((0, len(languages)))
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            bare = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "), " ")
            split = pc.split_pattern(bare, " ")
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(numbers) > REMEMBERED:
                numbers, logs = {}, logs[:0]
            new = [w for w in words if w and w not in numbers]
            if new and languages:
                found = finder.log_likelihoods([MARK + w for w in new], table)
                numbers.update(zip(new, range(len(logs), len(logs) + len(new))))
                logs = np.concatenate((logs, found))
            row = np.concatenate((logs, np.zeros((1, len(languages)))))
            which = np.array([numbers.get(w, len(logs)) for w in words], np.int64)[coded.indices.to_numpy()]
            counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(counts) - counts
            total = np.add.reduceat(row[which], starts) if len(which) else np.zeros((len(texts), len(languages)))
            lettered = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
            best = total.argmax(1) if languages else np.zeros(len(texts), int)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if languages else np.zeros(len(texts))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist())], pa.string()),
                "score": pa.array(np.where(lettered, share, 0.0))})

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
