"""Phrases whose words belong together, grown best-first from word pairs.

Texts are encoded once as word numbers, in rows of bounded size. Words and pairs are
counted for all of them. Longer phrases are only counted where they matter: a phrase
that begins with p scores at most 2 f(p) / (f(first word of p) + f(p)), so each round
grows those prefixes whose bound reaches a floor per language, and the neighbours of
phrases whose own score does, since these tell what is dropped. The floor is lowered
until the wanted number of phrases at or above it survives, or nothing is left to grow.
What was not grown then scores below the last wanted phrase, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nearshelf.llm.batches import release, slices
from nearshelf.llm.shingles import _ODD, mixed
from nearshelf.llm.tables import LARGE_ROWS, written

#: Text encoded at a time, in bytes, and codes and phrases that are summed before they leave a task.
CHUNK, CODES, PHRASES = 2_000_000, 3_000_000, 500_000
#: Codes are first counted by this many digits, so that one number holds a code and a count.
DIGITS = 40
#: Places of a filter of codes: so many per code, and at most so many (16 MB).
PLACES_PER_CODE, MOST_PLACES = 24, 1 << 27
#: Slices of a language that are ranked on their own before its final ranking.
SALTS = 64
#: Score of a phrase whose parts occur nowhere else.
BEST = 1_000_000
ENCODED = "lang string, n bigint, words array<string>, hashes binary, ids binary"
COUNTED = "lang string, phrase string, code bigint, head bigint, tail bigint, f bigint"

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def _encode(batches: Iterator) -> Iterator:
    """Rows of one language each: its distinct words, and the texts as numbers of words, -1 between pieces."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    for batch in slices(batches, size=CHUNK):
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").filter(pc.equal(langs.indices, code)).cast(pa.large_string())
            texts = pc.binary_join_element_wise(texts, pa.scalar("\n", texts.type), pa.scalar("", texts.type))
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
            raw = _LOW[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]]
            kind = _KIND[raw]
            inside = np.concatenate(([False], kind == 0, [False]))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            if not len(edges):
                continue
            # Words and the gaps between them alternate; every second one is a word.
            parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw))
            coded = parts.dictionary_encode()
            number = coded.indices.to_numpy()[::2]
            used = np.zeros(len(coded.dictionary), bool)
            used[number] = True
            words = coded.dictionary.filter(pa.array(used))
            number = (np.cumsum(used) - 1)[number]
            piece = np.searchsorted(np.flatnonzero(kind == 2), edges[::2])
            after = np.cumsum(np.concatenate(([False], piece[1:] != piece[:-1])))
            ids = np.full(len(number) + after[-1], -1, np.int32)
            ids[np.arange(len(number)) + after] = number
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
            yield pa.RecordBatch.from_arrays([
                pa.array([lang]), pa.array([len(number)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                pa.array([hashes.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], ["lang", "n", "words", "hashes", "ids"])


class Places:
    """Codes as one bit each by their last digits: a code that was put in is always found, few others are."""

    def __init__(self, codes: DataFrame, name: str = "code"):
        """codes: a written table. Its bits are joined on the executors; a bounded number of words comes to the driver."""
        size = 1 << 16
        wanted = PLACES_PER_CODE * codes.count()
        while size < min(wanted, MOST_PLACES):
            size *= 2
        place = F.col(name).bitwiseAND(size - 1)
        rows = codes.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")).alias("bit"))
        table = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.mask, self.bits = np.uint64(size - 1), np.zeros(size // 64, np.uint64)
        self.bits[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
        self.size = size

    def hold(self, codes: np.ndarray) -> np.ndarray:
        place = codes & self.mask
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _codes(words: np.ndarray, n: int, lang: np.uint64) -> np.ndarray:
    """Codes of the phrases of n words at all places, from the codes of their words."""
    size = max(0, len(words) - n + 1)
    whole = np.full(size, lang + np.uint64(n), np.uint64)
    for k in range(n):
        whole += words[k:k + size] * _ODD[k]
    return mixed(whole)


def _phrases(row, n: int, filters: dict):
    """Word numbers of a row, the places where a phrase of n words is to be counted, and the codes of all phrases of n and n - 1 words."""
    import xxhash

    ids = np.frombuffer(row["ids"], np.int32)
    hashes = np.frombuffer(row["hashes"], np.uint64)
    lang = np.uint64(xxhash.xxh3_64_intdigest(row["lang"]))
    good = np.ones(len(hashes), bool)
    if "words" in filters:
        good = filters["words"].hold(_codes(hashes, 1, lang))
    stands = (ids >= 0) & good[ids]
    words = hashes[ids]
    code = _codes(words, n, lang)
    size = len(code)
    at = np.ones(size, bool)
    for k in range(n):
        at &= stands[k:k + size]
    if "pairs" in filters and n > 2:
        frequent = filters["pairs"].hold(_codes(words, 2, lang))
        for k in range(n - 1):
            at &= frequent[k:k + size]
    part = _codes(words, n - 1, lang) if n > 1 else np.zeros(size + 1, np.uint64)
    if "heads" in filters:
        at &= filters["heads"].hold(part[:size]) | filters["tails"].hold(part[1:size + 1])
    if "whole" in filters:
        at &= filters["whole"].hold(code)
    return ids, np.flatnonzero(at), code, part


def _rows(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {"lang": batch.column("lang")[k].as_py(), "ids": batch.column("ids")[k].as_buffer(),
                   "hashes": batch.column("hashes")[k].as_buffer(), "words": batch.column("words")[k].values if "words" in batch.schema.names else None}
    release()


def _same(ids: np.ndarray, at: np.ndarray, code: np.ndarray, n: int):
    """Of the phrases at these places, one place for each different one and how often it occurs there."""
    _, first, inverse, count = np.unique(code[at], return_index=True, return_inverse=True, return_counts=True)
    if all((ids[at + k] == ids[at[first][inverse] + k]).all() for k in range(n)):
        return at[first], count
    # Two phrases with one code.
    table = np.stack([ids[at + k] for k in range(n)], axis=1)
    _, first, count = np.unique(table, axis=0, return_index=True, return_counts=True)
    return at[first], count


def _count(encoded: DataFrame, n: int, least: int, filters: dict[str, Places]) -> DataFrame:
    """Exact counts of the phrases of n words that the filters ask for, those that occur least times or more.

    First by code only, so that the many rare phrases never travel as strings; phrases that
    are asked for as a whole are not rare.
    """
    spark = encoded.sparkSession
    given = spark.sparkContext.broadcast(filters)
    frequent = given

    def by_code(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def summed(some: list):
            codes, counts = np.unique(np.concatenate(some) & np.uint64((1 << DIGITS) - 1), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((codes << np.uint64(64 - DIGITS)).view(np.int64) | counts)], ["both"])

        held, size = [], 0
        for row in _rows(batches):
            _, at, code, _ = _phrases(row, n, given.value)
            held.append(code[at])
            size += len(at)
            if size >= CODES:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    if "whole" not in filters:
        both = encoded.select("lang", "hashes", "ids").mapInArrow(by_code, "both bigint")
        code = F.shiftrightunsigned("both", 64 - DIGITS)
        if n > 1:
            # Most codes are summed already: doing it again before the exchange saves nothing.
            both = both.repartition(code)
        codes = both.groupBy(code.alias("code")).agg(F.sum(F.col("both").bitwiseAND((1 << 64 - DIGITS) - 1)).alias("f"))
        codes = codes.where(F.col("f") >= least).select("code")
        frequent = spark.sparkContext.broadcast({"whole": Places(written(codes, "codes"))})

    def by_phrase(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def summed(some: list):
            table = pa.concat_tables(some).combine_chunks()
            _, first, inverse = np.unique(table.column("code").to_numpy(), return_index=True, return_inverse=True)
            firsts, again = table.take(first), pa.array(inverse)
            if all(firsts.column(c).take(again).equals(table.column(c)) for c in ("lang", "phrase")):
                counts = np.bincount(inverse, table.column("f").to_numpy(), len(first)).astype(np.int64)
                table = firsts.set_column(5, "f", pa.array(counts))
            return table

        held, size = [], 0
        for row in _rows(batches):
            ids, at, code, part = _phrases(row, n, given.value)
            at = at[frequent.value["whole"].hold(code[at])]
            at, counts = _same(ids, at, code, n)
            words = [row["words"].take(pa.array(ids[at + k])) for k in range(n)]
            phrase = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
            head, tail = (part[at], part[at + 1]) if n > 1 else (code[at], code[at])
            held.append(pa.table([
                pa.repeat(pa.scalar(row["lang"], pa.string()), len(at)), phrase, *(pa.array(x.view(np.int64)) for x in (code[at], head, tail)),
                pa.array(counts.astype(np.int64))], ["lang", "phrase", "code", "head", "tail", "f"]))
            size += len(at)
            if size >= 2 * PHRASES:
                # What is left stays for the rows to come, unless the sum has become large itself.
                held = [summed(held)]
                size = held[0].num_rows
                if size >= PHRASES:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    found = encoded.mapInArrow(by_phrase, COUNTED).groupBy("lang", "phrase").agg(
        *(F.first(c).alias(c) for c in ("code", "head", "tail")), F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(found, f"phrases-{n}")


def _ratio(a: Column, b: Column) -> Column:
    """floor(2000000 a / b), exact beyond 64 bits."""
    wide = "decimal(30,0)"
    return F.call_function("div", F.lit(2 * BEST).cast("decimal(8,0)") * a.cast(wide), b.cast(wide))


def _part(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases (lang, phrase, code, head, tail, f) with l, r and score of the lowest-scoring cut and bound,
    what a longer phrase with this beginning scores at most. Phrases with a part that was not counted are left out."""
    words = F.split("phrase", " ", -1)
    cuts = phrases.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumn("left", _part(F.col("w"), F.lit(1), F.col("k"))).withColumn("right", _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], "left")
    score = _ratio(F.col("f"), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)"))
    first = F.max(F.when(F.col("k") == 1, F.col("l")))
    found = cuts.withColumn("score", score).groupBy("lang", "phrase", "code", "head", "tail", "f").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("lowest"), F.count("l").alias("lefts"), F.count("r").alias("rights"),
        F.count("*").alias("cuts"), first.alias("first"))
    whole = found.where("lefts = cuts AND rights = cuts")
    bound = _ratio(F.col("f"), F.col("first").cast("decimal(20,0)") + F.col("f").cast("decimal(20,0)"))
    return whole.select("lang", "phrase", "code", "head", "tail", "f", "lowest.l", "lowest.r", "lowest.score", bound.alias("bound"))


def _floors(pairs: DataFrame, aim: int) -> DataFrame:
    """lang, floor: a score that aim pairs of the language reach; 0 where it has fewer."""
    # At most 10,001 steps of 100 per language.
    steps = pairs.groupBy("lang", F.expr("score div 100").alias("step")).agg(F.count("*").alias("here"))
    above = F.sum("here").over(W.partitionBy("lang").orderBy(F.desc("step")))
    reached = steps.withColumn("above", above)
    return reached.groupBy("lang").agg((F.coalesce(F.max(F.when(F.col("above") >= aim, F.col("step"))), F.lit(0)) * 100).alias("floor"))


def _survivors(scored: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """scored without the phrases that occur inside a phrase with one more word in share percent of their cases or more."""
    words = F.split("phrase", " ", -1)
    size = F.size(words) - 1
    inside = longer.select("lang", "f", F.explode(F.array(_part(words, F.lit(1), size), _part(words, F.lit(2), size))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    wide = "decimal(30,0)"
    swallowed = F.col("most").cast(wide) * F.lit(100).cast("decimal(4,0)") >= F.col("f").cast(wide) * F.lit(share).cast("decimal(4,0)")
    return scored.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(swallowed, F.lit(False))).drop("most")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; slices of a language are cut first, so that ties without end don't meet in one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("salt")


def mine_phrases(docs: DataFrame, *, longest: int = 4, least: int = 30, top: int = 2_000, share: int = 80,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """The first top phrases of each language: lang, rank, phrase, a, l, r, n, score, n_words.

    A-Z are lower-cased; `. , ; : ! ?` and line ends part pieces, spaces and tabs words. A
    phrase is 2 to longest (4 at most) words of one piece that occur a >= least times,
    overlaps included. Its score is floor(2000000 a / (l + r)) of the cut that makes
    it lowest (of equal ones the first), l and r being the counts of both parts. Phrases
    inside a longer one with at least share percent of their count are left out. n is
    the number of words of the language.

    Null texts count as empty, a null lang as `und`. Repeated rows count as often as they
    stand there; columns other than these two are not read. A very long text is encoded on
    its own. Ties go by a, then by the phrase's bytes. An empty table gives no row.
    """
    if not 2 <= longest <= 4:
        raise ValueError("longest must be 2, 3 or 4")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    folder = written(rows.mapInArrow(_encode, ENCODED), "words", **LARGE_ROWS)
    totals = folder.groupBy("lang").agg(F.sum("n").alias("n"))
    words = _count(folder, 1, least, {})
    known = {"words": Places(words)}
    pairs = _count(folder, 2, least, known)
    known["pairs"] = Places(pairs)
    base = words.unionByName(pairs)
    scored_pairs = written(_scored(pairs, base), "scored-2")

    settled, open_langs, aim = [], scored_pairs.select("lang").distinct(), 2 * top
    while True:
        floors = written(_floors(scored_pairs.join(open_langs, "lang", "left_semi"), aim), "floors")
        encoded = folder.join(floors.select("lang"), "lang", "left_semi")
        counts, scored, kept = base, scored_pairs.join(floors, "lang"), []
        for n in range(2, longest):
            reach = F.col("score") >= F.col("floor")
            grow = written(scored.where(reach | (F.col("bound") >= F.col("floor"))).select("code", reach.alias("reach")), "grow")
            longer = _count(encoded, n + 1, least, known | {"heads": Places(grow), "tails": Places(grow.where("reach"))})
            kept.append(_survivors(scored.where(reach), longer, share))
            if n > 2:
                # Their right parts may begin with something that was not grown.
                tails = Places(written(longer.select(F.col("tail").alias("code")).distinct(), "tails"))
                counts = counts.where(F.size(F.split("phrase", " ", -1)) < n).unionByName(_count(encoded, n, least, known | {"whole": tails})).unionByName(
                    scored.select(base.columns)).dropDuplicates(["lang", "phrase"])
            scored = written(_scored(longer, counts.unionByName(longer)), f"scored-{n + 1}").join(floors, "lang")
            counts = counts.unionByName(longer)
        kept.append(scored.where(F.col("score") >= F.col("floor")))
        found = written(reduce(DataFrame.unionByName, kept), "survivors")
        enough = found.groupBy("lang").agg(F.count("*").alias("found"))
        states = written(floors.join(enough, "lang", "left").select("lang", (F.coalesce("found", F.lit(0)) >= top).alias("full"), "floor"), "states")
        done = states.where("full OR floor = 0").select("lang")
        settled.append(found.join(done, "lang", "left_semi"))
        open_langs = states.where("NOT full AND floor > 0").select("lang")
        if open_langs.isEmpty():
            break
        aim *= 4
    out = reduce(DataFrame.unionByName, settled).withColumnRenamed("f", "a")
    return _ranked(out, top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", F.size(F.split("phrase", " ", -1)).alias("n_words"))
