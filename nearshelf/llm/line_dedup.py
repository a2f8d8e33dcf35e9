"""Line dedup: exact copies, and lines within one word's edit of an earlier line.

Edits are insertions, deletions and replacements of words. A line's deletion
neighbourhood is itself and every way to leave one word out; two lines within one
edit share a member at the same place. Members meet as hashed keys, each key keeps
its earliest line, and the edit distance to that line is verified on the words.

Lines that cannot have a partner emit no members: of two lines within one edit, the
words before or after the middle are equal, so four keys per line tell who may match,
and on which side of the middle the edit can be.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearshelf.functions.text import let
from nearshelf.llm.tables import small, written
from nearshelf.llm.text import words

PREFIX, SUFFIX = 0, 1


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("line_no", "line"))


def _half_keys(w: Column) -> Column:
    """(relation, side, key) of a line: as the one of n words, and as the shorter one of a pair whose longer has n + 1."""
    n = F.size(w)

    def keys(size, relation):
        head = F.floor(size / 2).cast("int")
        tail = (size - head).cast("int")
        return [F.struct(F.lit(relation).alias("longer"), F.lit(side).alias("side"), F.xxhash64(size.cast("int"), F.lit(side), half).alias("key"))
                for side, half in ((PREFIX, F.slice(w, F.lit(1), head)), (SUFFIX, F.slice(w, n - tail + 1, tail)))]

    return F.array(*keys(n, 0), *keys(n + 1, 1))


def near_lines(docs: DataFrame, *, min_words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, line_no, kind ("copy" or "near"): lines that an earlier line makes superfluous.

    Lines are the \\n-separated parts of a text that hold a word, compared by their words,
    in order of doc_id and place. A line is a copy if an earlier line has the same words.
    The first line with its words is near if the first place of other words within one
    word's edit is earlier; both have min_words words or more. Every line is judged
    against all lines, removed ones too, so the result depends on nothing but the texts.

    Null and empty texts have no lines. Rows without doc_id take no part. Rows that
    repeat a doc_id count as one place: neither of two equal lines there is earlier.
    """
    lines = _lines(docs, text, doc_id)
    w = F.col("_words")
    table = written(lines.withColumn("_words", words(F.col("line"))).where(F.size(w) > 0).select(
        F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2"), "doc_id", "line_no",
        F.when(F.size(w) >= min_words, _half_keys(w)).alias("keys")), "lines")
    place = F.struct("doc_id", "line_no")
    first = written(table.groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "line_no", "keys"), place).alias("first"), F.count("*").alias("n")), "first-lines")
    copies = table.select("h1", "h2", "doc_id", "line_no").join(
        first.where("n > 1").select("h1", "h2", F.struct("first.doc_id", "first.line_no").alias("at")), ["h1", "h2"]).where(place > F.col("at"))

    halves = first.where(F.col("first.keys").isNotNull()).select(
        "first.doc_id", "first.line_no", F.explode("first.keys").alias("k")).select("doc_id", "line_no", "k.*")
    met = halves.groupBy("key").agg(F.count("*").alias("n"), F.min("longer").alias("low")).where("n > 1 AND low = 0").select("key")
    asked = written(halves.join(met, "key").groupBy("doc_id", "line_no").agg(
        F.collect_set(F.struct("longer", "side")).alias("sides")), "asked-lines")
    held = written(lines.join(small(asked), ["doc_id", "line_no"]).select("doc_id", "line_no", words(F.col("line")).alias("_words"), "sides"), "asked-words")

    def has(longer: int, side: int) -> Column:
        return F.array_contains("sides", F.struct(F.lit(longer).alias("longer"), F.lit(side).alias("side")))

    n = F.size(w)
    middle = F.floor(n / 2).cast("int")
    # Places where a word may have to be left out: after the middle if the parts before it are equal, and the reverse.
    without = F.filter(F.sequence(F.lit(0), n - 1), lambda p: F.when(p >= middle, has(0, PREFIX)).otherwise(has(0, SUFFIX)))
    gap = F.floor((n + 1) / 2).cast("int")
    into = F.filter(F.sequence(F.lit(0), n), lambda p: F.when(p >= gap, has(1, PREFIX)).otherwise(has(1, SUFFIX)))
    members = F.concat(
        F.transform(without, lambda p: F.struct(
            F.xxhash64(p, n - 1, F.concat(F.slice(w, F.lit(1), p), F.slice(w, p + 2, n))).alias("key"), p.alias("p"))),
        F.transform(into, lambda p: F.struct(F.xxhash64(p, n, w).alias("key"), p.alias("p"))))
    variants = written(held.select("doc_id", "line_no", F.explode(members).alias("m")).select("doc_id", "line_no", "m.*"), "line-variants")
    earliest = variants.groupBy("key").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").select("key", "at")
    pairs = variants.join(earliest, "key").where(place > F.col("at")).select("doc_id", "line_no", "at", "p").distinct()
    other = held.select(F.struct("doc_id", "line_no").alias("at"), F.col("_words").alias("_other"))
    both = pairs.join(held.select("doc_id", "line_no", "_words"), ["doc_id", "line_no"]).join(other, "at")

    def left(x: Column, size: Column) -> Column:
        return F.when(F.size(x) >= size, F.concat(F.slice(x, F.lit(1), F.col("p")), F.slice(x, F.col("p") + 2, F.size(x) + 1))).otherwise(x)

    longest = F.greatest(F.size("_words"), F.size("_other"))
    near = both.where(left(F.col("_words"), longest) == left(F.col("_other"), longest)).select("doc_id", "line_no").distinct()
    return copies.select("doc_id", "line_no", F.lit("copy").alias("kind")).distinct().unionByName(near.withColumn("kind", F.lit("near")))


def dedup_lines(docs: DataFrame, *, min_words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the lines that near_lines names; adds n_lines, n_copies, n_near. Other lines stay as they are.

    A null text stays null. Rows without doc_id stay as they are. Columns of docs with the
    names made here, or named _id, _drop, _parts or _gone, are replaced.
    """
    found = near_lines(docs, min_words=min_words, text=text, doc_id=doc_id)
    drops = written(found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.struct("line_no", "kind")).alias("_drop")), "dropped-lines")
    docs = docs.drop("n_lines", "n_copies", "n_near", "_id", "_drop", "_parts", "_gone")
    df = docs.join(small(drops), F.col(doc_id).cast("bigint") == F.col("_id"), "left")
    df = df.withColumn("_parts", F.split(F.col(text).cast("string"), "\n"))
    df = df.withColumn("_gone", F.coalesce(F.transform("_drop", lambda s: s["line_no"]), F.array().cast("array<int>")))

    # Numbers of the lines that stay, told by hash: a document may have very many lines, and very many that go.
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))

    def number(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("_drop", lambda s: s["kind"] == kind)), F.lit(0)).cast("bigint")

    return df.select(
        *[c for c in docs.columns if c != text],
        F.when(F.size("_gone") == 0, F.col(text)).otherwise(
            F.array_join(let(F.col("_parts"), lambda p: F.transform(left, lambda i: F.get(p, i))), "\n")).alias(text),
        F.coalesce(F.size("_parts"), F.lit(0)).cast("bigint").alias("n_lines"), number("copy").alias("n_copies"), number("near").alias("n_near"))
