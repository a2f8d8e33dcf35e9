"""Quality rules: repetition and length, then divergence from the language's own histograms.

Everything is a column expression on the row of a document. The language references
are a few dozen sums, gathered by one aggregate over the counts of all documents.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.text import GAPS, total, words
from nearshelf.session import work_folder

# The most common function words of each language.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "as", "with", "be", "by", "this", "at", "are", "from"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "avec"),
}
#: What is taken out of the text in turn; the last class is what remains.
CLASSES = ("[a-z]+", "[\\x20\\x09-\\x0D]+", "[A-Z]+", "[^\\x00-\\x7F]+", "[0-9]+", "[.,;:!?'\"()-]+")
#: Positions of a text with more 3-word windows than this don't fit beside a hash.
PACKED = 1 << 24


def _histograms(df: DataFrame, common: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds _lang, _chars and _common (one count per common word, then the other words)."""
    key = F.when(F.col("_lang").isin(*common), F.col("_lang")).otherwise("")
    lists = F.create_map(*[x for k, v in {**common, "": ()}.items()
                           for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    rest = df
    for n, pattern in enumerate(CLASSES):
        before = "_text" if n == 0 else f"_rest{n - 1}"
        rest = rest.withColumn(f"_rest{n}", F.regexp_replace(before, pattern, ""))
    sizes = ["_text", *(f"_rest{n}" for n in range(len(CLASSES)))]
    chars = [F.length(a) - F.length(b) for a, b in zip(sizes, sizes[1:])] + [F.length(sizes[-1])]
    plain = F.concat(F.lit("  "), F.regexp_replace(F.lower("_text"), r"[^\p{L}]+", "  "), F.lit("  "))
    df = rest.withColumns({"_chars": F.array(*chars).cast("array<double>"), "_lang": key, "_plain": plain})
    df = df.withColumn("_hits", F.transform(
        F.element_at(lists, F.col("_lang")),
        lambda w: (F.octet_length("_plain") - F.octet_length(F.replace(F.col("_plain"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))))
        / (F.octet_length(w) + 2)))
    other = F.greatest(F.lit(0.0), F.col("n_words") - total(F.col("_hits")))
    return df.withColumn("_common", F.array_append("_hits", other)).drop("_plain", "_hits", *sizes[1:])


def _repeated_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from _words: positions inside 3-word windows that occur again in the text."""
    n = F.col("n_words").cast("int")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", windows)
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    # Hash and position in one number sort fast; equal leading bits only nominate windows.
    packed = F.when(F.col("_again") & (F.size("_h") < PACKED), F.sort_array(F.transform(
        "_h", lambda h, i: h.bitwiseAND(F.lit(-PACKED)).bitwiseOR(i.cast("bigint")))))
    df = df.withColumn("_packed", packed)

    def same(i, j):
        return F.coalesce(F.shiftright(F.get("_packed", i), 24) == F.shiftright(F.get("_packed", j), 24), F.lit(False))

    near = F.transform(
        F.filter(F.transform("_packed", lambda x, i: F.struct(x.alias("x"), (same(i, i - 1) | same(i, i + 1)).alias("ok"))), lambda s: s["ok"]),
        lambda s: s["x"].bitwiseAND(F.lit(PACKED - 1)).cast("int"))
    everywhere = F.transform("_h", lambda h, i: i)
    df = df.withColumn("_near", F.when(F.col("_again"), F.coalesce(near, everywhere)))
    df = df.withColumn("_sorted", F.array_sort(F.transform("_near", lambda i: F.struct(F.get("_h", i).alias("h"), i.alias("i")))))

    def equal(i, j):
        return F.coalesce(F.get("_sorted", i)["h"] == F.get("_sorted", j)["h"], F.lit(False))

    twice = F.filter("_sorted", lambda s, k: equal(k, k - 1) | equal(k, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    return df.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("bigint")).drop(
        "_h", "_again", "_packed", "_near", "_sorted")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; 0 if either is empty."""
    sp, sq = total(p), total(q)

    def part(x, y):
        return F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a / sp, b / sq) + part(b / sq, a / sp))
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))).otherwise(0.0)


def _base(docs: DataFrame, text: str, lang: str) -> DataFrame:
    df = docs.withColumns({"_text": F.coalesce(F.col(text).cast("string"), F.lit("")), "_lang": F.coalesce(F.col(lang).cast("string"), F.lit(""))})
    return df.withColumn("_words", words(F.col("_text"))).withColumn("n_words", F.size("_words").cast("bigint"))


def rule_features(docs: DataFrame, *, common: Mapping[str, Sequence[str]] = COMMON_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the counts of the base rules, _lang (a listed language or "") and the histograms _chars and _common."""
    df = _histograms(_base(docs, text, lang), common)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x, F.lit(GAPS))) > 0)
    df = df.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("bigint"),
        "_lines": lines,
    })
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    return _repeated_words(df).drop("_text", "_words", "_lines")


def language_references(features: DataFrame, *, common: Mapping[str, Sequence[str]] = COMMON_WORDS, min_words: int = 50) -> DataFrame:
    """One row per listed language (and "" for all others): summed histograms of all its
    documents of min_words words or more, as ref_chars and ref_common."""
    sizes = {"_chars": len(CLASSES) + 1, "_common": 1 + max(map(len, common.values()), default=0)}
    return features.where(F.col("n_words") >= min_words).groupBy("_lang").agg(*[
        F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)]).alias("ref" + c) for c, n in sizes.items()])


def quality_rules(docs: DataFrame, *, keep: Sequence[str] | None = None, common: Mapping[str, Sequence[str]] = COMMON_WORDS,
                  min_words: int = 50, max_repeat_percent: int = 50, compare_from: int = 80, max_chars: float = 0.35,
                  max_common: float = 0.45, max_common_share: float | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_common, kept.

    A document fails the base rules with fewer than min_words words, or more than
    max_repeat_percent of its words in repeated 3-word windows. Otherwise, from
    compare_from words on, it is rejected if its Jensen-Shannon distance to the
    reference of its language is over max_chars (character classes) or max_common
    (common words). max_common_share rejects as well what is further by common words than
    that share of the distance of a text without any: max_common alone may be over all of it
    and then finds only texts with too many. The references are sums over all documents. Counts and histograms
    are written once to the shared folder, with the columns of docs named in keep
    (all of them by default), so no text is read twice.

    Null text counts as empty and fails. A null or unlisted language is compared with
    all such documents, by characters only. One row comes out per row that goes in,
    repeated ones too. Columns of docs with the names made here, or that start with
    an underscore, are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_common", "kept"]
    docs = docs.drop(*made, *[c for c in docs.columns if c.startswith("_")])
    keep = docs.columns if keep is None else list(keep)
    folder = work_folder(docs.sparkSession, "quality")
    features = rule_features(docs, common=common, text=text, lang=lang)
    features.select(*keep, "_lang", "_chars", "_common", *made[:5]).write.parquet(folder)
    df = docs.sparkSession.read.parquet(folder)
    # A row per listed language and one more: bounded by the word lists, whatever the corpus.
    refs = {r["_lang"]: r for r in language_references(df, common=common, min_words=min_words).collect()}

    def reference(column: str) -> Column:
        known = [(k, r[column]) for k, r in sorted(refs.items())]
        if not known:
            return F.array().cast("array<double>")
        of = F.create_map(*[x for k, v in known for x in (F.lit(k), F.array(*map(F.lit, v)))])
        return F.slice(F.coalesce(F.element_at(of, F.col("_lang")), F.array().cast("array<double>")), 1,
                       F.size("_chars" if column == "ref_chars" else "_common"))

    df = df.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        "js_chars": F.round(_distance(F.col("_chars"), reference("ref_chars")), 6),
        "js_common": F.round(_distance(F.col("_common"), reference("ref_common")), 6),
    })
    odd = (F.col("js_chars") > max_chars) | (F.col("js_common") > max_common)
    if max_common_share is not None:
        bare = F.transform(F.col("_common"), lambda x, i: F.when(i == F.size("_common") - 1, 1.0).otherwise(0.0))
        most = _distance(bare, reference("ref_common"))
        odd = odd | ((most > 0) & (F.col("js_common") > max_common_share * most))
    far = (F.col("n_words") >= compare_from) & odd
    return df.withColumn("kept", ~F.col("base_failed") & ~far).select(*keep, *made)
