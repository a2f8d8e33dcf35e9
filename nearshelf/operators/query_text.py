"""Texts that are turned into query vectors."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearshelf import fixed_values as V
from nearshelf.functions.text import (
    brand_from_name, clean_lines, comma_items, last_items, let, squeeze, strip, text_or_null,
)


def style_text(profile: Column) -> Column:
    """Profile without its name, producer, vintage and price lines; the profile
    itself when nothing else remains, '' for none."""
    def is_style(line: Column) -> Column:
        low = F.lower(line)
        test = F.lit(True)
        for prefix in V.IDENTITY_LINE_PREFIXES:
            test = test & ~low.startswith(prefix)
        return test

    def kept_or_all(p: Column) -> Column:
        return let(clean_lines(p, keep=is_style), lambda kept: F.when(kept != "", kept).otherwise(F.coalesce(p, F.lit(""))))

    return let(profile, kept_or_all)


def _column(df: DataFrame, name: str, type_: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def origin(df: DataFrame) -> Column:
    return F.coalesce(_filled(_column(df, "country_of_origin")), _filled(_column(df, "country")))


def query_text(df: DataFrame, include_identity: bool = True) -> Column:
    """Text describing one catalog row: its stored profile, else a text built
    from its fields, else a fixed sentence."""
    col = lambda c: _filled(_column(df, c))
    stored = text_or_null(_column(df, "embedding_text"))
    name, brand = _column(df, "name"), _column(df, "brand")
    line = lambda label, c: F.concat(F.lit(label), c, F.lit("."))
    parts = []
    if include_identity:
        stated = F.when((brand != "") & (brand != V.MISSING), brand)
        guessed = _filled(brand_from_name(name))
        parts += [line("Wine: ", _filled(name)), line("Producer: ", F.coalesce(stated, guessed))]
    tags = _column(df, "keywords_list", "array<string>")
    parts += [
        line("Type/Category: ", col("category")),
        line("Origin: ", origin(df)),
        line("Bottle Size: ", col("size")),
        F.concat(F.lit("Tasting notes:\n"), col("description")),
        F.when(F.size(tags) > 0, line("Tags/Keywords: ", F.array_join(last_items(tags, V.QUERY_KEYWORDS), ", "))),
    ]
    built = clean_lines(F.concat_ws("\n", *parts))
    fallback = F.concat(F.lit(V.BUILT_TEXT_FALLBACK), F.coalesce(name, F.lit(V.UNNAMED_ITEM)), F.lit("."))
    own = (lambda s: s) if include_identity else style_text
    from_fields = let(built, lambda b: F.when(b != "", b).otherwise(fallback))
    text = let(stored, lambda s: F.when(s.isNotNull(), own(s)).otherwise(from_fields))
    if "has_metadata" in df.columns:  # false where an id has no row behind it
        text = F.when(F.coalesce("has_metadata", F.lit(False)), text).otherwise(F.lit(V.NO_ITEM_TEXT))
    return text


def query_variants(base: DataFrame) -> DataFrame:
    """Up to three query texts per base row: style, keywords, category + origin.
    Texts equal after squeezing appear once, the earliest. Returns query_id,
    variant_no, text."""
    tags = _column(base, "keywords_list", "array<string>")
    keywords = F.coalesce(_filled(_column(base, "keywords")), F.array_join(tags, ","), F.lit(""))
    cues = F.array_join(last_items(comma_items(keywords), V.VARIANT_KEYWORDS), " ")
    category = F.coalesce(_column(base, "category"), F.lit(""))
    place = F.coalesce(origin(base), F.lit(""))
    texts = F.array(
        query_text(base, include_identity=False),
        F.when(cues != "", F.concat(F.lit("Varietal/Style cues: "), cues)),
        F.when(
            (category != "") | (place != ""),
            strip(F.concat(F.lit("Category: "), category, F.lit(". Origin: "), place, F.lit("."))),
        ),
    )
    numbered = F.transform(
        texts, lambda t, i: F.struct((i + 1).alias("variant_no"), t.alias("text"), squeeze(t).alias("same"))
    )

    # at most three texts per row: duplicates are found inside the row's array
    def distinct(rows: Column) -> Column:
        same = F.transform(rows, lambda r: r["same"])
        return F.filter(
            rows,
            lambda r: (r["same"] != "") & (F.array_position(same, r["same"]) == r["variant_no"]),
        )

    return base.select("query_id", F.inline(let(numbered, distinct))).select("query_id", "variant_no", "text")


def embedding_input(text: Column, version: int = 2) -> Column:
    """Text handed to the embedding step; a fixed sentence replaces a blank one.
    Version 1 also strips it and keeps its first 3000 characters."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    if version == 1:
        return F.substring(strip(F.when(blank, F.lit(V.EMPTY_QUERY_TEXT_V1)).otherwise(text)), 1, V.QUERY_TEXT_V1_CHARS)
    return F.when(blank, F.lit(V.EMPTY_QUERY_TEXT)).otherwise(text)


def taste_words(rows: DataFrame, prefix: str = "taste_") -> DataFrame:
    """Words for the five sliders, as columns <scale>_word."""
    for scale, low, high, low_word, mid_word, high_word in V.TASTE_SCALES:
        value = F.col(prefix + scale)
        word = F.when(value <= low, low_word).when(value >= high, high_word).otherwise(mid_word)
        rows = rows.withColumn(scale + "_word", word)
    return rows


def free_text_prompt(rows: DataFrame, text: str = "text", out: str = "prompt") -> DataFrame:
    """Request text followed by the slider words as a sentence."""
    wording = F.concat_ws("; ", *[F.col(scale + "_word") for scale, *_ in V.TASTE_SCALES])
    prompt = F.concat(
        strip(F.coalesce(F.col(text), F.lit(""))), F.lit("\n\nPreferences: "), wording,
        F.lit(". " + V.FLIGHT_REQUEST),
    )
    return rows.withColumn(out, strip(prompt))
