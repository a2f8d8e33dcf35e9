"""Data around comparison notes: inputs of the prompts, parsing of the answers.

No model is called here. The instruction wording belongs to the caller: it is a
template with {placeholders}, filled from columns.
"""

import re

from pyspark.sql import Column, DataFrame, functions as F

from nearshelf import fixed_values as V
from nearshelf.functions.text import brand_from_name, strip

PAIR_TEMPLATE = (
    'Compare two items for a customer.\n'
    'Chosen: "{base_name}" (Details: {base_details})\n'
    'Recommended: "{rec_name}" (Details: {rec_details})\n'
    "Answer in three parts divided by " + V.SECTION_SEPARATOR + ":\n"
    + V.SECTION_LABELS[0] + " what the customer likely enjoys about the chosen item\n"
    + V.SECTION_LABELS[1] + " why the recommended item fits\n"
    + V.SECTION_LABELS[2] + " a comparison by characteristic"
)
BASE_TEMPLATE = 'Details of "{base_name}": {base_details}\nSay in one or two sentences what is enjoyable about it.'
PAIR_TEMPLATE_V1 = (
    'The customer likes "{base_name}" and is offered "{rec_name}".\n'
    '"{base_name}": category {base_category}, country {base_country}, notes {base_notes}\n'
    '"{rec_name}": category {rec_category}, country {rec_country}, notes {rec_notes}\n'
    "Explain the similarity in two or three sentences."
)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Template text with its {names} replaced by column values."""
    parts = [
        values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) and p[1:-1] in values else F.lit(p)
        for p in re.split(r"(\{\w+\})", template) if p
    ]
    return F.concat(*parts)


def review_snippets(reviews_json: Column, n: int = 2) -> Column:
    """First n reviews, those with text as quoted beginnings, joined."""
    listed = F.slice(F.try_variant_get(F.try_parse_json(reviews_json), "$", "array<variant>"), 1, n)
    texts = F.transform(listed, lambda r: F.nullif(F.try_variant_get(r, "$.review", "string"), F.lit("")))
    quoted = F.transform(
        F.filter(texts, lambda t: t.isNotNull()),
        lambda t: F.concat(F.lit('"'), F.substring(t, 1, V.SNIPPET_CHARS), F.lit('..."')),
    )
    return F.coalesce(F.nullif(F.array_join(quoted, "; "), F.lit("")), F.lit(V.NO_REVIEWS_TEXT))


def _prompt_brand(brand: Column, name: Column) -> Column:
    stated = F.when((brand != "") & (brand != V.MISSING), brand)
    return F.coalesce(stated, F.nullif(brand_from_name(name), F.lit("")), F.lit(V.MISSING))


def _details(side: str, default_name: str, no_description: str, cut: int, snippets: int) -> Column:
    c = lambda name: F.col(f"{side}_{name}")
    or_missing = lambda x: F.coalesce(x, F.lit(V.MISSING))
    return F.concat(
        F.lit("Category: "), or_missing(c("category")),
        F.lit(", Origin: "), or_missing(c("country")),
        F.lit(", Producer: "), _prompt_brand(c("brand"), F.coalesce(c("name"), F.lit(default_name))),
        F.lit(", Description: "), F.substring(F.coalesce(c("description"), F.lit(no_description)), 1, cut),
        F.lit("..., Reviews: "), review_snippets(c("reviews_json"), snippets),
    )


PAIR_LIMITS = (V.PAIR_NO_DESCRIPTION, V.PAIR_DESCRIPTION_CHARS, V.PAIR_SNIPPETS)
BASE_LIMITS = (V.BASE_NO_DESCRIPTION, V.BASE_DESCRIPTION_CHARS, V.BASE_SNIPPETS)
BASE_FIELDS = ["name", "brand", "category", "country", "description", "reviews_json"]


def _side(df: DataFrame, side: str, keys: list[str], fields: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(f).alias(f"{side}_{f}") for f in fields])


def pair_prompts(recs: DataFrame, base: DataFrame, template: str = PAIR_TEMPLATE) -> DataFrame:
    """Prompt of every (base item, recommended item) pair: query_id, id,
    base_details, rec_details, prompt. Both sides carry name, brand, category,
    country, description, reviews_json."""
    pairs = _side(recs, "rec", ["query_id", "id"], BASE_FIELDS).join(
        _side(base, "base", ["query_id"], BASE_FIELDS), "query_id"
    )
    rows = pairs.select(
        "query_id", "id",
        F.coalesce("base_name", F.lit(V.BASE_NAME_DEFAULT)).alias("base_name"),
        F.coalesce("rec_name", F.lit(V.RECOMMENDED_NAME_DEFAULT)).alias("rec_name"),
        _details("base", V.BASE_NAME_DEFAULT, *PAIR_LIMITS).alias("base_details"),
        _details("rec", V.RECOMMENDED_NAME_DEFAULT, *PAIR_LIMITS).alias("rec_details"),
    )
    values = {c: F.col(c) for c in ("base_name", "rec_name", "base_details", "rec_details")}
    return rows.withColumn("prompt", fill_template(template, values)).select(
        "query_id", "id", "base_details", "rec_details", "prompt"
    )


def base_prompts(base: DataFrame, template: str = BASE_TEMPLATE) -> DataFrame:
    """Prompt about the base item alone: query_id, base_details, prompt."""
    rows = _side(base, "base", ["query_id"], BASE_FIELDS).select(
        "query_id",
        F.coalesce("base_name", F.lit(V.BASE_NAME_DEFAULT)).alias("base_name"),
        _details("base", "", *BASE_LIMITS).alias("base_details"),
    )
    values = {c: F.col(c) for c in ("base_name", "base_details")}
    return rows.withColumn("prompt", fill_template(template, values)).select("query_id", "base_details", "prompt")


def pair_prompts_v1(recs: DataFrame, base: DataFrame, template: str = PAIR_TEMPLATE_V1) -> DataFrame:
    """Earlier prompt: up to three review texts per side, as a JSON list. When
    either side's reviews cannot be parsed both count as empty."""
    fields = ["name", "category", "country", "reviews_json"]
    pairs = _side(recs, "rec", ["query_id", "id"], fields).join(_side(base, "base", ["query_id"], fields), "query_id")
    parsed = {s: F.try_parse_json(F.coalesce(F.col(f"{s}_reviews_json"), F.lit("[]"))) for s in ("base", "rec")}
    readable = parsed["base"].isNotNull() & parsed["rec"].isNotNull()

    def notes(side: str) -> Column:
        listed = F.slice(F.try_variant_get(parsed[side], "$", "array<variant>"), 1, V.V1_REVIEWS)
        texts = F.transform(
            listed, lambda r: F.coalesce(F.try_variant_get(r, "$.review", "string"), F.lit(V.V1_NO_REVIEW))
        )
        return F.when(readable & texts.isNotNull(), F.to_json(texts)).otherwise(F.lit("[]"))

    or_unknown = lambda c: F.coalesce(F.col(c), F.lit(V.V1_UNKNOWN))
    values = {
        "base_name": or_unknown("base_name"), "rec_name": or_unknown("rec_name"),
        "base_category": or_unknown("base_category"), "rec_category": or_unknown("rec_category"),
        "base_country": or_unknown("base_country"), "rec_country": or_unknown("rec_country"),
        "base_notes": notes("base"), "rec_notes": notes("rec"),
    }
    return pairs.select(
        "query_id", "id", values["base_notes"].alias("base_notes"), values["rec_notes"].alias("rec_notes"),
        fill_template(template, values).alias("prompt"),
    )


def parse_sections(responses: DataFrame) -> DataFrame:
    """Three named sections of each response; default sentences where a part is
    blank, the whole text as comparison when there are not exactly three parts.
    responses: query_id, id, base_name, rec_name, response."""
    whole = strip(F.col("response"))
    parts = F.split(whole, r"\|\|END_SECTION\|\|", -1)
    three = F.size(parts) == 3
    part = lambda i: F.nullif(strip(F.replace(F.get(parts, F.lit(i)), F.lit(V.SECTION_LABELS[i]), F.lit(""))), F.lit(""))
    names = {"base_name": F.col("base_name"), "rec_name": F.col("rec_name")}
    base_default = fill_template(V.BASE_BLURB_DEFAULT, names)
    rec_default = fill_template(V.RECOMMENDED_BLURB_DEFAULT, names)
    return responses.select(
        "query_id", "id",
        F.coalesce(F.when(three, part(0)), base_default).alias("base_wine_blurb"),
        F.coalesce(F.when(three, part(1)), rec_default).alias("recommended_wine_blurb"),
        F.when(three, F.coalesce(part(2), F.lit(V.NOTES_PENDING_TEXT)))
        .otherwise(F.coalesce(F.concat(F.lit(V.UNSPLIT_NOTES_HEADING), whole), F.lit(V.NOTES_PENDING_TEXT)))
        .alias("detailed_comparison_markdown"),
    )


def base_blurb(responses: DataFrame) -> DataFrame:
    """Blurb of the base item, a default sentence where the answer is blank.
    responses: query_id, base_name, response."""
    default = fill_template(V.BASE_ONLY_BLURB_DEFAULT, {"base_name": F.col("base_name")})
    answer = F.nullif(strip(F.col("response")), F.lit(""))
    return responses.select("query_id", F.coalesce(answer, default).alias("base_wine_blurb"))


def pending_notes(recs: DataFrame, explained: DataFrame) -> DataFrame:
    """Recommendations that have no notes yet."""
    return recs.join(explained.select("query_id", "id"), ["query_id", "id"], "left_anti")
