"""Product records out of raw pages that embed JSON-LD.

Everything is built-in expressions over VARIANT values: a page is parsed once,
in its own row, without any exchange. The step from page to product is an
`explode`, a generator, so that filters on product fields are not pushed below
it and the JSON is not parsed a second time for them.
"""

from pyspark.sql import Column, DataFrame, functions as F

from nearshelf import fixed_values as V
from nearshelf.functions.text import let, squeeze, text_or_null
from nearshelf.functions.variant import double_at, is_object, items_at, text_at


def jsonld_blocks(html: Column) -> Column:
    """Non-blank bodies of the JSON-LD script elements, in page order."""
    bodies = F.regexp_extract_all(html, F.lit(V.JSONLD_BLOCK), F.lit(1))
    return F.filter(bodies, lambda b: text_or_null(b).isNotNull())


def lenient_objects(text: Column) -> Column:
    """Objects of a text that strict parsing rejects, by the members that product
    fields come from: of repeated keys the last counts, NaN literals are read.
    Null where it is no JSON; a member that itself repeats keys is null."""
    members = ", ".join(f"`{m}`: VARIANT" for m in V.PRODUCT_MEMBERS)
    return F.transform(F.from_json(text, f"ARRAY<STRUCT<{members}>>"), F.to_variant_object)


def jsonld_objects(html: Column) -> Column:
    """Parsed values; unparsable blocks are left out, top-level arrays are
    flattened one level."""
    def objects(block: Column) -> Column:
        return let(F.try_parse_json(block), lambda v: F.when(
            v.isNotNull(), F.coalesce(items_at(v, "$"), F.array(v))).otherwise(lenient_objects(block)))

    return F.flatten(F.filter(F.transform(jsonld_blocks(html), objects), lambda v: v.isNotNull()))


def products_of(html: Column) -> Column:
    """Objects whose @type is exactly the product type (a list is not)."""
    return F.filter(
        jsonld_objects(html),
        lambda o: F.coalesce(F.try_variant_get(o, '$["@type"]', "string") == V.PRODUCT_TYPE, F.lit(False)),
    )


def og_url(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, V.OG_URL, 1), F.lit(""))


def category_of(product: Column) -> Column:
    return squeeze(text_at(product, "$.category"))


def country_of(product: Column) -> Column:
    """Country given as text or as an object with a name."""
    return F.coalesce(text_at(product, "$.countryOfOrigin.name"), text_at(product, "$.countryOfOrigin"))


def reviews_of(product: Column) -> Column:
    """Reviews with a text or a rating; null when none is left."""
    def review(r: Column) -> Column:
        return F.struct(
            F.coalesce(text_at(r, "$.author.name"), text_at(r, "$.author")).alias("author"),
            text_at(r, "$.reviewBody").alias("review"),
            double_at(r, "$.reviewRating.ratingValue").alias("rating"),
            double_at(r, "$.reviewRating.bestRating").alias("best_rating"),
        )

    kept = F.filter(
        F.transform(items_at(product, "$.review"), review),
        lambda r: r["review"].isNotNull() | r["rating"].isNotNull(),
    )
    return let(kept, lambda rs: F.when(F.size(rs) > 0, rs))


def aggregate_rating_of(product: Column) -> Column:
    rating = F.try_variant_get(product, "$.aggregateRating", "variant")
    return F.when(is_object(rating), F.to_json(rating))


def product_fields(product: Column) -> list[Column]:
    return [
        text_at(product, "$.sku").alias("sku"),
        text_at(product, "$.name").alias("name"),
        category_of(product).alias("category"),
        country_of(product).alias("country"),
        text_at(product, "$.size").alias("size"),
        text_at(product, "$.image").alias("image"),
        text_at(product, "$.description").alias("description"),
        double_at(product, "$.offers[0].price").alias("price"),
        text_at(product, "$.offers[0].availability").alias("availability"),
        text_at(product, "$.keywords").alias("keywords"),
        reviews_of(product).alias("reviews"),
        aggregate_rating_of(product).alias("aggregate_rating"),
    ]


def first_products(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per page with its first product as VARIANT, null without one."""
    return pages.select(
        *keep, og_url(F.col("html")).alias("source_url"),
        F.explode_outer(F.slice(products_of(F.col("html")), 1, 1)).alias("product"),
    )


def classify_pages(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every page once, with `status` ok / skip_parse / skip_not_wine and the
    product fields (null where parsing found no product)."""
    keep = keep or [c for c in pages.columns if c != "html"]
    found = first_products(pages, keep)
    fields = found.select(*keep, *product_fields(F.col("product")), "source_url")
    parsed = F.col("sku").isNotNull() & F.col("name").isNotNull()
    status = (
        F.when(~parsed, "skip_parse")
        .when(~is_wanted_category(F.col("category")), "skip_not_wine")
        .otherwise("ok")
    )
    return fields.withColumn("status", status)


def extract_products(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Product records of the pages that have one with a sku and a name."""
    return classify_pages(pages, keep).where(F.col("status") != "skip_parse").drop("status")


def is_wanted_category(category: Column) -> Column:
    """Contains the wanted word and none of the blocked ones, as substrings."""
    low = F.lower(category)
    blocked = low.rlike("|".join(V.CATEGORY_MUST_NOT_CONTAIN))
    return F.coalesce(low.contains(V.CATEGORY_MUST_CONTAIN) & ~blocked, F.lit(False))


def vector_id(sku: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), sku)


def page_key(path: Column) -> Column:
    """Key of a page in the manifest: hash of its path, not of its content."""
    return F.sha1(path)


def file_vector_id(file_name: Column, prefix: str = "wine_") -> Column:
    """Vector id of a page file named <digits>.html, null for other names."""
    number = F.nullif(F.regexp_extract(file_name, V.PAGE_FILE_ID, 1), F.lit(""))
    return F.concat(F.lit(prefix), number)
