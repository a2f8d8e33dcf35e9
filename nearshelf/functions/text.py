"""Column expressions over names and free text. All of them run inside the JVM."""

from pyspark.sql import Column, functions as F

from nearshelf import fixed_values as V


def let(value: Column, body) -> Column:
    """body(value) with the value computed once. Higher-order functions are not
    covered by common-subexpression elimination, so a costly value used twice
    is bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_of(c: Column, fixed: list[str]) -> Column:
    """Membership in a fixed word list."""
    return c.isin(*fixed)


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(V.WHITESPACE))


def text_or_null(c: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return let(strip(c), lambda t: F.when(t != "", t))


def squeeze(c: Column) -> Column:
    """Collapse every whitespace run to one blank and strip."""
    return strip(F.regexp_replace(c, V.WHITESPACE_CLASS + "+", " "))


def words(c: Column) -> Column:
    """Non-empty whitespace-separated words."""
    return F.filter(F.split(c, V.WHITESPACE_CLASS + "+"), lambda w: w != "")


def clean_lines(c: Column, keep=None) -> Column:
    """Strip every line, drop blank ones (and those `keep` rejects)."""
    lines = F.transform(F.split(c, V.LINE_BREAK_CLASS), strip)
    wanted = (lambda x: x != "") if keep is None else (lambda x: (x != "") & keep(x))
    return F.array_join(F.filter(lines, wanted), "\n")


def shorten(c: Column, limit: int) -> Column:
    """Text over `limit` characters is cut, right-stripped and marked."""
    return let(c, lambda t: F.when(
        F.length(t) > limit, F.concat(rstrip(F.substring(t, 1, limit)), F.lit(V.ELLIPSIS))
    ).otherwise(t))


def comma_items(c: Column) -> Column:
    """Stripped non-empty items of a comma-separated text."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda k: k != "")


def last_items(items: Column, n: int) -> Column:
    """The last n elements, or all when there are fewer."""
    return let(items, lambda xs: F.slice(xs, F.greatest(F.size(xs) - (n - 1), F.lit(1)), F.lit(n)))


def first_year(name: Column) -> Column:
    """First 19xx/20xx year standing as a word, else null."""
    return F.nullif(F.regexp_extract(name, "(?U)" + V.YEAR, 1), F.lit(""))


def producer_from_name(name: Column) -> Column:
    """Producer as stored in profiles: the words after dropping one year,
    up to a region word, at most four; null for one-word names."""
    def lead(ws: Column) -> Column:
        is_stop = F.transform(ws, lambda w: one_of(F.lower(w), V.PRODUCER_STOP_WORDS))
        before_stop = F.nullif(F.array_position(is_stop, F.lit(True)), F.lit(0)) - 1
        n = F.least(before_stop, F.lit(V.PRODUCER_MAX_TOKENS)).cast("int")
        return F.when(F.size(ws) > 1, F.nullif(F.array_join(F.slice(ws, F.lit(1), n), " "), F.lit("")))

    return let(words(F.regexp_replace(name, "(?sU)^(.*?)" + V.YEAR, "$1")), lead)


def _word_class(w: Column) -> Column:
    low = F.lower(w)
    quoted = one_of(F.substring(w, 1, 1), V.BRAND_QUOTES)
    capital = w.rlike(r"^\p{Lu}") | low.startswith("st.") | low.startswith("st-")
    return (
        F.when(quoted, "q")
        .when(one_of(low, V.BRAND_OPENERS), "o")
        .when(one_of(low, V.BRAND_KEYWORDS), "k")
        .when(capital, "p")
        .otherwise("l")
    )


def brand_from_name(name: Column) -> Column:
    """Lower-cased brand guessed from an item name, '' when there is none.

    Each word gets a one-letter class (q quote, o opening keyword, k other
    keyword, p capitalised, l other); the brand is the first run of an o or p
    followed by p's, found on the string of classes.
    """
    def without_year(ws: Column) -> Column:
        first = F.coalesce(F.get(ws, F.lit(0)), F.lit(""))
        return F.when(first.rlike(r"^\d{4}\z"), F.slice(ws, F.lit(2), F.size(ws))).otherwise(ws)

    def pick(ws: Column) -> Column:
        return let(F.array_join(F.transform(ws, _word_class), ""), lambda classes: F.array_join(F.slice(
            ws,
            F.length(F.regexp_extract(classes, "^([kl]*)[op]", 1)) + 1,
            F.length(F.regexp_extract(classes, "^[kl]*([op]p{0,%d})" % (V.BRAND_MAX_WORDS - 1), 1)),
        ), " "))

    def accept(brand: Column) -> Column:
        rejected = (F.length(brand) < 2) | one_of(brand, V.BRAND_KEYWORDS + V.BRAND_REGIONS)
        return F.when(rejected, F.lit("")).otherwise(brand)

    picked = let(let(words(F.coalesce(name, F.lit(""))), without_year), pick)
    return let(F.lower(F.regexp_replace(F.regexp_replace(picked, r"'s?\z", ""), r",+\z", "")), accept)


def known_brand(brand: Column) -> Column:
    """The brand where one is stated, else null."""
    return F.when((strip(brand) != "") & (brand != V.MISSING), brand)


def effective_producer(brand: Column, name: Column) -> Column:
    """Stated brand, else the one guessed from the name, else ''. Lower case."""
    return F.coalesce(F.lower(known_brand(brand)), brand_from_name(name))


def brand_key(brand: Column) -> Column:
    """Stripped lower-cased stated brand, '' when missing."""
    return F.coalesce(F.lower(strip(brand)), F.lit(""))


def item_key(name: Column) -> Column:
    """Key shared by the same item over different years; '' when missing."""
    no_year = F.regexp_replace(F.lower(name), "(?U)" + V.YEAR, " ")
    return F.coalesce(F.trim(F.regexp_replace(no_year, "[^a-z0-9]+", " ")), F.lit(""))


def lenient_double(c: Column) -> Column:
    """Text to number: underscores between digits, inf and nan allowed, no
    type suffixes; anything else is null."""
    t = strip(c)
    number = (
        r"(?i)^[+-]?(inf(inity)?|nan|(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)"
        r"(e[+-]?\d+(_\d+)*)?)\z"
    )
    return F.when(t.rlike(number), F.regexp_replace(t, "_", "").try_cast("double"))
