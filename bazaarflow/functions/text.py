"""Column functions on texts, numbers and token arrays; all stay in the JVM. Word lists are parameters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lit_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def words(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def split_words(c: Column) -> Column:
    """Split at white space, without empty parts."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def phrasings(primary: Column, variants: Column) -> Column:
    """The primary question and its variants, trimmed, blanks dropped, the primary first."""
    some = F.coalesce(variants, F.array().cast("array<string>"))
    return F.filter(F.transform(F.concat(F.array(primary), some), lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")


def unified_faq(question: Column, q: Column, variants: Column, question_variants: Column, answer: Column, a: Column, answer_ml: Column, a_ml: Column, q_ml: Column) -> Column:
    """The three dialects of a FAQ as one struct: q, variants, a, q_ml, a_ml.

    The question is ``question``, else ``q``, else the first of the variants; blanks count as missing. Variants are those of
    either name, without the question itself; repeats stay as they are.
    """
    listed = F.coalesce(F.when(F.size(variants) > 0, variants), question_variants, F.array().cast("array<string>"))
    clean = F.filter(F.transform(listed, lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")
    primary = F.coalesce(blank_to_null(question), blank_to_null(q), F.try_element_at(clean, F.lit(1)))
    return F.struct(primary.alias("q"), F.filter(clean, lambda v: v != primary).alias("variants"), F.coalesce(blank_to_null(answer), blank_to_null(a)).alias("a"), blank_to_null(q_ml).alias("q_ml"), F.coalesce(blank_to_null(answer_ml), blank_to_null(a_ml)).alias("a_ml"))


def listed_words(c: Column, stop: list[str]) -> Column:
    """Words of two letters or more that are no stop words, with repeats."""
    return F.filter(words(c), lambda w: (F.length(w) > 1) & ~F.array_contains(lit_array(stop), w))


def priced_words(c: Column, stop: list[str]) -> Column:
    """Distinct words, in which a rupee sign counts as a letter, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_₹]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~F.array_contains(lit_array(stop), w)))


def flat_settings(settings: dict[str, Column], aliases: dict[str, str], defaults: dict[str, str]) -> Column:
    """Nested settings as one map of texts.

    ``settings``: path, its parts joined by ``_``, to a column; an array is joined by commas, a null is blank. ``aliases``
    names some paths a second time, where the alias itself is no path; ``defaults`` fills keys that are missing or blank.
    """
    out = {k: F.coalesce(v.cast("string"), F.lit("")) for k, v in settings.items()}
    for short, path in aliases.items():
        if short not in out and path in out:
            out[short] = out[path]
    for k, v in defaults.items():
        out[k] = F.coalesce(F.nullif(out[k], F.lit("")), F.lit(v)) if k in out else F.lit(v)
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in out.items()]))


def dietary(c: Column, terms: dict[str, str]) -> Column:
    """Phrases replaced by their canonical term wherever they occur, without case, the longest first."""
    return reduce(lambda acc, p: F.regexp_replace(acc, "(?i)" + re.escape(p), terms[p]), sorted(terms, key=lambda p: (-len(p), p)), c)


def content_words(c: Column, stop: list[str], least: int = 3) -> Column:
    return F.filter(words(c), lambda w: (F.length(w) >= least) & ~F.array_contains(lit_array(stop), w))


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-|-$", "")


def replace_words(c: Column, table: dict[str, str], patterns: list[tuple[str, str]] = ()) -> Column:
    """Lower, one space between words, fix spellings by pattern, then replace whole words (by one or more words)."""
    clean = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    clean = reduce(lambda acc, p: F.regexp_replace(acc, p[0], p[1]), patterns, clean)
    return F.array_join(F.transform(F.split(clean, " "), lambda w: F.coalesce(F.try_element_at(lit_map(table), w), w)), " ")


SUFFIXES = ("ings", "ing", "tion", "sion", "als", "ies", "es", "s")


def stem(w: Column) -> Column:
    """Cut the first suffix that leaves three letters."""
    out = F.when(F.lit(False), w)
    for s in SUFFIXES:
        out = out.when(w.endswith(s) & (F.length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def expand_synonyms(tokens: Column, table: dict[str, str], particles: list[str] = ()) -> Column:
    """Tokens and the words of their synonyms, without repeats; particles are kept but not expanded."""
    extra = F.flatten(F.transform(F.filter(tokens, lambda t: ~F.array_contains(lit_array(list(particles)), t)), lambda t: F.split(F.coalesce(F.try_element_at(lit_map(table), t), F.lit("")), " ")))
    return F.array_distinct(F.concat(tokens, F.filter(extra, lambda t: t != "")))


def append_umbrella(c: Column, table: dict[str, list[str]]) -> Column:
    """Append the words of every umbrella phrase that occurs, sorted."""
    found = [F.when(F.lower(c).contains(k), lit_array(v)).otherwise(lit_array([])) for k, v in table.items()]
    return F.concat_ws(" ", c, F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*found)))), " "))


def fix_spelling(c: Column, fixes: list[tuple[str, str]]) -> Column:
    """Replace whole words in turn, without case."""
    return reduce(lambda acc, p: F.regexp_replace(acc, rf"(?i)\b{p[0]}\b", p[1]), fixes, c)


def indian_number(c: Column) -> Column:
    """``2,50,000`` -> 250000; null if it is no number."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("bigint")


# What marks a price, and what is cut from a price cell.
CURRENCY = r"(?i)₹|Rs\.?|Rupee"
CURRENCY_SIGN = r"(?i)₹|Rs\.?"


def prices(cell: Column) -> Column:
    """(price, price_min, price_max) of a price cell; letters without a currency sign are no price.

    Two unequal numbers around a dash are a range, wherever they stand. Else a single number above 0 is the price; of more,
    the first two are a range if they rise, and the first is the price if not.
    """
    clean = F.trim(F.regexp_replace(cell, CURRENCY_SIGN, ""))
    numbers = F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"(\d[\d,]*)"), F.lit(1)), indian_number), lambda v: v > 0)
    first, second = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2))
    dashed = lambda k: indian_number(F.regexp_extract(clean, r"(\d[\d,]*)\s*[-–]\s*(\d[\d,]*)", k))
    a, b = dashed(1), dashed(2)
    around = F.coalesce((a > 0) & (b > 0) & (a != b), F.lit(False))
    rising = F.coalesce(first < second, F.lit(False))
    good = F.coalesce(cell.rlike(CURRENCY) | ~cell.rlike("[A-Za-z]"), F.lit(False))
    low = F.when(around, F.least(a, b)).when(rising, first)
    high = F.when(around, F.greatest(a, b)).when(rising, second)
    return F.struct(F.when(good & ~around & ~rising, first).alias("price"), F.when(good, low).alias("price_min"), F.when(good, high).alias("price_max"))


def price_label(price: Column, low: Column, high: Column, missing: str = "on request", zero: bool = False, both: bool = True) -> Column:
    """``₹1,200`` or ``₹a–₹b``, else ``missing``: blank, 'on request' or 'price on request' by the caller.

    A price of 0 counts as none unless ``zero``; a range needs both ends, or with ``both`` false the lower one.
    """
    shown = lambda p: F.concat(F.lit("₹"), F.format_number(p, 0))
    has = lambda p: p.isNotNull() if zero else F.coalesce(p, F.lit(0)) != 0
    return F.when(has(price), shown(price)).when(has(low) & (has(high) if both else F.lit(True)), F.concat(shown(low), F.lit("–"), F.coalesce(shown(high), F.lit("")))).otherwise(missing)


_EMPTY = ("", "N/A", "NONE", "NULL", "0")


def fill_placeholders(text: Column, values: Column, fallbacks: dict[str, str]) -> Column:
    """Replace every ``{key}``; an absent or empty value gives its fallback, else ``[key]``."""
    keys = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1)))

    def value(k: Column) -> Column:
        v = F.try_element_at(values, k)
        real = F.when(~F.upper(F.trim(v)).isin(*_EMPTY), v)
        return F.coalesce(real, F.try_element_at(lit_map(fallbacks), k), F.concat(F.lit("["), k, F.lit("]")))

    return F.aggregate(keys, text, lambda acc, k: F.replace(acc, F.concat(F.lit("{"), k, F.lit("}")), value(k)))


def format_map(text: Column, values: Column) -> Column:
    """All or nothing: a key without a value leaves the text as it is."""
    keys = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1)))
    filled = F.aggregate(keys, text, lambda acc, k: F.replace(acc, F.concat(F.lit("{"), k, F.lit("}")), F.coalesce(F.try_element_at(values, k), F.lit(""))))
    return F.when(F.forall(keys, lambda k: F.map_contains_key(values, k)), filled).otherwise(text)


def preview(c: Column, chars: int = 120) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 0 if either is empty or they share nothing."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def any_of(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text contains one of the phrases."""
    low = F.lower(c)
    return reduce(lambda acc, p: acc | low.contains(p), phrases, F.lit(False))


def first_of(c: Column, table: dict[str, list[str]], default: str | None = None) -> Column:
    """The first key, in order, one of whose phrases the text contains."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, phrases in table.items():
        out = out.when(any_of(c, phrases), F.lit(key))
    return out.otherwise(F.lit(default).cast("string"))
