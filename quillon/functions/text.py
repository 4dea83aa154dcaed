"""Text expressions: normalising, tokens, n-grams, choices, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with".split()


def normalize_text(c: Column) -> Column:
    """Lower case, all but letters and digits to blanks, squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9, and each CJK letter alone, in lower case.

    Texts without CJK letters are split at what isn't a token, which is far cheaper than collecting matches.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    plain = F.array_remove(F.split(low, "[^a-z0-9]+"), "")
    return F.when(low.rlike("[一-鿿]"), F.regexp_extract_all(low, F.lit(r"([一-鿿]|[a-z0-9]+)"), F.lit(1))).otherwise(plain)


def tokens_compat(c: Column) -> Column:
    """Tokens by the over-escaped class: the letters u, e, f, a backslash and 0 to backslash each stand alone."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\\u4e0-\\9f]|[a-z0-9]+)"), F.lit(1))


def stem(w: Column) -> Column:
    n = F.char_length(w)
    return (
        F.when(w.endswith("ing") & (n > 5), F.substring(w, F.lit(1), n - 3))
        .when(w.endswith("ied") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when(w.endswith("ed") & (n > 4), F.substring(w, F.lit(1), n - 2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def stems(c: Column) -> Column:
    """Distinct stems of the tokens that aren't stop words."""
    words = F.filter(tokens(c), lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(words, stem))


def ngrams(words: Column, n: int) -> Column:
    k = F.size(words) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), k)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.slice(words, 1, 0))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def parse_choice(c: Column) -> Column:
    """A letter A to E: from an answer tag, brackets, a key word, or standing alone; else null."""
    def first(p: str) -> Column:
        return F.nullif(F.upper(F.regexp_extract(c, p, 1)), F.lit(""))

    return F.coalesce(
        first(r"(?i)<answer>\s*\(?([A-E])\)?\s*</answer>"), first(r"[\(\[]([A-Ea-e])[\)\]]"),
        first(r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-E])\b"), first(r"^\s*([A-Ea-e])\s*[.)]?\s*$"),
    )


def seconds_to_clock(c: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(c)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def clock_to_seconds(c: Column) -> Column:
    """MM:SS or HH:MM:SS(.fff); null otherwise. Minutes may exceed 59."""
    p = F.split(c, ":")
    v = F.transform(p, lambda x: x.try_cast("double"))
    return F.when(F.size(p) == 2, v[0] * 60 + v[1]).when(F.size(p) == 3, v[0] * 3600 + v[1] * 60 + F.try_element_at(v, F.lit(3)))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
