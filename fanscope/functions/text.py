"""String column expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---
# Suffix removed from relationship statuses (after capitalizing words).
PENDING_SUFFIX = r"\s*\(Pending\)"
# --- End of fixed values ---


def ordered_token_match(name: Column, type_: Column, token_a: str, token_b: str) -> Column:
    """True when `token_a` matches the lower-cased name, `token_b` matches the
    lower-cased name+type, and A's first match starts before B's first match.

    Tokens are Java regular expressions. A NULL name or type never matches.
    """
    pos_a = F.regexp_instr(F.lower(name), F.lit(token_a))
    pos_b = F.regexp_instr(F.lower(F.concat(name, type_)), F.lit(token_b))
    return F.coalesce((pos_a > 0) & (pos_b > pos_a), F.lit(False))


def capitalize_words(s: Column) -> Column:
    """Upper-case the first character of each word and keep the rest as is
    (unlike `initcap`, which lower-cases the rest). Words are separated by any
    white space, which is kept."""
    words = F.split(s, r"(?<=\s)", -1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))),
                                                              F.call_function("substring", w, F.lit(2)))), "")


def clean_relationship(s: Column) -> Column:
    """`in an OPEN relationship` -> `In An OPEN Relationship`,
    `engaged (Pending)` -> `Engaged`."""
    return F.trim(F.regexp_replace(capitalize_words(s), PENDING_SUFFIX, ""))


def starts_with_digit(s: Column) -> Column:
    """Any Unicode decimal digit, as Java's Character.isDigit."""
    return s.rlike(r"^\p{Nd}")
