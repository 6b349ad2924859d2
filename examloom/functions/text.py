"""Text keys, hashes and n-grams as Column functions. Several normal forms exist side by side on purpose; they differ."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python calls white space, as a Java character class.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it. Texts of ASCII are left as they are."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def drop_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def question_key(text: Column) -> Column:
    """Lower-case compatibility form without white space; null counts as empty."""
    return drop_spaces(F.lower(nfkc(F.coalesce(text, F.lit("")))))


def strip_marks(text: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(text, rf"[\p{{P}}{SPACE}]+", "")


def stem_key(text: Column) -> Column:
    """Lower-case compatibility form without white space and punctuation; null counts as empty."""
    return strip_marks(F.lower(nfkc(F.coalesce(text, F.lit("")))))


def display_text(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def explanation_text(text: Column) -> Column:
    """Unix line ends, no blanks at line ends or at the ends of the text."""
    return strip(F.regexp_replace(unix_lines(F.coalesce(text, F.lit(""))), rf"[{SPACE}&&[^\n]]+(?=\n|$)", ""))


def stable_hash(separator: str, *parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by a separator."""
    return F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256)


def stable_fraction(separator: str, *parts: Column) -> Column:
    """The first 48 bits of the hash as a double in [0, 1); exact, so every engine gives the same value."""
    return F.conv(F.substring(stable_hash(separator, *parts), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def sample_id(messages: Column) -> Column:
    """Hash of the user turns; a record's join key, independent of the answer."""
    user = F.filter(messages, lambda m: m["role"] == "user")
    return F.sha2(F.array_join(F.transform(user, lambda m: m["content"]), "\n"), 256)


def option_signature(keys: Column) -> Column:
    """Normalised option texts in order, so that the order of options does not count."""
    return F.array_join(F.array_sort(keys), "|")


def stem_option_hash(stem: Column, option_keys: Column) -> Column:
    return F.sha2(F.concat(stem, F.lit("||"), option_signature(option_keys)), 256)


@F.pandas_udf(T.ArrayType(T.StringType()))
def option_keys(texts: pd.Series) -> pd.Series:
    """stem_key of each text of an array, in one crossing to Python whatever the number of options."""

    def one(t: str | None) -> str:
        low = unicodedata.normalize("NFKC", t or "").lower()
        return "".join(c for c in low if not c.isspace() and unicodedata.category(c)[0] != "P")

    return texts.map(lambda a: None if a is None else [one(t) for t in a])


def ngrams(text: str, n: int) -> set[str]:
    """The set of character n-grams; a shorter text is its own single gram, an empty one has none."""
    if len(text) <= n:
        return {text} - {""}
    return {"".join(g) for g in zip(*(text[i:] for i in range(n)), strict=False)}


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams. Linear in the text, other than substring over a sequence of positions."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: sorted(ngrams(t or "", n))), T.ArrayType(T.StringType()))
    return udf(text)


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """The n-grams as 64-bit numbers, one for each place, in the JVM: an eighth of the bytes in a shuffle.

    The text is cut into characters once, so that the work is linear; null and empty texts have none.
    """
    # an array of one array, so that the characters are a lambda variable and not worked out again for every gram
    places = lambda c: F.when(F.size(c) > n, F.sequence(F.lit(1), F.size(c) - n + 1)).when(F.size(c) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    made = F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "")), lambda c: F.transform(places(c), lambda i: F.xxhash64(F.array_join(F.slice(c, i, F.lit(n)), ""))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.element_at(made, 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)
