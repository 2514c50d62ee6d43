"""Text expressions. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() knows it; Java's own \s is ASCII only.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
#: A word as Python's \w+ finds it.
WORD = r"[\p{L}\p{N}_]+"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normal_key(c: Column) -> Column:
    """Stripped and in lower case."""
    return F.lower(py_strip(c))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def split_words(c: Column) -> Column:
    """What str.split() gives."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words of all words, in lower case; 0 if either has none, null if either is null."""
    return word_overlap(word_set(a), word_set(b))


def word_set(c: Column) -> Column:
    return F.array_distinct(split_words(F.lower(c)))


def word_overlap(x: Column, y: Column) -> Column:
    """D6 of two word sets. Make the sets columns of their own first: they are used more than once."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both)).otherwise(F.when(x.isNotNull() & y.isNotNull(), 0.0))


def tokens_quarter(c: Column) -> Column:
    """R18, char4: a token for each four characters of the stripped text, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(py_strip(c)) / 4)).cast("int")


def tokens_ratio(c: Column, per_token: float = 3.8) -> Column:
    """Characters by a ratio, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / per_token)).cast("int")


def tokens_of_parts(parts: Column) -> Column:
    """Quarters of each part's characters, summed."""
    return F.aggregate(parts, F.lit(0), lambda s, x: s + F.floor(F.length(x) / 4).cast("int"))


def bigrams(w: Column) -> Column:
    """Neighbouring pairs of an array, none if it has fewer than two."""
    n = F.size(w) - 1  # slices, not places: an array that is an expression would be made again for each place
    return F.when(n >= 1, F.zip_with(F.slice(w, 1, F.greatest(n, F.lit(0))), F.slice(w, 2, F.greatest(n, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty; '' if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
