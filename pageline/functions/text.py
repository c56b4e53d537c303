"""Text expressions that behave as the engine's rules say, all within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that loose matching ignores (the hyphen counts).
LOOSE = "[.,;:!?\"'‘’“”]"
#: Unicode white space.
SPACE = r"(?U)\s+"
#: Words that say nothing about what a headline is about.
STOPWORDS = (
    "a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "is", "as", "at",
    "with", "after", "over", "amid", "by", "from", "its", "it", "than",
)


def or_default(value: Column, default: Column | float | int | str, nothing: Column | float | int | str = 0) -> Column:
    """``value``, or ``default`` where it is null or ``nothing``."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, nothing if isinstance(nothing, Column) else F.lit(nothing)), default)


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(strip(F.regexp_replace(text, SPACE, " ")))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def is_alpha(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\p{L}+$"), F.lit(False))


def is_upper(text: Column) -> Column:
    """Has a cased character and none in lower case."""
    return (text == F.upper(text)) & (text != F.lower(text))


def words(text: Column) -> Column:
    """The runs between white space, none of them empty."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return F.coalesce(out, F.lit(False))


def loosely_starts(text: Column, start: Column) -> Column:
    """``text`` begins with ``start``: as it is, without white space, or without punctuation (each by itself)."""
    a, b = squeezed(text), squeezed(start)
    bare = lambda x: F.regexp_replace(x, LOOSE, "")
    return (b == "") | a.startswith(b) | F.startswith(without_space(a), without_space(b)) | F.startswith(bare(a), bare(b))


def loosely_ends(text: Column, end: Column) -> Column:
    a, b = squeezed(text), squeezed(end)
    bare = lambda x: F.regexp_replace(x, LOOSE, "")
    return (b == "") | a.endswith(b) | F.endswith(without_space(a), without_space(b)) | F.endswith(bare(a), bare(b))


def topic_words(headline: Column) -> Column:
    """The distinct words of a headline that say what it is about."""
    plain = F.lower(F.regexp_replace(headline, r"[^\p{L}\p{N}]", " "))
    return F.array_except(words(plain), F.array(*map(F.lit, STOPWORDS)))


def same_story(a: Column, b: Column, least: int = 2, ratio: float = 0.5) -> Column:
    """Two arrays of topic words share at least ``least`` words and ``ratio`` of the shorter one."""
    shared, short = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return (short > 0) & (shared >= least) & (shared >= ratio * short)


def ordered_text(order: str, text: Column, glue: str = "") -> Column:
    """The aggregate of ``text`` in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), glue)


def edition_id(edition: Column, date: Column) -> Column:
    return F.concat_ws("__", edition, date)


def split_edition_id(value: Column) -> tuple[Column, Column]:
    """Edition and date, split at the first double underscore; null where there is none."""
    ok = value.contains("__")
    return F.when(ok, F.regexp_extract(value, r"^(.*?)__(.*)$", 1)), F.when(ok, F.regexp_extract(value, r"^(.*?)__(.*)$", 2))


def page_list(text: Column) -> Column:
    """``1,2,5-8`` as integers in order, repeats kept."""
    part = F.transform(F.split(text, ","), lambda p: F.trim(p))
    lo = lambda p: F.split(p, "-")[0].cast("int")
    hi = lambda p: F.element_at(F.split(p, "-"), -1).cast("int")
    return F.flatten(F.transform(F.filter(part, lambda p: p != ""), lambda p: F.when(lo(p) <= hi(p), F.sequence(lo(p), hi(p))).otherwise(F.array().cast("array<int>"))))
