"""Column expressions for identifiers and text.  All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The title-token stop list and the punctuation stripped from tokens.
TITLE_STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "are", "was",
    "not", "have", "has", "its", "via", "using", "based", "into", "been",
    "which", "their", "also", "more", "than", "over", "such", "each",
)
TITLE_PUNCTUATION = ".,;:()[]{}\"'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_id(url) -> Column:
    """Text after the last ``/``; null and empty give the empty string."""
    return F.coalesce(F.substring_index(_col(url), "/", -1), F.lit(""))


def reconstruct_abstract(index) -> Column:
    """Rebuild text from a ``word -> positions`` map, in position order."""
    placed = F.flatten(F.transform(
        F.map_entries(_col(index)),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word"))),
    ))
    words = F.transform(F.array_sort(placed), lambda x: x["word"])
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def title_tokens(text) -> Column:
    """Distinct lower-case alphabetic words of more than three letters, stop list removed."""
    raw = F.array_distinct(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"(?U)\s+"))
    words = F.transform(raw, lambda w: F.btrim(w, F.lit(TITLE_PUNCTUATION)))
    return F.array_distinct(F.filter(
        words,
        lambda w: (F.length(w) > 3) & ~w.isin(*TITLE_STOP_WORDS) & w.rlike(r"^\p{L}+$"),
    ))


def word_tokens(text) -> Column:
    """Every lower-case word of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))),
                                F.lit(r"(?U)\b(\w\w+)\b"), 1)


def shorten(text, n: int) -> Column:
    """``text`` cut to ``n`` characters, the last one an ellipsis when something is lost."""
    c = _col(text)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def unit(vector) -> Column:
    """An array of doubles scaled to Euclidean length one; a zero vector stays as it is."""
    v = F.transform(_col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
