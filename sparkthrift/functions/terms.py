"""Terms of a text, hashed embeddings, similarity measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# Words that are no terms.
STOP_WORDS = (
    "about", "all", "also", "and", "any", "are", "been", "but", "can", "could", "did", "for",
    "from", "had", "has", "have", "her", "him", "his", "how", "into", "its", "may", "new",
    "not", "now", "old", "one", "only", "our", "out", "see", "should", "some", "such", "than",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "two", "was",
    "were", "what", "when", "which", "while", "who", "will", "with", "would", "yes", "you", "your",
)


def terms(text: Column, min_length: int = 3) -> Column:
    """Distinct lower-cased runs of ASCII letters, digits and underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= min_length) & ~t.isin(list(STOP_WORDS))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def term_bucket(term: Column, dim: int = 256) -> Column:
    """Bucket of a term: the first eight hash bytes, big-endian, modulo ``dim``."""
    if dim & (dim - 1) == 0 and dim <= 1 << 16:  # the last four of the sixteen digits tell
        return F.conv(F.substring(F.sha2(term, 256), 13, 4), 16, 10).cast("int") % dim
    first = F.conv(F.substring(F.sha2(term, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (first % dim).cast("int")


def term_sign(term: Column) -> Column:
    """Sign by bit 17 of the same integer."""
    low = F.conv(F.substring(F.sha2(term, 256), 11, 2), 16, 10).cast("int")
    return F.when(low.bitwiseAND(2) != 0, 1.0).otherwise(-1.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0; vectors of different lengths raise."""
    sized = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    scale = norm(a) * norm(b)
    return F.coalesce(sized, F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale))


def hashing_embedding(text: Column, dim: int = 256) -> Column:
    """Signed counts of hashed terms, of norm 1 (zeros if there are no terms)."""
    signed = F.transform(terms(text), lambda t: F.struct(term_bucket(t, dim).alias("b"), term_sign(t).alias("s")))

    def spread(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(found, lambda f: f["b"] == i), F.lit(0.0), lambda s, f: s + f["s"]))

    raw = bind(signed, spread)
    return bind(raw, lambda v: bind(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))))
