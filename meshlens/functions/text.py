"""Text expressions: tokenizing, truncation, masking, token estimates
(X-01, X-17, X-22, X-23, X-31)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's query stop words (X-01).
QUERY_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
                    "of", "with", "by")

# Unicode word characters; the same class is valid in Java regex and RE2.
WORD_RE = r"[\p{L}\p{N}_]+"


def tokenize_query_literal(query: str) -> list[str]:
    """X-01 on a driver-side literal (the user's search text)."""
    toks = re.findall(r"\w+", query.lower())
    return [t for t in toks if t not in QUERY_STOP_WORDS and len(t) >= 2]


def tokenize(c: Column) -> Column:
    """X-01 as a column expression: lower, word runs, no stop words, length ≥ 2."""
    toks = F.regexp_extract_all(F.lower(c), F.lit(WORD_RE), 0)
    stops = F.array(*[F.lit(w) for w in QUERY_STOP_WORDS])
    return F.filter(toks, lambda t: (~F.array_contains(stops, t)) & (F.length(t) >= 2))


def truncate(c: Column, n: int) -> Column:
    """X-23: null-safe cut to ``n`` characters."""
    return F.when(c.isNull(), c).otherwise(F.substring(c, 1, n))


def mask(c: Column, n: int = 4) -> Column:
    """X-22: all stars when not longer than ``n``; else the first and last ``n``
    characters with ``len - 2n`` stars between (the two ends overlap when the
    value is shorter than ``2n``, as in the reference)."""
    ln = F.length(c)
    return (F.when(ln <= n, F.repeat(F.lit("*"), ln))
            .otherwise(F.concat(F.substring(c, 1, n),
                                F.repeat(F.lit("*"), F.greatest(ln - 2 * n, F.lit(0))),
                                F.right(c, F.lit(n)))))


def token_estimate(c: Column) -> Column:
    """X-17 (code form): length div 4."""
    return F.floor(F.length(c) / 4).cast("bigint")


def first_n_and_more(arr: Column, n: int = 5) -> Column:
    """X-31: first ``n`` items joined by ``, `` plus ``… and k more``."""
    head = F.array_join(F.slice(arr, 1, n), ", ")
    extra = F.size(arr) - n
    return F.when(extra > 0, F.concat(head, F.lit(" ... and "), extra.cast("string"), F.lit(" more"))) \
        .otherwise(head)
