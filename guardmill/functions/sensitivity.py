"""Sensitive-content detection and scoring as column expressions.

All of it stays in generated code: the detector names are fixed, so the type list is written
out in sorted order instead of being collected, made distinct and sorted per row.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardmill import fixed_values as fv

_KEYWORD_PREFIX = "keyword:"


def keyword_hits(lowered: Column) -> Column:
    """array<string>: keywords a left-to-right scan finds, longest first; null if none.

    The scan does not overlap: "secretoken" holds "secret" but no "token". `contains`
    rejects nearly every text before the pattern runs.
    """
    longest_first = sorted(fv.SENSITIVE_KEYWORDS, key=len, reverse=True)
    alternation = "|".join(re.escape(w) for w in longest_first)
    present = reduce(or_, (lowered.contains(w) for w in fv.SENSITIVE_KEYWORDS))
    return F.when(present, F.regexp_extract_all(lowered, F.lit(f"({alternation})"), F.lit(1)))


def detected_types(text: Column, hits: Column | None = None) -> Column:
    """Sorted distinct detector names that fire on `text`.

    Pass `hits` as a materialised `keyword_hits` column: it is read once per keyword.
    """
    text = F.coalesce(text, F.lit(""))
    hits = keyword_hits(F.lower(text)) if hits is None else hits
    # `contains` on the literal part of a pattern spares most texts the regular expression
    fires = {name: text.contains(literal) & text.rlike(pattern)
             for name, literal, pattern in fv.SENSITIVE_PATTERNS}
    fires |= {_KEYWORD_PREFIX + word.replace(" ", "_"): F.array_contains(hits, word)
              for word in fv.SENSITIVE_KEYWORDS}
    listed = F.array(*(F.when(fires[name], F.lit(name)) for name in sorted(fires)))
    return F.array_except(listed, F.array(F.lit(None).cast("string")))


def score(types: Column, classification: Column) -> Column:
    """Score in double, rounded to 3 places; cast to float only when writing."""
    base = F.lit(0.0)
    for level, value in fv.CLASSIFICATION_BASE_SCORE.items():
        base = F.when(classification == level, F.lit(value)).otherwise(base)
    from_types = F.least(F.size(types) * F.lit(fv.SCORE_PER_TYPE), F.lit(fv.MAX_TYPE_SCORE))
    return F.round(F.least(base + from_types, F.lit(fv.MAX_SCORE)), 3)
