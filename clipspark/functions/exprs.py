"""Small column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(ladder: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rung whose condition holds; ``default`` when none does."""
    out = None
    for cond, value in ladder:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def digest(*parts: Column, sep: str = "|", chars: int = 16) -> Column:
    """Truncated SHA-256 of the parts; a null part hashes as the empty string."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(sep, *texts), 256), 1, chars)


def seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def word_set(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column) -> Column:
    """Lower-case alphabetic words of two letters or more, any script."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[^\W\d_]+\b"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) > 1)


def flag_list(pairs: Sequence[tuple[Column, str | Column]], sep: str = "; ") -> Column:
    """Join the labels whose condition holds, in the given order."""
    labels = [
        F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in pairs
    ]
    return F.array_join(F.array_compact(F.array(*labels)), sep)


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns so that they are computed once per row.

    Catalyst copies a projected expression into every later use of it, filters
    included; where the expression is a parse and the uses are many, the copies
    outweigh everything else. A one-element generator is not copied through."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
