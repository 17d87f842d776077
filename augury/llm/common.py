"""Column helpers shared by the operators of this subpackage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The six white-space characters of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def squeeze(text: Column) -> Column:
    """``text`` without its white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*cols: Column) -> list[Column]:
    """128 bits that name a row by its content, so that two reads of a table agree without row numbers. Rows with the
    same key are equal in ``cols`` and get equal results."""
    return [F.xxhash64(*cols).alias("__k1"), F.xxhash64(F.lit(1), *reversed(cols)).alias("__k2")]


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Working names that ``df`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names that no operator uses, and the new name of every column: work on it can't clash with what the
    caller's columns are called."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), at
