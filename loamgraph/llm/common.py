"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.sources.stages import stored, table

__all__ = ["SPACES", "WORD", "hash_share", "n_words", "stored", "table", "words"]

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The array of words of a text; empty for null and for texts without a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_share(rows: DataFrame, k: int, salt: str, *, n: int, on: tuple[str, ...] = ("doc_id",), order: str = "__order") -> DataFrame:
    """Of ``rows``, of which there are about ``n``, some 2 * ``k`` by a hash of the columns ``on`` (all where they are fewer), with the hash as ``order``.

    Ordered by it and limited, they are a sample of ``k`` rows. Without this share, every task of such a limit
    would hand on ``k`` rows of its own, and what meets in one place would grow with the number of tasks. Rows alike in ``on`` share a hash,
    so these columns should tell rows apart: where ids may be missing, the text has to be among them.
    """
    h = F.xxhash64(*on, F.lit(salt))
    rows = rows.withColumn(order, h)
    if n <= 2 * k:
        return rows
    return rows.where(F.col(order) < F.lit(-(1 << 63) + int((1 << 64) * (2 * k / n))))
