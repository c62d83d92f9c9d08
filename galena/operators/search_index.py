"""Contains search over an index of trigrams, so that a search reads the postings of its needle and not all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - WIDTH + 1), lambda i: F.substring(low, i, WIDTH)))


def trigrams(df: DataFrame, id: str, text: str) -> DataFrame:
    """(gram, id): a posting for each different trigram of a lower-cased text; texts of fewer characters have none.

    Written partitioned or clustered by gram, a search prunes everything but the grams of its needle.
    """
    long = df.select(id, text).where(F.length(F.lower(text)) >= WIDTH)
    return long.select(F.explode(_grams(F.col(text))).alias("gram"), id)


def contains(index: DataFrame, df: DataFrame, id: str, text: str, needle: str) -> DataFrame:
    """Rows of ``df`` whose text contains ``needle``, without regard to case.

    Candidates have all trigrams of the needle; each is verified. A needle that is shorter than a trigram has no postings, so the texts are scanned.
    """
    low = needle.lower()
    verified = F.contains(F.lower(text), F.lit(low))
    if len(low) < WIDTH:
        return df.where(verified)
    grams = sorted({low[i : i + WIDTH] for i in range(len(low) - WIDTH + 1)})
    found = index.where(F.col("gram").isin(grams)).groupBy(id).agg(F.count("*").alias("__n")).where(F.col("__n") == len(grams)).select(id)
    return df.join(found, id, "left_semi").where(verified)
