"""Edits of a collection as they come from forms: parsed, bounded, or rejected with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a copy can be like.
CONDITIONS = ["SEALED", "NEW", "EXCELLENT", "GOOD", "FAIR", "POOR", "UNKNOWN"]
MAX_PRICE, MAX_NOTES, MAX_PRIORITY = 1_000_000, 2_000, 3


def _text(c: str) -> Column:
    """Without white space around it; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def price_cents(c: str) -> Column:
    """(cents, valid) of a price with a decimal comma or point; blank is valid and null, a number below 0 or above MAX_PRICE and what is no number are not."""
    amount = F.replace(_text(c), F.lit(","), F.lit(".")).try_cast("double")
    fits = F.coalesce(amount.between(0, MAX_PRICE), F.lit(False))
    return F.struct(F.when(fits, F.round(amount * 100).cast("long")).alias("cents"), (_text(c).isNull() | fits).alias("valid"))


def priority(c: str) -> Column:
    """The whole number that a text begins with, within 0 and MAX_PRIORITY; 0 if there is none."""
    number = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "^\\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")
    return F.least(F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)), F.lit(MAX_PRIORITY))


def parse_edit(form: DataFrame) -> DataFrame:
    """Texts of a form (condition, complete, date, price, currency, notes, priority) as typed columns; ``reject`` names a field that stops the edit.

    Only a bad price stops it. An unknown condition is UNKNOWN, yes and no are told apart from everything else, a date that
    isn't one is null, notes end after MAX_NOTES characters, and a currency goes with a price: three letters, else EUR.
    """
    parsed = form.withColumn("__p", price_cents("price"))
    code = F.upper(F.trim(F.coalesce("currency", F.lit("EUR"))))
    return parsed.withColumns(
        {
            "reject": F.when(~F.col("__p.valid"), "price"),
            "condition": F.when(F.col("condition").isin(CONDITIONS), F.col("condition")).otherwise("UNKNOWN"),
            "complete": F.when(F.col("complete") == "yes", True).when(F.col("complete") == "no", False),
            "date": F.try_to_date(_text("date"), "yyyy-MM-dd"),
            "price_cents": F.col("__p.cents"),
            "currency": F.when(F.col("__p.cents").isNotNull(), F.when(F.length(code) == 3, code).otherwise("EUR")),
            "notes": F.nullif(F.substring(F.trim(F.coalesce("notes", F.lit(""))), 1, MAX_NOTES), F.lit("")),
            "priority": priority("priority"),
        }
    ).drop("__p", "price")
