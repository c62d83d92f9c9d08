"""Numbers, dates, measures, dictionary values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_year(c: Column) -> Column:
    return F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1).try_cast("int")


def parse_measures(c: Column) -> Column:
    """Millimetres of ``a x b x c cm`` and grams of ``n kg`` or ``n g``; decimal commas are accepted."""
    number = "([0-9]+(?:[.,][0-9]+)?)"
    size = f"{number} ?x ?{number} ?x ?{number} ?cm"

    def part(i: int) -> Column:
        return F.floor(F.replace(F.regexp_extract(c, size, i), F.lit(","), F.lit(".")).try_cast("double") * 10 + 0.5).cast("long")

    weight = F.replace(F.regexp_extract(c, f"{number} ?(kg|g)\\b", 1), F.lit(","), F.lit(".")).try_cast("double")
    grams = weight * F.when(F.regexp_extract(c, f"{number} ?(kg|g)\\b", 2) == "kg", 1000).otherwise(1)
    return F.struct(part(1).alias("length_mm"), part(2).alias("width_mm"), part(3).alias("height_mm"), F.floor(grams + 0.5).cast("long").alias("weight_g"))


def era_bucket(year: Column) -> Column:
    """Decades from 1990 on, what was before in one; an unknown year counts as the latest, as comparisons with it fail."""
    return F.when(year < 1990, "before-1990").when(year < 2000, "1990s").when(year < 2010, "2000s").when(year < 2020, "2010s").otherwise("2020s")


def age_bucket(at: Column, now: Column) -> Column:
    """Whole minutes, hours or days from ``at`` to ``now``, as text with a unit."""
    minutes = F.timestamp_diff("MINUTE", at, now)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))


def availability(code: Column) -> Column:
    """Six statuses of a feed as two; any other is unknown."""
    return F.when(code.isin("in_stock", "pre_order", "available_on_order", "stock_on_order"), "AVAILABLE").when(code.isin("not_in_stock", "out_of_stock"), "OUT_OF_STOCK").otherwise("UNKNOWN")


def product_kind(form: Column, tags: Column, promotion: Column) -> Column:
    """Kind of an article from the words of its format and tags, the first that tells."""
    signal = F.lower(F.concat_ws(" ", form, tags))
    return F.when(signal.rlike("catalog"), "CATALOGUE").when(signal.rlike("merch|sticker|book|magazine|multimedia"), "MERCHANDISE").when(signal.rlike("promotion") | F.coalesce(promotion, F.lit(False)), "PROMOTIONAL_ITEM").when(signal.rlike("figure"), "FIGURE").otherwise("SET")


def variant_kind(signal: Column, promotion: Column, exclusive: Column) -> Column:
    """Kind of a variant from what its reference signals, then from its flags."""
    return F.when(signal == "market", "MARKET").when(signal.isin("version", "edition"), "EDITION").when(F.coalesce(promotion, F.lit(False)), "PROMOTION").when(F.coalesce(exclusive, F.lit(False)), "EXCLUSIVE").otherwise("STANDARD")


def exclusive_claims(payload: Column, market: Column) -> Column:
    """(exclusive, market, statement) that a JSON payload claims; the market claim only if it names this market and says something."""
    parsed = F.from_json(payload, "exclusive string, marketExclusive struct<marketCode: string, statement: string>")
    code, statement = F.nullif(F.upper(F.trim(parsed["marketExclusive"]["marketCode"])), F.lit("")), F.nullif(F.trim(parsed["marketExclusive"]["statement"]), F.lit(""))
    holds = F.coalesce(code == F.upper(F.trim(market)), F.lit(False)) & statement.isNotNull()
    return F.struct(F.nullif(F.trim(parsed["exclusive"]), F.lit("")).alias("exclusive"), F.when(holds, code).alias("market"), F.when(holds, statement).alias("statement"))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
