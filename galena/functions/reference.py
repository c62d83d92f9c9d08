"""Printed references and product identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from galena.functions.unicode import composed, folded, normalized

# Dash characters that mean a hyphen, lengths of identifiers, market codes in slugs.
DASHES = "‐‑‒–—"
GTIN_LENGTHS = (8, 12, 13, 14)
MARKETS = ["ant", "aus", "bel", "can", "deu", "esp", "fra", "ger", "gre", "ita", "lyr", "mex", "ned", "sch", "swi", "uk", "usa"]


def reference_normalize(c: Column) -> Column:
    """Compatibility characters composed, dashes as hyphens, no white space, upper case."""
    return F.upper(F.regexp_replace(F.translate(normalized(F.trim(c), composed), DASHES, "-" * len(DASHES)), "\\s+", ""))


def reference_parse(c: Column) -> Column:
    """base, suffix, number, what the suffix signals (version, market, edition or none), and warnings.

    Only two forms are split: ``..V<number>``, and three to eight digits with a hyphen and a suffix that begins
    with a letter (one letter: an edition). All else is a base as a whole, with a warning if it has other
    characters than letters, digits and hyphens. An empty reference has null parts.
    """
    # The array binds the normalised reference, so that it is made once.
    return F.get(F.transform(F.array(F.nullif(reference_normalize(c), F.lit(""))), _parsed), F.lit(0))


def _parsed(r: Column) -> Column:
    version, hyphened = "^(.+?)V([0-9]+)$", "^([0-9]{3,8})-([A-Z][A-Z0-9-]*)$"
    is_version, is_hyphened = r.rlike(version), r.rlike(hyphened)
    tail = F.regexp_extract(r, hyphened, 2)
    odd = ~is_version & ~is_hyphened & ~r.rlike("^[A-Z0-9-]+$")
    return F.struct(
        F.when(is_version, F.regexp_extract(r, version, 1)).when(is_hyphened, F.regexp_extract(r, hyphened, 1)).otherwise(r).alias("base"),
        F.when(is_version, F.concat(F.lit("V"), F.regexp_extract(r, version, 2))).when(is_hyphened, tail).alias("suffix"),
        F.when(is_version, F.regexp_extract(r, version, 2).try_cast("bigint")).alias("number"),
        F.when(is_version, "version").when(is_hyphened & ((F.length(tail) > 1) | F.contains(tail, F.lit("-"))), "market").when(is_hyphened, "edition").when(r.isNotNull(), "none").alias("signal"),
        F.when(odd, F.array(F.lit("unrecognised-characters"))).when(r.isNotNull(), F.array().cast("array<string>")).alias("warnings"),
    )


# References that stand for none.
PLACEHOLDERS = ("^0+(V[0-9]+)?(-[A-Z0-9-]+)?$", "^N/?A(-[A-Z0-9-]+)?$")


def placeholder(c: Column) -> Column:
    """Zeros or N/A, perhaps with a version or a suffix, as the whole value; a missing one is a placeholder too."""
    r = F.upper(F.regexp_replace(normalized(c, composed), "\\s+", ""))
    return F.coalesce(r.rlike(PLACEHOLDERS[0]) | r.rlike(PLACEHOLDERS[1]), F.lit(True))


def gtin_valid(c: Column) -> Column:
    """Digits of a known length whose check digit fits: weights 1, 3, 1, .. from the right sum to a multiple of ten."""
    digits = F.transform(F.split(F.reverse(c), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(c.rlike("^[0-9]+$") & F.length(c).isin(*GTIN_LENGTHS) & (total % 10 == 0), F.lit(False))


def identifier_normalize(kind: Column, value: Column) -> Column:
    """Digits of GTINs and EANs of a valid length, upper-case text of other kinds; null if it can't be one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    coded = F.when(F.length(digits).isin(*GTIN_LENGTHS), digits)
    return F.when(kind.isin("GTIN", "EAN"), coded).otherwise(F.nullif(F.upper(F.trim(value)), F.lit("")))


def observation_key(*parts: Column) -> Column:
    """Parts joined by pipes; a null part stands for all markets."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("global")) for p in parts])


def record_qualifier(source: Column, external_id: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source.cast("string"), external_id.cast("string")), 256), 1, 16)


def url_reference(url: Column, folder: str = "sets") -> Column:
    """The reference that the slug after ``/sets/`` begins with, or null.

    The first segment has a digit and no other sign but dots; numbers after it and then market codes belong
    to it, codes up to five segments in all. A slug that begins with ``n-a`` says that there is none: N-A.
    """
    slug = F.btrim(F.lower(F.regexp_extract(url, f"(?i)/{folder}/([^/?#]+)", 1)), F.lit("-"))
    parts = F.filter(F.split(slug, "-"), lambda x: x != "")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def run(values: Column, holds: Callable[[Column], Column]) -> Column:
        """How many values hold from the first on."""
        at = F.array_position(F.transform(values, holds), F.lit(False))
        return F.when(at > 0, at - 1).otherwise(F.size(values)).cast("int")

    numbers = run(rest, lambda x: x.rlike("^[0-9]+$"))
    after = F.slice(rest, numbers + 1, F.greatest(F.size(rest), F.lit(1)))
    markets = F.least(run(after, lambda x: x.isin(MARKETS)), F.greatest(4 - numbers, F.lit(0)))
    first = F.get(parts, F.lit(0))
    found = F.upper(F.array_join(F.slice(parts, 1, 1 + numbers + markets), "-"))
    return F.when((first == "n") & F.coalesce(F.get(parts, F.lit(1)) == "a", F.lit(False)), "N-A").when(first.rlike("^[a-z]*[0-9][a-z0-9.]*$"), found)


def url_evidence(declared: Column, candidate: Column) -> Column:
    """How well a URL's reference supports the declared one.

    A suffix that the URL leaves out and a digit 2 to 9 that it adds to tell pages apart are compatible.
    """

    def bare(c: Column) -> Column:
        return F.nullif(F.regexp_replace(F.upper(normalized(c, folded)), "[^A-Z0-9]+", ""), F.lit(""))

    def graded(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return (
            F.when((F.coalesce(declared, F.lit("")) == "") | (F.coalesce(candidate, F.lit("")) == ""), "NONE")
            .when(placeholder(declared) | F.upper(candidate).rlike("^N-?A(-|$)") | a.isNull() | b.isNull(), "WEAK")
            .when(a == b, "EXACT")
            .when(F.startswith(a, b) & F.substr(a, F.length(b) + 1).rlike("^[A-Z][A-Z0-9]*$"), "COMPATIBLE_BASE")
            .when(F.startswith(b, a) & F.substr(b, F.length(a) + 1).rlike("^[2-9]$"), "COMPATIBLE_BASE")
            .otherwise("STRONG_MISMATCH")
        )

    return F.get(F.transform(F.array(F.struct(bare(declared).alias("a"), bare(candidate).alias("b"))), graded), F.lit(0))
