"""Text: folding, slugs, tokens, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galena.functions.unicode import folded, normalized

# Colours in three languages.
COLOURS = ["beige", "black", "blue", "brown", "gold", "gray", "green", "grey", "orange", "pink", "purple", "red", "silver", "white", "yellow", "blanc", "bleu", "gris", "jaune", "noir", "rouge", "vert", "violet", "blau", "gelb", "grau", "grun", "rot", "schwarz", "silber", "weiss"]


def fold_text(c: Column) -> Column:
    """Lower case without diacritics, runs of other characters as one space, null if nothing is left."""
    words = F.trim(F.regexp_replace(F.lower(normalized(c, folded)), "[^a-z0-9]+", " "))
    return F.when(words != "", words)


def slug(c: Column, length: int | None = None) -> Column:
    s = F.replace(fold_text(c), F.lit(" "), F.lit("-"))
    return F.substring(s, 1, length) if length else s


def tokens(c: Column) -> Column:
    """Distinct folded tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.coalesce(fold_text(c), F.lit("")), " "), lambda t: F.length(t) > 1))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of tokens; equality of the folded texts if one side has none."""
    same = F.coalesce(fold_text(a).eqNullSafe(fold_text(b)), F.lit(False))
    return jaccard_of(tokens(a), tokens(b), same)


def jaccard_of(x: Column, y: Column, same: Column) -> Column:
    """The same for token sets made before, so that pairs don't fold their texts again."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), same.cast("double")).otherwise(both / (F.size(x) + F.size(y) - both))


def display_name(*choices: Column) -> Column:
    """The first choice that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices])


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


# Patterns of qualifiers, issues, numbered editions and routes.
QUALIFIER = "^(.*?)\\s*[(\\[]\\s*([^\\])]+)\\s*[)\\]]\\s*$"
ISSUE = "(?i)\\b(?:heft|folge|issue|no|nr)\\.?\\s*[0-9]+\\b|\\b[0-9]+/[0-9]{4}\\b"
NUMBERED = "\\b(?:edition|version|series|part|folge|issue|heft|nr|no) *[0-9]+\\b"
ROUTE = "\\b[us] ?[0-9]+\\b"


def descriptors(c: Column) -> Column:
    """What a name tells beside its words: all parts are null where it does not.

    folded; stem and qualifier of ``stem (qualifier)``; issue (``no. 3``, ``4/1999``); colours and the core
    without them; route (``U 3``, ``S7``, tram); what follows ``cover`` or ``with`` and what stands before;
    a numbered edition, version, series or part.
    """
    stem, qualifier = fold_text(_found(c, QUALIFIER, 1)), fold_text(_found(c, QUALIFIER, 2))
    fixed = [stem.alias("stem"), qualifier.alias("qualifier"), F.lower(_found(c, ISSUE)).alias("issue")]
    # The array binds the folded name, so that it is made once.
    return F.get(F.transform(F.array(fold_text(c)), lambda name: F.struct(name.alias("folded"), *fixed, *_from_folded(name))), F.lit(0))


def _from_folded(name: Column) -> list[Column]:
    words = F.split(name, " ")
    colours = F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(COLOURS))))
    coloured = F.size(colours) > 0

    def halves(marker: str) -> tuple[Column, Column]:
        parts = F.split(name, f" {marker} ")
        core, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        whole = (F.size(parts) == 2) & (core != "") & (rest != "")
        return F.when(whole, core), F.when(whole, rest)

    (cover_core, cover), (with_core, with_) = halves("cover"), halves("with")
    route = F.replace(_found(name, ROUTE), F.lit(" "), F.lit(""))
    return [
        F.when(coloured, F.array_join(colours, ",")).alias("colours"),
        F.when(coloured, F.array_join(F.filter(words, lambda w: ~w.isin(COLOURS)), " ")).alias("colour_core"),
        F.coalesce(route, F.when(F.contains(name, F.lit("tram")), "tram")).alias("route"),
        cover_core.alias("cover_core"),
        cover.alias("cover"),
        with_core.alias("with_core"),
        with_.alias("with_"),
        _found(name, NUMBERED).alias("numbered"),
    ]


def market_code(c: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "-"), F.lit("-")), 1, 16)


def mask_postcode(c: Column) -> Column:
    """The first two characters; the rest is masked."""
    return F.concat(F.substring(c, 1, 2), F.repeat(F.lit("*"), F.greatest(F.length(c) - 2, F.lit(0))))


def title_match(title: Column, reference: Column) -> Column:
    """Whether the words of the reference stand in the title, one after the other, with no letter or digit next to them."""

    def words(c: Column) -> Column:
        return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))

    return F.contains(words(title), words(reference))
