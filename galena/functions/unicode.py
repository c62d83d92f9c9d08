"""Unicode normalisation as expressions: tables that are derived from the character database, not listed.

A table covers the characters of the basic plane. Those with one character to stand for them go through
``translate``; those with several (ligatures, digraphs, fractions, numerals, letterlike signs) are replaced
one by one, and only in texts that hold such a character. Squared and parenthesised signs of East Asian
blocks, and combining marks that would join their letter (in ``composed``), are left as they are.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of Latin letters and signs whose characters may be spelled by several others.
SPELLED = (range(0x80, 0x250), range(0x1E00, 0x1F00), range(0x2000, 0x2190), range(0xFB00, 0xFB07))
DIACRITIC = regex.compile("\\p{Diacritic}")


def folded(character: str) -> str:
    """Compatibility decomposition without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", character) if not DIACRITIC.match(c))


def composed(character: str) -> str:
    return unicodedata.normalize("NFKC", character)


@lru_cache
def table(form: Callable[[str], str]) -> tuple[str, str, dict[str, str]]:
    """Characters with one stand-in (then those that go), the stand-ins, and characters with several.

    Only what bears on ASCII letters, digits and marks is kept: all else looks alike to the rules here.
    """
    single, gone, several = {}, [], {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        to = form(c)
        if to == c:
            continue
        if not to:
            gone.append(c)
        elif len(to) == 1 and to.isascii():
            single[c] = to
        elif any(code in block for block in SPELLED) and any(x.isascii() and not x.isspace() for x in to):
            several[c] = to
    gone += [c for c in map(chr, range(0x80)) if not form(c)]
    return "".join([*single, *gone]), "".join(single.values()), several


def ranges(characters: str, gap: int = 16) -> str:
    """A class of a few ranges that holds the characters and some between them: a quick test, not an exact one."""
    codes = sorted(map(ord, characters))
    cuts = [0, *[i for i in range(1, len(codes)) if codes[i] - codes[i - 1] > gap], len(codes)]
    return "[" + "".join(f"\\u{codes[a]:04x}-\\u{codes[b - 1]:04x}" for a, b in itertools.pairwise(cuts)) + "]"


def normalized(c: Column, form: Callable[[str], str]) -> Column:
    source, target, several = table(form)
    pattern = ranges("".join(several))
    spell = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in several.items())), F.lit("\x02"), F.lit("\x01"))  # a constant
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(spell, x), x)), "")
    return F.translate(F.when(c.rlike(pattern), spelled).otherwise(c), source, target)
