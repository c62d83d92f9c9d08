"""Licence scan: Aho-Corasick over identifier tags and notice phrases, and a shunting-yard parser.

One automaton over the words of a text (ASCII letters lower-cased, other ASCII characters but digits
are separators) finds the notice phrases; another over the lower-cased text finds the tags
``SPDX-License-Identifier:``. What follows a tag, up to the end of its line, is parsed as an
expression of licence identifiers with ``WITH`` before ``AND`` before ``OR`` and parentheses.

Every identifier of a valid expression gives a label, and the expression is evaluated to how
permissive it is (an ``OR`` lets the reader choose the most permissive side, an ``AND`` binds to the
least, ``WITH`` an exception lifts its licence halfway). The score is the confidence that the text
carries a licence: ``1 - product of (1 - weight)`` over its distinct kinds of evidence.

Defined results: a null or empty text has no words, no labels and score 0; an expression that doesn't
parse gives no label but counts as weak evidence; repeated rows are scanned one by one; other columns
are not read. Matches are found in whole texts, never in prefixes, and expressions have no longest length.
Work is linear in the text, but an expression that has tags in itself is read again from each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases of the base labels, further notices, families of identifiers by prefix.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}
PERMISSIVE = {"mit": 1.0, "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "bsd": 0.95, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05, "all-rights-reserved": 0.0}
ALIASES = {"cc-by-nc-nd": "cc-by-nc-nd", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "cc0", "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "0bsd": "0bsd", "bsl": "bsl", "mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense"}
TAG = "spdx-license-identifier:"
WEIGHTS = {"phrase": 0.6, "notice": 0.5, "tag": 0.9, "bad tag": 0.2}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Ends of an expression, spaces, parentheses, identifiers, other characters.
TOKEN = re.compile(r"(?P<end>[\r\n\"',;]|\*/|-->)|(?P<space>[^\S\r\n]+)|[()]|[a-z0-9](?:(?!-->)[a-z0-9.+_:-])*|\S")

TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() and c < 0x80 else 32 for c in range(256))
TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def family(identifier: str) -> str:
    """The label of an identifier: the longest known prefix, or the identifier itself."""
    return max((v for k, v in ALIASES.items() if identifier == k or identifier.startswith((f"{k}-", f"{k}_"))), key=len, default=identifier)


def expression(text: str, at: int = 0) -> tuple[set[str], float] | None:
    """Labels and permissiveness of the expression that a line starts with at ``at``.

    What follows the longest part that parses is comment. One shunting-yard pass keeps the state at the
    last space where the expression was complete; a part that doesn't parse ends it, as no longer one does.
    """
    values: list[tuple[float, bool]] = []  # permissiveness, and whether it is a single licence
    operators: list[str] = []
    labels: list[str] = []
    depth, operand = 0, True  # open parentheses; an operand comes next
    best: tuple[int, float] | None = None

    def joined(operator: str, a: float, b: float) -> float:
        return (max if operator == "or" else min)(a, b)

    def reduce_to(precedence: int) -> None:
        while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= precedence:
            b, a = values.pop(), values.pop()
            values.append((joined(operators.pop(), a[0], b[0]), False))

    def complete() -> tuple[int, float] | None:
        if operand or depth:
            return best
        value = values[-1][0]  # at most an OR and an AND are pending
        for k in range(len(operators) - 1, -1, -1):
            value = joined(operators[k], values[k][0], value)
        return len(labels), value

    for found in TOKEN.finditer(text, at):
        token = found[0]
        if found.lastgroup:
            best = complete()
            if found.lastgroup == "end":
                break
        elif token == "(" and operand:
            operators.append(token)
            depth += 1
        elif token in PRECEDENCE and not operand:
            reduce_to(PRECEDENCE[token])
            operators.append(token)
            operand = True
        elif token == ")" and depth and not operand or token not in PRECEDENCE and operand and token[0].isalnum():
            if token == ")":
                reduce_to(0)
                operators.pop()
                depth -= 1
            else:
                label = family(token.rstrip("+"))
                labels.append(label)
                values.append((PERMISSIVE.get(label, 0.5), True))
                operand = False
            if operators and operators[-1] == "with":
                b, a = values.pop(), values.pop()
                if not (a[1] and b[1]):  # an exception belongs to one licence
                    break
                operators.pop()
                labels.pop()
                values.append(((a[0] + 1) / 2, False))
        else:
            break
    else:
        best = complete()
    return best and (set(labels[: best[0]]), best[1])


@lru_cache(1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for base, phrases in ((True, BASE_PHRASES), (False, NOTICES)):
        for phrase, label in phrases.items():
            words.add_word(f" {phrase} ", (base, label, len(phrase) + 2))
    words.make_automaton()
    tags.add_word(TAG, len(TAG))
    tags.make_automaton()
    return words, tags


def scan(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, float | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive of one UTF-8 text."""
    words_of, tags_of = automata()
    words = raw.translate(TO_WORDS).split()
    text = f" {b' '.join(words).decode('latin-1')} "
    starts, base, labels, kinds = [], set(), set(), set()
    free: list[float] = []
    spaces, at = 0, 0
    for end, (is_base, label, length) in words_of.iter(text):
        start = end - length + 1
        if is_base:
            spaces += text.count(" ", at, start) if start >= at else -text.count(" ", start, at)
            at = start
            starts.append(spaces)
            base.add(label)
        kinds.add("phrase" if is_base else "notice")
        labels.add(label)
        free.append(PERMISSIVE.get(label, 0.5))
    low = raw.translate(TO_LOWER).decode("latin-1")
    for end, _ in tags_of.iter(low):
        got = expression(low, end + 1)
        kinds.add("tag" if got else "bad tag")
        if got:
            labels |= got[0]
            free.append(got[1])
    miss = 1.0
    for kind in sorted(kinds):
        miss *= 1 - WEIGHTS[kind]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - miss, 6), min(free, default=None)


FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "permissive": pa.float64()}
FIELD_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive double"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id and the fields of ``scan``."""
    source = docs.select("doc_id", docs["text"].alias("__text"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py().encode() if t.is_valid else b"") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(list(c), t) for c, t in zip(columns, FIELDS.values(), strict=True)], names=["doc_id", *FIELDS])

    return source.mapInArrow(job, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {FIELD_DDL}")
