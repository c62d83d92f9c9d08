"""Rule statistics of whole texts, used by the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from galena.llm.common import SLICE_BYTES, flat, mix, per_row, prefix_hash, rows_of, slices, span_hash, word_spans

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct"]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


SYMBOLS = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGITS = _table("0123456789")
MARKS = _table("!?.,;:'\"()[]{}-_/\\@^~`=+")


def stats_of(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for each row of a slice."""
    n_rows = len(off) - 1
    starts, ends, words = word_spans(data, off)
    prefix = prefix_hash(data)
    lead = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, starts, 1)
    np.add.at(in_word, ends, -1)
    in_word = np.cumsum(in_word[:-1]).astype(bool)
    out = {"n_words": np.diff(words), "word_chars": per_row(lead & in_word, off), "n_chars": per_row(lead, off)}
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_letters", LETTERS), ("n_digits", DIGITS), ("n_marks", MARKS)):
        out[name] = per_row(table[data], off)

    # Lines: spans between line feeds, never across rows; only those with a word count.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, off[1:]]))
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    row = np.searchsorted(off, line_start, "right") - 1
    key = mix(span_hash(prefix, line_start, line_end) + row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, at = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(row, minlength=n_rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[at], minlength=n_rows)

    # Three-word windows that occur at least twice in their row.
    h = span_hash(prefix, starts, ends)
    row = rows_of(words)
    key = mix(h + row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, at = np.unique(key, return_index=True)
    out["n_distinct"] = np.bincount(row[at], minlength=n_rows)
    repeated = np.zeros(len(h) + 1, np.int64)
    if len(h) >= 3:
        inside = np.flatnonzero(row[:-2] == row[2:])
        c1, c2, c3 = (np.uint64(c) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
        tri = mix(h[inside] * c1 + h[inside + 1] * c2 + h[inside + 2] * c3 + row[inside].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        _, which, n = np.unique(tri, return_inverse=True, return_counts=True)
        twice = inside[n[which] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 3, -1)
    out["n_repeat_words"] = per_row(np.cumsum(repeated[:-1]) > 0, words)
    return out


def with_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the COUNTS of ``text`` for each row; a null text has none of anything.

    Very long texts are handled alone, so memory is bounded by the longest text of a batch.
    """
    source = docs.select(*keep, docs[text].alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} long" for c in COUNTS])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(len(keep)))
            for i, j in slices(off, SLICE_BYTES):
                got = stats_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(len(keep))] + [pa.array(got[c], pa.int64()) for c in COUNTS], names=[*keep, *COUNTS])

    return source.mapInArrow(job, schema)


def ratios(table: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics that don't depend on the language; one row for each document."""
    c = {k: np.asarray(table[k], np.float64) for k in COUNTS}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / np.maximum(c["word_chars"], 1),
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["n_upper"] / np.maximum(c["n_letters"], 1),
            c["n_marks"] / chars,
            c["n_digits"] / chars,
            c["n_distinct"] / words,
        ],
        axis=1,
    )


RATIOS = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share"]
