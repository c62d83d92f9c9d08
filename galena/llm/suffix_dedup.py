"""Suffix-array dedup of byte strings by longest-previous-factor arrays.

A shard of segments (see ``segments``) is one string with a suffix array, built by prefix doubling to
the depth of the window. In suffix order, neighbours that share at least ``length`` bytes form an
interval; the previous and the next smaller position of a suffix inside its interval are the places of
an earlier match, so a suffix with either of them has a longest previous factor of ``length`` or more.

``keep="first"`` removes the bytes of windows that have such an earlier match: the first copy, by
(doc_id, place), stays. ``keep="none"`` removes every copy of a recurring string: windows with an earlier
match, and with a later one, which is a smaller position beside it if positions are turned round.

Defined results: a null text counts as empty and stays null; texts shorter than the window lose nothing; overlapping
matches in one document count; repeated rows are copies of each other (one stays whole with
keep="first" if their ids differ); a null id comes after all others; an empty table gives an empty
result. Windows are judged on the input, not on what is left, and never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from galena.llm.segments import Search, Shard, byte_items, distinct_segments, expand, in_chunks, look_up, recurring, segments_of, sliced, spread

LENGTH = 200
GRAM = 32
CHUNK_BYTES = 4 << 20
SHARDS = 4  # for each chunk


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def window_ranks(body: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of a shard, and their ranks in suffix order to the depth ``length``.

    Prefix doubling: the rank of 2 m bytes is the rank of the pair of ranks of m bytes. Equal ranks
    mean that at least ``length`` bytes are shared.
    """
    at = np.arange(len(body))
    left = np.repeat(off[1:], np.diff(off)) - at  # bytes to the end of the segment
    m = 1
    rank = body.astype(np.uint64)
    while m < 8 and 2 * m <= length:
        double = rank.copy()
        double[:-m] = rank[:-m] << np.uint64(8 * m) | rank[m:]
        rank, m = double, 2 * m
    held = np.flatnonzero(left >= m)
    dense = np.zeros(len(body), np.uint64)
    dense[held] = dense_ranks(rank[held])
    rank = dense
    while m < length:
        step = min(m, length - m)
        held = np.flatnonzero(left >= m + step)
        double = np.zeros(len(body), np.uint64)
        double[held] = dense_ranks(rank[held] * np.uint64(len(body) + 1) + rank[held + step])
        rank, m = double, m + step
    held = np.flatnonzero(left >= length)
    return held, rank[held]


def smaller_before(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value inside an item's interval, or -1; intervals begin at ``begin``.

    All items between a pointer and its item stay larger, so pointers can be followed by jumps.
    """
    jump = np.arange(len(values)) - 1
    todo = np.flatnonzero(jump >= begin)
    jump[jump < begin] = -1
    while len(todo):
        todo = todo[values[jump[todo]] >= values[todo]]
        after = jump[jump[todo]]
        jump[todo] = np.where(after >= begin[todo], after, -1)
        todo = todo[jump[todo] >= 0]
    return jump


def smaller_beside(p: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether an item has a previous or a next smaller one inside its interval."""
    previous = smaller_before(p, np.repeat(head, size))
    end = np.repeat(len(p) - head - size, size)  # intervals from the other side
    following = smaller_before(p[::-1], end[::-1])[::-1]
    return (previous >= 0) | (following >= 0)


def matches(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, whether an earlier and whether a later one shares its window.

    Positions are those in suffix order, so a smaller one beside it in its interval is an earlier match; with
    positions turned round, it is a later one.
    """
    order = np.argsort(rank, kind="stable")
    r, p = rank[order], position[order]
    head = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(r)))
    earlier, later = np.empty(len(r), bool), np.empty(len(r), bool)
    earlier[order] = smaller_beside(p, head, size)
    later[order] = smaller_beside(len(r) - 1 - p, head, size)
    return earlier, later


def judge(shard: Shard, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the distinct segments: its segment, whether it recurs, whether an earlier copy exists.

    A window recurs if there is an earlier or a later match, or if its segment stands for several copies.
    """
    at, rank = window_ranks(shard.body, shard.off, length)
    segment = np.searchsorted(shard.off, at, "right") - 1
    place = shard.low_at[segment] + at - shard.off[segment]
    by_place = np.lexsort((place, shard.low_id[segment]))
    position = np.empty(len(at), np.int64)
    position[by_place] = np.arange(len(at))
    earlier, later = matches(rank, position)
    return segment, earlier | later | (shard.n[segment] > 1), earlier


ANSWER_DDL = "__chunk int, anchor long, segment long, low_id long, low_at long, again binary, earlier binary"


def _packed(flags: np.ndarray, segment: np.ndarray, n: int) -> list[bytes]:
    cuts = np.searchsorted(segment, np.arange(n + 1))
    return [np.packbits(flags[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def answers_of(segments: DataFrame, length: int) -> DataFrame:
    def job(table: pa.Table) -> pa.Table:
        shard = distinct_segments(table)
        segment, again, earlier = judge(shard, length)
        n = len(shard.n)
        some = np.zeros(n, bool)
        some[segment[again]] = True
        rows = np.flatnonzero(some[shard.which])
        which = shard.which[rows]
        bits, later = _packed(again, segment, n), _packed(earlier, segment, n)
        return pa.table(
            {
                **{c: table.column(c).take(pa.array(rows)) for c in ("__chunk", "anchor", "segment")},
                "low_id": pa.array(shard.low_id[which]),
                "low_at": pa.array(shard.low_at[which]),
                "again": pa.array([bits[i] for i in which], pa.binary()),
                "earlier": pa.array([later[i] for i in which], pa.binary()),
            }
        )

    return segments.groupBy("__shard").applyInArrow(job, ANSWER_DDL)


def _removed(table: pa.Table, answers: pa.Table, search: Search, keep: str) -> list[np.ndarray]:
    """For each document of a chunk: which of its bytes go."""
    again, earlier = (answers.column(c).to_pylist() for c in ("again", "earlier"))
    low_id, low_at = (answers.column(c).to_numpy() for c in ("low_id", "low_at"))
    out = []
    for it, ids, _ in sliced(table, search):
        first, count, which = look_up(search, it, answers)
        row = np.searchsorted(it.off, first, "right") - 1
        own = (low_id[which] == ids[row]) & (low_at[which] == first - it.off[row]) if keep == "first" else np.zeros(len(first), bool)
        flags = [np.unpackbits(np.frombuffer(earlier[k] if o else again[k], np.uint8), count=c) for k, o, c in zip(which.tolist(), own.tolist(), count.tolist(), strict=True)]
        windows, _ = expand(first, count)
        gone = spread(windows[np.concatenate(flags).astype(bool)] if flags else windows, search.length, len(it.data))
        out += np.split(gone, it.off[1:-1])
    return out


def whole_code_points(gone: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Keep a code point unless all its bytes go."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return gone
    size = np.diff(np.append(lead, len(data)))
    return np.repeat(np.logical_and.reduceat(gone, lead), size) if lead[0] == 0 else gone


def _search_repeats(docs: DataFrame, length: int, chunk_bytes: int):
    search = Search(length, min(GRAM, max(1, length // 2)), byte_items, distinct_docs=False)
    chunks, n = in_chunks(docs, chunk_bytes)
    answers = answers_of(segments_of(chunks, recurring(chunks, search), search, SHARDS * n), length)
    return search, chunks.groupBy("__chunk").cogroup(answers.groupBy("__chunk"))


def repeat_digests(docs: DataFrame, length: int = LENGTH, keep: str = "none", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``."""
    source = docs.select("doc_id", "text")
    search, pairs = _search_repeats(source, length, chunk_bytes)

    def job(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        texts = table.column("__text").to_pylist()
        for text, gone in zip(texts, _removed(table, answers, search, keep) if texts else [], strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            edges = int(gone[:1].sum()) + int(np.count_nonzero(~gone[:-1] & gone[1:]))
            rows.append((len(data), int(gone.sum()), edges, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        ids = table.column("__doc").combine_chunks().field("doc_id") if rows else pa.array([], id_type)
        return pa.table({"doc_id": ids, **{c: pa.array(list(v), pa.int64()) for c, v in zip(("n_bytes", "n_removed", "n_spans"), columns, strict=False)}, "kept_sha256": pa.array(list(columns[3]), pa.string())})

    id_type = to_arrow_type(source.schema["doc_id"].dataType)
    return pairs.applyInArrow(job, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with the recurring strings taken out of ``text``; code points stay whole."""
    search, pairs = _search_repeats(docs, length, chunk_bytes)
    order, schema = docs.columns, docs.schema

    def job(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        texts = []
        for text, gone in zip(table.column("__text").to_pylist(), _removed(table, answers, search, keep), strict=True):
            if text is not None and gone.any():
                data = np.frombuffer(text.encode(), np.uint8)
                text = data[~whole_code_points(gone, data)].tobytes().decode()
            texts.append(text)
        rest = table.column("__doc").combine_chunks()
        return pa.table([pa.array(texts, pa.string()) if c == "text" else rest.field(c) for c in order], names=order)

    empty = to_arrow_schema(schema).empty_table()
    return pairs.applyInArrow(job, schema)
