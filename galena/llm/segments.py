"""Exact search for strings of L items that recur, without comparing documents in pairs.

Shared by the byte search (suffix arrays) and the word search (automata). A document is a sequence of
items, bytes or words. Every window of L items is assigned to its *anchor*: the smallest hash among
its k-item grams, the leftmost if tied. Equal windows have equal anchors at equal offsets, so they can
only be found among the windows of one anchor. Neighbouring windows with one anchor make a *segment*,
which is what is shuffled:

1. each chunk of documents lists its anchors, and anchors that occur once in the corpus are dropped;
2. each chunk sends its distinct segments of the other anchors to the anchor's shard, where windows
   are compared by content (this part differs between the two searches);
3. shards answer each chunk, for each of its segments, and the chunk marks its documents.

Documents are dealt into chunks of about ``chunk_bytes`` by a hash, and the three steps read the same
shuffle of the documents. A chunk tells an anchor or a segment only once, whatever the number of its
documents that hold it, so a passage in a third of all documents costs a shard no more than one row
for each chunk. Nothing is sampled, capped or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.common import SLICE_BYTES, check_ids, flat, prefix_hash, rows_of, slices, sliding_min, span_hash, text_bytes, word_spans

NO_ID = np.iinfo(np.int64).max
POSITION_BITS = 24


@dataclass
class Items:
    """A slice of documents as items, and the bytes of each item."""

    off: np.ndarray  # of the documents, in items
    prefix: np.ndarray
    data: np.ndarray  # the bytes that segments are cut from
    start: np.ndarray | None  # of each word in data; None if the items are the bytes
    end: np.ndarray | None

    def bytes_of(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the item spans [first, last)."""
        return (first, last) if self.start is None else (self.start[first], self.end[last - 1])


def byte_items(data: np.ndarray, off: np.ndarray) -> Items:
    return Items(off, prefix_hash(data), data, None, None)


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans one after the other, and their offsets."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return data[np.repeat(start - off[:-1], size) + np.arange(off[-1])], off


def word_items(data: np.ndarray, off: np.ndarray) -> Items:
    """Words of a slice; their bytes are joined by single spaces."""
    starts, ends, words = word_spans(data, off)
    hashes = span_hash(prefix_hash(data), starts, ends)
    spaced = np.append(data, np.uint8(32))
    size = ends - starts + 1
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    index = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    index[at[1:] - 1] = len(data)  # the separator
    return Items(words, prefix_hash(hashes), spaced[index], at[:-1], at[1:] - 1)


def anchor_places(grams: np.ndarray, w: int, bits: int = POSITION_BITS) -> np.ndarray:
    """Where the anchor of each w consecutive grams is: the leftmost of those with the least hash, but for its lowest ``bits``.

    The lowest bits of a hash give way to the place, so that one minimum finds both. Places are counted anew in each stretch of
    2 ** bits, so as many bits order the grams in texts of any length, and equal windows have equal anchors wherever they are.
    """
    stretch = max((1 << bits) - w, 1)
    out = np.empty(max(len(grams) - w + 1, 0), np.int64)
    low = np.uint64((1 << bits) - 1)
    for b in range(0, len(out), stretch):
        part = grams[b : b + stretch + w - 1]
        least = sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), w)
        out[b : b + len(least)] = b + (least & low).astype(np.int64)
    return out


@dataclass
class Search:
    length: int  # of a window, in items
    gram: int
    items: Callable[[np.ndarray, np.ndarray], Items]
    distinct_docs: bool  # whether an anchor has to occur in two documents, or twice anywhere

    def runs(self, it: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and anchor of each segment of a slice."""
        n, w = len(it.prefix) - 1, self.length - self.gram + 1
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none.astype(np.uint64)
        at = np.arange(n - self.gram + 1)
        grams = span_hash(it.prefix, at, at + self.gram)
        least = anchor_places(grams, w)
        ends = np.repeat(it.off[1:], np.diff(it.off))
        inside = np.flatnonzero(np.arange(len(least)) + self.length <= ends[: len(least)])
        if not len(inside):
            return none, none, none.astype(np.uint64)
        least = least[inside]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (np.diff(inside) != 1) | (least[1:] != least[:-1])
        first = np.flatnonzero(fresh)
        return inside[first], np.diff(np.append(first, len(inside))), grams[least[first]]

    def segment_hash(self, it: Items, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        return span_hash(it.prefix, first, first + count + (self.length - 1))


def in_chunks(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """``__chunk``, ``__id``, ``__text`` and the columns of ``docs`` as ``__doc``."""
    check_ids(docs)
    n = max(1, -(-text_bytes(docs) // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(chunk.alias("__chunk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("__id"), F.col("text").alias("__text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("__doc")), n


def sliced(table: pa.Table, search: Search):
    """Items, ids and first row of each slice of a chunk."""
    data, off = flat(table.column("__text"))
    ids = table.column("__id").to_numpy()
    for i, j in slices(off, SLICE_BYTES):
        yield search.items(data[off[i] : off[j]], off[i : j + 1] - off[i]), ids[i:j], i


def recurring(chunks: DataFrame, search: Search) -> DataFrame:
    """(__chunk, anchor) of the anchors that may have recurring windows."""

    def job(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = []
        for it, _, _ in sliced(table, search):
            first, _, anchor = search.runs(it)
            if search.distinct_docs:
                row = np.searchsorted(it.off, first, "right") - 1
                order = np.lexsort((row, anchor))
                a, r = anchor[order], row[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                anchor = a[new]
            parts.append(anchor)
        anchors, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
        return pa.table({"__chunk": pa.array(np.full(len(anchors), key[0].as_py(), np.int32)), "anchor": pa.array(anchors.view(np.int64)), "n": pa.array(np.minimum(n, 2).astype(np.int32))})

    listed = chunks.groupBy("__chunk").applyInArrow(job, "__chunk int, anchor long, n int")
    return listed.withColumn("n", F.sum("n").over(Window.partitionBy("anchor"))).where("n > 1").select("__chunk", "anchor")


SEGMENT_DDL = "__shard int, __chunk int, anchor long, segment long, n int, low_id long, low_at long, high_id long, body binary"


def segments_of(chunks: DataFrame, anchors: DataFrame, search: Search, n_shards: int) -> DataFrame:
    """The distinct segments of each chunk: count, first and last document, place in the first, content."""

    def job(table: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = np.sort(asked.column("anchor").to_numpy()).view(np.uint64) if asked.num_rows else np.zeros(0, np.uint64)
        wanted = np.sort(wanted)
        out: dict[str, list] = {c: [] for c in ("anchor", "segment", "n", "low_id", "low_at", "high_id")}
        bodies = []
        for it, ids, _ in sliced(table, search) if table.num_rows else ():
            first, count, anchor = search.runs(it)
            at = np.minimum(np.searchsorted(wanted, anchor), max(len(wanted) - 1, 0))
            keep = wanted[at] == anchor if len(wanted) else np.zeros(len(anchor), bool)
            first, count, anchor = first[keep], count[keep], anchor[keep]
            if not len(first):
                continue
            segment = search.segment_hash(it, first, count)
            row = np.searchsorted(it.off, first, "right") - 1
            doc, place = ids[row], first - it.off[row]
            order = np.lexsort((place, doc, segment))
            seg = segment[order]
            head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            tail = np.append(head[1:], len(seg)) - 1
            pick = order[head]
            for c, v in (("anchor", anchor[pick].view(np.int64)), ("segment", segment[pick].view(np.int64)), ("n", np.minimum(tail - head + 1, 2).astype(np.int32)), ("low_id", doc[pick]), ("low_at", place[pick]), ("high_id", doc[order[tail]])):
                out[c].append(v)
            body, off = gather(it.data, *it.bytes_of(first[pick], first[pick] + count[pick] + (search.length - 1)))
            bodies.append(pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))]))
        columns = {c: np.concatenate(v) if v else np.zeros(0, np.int32 if c == "n" else np.int64) for c, v in out.items()}
        chunk = table.column("__chunk")[0].as_py() if table.num_rows else 0
        n = len(columns["anchor"])
        shard = (columns["anchor"].view(np.uint64) % np.uint64(n_shards)).astype(np.int32)
        return pa.table({"__shard": pa.array(shard), "__chunk": pa.array(np.full(n, chunk, np.int32)), **{c: pa.array(v) for c, v in columns.items()}, "body": pa.chunked_array(bodies, pa.binary())})

    return chunks.groupBy("__chunk").cogroup(anchors.groupBy("__chunk")).applyInArrow(job, SEGMENT_DDL)


@dataclass
class Shard:
    """The distinct segments of a shard, and where each row of the shard points to."""

    which: np.ndarray  # of each row, its distinct segment
    body: np.ndarray
    off: np.ndarray
    n: np.ndarray
    low_id: np.ndarray
    low_at: np.ndarray
    high_id: np.ndarray


def distinct_segments(table: pa.Table) -> Shard:
    anchor, segment = (table.column(c).to_numpy() for c in ("anchor", "segment"))
    low_id, low_at, high_id, n = (table.column(c).to_numpy() for c in ("low_id", "low_at", "high_id", "n"))
    order = np.lexsort((low_at, low_id, anchor, segment))
    a, s = anchor[order], segment[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))
    head = np.flatnonzero(fresh)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    data, off = flat(table.column("body"))
    pick = order[head]
    body, at = gather(data, off[pick], off[pick + 1])
    return Shard(which, body, at, np.add.reduceat(n[order], head), low_id[pick], low_at[pick], np.maximum.reduceat(high_id[order], head))


def look_up(search: Search, it: Items, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a slice that have an answer: first window, number of windows, row of the answer."""
    first, count, anchor = search.runs(it)
    known = answers.column("segment").to_numpy().view(np.uint64)
    if not len(first) or not len(known):
        return first[:0], count[:0], first[:0]
    order = np.argsort(known)
    segment = search.segment_hash(it, first, count)
    at = order[np.minimum(np.searchsorted(known, segment, sorter=order), len(known) - 1)]
    hit = (known[at] == segment) & (answers.column("anchor").to_numpy().view(np.uint64)[at] == anchor)
    return first[hit], count[hit], at[hit]


def spread(flagged: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items lie in a window that starts at one of ``flagged``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, flagged, 1)
    np.add.at(edge, flagged + length, -1)
    return np.cumsum(edge[:-1]) > 0


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of runs, and the run of each."""
    run = np.repeat(np.arange(len(first)), count)
    start = np.cumsum(count) - count
    return first[run] + np.arange(len(run)) - start[run], run
