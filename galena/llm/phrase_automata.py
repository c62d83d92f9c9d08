"""Substring dedup of repeated phrases with sharded Aho-Corasick automata.

Windows of ``length`` words that occur in two or more documents are recurring phrases. Shards of
segments (see ``segments``) confirm them: a window's phrase is looked up by its words, with the
smallest and the largest id of a document that holds it. The confirmed phrases of a shard are compiled
into one automaton, and the segments of all documents stream through it, which locates every
occurrence together with the smallest id that holds the phrase. A document loses each word covered by
a phrase that also starts in a document with a smaller id.

A shard holds the phrases of its anchors only, and a document visits only the shards of its own
anchors, so automata stay small and no document is matched against all phrases.

Defined results: a null text has no words; texts shorter than a phrase lose nothing; rows with equal
ids count as one document; a null id comes after all others, and two null ids are not earlier than
each other; repeats within one document stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from galena.llm.segments import NO_ID, Search, Shard, distinct_segments, expand, in_chunks, look_up, recurring, segments_of, sliced, spread, word_items

LENGTH = 13
GRAM = 4
CHUNK_BYTES = 4 << 20
SHARDS = 4  # for each chunk


Phrase = tuple[int, ...]


def confirm(texts: list[Phrase], low_id: list[int], high_id: list[int], length: int) -> dict[Phrase, int]:
    """Phrases in two or more documents, and the smallest id of each."""
    low: dict[Phrase, int] = {}
    high: dict[Phrase, int] = {}
    for words, a, b in zip(texts, low_id, high_id, strict=True):
        for i in range(len(words) - length + 1):
            phrase = words[i : i + length]
            low[phrase] = min(a, low.get(phrase, a))
            high[phrase] = max(b, high.get(phrase, b))
    return {p: a for p, a in low.items() if a < high[p]}


def locate(shard: Shard, length: int) -> list[np.ndarray | None]:
    """For each distinct segment, the smallest id of each window's phrase; None if no phrase occurs.

    The words of a shard are numbered, and the automaton runs over numbers: it has a node for each
    word of a phrase and not for each character.
    """
    whole = shard.body.tobytes()
    number: dict[bytes, int] = {}
    texts = [tuple(number.setdefault(w, len(number) + 1) for w in whole[a:b].split(b" ")) for a, b in zip(shard.off[:-1].tolist(), shard.off[1:].tolist(), strict=True)]
    phrases = confirm(texts, shard.low_id.tolist(), shard.high_id.tolist(), length)
    out: list[np.ndarray | None] = [None] * len(texts)
    if not phrases:
        return out
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, low in phrases.items():
        automaton.add_word(phrase, low)
    automaton.make_automaton()
    for k, words in enumerate(texts):
        for end, low in automaton.iter(words):
            if out[k] is None:
                out[k] = np.full(len(words) - length + 1, NO_ID, np.int64)
            out[k][end - length + 1] = low
    return out


ANSWER_DDL = "__chunk int, anchor long, segment long, low binary"


def answers_of(segments: DataFrame, length: int) -> DataFrame:
    def job(table: pa.Table) -> pa.Table:
        shard = distinct_segments(table)
        low = locate(shard, length)
        rows = np.array([r for r, k in enumerate(shard.which.tolist()) if low[k] is not None], np.int64)
        return pa.table({**{c: table.column(c).take(pa.array(rows)) for c in ("__chunk", "anchor", "segment")}, "low": pa.array([low[k].tobytes() for k in shard.which[rows].tolist()], pa.binary())})

    return segments.groupBy("__shard").applyInArrow(job, ANSWER_DDL)


def _search_phrases(docs: DataFrame, length: int, chunk_bytes: int):
    search = Search(length, min(GRAM, length), word_items, distinct_docs=True)
    chunks, n = in_chunks(docs, chunk_bytes)
    answers = answers_of(segments_of(chunks, recurring(chunks, search), search, SHARDS * n), length)
    return search, chunks.groupBy("__chunk").cogroup(answers.groupBy("__chunk"))


def _kept(table: pa.Table, answers: pa.Table, search: Search):
    """Words (with a space after each) and which of them go, for each document of a chunk."""
    low_of = answers.column("low").to_pylist()
    for it, ids, _ in sliced(table, search):
        first, count, which = look_up(search, it, answers)
        windows, run = expand(first, count)
        low = np.concatenate([np.frombuffer(low_of[k], np.int64)[:c] for k, c in zip(which.tolist(), count.tolist(), strict=True)]) if len(which) else np.zeros(0, np.int64)
        row = np.searchsorted(it.off, first, "right") - 1
        gone = spread(windows[low < ids[row[run]]], search.length, int(it.off[-1]))
        size = it.end - it.start + 1
        keep_bytes = np.repeat(~gone, size)
        ends = np.append(0, np.cumsum(np.where(gone, 0, size)))
        kept = it.data[: int(size.sum())][keep_bytes].tobytes()
        for a, b in zip(it.off[:-1].tolist(), it.off[1:].tolist(), strict=True):
            yield b - a, int(gone[a:b].sum()), kept[ends[a] : max(ends[b] - 1, ends[a])]


def phrase_digests(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``."""
    source = docs.select("doc_id", "text")
    search, pairs = _search_phrases(source, length, chunk_bytes)
    id_type = to_arrow_type(source.schema["doc_id"].dataType)

    def job(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept(table, answers, search)] if table.num_rows else []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        ids = table.column("__doc").combine_chunks().field("doc_id") if rows else pa.array([], id_type)
        return pa.table({"doc_id": ids, "n_words": pa.array(list(columns[0]), pa.int64()), "n_removed": pa.array(list(columns[1]), pa.int64()), "kept_sha256": pa.array(list(columns[2]), pa.string())})

    return pairs.applyInArrow(job, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove_phrases(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with later copies of recurring phrases taken out; what changes is joined by single spaces."""
    search, pairs = _search_phrases(docs, length, chunk_bytes)
    order, schema = docs.columns, docs.schema
    empty = to_arrow_schema(schema).empty_table()

    def job(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        texts = [t if t is None or not gone else kept.decode() for t, (_, gone, kept) in zip(table.column("__text").to_pylist(), _kept(table, answers, search), strict=True)]
        rest = table.column("__doc").combine_chunks()
        return pa.table([pa.array(texts, pa.string()) if c == "text" else rest.field(c) for c in order], names=order)

    return pairs.applyInArrow(job, schema)
