"""Byte-level BPE encoding and decoding; long texts are encoded in halves of halves and concatenated as a tree.

A text above ``part_bytes`` is halved, at code points, until its parts are small. The parts are rows of
their own, so they are encoded in parallel. Then neighbours are concatenated, level by level: a window
of tokens around each join is encoded anew, and it grows until its first token is the one that the left
half has there and its last token the one of the right half (or until it covers a half).

Why that is exact. A text is cut into pieces by a scan that looks neither back nor more than three
characters ahead, and the tokens of a piece are merged by rank. (1) What lies between two token
boundaries of a piece encodes alone to the tokens that it has there. (2) Tokens are the encoding of their
piece if each pair of neighbours encodes to itself: the first merge across a boundary would also
happen in the pair alone. A window that starts and ends with tokens of the halves keeps each such pair
of them, so nothing beyond the window can change. Windows are only cut where the scan can't take
another turn: not at an apostrophe (contractions), not between white space and what follows it, not
within reach of a special token that straddles the join.

Two libraries encode. The one that the file is made for merges listed pairs; a faster one merges whatever
two tokens make up a third. They agree where ids follow the order of merges and every token encodes to
itself, as a merge that isn't listed would then be reached in the token alone: both are checked when
the file is loaded. The faster one is given texts of letters, digits and marks that all versions of
Unicode class alike; the other one encodes the rest, and all texts if the file is of another kind.

Ids are kept as they are on disk for training: a binary of little-endian unsigned 32-bit integers.

Defined results: null and empty texts have no ids and decode to an empty text; the string of a special
token is that token, as the library has it; rows with the same id or text are rows of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galena.llm.common import cut, flat, join_counted, slices

PART_BYTES = 32 << 10
#: Tokens on each side of a join in the first window. More than the bytes of any special token.
WINDOW = 32
# How byte-level files cut a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A character outside of ASCII, Latin, Cyrillic, general punctuation, kana, ideographs and Hangul as they have been for long.
UNUSUAL = re.compile("[^\t-\r -~\u00a1-\u024f\u0400-\u0481\u2010-\u2027\u2030-\u205e\u3001-\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]")
ID = np.dtype("<u4")


def alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: visible Latin-1 stands for itself, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A tokenizer file, and the bytes of each of its tokens."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if max((len(t.encode()) for t in added.values()), default=0) > WINDOW // 2:
            raise ValueError(f"special tokens of more than {WINDOW // 2} bytes don't fit the window")
        byte = alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = added[i].encode() if i in added else bytes(byte[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.quick = self.ranked(path, added)

    def ranked(self, path: str, added: dict[int, str]) -> tiktoken.Encoding | None:
        """The faster encoder, if it gives the same ids."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cutter = file["model"], file["pre_tokenizer"] or {}
        plain = {k: model.get(k) for k in ("type", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")}
        if file["normalizer"] or any(plain[k] for k in plain if k != "type") or plain["type"] != "BPE" or {k: cutter.get(k) for k in ("type", "add_prefix_space", "use_regex")} != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            return None
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocabulary) - len(merges)
        in_order = sorted(vocabulary.values()) == list(range(len(vocabulary))) and all(vocabulary[a + b] == first + k for k, (a, b) in enumerate(merges))
        if first != 256 or not in_order or any([t.id for t in self.tokenizer.model.tokenize(token)] != [i] for token, i in vocabulary.items()):
            return None
        return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks={self.bytes_of[i]: i for i in vocabulary.values()}, special_tokens={t: i for i, t in added.items()})

    def encode(self, text: str) -> np.ndarray:
        if self.quick and not UNUSUAL.search(text):
            return self.quick.encode_to_numpy(text, allowed_special="all").astype(ID, copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; one without a token has none, bytes that are no text become U+FFFD."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        n = self.lengths[ids]
        at = np.repeat(self.offsets[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(ids) else ids
        return self.flat[at].tobytes().decode(errors="replace")

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    def sound(self, ids: np.ndarray, at: int) -> bool:
        """Whether a window may be cut before ids[at]."""
        before, after = self.text(ids[max(0, at - 12) : at])[-12:], self.text(ids[at : at + 12])[:4]
        if not before or not after or after[0] & 0xC0 == 0x80 or b"'" in before + after:
            return False
        last, first = before.decode(errors="ignore")[-1:], after.decode(errors="ignore")[:1]
        if not last or not first or "\x1c" <= last <= "\x1f" or "\x1c" <= first <= "\x1f":
            return False
        return first.isspace() or not last.isspace()

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of two neighbouring texts as one."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        k = WINDOW
        while True:
            room = k // 4
            a = 0 if len(left) <= k else next((i for i in range(len(left) - k, len(left) - k + room) if self.sound(left, i)), None)
            b = len(right) if len(right) <= k else next((j for j in range(k, k - room, -1) if self.sound(right, j)), None)
            k *= 2
            if a is None or b is None:
                continue
            window = (self.text(left[a:]) + self.text(right[:b])).decode()
            new = self.encode(window)
            if (a == 0 or new[0] == left[a]) and (b == len(right) or new[-1] == right[b - 1]):
                return np.concatenate([left[:a], new, right[b:]])

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        """Neighbours are joined level by level, so that every join has two halves of about one size."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, ID)


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(text: bytes, part_bytes: int) -> list[bytes]:
    """The text, halved at code points until no part has more than ``part_bytes`` (or a few more, for whole code points)."""
    n = 1
    while len(text) > n * part_bytes:
        n *= 2
    at = [len(text) * i // n for i in range(n + 1)]
    for k in range(1, n):
        while at[k] < len(text) and text[at[k]] & 0xC0 == 0x80:
            at[k] += 1
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column("text")
    for i, j in slices(flat(column)[1]):
        yield i, j, [t or "" for t in column[i:j].to_pylist()]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for i, j, texts in _texts(batch):
            ids = pa.array([codec(path).encode(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest[i:j].columns, ids], [*rest.schema.names, "ids"])


def encode(docs: DataFrame, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id and ids of each row of ``docs``. ``path``: a tokenizer file that every executor can open."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    long = rows.where(F.octet_length("text") > part_bytes).withColumn("key", F.sha2("text", 256))
    short = rows.where(F.coalesce(F.octet_length("text") <= part_bytes, F.lit(True)))
    out = short.mapInArrow(lambda batches: _encoded(batches, path), f"doc_id {kind}, ids binary")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in _texts(batch):
                for key, text in zip(batch.column("key")[i:j].to_pylist(), texts, strict=True):
                    pieces = [p.decode() for p in halves(text.encode(), part_bytes)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces)], ["key", "part", "text"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        ids = codec(path).concatenate([np.frombuffer(b, ID) for b in table["ids"].to_pylist()])
        return pa.table({"key": table["key"][:1], "ids": pa.array([ids.tobytes()], pa.binary())})

    # A text that many rows have is encoded once.
    pieces = long.select("key", "text").mapInArrow(parts, "key string, part int, text string").dropDuplicates(["key", "part"])
    encoded = pieces.mapInArrow(lambda batches: _encoded(batches, path), "key string, part int, ids binary")
    joined = encoded.groupBy("key").applyInArrow(whole, "key string, ids binary")
    copies = long.groupBy("key").agg(F.count("*").alias("n"))
    joined = cut(joined)
    return out.unionByName(join_counted(long.select("doc_id", "key"), joined.join(copies, "key"), "key", "n").select("doc_id", "ids"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with the text that their ``ids`` decode to, as ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(flat(batch.column("ids"))[1]):
                part = batch[i:j]
                texts = [codec(path).decode(np.frombuffer(b or b"", ID)) for b in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, decoded string")


def token_digests(docs: DataFrame, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    rows = decode(encode(docs, path, part_bytes), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
