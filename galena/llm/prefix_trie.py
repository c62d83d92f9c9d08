"""The trie of all prefixes of conversations, built as a burst trie.

Conversations are rebuilt first: one takes the first turns of the first of its family (``conv_id - conv_id %
family``), then goes on with its own. Equal conversations become one suffix with a count, so copies never
meet in one task: their ids are dealt into blocks by value, and the blocks of a conversation are hashed
as a stream.

A container holds the suffixes under one head of the trie, at first all of them under the root. A container
of more than ``limit`` suffixes is burst by the next turn id: each turn that comes next is a new head
with a container of its own, and a conversation that ends there stays with the head. If all suffixes of
the container go on alike, the shared turns are skipped, so that each round tells some apart. Containers that
remain are sorted, many to a task, and swept into nodes with a stack. Counts of the heads are then added
up from their containers, last round first.

Turn ids are digests of 128 bits of role and text; texts are read once and not shuffled. A container has
at most ``limit`` suffixes, what a task keeps of it is a row for each of its nodes. A conversation is held as
one row of its turn ids.

Defined results: rows without a conv_id belong to no conversation; a null role or text is an empty one; turns
come by number, null first, those with the same number by digest; a conversation without turns ends at
the root; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import check_ids, cut, forget, join_counted

FAMILY, HEADS = 5, 9
#: Suffixes above which a container is burst.
LIMIT = 256
#: Ids of equal conversations in a block.
BLOCK = 1024
WIDTH = 16
NOTHING = hashlib.sha256().hexdigest()
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "up", "level"]
KINDS = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.int32()]


def turn_id(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def rebuild(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, ids (digests of its turns, one after the other), sizes (bytes of their texts) of each rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.expr(f"conv_id - conv_id % {family}").cast("long").alias("base"), F.struct("turn", turn_id(role, text).alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t")
    )
    # A family is dealt out by its base, and what is grouped within it stays there.
    whole = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = F.filter("all", lambda c: c["conv_id"] == F.col("base"))
    families = whole.groupBy("base").agg(F.collect_list(F.struct("conv_id", "own")).alias("all")).withColumn("first", F.coalesce(F.element_at(first, 1)["own"], F.array().cast("array<struct<turn:bigint,id:binary,size:bigint>>")))
    each = families.select("first", F.inline("all")).withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int"))
    turn = F.when(F.col("h") > 0, F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))).otherwise(F.col("own"))
    each = each.select("conv_id", turn.alias("turns"))
    ids = F.aggregate("turns", F.lit(b""), lambda a, t: F.concat(a, t["id"]))
    return each.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def distinct(rebuilt: DataFrame, block: int = BLOCK) -> DataFrame:
    """Equal conversations as a row: conv (smallest id), n, ends (digest of all ids), ids, sizes."""
    blocks = rebuilt.groupBy(F.sha2("ids", 256).alias("key"), F.floor(F.col("conv_id") / block).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("convs"), F.min(F.struct("conv_id", "ids", "sizes")).alias("first"))
    blocks = blocks.select("key", "block", F.size("convs").cast("long").alias("n"), F.array_join(F.col("convs").cast("array<string>"), ",").alias("text"), "first.*")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, row = None, None, None
        done: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if row:
                        done.append((*row, digest.hexdigest()))
                    key, digest, row = r["key"], hashlib.sha256(r["text"].encode()), [r["conv_id"], 0, r["ids"], r["sizes"]]
                else:
                    digest.update(b"," + r["text"].encode())
                row[1] += r["n"]
            if len(done) > 1000:
                yield as_batch(done)
                done = []
        if row:
            done.append((*row, digest.hexdigest()))
        yield as_batch(done)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv", "n", "ids", "sizes", "ends"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(stream, "conv long, n long, ids binary, sizes array<long>, ends string")


def shared(a: bytes, b: bytes) -> int:
    """Turns that two suffixes have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // WIDTH


def shared_turns(low: str, high: str) -> Column:
    """The same for columns."""
    n = f"int(least(length({low}), length({high})) / {WIDTH})"
    alike = f"transform(sequence(0, {n} - 1), i -> substring({low}, i * {WIDTH} + 1, {WIDTH}) = substring({high}, i * {WIDTH} + 1, {WIDTH}))"
    return F.expr(f"CASE WHEN {n} = 0 THEN 0 WHEN array_position({alike}, false) = 0 THEN {n} ELSE int(array_position({alike}, false)) - 1 END")


def burst(rows: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Suffixes in containers of at most ``limit``; and for each round the heads that were burst, and the suffixes that end at them.

    A suffix has head, up (the head above), level (bursts above), depth (turns up to the head), rest (the turn
    ids after it) and sizes (bytes of all turns). A burst head also has skip: turns that all its suffixes share.
    """
    rows = rows.select("conv", "n", "ends", F.col("ids").alias("rest"), "sizes", F.lit("").alias("head"), F.lit("").alias("up"), F.lit(0).alias("level"), F.lit(0).alias("depth"))
    names, settled, rounds = rows.columns, [], []
    while True:
        containers = rows.groupBy("head").agg(F.count("*").alias("size"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        containers = cut(containers.select("head", "size", F.when(F.col("size") > limit, shared_turns("low", "high")).alias("skip")))
        told = cut(join_counted(rows, containers, "head", "size"))
        forget(containers)
        settled.append(told.where(F.col("size") <= limit).select(names))
        over = told.where(F.col("size") > limit)
        heads = over.groupBy("head").agg(*(F.min(c).alias(c) for c in ("up", "depth", "skip")), F.min(F.struct(F.length("rest"), "sizes"))["sizes"].alias("sizes"))
        heads = cut(heads)
        if heads.isEmpty():
            return functools.reduce(DataFrame.unionByName, settled), rounds
        ending = F.length("rest") == F.col("skip") * WIDTH
        rounds.append((heads, over.where(ending).select("head", "conv", "n", "ends")))
        next_id = F.expr(f"substring(rest, skip * {WIDTH} + 1, {WIDTH})")
        rows = over.where(~ending).select(
            "conv",
            "n",
            "ends",
            F.expr(f"substring(rest, (skip + 1) * {WIDTH} + 1)").alias("rest"),
            "sizes",
            F.sha2(F.concat(F.encode("head", "utf-8"), next_id), 256).alias("head"),
            F.col("head").alias("up"),
            F.lit(len(rounds)).alias("level"),
            (F.col("depth") + F.col("skip") + 1).alias("depth"),
        )


class Node:
    """A node that the sweep has open."""

    __slots__ = ("children", "conv", "depth", "ends", "leaves", "n", "saved", "size")

    def __init__(self, depth: int, size: int) -> None:
        self.depth, self.size = depth, size
        self.conv, self.n, self.leaves, self.saved, self.ends = None, 0, 0, 0, NOTHING
        self.children: list[list] = []


def sweep(suffixes: list[dict]) -> list[list]:
    """The nodes of a container, its head last: conv, depth, parent's conv, n_convs, n_children, n_leaves, saved_tokens, ends."""
    depth, out, open_, before = suffixes[0]["depth"], [], [], b""

    def close() -> None:
        x = open_.pop()
        x.leaves = x.leaves or 1
        x.saved += (x.n - 1) * x.size
        for child in x.children:
            child[2] = x.conv
        out.append([x.conv, x.depth, None, x.n, len(x.children), x.leaves, x.saved, x.ends])
        if open_:
            up = open_[-1]
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
            up.n, up.leaves, up.saved = up.n + x.n, up.leaves + x.leaves, up.saved + x.saved
            up.children.append(out[-1])

    for s in suffixes:
        sizes = s["sizes"]
        if not open_:
            open_.append(Node(depth, sizes[depth - 1] if depth else 0))
        same = shared(before, s["rest"])
        while len(open_) > same + 1:
            close()
        for d in range(depth + same, depth + len(s["rest"]) // WIDTH):
            open_.append(Node(d + 1, sizes[d]))
        end = open_[-1]
        end.conv = s["conv"] if end.conv is None else min(end.conv, s["conv"])
        end.n, end.ends, before = end.n + s["n"], s["ends"], s["rest"]
    while open_:
        close()
    return out


def sweep_containers(suffixes: DataFrame) -> DataFrame:
    """NAMES; up and level are those of heads only."""

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[dict] = []

        def flush() -> None:
            if held:
                nodes = sweep(held)
                rows.extend((*x, None, None) for x in nodes[:-1])
                rows.append((*nodes[-1], held[0]["up"], held[0]["level"]))

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["head"] != r["head"]:
                    flush()
                    held = []
                    if len(rows) > 5000:
                        yield as_batch(rows)
                        rows = []
                held.append(r)
        flush()
        yield as_batch(rows)

    ordered = suffixes.repartition("head").sortWithinPartitions("head", "rest")
    return ordered.mapInArrow(run, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up string, level int")


def chains(heads: DataFrame, endings: DataFrame, tops: DataFrame, level: int) -> DataFrame:
    """The nodes of heads that were burst, from the tops of the containers below them. Like ``sweep_containers``, with head for the lowest of each."""
    below = tops.groupBy(F.col("up").alias("head")).agg(F.min("conv_id").alias("conv"), F.sum("n_convs").alias("n"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    all_ = heads.join(below, "head").join(endings.select("head", F.col("conv").alias("end_conv"), F.col("n").alias("end_n"), "ends"), "head", "left")
    all_ = all_.withColumns({"conv": F.least("conv", "end_conv"), "n": F.col("n") + F.coalesce("end_n", F.lit(0)), "at": F.explode(F.sequence(F.lit(0), F.col("skip")))})
    # The root has no text; the text of depth d is number d - 1.
    own = F.expr("aggregate(slice(sizes, greatest(depth + at, 1), IF(depth + skip = 0, 0, skip - at + IF(depth + at = 0, 0, 1))), 0L, (a, x) -> a + x)")
    lowest, highest = F.col("at") == F.col("skip"), F.col("at") == 0
    return all_.select(
        F.col("conv").alias("conv_id"),
        (F.col("depth") + F.col("at")).cast("long").alias("depth"),
        F.when(~highest, F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(lowest, F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * own).alias("saved_tokens"),
        F.when(lowest, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
        F.when(highest, F.col("up")).alias("up"),
        F.when(highest, F.lit(level)).alias("level"),
        F.when(lowest, F.col("head")).alias("head"),
    )


def prefix_nodes(turns: DataFrame, family: int = FAMILY, heads: int = HEADS, limit: int = LIMIT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    check_ids(turns, "conv_id")
    suffixes, rounds = burst(distinct(rebuild(turns, family, heads)), limit)
    nodes = cut(sweep_containers(suffixes)).withColumn("head", F.lit(None).cast("string"))
    for level, (burst_heads, endings) in reversed(list(enumerate(rounds))):
        tops = nodes.where(F.col("level") == level + 1)
        nodes = nodes.unionByName(cut(chains(burst_heads, endings, tops, level)))
    tops = nodes.where("level IS NOT NULL AND depth > 0").withColumnRenamed("n_children", "own_children").drop("parent_conv_id")
    above = nodes.where("head IS NOT NULL").select(F.col("head").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    # A head with many children is told to each of them without bringing them together.
    placed = join_counted(tops, above, "up", "n_children").drop("n_children").withColumnRenamed("own_children", "n_children")
    return nodes.where("level IS NULL OR depth = 0").select(NAMES[:8]).unionByName(placed.select(NAMES[:8]))
