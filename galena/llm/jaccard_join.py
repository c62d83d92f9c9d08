"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (all its words, if it has fewer). Equal sets are one
class, and only classes are compared.

*Chosen paths.* A class has ``COORDINATES`` min-hash values; two sets share each with a probability
equal to their similarity. The root of a run draws one or two coordinates (1 / similarity on average)
and sends each class to the child for its value there. A child of more than ``BUCKET`` classes draws
coordinates of its own and splits again, to a depth of ``DEPTH``; smaller ones are compared pair by
pair on 128-bit min-wise sketches. Runs are repeated until a pair at the threshold is missed with a
probability below ``1 - RECALL``, also where its buckets are split at every level. A bucket that cannot be split because its sets are
alike is dealt into blocks, and every pair of blocks is compared, so nothing is capped.

*Verification.* Sketches only link classes into candidate groups. Each group's sets are then compared
exactly, and links at ``similarity`` or more are counted inside the task: pairs are never written out.
A text goes to one task only. In a large group each class is told as what its set and the set of the
group's representative do not share, which is little among near copies; these differences are dealt into
blocks, and every pair of blocks is compared from them. Groups are the components of the exact links.

Defined results: a null or empty text has no shingles, no links and is a group of its own; rows with a
null id keep a null group and no links; repeated rows are copies of each other; rows with one id and
different texts are documents of their own; an empty table gives an empty result; ids that are no whole
numbers are an error; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import check_ids, cut, flat, join_counted, mix, prefix_hash, rows_of, slices, span_hash, word_spans
from galena.llm.components import connected, local_components

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
COORDINATES = 32
BITS = 128
#: Sketches of sets at the threshold agree in 115 bits on average, with a deviation of 3.4.
AGREE = 100
BUCKET = 1000
BLOCK = 500
LARGE_BUCKETS = 1_000_000  # rows (16 bytes each) up to which the list of large buckets is broadcast
SALTS = 32
DEPTH = 3
_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
ROW = np.uint64(0x9FB21C651E98DF25)


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """Runs until a pair is missed with probability 1 - recall even where it must collide at every level.

    One more is for runs that draw the same coordinates. By simulation of the draws that holds at 0.8 and
    above; lower thresholds draw the same ones more often (missed at full depth: 0.0003 at 0.7, 0.002 at 0.5).
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**DEPTH)) + 1


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row; the row of each; the offsets of the rows."""
    starts, ends, words = word_spans(data, off)
    row = rows_of(words)
    prefix = prefix_hash(span_hash(prefix_hash(data), starts, ends))
    last = np.minimum(np.arange(len(starts)) + SHINGLE, words[row + 1] if len(row) else 0)
    begin = np.arange(len(starts))
    whole = (last - begin == SHINGLE) | (begin == words[row])  # shorter texts have one shingle
    h, row = span_hash(prefix, begin[whole], last[whole]), row[whole]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    h, row = h[fresh], row[fresh]
    return h, row, np.searchsorted(row, np.arange(len(off)))


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h * ROW), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * ROW)


SIGNATURE_DDL = "doc_id long, text_key long, class long, n int, path binary, low long, high long"


def signatures(docs: DataFrame) -> DataFrame:
    """Class (hash of the set), size, min-hash values and sketch of each text with words; a hash of the text."""
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            for i, j in slices(off):
                h, _, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                low = np.empty((len(some), BITS), np.uint64)
                for k in range(BITS):
                    low[:, k] = np.minimum.reduceat(h * MULTIPLIERS[k], at[some])
                bits = np.packbits((mix(low) & np.uint64(1)).astype(np.uint8), axis=1)
                halves = np.ascontiguousarray(bits).view(np.int64)
                path = np.ascontiguousarray(mix(low[:, :COORDINATES]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i).take(pa.array(some)) for c in (0, 2)), pa.array(set_keys(h, at)[some].view(np.int64)), pa.array(np.diff(at)[some].astype(np.int32)), pa.array([p.tobytes() for p in path], pa.binary()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    names=["doc_id", "text_key", "class", "n", "path", "low", "high"],
                )

    return source.mapInArrow(job, SIGNATURE_DDL)


def drawn(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two coordinates for each node and whether the second one counts; the same for all its classes."""
    draw = mix(node * ROW + np.uint64(1))
    first = draw % np.uint64(COORDINATES)
    second = (first + np.uint64(1) + (draw >> np.uint64(20)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
    return first, second, (draw >> np.uint64(40)) % np.uint64(4) == 0


def children(rows: DataFrame, runs: int | None) -> DataFrame:
    """(bucket, class, low, high) one level down. At the root (``runs``) each class enters every run."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path = np.frombuffer(b"".join(b.column("path").to_pylist()), np.uint64).reshape(-1, COORDINATES)
            out = []
            for run in range(runs or 1):
                node = np.full(len(path), run, np.uint64) if runs else b.column("bucket").to_numpy().view(np.uint64)
                first, second, both = drawn(node)
                for c, rows_ in ((first, np.arange(len(path))), (second, np.flatnonzero(both))):
                    value = path[rows_, c[rows_].astype(np.int64)]
                    out.append((mix(mix(node[rows_] + ROW) + value + c[rows_]), rows_))
            rows_ = pa.array(np.concatenate([r for _, r in out]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in out]).view(np.int64)), *(b.column(c).take(rows_) for c in ("class", "low", "high"))], names=["bucket", "class", "low", "high"])

    return rows.mapInArrow(job, "bucket long, class long, low long, high long")


def split_by_size(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets of 2 to BUCKET classes, and rows (with the count) of larger ones.

    Rows of large buckets are told apart before the small ones are joined by bucket, so no bucket meets in
    one task. The list of large buckets has a row for more than BUCKET rows; it is broadcast up to
    ``LARGE_BUCKETS`` rows, and joined in ``SALTS`` parts of each bucket beyond that.
    """
    sizes = cut(level.groupBy("bucket").count().where("count > 1"))
    above = sizes.where(F.col("count") > BUCKET)
    small = sizes.where(F.col("count") <= BUCKET).select("bucket")
    if above.count() <= LARGE_BUCKETS:
        marked = level.join(F.broadcast(above), "bucket", "left")
    else:
        parts = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = level.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(parts, ["bucket", "salt"], "left").drop("salt")
    return marked.where("count is null").drop("count").join(small, "bucket", "left_semi"), marked.where("count is not null")


def buckets(classes: DataFrame, runs: int) -> DataFrame:
    """(bucket, class, low, high) of all buckets to be compared: small, or dealt into pairs of blocks."""
    level, done = children(classes.select("path", "class", "low", "high"), runs), []
    for depth in range(1, DEPTH + 1):
        level = cut(level.distinct())
        small, large = split_by_size(level)
        done.append(small)
        if large.isEmpty():
            break
        if depth < DEPTH:
            level = children(large.join(classes.select("class", "path"), "class").select("bucket", "path", "class", "low", "high"), None)
        else:
            parts = F.ceil(F.col("count") / BLOCK).cast("int")
            own = F.pmod(F.xxhash64("class"), parts).cast("int")
            other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            dealt = large.withColumns({"parts": parts, "own": own}).withColumn("other", other)
            done.append(dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "class", "low", "high"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def similar_pairs(bucket: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of the same bucket whose sketches agree enough; rows are sorted by bucket."""
    for step in range(1, len(bucket)):
        i = np.flatnonzero(bucket[:-step] == bucket[step:])
        if not len(i):
            return
        differ = np.bitwise_count(low[i] ^ low[i + step]) + np.bitwise_count(high[i] ^ high[i + step])
        i = i[differ <= BITS - AGREE]
        yield i, i + step


def candidate_links(rows: DataFrame, n_shards: int) -> DataFrame:
    """Links (a, b) that join the classes of each bucket as their sketches do; at most one for each row."""

    def job(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("bucket", "class", "low", "high")]
        order = np.lexsort((columns[1], columns[0]))  # so that buckets with the same classes link them to the same one
        bucket, node, low, high = (c[order] for c in columns)
        low, high = low.view(np.uint64), high.view(np.uint64)
        label = np.arange(len(bucket))
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i, j in similar_pairs(bucket, low, high):
            kept.append((i, j))
            size += len(i)
            if size > 2_000_000:  # join what there is, to keep memory bounded
                label = local_components(len(bucket), *(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept, size = [(np.arange(len(label)), label)], len(label)
        if kept:
            label = local_components(len(bucket), *(np.concatenate(x) for x in zip(*kept, strict=True)))
        off = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(node[off]), "b": pa.array(node[label[off]])})

    shard = F.pmod(F.col("bucket"), F.lit(n_shards)).cast("int")
    return rows.withColumn("__shard", shard).groupBy("__shard").applyInArrow(job, "a long, b long")


def exact_links(h: list[np.ndarray], size: np.ndarray, base: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets with at least this Jaccard similarity.

    Sets i and j have ``base[i] + base[j]`` elements in common and those of h[i] and h[j]; ``size`` are
    their whole sizes. Whole sets have base 0; for differences from a set R, h is what either has alone,
    and base is half the size of R less what R has alone.
    """
    item = np.repeat(np.arange(len(h)), [len(x) for x in h])
    _, which, times = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[which]
    item, which = item[use], column[which[use]]
    common = np.zeros((len(h), len(h)), np.float32)
    order = np.argsort(which, kind="stable")
    item, which = item[order], which[order]
    for begin in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(which, (begin, begin + 8192))
        m = np.zeros((len(h), min(8192, int(shared.sum()) - begin)), np.float32)
        m[item[a:b], which[a:b] - begin] = 1
        common += m @ m.T
    both = common + base[:, None] + base[None, :]
    total = size[:, None] + size[None, :] - both
    return np.nonzero(np.triu(both >= similarity * total - 1e-6, 1))


def linked(node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """class, root, links, copies_linked of the nodes of the links (i, j)."""
    label = local_components(len(node), i, j)
    n, c = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
    for x, y in ((i, j), (j, i)):
        np.add.at(n, x, 1)
        np.add.at(c, x, copies[y])
    some = np.flatnonzero(n)
    return node[some], node[label[some]], n[some], c[some]


def _parts(part: np.ndarray, node: np.ndarray, keep: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each part, those to keep, each node once."""
    order = np.lexsort((node, part))
    order = order[keep[order]]
    if not len(order):
        return
    order = order[np.append(True, (node[order][1:] != node[order][:-1]) | (part[order][1:] != part[order][:-1]))]
    heads = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
    for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
        yield order[a:b]


VERIFIED_DDL = "class long, root long, links long, copies_linked long, label long, block int, copies long, n int, lacks int, shared int, differs binary"


def verified(groups: DataFrame, n_shards: int, similarity: float) -> DataFrame:
    """Exact links of candidate groups that are not dealt into blocks; differences of the classes of the others.

    ``groups``: label, block (-1 for a group that is not dealt), class, copies, leads, text. Each block has
    the representative of its group among its rows, marked by ``leads``.
    """

    def job(table: pa.Table) -> pa.Table:
        data, off = flat(table.column("text"))
        sets = [s for i, j in slices(off) for h, _, at in [shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])] for s in np.split(h, at[1:-1])]
        group, node, block, copies, leads = (table.column(c).to_numpy() for c in ("label", "class", "block", "copies", "leads"))
        same = np.array([len(s) > 0 and int(set_keys(s, np.array([0, len(s)])).view(np.int64)[0]) == c for s, c in zip(sets, node.tolist(), strict=True)], bool)
        size = np.array([len(s) for s in sets])
        whole, told = [], []
        for rows in _parts(group, node, same & (block < 0)):
            if len(rows) > 1:
                i, j = exact_links([sets[r] for r in rows], size[rows], np.zeros(len(rows)), similarity)
                whole.append(linked(node[rows], copies[rows], i, j))
        first = {(group[r], block[r]): r for r in np.flatnonzero(leads & same & (block >= 0)).tolist()}
        for r in np.flatnonzero(same & (block >= 0) & ~leads).tolist():
            lead = sets[first[group[r], block[r]]]
            differs = np.setxor1d(lead, sets[r], assume_unique=True)
            lacks = (len(differs) + len(lead) - size[r]) // 2
            told.append((node[r], group[r], block[r], copies[r], size[r], lacks, len(lead), differs.tobytes()))
        found = [np.concatenate(x) for x in zip(*whole, strict=True)] if whole else [np.zeros(0, np.int64)] * 4
        rest = list(zip(*told, strict=True)) if told else [()] * 8
        n, m = len(found[0]), len(told)
        none = [None] * n
        return pa.table(
            {
                "class": pa.array([*found[0].tolist(), *rest[0]], pa.int64()),
                **{c: pa.array([*v.tolist(), *[None] * m], pa.int64()) for c, v in zip(("root", "links", "copies_linked"), found[1:], strict=True)},
                **{c: pa.array([*none, *v], t) for c, v, t in zip(("label", "block", "copies", "n", "lacks", "shared", "differs"), rest[1:], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)},
            }
        )

    shard = F.pmod(F.xxhash64("label", "block"), F.lit(n_shards)).cast("int")
    return groups.withColumn("__shard", shard).groupBy("__shard").applyInArrow(job, VERIFIED_DDL)


def block_links(dealt: DataFrame, n_shards: int, similarity: float) -> DataFrame:
    """Exact links between the classes of pairs of blocks. ``dealt``: part, block and the differences of ``verified``."""

    def job(table: pa.Table) -> pa.Table:
        part, node, block, copies, n, lacks, shared = (table.column(c).to_numpy() for c in ("part", "class", "block", "copies", "n", "lacks", "shared"))
        data, off = flat(table.column("differs"))
        values = data.view(np.uint64) if len(data) else np.zeros(0, np.uint64)
        out = []
        for rows in _parts(part, node, np.ones(len(part), bool)):
            if len(rows) < 2:
                continue
            sets = [values[off[r] // 8 : off[r + 1] // 8] for r in rows]
            i, j = exact_links(sets, n[rows], shared[rows] / 2 - lacks[rows], similarity)
            if len(np.unique(block[rows])) > 1:
                cross = block[rows][i] != block[rows][j]
                i, j = i[cross], j[cross]
            out.append(linked(node[rows], copies[rows], i, j))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in zip(("class", "root", "links", "copies_linked"), columns, strict=True)})

    shard = F.pmod(F.col("part"), F.lit(n_shards)).cast("int")
    return dealt.withColumn("__shard", shard).groupBy("__shard").applyInArrow(job, "class long, root long, links long, copies_linked long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest id of its group), n_links (other documents it is similar to), n_copies (documents with its set), set_id, class, group, text_key (hashes of the set, the group and the text)."""
    check_ids(docs)
    signed = cut(signatures(docs))
    best = F.min(F.struct("doc_id", "text_key"))
    classes = cut(signed.groupBy("class").agg(best.alias("best"), F.count("*").alias("copies"), F.first("path").alias("path"), F.first("low").alias("low"), F.first("high").alias("high")).withColumn("set_id", F.col("best.doc_id")))
    n_shards = max(8, classes.count() // 2000)
    links = candidate_links(buckets(classes, runs_for(recall, similarity)), n_shards)
    groups = connected(links)
    # One text for each class in a group. Large groups are dealt into blocks, and each block gets the
    # text of the group's representative: the class that the group is labelled by.
    sized = groups.groupBy("label").count().withColumn("parts", F.ceil(F.col("count") / BLOCK).cast("int"))
    large = sized.where("parts > 1").select("label", "parts")
    own = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    if large.limit(LARGE_BUCKETS + 1).count() <= LARGE_BUCKETS:
        large = F.broadcast(large)
    members = groups.join(large, "label", "left").select("label", own.alias("block"), F.col("node").alias("class"), F.lit(False).alias("leads"))
    leaders = sized.where("parts > 1").select("label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.col("label").alias("class"), F.lit(True).alias("leads"))
    placed = members.union(leaders).join(classes.select("class", "best", "copies"), "class")
    wanted = placed.select(F.col("best.doc_id").alias("set_id"), F.col("best.text_key").alias("text_key"), "label", "block", "class", "copies", "leads")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("set_id"), F.xxhash64("text").alias("text_key"), "text")
    sent = texts.join(wanted, ["set_id", "text_key"]).dropDuplicates(["set_id", "text_key", "label", "block", "class", "leads"])
    checked = cut(verified(sent.select("label", "block", "class", "copies", "leads", "text"), n_shards, similarity))
    exact = checked.where("label is null").select("class", "root", "links", "copies_linked")
    roots = exact.select("class", "root")
    differences = checked.where("label is not null")
    if not differences.isEmpty():
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = differences.join(large, "label").withColumn("other", other).withColumn("part", F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other")))
        across = cut(block_links(dealt.select("part", "block", "class", "copies", "n", "lacks", "shared", "differs"), n_shards, similarity))
        joined = connected(across.select(F.col("class").alias("a"), F.col("root").alias("b")))
        roots = roots.union(joined.select(F.col("node").alias("class"), F.col("label").alias("root")))
        exact = exact.union(across)
    counts = exact.groupBy("class").agg(F.sum("links").alias("links"), F.sum("copies_linked").alias("copies_linked"))
    rooted = roots.join(classes.select("class", "set_id"), "class")
    first = rooted.groupBy("root").agg(F.min("set_id").alias("group_id"))
    grouped = rooted.join(first, "root").join(counts, "class").select("class", "root", "group_id", "links", "copies_linked")
    of_class = cut(classes.select("class", "set_id", "copies").join(grouped, "class", "left"))
    of_doc = join_counted(signed.select("doc_id", "text_key", "class"), of_class, "class", "copies")
    out = of_doc.select("doc_id", F.coalesce("group_id", "set_id").alias("class_id"), (F.coalesce("copies_linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), "set_id", "class", F.coalesce("root", "class").alias("group"), "text_key")
    wordless = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    own_id = F.col("doc_id").cast("long")
    alone = wordless.select(own_id.alias("doc_id"), own_id.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), own_id.alias("set_id"), F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("group"), F.xxhash64("text").alias("text_key"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id (then hash of set and text).

    Of repeated rows one stays, of rows with one id and different texts one of each group. Each text without
    words is a group of its own. Rows with a null id all stay.
    """
    found = near_duplicates(docs, similarity).where("doc_id = class_id")
    firsts = found.groupBy("doc_id", F.coalesce("group", "text_key")).agg(F.min(F.struct("class", "text_key"))["text_key"].alias("__text"))
    firsts = firsts.select(F.col("doc_id").alias("__id"), "__text")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__text"))
    one = rows.join(firsts, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select("__doc.*")
    return one.union(docs.where(F.col("doc_id").isNull()))
