"""What the operators share: tables, cut lineage, and byte and word arrays of Arrow text columns.

Text columns are handled as flat byte arrays, so a batch costs a handful of numpy passes and no
Python object per word. Words are ``[^\\x20\\x09-\\x0D]+``; all separators are ASCII, so cutting
UTF-8 bytes at them never splits a code point.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("galena.shared.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="galena-")
        spark.conf.set("galena.shared.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that no lineage is left."""
    path = f"{shared_dir(df.sparkSession)}/galena-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``cut`` wrote; nothing may read ``df`` any more."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_at)  # type: ignore[attr-defined]
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_sample(df: DataFrame, rows: int, by: list[str], seed: int, kind: str) -> DataFrame:
    """At most ``rows`` different rows of ``by`` and ``kind``, the same in each run: those with the smallest hash, for each of both kinds.

    ``kind`` is a boolean. Repeats of a row are one row. A kind takes its share of the rows, but a rare one has up to a quarter of the
    sample, so a few rows beside very many reach it. A threshold on the hash goes before the sort, so
    the partitions send little more than the sample, however many there are.
    """
    distinct = cut(df.select(*by, kind).distinct())
    count = {bool(r[kind]): r["count"] for r in distinct.groupBy(kind).count().collect()}
    total = sum(count.values())
    least = {k: min(n, rows // 4) for k, n in count.items()}
    quota = {k: max(least[k], min(n, rows * n // max(total, 1), rows - sum(v for o, v in least.items() if o != k))) for k, n in count.items()}
    draw = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30))
    parts = []
    for k, n in sorted(quota.items()):
        share = 1.0 if count[k] <= 4 * n else 1.2 * n / count[k]
        parts.append(distinct.where((F.col(kind) == k) & (draw <= int(share * (1 << 30)))).orderBy(draw, *by).limit(n))
    return functools.reduce(DataFrame.unionByName, parts) if parts else distinct


#: Rows of a key from which on it is joined apart, and up to which the list of such keys is broadcast.
HOT_ROWS, HOT_KEYS, SALTS = 1_000, 1_000_000, 32


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` to the one row of ``table`` for their key; ``n`` tells how many of ``rows`` have it.

    Rows of a hot key never meet in one task. There are at most (number of rows) / HOT_ROWS hot keys: they
    are broadcast up to HOT_KEYS of them, and joined in SALTS parts beyond that. ``table`` is read twice.
    """
    hot, other = table.where(F.col(n) > HOT_ROWS), table.where(F.col(n) <= HOT_ROWS)
    if hot.count() > HOT_KEYS:
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
        parts = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", salt).join(parts, [key, "__salt"]).drop("__salt")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(other, key).unionByName(rows.join(F.broadcast(hot), key))


def check_ids(docs: DataFrame, column: str = "doc_id") -> None:
    """Operators that compare ids need whole numbers."""
    kind = docs.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} has to be a whole number, not {kind.simpleString()}")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


# --- bytes -----------------------------------------------------------------------------------


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(max(n, 2 * SLICE_BYTES), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE ** i; ``span_hash`` takes the hash of any span from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal wherever the values are."""
    inverse = powers(len(prefix))[1]
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n])


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each row's words in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = space[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:] = gap[:-1] | first[1:n]
    after[:-1] = gap[1:] | first[1:n]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of flags in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
