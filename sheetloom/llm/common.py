"""Helpers that the corpus operators share: words, row mapping, shared files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of digits, lower-case letters and everything beyond ASCII, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Upper case to lower case, what no word holds to a space; bytes of other characters stay.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step handles; longer texts form a step of their own.
CHUNK = 2 << 20
#: The same where a step takes many times the memory of its texts.
STEP = 1 << 19


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def spare(names: list[str], wish: str) -> str:
    """A column name that is not among names."""
    while wish in names:
        wish += "_"
    return wish


def named(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as long; ids that are no integers are refused."""
    kind = df.select(named(name)).schema[0].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{name} must be an integer column, not {kind.simpleString()}")
    return named(name).cast("long")


def map_texts(df: DataFrame, text: str, made: T.StructType, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], keep: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Adds columns that are worked out from each row's whole text.

    make() runs once in each task and gives a function from a list of texts (UTF-8,
    b"" for null) to one Arrow array for each field of made. keep names the input
    columns to hand on (default: all); those that share a name with a made column
    are replaced by it.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in made.names]
    by = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(by[c] for c in kept), *made.fields])
    src = df.select(*(named(c) for c in kept), F.coalesce(named(text).cast("string"), F.lit("")).cast("binary").alias(spare(kept, "text__")))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.columns[-1]
            sizes = np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            for end in cuts(sizes, chunk):
                got = work(texts.slice(at, end - at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns[:-1]), *got], names=names)
                at = end

    return src.mapInArrow(run, schema)


def cuts(sizes: np.ndarray, chunk: int) -> list[int]:
    """Ends of runs of rows whose sizes add up to about chunk."""
    if not len(sizes):
        return []
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // chunk)) + 1
    return [*ends.tolist(), len(sizes)]


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names. A session on one machine may name none: then a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there and lost executors cost no recomputation."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, written to the shared folder in as many buckets by keys as shuffles have partitions: joins on keys leave them where they are.

    The table's name serves to read it once and is given up again; the files stay.
    """
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A bucket is a task's, so that each makes one file.
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).option("path", shared_dir(spark)).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"drop table {name}")
    return rows


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Puts bytes into the shared folder and lets every executor fetch them; returns the name for SparkFiles.get."""
    jvm, name = spark.sparkContext._jvm, f"{uuid.uuid4().hex}-{name}"
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


# --- vectorised hashing -------------------------------------------------------

ODD = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(norm: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes in which words are parted by single spaces or newlines: each word's 64-bit hash, start and end."""
    t = np.frombuffer(norm, dtype=np.uint8)
    word = t > 32
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    # Eight bytes at a time: the words' lengths fix how many loads each needs.
    pad = np.concatenate([t, np.zeros(16, np.uint8)])
    loads = np.ndarray((len(t) + 8,), dtype="<u8", buffer=pad.data, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) * np.uint64(ODD))
    at, left, who = start, size, slice(None)
    while True:
        part = loads[at] & MASKS[np.minimum(left, 8)]
        h[who] = mix((h[who] ^ part) * np.uint64(ODD) + np.uint64(1))
        more = left > 8
        if not more.any():
            return h, start, end
        idx = np.flatnonzero(more)
        who = idx if isinstance(who, slice) else who[idx]
        at, left = at[idx] + 8, left[idx] - 8


MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


# --- rows dealt out by bucket ---------------------------------------------------

def by_bucket(rows: DataFrame, work: Callable[[list[bytes]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies work to all packed blobs of each bucket. rows: (bucket long, data binary); a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != at:
                    if held and (out := work(held)) is not None:
                        yield out
                    at, held = b, []
                held.append(data)
        if held and (out := work(held)) is not None:
            yield out

    return rows.select("bucket", "data").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


#: Schemas of packed rows on their way to a bucket, and of what buckets answer.
OUT, ANSWER = "bucket long, data binary", "row binary, found binary"


def blobs(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["bucket", "data"])


def answers(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.binary()), pa.array([d for _, d in found], pa.binary())], names=["row", "found"]) if found else None


def edges(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours, and the end."""
    return np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(1, np.int64)


def settled(rows: list[bytes], own: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """(row, packed columns) for each text number in own."""
    order = np.argsort(own, kind="stable")
    own, cols = own[order], [c[order].astype("<u4") for c in cols]
    e = edges(own)
    for lo, hi in zip(e[:-1].tolist(), e[1:].tolist(), strict=True):
        yield rows[own[lo]], b"".join(c[lo:hi].tobytes() for c in cols)


def pack_arrays(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed blob."""
    parts = [a if isinstance(a, bytes) else a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays]
    head = np.array([len(parts), *(2 * len(p) + isinstance(a, bytes) for p, a in zip(parts, arrays, strict=True))], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack_arrays(data: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        part, plain = raw[at : at + size // 2], size % 2
        out.append(part if plain else np.frombuffer(part, part[:4].decode().strip(), offset=4))
        at += size // 2
    return out


def text_row(text: str) -> Column:
    """The first ROW bytes of a text's SHA-256; a null text counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(named(text).cast("string"), F.lit("")), 256)), 1, ROW)


def distinct_texts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members: doc, row; texts: row, doc, text), one text for each group of exact copies.

    row is the first ROW bytes of the text's SHA-256; doc is the smallest id of the group, null
    where none has an id. A null text counts as empty. The test of row is always true: joins
    would add it, and with it everywhere one exchange of the texts serves all uses.
    """
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    row = text_row(text)
    members = docs.select(named(doc_id).alias("doc"), row.alias("row"))
    texts = docs.select(row.alias("row"), named(doc_id).alias("doc"), body.alias("text")).where(F.col("row").isNotNull()).groupBy("row").agg(F.min("doc").alias("doc"), F.max("text").alias("text"))
    return members, texts


LAST = (1 << 63) - 1
#: Bytes of a text digest that stand for the text.
ROW = 12


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(named(text))), F.lit(0))).first()[0]
