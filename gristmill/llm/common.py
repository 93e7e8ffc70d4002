"""What the text operators share: the shared folder, written tables, hashing of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import shared_dir, visible_to_workers

#: ASCII white space, as in the character class [\x20\x09-\x0D].
ASCII_SPACE = r"[\x20\x09-\x0D]"
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20
#: Cells of a filter, of 64 bits: 4 MB travel to each executor at most.
CELLS = 1 << 18


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/gristmill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned."""
    for name in df.inputFiles()[:1]:
        removed(df.sparkSession, name.rsplit("/", 1)[0])


def file_system(uri: str) -> tuple:
    """The file system and the path in it, for files that tasks write and read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, as one text may have megabytes; a value that the user set stays."""
    visible_to_workers(spark)
    for key, usual, own in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(own))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, null text as empty; other columns can't clash."""
    arrow_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def sifted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` is surely not in the only column of ``keys`` (of the same type), and those whose may be.

    Together they are all rows. A filter of bounded size tells, so that only the
    second frame need travel to a join with ``keys``; with more keys than it
    has room for, more rows are in the second, up to all of them. Null is a key.
    """
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(CELLS)), F.pmod(F.shiftright(F.xxhash64(c), 32), F.lit(64)).cast("int"))
    cell, bit = place(F.col(keys.columns[0]))
    cells = keys.select(cell.alias("sifted_cell"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    cells = cells.groupBy("sifted_cell").agg(F.bit_or("bit").alias("sifted_bits"))
    cell, bit = place(key)
    told = rows.join(F.broadcast(cells), cell == cells["sifted_cell"], "left")
    may = F.coalesce(F.getbit(cells["sifted_bits"], bit) == 1, F.lit(False))
    own = [cells[c] for c in cells.columns]
    return told.where(~may).drop(*own), told.where(may).drop(*own)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n (null stays null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


# ---------------------------------------------------------------- words as numbers

#: An odd multiplier has an inverse modulo 2**64; both are fixed so that all workers agree.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that low bits depend on all."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words between ASCII white space."""
    gap = IS_SPACE[raw]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from prefix sums."""
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + words[i : i + n]
    return mix(out)


def texts_of(batch, column: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as UTF-8."""
    import pyarrow as pa

    return batch.column(column).cast(pa.binary()).to_pylist()


def batches_of(batches: Iterator, rows: int, size: int) -> Iterator:
    """Regroup (id, text bytes) pairs of Arrow batches into lists of bounded rows and bytes."""
    held, n = [], 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
            held.append((i, t))
            n += len(t)
            if len(held) >= rows or n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held
