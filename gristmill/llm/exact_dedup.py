"""Exact dedup with a log-structured merge index of text digests.

A memtable maps digests to one copy of each text, bounded in rows and bytes;
a text whose digest is there is compared byte by byte. Flushing writes a run
to the shared folder: its distinct texts in the order of their digests, and
for each row the text it has. The run's digests, cut at the bounds of digest
ranges, each piece sorted and with a Bloom filter, are level 0 of the index.
Compaction merges the sorted pieces of a range, keeps the smallest identifier
of each digest, and looks up the digests of more than one run in each piece
behind its filter. Only for these hits the runs' texts are read again and
compared. A text travels at most once a run, however many copies there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, file_system, id_text, removed, scratch, texts_of, written

#: What a memtable holds before it is flushed.
MEMTABLE_ROWS, MEMTABLE_BYTES = 1 << 16, 32 << 20
#: Rows of a digest range, and the most ranges (two bytes of the digest).
RANGE_ROWS, RANGE_BITS = 1 << 17, 16
BITS_A_KEY, PROBES = 16, 4
#: Texts of a batch of a run's file; bytes of the batches that tasks hand on.
BATCH_ROWS, BATCH_BYTES = 64, 4 << 20
#: Parts that the texts of one digest are first compared in.
SALTS = 64
KEY = "S32"
_SPACES = b" \t\n\r\x0b\x0c"


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space; those at the ends stay as one space each."""
    if not text:
        return text
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return (b" " if text[0] in _SPACES else b"") + inner + (b" " if text[-1] in _SPACES else b"")


class Bloom:
    """A filter of 16 bits a key in a power of two of bits; keys are digests, so their own bytes are the hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: np.ndarray) -> Bloom:
        out = cls(np.zeros(1 << max(0, (len(keys) * BITS_A_KEY - 1).bit_length() - 5), np.uint32))
        at = out._places(keys).ravel()
        np.bitwise_or.at(out.words, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        return out

    def _places(self, keys: np.ndarray) -> np.ndarray:
        raw = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 4)
        return ((raw[:, 1:2] + raw[:, 2:3] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(32 * len(self.words) - 1)).astype(np.int64)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        return ((self.words[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=1)


@dataclass
class Run:
    """Sorted digests with, for each, a place, the smallest identifier (if any is known) and the number of rows."""

    keys: np.ndarray
    slots: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    rows: np.ndarray
    bloom: Bloom
    run: int = -1

    def columns(self) -> dict[str, bytes]:
        return {"keys": self.keys.tobytes(), "slots": self.slots.tobytes(), "ids": self.ids.tobytes(), "known": self.known.tobytes(), "rows": self.rows.tobytes(), "bloom": self.bloom.words.tobytes()}

    @classmethod
    def read(cls, run: int, keys: bytes, slots: bytes, ids: bytes, known: bytes, rows: bytes, bloom: bytes) -> Run:
        return cls(np.frombuffer(keys, KEY), np.frombuffer(slots, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(rows, np.int64), Bloom(np.frombuffer(bloom, np.uint32)), run)

    def find(self, other: Run) -> np.ndarray:
        """Which of this run's digests the other has; the filter of the larger one goes before the search."""
        if len(self.keys) > len(other.keys):
            some = other.keys[self.bloom.may_have(other.keys)]
            out = np.zeros(len(self.keys), bool)
            low, high = np.searchsorted(self.keys, some, "left"), np.searchsorted(self.keys, some, "right")
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                out[a:b] = True
            return out
        out = other.bloom.may_have(self.keys)
        some = self.keys[out]
        at = np.minimum(np.searchsorted(other.keys, some), max(0, len(other.keys) - 1))
        out[out] = other.keys[at] == some if len(other.keys) else False
        return out


def compacted(runs: list[Run]) -> Run:
    """The digests that several entries of the runs have, with their smallest identifiers: sorted runs merged."""
    keys = np.concatenate([r.keys for r in runs])
    order = np.argsort(keys, kind="stable")  # merges what is sorted already
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    many = np.diff(np.append(start, len(keys))) > 1
    ids, known = np.concatenate([r.ids for r in runs])[order], np.concatenate([r.known for r in runs])[order]
    low = np.minimum.reduceat(np.where(known, ids, np.iinfo(np.int64).max), start)[many]
    rows = np.add.reduceat(np.concatenate([r.rows for r in runs])[order], start)[many]
    return Run(keys[start][many], np.zeros(len(rows), np.int32), low, np.logical_or.reduceat(known, start)[many], rows, Bloom.of(keys[start][many]))


class Memtable:
    """Distinct texts by digest, and the rows that have them."""

    def __init__(self, width: int):
        self.width, self.slots, self.bodies, self.keys, self.size = width, {}, [], [], 0
        self.ids: list[int | None] = []
        self.at: list[int] = []
        self.shas: list[bytes] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        sha = hashlib.sha256(text).digest()
        key = sha[: self.width].ljust(32, b"\0")
        same = self.slots.setdefault(key, [])
        slot = next((s for s in same if self.bodies[s] == text), None)
        if slot is None:
            slot = len(self.bodies)
            same.append(slot)
            self.bodies.append(text)
            self.keys.append(key)
            self.size += len(text)
        self.ids.append(doc_id)
        self.at.append(slot)
        self.shas.append(sha)

    def flush(self, folder: str, run: int, bits: int) -> Iterator[pa.RecordBatch]:
        """Write the run's files and hand on its pieces, one a digest range."""
        system, top = file_system(folder)
        for part in ("bodies", "rows"):
            system.create_dir(f"{top}/{part}", recursive=True)
        keys = np.array(self.keys, KEY)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        small = pa.ipc.IpcWriteOptions(compression="lz4")
        kind = pa.schema([("body", pa.large_binary())])
        with system.open_output_stream(f"{top}/bodies/{run}.arrow") as f, pa.ipc.new_file(f, kind, options=small) as w:
            for a in range(0, len(order), BATCH_ROWS):
                w.write_batch(pa.record_batch([pa.array([self.bodies[i] for i in order[a : a + BATCH_ROWS].tolist()], pa.large_binary())], schema=kind))
        slots = place[self.at]
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "slot": pa.array(slots), "sha": pa.array(self.shas, pa.binary(32))})
        with system.open_output_stream(f"{top}/rows/{run}.arrow") as f, pa.ipc.new_file(f, table.schema, options=small) as w:
            w.write_table(table, max_chunksize=1 << 14)
        ids, known, rows = least_ids(table.column("doc_id"), slots, len(order))
        keys = keys[order]
        prefix = keys.view(np.uint8).reshape(-1, 32)[:, :2].astype(np.int64) @ np.array([256, 1]) >> RANGE_BITS - bits
        cut = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            piece = Run(keys[a:b], np.arange(a, b, dtype=np.int32), ids[a:b], known[a:b], rows[a:b], Bloom.of(keys[a:b]))
            yield pa.record_batch({"range": pa.array([int(prefix[a])], pa.int32()), "run": pa.array([run], pa.int64())} | {c: pa.array([x], pa.binary()) for c, x in piece.columns().items()})


def least_ids(doc_ids: pa.ChunkedArray, slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each slot the smallest known id, whether one is known, and the rows."""
    some = ~doc_ids.is_null().to_numpy()
    ids = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(ids, slots[some], doc_ids.fill_null(0).to_numpy()[some])
    return ids, np.bincount(slots[some], minlength=n) > 0, np.bincount(slots, minlength=n)


LEVEL0 = "range int, run long, keys binary, slots binary, ids binary, known binary, rows binary, bloom binary"
HITS = "key binary, run long, slot int, id long, n long"


def flush_runs(folder: str, rows: int, size: int, width: int, bits: int):
    """A function for mapInArrow: texts into memtables, memtables into runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, table = TaskContext.get().taskAttemptId() << 20, Memtable(width)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                table.add(i, normalised(t))
                if len(table.ids) >= rows or table.size >= size:
                    yield from table.flush(folder, number, bits)
                    number, table = number + 1, Memtable(width)
        if table.ids:
            yield from table.flush(folder, number, bits)

    return run


def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by range: merge each range and look its repeated digests up in the pieces."""

    def hits(held: list[Run]) -> Iterator[pa.RecordBatch]:
        many = compacted(held)
        for r in held if len(many.keys) else ():
            at = np.flatnonzero(r.find(many))
            if len(at):
                keys = pa.array(r.keys.view(np.uint8).reshape(-1, 32)[at].tobytes()[i : i + 32] for i in range(0, 32 * len(at), 32))
                yield pa.record_batch({"key": keys.cast(pa.binary()), "run": pa.array(np.full(len(at), r.run)), "slot": pa.array(r.slots[at]), "id": pa.array(r.ids[at], mask=~r.known[at]), "n": pa.array(r.rows[at])})

    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["range"] != now:
                if held:
                    yield from hits(held)
                now, held = r["range"], []
            held.append(Run.read(r["run"], *(r[c] for c in ("keys", "slots", "ids", "known", "rows", "bloom"))))
    if held:
        yield from hits(held)


def read_bodies(folder: str):
    """A function for mapInArrow: the texts of the hits of each run, in batches of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        for b in batches:
            for r in b.to_pylist():
                asked, out, size = sorted(r["hits"], key=lambda h: h["slot"]), [], 0
                with system.open_input_file(f"{top}/bodies/{r['run']}.arrow") as f:
                    file, now, bodies = pa.ipc.open_file(f), -1, None
                    for h in asked:
                        if h["slot"] // BATCH_ROWS != now:
                            now = h["slot"] // BATCH_ROWS
                            bodies = file.get_batch(now).column("body")
                        out.append(h | {"run": r["run"], "body": bodies[h["slot"] % BATCH_ROWS].as_py()})
                        size += len(out[-1]["body"])
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(out, BODY_SCHEMA)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, BODY_SCHEMA)

    return run


BODIES = HITS + ", body binary"
BODY_SCHEMA = pa.schema([("key", pa.binary()), ("run", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def read_rows(folder: str):
    """A function for mapInArrow: a run's rows with what the index found for their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        for b in batches:
            for r in b.to_pylist():
                with system.open_input_file(f"{top}/rows/{r['run']}.arrow") as f:
                    table = pa.ipc.open_file(f).read_all()
                slots = table.column("slot").to_numpy()
                ids, known, rows = least_ids(table.column("doc_id"), slots, int(slots.max()) + 1)
                for x in r["placed"] or ():
                    ids[x["slot"]], known[x["slot"]], rows[x["slot"]] = x["keep_id"] or 0, x["keep_id"] is not None, x["group_size"]
                doc_id, keep = table.column("doc_id").combine_chunks(), pa.array(ids[slots], mask=~known[slots])
                kept = (doc_id.is_null().to_numpy(zero_copy_only=False) & ~known[slots]) | (known[slots] & ~doc_id.is_null().to_numpy(zero_copy_only=False) & (doc_id.fill_null(0).to_numpy() == ids[slots]))
                yield pa.record_batch({"doc_id": doc_id, "keep_id": keep, "group_size": pa.array(rows[slots]), "kept": pa.array(kept), "text_sha256": pa.array([x.hex() for x in table.column("sha").to_pylist()])})

    return run


def exact_dedup(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, memtable_bytes: int = MEMTABLE_BYTES, range_rows: int = RANGE_ROWS, digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text; other columns are ignored. Texts are equal
    when identical after each run of ASCII white space becomes one space; a
    null text counts as empty, and all empty texts are one group. Of a group
    the smallest doc_id stays. Rows that repeat that id are all marked kept
    (they can't be told apart); a null doc_id stays only in a group without
    any other id. An empty table gives an empty result. ``digest_bytes``
    shortens the index key (for tests of collisions); results don't depend on
    it, nor on the sizes of memtables and ranges.
    """
    spark, rows = docs.sparkSession, id_text(docs)
    folder = scratch(spark, "runs")
    bits = min(RANGE_BITS, max(4, (rows.count() // range_rows).bit_length()))
    level0 = written(rows.mapInArrow(flush_runs(folder, memtable_rows, memtable_bytes, digest_bytes, bits), LEVEL0), "level0")
    runs = written(level0.groupBy("run").agg(F.count(F.lit(1)).alias("pieces")), "run-list")
    tasks = max(1, min(runs.count(), max(2 * spark.sparkContext.defaultParallelism, runs.count() // 4)))

    merging = level0.repartition(max(1, min(1 << bits, 4 * tasks)), "range").sortWithinPartitions("range")
    hits = written(merging.mapInArrow(compact, HITS), "hits")
    asked = hits.groupBy("run").agg(F.collect_list(F.struct("key", "slot", "id", "n")).alias("hits"))  # at most a memtable
    bodies = written(asked.repartition(tasks, "run").mapInArrow(read_bodies(folder), BODIES), "bodies")
    # equal digest and equal bytes: this grouping is the byte verification; a hot text meets itself in parts first
    part = F.pmod(F.xxhash64("run"), F.lit(SALTS))
    proven = bodies.groupBy("key", "body", part.alias("part")).agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    proven = written(proven.groupBy("key", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "proven")
    by_key = written(proven.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")), "groups")
    kinds = ["run", "slot", "keep_id", "group_size"]
    placed = hits.join(by_key.where("texts = 1"), "key").select(*kinds)
    mixed = by_key.where("texts > 1").select("key")
    if not mixed.isEmpty():
        placed = placed.unionByName(bodies.join(mixed, "key", "left_semi").join(proven, ["key", "body"]).select(*kinds))
    placed = placed.groupBy("run").agg(F.collect_list(F.struct("slot", "keep_id", "group_size")).alias("placed"))
    found = written(runs.join(placed, "run", "left").select("run", "placed"), "placed")
    for done in (level0, runs, hits, bodies, proven, by_key):
        discard(done)
    removed(spark, f"{folder}/bodies")
    return found.repartition(tasks, "run").mapInArrow(read_rows(folder), RESULT)
