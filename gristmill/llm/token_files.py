"""Token ids in Arrow IPC files of fixed-size-list batches.

Texts are dealt out by ranges of doc_id and sorted; each task encodes its
range and writes one file of equal-length sequences (column ``tokens``) with
masks (column ``mask``, false where the last sequence is padded), and beside
it an index of (doc_id, start, n). A row's address follows from its number, so
``SequenceFile`` returns views of the mapped file without copying.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, id_text, scratch, texts_of, written

SEQUENCE, ROWS_A_BATCH = 1024, 256
#: Words a worker remembers before it starts anew, about 150 MB.
MAX_WORDS = 600_000
#: The declaration of a tokenizer whose ids of a text are those of its words.
PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "kind": "BPE",
}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte inside a byte-level vocabulary: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def plain_words(definition: str) -> bool:
    """Whether a text's ids are those of its words, by the tokenizer's declared normaliser, splitter and special tokens."""
    own = json.loads(definition)
    marks = [t["content"] for t in own.get("added_tokens") or ()]
    return all(m.startswith("<|") and not m.split()[1:] for m in marks) and {"normalizer": own.get("normalizer"), "pre_tokenizer": own.get("pre_tokenizer"), "kind": (own.get("model") or {}).get("type")} == PLAIN


class WordEncoder:
    """The tokenizers library behind a bounded memory of words.

    If the tokenizer is one of ``plain_words``, a text's ids are those of its
    words in order. A word of lower-case Latin letters in normal form is one
    piece as it stands and goes to the library's model directly; any other word
    goes through the whole tokenizer, as whole texts do for another tokenizer.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters, self.by_word = Tokenizer.from_str(definition), {}, byte_letters(), plain_words(definition)
        self.model = self.tokenizer.model

    def _letters_only(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)) and word == word.lower()

    def _ids(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ".," and self._letters_only(word[-2].lower()):  # a piece of its own
            return self._ids(word[:-1]) + self._ids(word[-1])
        if self._letters_only(word):
            spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for t in texts:
            if not self.by_word:
                yield np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32)
                continue
            # special tokens are written in lower case between <| and |>; a text with such marks keeps its case
            words, known = (t if b"<|" in t else t.lower()).split(), self.known
            new = set(words).difference(known)
            if len(known) + len(new) > MAX_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self._ids(w.decode())
            yield np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)


_encoders: dict[int, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


class SequenceWriter:
    """Pack ids end to end into sequences of equal length; only the last is padded."""

    def __init__(self, sink, length: int, rows: int, kind: pa.DataType):
        self.length, self.block, self.kind = length, length * rows, kind
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n += len(ids)
        if self.n >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(ids[at : at + self.block], self.block)
            self.held, self.n = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch([x.cast(f.type) for x, f in zip(lists, self.schema, strict=True)], schema=self.schema))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.held)
            self._write(np.concatenate([ids, np.zeros(-len(ids) % self.length, ids.dtype)]), len(ids))
        self.writer.close()


class SequenceFile:
    """Random access to a file of sequences; views, no copies, where the file can be mapped."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("tokens").type.list_size
        self.batches: dict[int, tuple] = {}
        first = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.rows = first
        last = self.reader.num_record_batches - 1
        self.count = last * first + self.reader.get_batch(last).num_rows if last >= 0 else 0

    def __len__(self) -> int:
        return self.count

    def _batch(self, k: int) -> tuple:
        if k not in self.batches:
            if len(self.batches) >= 8:
                self.batches.clear()
            b = self.reader.get_batch(k)
            self.batches[k] = b.column("tokens").flatten().to_numpy(zero_copy_only=True), b.column("mask").flatten()
        return self.batches[k]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Sequence i: its ids (a view) and its mask (a slice)."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        tokens, mask = self._batch(i // self.rows)
        at = i % self.rows * self.length
        return tokens[at : at + self.length], mask.slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids at start ... start+n-1 of the whole file."""
        size, out, end = self.rows * self.length, [], start + n
        while start < end:
            k, at = divmod(start, size)
            take = min(end - start, size - at)
            out.append(self._batch(k)[0][at : at + take])
            start += take
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


def write_sequences(docs: DataFrame, definition: str, end_id: int = 2, length: int = SEQUENCE, rows: int = ROWS_A_BATCH, folder: str | None = None) -> DataFrame:
    """Write all texts' ids to files below ``folder`` (a fresh one of the shared folder unless given).

    Returns the manifest, one row a file: shard, path, n_docs, n_tokens, base
    (ids in the files before it). Each task writes under a name of its own and
    the manifest lists those that succeeded, so lost executors do no harm.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sequences")
    ref = spark.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ref.value)
        kind = pa.uint16() if max(own.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else pa.uint32()
        system, top = file_system(folder)
        system.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        end, starts, sizes, ids, n = np.array([end_id], np.uint32), [], [], [], 0
        sink = writer = None
        for b in batches:
            if writer is None:
                sink = system.open_output_stream(f"{top}/{name}.arrow")
                writer = SequenceWriter(sink, length, rows, kind)
            ids.append(b.column("doc_id"))
            for got in own.encode(texts_of(b)):
                writer.add(np.concatenate([got, end]))
                starts.append(n)
                sizes.append(len(got) + 1)
                n += len(got) + 1
        if writer is None:
            return
        writer.close()
        sink.close()
        table = pa.table({"doc_id": pa.chunked_array(ids), "start": pa.array(starts, pa.int64()), "n": pa.array(sizes, pa.int64())})
        with system.open_output_stream(f"{top}/{name}.index.arrow") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table, max_chunksize=1 << 16)
        yield pa.record_batch({"shard": pa.array([task.partitionId()], pa.int64()), "path": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([len(starts)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    placed = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(placed.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                sequences = SequenceFile(f"{path}.arrow")
                system, at = file_system(f"{path}.index.arrow")
                with system.open_input_file(at) as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        start, n = part.column("start").to_numpy(), part.column("n").to_numpy()
                        crc = [zlib.crc32(sequences.ids(s, m).astype("<u4").tobytes()) for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                        yield pa.record_batch({"doc_id": part.column("doc_id"), "start": pa.array(start + base, pa.int64()), "n_tokens": part.column("n"), "ids_crc32": pa.array(crc, pa.int64())})

    n = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(n, 1), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, definition: str, end_id: int = 2, length: int = SEQUENCE) -> DataFrame:
    """Write the sequences and return what the files hold per document, in ascending doc_id order.

    A null text is empty (only the end id), null ids come first, rows with the
    same id are ordered by text and each keeps its own entry; an empty table
    writes no file and gives an empty result. Other columns are ignored.
    """
    return read_back(write_sequences(docs, definition, end_id, length))
