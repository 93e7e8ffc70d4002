"""Benchmark decontamination by the q-gram lemma.

If a benchmark item of m characters occurs in a text with at most k edits,
the two share at least m + 1 - q - kq of the item's q-grams on diagonals that
lie within k of each other. So q-grams shared with the items are counted in
overlapping diagonal bands; regions that meet the bound are verified by a
banded alignment, all regions of a text in step. A window count of the text's
own q-grams that any item has goes first: text without enough of them can't
hold an item. Items too short for the bound at q have shorter q-grams.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, IS_SPACE, id_text, texts_of, written

Q, EDIT_RATE = 8, 0.08
#: Items whose lengths differ by less than this factor share a window.
CLASS_RATIO = 1.25
#: Items a block holds; the texts pass once for each block of items.
ITEM_BYTES = 16 << 20
#: Shared q-grams counted at once, and cells of alignments that go in step.
HITS, CELLS = 1 << 21, 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def squeezed(text: bytes) -> np.ndarray:
    """Lower-case A-Z bytes, each run of ASCII white space one space, none at the ends."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    gap = IS_SPACE[raw]
    raw[gap] = 32
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    raw = raw[keep]
    a, b = int(len(raw) > 0 and raw[0] == 32), len(raw)
    return raw[a : b - 1] if b > a and raw[-1] == 32 else raw[a:]


def q_grams(raw: np.ndarray, q: int) -> np.ndarray:
    n = len(raw) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if q == 8:  # eight bytes are the number itself
        out = np.zeros(n, np.uint64)
        for i in range(8):
            out |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        return out
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = out * BASE + raw[i : i + n].astype(np.uint64)
    return out


def allowed(m: int, rate: float = EDIT_RATE) -> int:
    return int(m * rate)


def needed(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    return m + 1 - q - allowed(m, rate) * q


def gram_length(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """The longest q-gram, at most q, of which an item of m bytes must share one at least."""
    return max(1, min(q, m // (allowed(m, rate) + 1)))


class ItemIndex:
    """A block of items, indexed by q-grams of the length that each allows."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, rate: float = EDIT_RATE):
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in items:
            raw = squeezed(t)
            if len(raw):
                by_length.setdefault(gram_length(len(raw), q, rate), []).append((i, raw))
        self.parts = [GramIndex(some, n, rate) for n, some in sorted(by_length.items())]

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each item's occurrences in the squeezed text, best of each region."""
        raw = squeezed(text)
        return best_of([x for part in self.parts for x in part.find(raw)])


class GramIndex:
    """The q-grams of items, sorted, with a bit table in front."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.q = q
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        grams = [q_grams(t, q) for t in self.texts]
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.array([allowed(len(t), rate) for t in self.texts], np.int64)
        self.need = np.array([needed(len(t), q, rate) for t in self.texts], np.int64)
        flat = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(flat, kind="stable")
        flat, self.item, self.place = flat[order], item[order], place[order]
        # distinct q-grams; the postings of one are sorted by item
        self.gram, first = np.unique(flat, return_index=True)
        self.post = np.repeat(np.arange(len(self.gram)), np.diff(np.append(first, len(flat)))) << 32 | self.item
        # classes of items of like length; an item with its edits covers at most m + k bytes of the
        # text and has at least ``need`` of its q-grams there, so each class has its own window count
        kind = np.floor(np.log(self.m) / np.log(CLASS_RATIO)).astype(np.int64)
        kinds, own = np.unique(kind, return_inverse=True)
        own = np.minimum(own, 31)
        self.classes = [(int((self.m + self.k)[own == c].max()), int(self.need[own == c].min())) for c in range(min(len(kinds), 32))]
        self.bits = np.zeros(1 << 20, np.uint32)
        np.bitwise_or.at(self.bits, self._slot(flat), np.uint32(1) << own[self.item].astype(np.uint32))
        self.window = max(w for w, _ in self.classes)

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        """A slot of the bit table: the top bits of a product."""
        return ((grams * BASE) >> np.uint64(44)).astype(np.int64)

    def _likely(self, grams: np.ndarray) -> np.ndarray:
        """Places of q-grams of items in windows with enough of them for some item of the class."""
        mask = self.bits[self._slot(grams)]
        keep = np.zeros(len(grams), bool)
        for c, (window, least) in enumerate(self.classes):
            hit = (mask & np.uint32(1 << c)) != 0
            total = np.zeros(len(grams) + 1, np.int32)
            np.cumsum(hit, out=total[1:])
            if total[-1] < least:
                continue
            w = min(window, len(grams))
            start = np.flatnonzero(total[w:] - total[:-w] >= least)
            if len(start):
                mark = np.zeros(len(grams) + 1, np.int32)
                mark[start] += 1
                mark[start + w] -= 1
                keep |= hit & (np.cumsum(mark[:-1]) > 0)
        return np.flatnonzero(keep)

    def find(self, raw: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits), some of them several times."""
        grams = q_grams(raw, self.q)
        at = self._likely(grams) if len(grams) else grams
        if not len(at):
            return []
        number = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        real = self.gram[number] == grams[at]
        at, number = at[real], number[real]
        out: list[tuple[int, int, int, int]] = []
        for first in range(0, len(at), 1 << 15):  # bounded: a part of the text ...
            pass_to = min(len(at), first + (1 << 15))
            a = max(0, int(np.searchsorted(at, at[first] - 2 * self.window)))
            places, own = at[a:pass_to], number[a:pass_to] << 32
            low, high = np.searchsorted(self.post, own), np.searchsorted(self.post, own + len(self.m))
            blocks = int((high - low).sum()) // HITS + 1
            for block in range(blocks):  # ... with a part of the items
                i, j = len(self.m) * block // blocks, len(self.m) * (block + 1) // blocks
                if blocks > 1:
                    low, high = np.searchsorted(self.post, own + i), np.searchsorted(self.post, own + j)
                out += self._regions(raw, places, low, high - low)
        return out

    def _regions(self, raw: np.ndarray, at: np.ndarray, low: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Count shared q-grams by item and overlapping diagonal band; verify bands that meet the bound."""
        total = int(size.sum())
        if not total:
            return []
        index = np.repeat(low - np.cumsum(size) + size, size) + np.arange(total)
        item, place = self.item[index], self.place[index]
        # cells are k+1 wide and two neighbours a band, so any k+1 neighbouring diagonals lie in one band
        cell = (np.repeat(at, size) - place) // (self.k[item] + 1)
        low_cell, width = int(cell.min()), int(cell.max() - cell.min()).bit_length() + 1
        bits = int(self.m.max()).bit_length()
        if width + bits + len(self.m).bit_length() > 62:
            raise ValueError("an item or a text is too long for one index")
        key = np.sort((item << width | (cell - low_cell)) << bits | place)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] >> bits  # each q-gram of the item once a cell
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        cells, counts = key[start], np.diff(np.append(start, len(key)))
        beside = np.concatenate((np.where(cells[1:] == cells[:-1] + 1, counts[1:], 0), [0]))
        own = cells >> width
        ok = counts + beside >= self.need[own]
        own, band = own[ok], ((cells[ok] & ((1 << width) - 1)) + low_cell) * (self.k[own[ok]] + 1)
        hit = self._within(raw, own, band)
        out = []
        for i, first in zip(own[hit].tolist(), band[hit].tolist(), strict=True):
            got = aligned(self.texts[i], raw, first, first + 2 * (int(self.k[i]) + 1) - 1, int(self.k[i]))
            if got:
                out.append((self.ids[i], *got))
        return out

    def _within(self, raw: np.ndarray, own: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which bands hold their item with at most k edits: the costs of ``aligned``, without its places, for many bands at once."""
        out = np.zeros(len(own), bool)
        for k in np.unique(self.k[own]).tolist():
            rows, width = np.flatnonzero(self.k[own] == k), 4 * k + 2
            rows = rows[np.argsort(self.m[own[rows]], kind="stable")]
            for at in range(0, len(rows), max(1, CELLS // width)):
                some = rows[at : at + max(1, CELLS // width)]
                out[some] = self._costs(raw, own[some], band[some] - k, k, width)
        return out

    def _costs(self, raw: np.ndarray, own: np.ndarray, left: np.ndarray, k: int, width: int) -> np.ndarray:
        columns, m = np.arange(width, dtype=np.int16)[:, None], self.m[own]
        top = int(m.max())
        pad = top + width + 1
        text = np.concatenate([np.full(pad, 256, np.int16), raw.astype(np.int16), np.full(pad + top + width, 256, np.int16)])
        some, row = np.unique(own, return_inverse=True)
        items = np.full((len(some), top), 257, np.int16)
        for at, i in enumerate(some.tolist()):
            items[at, : self.m[i]] = self.texts[i]
        live, out = np.arange(len(own)), np.zeros(len(own), bool)
        base = np.clip(left + pad, 0, len(text) - top - width)
        cost = np.zeros((width, len(own)), np.int16)
        for i in range(top):
            cost_up = cost[1:] + np.int16(1)
            cost = cost + (text[base[live] + i + columns] != items[row[live], i])
            np.minimum(cost[:-1], cost_up, out=cost[:-1])
            cost -= columns
            np.minimum.accumulate(cost, axis=0, out=cost)
            cost += columns
            ended = m[live] == i + 1
            if i % 8 == 7 or ended.any():
                good = cost.min(axis=0) <= k
                out[live[ended & good]] = True
                go_on = good & ~ended
                if not go_on.all():
                    live, cost = live[go_on], cost[:, go_on]
                    if not len(live):
                        break
        return out


def best_of(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of an item's overlapping finds the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (x[0], x[3], x[1], x[2])):
        if not any(y[0] == x[0] and y[1] < x[2] and x[1] < y[2] for y in out):
            out.append(x)
    return sorted(out)


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The best occurrence of the whole item on diagonals low-k ... high+k: (start, end, edits), if edits <= k.

    Edit distance with free ends in the text; cell c of row i is at text
    position i + low - k + c. Insertions along a row are a running minimum.
    """
    begin = max(0, low - k)
    verbatim = text[begin : high + k + len(item)].tobytes().find(item.tobytes())
    if verbatim >= 0:
        return begin + verbatim, begin + verbatim + len(item), 0
    left, width = low - k, high - low + 2 * k + 1
    columns = np.arange(width)
    big = 1 << 20
    place = left + columns
    cost = np.where((place >= 0) & (place <= len(text)), 0, big)
    begin = np.clip(place, 0, len(text))
    padded = np.concatenate([text.astype(np.int16), [-1]])
    for i, c in enumerate(item.tolist(), 1):
        place = i + left + columns
        inside = (place >= 1) & (place <= len(text))
        other = padded[np.where(inside, place - 1, len(text))]
        diag = cost + (other != c)
        up = np.concatenate([cost[1:], [big]]) + 1
        best, origin = np.where(inside, diag, big), begin
        better = up < best
        best = np.where(better, up, best)
        origin = np.where(better, np.concatenate([begin[1:], [0]]), origin)
        best = np.where((place >= 0) & (place <= len(text)), best, big)
        slide = best - columns
        low_so_far = np.minimum.accumulate(slide)
        source = np.maximum.accumulate(np.where(slide == low_so_far, columns, 0))
        cost, begin = np.minimum(low_so_far + columns, big), origin[source]
        if cost.min() > k:
            return None
    at = int(cost.argmin())
    return (int(begin[at]), len(item) + left + at, int(cost[at])) if cost[at] <= k else None


SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


_indexes: dict[str, ItemIndex] = {}


def index_of(name: str, items: list[tuple[int, bytes]], q: int, rate: float) -> ItemIndex:
    """The index of a block of items, built once a worker; only the latest is kept."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = ItemIndex(items, q, rate)
    return _indexes[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Where items occur: doc_id, item_id, start, end, edits, one row an occurrence.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored. Both are compared as bytes with A-Z lower-cased and white
    space squeezed; start and end count in that form. An item occurs where at
    most ``rate`` of its bytes are edits, so one of fewer than 1 / ``rate``
    bytes occurs verbatim, anywhere in a text. Null and empty texts never
    match; items with equal texts each match; repeated rows give repeated
    results, clean documents none. The items are broadcast in blocks of at most
    ``item_bytes``; more items cost more passes over the texts, no more memory.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.encode(benchmark["text"], "UTF-8").alias("text")).where("text IS NOT NULL AND length(text) > 0")
    rows, out = id_text(docs), None
    for block in item_blocks(items, item_bytes):
        ref, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], ref=ref, name=name) -> Iterator[pa.RecordBatch]:
            index = index_of(name, ref.value, q, rate)
            for b in batches:
                found = [(i, *x) for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True) for x in index.find(t)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, SCHEMA)
        if out is not None or sum(len(t) for _, t in block) >= item_bytes:  # one of several: done with its items before the next
            part = written(part, "leaks")
            ref.unpersist()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def item_blocks(items: DataFrame, item_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """All items in blocks of bounded size, without holding more than one on the driver."""
    block, n = [], 0
    for r in items.toLocalIterator():
        block.append((r.item_id, bytes(r.text)))
        n += len(r.text)
        if n >= item_bytes:
            yield block
            block, n = [], 0
    if block:
        yield block
