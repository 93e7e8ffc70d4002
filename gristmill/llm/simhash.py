"""SimHash near-dedup: fingerprints, a vantage-point forest, exact links, components.

Two fingerprints within 3 bits of each other are within 1 bit in their upper
or in their lower half (within 7: in one of four quarters, 9: of five fifths), and the Hamming
distance of such a piece is a metric too. So each piece has a vantage-point
tree that partitions by distance: a point's home is the shard on its path,
and it also visits each shard whose bound its ball of radius 1 crosses
(triangle inequality). A pair within reach thus
meets in the home shard of either point, where the whole fingerprints are
compared. A shard returns a spanning forest of its links, never all pairs.
Fingerprints that no distance of their piece tells apart, too many for one
shard, are dealt out again by parts of their other bits, one of which two
within reach have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, id_text, sifted, texts_of, word_hashes, word_spans, written
from .components import components

SHINGLE, BITS = 3, 3
#: Near copies by content: words of a run, the share of runs two texts have in common, and the fingerprints that propose them.
RUN, SAME, COPY_SHINGLE, COPY_BITS = 5, 0.8, 2, 9
#: Texts, and bytes of their runs, that one task compares with one another.
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20
#: Fingerprints a shard should hold at home, the tree's sample for each shard, and the bound of the sample.
LEAF, SAMPLE_A_LEAF, SAMPLE = 4096, 64, 1 << 20
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: bit i is set if more than half of the shingles' XXH64 have it."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([h(line[a:b], SEED) for a, b in spans], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, node (``node_of`` the row) and fp (the fingerprint as a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(b)], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "node": b.column("node"), "fp": pa.array(fp.view(np.int64))})

    own = id_text(docs)
    return own.withColumn("node", node_of(own)).mapInArrow(run, "doc_id long, node long, fp long")


def node_of(docs: DataFrame) -> Column:
    """A hash of id and text, which names a row where ids are null or repeat."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))


class VantageTree:
    """A tree over pieces of fingerprints. Nodes: vantage point, radius, inner child, outer child; leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 7):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.shards = 0
        self.hot: set[int] = set()
        self.leaf, self.random = leaf, np.random.default_rng(seed)
        self.root = self._build(sample)

    def _build(self, points: np.ndarray) -> int:
        """The node's number, or -1 - shard."""
        if len(points) > self.leaf:
            best = None
            for vantage in self.random.choice(points, 8):  # the one whose balanced split has the fewest points near its bound
                d = np.bitwise_count(points ^ vantage)
                for radius in np.unique(np.quantile(d, (0.35, 0.5, 0.65), method="lower")):
                    inner = int((d <= radius).sum())
                    if 0 < inner < len(points):
                        near = int(((d == radius) | (d == radius + 1)).sum())
                        cost = near + abs(2 * inner - len(points)) / 2
                        if best is None or cost < best[0]:
                            best = cost, vantage, int(radius), d
            if best is not None:
                at = len(self.nodes)
                self.nodes.append(())
                _, vantage, radius, d = best
                self.nodes[at] = int(vantage), radius, self._build(points[d <= radius]), self._build(points[d > radius])
                return at
        if len(points) > 2 * self.leaf:
            self.hot.add(self.shards)
        self.shards += 1
        return -self.shards

    def route(self, points: np.ndarray, reach: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indices of the points that live in or visit it, whether each is at home)."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            vantage, radius, inner, outer = self.nodes[node]
            d = np.bitwise_count(points[at] ^ np.uint32(vantage)).astype(np.int16)
            into = d <= radius + reach
            todo.append((inner, at[into], home[into] & (d[into] <= radius)))
            into = d > radius - reach
            todo.append((outer, at[into], home[into] & (d[into] > radius)))


def pieces(fp: np.ndarray, parts: int) -> list[np.ndarray]:
    """The fingerprints cut into ``parts`` runs of bits, as even as can be."""
    whole, cut = fp.view(np.uint64), [64 * i // parts for i in range(parts + 1)]
    return [((whole >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.uint32) for a, b in zip(cut, cut[1:], strict=False)]


def others(fp: np.ndarray, parts: int, part: int, bits: int) -> list[np.ndarray]:
    """The bits outside a piece cut into ``bits`` + 1 runs: of two fingerprints within ``bits`` at least one is equal."""
    low, high = 64 * part // parts, 64 * (part + 1) // parts
    whole = fp.view(np.uint64)
    rest = whole & np.uint64((1 << low) - 1)
    if high < 64:
        rest |= (whole >> np.uint64(high)) << np.uint64(low)
    n = 64 - (high - low)
    cut = [n * i // (bits + 1) for i in range(bits + 2)]
    return [(rest >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cut, cut[1:], strict=False)]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting those of a[i] and b[i]: each component gets its smallest."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def forest_of_links(fp: np.ndarray, home: np.ndarray, bits: int, parts: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links between home points and all points of a shard."""
    whole = fp.view(np.uint64)
    label = np.arange(len(fp))
    inside = np.flatnonzero(home)
    cells = [(0, np.arange(len(fp)), home)]
    if len(inside) > 512:  # the same partition again, within memory
        own = pieces(fp, parts)[part]
        tree = VantageTree(own[inside], 256)
        if tree.shards > 1:
            cells = tree.route(own)
    for _, at, near in cells:
        rows = at[near & home[at]]
        step = max(1, (1 << 20) // max(1, len(at)))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            r, c = np.nonzero(np.bitwise_count(whole[some, None] ^ whole[None, at]) <= bits)
            label = joined(label, some[r], at[c])
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def links(distinct: DataFrame, n: int, bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """Links (u, v) that connect all of ``distinct.fp`` within ``bits`` (at most 9) of each other.

    The trees grow from a sample of the fingerprints (by hash, about 64 a
    shard, at most 2**20). It decides only where shards end; every fingerprint
    is routed and every link within reach is found.
    """
    if not 0 <= bits <= 9:
        raise ValueError("fifths with reach 1 find links of at most 9 bits")
    parts = 2 if bits <= 3 else 4 if bits <= 7 else 5
    share = min(1.0, SAMPLE_A_LEAF / leaf, SAMPLE / max(n, 1))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < max(1, round(share * (1 << 20)))).select("fp").limit(SAMPLE).toArrow().column("fp").to_numpy()
    sample = np.sort(sample)
    trees = [VantageTree(x, max(1, round(leaf * share))) for x in pieces(sample, parts)]
    ref = distinct.sparkSession.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for part, (tree, points) in enumerate(zip(ref.value, pieces(fp, parts), strict=True)):
                for shard, at, home in tree.route(points):
                    key = shard * parts + part << 36
                    if shard not in tree.hot:
                        yield pa.record_batch({"shard": pa.array(np.full(len(at), key), pa.int64()), "fp": pa.array(fp[at]), "home": pa.array(home)})
                        continue
                    for j, value in enumerate(others(fp[at], parts, part, bits)):
                        yield pa.record_batch({"shard": pa.array(key + (j + 1 << 32) + value.astype(np.int64)), "fp": pa.array(fp[at]), "home": pa.array(home)})

    def meet(key, table):
        u, v = forest_of_links(table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False), bits, parts, (key[0].as_py() >> 36) % parts)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    dealt = distinct.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(meet, "u long, v long")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``docs`` needs doc_id and text; other columns are ignored. Words are
    separated by ASCII white space, A-Z lower-cased; a text of fewer than
    ``shingle`` words is one shingle, a text without words (null, empty) has
    fingerprint zero. Rows link when at most ``bits`` bits differ;
    component_id is the smallest doc_id reachable. Repeated rows are linked
    as equals; a null doc_id is never the smallest unless there is no other.
    An empty table gives an empty result.
    """
    own = written(fingerprints(docs, shingle).drop("node"), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    stars = components(links(distinct, distinct.count(), bits, leaf))
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(ids, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def runs_of(text: bytes, words: int = RUN) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run."""
    raw = np.frombuffer(text.lower(), np.uint8)
    own = word_hashes(raw, *word_spans(raw))
    return np.unique(gram_hashes(own, min(words, len(own))))


def copies(fp: np.ndarray, sets: list[np.ndarray], bits: int, same: float, known: np.ndarray | None = None, first: int | None = None) -> np.ndarray:
    """A label per text, the smallest index of those linked with it over any steps.

    Two texts link if they are at most ``bits`` bits apart and have a Jaccard
    similarity of ``same`` or more. ``known`` labels join what is linked already,
    and with ``first`` only pairs with one of the first so many texts count. A
    text is compared only with those its component lacks, so a group of copies
    takes about one comparison a text, not all pairs.
    """
    whole, label = fp.view(np.uint64), np.arange(len(fp)) if known is None else known.copy()
    size = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(size)
    code = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)[1]
    mark = np.zeros(int(code.max(initial=0)) + 1, bool)
    for i in range(min(len(fp) - 1, len(fp) if first is None else first)):
        n, rest = size[i], np.arange(i + 1, len(fp))
        rest = rest[(label[rest] != label[i]) & (np.minimum(size[rest], n) >= same * np.maximum(size[rest], n) - 1e-9) & (np.bitwise_count(whole[rest] ^ whole[i]) <= bits)]
        if not len(rest):
            continue
        mark[code[ends[i] - n : ends[i]]] = True
        met = []
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            if not n:  # no words in either
                met.append(some)
                continue
            both = np.add.reduceat(mark[np.concatenate([code[ends[k] - size[k] : ends[k]] for k in some])].astype(np.int64), np.cumsum(size[some]) - size[some])
            met.append(some[both >= same * (size[some] + n - both) - 1e-9])
        mark[code[ends[i] - n : ends[i]]] = False
        hit = np.concatenate(met)
        if len(hit):
            old = np.unique(label[np.append(hit, i)])
            label[np.isin(label, old)] = old[0]
    return label


CLASSES = "root long, doc_id long, node long, fp long, class long"


def classes_of_blocks(runs: DataFrame, turn: int, bits: int, same: float) -> DataFrame:
    """Rows of ``runs`` with the class they belong to within a block of their root: the node of its first row."""

    def label(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending"), ("node", "ascending")]))  # nulls come last
        found = copies(table.column("fp").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("runs").to_pylist()], bits, same)
        return table.select(["root", "doc_id", "node", "fp"]).append_column("class", pa.array(table.column("node").to_numpy()[found]))

    return in_blocks(runs, turn).groupBy("root", "block").applyInArrow(label, CLASSES)


def blocks_of(runs: DataFrame) -> DataFrame:
    """root, blocks: how many tasks share its rows."""
    return runs.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(F.length("runs")) / BLOCK_BYTES)).alias("blocks"))


def in_blocks(runs: DataFrame, turn: int) -> DataFrame:
    """``runs`` with a column block; few roots have more than one."""
    large = blocks_of(runs).where("blocks > 1")
    return runs.join(large, "root", "left").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), F.coalesce("blocks", F.lit(1))))


def class_links(members: DataFrame, bits: int, same: float) -> DataFrame:
    """Links (u, v) between the classes of a root, from exact comparisons of all pairs that could join two.

    The rows outside a root's largest class are the queries, in blocks, and
    meet all its rows, in blocks; each task gets two blocks and skips pairs of
    one class, or of classes it has joined.
    """
    sizes = members.groupBy("root", "class").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("root").agg(F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("root", F.col("top.class").alias("top"))
    own = written(members.join(top, "root").withColumn("asks", F.col("class") != F.col("top")).drop("top"), "members")
    n = blocks_of(own).select("root", F.col("blocks").alias("all_blocks")).join(blocks_of(own.where("asks")).select("root", F.col("blocks").alias("ask_blocks")), "root")
    every, deal = own.join(n, "root"), lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    kinds = ["root", "x", "y", "asked", "class", "fp", "runs"]
    queries = every.where("asks").withColumn("x", deal("ask_blocks")).withColumn("y", spread("all_blocks")).withColumn("asked", F.lit(False))
    rows = every.withColumn("y", deal("all_blocks")).withColumn("x", spread("ask_blocks")).withColumn("asked", F.lit(True))

    def meet(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("asked", "ascending"), ("class", "ascending")]))
        names, known = np.unique(table.column("class").to_numpy(), return_inverse=True)
        first = np.full(len(names), len(known))
        np.minimum.at(first, known, np.arange(len(known)))
        queries = len(known) - int(pa.compute.sum(table.column("asked")).as_py() or 0)
        label = copies(table.column("fp").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("runs").to_pylist()], bits, same, first[known], queries)
        u, v = names, names[known[label[first]]]
        return pa.table({"u": pa.array(u[u != v], pa.int64()), "v": pa.array(v[u != v], pa.int64())})

    return queries.select(kinds).unionByName(rows.select(kinds)).groupBy("root", "x", "y").applyInArrow(meet, "u long, v long")


def near_copies(docs: DataFrame, same: float = SAME, words: int = RUN, shingle: int = COPY_SHINGLE, bits: int = COPY_BITS, leaf: int = LEAF) -> DataFrame:
    """doc_id and node of the rows that go so that one row of each component of near copies stays.

    Rows link when their texts' sets of ``words``-word runs have an exact
    Jaccard similarity of ``same`` or more and their fingerprints differ in at
    most ``bits`` bits; the fingerprints only propose, the texts decide. The
    row with the smallest id stays (a null id last; then by node). Texts
    without words are equal; rows that repeat both id and text go or stay
    together. An empty table gives an empty result.

    Rows whose fingerprints hang together are compared in blocks of bounded
    size; classes of several blocks are joined by their first rows, and then
    by whatever link is left between their members.
    """
    own = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")), "distinct")
    stars = components(links(distinct, distinct.count(), bits, leaf)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    linked = stars.unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    wide = distinct.join(linked, "fp", "left").where("root IS NOT NULL OR rows > 1").select("fp", F.coalesce("root", "fp").alias("root"))
    asked = written(own.join(wide, "fp").select("node", "fp", "root").distinct(), "asked")
    texts = id_text(docs)
    texts = texts.withColumn("node", node_of(texts))
    texts = sifted(texts, texts["node"], asked.select("node"))[1].join(asked, "node").dropDuplicates(["node"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [runs_of(t, words).tobytes() for t in texts_of(b)]
            yield pa.record_batch({c: b.column(c) for c in ("root", "doc_id", "node", "fp")} | {"runs": pa.array(runs, pa.binary())})

    runs = written(texts.select("root", "doc_id", "node", "fp", "text").mapInArrow(cut, "root long, doc_id long, node long, fp long, runs binary"), "runs")
    for done in (own, distinct, asked):
        discard(done)
    local = written(classes_of_blocks(runs, 0, bits, same), "classes")
    large = written(blocks_of(runs).where("blocks > 1").select("root"), "large")
    gone = local.where("node <> class").select("doc_id", "node")
    if large.isEmpty():
        return gone
    members = written(runs.join(large, "root", "left_semi"), "large-rows")
    own = written(local.join(large, "root", "left_semi").select("node", "class"), "large-classes")
    edges = own.where("node <> class").select(F.col("node").alias("u"), F.col("class").alias("v"))
    firsts, n, turn = members.join(own.where("node = class").select("node"), "node", "left_semi"), own.where("node = class").count(), 0
    while True:  # the classes' first rows, as long as that joins half of them
        turn += 1
        again = written(classes_of_blocks(firsts, turn, bits, same), "firsts")
        edges = edges.unionByName(again.where("node <> class").select(F.col("node").alias("u"), F.col("class").alias("v")))
        left = again.where("node = class").select("node")
        before, n = n, left.count()
        if 2 * n > before:
            break
        firsts = members.join(left, "node", "left_semi")
    stars = components(edges)
    named = members.join(stars.select(F.col("u").alias("node"), F.col("v").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    edges = edges.unionByName(class_links(named, bits, same))
    final = members.select("node", "doc_id").join(components(edges).select(F.col("u").alias("node"), F.col("v").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    key = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    kept = final.groupBy("class").agg(F.min(key).alias("kept"))
    late = final.join(kept, "class").where(F.col("node") != F.col("kept.node")).select("doc_id", "node")
    return gone.join(members.select("node"), "node", "left_anti").select("doc_id", "node").unionByName(late)
