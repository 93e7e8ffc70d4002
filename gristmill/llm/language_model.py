"""Scores of a gated recurrent language model over words.

Counts of all training tokens give the base score, and the model's output
biases. The network (one GRU layer) is trained in numpy by truncated
backpropagation on all training texts: each task goes once over its own, and
the tasks' weights are averaged, weighted by tokens, after each round. The
output softmax is factored: a class first, then the word in the class. One
class stands for the words beyond the vocabulary; there the share of a word
follows its count, so each token of each text has a probability. Scoring
keeps the state across windows, from a text's first token to its end.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, texts_of, written

END = b""
#: Sizes of the layers, and words with a row in the network: classes of 16, of 32, then of 64 words, by falling count.
EMBEDDING, HIDDEN, VOCABULARY = 16, 16, 1024
#: Words whose counts travel to the workers (about 4 MB); others are joined.
HEAD = 1 << 17
#: Training: rounds (each text is in one of them), lanes, steps of a window, tokens laid out at once, tokens a task should have at least.
ROUNDS, LANES, WINDOW, TRAIN_TOKENS, SHARD_TOKENS = 2, 128, 32, 1 << 19, 1 << 20
#: Steps that the tokens laid out at once should give.
STEPS = 64
#: Windows that are laid out together.
WINDOWS = 16
#: Blocks in which weights travel, and parts in which a block is summed first.
BLOCKS, PARTS = 16, 8
SCORE_LANES, SCORE_WINDOW, SCORE_TOKENS = 128, 64, 1 << 20


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end."""
    out = text.lower().split()
    out.append(END)
    return out


def token_counts(rows: DataFrame) -> DataFrame:
    """word (binary, empty for the end) and c: how often each occurs in ``rows.text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})

        for b in batches:
            for t in texts_of(b):
                held.update(tokens_of(t))
            if len(held) > 200_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_threshold(counts: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` words have it or more.

    Counts are binned (exactly up to 1024, then 64 bins a doubling), so what
    comes to the driver is a few thousand rows at any size of the corpus.
    """
    fine = F.col("c") <= 1024
    bins = counts.groupBy(F.when(fine, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 384).alias("bin")).agg(F.min("c").alias("low"), F.count(F.lit(1)).alias("n"))
    taken, low = 0, 1 << 62
    for r in sorted(bins.collect(), key=lambda r: -r.low):
        taken += r.n
        if taken > head:
            break
        low = r.low
    return low


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_total(x: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials of each column."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def class_bounds(v: int) -> list[int]:
    """Where classes of words start, and the end: frequent words lie in small classes, so most softmaxes are short."""
    out = [0]
    while out[-1] < v:
        out.append(min(v, out[-1] + (16 if len(out) <= 2 else 32 if len(out) <= 5 else 64)))
    return out


class GatedModel:
    """GRU over word numbers: 0 ... v-1 the vocabulary by falling count, v the words beyond it, v+1 the start."""

    def __init__(self, counts: np.ndarray, beyond: float, seed: int = 11, bounds: list[int] | None = None, embedding: int = EMBEDDING, hidden: int = HIDDEN):
        self.v, self.hidden = len(counts), hidden
        self.bounds = class_bounds(self.v) if bounds is None else bounds
        self.classes = len(self.bounds) - 1
        self.kinds = np.append(np.repeat(np.arange(self.classes), np.diff(self.bounds)), self.classes)
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        weight = np.asarray(counts, np.float64) + 0.5
        mass = np.append(np.add.reduceat(weight, self.bounds[:-1]) if self.v else [], beyond + 0.5)
        self.p = {
            "embed": draw(self.v + 2, embedding, scale=0.1),
            "wx": draw(embedding, 3 * hidden, scale=embedding**-0.5), "wh": draw(hidden, 3 * hidden, scale=hidden**-0.5), "b": np.zeros(3 * hidden, np.float32),
            "class_w": np.zeros((hidden, self.classes + 1), np.float32), "class_b": np.log(mass / mass.sum()).astype(np.float32),
            "word_w": np.zeros((self.v, hidden), np.float32), "word_b": np.log(weight).astype(np.float32),
        }

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def with_weights(self, flat: np.ndarray) -> None:
        """Take the weights from one array, as views of it."""
        flat, at = np.ascontiguousarray(flat, np.float32), 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    # Arrays have units first and lanes (or tokens) last, so that each operation runs along many tokens.

    def steps(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (units, steps, lanes) after each of the inputs (steps, lanes), and the last; a fresh lane starts from zero."""
        p, n = self.p, self.hidden
        x = np.ascontiguousarray(np.take((p["embed"] @ p["wx"] + p["b"]).T, inputs, axis=1).transpose(1, 0, 2))
        turned, states, starts = np.ascontiguousarray(p["wh"].T), np.empty((len(inputs), n, inputs.shape[1]), p["wx"].dtype), fresh.any(axis=1).tolist()
        for t in range(len(inputs)):
            if starts[t]:
                h = h * ~fresh[t]
            s = turned @ h
            zr, c = x[t, : 2 * n], x[t, 2 * n :]
            zr += s[: 2 * n]
            z, r = sigmoid(zr)[:n], zr[n:]
            c += r * s[2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, c, s[2 * n :]))
            h = h - c
            h *= z
            h += c
            states[t] = h
        return np.ascontiguousarray(states.transpose(1, 0, 2)), h

    def _by_class(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order that puts targets of one class side by side, their classes, and where each class starts."""
        kind = self.kinds[targets]
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        return order, kind, np.searchsorted(kind, np.arange(self.classes + 1))

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, from states (units, tokens); of v, that of the class of words beyond."""
        order, kind, edge = self._by_class(targets)
        states, targets = states[:, order], targets[order]
        x = self.p["class_w"].T @ states + self.p["class_b"][:, None]
        got = x[kind, np.arange(len(kind))] - log_total(x)
        for k in range(self.classes):
            a, b = edge[k], edge[k + 1]
            if a < b:
                low, high = self.bounds[k], self.bounds[k + 1]
                x = self.p["word_w"][low:high] @ states[:, a:b] + self.p["word_b"][low:high, None]
                got[a:b] += x[targets[a:b] - low, np.arange(b - a)] - log_total(x)
        out = np.empty(len(order))
        out[order] = got
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Backpropagation through one window; the state (units, lanes) it starts from is taken as given."""
        p, n, keep = self.p, self.hidden, []
        states, last = self.steps(inputs, fresh, h, keep)
        order, kind, edge = self._by_class(targets.ravel())
        flat, want, w = states.reshape(n, -1)[:, order], targets.ravel()[order], real.ravel()[order].astype(p["wx"].dtype)
        w /= max(1.0, w.sum())
        g = {k: np.zeros_like(x) for k, x in p.items()}

        def softmax(x: np.ndarray, own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
            """The gradient at the logits, and the loss."""
            x -= x.max(axis=0)
            at = np.arange(x.shape[1])
            picked = x[own, at]
            np.exp(x, out=x)
            total = x.sum(axis=0)
            x *= weight / total
            x[own, at] -= weight
            return x, float(((np.log(total) - picked) * weight).sum())

        d, loss = softmax(p["class_w"].T @ flat + p["class_b"][:, None], kind, w)
        g["class_w"], g["class_b"] = flat @ d.T, d.sum(axis=1)
        back = p["class_w"] @ d
        for k in range(self.classes):
            a, b = edge[k], edge[k + 1]
            if a < b:
                low, high = self.bounds[k], self.bounds[k + 1]
                d, more = softmax(p["word_w"][low:high] @ flat[:, a:b] + p["word_b"][low:high, None], want[a:b] - low, w[a:b])
                loss += more
                g["word_w"][low:high], g["word_b"][low:high] = d @ flat[:, a:b].T, d.sum(axis=1)
                back[:, a:b] += p["word_w"][low:high].T @ d
        unsorted = np.empty_like(back)
        unsorted[:, order] = back
        back = np.ascontiguousarray(unsorted.reshape(states.shape).transpose(1, 0, 2))
        dx = np.empty((len(inputs), 3 * n, inputs.shape[1]), p["wx"].dtype)
        y, dh, wh, starts = np.empty_like(dx[0]), np.zeros_like(h), p["wh"], fresh.any(axis=1).tolist()
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, c, s = keep[t]
            dh += back[t]
            x = dx[t]
            dz, dr, dc = x[:n], x[n : 2 * n], x[2 * n :]
            np.subtract(before, c, out=dz)
            dz *= dh
            dz *= z
            np.subtract(1, z, out=z)
            dz *= z
            np.multiply(dh, z, out=dc)
            dh -= dc  # dh times z
            np.multiply(c, c, out=c)
            dc *= np.subtract(1, c, out=c)
            np.multiply(dc, s, out=dr)
            dr *= r
            dr *= 1 - r
            y[: 2 * n] = x[: 2 * n]
            np.multiply(dc, r, out=y[2 * n :])
            g["wh"] += before @ y.T
            dh += wh @ y
            if starts[t]:
                dh *= ~fresh[t]
        # the gradient at each word's row of embed @ wx, then at both factors
        rows, flat_dx = inputs.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * n)
        order = np.argsort(rows, kind="stable")
        start = np.flatnonzero(np.diff(rows[order], prepend=-1))
        words, sums = rows[order][start], np.add.reduceat(flat_dx[order], start, axis=0)
        g["wx"], g["b"] = p["embed"][words].T @ sums, sums.sum(axis=0)
        g["embed"][words] = sums @ p["wx"].T
        return g, last, loss

    def fit(self, texts: list[np.ndarray], lanes: int = LANES, window: int = WINDOW, rate: float = 0.01, state: dict | None = None) -> float:
        """Adam over the windows of one pass over the texts; the mean loss. ``state`` carries on from the call before."""
        state = {} if state is None else state
        if not state:
            state |= {"step": 0, "first": np.zeros(sum(x.size for x in self.p.values()), np.float32), "second": np.zeros(sum(x.size for x in self.p.values()), np.float32)}
        total, n = 0.0, 0
        flat = self.weights()
        self.with_weights(flat)
        # few tokens go in few lanes, so that there are some dozens of steps
        lanes = max(1, min(lanes, len(texts), max(8, sum(map(len, texts)) // (window * STEPS))))
        for inputs, targets, fresh, real, _, h in windows(texts, self.v + 1, lanes, window, self.hidden):
            g, h[:], loss = self.gradients(inputs, targets, fresh, real, h)
            g = np.concatenate([g[k].ravel() for k in self.p])
            state["step"] += 1
            g *= min(1.0, 1 / (math.sqrt(float(g @ g)) + 1e-9))
            state["first"] += 0.1 * (g - state["first"])
            state["second"] += 0.001 * (g * g - state["second"])
            # windows with few lanes left, at the end of the longest texts, move the weights less
            pace = rate * real.sum() / (lanes * window) * math.sqrt(1 - 0.999 ** state["step"]) / (1 - 0.9 ** state["step"])
            flat -= (pace * state["first"] / (np.sqrt(state["second"]) + 1e-8)).astype(np.float32)
            total, n = total + loss * int(real.sum()), n + int(real.sum())
        return total / max(1, n)

    def score(self, texts: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
        """Natural log probability of each whole text."""
        out = np.zeros(len(texts))
        for inputs, targets, fresh, real, owner, h in windows(texts, self.v + 1, lanes, window, self.hidden):
            states, h[:] = self.steps(inputs, fresh, h)
            states = states.reshape(self.hidden, -1)
            got = self.log_probs(states if real.all() else states[:, real.ravel()], targets[real])
            out += np.bincount(owner[real], got, len(texts))
        return out


def windows(texts: list[np.ndarray], start: int, lanes: int, window: int, hidden: int) -> Iterator[tuple]:
    """Lay texts end to end in lanes of even length and cut these into windows.

    Yields inputs, targets, fresh, real, owner (all steps x lanes) and the
    state of the lanes (units x lanes), which the caller replaces in place; lanes that have
    ended leave the window, so a long text doesn't drag the others along.
    """
    lanes = max(1, min(lanes, len(texts)))
    loads, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        n, k = heapq.heappop(loads)
        dealt[k].append(i)
        heapq.heappush(loads, (n + len(texts[i]), k))
    dealt.sort(key=lambda d: -sum(len(texts[i]) for i in d))
    lengths = np.array([sum(len(texts[i]) for i in d) for d in dealt])
    targets = [np.concatenate([texts[i] for i in d]) if d else np.empty(0, np.int64) for d in dealt]
    owner = [np.repeat(d, [len(texts[i]) for i in d]) for d in dealt]
    fresh = [np.concatenate([np.arange(len(texts[i])) == 0 for i in d]) if d else np.empty(0, bool) for d in dealt]
    h = np.zeros((hidden, lanes), np.float32)
    for first in range(0, int(lengths.max(initial=0)), window * WINDOWS):
        live, span = int((lengths > first).sum()), min(window * WINDOWS, int(lengths[0]) - first)
        t, o, x = np.zeros((live, span), np.int64), np.zeros((live, span), np.int64), np.full((live, span), start, np.int64)
        f, real = np.zeros((live, span), bool), np.zeros((live, span), bool)
        for k in range(live):
            own = slice(first, first + min(span, int(lengths[k]) - first))
            n = own.stop - first
            t[k, :n], o[k, :n], f[k, :n], real[k, :n] = targets[k][own], owner[k][own], fresh[k][own], True
            x[k, 1:n] = t[k, : n - 1]
            if first:
                x[k, 0] = targets[k][first - 1]
        x[f] = start
        for at in range(0, span, window):
            own, now = slice(at, min(span, at + window)), int((lengths > first + at).sum())
            yield *(np.ascontiguousarray(a[:now, own].T) for a in (x, t, f, real, o)), h[:, :now]


def fitted(train: DataFrame, model: GatedModel, words: list[bytes], tokens: int, rounds: int = ROUNDS) -> int:
    """Train ``model`` on every text of ``train.text``; the number of tokens it was trained on.

    In each round every task trains a copy of the network on its texts of the
    round (dealt out by a hash of the text), one after the other, and hands on
    its weights times its tokens, in blocks. Blocks are summed in parts; the
    driver gets one row a block and part and averages them.
    """
    spark, seen = train.sparkSession, 0
    shards = max(spark.sparkContext.defaultParallelism, tokens // SHARD_TOKENS)
    for turn in range(rounds):
        ref = spark.sparkContext.broadcast((model, words))

        def run(batches: Iterator[pa.RecordBatch], ref=ref, rate: float = 0.01 / (1 + turn)) -> Iterator[pa.RecordBatch]:
            net, words = ref.value
            net = copy.deepcopy(net)
            number, state, held, size, n = {w: i for i, w in enumerate(words)}, {}, [], 0, 0
            for b in batches:
                for t in texts_of(b):
                    tokens = tokens_of(t)
                    held.append(np.fromiter(map(number.get, tokens, repeat(net.v)), np.int64, len(tokens)))
                    size += len(held[-1])
                    if size >= TRAIN_TOKENS:
                        net.fit(held, rate=rate, state=state)
                        held, size, n = [], 0, n + size
            if held:
                net.fit(held, rate=rate, state=state)
            n += size
            if n:
                part = TaskContext.get().partitionId() % PARTS
                for i, x in enumerate(np.array_split(net.weights().astype(np.float64) * n, BLOCKS)):
                    yield pa.record_batch({"block": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([x.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for b in batches:
                for r in b.to_pylist():
                    x = np.frombuffer(r["weights"], np.float64)
                    own = sums.setdefault((r["block"], r["part"]), [0, np.zeros(len(x))])
                    own[0] += r["n"]
                    own[1] += x
            for (block, part), (n, x) in sums.items():
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([x.tobytes()], pa.binary())})

        kinds = "block int, part int, n long, weights binary"
        texts = train.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).select("text")
        got = texts.coalesce(shards).mapInArrow(run, kinds).repartition(BLOCKS, "block", "part").mapInArrow(add, kinds).toArrow().to_pylist()
        ref.unpersist()
        if got:
            n = sum(r["n"] for r in got if r["block"] == 0)
            blocks = [sum(np.frombuffer(r["weights"], np.float64) for r in sorted(got, key=lambda r: r["part"]) if r["block"] == i) for i in range(BLOCKS)]
            model.with_weights(np.concatenate(blocks) / n)
            seen += n
    return seen


def language_model_scores(docs: DataFrame, held_out: Column | None = None, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` needs doc_id and text; other columns are ignored. All texts that
    aren't held out (by default crc32 of the id as text, modulo 5, is 1; a null
    id isn't held out) are counted, and the network is trained on all of them,
    in ``rounds`` parts. Its weights depend on how the rows lie in partitions.
    A null text is empty: its only token is the end. Without training tokens all
    counts are 0 and base scores 0; repeated rows pass through; an empty table
    gives an empty result. Scores are log10.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    held_out = F.coalesce(crc_mod(docs["doc_id"], 5) == 1, F.lit(False)) if held_out is None else held_out
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), held_out.alias("held_out"))
    train = rows.where(~F.col("held_out"))

    counts = written(token_counts(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where((F.col("c") >= head_threshold(counts, head)) | (F.col("word") == F.lit(bytearray(END)))).toArrow()
    ranked = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    v = min(len(ranked), VOCABULARY)
    at = next((i for i, x in enumerate(ranked) if x[1] == END), 0)
    if ranked and at >= v:  # the end is always of the vocabulary
        ranked.insert(v - 1, ranked.pop(at))
    words, c = [w for _, w in ranked], np.array([n for n, _ in ranked], np.int64)
    beyond, kinds = total - int(c[:v].sum()), distinct - v
    model = GatedModel(c[:v], beyond)
    if total:
        fitted(train, model, words[:v], int(total), rounds)

    ref = spark.sparkContext.broadcast((words, c, model, v))
    base_all, base_beyond = math.log10(total + 0.5 * (distinct + 1)), math.log10(beyond + 0.5 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, net, v = ref.value
        number = {w: i for i, w in enumerate(words)}
        logs = np.log10(c + 0.5)
        part, seq = TaskContext.get().partitionId(), 0
        ids, out, held, texts, rare, size = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            lines, known, n, beyond_n = [], [], [], []
            for x in texts:
                inside = x[x < len(words)]
                lines.append(float(logs[inside].sum()) - base_all * len(inside))
                n.append(len(x))
                known.append(len(inside))
                beyond_n.append(float(logs[inside[inside >= v]].sum()) - base_beyond * int((inside >= v).sum()))
            scores = net.score([np.minimum(x, v) for x in texts]) / math.log(10) + np.array(beyond_n)
            keys = pa.array(np.arange(seq, seq + len(texts)) + (part << 36), pa.int64())
            seq += len(texts)
            return pa.record_batch({"key": keys, "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out, pa.bool_()), "n_tokens": pa.array(n, pa.int64()), "n_head": pa.array(known, pa.int64()), "base": pa.array(lines, pa.float64()), "gated": pa.array(scores, pa.float64()),
                                    "rare": pa.array([list(r) for r in rare], pa.list_(pa.binary())), "times": pa.array([list(r.values()) for r in rare], pa.list_(pa.int32()))})

        for b in batches:
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), texts_of(b), strict=True):
                tokens = tokens_of(t)
                x = np.fromiter(map(number.get, tokens, repeat(-1)), np.int64, len(tokens))
                miss = np.flatnonzero(x < 0)
                rare.append(Counter([tokens[k] for k in miss.tolist()]))
                x[miss] = len(words)
                ids.append(i), out.append(h), texts.append(x)
                size += len(x)
                if size >= SCORE_TOKENS:
                    yield flush()
                    ids, out, held, texts, rare, size = [], [], [], [], [], 0
        if texts:
            yield flush()

    scored = written(rows.select("doc_id", "held_out", "text").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, gated double, rare array<binary>, times array<int>"), "scored")
    seen = scored.where(F.size("rare") > 0).select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    met = seen.join(counts, "word", "left").select("key", "n", F.coalesce("c", F.lit(0)).alias("c"))
    rest = met.groupBy("key").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("line"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    n_rare, line = F.coalesce("n_rare", F.lit(0)), F.coalesce("line", F.lit(0.0))
    return scored.drop("rare", "times").join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + line - n_rare * base_all).alias("base_score"), (F.col("gated") + line - n_rare * base_beyond).alias("score"))
