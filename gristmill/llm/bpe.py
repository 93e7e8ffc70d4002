"""Byte-level BPE by a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of a text exactly if each neighbouring
pair encodes to itself, so every prefix has one last token. The
nondeterministic machine starts a thread in the vocabulary's trie before each
byte and may end a token wherever the pair with the token before the thread
holds. Subset states (the trie nodes of the live threads) are determinised on
demand and kept; registers hold the last token at each open position. What
all threads agree on is emitted, so lookahead is bounded by the block and the
longest token.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

ROOT, NONE = 0, -1
#: Bounds of what a worker keeps; when one is reached, that cache starts anew.
MAX_PIECES, MAX_PAIRS, MAX_STATES = 400_000, 500_000, 100_000
#: Bytes of a piece after which the agreed tokens are emitted.
BLOCK = 4096


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from a .tiktoken file's content."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


class Transducer:
    """Encode one piece (a match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int], block: int = BLOCK):
        self.ranks, self.block = ranks, block
        self.step_to: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.depth = [0]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                nxt = self.step_to.get(key)
                if nxt is None:
                    nxt = self.step_to[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.ends: list[list[tuple[int, int]]] = []
        self.moves: dict[int, int] = {}
        self._state(())

    def _restart(self, state: int) -> int:
        """Forget all states but one; its new number."""
        nodes = self.states[state]
        for kept in (self.states, self.number, self.ends, self.moves):
            kept.clear()
        self._state(())
        return self._state(nodes)

    def _state(self, nodes: tuple[int, ...]) -> int:
        """The number of a subset state; its tokens that may end now, with their lengths."""
        at = self.number.get(nodes)
        if at is None:
            at = self.number[nodes] = len(self.states)
            self.states.append(nodes)
            self.ends.append([(self.token_at[n], self.depth[n]) for n in nodes if n in self.token_at])
        return at

    def _move(self, state: int, byte: int) -> int:
        """Determinise one transition: all threads step, and a thread starts at the root."""
        found = (self.step_to.get(node << 8 | byte) for node in (*self.states[state], ROOT))
        out = self.moves[state << 8 | byte] = self._state(tuple(n for n in found if n is not None))
        return out

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE, by the lowest rank first: the definition that pairs are judged by."""
        get, none = self.ranks.get, sys.maxsize
        cut, rank = list(range(len(data) + 1)), [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while rank and (low := min(rank)) != none:
            at = rank.index(low)
            del cut[at + 1], rank[at]
            if at < len(rank):
                rank[at] = get(data[cut[at] : cut[at + 2]], none)
            if at:
                rank[at - 1] = get(data[cut[at - 1] : cut[at + 1]], none)
        return [self.ranks[data[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def holds(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (or begin a piece)."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        want = [token] if last == NONE else [last, token]
        found = self.pairs[last << 32 | token] = self.merge(b"".join(self.bytes_of[t] for t in want)) == want
        return found

    def _chain(self, last: list[int], at: int) -> list[int]:
        """Tokens up to the open position ``at``, back to the last emission."""
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def _agreed(self, last: list[int], state: int) -> int:
        """The latest position that the histories of all live threads pass."""
        end = len(last) - 1
        ahead = {end} | {end - self.depth[n] for n in self.states[state]}
        while len(ahead) > 1:
            top = max(ahead)
            ahead = ahead - {top} | {top - len(self.bytes_of[last[top]])}
        return ahead.pop()

    def encode(self, piece: bytes) -> list[int]:
        state, out, last = 0, [], [NONE]
        moves, ends, pairs = self.moves, self.ends, self.pairs
        if len(moves) > 4 * MAX_STATES or len(ends) > MAX_STATES:
            self._restart(0)
        for byte in piece:
            nxt = moves.get(state << 8 | byte)
            state = self._move(state, byte) if nxt is None else nxt
            for token, n in ends[state]:
                before = last[-n]
                ok = pairs.get(before << 32 | token)
                if self.holds(before, token) if ok is None else ok:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary can't encode a byte of the text")
            if len(last) > self.block and (at := self._agreed(last, state)) > 0:
                out += self._chain(last, at)
                last = last[at:]
                if len(moves) > 4 * MAX_STATES or len(ends) > MAX_STATES:
                    state = self._restart(state)
        return out + self._chain(last, len(last) - 1)


class Utf8Stream:
    """Incremental decoder: a state is (bytes still due, lowest and highest next byte, bits so far).

    ``feed`` takes any cut of the byte stream; an ill-formed byte gives U+FFFD
    and is read again as a first byte, as the Unicode standard recommends.
    """

    START = (0, 0, 0, 0)

    def __init__(self):
        self.state = self.START

    @staticmethod
    def step(state: tuple, byte: int) -> tuple[tuple, str]:
        due, low, high, bits = state
        text = ""
        if due:
            if low <= byte <= high:
                bits = bits << 6 | byte & 63
                return ((due - 1, 0x80, 0xBF, bits), "") if due > 1 else (Utf8Stream.START, chr(bits))
            text = "�"
        if byte < 0x80:
            return Utf8Stream.START, text + chr(byte)
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF, byte & 31), text
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF, byte & 15), text
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF, byte & 7), text
        return Utf8Stream.START, text + "�"

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            self.state, piece = self.step(self.state, byte)
            out.append(piece)
        return "".join(out)

    def close(self) -> str:
        cut, self.state = self.state != self.START, self.START
        return "�" if cut else ""


class TokenDecoder:
    """Ids to text through the byte machine, without a loop over most tokens.

    A table made by the machine tells which tokens, read from its first state,
    are emitted as they are and leave it there; their bytes are gathered in
    one step. Runs of other tokens go through the machine byte by byte.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        top = max(bytes_of) + 1
        self.bytes_of = bytes_of
        self.size, self.chars, self.closed = np.zeros(top, np.int64), np.zeros(top, np.int64), np.zeros(top, bool)
        for i, t in bytes_of.items():
            machine = Utf8Stream()
            text = machine.feed(t) + machine.close()
            self.size[i], self.chars[i], self.closed[i] = len(t), len(text), text.encode() == t
        self.flat = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    def _gather(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[ids] - ends + size, size) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> tuple[bytes, int]:
        """What the machine emits, as UTF-8 (ill-formed parts are U+FFFD), and its code points."""
        closed = self.closed[ids]
        if closed.all():
            return self._gather(ids), int(self.chars[ids].sum())
        out, n, machine = [], 0, Utf8Stream()
        edge = np.flatnonzero(np.diff(closed, prepend=~closed[:1]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
            if closed[a]:
                text = machine.close()
                out += [text.encode(), self._gather(ids[a:b])]
                n += len(text) + int(self.chars[ids[a:b]].sum())
            else:
                text = "".join(machine.feed(self.bytes_of[i]) for i in ids[a:b].tolist())
                out.append(text.encode())
                n += len(text)
        text = machine.close()
        return b"".join([*out, text.encode()]), n + len(text)


class Codec:
    """Whole texts: split by the pattern, encode each piece, remember short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.machine, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.decoder = TokenDecoder(self.machine.bytes_of)
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        found, pieces, long = self.find(text), self.pieces, {}
        new = set(found).difference(pieces)
        if len(pieces) + len(new) > MAX_PIECES:
            pieces.clear()
            new = set(found)
        for piece in new:
            ids = array("I", self.machine.encode(piece.encode())).tobytes()
            if len(piece) <= 64 and len(pieces) < MAX_PIECES:
                pieces[piece] = ids
            else:
                long[piece] = ids
        if long:
            return np.frombuffer(b"".join([long[p] if p in long else pieces[p] for p in found]), np.uint32)
        return np.frombuffer(b"".join(map(pieces.__getitem__, found)), np.uint32)


_codecs: dict[tuple, Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(content), pattern)
    return _codecs[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long"


def bpe_round_trip(docs: DataFrame, content: bytes, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids.

    ``content`` is a rank file (broadcast; about 1 MB). One row per row of
    ``docs``: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit),
    decoded_sha256 and n_chars (bytes and code points that the streaming decoder emits), and with
    ``keep_ids`` the ids. A null text counts as empty: no tokens. Repeated rows
    and null ids pass through; an empty table gives an empty result.
    """
    ref = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ref.value, pattern)
        for b in batches:
            n, ids_sha, out_sha, chars, kept = [], [], [], [], []
            for text in b.column("text").to_pylist():
                ids = own.encode(text)
                out, count = own.decoder.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out_sha.append(hashlib.sha256(out).hexdigest())
                chars.append(count)
                if keep_ids:
                    kept.append(ids.astype(np.int64))
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(out_sha, pa.string()), "n_chars": pa.array(chars, pa.int64())}
            if keep_ids:
                cols["ids"] = pa.array(kept, pa.list_(pa.int64()))
            yield pa.record_batch(cols)

    return id_text(docs).mapInArrow(run, SCHEMA + (", ids array<long>" if keep_ids else ""))
