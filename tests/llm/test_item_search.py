"""The search for benchmark items against brute force over all items and texts, and many items from one template."""

import random
import time

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from gristmill.llm import decontaminate as d


def fewest_edits(item, text):
    """Of the item in any part of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    other, at = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        best = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (other != c))))
        row = np.minimum.accumulate(best - at) + at
    return int(row.min())


@pytest.mark.parametrize("alphabet,seed", [("abc ", 1), ("etaoin shrdlu", 2)])
def test_search_against_brute_force(alphabet, seed):
    r = random.Random(seed)
    draw = lambda n: "".join(r.choice(alphabet) for _ in range(n)).encode()
    items = [(i, draw(n)) for i, n in enumerate([*range(1, 41), 60, 75, 100, 130])]
    index = d.ItemIndex(items)
    texts = [b"", b"a", *(draw(r.randrange(5, 400)) for _ in range(40))]
    for k in range(60):  # texts with an edited copy of an item
        raw = bytearray(bytes(d.squeezed(items[k % len(items)][1])))
        for _ in range(r.randrange(d.allowed(len(raw)) + 2) if raw else 0):
            at = r.randrange(len(raw))
            raw[at : at + r.randrange(2)] = draw(r.randrange(2))
        texts.append(draw(50) + bytes(raw) + draw(30))
    n = 0
    for text in texts:
        raw, found = bytes(d.squeezed(text)), index.find(text)
        want = {i for i, t in items if (own := bytes(d.squeezed(t))) and fewest_edits(own, raw) <= d.allowed(len(own))}
        assert {x[0] for x in found} == want
        n += len(want)
        for i, start, end, edits in found:
            assert fewest_edits(bytes(d.squeezed(items[i][1])), raw[start:end]) <= edits <= d.allowed(len(bytes(d.squeezed(items[i][1]))))
    assert n > 150


def test_short_items_are_found_verbatim():
    items = [(n, bytes(range(97, 97 + n))) for n in range(1, 17)]
    assert [x[0] for x in d.ItemIndex(items).find(b"xx abcdefghijklmnop yy")] == list(range(1, 17))
    assert [x[0] for x in d.ItemIndex(items[6:]).find(b"xx abcdefg.ijklmno yy")] == [7, 13, 14, 15]  # from 13 bytes on one edit is allowed


def test_many_items_of_one_template():
    """5,000 items that differ in one phrase against a text that holds the template again and again: no find, bounded time."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(8))
    items = [(i, f"what is the name of the river that flows through {word()} {word()} {word()} and ends in the sea".encode()) for i in range(5000)]
    text = " ".join(f"What is the name of the river that flows through {word()} {word()} {word()} and ends in the sea" for _ in range(30))
    index = d.ItemIndex(items)
    start = time.process_time()
    assert index.find(text.encode()) == []
    assert time.process_time() - start < 60
    assert [x[0] for x in index.find((text + " " + items[7][1].decode()).encode())] == [7]
