"""Parts that run without Spark, against slow models and public libraries."""

import random
import zlib

import numpy as np
import pytest

from gristmill.llm import bpe, common, decontaminate, exact_dedup, language_model, secrets, simhash, substring_dedup, token_files

P = pytest.importorskip("public_tokenizers")
ODD = ["", "  \n\n x y", "日本語のテキスト🙂🙃 don't I'LL", "\t\t  a", "a" * 3000, "aaaa bbbb" * 50, "é̀́̂ ﷽   x", "a.,b ...x., ς Σ. É.É, é.", "<|endoftext|> A<|ENDOFTEXT|>b"]


def noise(alphabet, n=60, size=200, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(size)) for _ in range(n)]


def test_word_spans_and_hashes():
    text = b" The  cat\tthe dog\n"
    raw = np.frombuffer(text.lower(), np.uint8)
    s, e = common.word_spans(raw)
    assert [text[a:b] for a, b in zip(s, e)] == text.split()
    h = common.word_hashes(raw, s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert len(common.gram_hashes(h, 5)) == 0 and len(common.word_spans(np.empty(0, np.uint8))[0]) == 0


def test_bpe_equals_the_public_library_and_round_trips():
    import tiktoken

    content = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    own = bpe.codec(content, P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(content), special_tokens={})
    small = bpe.Transducer(own.machine.ranks, block=16)
    for text in ODD + noise("abcdeth ing'sXYZ09 \n!?-_éß漢🙂"):
        ids = own.encode(text)
        assert ids.tolist() == other.encode_ordinary(text)
        assert own.decoder.decode(ids) == (text.encode(), len(text))
        if text:
            assert small.encode(text.encode()) == own.machine.encode(text.encode())


def test_bpe_with_small_memories(monkeypatch):
    """Caches that start anew again and again, and ids whose bytes are ill-formed."""
    own = bpe.Codec(bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)
    texts = ODD + noise("abcdeth ing'sXYZ09 \n!?-_éß漢🙂", n=10)
    want = [own.encode(t).tolist() for t in texts]
    for name, size in (("MAX_PIECES", 5), ("MAX_PAIRS", 7), ("MAX_STATES", 11)):
        monkeypatch.setattr(bpe, name, size)
    own = bpe.Codec(own.machine.ranks, P.PATTERN)  # with memories that are empty
    own.machine.block = 16
    assert [own.encode(t).tolist() for t in texts] == want and len(own.pieces) <= 5 and len(own.machine.pairs) <= 7
    r = np.random.default_rng(6)
    for _ in range(50):
        ids = r.choice([*range(256), *r.integers(0, 50_000, 30)], 40)
        raw = b"".join(own.machine.bytes_of[i] for i in ids.tolist())
        text = raw.decode("utf-8", "replace")
        assert own.decoder.decode(ids) == (text.encode(), len(text))


def test_streaming_utf8_decoder():
    r = random.Random(2)
    for data in [t.encode() for t in ODD] + [bytes(r.randrange(256) for _ in range(300)) for _ in range(50)]:
        machine, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            n = r.randrange(1, 5)
            out += machine.feed(data[at : at + n])
            at += n
        assert out + machine.close() == data.decode("utf-8", "replace")


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    definition = open(P.path("word_bpe_49k.json")).read()
    own, other = token_files.WordEncoder(definition), Tokenizer.from_str(definition)
    for text in ODD + noise("abcdeTHs'.,!-_ 09éÉñßİΣςǅŉà́ 漢🙂\n\t ﬁ"):
        assert next(own.encode([text.encode()])).tolist() == other.encode(text, add_special_tokens=False).ids


def test_another_tokenizer_goes_through_the_library():
    from tokenizers import Tokenizer

    definition = open(P.path("byte_bpe_50k.json")).read()
    own, other = token_files.WordEncoder(definition), Tokenizer.from_str(definition)
    assert not own.by_word and token_files.plain_words(open(P.path("word_bpe_49k.json")).read())
    assert [x.tolist() for x in own.encode([t.encode() for t in ODD])] == [x.ids for x in other.encode_batch(ODD, add_special_tokens=False)]


def test_sequence_files_give_views(tmp_path):
    import pyarrow as pa

    ids = [np.arange(n, dtype=np.uint32) % 50000 for n in (3, 0, 70, 1, 500)]
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as sink:
        w = token_files.SequenceWriter(sink, 16, 4, pa.uint16())
        for x in ids:
            w.add(x)
        w.close()
    f = token_files.SequenceFile(f"file://{tmp_path}/x.arrow")
    flat = np.concatenate(ids)
    assert len(f) == -(-len(flat) // 16) and f.ids(0, len(flat)).tolist() == flat.tolist() and f.ids(60, 20).tolist() == flat[60:80].tolist()
    tokens, mask = f[len(f) - 1]
    assert not tokens.flags.owndata and sum(mask.to_pylist()) == len(flat) % 16
    with pytest.raises(IndexError):
        f[len(f)]


def test_normalised_text():
    import re

    for t in [b"", b" ", b"\n\n", b"a  b", b" a\tb\x0c ", b"x"]:
        assert exact_dedup.normalised(t) == re.sub(rb"[ \t-\r]+", b" ", t)


def test_aligned_against_brute_force():
    r = random.Random(4)

    def best(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    for _ in range(200):
        text = bytes(r.choice(b"abc") for _ in range(40))
        item = bytearray(text[10:30])
        for _ in range(r.randrange(4)):
            k = r.randrange(len(item))
            item[k : k + r.randrange(2)] = bytes(r.choice(b"abc") for _ in range(r.randrange(2)))
        got = decontaminate.aligned(np.frombuffer(bytes(item), np.uint8), np.frombuffer(text, np.uint8), 6, 14, 6)
        want = best(bytes(item), text)
        assert got is None and want > 3 or got is not None and got[2] >= want and (got[2] == want or want < got[2] <= 6)
        if got:
            assert best(bytes(item), text[got[0] : got[1]]) <= got[2]


def test_items_are_found_up_to_the_edit_budget():
    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 8)))
    items = [" ".join(word() for _ in range(40)) for _ in range(20)]
    index = decontaminate.ItemIndex([(i, t.encode()) for i, t in enumerate(items)])
    for i, t in enumerate(items):
        edited = list(t)
        for k in r.sample(range(len(t)), decontaminate.allowed(len(t)) - 2):
            edited[k] = "z"
        text = " ".join(word() for _ in range(300)) + "  " + "".join(edited).upper() + "\n" + " ".join(word() for _ in range(100))
        assert [x[0] for x in index.find(text.encode())] == [i]
    assert index.find(b"") == [] and index.find(" ".join(word() for _ in range(3000)).encode()) == []


def test_trigram_queries():
    q = secrets.trigram_query(secrets.BASE[0].pattern)
    assert frozenset({"pas", "ass", "ssw", "swo", "wor", "ord"}) in q and frozenset({"tok", "oke", "ken"}) in q
    assert secrets.trigram_query(secrets.BASE[1].pattern) == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(secrets.BASE[2].pattern) is None and secrets.trigram_query("(abc|d?)x") is None


def test_vantage_tree_finds_every_close_pair():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 300, dtype=np.int64)
    near = base[:150] ^ (np.int64(1) << r.integers(0, 62, 150)) ^ (np.int64(1) << r.integers(0, 62, 150))
    points = np.unique(np.concatenate([base, near]))
    whole = points.view(np.uint64)
    for bits, parts in ((3, 2), (7, 4)):
        close = {(i, j) for i in range(len(points)) for j in range(i) if int(whole[i] ^ whole[j]).bit_count() <= bits}
        met = set()
        for part in simhash.pieces(points, parts):
            tree = simhash.VantageTree(part, 16)
            homes = np.zeros(len(points), int)
            for _, at, home in tree.route(part):
                homes[at[home]] += 1
                met |= {(max(a, b), min(a, b)) for a in at[home].tolist() for b in at.tolist() if a != b}
            assert (homes == 1).all()
        assert close and close <= met


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", "one", "One two", "a b c d e a b c d", "x " * 50):
        w = text.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_gradients_agree_with_differences():
    net = language_model.GatedModel(np.array([50, 20, 10, 5, 4, 3]), 7.0, bounds=[0, 2, 4, 6], embedding=3, hidden=4)
    r = np.random.default_rng(0)
    net.p = {k: (x + r.standard_normal(x.shape) * 0.3).astype(np.float64) for k, x in net.p.items()}
    inputs, targets = r.integers(0, 8, (5, 2)), r.integers(0, 7, (5, 2))
    fresh, real = np.zeros((5, 2), bool), np.ones((5, 2), bool)
    fresh[0] = fresh[3, 1] = True
    h = np.zeros((4, 2))
    g, _, loss = net.gradients(inputs, targets, fresh, real, h)
    for name, x in net.p.items():
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in x.shape)
            old, x[at] = x[at], x[at] + 1e-5
            high = net.gradients(inputs, targets, fresh, real, h)[2]
            x[at] = old - 1e-5
            low = net.gradients(inputs, targets, fresh, real, h)[2]
            x[at] = old
            assert abs((high - low) / 2e-5 - g[name][at]) < 2e-3, name


def test_model_is_a_distribution_and_state_crosses_windows():
    net = language_model.GatedModel(np.array([9, 5, 4, 2, 1]), 3.0, bounds=[0, 2, 4, 5], embedding=3, hidden=4)
    texts = [np.array(x) for x in ([0, 1, 2, 5, 3], [4], [1] * 30, [2, 0])]
    losses = [net.fit(texts * 20, lanes=4, window=4) for _ in range(3)]
    assert losses[2] < losses[0]
    every = np.array([np.exp(net.score([np.array([1, 3, k])])[0]) for k in range(6)])
    assert abs(every.sum() - np.exp(net.score([np.array([1, 3])])[0])) < 1e-5
    a, b = net.score(texts, lanes=1, window=1000), net.score(texts, lanes=3, window=2)
    assert np.allclose(a, b, atol=1e-4)


def test_chains_keep_order():
    a, b = np.array([0, 5, 10, 15, 40]), np.array([100, 105, 3, 115, 140])
    best = substring_dedup.chains(a, b)[0]
    assert best == [0, 1, 3, 4]
    x = np.arange(200)
    assert substring_dedup.align(x, x[50:150], [(60, 10), (80, 30)]) == (50, 150, 0, 100, 0)
    y = np.delete(x[50:150].copy(), 40)
    assert substring_dedup.align(x, y, [(60, 10), (120, 69)]) == (50, 150, 0, 99, 1)


def test_crc_of_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
