"""Removal of repeats against brute force: equal keys of different contents, several blocks and slices, runs, and words made to collide."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import zstandard

from trustloom.llm import blocks, recompression, suffix_dedup
from trustloom.llm import windows as W


def plain_bytes(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = Counter()
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out[len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)] += 1
    return out


def plain_words(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = Counter()
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out[len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


def corpus(seed, n=30):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 4))) for _ in range(25)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [say(rnd.randrange(30, 120)) for _ in range(6)]
    out = [None, "", " \n", "a " * 300, "b a " * 150, "a " * 299 + "b", "x" * 650, say(3000)]
    for _ in range(n):
        parts = [say(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 4)):
            s = rnd.choice(shared)
            cut = rnd.randrange(len(s) // 2)
            parts += [s[cut:] if rnd.random() < 0.5 else s, say(rnd.randrange(0, 40))]
        out.append(" ".join(parts))
    return out + [out[9], out[9], out[10] + " " + out[11]]


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, block long, runs string")


@pytest.mark.parametrize("prime_bits", [31, 13, 5])
@pytest.mark.parametrize("block_bytes", [1 << 22, 2000])
def test_bytes(spark, prime_bits, block_bytes):
    texts = corpus(prime_bits)
    got = suffix_dedup.remove_repeats(frame(spark, texts), block_bytes=block_bytes, prime_bits=prime_bits).collect()
    assert Counter((r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == plain_bytes(texts, 200)
    assert sum(r.doc_id is None for r in got) == 1


@pytest.mark.parametrize("prime_bits", [31, 13, 5])
@pytest.mark.parametrize("block_bytes", [1 << 22, 2000])
def test_words(spark, prime_bits, block_bytes):
    texts = corpus(100 + prime_bits)
    got = recompression.remove_repeats(frame(spark, texts), block_bytes=block_bytes, prime_bits=prime_bits).collect()
    assert Counter((r.n_words, r.n_removed, r.kept) for r in got) == plain_words(texts, 35)
    assert sum(r.doc_id is None for r in got) == 1


def test_words_in_short_windows(spark):
    texts = corpus(8, 12)
    for size in (1, 2, 5):
        got = recompression.remove_repeats(frame(spark, texts), min_words=size).collect()
        assert Counter((r.n_words, r.n_removed, r.kept) for r in got) == plain_words(texts, size)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_modulo_powers_of_two(spark):
    same = " ".join(f"w{i}" for i in range(34))
    texts = [f"{same} {thue_morse(1024, 'a', 'b')}", f"{same} {thue_morse(1024, 'b', 'a')}", same + " end"]
    got = recompression.remove_repeats(frame(spark, texts)).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]
    long = [thue_morse(4096, "a", "b"), "z" + thue_morse(4096, "b", "a")]
    got = suffix_dedup.remove_repeats(frame(spark, long)).collect()
    assert Counter((r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == plain_bytes(long, 200)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(50000)}" for _ in range(110_000)]
    at = 524_200
    long = " ".join(words)
    piece = long[at : at + 600]  # lies across the first slice's end
    texts = [long, "x " * 40 + piece + " y", piece[:250]]
    assert len(long) > blocks.SLICE + 1000
    got = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    assert Counter((r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == plain_bytes(texts, 200)
    got = recompression.remove_repeats(frame(spark, texts)).collect()
    assert Counter((r.n_words, r.n_removed, r.kept) for r in got) == plain_words(texts, 35)


def test_rolling_keys_are_the_polynomials():
    import numpy as np

    x = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    r = W.Rolling(13)
    got = r.keys(r.of_bytes(x), 20)
    want = []
    for i in range(481):
        key = 0
        for base, letters in zip(r.bases, r.letters):
            key = key << 32 | sum(int(letters[c]) * pow(base, j, r.prime) for j, c in enumerate(x[i : i + 20].tolist())) % r.prime
        want.append(key)
    assert got.tolist() == blocks.mix(np.asarray(want, np.uint64)).tolist()


def test_words_of_a_block():
    """Words, their coding and what is left of a text, against bytes.split(); texts meet without white space between them."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        texts = [bytes(rng.choice(list(b"ab \n\t\x0b\x1cz"), rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 5))]
        data = b"".join(texts)
        row = SimpleNamespace(sizes=[len(t) for t in texts], n_bytes=len(data), data=zstandard.ZstdCompressor().compress(data))
        own, words = recompression.Words(row), [t.split() for t in texts]
        flat = [w for ws in words for w in ws]
        assert np.diff(own.offsets).tolist() == [len(ws) for ws in words]
        code, different, cuts = own.coded(6)
        assert [different[i] for i in code.tolist()] == flat and sorted(different) == sorted(set(flat)) and cuts[-1] == len(different)
        gone = rng.random(len(flat)) < 0.4
        kept = iter(gone.tolist())
        assert own.without(gone) == [b" ".join([w for w in ws if not next(kept)]) for ws in words]


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.uint32, np.int64, np.uint64])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packed_numbers_come_back(dtype, n):
    x = np.random.default_rng(3).integers(0, 200, n).astype(dtype)
    assert np.array_equal(blocks.expand(blocks.squeeze(x), dtype), x)


def test_short_keys_travel_short():
    """A suffix key is as long as the corpus needs, one to one with its pair of polynomials, and its message holds nothing else."""
    for bits, less in W.BELOW.items():
        assert all(((1 << bits) - less) % d for d in [2, *range(3, 1 << 16, 2)] if d * d <= 1 << bits), bits
    assert len(np.unique(W.spread(np.arange(1 << 17, dtype=np.uint64), 17))) == 1 << 17
    data = np.random.default_rng(3).integers(97, 123, 300_000).astype(np.uint8)
    for second in (17, 20, 25):
        r = W.Rolling(second_bits=second)
        keys, want = r.keys(r.of_bytes(data), 200), []
        for at in (0, 7, len(keys) - 1):
            pair = []
            for letters, base, (bits, less) in zip(r.letters, r.bases, r.moduli, strict=True):
                p = (1 << bits) - less
                pair.append(sum(int(letters[c]) * pow(base, i, p) for i, c in enumerate(data[at : at + 200].tolist())) % p)
            want.append(pair[0] << second | pair[1])
        assert (W.spread(np.array(want, np.uint64), 31 + second) << np.uint64(r.spare)).tolist() == keys[[0, 7, -1]].tolist()
    r = W.Rolling(second_bits=17)
    sent = W.Windows(np.arange(len(data) - 199), r.keys(r.of_bytes(data), 200), [], 6, spare=r.spare).messages(0)
    assert sum(map(len, sent["keys"])) < 4.5 * len(data)  # 6 bytes each with keys of two large primes
