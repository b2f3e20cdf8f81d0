"""Which windows of a corpus occur more than once: keys find them, contents prove them.

The key of a window is a pair of polynomials modulo two primes. With a key travel what stands before the window and what
ends it, since of these the key of the window one place to the left follows by arithmetic. So if all windows with one key agree in both,
the windows to their left also have one key, and if those are equal in content then so are these. Only *bases* are
left to prove: windows with no window to their left, or whose key comes with different neighbours. Every chain of
such steps to the left ends at a base, for positions in a text can't fall for ever. Bases are few (ends of repeats), and their
contents are compared, whole, by an aggregate. Where one key turns out to hold different contents, all windows of the chains that
start there are compared by their contents. So a window counts as repeated exactly if its content occurs more than once.

Work goes by block (see blocks): `Windows` is one block's part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import scratch

MESSAGE = "bucket int, block long, n int, keys binary, flags binary, tags array<binary>"
ANSWER = "block long, bucket int, n int, bits binary"
STATE = "block long, kind int, runs binary, bases binary, key long, content binary"


#: So much below 2**k lies the next prime, for k bits.
BELOW = {17: 1, 18: 5, 19: 1, 20: 3, 21: 9, 22: 3, 23: 15, 24: 3, 25: 39, 26: 5, 27: 39, 28: 57, 29: 3, 30: 35, 31: 1}


def spread(x: np.ndarray, width: int) -> np.ndarray:
    """Spread numbers of `width` bits over all of these, one to one."""
    mask, half = np.uint64((1 << width) - 1), np.uint64(width // 2)
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = x ^ (x >> half)
        x *= np.uint64(odd)
        x &= mask
    return x ^ (x >> half)


class Rolling:
    """Keys of all windows of a sequence of numbers. prime_bits: of 5, 7, 13, 17, 19, 31 (less than 31 only to provoke equal keys).

    second_bits: 17 to 31, for a smaller second prime. Keys then are shorter, their lowest `spare` bits are zero; they still are one to one with the pair of polynomials.
    """

    def __init__(self, prime_bits: int = 31, seed: int = 17, second_bits: int | None = None):
        self.bits, self.prime = prime_bits, (1 << prime_bits) - 1
        rng = np.random.default_rng(seed)
        self.bases = [int(x) for x in rng.integers(self.prime // 4, self.prime - 1, 2)]
        self.letters = rng.integers(1, self.prime, (2, 256), dtype=np.uint64)
        self.moduli, self.spare = [(self.bits, 1)] * 2, 0
        if second_bits and second_bits < prime_bits:
            p = (1 << second_bits) - BELOW[second_bits]
            self.moduli[1], self.spare = (second_bits, BELOW[second_bits]), 64 - prime_bits - second_bits
            self.bases[1] = p // 4 + self.bases[1] % (p // 2)
            self.letters[1] = self.letters[1] % np.uint64(p - 1) + np.uint64(1)

    def of_bytes(self, data: np.ndarray) -> list[np.ndarray]:
        return [letters[data] for letters in self.letters]

    def of_numbers(self, x: np.ndarray) -> list[np.ndarray]:
        return [B.mix(x.astype(np.uint64) * np.uint64(odd)) % np.uint64(self.prime) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    def powers(self, base: int, n: int, prime: int | None = None) -> np.ndarray:
        """The first n powers of a number, modulo the prime."""
        out, p = np.ones(1, np.uint64), prime or self.prime
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
        return out[:n]

    def keys(self, values: list[np.ndarray], length: int) -> np.ndarray:
        """A key for each window, slice by slice."""
        n = max(0, len(values[0]) - length + 1)
        out = np.zeros(n, np.uint64)
        size = min(n, B.SLICE)
        parts = []
        for v, base, (bits, less) in zip(values, self.bases, self.moduli, strict=True) if n else ():
            p = (1 << bits) - less
            parts.append((v, self.powers(base, size + length, p), self.powers(pow(base, -1, p), size, p), np.uint64(p), np.uint64(bits), np.uint64((1 << bits) - 1), np.uint64(less)))
        place = np.uint64(self.moduli[1][0] if self.spare else 32)
        for a in range(0, n, B.SLICE):
            b = min(a + B.SLICE, n)
            for v, up, down, p, bits, low, less in parts:
                x = v[a : b + length - 1] * up[: b - a + length - 1]
                running = np.zeros(len(x) + 1, np.uint64)
                np.cumsum((x & low) + ((x >> bits) if less == 1 else (x >> bits) * less), out=running[1:])
                x = (running[length:] - running[:-length]) % p
                x *= down[: b - a]
                x %= p
                out[a:b] <<= place
                out[a:b] |= x
        return spread(out, 64 - self.spare) << np.uint64(self.spare) if self.spare else B.mix(out)


class Windows:
    """The windows of one block that take part: positions in order, keys, and what stands before and last in each."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, tags: list[np.ndarray], bits: int, starts: np.ndarray | None = None, spare: int = 0):
        """starts: positions where texts start. Before a window that has no window to its left, the tag doesn't count. spare: zero bits at the end of all keys; they don't travel."""
        self.at, self.sorted, self.spare = at, B.Keys(keys, bits), np.uint64(spare)
        self.fresh = np.ones(len(at), bool)
        self.fresh[1:] = at[1:] != at[:-1] + 1
        if starts is not None and len(starts) and len(at):
            near = np.searchsorted(starts, at)
            near[near == len(starts)] = 0
            self.fresh |= starts[near] == at
        self.tags = tags

    def messages(self, block: int) -> pd.DataFrame:
        k, rows = self.sorted, []
        if len(k.order):
            base = np.maximum.reduceat(self.fresh[k.order], k.where)
            firsts = []
            for tag in self.tags:
                tag = tag[k.order]
                base = base | (np.minimum.reduceat(tag, k.where) != np.maximum.reduceat(tag, k.where))
                firsts.append(tag[k.where])
            for b in np.flatnonzero(np.diff(k.cuts)):
                part = slice(k.cuts[b], k.cuts[b + 1])
                own = k.unique[part]
                flags = B.squeeze(np.packbits(np.concatenate([k.often[part], base[part]])))
                rows.append((int(b), block, len(own), B.squeeze(np.diff(own >> self.spare, prepend=np.uint64(0))), flags, [B.squeeze(t[part]) for t in firsts]))
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "keys", "flags", "tags"])

    def answered(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """For each window: whether its key is repeated, and whether it is a base."""
        k = self.sorted
        both = np.zeros((2, len(k.unique)), bool)
        for b, n, bits in zip(answers.bucket, answers.n, answers.bits, strict=True):
            both[:, k.cuts[b] : k.cuts[b] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * n).reshape(2, n)
        out = np.zeros((2, len(k.order)), bool)
        out[:, k.order] = both[:, k.group]
        return out[0], out[1]

    def state(self, block: int, answers: pd.DataFrame, content: Callable[[int], bytes]) -> pd.DataFrame:
        """A row (kind 0) with the runs of repeated windows and the bases among them; rows (kind 1) with the bases' contents, each once."""
        repeated, base = self.answered(answers)
        hit = self.at[repeated]
        keys = np.zeros(len(self.at), np.uint64)
        keys[self.sorted.order] = self.sorted.unique[self.sorted.group]
        base = base[repeated]
        known = pd.DataFrame({"at": hit[base], "key": keys[repeated][base].view(np.int64)})
        own = sorted({(k, content(a)) for a, k in zip(known["at"].tolist(), known["key"].tolist(), strict=True)})
        none = [None] * len(own)
        return pd.DataFrame({
            "block": block,
            "kind": [0, *[1] * len(own)],
            "runs": [runs_of(hit).tobytes(), *none],
            "bases": [known.to_numpy(np.int64).tobytes(), *none],
            "key": pd.array([None, *(k for k, _ in own)], dtype="Int64"),  # a column of floats would round the keys
            "content": [None, *(c for _, c in own)],
        })


def runs_of(at: np.ndarray) -> np.ndarray:
    """Positions in order as rows of (first, one past the last)."""
    edge = np.flatnonzero(np.diff(at) != 1) if len(at) else np.zeros(0, np.int64)
    first = at[np.concatenate([[0], edge + 1]).astype(np.int64)] if len(at) else at
    last = at[np.append(edge, len(at) - 1).astype(np.int64)] + 1 if len(at) else at
    return np.stack([first, last], axis=1).astype(np.int64)


def positions(runs: np.ndarray) -> np.ndarray:
    size = runs[:, 1] - runs[:, 0]
    return np.repeat(runs[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())


def covered(runs: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places are in a window that starts in the runs."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, runs[:, 0], 1)
    np.add.at(steps, np.minimum(runs[:, 1] - 1 + length, n), -1)
    return np.cumsum(steps[:n]) > 0


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    n = pdf["n"].tolist()
    keys = np.concatenate([np.cumsum(B.expand(x, np.uint64), dtype=np.uint64) for x in pdf["keys"]])
    flags = [np.unpackbits(B.expand(x, np.uint8), count=2 * m).reshape(2, m).astype(bool) for x, m in zip(pdf["flags"], n, strict=True)]
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    where = np.flatnonzero(first)
    often, base = (np.logical_or.reduceat(x[order], where) for x in np.concatenate(flags, axis=1))
    often |= np.diff(np.append(where, len(s))) > 1
    for i, (like, *_) in enumerate(zip(*pdf["tags"])):
        kind = np.uint64 if len(B.raw(like)) == 8 * n[0] else np.uint16
        tag = np.concatenate([B.expand(x[i], kind) for x in pdf["tags"]])[order]
        base |= np.minimum.reduceat(tag, where) != np.maximum.reduceat(tag, where)
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(first) - 1
    bits, a = [], 0
    for m in n:
        own = group[a : a + m]
        bits.append(np.packbits(np.concatenate([often[own], base[own] & often[own]])).tobytes())
        a += m
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "n": pdf["n"], "bits": bits})


def judged(messages: DataFrame, bits: int) -> DataFrame:
    """Answers (columns ANSWER) to the blocks' messages, one key range at a time."""
    return B.dealt(messages, bits).groupBy("bucket").applyInPandas(_judge, ANSWER)


def proved(state: DataFrame, blocks: DataFrame, contents: Callable, length: int) -> DataFrame:
    """block, runs: of each block the runs of windows whose contents occur more than once.

    state: what Windows.state() gave, stored. contents(block row, positions) gives the windows' contents; it is called only for
    windows of chains that start with a key that holds different contents.
    """
    found = state.filter("kind = 0").select("block", "runs", "bases")
    mixed = state.filter("kind = 1").groupBy("key").agg((F.min("content") < F.max("content")).alias("mixed")).filter("mixed").select("key")
    mixed = scratch.stored(mixed, "mixed")
    if mixed.isEmpty():
        return found.select("block", "runs")
    hit = state.filter("kind = 1").join(mixed, "key").groupBy("block").agg(F.collect_set("key").alias("mixed"))
    chains = scratch.stored(found.join(hit, "block"), "chains")

    def doubtful(row) -> np.ndarray:
        at = positions(np.frombuffer(row.runs, np.int64).reshape(-1, 2))
        bases = np.frombuffer(row.bases, np.int64).reshape(-1, 2)
        start = np.searchsorted(bases[:, 0], at, "right") - 1  # every run starts with a base
        return at[np.isin(bases[start, 1], np.asarray(row.mixed, np.int64))]

    def suspects(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                at = doubtful(row)
                for a in range(0, len(at), 50_000):
                    yield pd.DataFrame({"block": row.block, "at": at[a : a + 50_000], "content": contents(row, at[a : a + 50_000])})

    rows = scratch.stored(blocks.join(chains, "block").mapInPandas(suspects, "block long, at long, content binary"), "suspects")
    true = rows.join(rows.groupBy("content").count().filter("count > 1").select("content"), "content")
    true = true.groupBy("block").agg(F.collect_list("at").alias("at"))

    def corrected(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                at = positions(np.frombuffer(row.runs, np.int64).reshape(-1, 2))
                at = np.union1d(np.setdiff1d(at, doubtful(row)), np.asarray([] if row.at is None else row.at, np.int64))
                out.append((row.block, runs_of(at.astype(np.int64)).tobytes()))
            yield pd.DataFrame(out, columns=["block", "runs"])

    again = chains.join(true, "block", "left").mapInPandas(corrected, "block long, runs binary")
    return found.join(chains.select("block"), "block", "left_anti").select("block", "runs").unionByName(again)
