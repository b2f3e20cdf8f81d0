"""Removal of long repeated word sequences by recompression.

Every text is a sequence of symbols, words at first. A Spark round names words: equal words get equal names all over the
corpus, words that occur once get none (0). Each further round replaces maximal runs of one symbol and then adjacent pairs, a
symbol of the left half of the alphabet before one of the right half (a symbol's half in a round is a bit of its mixed name). Every block sends each of its
different (symbol, run length, symbol, run length) once; a key range numbers them, and the names go home. Names are numbers that the range
deals out, not hashes: two symbols have one name exactly if they stand for the same words. What occurs once gets no name.

With each symbol goes the stretch of words on which it depends (its own, and the neighbours that could have changed
it), so equal stretches have equal symbols inside. A window of min_words with a nameless symbol's stretch inside can't be repeated: it drops out,
and symbols that lie in no window left drop out after it. So the volume falls from round to round to what repeats. The windows whose
symbols are all shared are then verified over the whole corpus, exactly, on the names of their words (see windows).

Nulls and empty texts: no words, nothing removed, kept is the empty string. Texts shorter than min_words: nothing
removed, kept is the words joined by one space. Rows that repeat (same id, same text) are documents of their own and so repeat
each other. Null ids stay null. Columns other than the two named are not read. Memory: some fifty bytes for each word of a block, and
a text longer than a block makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import windows as W

ROUNDS = 3
#: Bits of a name for the round that gave it.
ROUND_BITS = 3
OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
VOCABULARY = "bucket int, block long, n int, words binary, often binary"
NAMES = "block long, round int, bucket int, n int, names binary"
SYMBOLS = "block long, kind int, state array<binary>, bucket int, n int, parts array<binary>, often binary"
#: Bytes of white space.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOLS = [c.split()[0] for c in SYMBOLS.split(", ")]


class Words:
    """The words of a block, `[^\\x20\\x09-\\x0D]+`: where each lies, and where the texts start."""

    def __init__(self, row):
        self.data, self.texts = B.texts(row)
        n = len(self.data)
        inside, edge = ~_SPACE[self.data], np.zeros(n + 1, bool)
        edge[self.texts] = True
        before, after = edge[:n].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        self.start, self.end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        self.offsets = np.searchsorted(self.start, self.texts)

    def coded(self, bits: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Which of the different words each one is, these in order of key range, and the cuts between ranges."""
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(self.data[~_SPACE[self.data]])]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), buffers).dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        bucket = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[found.indices.to_numpy()], [words[i] for i in order.tolist()], np.searchsorted(bucket[order], np.arange((1 << bits) + 1))

    def without(self, gone: np.ndarray) -> list[bytes]:
        """Each text's words that aren't gone, joined by one space."""
        n, kept = len(self.data), ~gone
        start, past = self.start[kept], self.end[kept]
        ends = np.zeros(n + 1, bool)
        ends[self.texts] = True
        open_ = ~ends[past]  # the byte after the word is white space of the same text
        out, steps = self.data.copy(), np.zeros(n + 1, np.int8)
        out[past[open_]] = 32
        past = past + open_
        steps[start] += 1
        steps[past] -= 1
        mask = np.cumsum(steps[:n], dtype=np.int8).astype(bool)
        cuts = np.concatenate([[0], np.cumsum(mask)])[self.texts].tolist()
        raw = out[mask].tobytes()
        return [raw[a:b].rstrip(b" ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def name(numbers: np.ndarray, bucket: int, bits: int, round_: int) -> np.ndarray:
    """Names of all the corpus from the numbers that a key range dealt out (from 1); 0 stays 0."""
    full = ((numbers.astype(np.int64) << bits) | bucket) << ROUND_BITS | round_
    return np.where(numbers > 0, full, 0)


@dataclass
class Symbols:
    """A block's symbols in one round: names, the words [left, right) that each depends on, and which ones start a text."""

    sym: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray

    @classmethod
    def of_words(cls, sym: np.ndarray, offsets: np.ndarray) -> Symbols:
        first = np.zeros(len(sym), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        return cls(sym, np.arange(len(sym)), np.arange(1, len(sym) + 1), first)

    def mask(self, alive: np.ndarray, window: int) -> None:
        """Take the name of symbols that no living window holds whole, and put runs of nameless ones together."""
        ahead = np.zeros(len(alive) + 1, np.int64)
        np.cumsum(alive, out=ahead[1:])
        lo, hi = np.clip(self.right - window, 0, len(alive)), np.minimum(self.left + 1, len(alive))
        self.sym = np.where((hi > lo) & (ahead[np.maximum(hi, lo)] > ahead[lo]), self.sym, 0)

    def kill(self, alive: np.ndarray, window: int) -> None:
        """Windows that hold a nameless symbol whole don't live."""
        lo, hi = np.clip(self.right - window, 0, len(alive)), np.minimum(self.left + 1, len(alive))
        lo, hi = (x[(self.sym == 0) & (hi > lo)] for x in (lo, hi))
        steps = np.zeros(len(alive) + 1, np.int32)
        np.add.at(steps, lo, 1)
        np.add.at(steps, hi, -1)
        alive &= np.cumsum(steps[:-1]) == 0

    def joined(self, round_: int) -> tuple[Symbols, np.ndarray, tuple[np.ndarray, ...]]:
        """The next round's symbols, which of them need a name, and what these stand for; sym still has the old names."""
        n = len(self.sym)
        if not n:
            none = np.zeros(0, np.int64)
            return Symbols(none, none, none, np.zeros(0, bool)), np.zeros(0, bool), (none,) * 4
        sym, left, right, first = self.sym, self.left, self.right, self.first
        # runs: a run ends because its neighbours differ; past the text's ends there is no telling
        fresh = np.ones(n, bool)
        fresh[1:] = (sym[1:] != sym[:-1]) | first[1:]
        at = np.flatnonzero(fresh)
        last = np.append(at[1:], n) - 1
        size = last - at + 1
        ends = np.append(first[1:], True)
        lo = np.where(first[at], left[at] - 1, left[np.maximum(at - 1, 0)])
        hi = np.where(ends[last], right[last] + 1, right[np.minimum(last + 1, n - 1)])
        sym, left, right, first = sym[at], lo, hi, first[at]
        # pairs: (x, y) joins if x is in the left half and y in the right one; nothing else can touch either
        half = (B.mix(sym.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(17 + round_) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(sym), bool)
        joins[:-1] = ~half[:-1] & half[1:] & ~first[1:]
        second = np.zeros(len(sym), bool)
        second[1:] = joins[:-1]
        at = np.flatnonzero(~second)
        pair = joins[at]
        ends = np.append(first[1:], True)
        prev, nxt = np.maximum(at - 1, 0), np.minimum(at + 1, len(sym) - 1)
        lo = np.where(pair | ~half[at], left[at], np.where(first[at], left[at] - 1, left[prev]))
        hi = np.where(pair, right[nxt], np.where(half[at], right[at], np.where(ends[at], right[at] + 1, right[nxt])))
        a, run_a = sym[at], size[at]
        b, run_b = np.where(pair, sym[nxt], 0), np.where(pair, size[nxt], 0)
        dead = (a == 0) | (pair & (b == 0))
        new = ~dead & (pair | (run_a > 1))
        return Symbols(np.where(dead, 0, a), lo, hi, first[at]), new, tuple(x[new] for x in (a, run_a, b, run_b))


def _route(parts: tuple[np.ndarray, ...], bits: int) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Different:
    """The different rows of some columns, in order of their key ranges."""

    def __init__(self, parts: tuple[np.ndarray, ...], bits: int):
        bucket = _route(parts, bits)
        order = np.lexsort((*reversed(parts), bucket))
        rows = [x[order] for x in parts]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in rows]) if len(order) else False
        where = np.flatnonzero(new)
        self.rows = [x[where] for x in rows]
        self.often = np.diff(np.append(where, len(order))) > 1
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.cuts = np.searchsorted(bucket[order][where], np.arange((1 << bits) + 1))

    def messages(self, block: int) -> list[tuple]:
        out = []
        for b in np.flatnonzero(np.diff(self.cuts)):
            part = slice(self.cuts[b], self.cuts[b + 1])
            a, run_a, y, run_y = (x[part] for x in self.rows)
            parts = [B.squeeze(np.diff(a, prepend=0)), B.squeeze(run_a), B.squeeze(y), B.squeeze(run_y)]
            out.append((block, 1, None, int(b), len(a), parts, np.packbits(self.often[part]).tobytes()))
        return out

    def named(self, answers: pd.DataFrame, bits: int, round_: int) -> np.ndarray:
        found = np.zeros(len(self.often), np.int64)
        for b, numbers in zip(answers["bucket"].tolist(), answers["names"], strict=True):
            found[self.cuts[b] : self.cuts[b + 1]] = name(B.expand(numbers, np.uint32), b, bits, round_)
        return found[self.group]


def _numbered(pdf: pd.DataFrame, round_: int, live: np.ndarray, group: np.ndarray) -> pd.DataFrame:
    """Answers: numbers from 1 of the living groups, in order, for the rows of each message."""
    numbers = np.where(live, np.cumsum(live), 0).astype(np.uint32)
    ends = np.cumsum(pdf["n"].to_numpy())
    names = [B.squeeze(numbers[group[z - n : z]]) for z, n in zip(ends.tolist(), pdf["n"].tolist(), strict=True)]
    return pd.DataFrame({"block": pdf["block"], "round": round_, "bucket": pdf["bucket"], "n": pdf["n"], "names": names})


def _often(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pdf["often"], pdf["n"], strict=True)])


def name_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range of the vocabulary: words that occur more than once are numbered in order."""
    words = [w for x in pdf["words"] for w in B.raw(x).split(b" ")]
    known = {w: i for i, w in enumerate(sorted(set(words)))}
    group = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return _numbered(pdf, 0, np.bincount(group, 1 + _often(pdf), len(known)) > 1, group)


def name_symbols(round_: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.concatenate([B.expand(x[i], np.int64) if i else np.cumsum(B.expand(x[0], np.int64)) for x in pdf["parts"]]) for i in range(4)]
        order = np.lexsort(parts[::-1])
        rows = [x[order] for x in parts]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in rows])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return _numbered(pdf, round_, np.bincount(group, 1 + _often(pdf)) > 1, group)

    return numbered


def _packed(symbols: Symbols, alive: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """What a block keeps from round to round; before the first, the symbols are the words."""
    arrays = [np.packbits(alive), words, offsets]
    if len(symbols.sym) < len(words) or not np.array_equal(symbols.sym, words):
        arrays += [symbols.sym, np.diff(symbols.left, prepend=0), symbols.right - symbols.left, symbols.first.astype(np.uint8)]
    return [B.squeeze(np.ascontiguousarray(x)) for x in arrays]


def _unpacked(state: list[bytes]) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
    alive, words, offsets, *rest = (B.expand(x, k) for x, k in zip(state, (np.uint8, np.int64, np.int64, np.int64, np.int64, np.int64, np.uint8)))
    if rest:
        sym, left, size, first = rest
        left = np.cumsum(left)
        symbols = Symbols(sym, left, left + size, first.astype(bool))
    else:
        symbols = Symbols.of_words(words, offsets)
    return symbols, np.unpackbits(alive, count=len(words)).astype(bool), words, offsets


def _squeezed(symbols: Symbols, window: int, alive: np.ndarray, words: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Drop what no longer matters: windows with nameless symbols, then names outside all living windows, in words and symbols."""
    symbols.kill(alive, window)
    symbols.mask(alive, window)
    some = np.flatnonzero(alive)
    runs = W.runs_of(some)
    return symbols, np.where(W.covered(runs, window, len(words)), words, 0)


def candidates(docs_blocks: DataFrame, bits: int, window: int, rounds: int) -> DataFrame:
    """A block table: after the rounds, the windows of each block whose symbols are all shared, and the names of their words."""
    table = docs_blocks

    def vocabulary(row):
        code, words, cuts = Words(row).coded(bits)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        often = np.bincount(code, minlength=len(words)) > 1
        rows = [(int(b), row.block, int(cuts[b + 1] - cuts[b]), squeeze(b" ".join(words[cuts[b] : cuts[b + 1]])), np.packbits(often[cuts[b] : cuts[b + 1]]).tobytes()) for b in np.flatnonzero(np.diff(cuts))]
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "words", "often"])

    named = B.dealt(B.each(table, vocabulary, VOCABULARY), bits).groupBy("bucket").applyInPandas(name_words, NAMES)

    def rows_of(block: int, round_: int, symbols: Symbols, alive, words, offsets) -> pd.DataFrame:
        """The state after a round, and what the next one has to name."""
        rows = [(block, 0, _packed(symbols, alive, words, offsets), None, None, None, None)]
        if round_ < rounds:
            rows += Different(symbols.joined(round_ + 1)[2], bits).messages(block)
        out = pd.DataFrame(rows, columns=_SYMBOLS)
        return out.astype({"bucket": "Int32", "n": "Int32"})

    def read(row, answers):
        own = Words(row)
        code, words, cuts = own.coded(bits)
        names, offsets = np.zeros(len(words), np.int64), own.offsets
        for b, numbers in zip(answers["bucket"].tolist(), answers["names"], strict=True):
            names[cuts[b] : cuts[b + 1]] = name(B.expand(numbers, np.uint32), b, bits, 0)
        ids = names[code]
        alive = B.whole(offsets, window, len(ids))
        symbols, ids = _squeezed(Symbols.of_words(ids, offsets), window, alive, ids)
        return rows_of(row.block, 0, symbols, alive, ids, offsets)

    state = B.by_block(B.meet(table, named, read, SYMBOLS), like=table)
    for r in range(1, rounds + 1):
        answers = B.dealt(state.filter("kind = 1").select("bucket", "block", "n", "parts", "often"), bits).groupBy("bucket").applyInPandas(name_symbols(r), NAMES)

        def advance(row, answers, r=r):
            symbols, alive, words, offsets = _unpacked(row.state)
            symbols, new, parts = symbols.joined(r)
            symbols.sym[new] = Different(parts, bits).named(answers, bits, r)
            symbols, words = _squeezed(symbols, window, alive, words)
            return rows_of(row.block, r, symbols, alive, words, offsets)

        last, state = state, B.by_block(B.meet(state.filter("kind = 0").select("block", "state"), answers, advance, SYMBOLS), like=table)
        B.forget(last)
    return state


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35, rounds: int = ROUNDS, block_bytes: int = B.BLOCK_BYTES, prime_bits: int = 31) -> DataFrame:
    """One row per document: sizes, the removed runs (word numbers) and the words that are left, joined by one space.

    A word goes if a window of min_words words that covers it starts anywhere else too, in this or another document. rounds (of
    runs and pairs, 7 at most) and prime_bits (see windows.Rolling) change the work and not the result.
    """
    if not 0 <= rounds < 1 << ROUND_BITS:
        raise ValueError("rounds must be 0 to 7")
    table = B.store(docs, id_col, text_col, block_bytes=block_bytes)
    bits = B.key_bits(table)
    rolling = W.Rolling(prime_bits)
    rest = candidates(table, bits, min_words, rounds).select("block", "state")

    def shared(row) -> tuple[np.ndarray, W.Windows]:
        _, alive, words, offsets = _unpacked(row.state)
        at = np.flatnonzero(alive)
        keys = rolling.keys(rolling.of_numbers(words), min_words)[at] if len(at) else np.zeros(0, np.uint64)
        tags = [words[np.maximum(at - 1, 0)].astype(np.uint64), words[at + min_words - 1].astype(np.uint64)]
        return words, W.Windows(at, keys, tags, bits, offsets[:-1])

    verified = W.judged(B.each(rest, lambda row: shared(row)[1].messages(row.block), W.MESSAGE), bits)

    def settle(row, answers):
        words, own = shared(row)
        return own.state(row.block, answers, lambda at: words[at : at + min_words].tobytes())

    state = B.by_block(B.meet(rest, verified, settle, W.STATE), like=table)

    def contents(row, at):
        words = _unpacked(row.state)[2]
        return [words[i : i + min_words].tobytes() for i in at.tolist()]

    def cut(row, found):
        own = Words(row)
        offsets = own.offsets
        runs = np.frombuffer(found["runs"].iloc[0], np.int64).reshape(-1, 2) if len(found) else np.zeros((0, 2), np.int64)
        gone = W.covered(runs, min_words, int(offsets[-1]))
        rows = []
        for i, (a, b, left) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), own.without(gone), strict=True)):
            some = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], some.astype(np.int8), [0]]))).reshape(-1, 2).tolist() if some.any() else []
            rows.append((row.ids[i], b - a, int(some.sum()), [{"start": x, "end": y} for x, y in edge], left.decode("utf-8", "replace")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "kept"])
        return out.astype({"doc_id": "Int64"})

    return B.meet(table, W.proved(state, rest, contents, min_words), cut, OUT)


def op7_recompression(spark, sf_dir: str) -> DataFrame:
    """Every text of documents, without the 35-word windows that occur more than once."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
