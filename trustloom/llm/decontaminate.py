"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Texts are sequences of lower-cased words. The CGK walk embeds a sequence by reading it with a pointer that stays or moves on
by a random bit of (step, word): a small edit distance becomes a small Hamming distance, because two walks that differ
at an edit soon fall into step again. Windows are sized by the item: as long as the words that the allowed edits must leave of it have room for,
at every start (`classes`). A document's windows, at every second to fourth start by their size, are embedded a number of times; each embedding is
sampled at a few coordinates `samples` times, and the samples are looked up among those of all windows of all items. How many
embeddings it takes to meet the target recall, at all the edits allowed, is found by trial on random words (`walks_for`). What is found is
verified: the edit distance, in words, between the item and the best stretch of the document around the hit (exact,
bit-parallel) must not exceed (1 - similarity) of the item's words. Verification sees no window boundaries. Items too short for a window (under 7
words at a similarity of 0.8) must occur exactly.

The items are bounded by the benchmark, not by the corpus: their number is counted, and a benchmark of more than `per_pass` items is
taken in several passes, one after another over stored documents. Documents are neither shuffled nor gathered in one pass: the answer is a column.

Nulls and empty texts match nothing, null items and items without words take no part. Repeated rows get a row each; repeated items are reported with
the smallest id. Null item ids take no part. No items: nothing matches. Ties: of several stretches with the least distance, the first. A column
of docs that is named like the answer is replaced by it; other columns stay whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import scratch
from .memory import release, small_batches

ITEMS = 20_000
#: Words of a window, and of a step between the starts that are looked at in documents.
WINDOWS = ((20, 4), (12, 4), (8, 3), (5, 2))
#: Target recall of an item at all the edits allowed, embeddings at most, and trials that choose their number.
RECALL, MOST_WALKS, TRIALS = 0.97, 24, 400
MATCHES = "array<struct<item_id:long,start:int,end:int,edits:int>>"
_CHUNK = 1 << 20
_STRIP = 1 << 14


def _letters() -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all of a character beyond ASCII."""
    x = np.zeros(256, bool)
    x[128:] = True
    for a, b in ("09", "az", "AZ"):
        x[ord(a) : ord(b) + 1] = True
    return x


_IN_WORD = _letters()


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the lower-cased words of some texts, and the texts' offsets among them."""
    raw = [x.lower().encode("utf-8", "replace") for x in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]))
    keys = np.zeros(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + B.SLICE)))
        running = B.sums(B._BYTE[data[start[a] : end[b - 1]]])
        keys[a:b] = B.span_keys(running, start[a:b] - start[a], end[a:b] - start[a])
        a = b
    return keys, offsets


def coordinates(size: int, samples: int, width: int, seed: int) -> list[np.ndarray]:
    """The steps that each sample looks at, of a walk of twice the window's length."""
    rng = np.random.default_rng(seed)
    steps = 2 * size - 2
    return [np.sort(rng.choice(steps, min(width, steps), replace=False)) for _ in range(samples)]


def sampled_walks(keys: np.ndarray, start: np.ndarray, size: int, walk: int, samples: int, width: int) -> np.ndarray:
    """One key per (sample, window): the words that a CGK walk reads at the sampled steps. keys go on for 2 * size beyond the last start."""
    symbols = B.mix(keys * np.uint64(2 * walk + 1) + np.uint64(walk))
    picks = coordinates(size, samples, width, 100 * size + walk)
    wanted: dict[int, list[int]] = {}
    for i, pick in enumerate(picks):
        for step in pick.tolist():
            wanted.setdefault(step, []).append(i)
    out = np.zeros((samples, len(start)), np.uint64)
    moved, one = symbols.view(np.int64), np.int64(1)
    for a in range(0, len(start), _STRIP):  # small arrays stay in the cache
        at = start[a : a + _STRIP].astype(np.int64)
        seen, bit = np.empty_like(at), np.empty_like(at)
        for step in range(max(wanted) + 1):
            np.take(moved, at, out=seen, mode="clip")
            for i in wanted.get(step, ()):
                part = out[i, a : a + _STRIP]
                part *= np.uint64(0x9E3779B97F4A7C15)
                part += seen.view(np.uint64)
            np.right_shift(seen, np.int64(step % 64), out=bit)
            bit &= one
            at += bit
    return out ^ (out >> np.uint64(29))


def classes(similarity: float) -> list[tuple[int, int, int]]:
    """(least words of an item, window, stride): whatever the edits, an item of so many words keeps room for a window at a start that is looked at."""
    out = []
    for size, stride in WINDOWS:
        least = max([n + 1 for n in range(1, 1000) if n - allowed(n, similarity) < size + stride - 1], default=1)
        if least < 1000:
            out.append((least, size, stride))
    return out


def allowed(words: int, similarity: float) -> int:
    return int(words * (1 - similarity) + 1e-9)


def edited(words: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """So many random deletions, replacements and insertions."""
    out = list(words)
    for _ in range(edits):
        kind, p = rng.integers(3), int(rng.integers(len(out)))
        out[p : p + (kind < 2)] = [] if kind == 0 else [int(rng.integers(1 << 62))]
    return out


@lru_cache(maxsize=64)
def walks_for(least: int, most: int, size: int, stride: int, similarity: float, samples: int, width: int, recall: float) -> int:
    """The number of embeddings that finds items of least to most words, with all the edits allowed, as often as recall says."""
    rng = np.random.default_rng(1)
    items, docs = [], []
    for i in range(TRIALS):
        n = least + i % max(1, min(most, least + 12) - least + 1)
        items.append(rng.integers(1 << 62, size=n).tolist())
        around = rng.integers(1 << 62, size=2 * size + int(rng.integers(stride))).tolist()
        docs.append([*around, *edited(items[-1], allowed(n, similarity), rng), *rng.integers(1 << 62, size=2 * size).tolist()])

    def windows(texts: list[list[int]], step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, owner, start = [], [], []
        for i, w in enumerate(texts):
            own = range(0, len(w) - size + 1, step)
            owner += [i] * len(own)
            start += [len(flat) + x for x in own]
            flat += w
        return np.asarray(flat + [0] * (2 * size), np.uint64), np.asarray(owner), np.asarray(start)

    (a, a_owner, a_start), (b, b_owner, b_start) = windows(items, 1), windows(docs, stride)
    found = np.zeros(TRIALS, bool)
    for walk in range(MOST_WALKS):
        mine, theirs = (sampled_walks(*x, size, walk, samples, width) for x in ((a, a_start), (b, b_start)))
        for x, y in zip(mine, theirs, strict=True):
            mark = B.mix(a_owner.astype(np.uint64)), B.mix(b_owner.astype(np.uint64))
            found[b_owner[np.isin(y ^ mark[1], x ^ mark[0])]] = True
        if found.mean() >= recall:
            return walk + 1
    return MOST_WALKS


def best_stretch(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance between the pattern and any stretch of text, and where the first such stretch ends."""
    n = len(pattern)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(diag | plus)) & full, plus & diag
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~((eq | minus) | up)) & full, up & (eq | minus)
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """The items of one pass with the samples of all their windows."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = 0.8, recall: float = RECALL, samples: int = 3, width: int = 4):
        self.samples, self.width = samples, width
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        keys, offsets = word_keys(texts)
        seen: dict[tuple, int] = {}
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            words = tuple(keys[a:b].tolist())
            if words:
                seen[words] = min(ids[i], seen.get(words, ids[i]))
        self.items = [(i, list(w)) for w, i in sorted(seen.items(), key=lambda x: x[1])]
        self.tables: list[tuple] = []
        most = 1 << 62
        for least, size, stride in classes(similarity):
            own = [(n, w) for n, (_, w) in enumerate(self.items) if least <= len(w) < most]
            if own:
                for walk in range(walks_for(least, most - 1, size, stride, similarity, samples, width, recall)):
                    self._index(own, size, stride, walk)
            most = least
        self.short: dict[int, tuple] = {}
        for size in sorted({len(w) for _, w in self.items if len(w) < most}):
            own = [(n, w) for n, (_, w) in enumerate(self.items) if len(w) == size]
            found = self._runs(np.asarray([k for _, w in own for k in w], np.uint64), np.arange(len(own)) * size, size)
            self.short[size] = self._sorted(found, np.asarray([n for n, _ in own]), np.zeros(len(own), np.int64))

    @staticmethod
    def _sorted(found: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple:
        order = np.argsort(found, kind="stable")
        maybe = np.zeros(1 << 20, bool)
        maybe[(found & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return found[order], item[order], offset[order], maybe

    @staticmethod
    def _runs(keys: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for i in range(size):
            out = B.mix(out * np.uint64(0x9E3779B97F4A7C15) + keys[start + i])
        return out

    def _index(self, own: list, size: int, stride: int, walk: int) -> None:
        flat = np.asarray([k for _, w in own for k in w] + [0] * (2 * size), np.uint64)
        base = np.concatenate([[0], np.cumsum([len(w) for _, w in own])])
        at = [(n, o, base[j] + o) for j, (n, w) in enumerate(own) for o in range(len(w) - size + 1)]
        item, offset, start = (np.asarray(x) for x in zip(*at))
        for sample, found in enumerate(sampled_walks(flat, start, size, walk, self.samples, self.width)):
            self.tables.append((size, stride, walk, sample, *self._sorted(found, item, offset)))

    @staticmethod
    def _starts(offsets: np.ndarray, size: int, stride: int) -> np.ndarray:
        count = np.diff(offsets)
        fits = np.where(count < size, 0, (count - size) // stride + 1)
        return np.repeat(offsets[:-1] - stride * (np.cumsum(fits) - fits), fits) + stride * np.arange(fits.sum())

    @staticmethod
    def _looked_up(own: np.ndarray, start: np.ndarray, known, item, offset, maybe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero(maybe[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(known, own[some], "left"), np.searchsorted(known, own[some], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(start[some], n), item[at], offset[at]

    def hits(self, keys: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window starts, items, offsets in the items) that share a sample."""
        for size, table in self.short.items():
            start = self._starts(offsets, size, 1)
            yield self._looked_up(self._runs(keys, start, size), start, *table)
        last: tuple | None = None
        start, sampled, padded = np.zeros(0, np.int64), np.zeros((0, 0), np.uint64), keys
        for size, stride, walk, sample, *table in self.tables:
            if last is None or last[0] != size:
                start, padded = self._starts(offsets, size, stride), np.append(keys, np.zeros(2 * size, np.uint64))
            if last != (size, walk):
                sampled = sampled_walks(padded, start, size, walk, self.samples, self.width)
            last = (size, walk)
            yield self._looked_up(sampled[sample], start, *table)

    def match(self, texts: list[str], similarity: float) -> list[list[dict]]:
        keys, offsets = word_keys(texts)
        found: list[dict[int, tuple]] = [{} for _ in texts]
        tried: set[tuple[int, int, int]] = set()
        words = None
        for start, item, offset in self.hits(keys, offsets):
            doc = np.searchsorted(offsets, start, "right") - 1
            for d, n, s in {(int(a), int(b), int(c)) for a, b, c in zip(doc, item, start - offset, strict=True)} - tried:
                tried.add((d, n, s))
                pattern = self.items[n][1]
                bound = allowed(len(pattern), similarity) if len(pattern) not in self.short else 0
                if n in found[d] and found[d][n][0] == 0:
                    continue
                words = keys.tolist() if words is None else words
                a, b = max(int(offsets[d]), s - bound), min(int(offsets[d + 1]), s + len(pattern) + bound)
                if s >= offsets[d] and words[s : s + len(pattern)] == pattern and s + len(pattern) <= offsets[d + 1]:
                    best, lo, hi = 0, s, s + len(pattern)
                else:
                    best, end = best_stretch(pattern, words[a:b])
                    lo, hi = a + end - best_stretch(pattern[::-1], words[a : a + end][::-1])[1], a + end
                new = (best, lo - int(offsets[d]), hi - int(offsets[d]))
                if best <= bound and (n not in found[d] or new < found[d][n]):
                    found[d][n] = new
        return [[{"item_id": self.items[n][0], "start": lo, "end": hi, "edits": e} for n, (e, lo, hi) in sorted(x.items())] for x in found]


def matches(text_col: str, items: list[tuple[int, str]], similarity: float = 0.8, recall: float = RECALL, samples: int = 3, width: int = 4) -> Column:
    """A column with the items that a text contains, up to the edits allowed."""

    @F.pandas_udf(MATCHES)
    def of(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Items(items, similarity, recall, samples, width)
        for texts in frames:
            out, part, held = [], [], 0
            for x in texts:
                part.append(x or "")
                held += len(part[-1])
                if held >= 4 * _CHUNK:
                    out += index.match(part, similarity)
                    part, held = [], 0
            out += index.match(part, similarity) if part else []
            release()
            yield pd.Series(out)

    return of(F.col(text_col))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "matches", similarity: float = 0.8, recall: float = RECALL, per_pass: int = ITEMS) -> DataFrame:
    """docs with one more column: the benchmark items that the whole text contains."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    passes = max(1, -(-items.count() // per_pass))

    def taken(n: int) -> list[tuple[int, str]]:
        """The items of one pass; equal texts come in the same one."""
        return [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("t"), F.lit(passes)) == n).collect()]

    if passes == 1:
        return docs.withColumn(out, matches(text_col, taken(0), similarity, recall))
    name = f"_row_{uuid.uuid4().hex}"
    rows = scratch.stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    found = [scratch.stored(rows.select(name, matches(text_col, taken(n), similarity, recall).alias("m")).filter("size(m) > 0"), "pass") for n in range(passes)]
    every = reduce(DataFrame.unionByName, found).groupBy(name).agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m")).withColumnRenamed("m", f"{name}_m")
    none = F.array().cast(MATCHES)
    return rows.join(every, name, "left").withColumn(out, F.coalesce(f"{name}_m", none)).drop(name, f"{name}_m")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items found in its whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.array_min(F.col("matches.edits")).alias("least_edits"))
