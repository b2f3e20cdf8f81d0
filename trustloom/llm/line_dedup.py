"""Near-duplicate lines by a deletion-neighbourhood join; the earliest of each kind stays.

A line is its words. Lines are equal if their words are; they are near if so few words inserted, deleted or replaced make them equal as
`bound` allows: one for each full WORDS_PER_EDIT words of the shorter line, EDITS at most. A line goes if an equal or near line stands earlier (smaller document id,
then smaller line number).

Two edits are allowed from LONG words on, so pairs with a shorter line than that are one edit apart, and neither line has more than LONG words. They
agree on their first or their last half (one edit can't touch both), so only lines up to LONG words that share a half
with a different line, anywhere in the corpus, emit variants: the half's key with the other half whole and with each of
its words deleted, hashed to 124 bits from running sums, so that the work grows with the line and not with its square. Two lines are near exactly if they share a variant with the same deleted place, or one's whole
with the other's deletion; both are minima per variant, so a template that thousands of lines fill in makes no pairs. What is found
is verified by edit distance.

For more than one edit the variants would be too many. Lines of LONG words and more that are near share one of a few *pieces*, whatever the edits (one included). A piece has as many words
as the shorter line's range of lengths leaves room for: at three edits the first, the second, the last but one and the last stretch of a line, at two edits all but the last but one. If the first or the last
stretch is untouched, it is shared as it stands. Otherwise each has an edit, and at most one is left for all else: some inner stretch is untouched, and the stretch outside it has exactly one edit. So the inner one moved by one
word at most; it is read at two places, one word further in as well (inner stretches have a word more), and two lines' places agree for each such move. Each range of lengths has pieces of its own, and a
line that its edits could shorten into the range below has both. Only lines that share a piece with a different line
travel, as signatures (parities of word hashes, of which an edit changes two at most), once per shared piece; those that share one are compared in parts of bounded size. A
line emits the earliest and the most alike of the lines that may be near, never all, and these are verified by edit distance. A line that had more
to offer, and neither verified, is compared with all of them by its words.

Lines without words (blank) always stay. Null and empty texts stay as they are. Lines at the same place, in rows that repeat an
id, don't count as earlier than each other. Null ids come last. Very long texts and lines are kept whole. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import scratch
from . import windows as W
from .memory import release

#: Hashed.pieces() holds for three edits at most.
WORDS_PER_EDIT, EDITS = 8, 3
#: Words of the shortest lines that two edits are allowed for.
LONG = 2 * WORDS_PER_EDIT
#: Words of a run in Hashed.grams().
GRAM = 5
#: Lengths of lines that have pieces of one size: each range's least length is so many times that of the range below.
RANGE = 1.5
#: Lines of one part of those that share a piece; rows and bytes that a task compares, about.
PART, TASK_ROWS, TASK_BYTES = 1024, 20_000, 8 << 20
LAST = (1 << 63) - 1
#: Earlier lines of a unit that are compared for many units at once.
_FEW = 24
LINES = "lid binary, doc long, line int, block long, row int, halves array<int>, pieces array<long>, signs array<long>, words string"
VARIANTS = "variant binary, pos int, doc long, line int, lid binary"
#: Bytes whose words are hashed at once: their arrays stay in the processor's cache.
_SLICE = 1 << 16
#: Bytes of white space, and white space of several bytes in UTF-8: what separates words, as in str.split().
_SPACE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
_WIDE = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
#: For each byte: 1 if it is white space, 2 if white space of several bytes starts with it.
_KINDS = bytes(1 if x in _SPACE else 2 if x in {c.encode()[0] for c in _WIDE} else 0 for x in range(256))
_CODES = np.array(sorted(int.from_bytes(c.encode().ljust(3, b"\0")) for c in _WIDE))


def bound(words: int) -> int:
    """Edits that are allowed between two lines, by the words of the shorter one."""
    return min(EDITS, words // WORDS_PER_EDIT)


def _ranges(most: int) -> Iterator[tuple[int, int, int, int]]:
    """(least, end, edits, words of a piece) of each range of lengths of a shorter line, up to those of lines of `most` words."""
    low = LONG
    while low <= most:
        edits = bound(low)
        end = max(int(low * RANGE), low + 1) if edits == EDITS else (edits + 1) * WORDS_PER_EDIT
        # e + 1 stretches, of which the inner ones have a word more
        yield low, end, edits, (low - edits + 1) // (edits + 1)
        low = end


class Hashed:
    """Some lines by the hashes of their words."""

    def __init__(self, words: np.ndarray, size: np.ndarray):
        """words: of all lines, one after another; size: words of each line."""
        self.words, self.size = words, size
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.running = B.sums(self.words)

    @classmethod
    def of(cls, lines: list[list[str]]) -> Hashed:
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        return cls(np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lines)), np.uint64, int(size.sum())), size)

    def _stretches(self, line: np.ndarray, at: np.ndarray, size: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Keys of the stretches of `size` words from word `at` of each line on; those with one tag and equal words have equal keys, and keys only choose what is looked at."""
        a = self.start[line] + at
        return B.mix(B.span_keys(self.running, a, a + size) + tag.astype(np.uint64))

    def halves(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, signed size, key) of the stretches that a line one edit apart must share one of: the first and the last half, rounded down and up; sizes from the end are negative."""
        n = self.size[some]
        odd = n % 2 == 1
        line = np.concatenate([some] * 2 + [some[odd]] * 2)
        size = np.concatenate([n // 2, -(n // 2), n[odd] // 2 + 1, -(n[odd] // 2 + 1)])
        return line, size, self._stretches(line, np.where(size > 0, 0, self.size[line] + size), np.abs(size), size)

    def pieces(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of the pieces of some lines; two lines of LONG words or more that are near have one in common."""
        n, parts = self.size[some], [(np.zeros(0, np.int64),) * 4]
        for k, (low, end, edits, size) in enumerate(_ranges(int(n.max(initial=0)))):
            line = some[(n >= low) & (n < end + edits)]
            last = self.size[line] - size
            inner = [(1, np.full(len(line), size + x)) for x in (0, 1)] + [(2, last - size - x) for x in (0, 1) if edits > 2]
            for kind, at in [(0, np.zeros(len(line), np.int64)), *inner, (3, last)]:
                parts.append((line, at, np.full(len(line), size), np.full(len(line), 4 * k + kind)))
        line, at, size, tag = (np.concatenate(x) for x in zip(*parts, strict=True))
        return line, self._stretches(line, at, size, tag)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, key of 44 bits), another filter than pieces(), with over twice the keys: of each line the different runs of GRAM words that are least by key, one more than its edits can touch."""
        h, none = self.words, np.zeros(0, np.uint64)
        if len(h) < GRAM:
            return none.astype(np.int64), none
        key = B.mix((self.running[GRAM:] - self.running[:-GRAM]) * B.powers(len(h))[1][: len(h) - GRAM + 1])
        owner = np.repeat(np.arange(len(self.size), dtype=np.uint64), self.size)[: len(key)]
        fits = np.arange(len(key)) + GRAM <= np.repeat(self.end, self.size)[: len(key)]
        both = np.sort(owner[fits] << np.uint64(44) | key[fits] >> np.uint64(20))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        owner = (both >> np.uint64(44)).astype(np.int64)
        n = np.bincount(owner, minlength=len(self.size))
        least = GRAM * np.minimum(EDITS, self.size // WORDS_PER_EDIT) + 1
        few = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(least, n)
        return owner[few], both[few] << np.uint64(20)

    def signs(self, some: np.ndarray) -> np.ndarray:
        """Two words of 64 parities for each of some lines with words: how often, modulo 2, its words' hashes have each residue."""
        out, words = np.zeros((len(some), 2), np.uint64), self.words[np.repeat(np.isin(np.arange(len(self.size)), some), self.size)]
        size = self.size[some]
        for i in range(2 if len(some) else 0):
            bits = np.uint64(1) << (words >> np.uint64(6 * i) & np.uint64(63))
            out[:, i] = np.bitwise_xor.reduceat(bits, np.cumsum(size) - size)
        return out


def _within(a: list[str], b: list[str], edits: int) -> bool:
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b or edits == 0 or edits == 1:
        return max(len(a), len(b)) <= edits
    return _within(a[1:], b[1:], edits - 1) or _within(a[1:], b, edits - 1) or _within(a, b[1:], edits - 1)


def near(a: list[str], b: list[str]) -> bool:
    """Whether so many inserted, deleted or replaced words, at most, as the shorter one's length allows make two lines equal."""
    return _within(a, b, bound(min(len(a), len(b))))


class Lines:
    """The lines of a block that have words: row in the block, number in the text, and where the words lie."""

    def __init__(self, row):
        self.data, offsets = B.texts(row)
        n = len(self.data)
        self.raw = self.data.tobytes()
        kinds = np.frombuffer(self.raw.translate(_KINDS), np.uint8)
        word = kinds != 1
        at = np.flatnonzero(kinds == 2)
        if len(at):
            data = np.append(self.data, np.zeros(2, np.uint8))
            b = [data[at + i].astype(np.int64) for i in range(3)]
            two = b[0] == 0xC2
            code = b[0] << 16 | b[1] << 8 | np.where(two, 0, b[2])
            wide = np.isin(code, _CODES)
            for i in range(3):
                word[at[wide & ~(two & (i == 2))] + i] = False
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edge = offsets[offsets < n]
        start[edge] = word[edge]
        edge = offsets[offsets > 0] - 1
        end[edge] = word[edge]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        breaks = np.flatnonzero(self.data == 10)
        new = np.zeros(len(self.start) + 1, bool)
        new[np.searchsorted(self.start, offsets[:-1])] = True
        new[np.searchsorted(self.start, breaks)] = True
        new = new[:-1]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(new)))
        self.row = np.searchsorted(offsets, self.start[self.first], "right") - 1
        self.number = np.searchsorted(breaks, self.start[self.first]) - np.searchsorted(breaks, offsets)[self.row]
        # lines whose words have one blank between them are cut out as they stand
        single = new.copy()
        single[1:] |= (self.start[1:] - self.end[:-1] == 1) & (self.data[self.end[:-1]] == 32)
        self.plain = np.logical_and.reduceat(single, self.first) if len(self.first) else single
        last = self.first + self.size - 1
        self.spans = list(zip(self.start[self.first].tolist(), self.end[last].tolist(), self.plain.tolist(), strict=True))

    def line(self, i: int) -> bytes:
        """The words of a line, one blank between them."""
        a, b, plain = self.spans[i]
        return self.raw[a:b] if plain else " ".join(self.raw[a:b].decode("utf-8", "replace").split()).encode()

    def keys(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(self.line(i)) for i in range(len(self.spans))), np.uint64, len(self.spans))

    def hashed(self) -> Hashed:
        """All lines by hashes of their words: equal words have equal ones, and they only choose what is looked at."""
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):  # words of one slice of the block
            a = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, a + _SLICE, "right")))
            running = B.sums(B.letters(self.data[a : self.end[j - 1]]))
            out[i:j] = B.span_keys(running, self.start[i:j] - a, self.end[i:j] - a)
            i = j
        return Hashed(out, self.size)


_ROLL = W.Rolling(31, 23), W.Rolling(31, 29)


def _deleted(other: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, deleted place or -1, 124 bits as four numbers): each sequence whole and without each of its words, in linear time."""
    n, p = len(other.words), np.uint64(_ROLL[0].prime)
    owner = np.repeat(np.arange(len(other.size)), other.size)
    at, start, end = np.arange(n), other.start[owner], other.end[owner]
    parts = []
    for roll in _ROLL:
        for base, v in zip(roll.bases, roll.of_numbers(other.words), strict=True):
            up, down = roll.powers(base, n + 1), roll.powers(pow(base, -1, roll.prime), n + 2)
            x = v * up[:n]
            running = np.zeros(n + 1, np.uint64)
            np.cumsum((x & p) + (x >> np.uint64(31)), out=running[1:])
            head = (running[at] - running[start]) % p * down[start] % p
            tail = (running[end] - running[at + 1]) % p * down[start + 1] % p
            whole = (running[other.end] - running[other.start]) % p * down[other.start] % p
            parts.append(np.concatenate([whole, (head + tail) % p]).astype(np.uint32))
    return np.concatenate([np.arange(len(other.size)), owner]), np.concatenate([np.full(len(other.size), -1), at - start]), np.stack(parts, axis=1)


def _variants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_128_digest

    def made(lids: list, kept: list, other: list) -> pd.DataFrame:
        owner, place, key = _deleted(Hashed.of(other))
        key ^= np.frombuffer(b"".join(kept), np.uint32).reshape(-1, 4)[owner]
        raw = key.tobytes()
        doc, line, lid = (np.array(x, t)[owner] for x, t in zip(zip(*lids, strict=True), (np.int64, np.int32, object), strict=True))
        return pd.DataFrame({"variant": [raw[i : i + 16] for i in range(0, len(raw), 16)], "pos": place.astype(np.int32), "doc": doc, "line": line, "lid": lid})

    for pdf in frames:
        lids, kept, other, held = [], [], [], 0
        for *lid, text, halves in zip(pdf["doc"], pdf["line"], pdf["lid"], pdf["words"], pdf["halves"], strict=True):
            words = text.split(" ")
            for size in halves:
                own, rest = (words[:size], words[size:]) if size > 0 else (words[size:], words[:size])
                lids.append(lid)
                kept.append(digest(f"{size} {' '.join(own)}"))
                other.append(rest)
                held += len(rest)
            if held > 50_000:
                yield made(lids, kept, other)
                lids, kept, other, held = [], [], [], 0
        if lids:
            yield made(lids, kept, other)


def _near_drops(cand: DataFrame) -> DataFrame:
    """lid, partner: short lines and an earlier line that by hashes is near, once for each lid. cand: lid, words, halves, first (their earliest place)."""
    n = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = cand.select("first.doc", "first.line", "lid", "words", "halves").repartition(n).mapInPandas(_variants, VARIANTS)
    emitted = scratch.stored(emitted.select("variant", "pos", F.struct("doc", "line", "lid").alias("o"), (F.col("pos") == -1).alias("whole")), "variants")
    ends = F.min("o.lid").alias("a"), F.max("o.lid").alias("b"), F.min(F.when(~F.col("whole"), F.col("o"))).alias("cut"), F.min(F.when(F.col("whole"), F.col("o"))).alias("self")
    least = emitted.groupBy("variant").agg(*ends).filter("a < b").drop("a", "b")
    rows = scratch.stored(emitted.join(least, "variant"), "shared")
    place = rows.filter("not whole").groupBy("variant", "pos").agg(F.min("o").alias("same"))
    earlier = lambda c: F.when(F.col(c) < F.col("o"), F.col(c))
    cuts = rows.filter("not whole").join(place, ["variant", "pos"]).select("o", F.least(earlier("same"), earlier("self")).alias("p"))
    wholes = rows.filter("whole").select("o", earlier("cut").alias("p"))
    return cuts.union(wholes).filter("p is not null").groupBy(F.col("o.lid").alias("lid")).agg(F.min("p").alias("p")).select("lid", F.col("p.lid").alias("partner"))


def _verified(found: DataFrame, cand: DataFrame) -> DataFrame:
    """The rows (lid, partner) of found whose lines are near by edit distance."""

    @F.pandas_udf("boolean")
    def holds(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)

    texts = cand.select("lid", "words")
    both = found.join(texts, "lid").join(texts.select(F.col("lid").alias("partner"), F.col("words").alias("other")), "partner")
    return both.filter(holds("words", "other")).select("lid", "partner")


def _reduced(i: np.ndarray, j: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all (i, j, away): for each i the least j and the j least away, and whether these are all there are."""
    order = np.lexsort((j, i))
    i, j, away = i[order], j[order], away[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(i)))
    alike = np.lexsort((j, away, i))[first] if len(i) else first
    both = n - (alike != first) <= 1
    other = alike != first
    return np.concatenate([i[first], i[alike[other]]]), np.concatenate([j[first], j[alike[other]]]), np.concatenate([both, both[other]])


def _compared(unit: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
    """lid, partner, sure, each pair once, of the rows that ask: the earliest and the most alike of the earlier lines of their unit that may be near, and whether these are all.

    With words, the partner is verified and sure.
    """
    doc, line, size = (rows[c].to_numpy(np.int64) for c in ("doc", "line", "size"))
    order = np.lexsort((line, doc, unit))
    unit, doc, line, size = unit[order], doc[order], line[order], size[order]
    signs, asks = np.stack([rows["sign"], rows["sign_2"]], axis=1).view(np.uint64)[order], rows["asks"].to_numpy(bool)[order]
    who, lids = pd.factorize(rows["lid"].to_numpy()[order])
    n = len(unit)
    new = np.concatenate([[True], unit[1:] != unit[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # lines at the same place don't count as earlier than each other
    fresh = new | np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])])
    before = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))

    def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        allowed = np.minimum(EDITS, np.minimum(size[i], size[j]) // WORDS_PER_EDIT)
        away = np.bitwise_count(signs[i] ^ signs[j]).astype(np.int64)
        ok = (away <= 2 * allowed[..., None]).all(axis=-1) & (np.abs(size[i] - size[j]) <= allowed)
        return i[ok], j[ok], away[ok].sum(axis=-1)

    def pairs(i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> pd.DataFrame:
        pair, at = np.unique(who[i] * len(lids) + who[j], return_inverse=True)
        every = np.ones(len(pair), bool)
        every[at[~sure]] = False
        return pd.DataFrame({"lid": lids[pair // max(1, len(lids))], "partner": lids[pair % max(1, len(lids))], "sure": every})

    some = np.flatnonzero(asks & (before > start))
    words = [x.split(" ") for x in rows["words"].iloc[order]] if "words" in rows else None
    if words is not None:
        found = []
        for i in some.tolist():
            j = np.arange(start[i], before[i])
            _, few, _ = close(np.full(len(j), i), j)
            found += [(i, j) for j in [j for j in few.tolist() if near(words[j], words[i])][:1]]
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pairs(i, j, np.ones(len(i), bool))
    small = some[before[some] - start[some] <= _FEW]
    parts = [(np.zeros(0, np.int64),) * 3]
    for back in range(1, int((small - start[small]).max(initial=0)) + 1):  # all units side by side
        i = small[(small - back >= start[small]) & (small - back < before[small])]
        parts.append(close(i, i - back))
    out = [_reduced(*(np.concatenate(x) for x in zip(*parts)))]
    for i in some[before[some] - start[some] > _FEW].tolist():
        j = np.arange(start[i], before[i])
        out.append(_reduced(*close(np.full(len(j), i), j)))
    return pairs(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _partners(rows: DataFrame, n_bytes: int) -> DataFrame:
    """lid, partner, sure among lines that share a piece (piece, lid, doc, line, size, sign, sign_2, asks and, to verify at once, words)."""
    sizes = rows.groupBy("piece").agg(F.count("*").alias("n"))
    large = scratch.stored(sizes.filter(F.col("n") > PART).select("piece", F.ceil(F.col("n") / PART).alias("parts")), "large")
    tasks = max(1, rows.count() // TASK_ROWS, n_bytes // TASK_BYTES)
    own = F.pmod(F.xxhash64("lid"), "parts")
    parted = rows.join(large, "piece", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.struct("piece", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    parted = parted.withColumn("unit", F.xxhash64(pair)).withColumn("task", F.when(F.col("parts") > 1, F.col("unit")).otherwise(F.pmod("unit", F.lit(tasks))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _compared(pdf["unit"].to_numpy(), pdf)
        release()
        return out

    return parted.drop("piece", "parts", "own", "other").groupBy("task").applyInPandas(compare, "lid binary, partner binary, sure boolean")


def _drops(cand: DataFrame) -> DataFrame:
    """lid: lines that have an earlier near line. cand: lid, words, halves, pieces, signs, first (their earliest place)."""
    own = ["lid", "doc", "line", "size", "sign", "sign_2"]  # of a line, made before its pieces are dealt out
    rows = cand.filter("size(pieces) > 0").select("pieces", "lid", "first.doc", "first.line", (F.size(F.split("words", " "))).alias("size"), F.col("signs")[0].alias("sign"), F.col("signs")[1].alias("sign_2"))
    rows = rows.select(F.explode("pieces").alias("piece"), *own, F.lit(True).alias("asks"))  # not stored: cheaper to deal out again than to write
    pairs = _near_drops(cand.filter("size(halves) > 0")).withColumn("sure", F.lit(True)).union(_partners(rows, 0))
    found = scratch.stored(pairs.groupBy("lid", "partner").agg(F.min("sure").alias("sure")), "found")
    sure = scratch.stored(_verified(found.select("lid", "partner"), cand).select("lid").distinct(), "sure")
    rest = scratch.stored(found.filter("not sure").select("lid").distinct().join(sure, "lid", "left_anti"), "rest")
    if rest.isEmpty():
        return sure
    # lines that had more to offer than what was tried: their pieces again, with words
    shared = scratch.stored(rows.join(rest, "lid").select("piece").distinct(), "pieces")
    asking = rows.drop("asks").join(shared, "piece").join(rest.withColumn("asks", F.lit(True)), "lid", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    worded = scratch.stored(asking.join(cand.select("lid", "words"), "lid"), "worded")
    n_bytes = worded.agg(F.sum(F.length("words"))).first()[0] or 0
    return sure.union(_partners(worded, n_bytes).select("lid")).distinct()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the text rewritten, and _n_lines, _n_removed."""
    rest = [c for c in docs.columns if c != text_col]
    table = B.store(docs, id_col, text_col, carry=rest, level=1)
    bits = B.key_bits(table)

    def scan(row):
        """All lines with words and their keys; and of each different one that may be near another: halves, pieces, hashes of words."""
        lines = Lines(row)
        keys = lines.keys()
        some, once = np.flatnonzero(lines.size >= WORDS_PER_EDIT), np.zeros(len(keys), bool)
        once[some[np.unique(keys[some], return_index=True)[1]]] = True
        each, hashed = np.flatnonzero(once), lines.hashed()
        who, size, halves = hashed.halves(each[lines.size[each] <= LONG])
        which, pieces = hashed.pieces(each[lines.size[each] >= LONG])
        return lines, keys, B.Keys(keys, bits), (keys[who], size, B.Keys(halves, bits)), (which, pieces, B.Keys(pieces, bits)), hashed

    def ask(row):
        _, keys, by_line, (key, _, by_half), (which, _, by_piece), _ = scan(row)
        return pd.concat([by_line.tagged(row.block, 1), by_half.tagged(row.block, 2, key), by_piece.tagged(row.block, 3, keys[which])])

    answers = scratch.stored(B.repeated_by_kind(B.each(table, ask, B.TAGGED), bits), "lines")

    def emit(row, said):
        lines, keys, by_line, (key, size, by_half), (which, pieces, by_piece), hashed = scan(row)
        again = by_line.answered(said[said.kind == 1])
        shared, met = by_half.answered(said[said.kind == 2]), by_piece.answered(said[said.kind == 3])
        own_halves: dict[int, list[int]] = {}
        for k, h in zip(key[shared].tolist(), size[shared].tolist(), strict=True):
            own_halves.setdefault(k, []).append(h)
        who, own_pieces = keys[which[met]], {}
        for k, g in zip(who.tolist(), pieces[met].view(np.int64).tolist(), strict=True):
            own_pieces.setdefault(k, set()).add(g)
        far = np.unique(which[met])
        signs = dict(zip(keys[far].tolist(), hashed.signs(far).view(np.int64).tolist(), strict=True))
        out, sent, at = [], set(), np.flatnonzero(again | np.isin(keys, key[shared]) | np.isin(keys, who))
        for i, r, n, k in zip(at.tolist(), lines.row[at].tolist(), lines.number[at].tolist(), keys[at].tolist(), strict=True):
            doc, line = row.ids[r], lines.line(i)
            lid = xxhash.xxh3_128_digest(line)
            found, own = ([], []) if lid in sent else (own_halves.get(k, []), sorted(own_pieces.get(k, ())))
            sent.add(lid)
            out.append((lid, LAST if doc is None or doc != doc else int(doc), n, row.block, r, found, own, signs[k] if own else None, line.decode("utf-8", "replace") if found or own else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    places = scratch.stored(B.meet(table, answers, emit, LINES), "places")
    first = scratch.stored(places.groupBy("lid").agg(F.min(F.struct("doc", "line")).alias("first"), F.max("words").alias("words"), F.max("halves").alias("halves"), F.max("pieces").alias("pieces"), F.max("signs").alias("signs")), "first")
    drops = scratch.stored(_drops(first.filter("words is not null")), "drops")
    verdict = first.select("lid", "first").join(drops.select("lid", F.lit(True).alias("gone")), "lid", "left")
    gone = places.select("lid", "doc", "line", "block", "row").join(verdict, "lid").filter((F.struct("doc", "line") != F.col("first")) | F.col("gone"))
    cut = gone.groupBy("block").agg(F.collect_list(F.struct("row", "line")).alias("cut"))

    def rewrite(row, cut):
        drop: dict[int, set[int]] = {}
        for places in cut["cut"]:
            for p in places:
                drop.setdefault(p["row"], set()).add(p["line"])
        data, offsets = B.texts(row)
        raw, rows = data.tobytes(), []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text, removed = raw[a:b].decode("utf-8", "replace"), len(drop.get(i, ()))
            n_lines = text.count("\n") + 1
            if removed:
                text = "\n".join([x for n, x in enumerate(text.split("\n")) if n not in drop[i]])
            rows.append((None, 0, 0, row.extra[i]) if row.sizes[i] < 0 else (text, n_lines, removed, row.extra[i]))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "extra"])

    out = B.meet(table, cut, rewrite, "text string, n_lines long, n_removed long, extra string")
    back = F.from_json("extra", docs.select(*rest).schema)
    kept = out.withColumn("_row", back).select(*[F.col("text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns], F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"))
    return kept


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every text of documents without the lines that stand earlier, whole or but for a few words."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
