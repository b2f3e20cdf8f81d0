"""Exact removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

A difference cover D modulo V meets every pair of positions i, j at some offset d < V with i+d and j+d both in
the cover. Its members are sampled in every block (12 of 133 positions) and *named* by the bytes that follow them,
far enough (min_bytes - V + 1) that two equal strings of min_bytes must agree on the names at such an offset. Names are
compared over the whole corpus first, and all that is kept of a name is whether it is repeated. A suffix that has no
repeated name within V positions can't tie over min_bytes with any other, and needs no sorting; the rest is dealt to suffix buckets by
key range, and one bucket is sorted at a time. Ties of keys are proved by bytes, at the left end of every chain of ties (see
windows): no byte goes because of equal keys alone. The order inside a bucket is the keys', not the alphabet's: only ties
matter here. The README says what that replaces and why.

Nulls and empty texts: an empty string, nothing removed. Texts shorter than min_bytes: nothing removed. Rows
that repeat (same id, same text) are documents of their own and so repeat each other. Null ids stay null. Columns other
than the two named are not read, so their names can't clash. Memory: some thirty bytes for each byte of a block, and a
text longer than a block makes a block of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import scratch
from . import windows as W

#: Bits of a suffix key's second prime beyond those of the key range.
SECOND = 11
OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def difference_cover(q: int = 11) -> tuple[int, np.ndarray]:
    """The modulus q*q+q+1 and a perfect difference set of q+1 residues, for a prime q (Singer)."""
    v = q * q + q + 1
    # powers of a root of a primitive cubic over the field of q elements; those with no square term make a line
    for c in ((a, b, d) for a in range(1, q) for b in range(q) for d in range(q)):
        x, line, at = (1, 0, 0), [], 0
        while True:
            if x[2] == 0:
                line.append(at)
            lo, mid, hi = x
            x = (hi * c[0] % q, (lo + hi * c[1]) % q, (mid + hi * c[2]) % q)
            at += 1
            if x == (1, 0, 0) or at > q**3:
                break
        if at == q**3 - 1:
            found = np.unique(np.asarray(line) % v)
            if len(found) == q + 1 and len({(int(a) - int(b)) % v for a in found for b in found}) == v:
                return v, found
    raise ValueError(f"no difference set for {q}")


def _cover(q: int, min_bytes: int) -> tuple[int, np.ndarray, int]:
    v, residues = difference_cover(q)
    if min_bytes < v:
        raise ValueError(f"min_bytes must be {v} at least for q={q}")
    member = np.zeros(v, bool)
    member[residues] = True
    return v, member, min_bytes - v + 1


def _names(data: np.ndarray, offsets: np.ndarray, v: int, member: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a block and the keys of the bytes that follow them."""
    at, keys = [], []
    fits = B.whole(offsets, length, len(data))
    for a, k in B.byte_keys(data, length):
        take = np.flatnonzero(fits[a : a + len(k)] & np.resize(np.roll(member, -(a % v)), len(k)))
        at.append(take + a)
        keys.append(k[take])
    return (np.concatenate(at), np.concatenate(keys)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _suffixes(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, again: np.ndarray, v: int, min_bytes: int, rolling: W.Rolling, bits: int) -> W.Windows:
    """The suffixes that have a repeated name within reach; only stretches around them are read for keys."""
    marks = np.zeros(len(data) + v + 1, np.int32)
    marks[at[again] + 1] = 1
    np.cumsum(marks, out=marks)
    near = np.flatnonzero((marks[v : v + len(data)] > marks[: len(data)]) & B.whole(offsets, min_bytes, len(data)))
    keys = [np.zeros(0, np.uint64)]
    runs = W.runs_of(near)
    apart = np.flatnonzero(runs[1:, 0] - runs[:-1, 1] > min_bytes) + 1  # runs that lie closer are read together
    for part in np.split(runs, apart):
        if len(part):
            a, b = int(part[0, 0]), int(part[-1, 1])
            keys.append(rolling.keys(rolling.of_bytes(data[a : b + min_bytes - 1]), min_bytes)[W.positions(part - a)])
    before = data[np.maximum(near - 1, 0)].astype(np.uint16) << np.uint16(8)
    return W.Windows(near, np.concatenate(keys), [before | data[near + min_bytes - 1]], bits, spare=rolling.spare)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200, q: int = 11, block_bytes: int = B.BLOCK_BYTES, prime_bits: int = 31) -> DataFrame:
    """One row per document: sizes, the removed runs (byte offsets) and the bytes that are left.

    A byte goes if a string of min_bytes that covers it starts anywhere else too, in this or another document. Matches
    don't cross documents; strings are judged on the input. prime_bits: see windows.Rolling; the result doesn't depend on it.
    """
    v, member, length = _cover(q, min_bytes)
    table = B.store(docs, id_col, text_col, block_bytes=block_bytes)
    bits = B.key_bits(table)
    # the key grows with the corpus, so that unlike windows of one key stay in proportion to it
    rolling = W.Rolling(prime_bits, second_bits=min(31, bits + SECOND))

    def sample(row):
        data, offsets = B.texts(row)
        return B.Keys(_names(data, offsets, v, member, length)[1], bits).messages(row.block, short=True)

    names = scratch.stored(B.shared(B.each(table, sample, B.MESSAGE), bits), "names")

    def candidates(row, answers) -> tuple[np.ndarray, W.Windows]:
        data, offsets = B.texts(row)
        at, keys = _names(data, offsets, v, member, length)
        return data, _suffixes(data, offsets, at, B.Keys(keys, bits).answered(answers[answers.kind == 1]), v, min_bytes, rolling, bits)

    ties = W.judged(B.meet(table, names, lambda row, answers: candidates(row, answers)[1].messages(row.block), W.MESSAGE), bits)

    def settle(row, answers):
        data, own = candidates(row, answers)
        return own.state(row.block, answers[answers.kind == 2], lambda at: data[at : at + min_bytes].tobytes())

    answers = names.unionByName(ties.withColumn("kind", F.lit(2)))
    state = B.by_block(B.meet(table, answers, settle, W.STATE), like=table)

    def contents(row, at):
        data, _ = B.texts(row)
        return [data[i : i + min_bytes].tobytes() for i in at.tolist()]

    def cut(row, found):
        data, offsets = B.texts(row)
        runs = np.frombuffer(found["runs"].iloc[0], np.int64).reshape(-1, 2) if len(found) else np.zeros((0, 2), np.int64)
        gone = W.covered(runs, min_bytes, len(data))
        rows = []
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            rows.append((row.ids[i], b - a, int(own.sum()), [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)], data[a:b][~own].tobytes()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
        return out.astype({"doc_id": "Int64"})

    return B.meet(table, W.proved(state, table, contents, min_bytes), cut, OUT)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every text of documents, without the 200-byte strings that occur more than once."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
