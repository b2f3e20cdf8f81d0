"""Blocks of rows, and an exchange of packed keys between them.

A *block* is one row that holds a few megabytes of consecutive texts (zstd) with their ids. Whole-corpus
questions such as "does this window start anywhere else?" are answered in rounds:

1. every block works out its keys in numpy, keeps each different key once and sends them, sorted, as one
   packed message per key range (*bucket*);
2. every bucket sees the keys of all blocks and answers each message with one bit per key (or a payload);
3. the answers go home and meet the block again.

Keys are de-duplicated inside a block before they travel, so a key that a third of all rows share costs a
bucket at most one entry per block. Buckets grow in number with the corpus; blocks have a bounded size. Blocks
are stored as a table bucketed by block number, so that the text itself isn't shuffled when answers arrive.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .memory import release, small_batches

BLOCK_BYTES = 4 << 20
#: Text that one key range stands for; sets the number of key ranges.
BUCKET_BYTES = 8 << 20
#: Text that one bucket of a block table stands for, at least, and key ranges that one task answers.
FILE_BYTES, RANGES_PER_TASK = 32 << 20, 4
#: A block is hashed in slices of so many positions, which bounds the hashing's arrays (not those with a number per position).
SLICE = 1 << 19

BLOCK = "block long, ids array<long>, sizes array<long>, data binary, n_bytes long, extra array<string>"
_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary()), ("n_bytes", pa.int64()), ("extra", pa.list_(pa.string()))])
MESSAGE = "bucket int, block long, n int, keys binary, local binary"
TAGGED = "kind int, bucket int, block long, n int, keys binary, local binary, tags binary"
ANSWER = "block long, kind int, bucket int, n int, bits binary"


def _pack(limit: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, base = 0, TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=level).compress
        ids: list[int | None] = []
        sizes: list[int] = []
        parts: list[bytes] = []
        extra: list[str | None] = []

        def block() -> pa.RecordBatch:
            data = b"".join(parts)
            out = pa.RecordBatch.from_arrays([pa.array([base + seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([squeeze(data)]), pa.array([len(data)]), pa.array([extra], pa.list_(pa.string()))], schema=_ARROW)
            for x in (ids, sizes, parts, extra):
                x.clear()
            return out

        held = 0
        for batch in batches:
            more = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for i, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True)):
                data = text.as_py()
                if more:
                    extra.append(more[i])
                ids.append(row)
                sizes.append(-1 if data is None else len(data))
                parts.append(data or b"")
                held += len(data or b"")
                if held >= limit:
                    yield block()
                    seq, held = seq + 1, 0
                    release()
        if ids:
            yield block()

    return pack


def store(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, level: int = 6) -> DataFrame:
    """The rows of docs as a stored table of blocks (columns BLOCK), bucketed by block; carry: more columns to keep, as JSON; level: zstd's."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.to_json(F.struct(*[docs[c] for c in carry])).alias("extra")] if carry else []))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return by_block(rows.mapInArrow(_pack(block_bytes, level), BLOCK), max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // FILE_BYTES))


def by_block(rows: DataFrame, n: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """Write rows with a column block as a table bucketed by it, into n buckets or as many as the table `like` has.

    Tables that are bucketed alike meet without a shuffle. They stay in the catalogue, since results are lazy, until drop_tables().
    """
    spark = rows.sparkSession
    n = n or like._buckets
    table = f"blocks_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "none").option("path", scratch.path(spark, "blocks")).bucketBy(n, "block").saveAsTable(table)
    out = spark.table(table)
    out._buckets, out._table = n, table
    return out


def _drop(spark, table: str) -> None:
    at = spark.sql(f"describe table extended {table}").filter("col_name = 'Location'").first()
    spark.sql(f"drop table if exists {table}")
    scratch.delete(spark, at.data_type)


def forget(table: DataFrame) -> None:
    """Delete a block table that nothing reads any more: what was made of it has been written."""
    _drop(table.sparkSession, table._table)


def drop_tables(spark) -> None:
    """Delete all block tables of the catalogue, when no result that was made of them will be read again."""
    for t in spark.catalog.listTables(pattern="blocks_*"):
        _drop(spark, t.name)


def key_bits(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """log2 of the number of key ranges, by the size of the whole corpus."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(6, int(total // bucket_bytes).bit_length())


def dealt(messages: DataFrame, bits: int, *more: str) -> DataFrame:
    """Messages by key range, over tasks whose number grows with that of the key ranges."""
    n = max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // RANGES_PER_TASK)
    return messages.repartition(n, *more, "bucket")


def squeeze(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    planes = np.empty(rows.T.shape, np.uint8)
    for i in range(x.itemsize):  # plane by plane: far faster than one copy of the transposed numbers
        planes[i] = rows[:, i]
    return zstandard.ZstdCompressor(level=1).compress(planes)


def raw(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def expand(data: bytes, dtype) -> np.ndarray:
    """The numbers that squeeze() got."""
    planes, width = np.frombuffer(raw(data), np.uint8), np.dtype(dtype).itemsize
    planes = planes.reshape(width, len(planes) // width)
    rows = np.empty(planes.T.shape, np.uint8)
    for i in range(width):
        rows[:, i] = planes[i]
    return rows.view(dtype).ravel()


def texts(row) -> tuple[np.ndarray, np.ndarray]:
    """A block's bytes, and the offsets of its texts in them (one more than texts)."""
    sizes = np.maximum(np.asarray(row.sizes, np.int64), 0)
    data = zstandard.ZstdDecompressor().decompress(row.data, max_output_size=max(1, int(row.n_bytes)))
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x5851F42D4C957F2D)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POW.get("up", ())) < n:
        n = max(n, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POW[name] = np.cumprod(x, dtype=np.uint64)
    return _POW["up"], _POW["down"]


def sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, with a zero before the first."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_keys(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of the spans [start, end) of what sums() ran over; equal contents have equal keys wherever they stand."""
    return mix((running[end] - running[start]) * powers(len(running))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def letters(data: np.ndarray) -> np.ndarray:
    """A number for each byte, to be summed by sums()."""
    return _BYTE[data]


def byte_keys(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, keys of all byte windows of this length that start in the slice), slice by slice."""
    up, down = powers(SLICE + length)
    for a in range(0, len(data) - length + 1, SLICE):
        b = min(a + SLICE, len(data) - length + 1)
        x = _BYTE[data[a : b + length - 1]]
        x *= up[: len(x)]
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=c[1:])
        yield a, mix((c[length:] - c[:-length]) * down[: b - a])


def whole(offsets: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions start a window of this length that stays in one text."""
    steps = np.zeros(n + 1, np.int64)
    size = np.diff(offsets)
    fits = size >= length
    np.add.at(steps, offsets[:-1][fits], 1)
    np.add.at(steps, offsets[1:][fits] - length + 1, -1)
    return np.cumsum(steps[:n]) > 0


class Keys:
    """The different keys of a block in order, cut into key ranges."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.order = np.argsort(keys, kind="stable") if len(keys) else np.zeros(0, np.int64)
        s = keys[self.order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        self.where = np.flatnonzero(first)
        self.unique = s[self.where]
        self.group = np.cumsum(first) - 1
        self.often = np.diff(np.append(self.where, len(s))) > 1
        self.cuts = np.searchsorted(self.unique, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        self.cuts = np.append(self.cuts, len(self.unique))
        self.bits = bits

    def messages(self, block: int, short: bool = False) -> pd.DataFrame:
        """One row per key range that has keys. short: 32 bits of a key beyond its range travel, enough for a filter."""
        rows = []
        for b in np.flatnonzero(np.diff(self.cuts)):
            part = slice(self.cuts[b], self.cuts[b + 1])
            keys = self.unique[part]
            if short:
                keys = np.diff(((keys << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))
            rows.append((int(b), block, len(keys), squeeze(keys) if short else keys.tobytes(), np.packbits(self.often[part]).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "keys", "local"])

    def tagged(self, block: int, kind: int, tags: np.ndarray | None = None) -> pd.DataFrame:
        """messages() with a kind; with tags (one for each key), a key is repeated only if it comes with different ones."""
        out = self.messages(block)
        out["kind"], out["tags"] = kind, None
        if tags is not None:
            t = tags[self.order]
            low = np.minimum.reduceat(t, self.where) if len(t) else t
            differ = low != np.maximum.reduceat(t, self.where) if len(t) else np.zeros(0, bool)
            parts = [slice(a, a + n) for a, n in zip(self.cuts[out["bucket"].to_numpy(int)], out["n"], strict=True)]
            out["tags"] = [low[p].tobytes() for p in parts]
            out["local"] = [np.packbits(differ[p]).tobytes() for p in parts]
        return out[[c.split()[0] for c in TAGGED.split(", ")]]

    def answered(self, answers: pd.DataFrame) -> np.ndarray:
        """For each key, in the order given at first: the bit that its range answered."""
        found = np.zeros(len(self.unique), bool)
        for b, n, bits in zip(answers.bucket, answers.n, answers.bits, strict=True):
            found[self.cuts[b] : self.cuts[b] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        out = np.zeros(len(self.order), bool)
        out[self.order] = found[self.group]
        return out


def _repeated(kind: int, short: bool = False) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(expand(x, np.uint32), dtype=np.uint32) if short else np.frombuffer(x, "<u8") for x in pdf["keys"]]
        local = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(pdf["local"], pdf["n"], strict=True)]
        s = np.sort(np.concatenate(keys))
        twice = s[1:][s[1:] == s[:-1]]
        bits = []
        for k, own in zip(keys, local, strict=True):
            at = np.searchsorted(twice, k)
            at[at == len(twice)] = 0
            bits.append(np.packbits(own | (twice[at] == k if len(twice) else False)).tobytes())
        return pd.DataFrame({"block": pdf["block"], "kind": kind, "bucket": pdf["bucket"], "n": pdf["n"], "bits": bits})

    return answer


def _differing(pdf: pd.DataFrame) -> pd.DataFrame:
    """As _repeated, but a key's bit is set if it came with different tags."""
    keys = [np.frombuffer(x, "<u8") for x in pdf["keys"]]
    local = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(pdf["local"], pdf["n"], strict=True)]
    k, t = np.concatenate(keys), np.concatenate([np.frombuffer(x, "<u8") for x in pdf["tags"]])
    order = np.argsort(k)  # a key's tags are all equal if each equals the next, in any order
    s, t = k[order], t[order]
    mixed = s[1:][(s[1:] == s[:-1]) & (t[1:] != t[:-1])]
    mixed = np.unique(np.concatenate([mixed, k[np.concatenate(local)]]))
    bits = []
    for k in keys:
        at = np.searchsorted(mixed, k)
        at[at == len(mixed)] = 0
        bits.append(np.packbits(mixed[at] == k if len(mixed) else np.zeros(len(k), bool)).tobytes())
    return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "bucket": pdf["bucket"], "n": pdf["n"], "bits": bits})


def repeated_by_kind(messages: DataFrame, bits: int) -> DataFrame:
    """Answers to tagged messages of several kinds at once."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        return _differing(pdf) if pdf["tags"].notna().any() else _repeated(int(pdf["kind"].iloc[0]))(pdf)

    return dealt(messages, bits, "kind").groupBy("kind", "bucket").applyInPandas(answer, ANSWER)


def shared(messages: DataFrame, bits: int) -> DataFrame:
    """Answers (columns ANSWER) to short messages: a bit is set if the key occurs more than once in the corpus, and for others now and then."""
    return dealt(messages, bits).groupBy("bucket").applyInPandas(_repeated(1, short=True), ANSWER)


def meet(blocks: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(block row, its answers) -> pandas rows, for every block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [work(row, right) for row in left.itertuples(index=False)]
        release()
        return found[0] if len(found) == 1 else pd.concat(found)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def each(blocks: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(block row) -> pandas rows, for every block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                yield work(row)
                release()

    return blocks.mapInPandas(run, schema)
