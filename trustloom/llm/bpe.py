"""BPE encoding and decoding of a corpus through a table of its distinct words.

Texts are split at white space (as the tokenizer's own pattern sees it). Every block keeps each of its distinct words
once and deals them to key ranges; a range encodes each distinct word once with the tokenizer and answers with its
ids. In the block, ids are joined back by position. No pre-token of the tokenizer spans white space, and neither
normalisation nor added tokens reach across it, so the ids of a text are those of its words in order. Decoding joins ids to
the vocabulary's pieces; a tokenizer without a decoder joins pieces by one space.

Nulls and empty texts, and texts of white space only: no ids, decoded to the empty string. Repeated rows and ids: each row gets a
row. Null ids stay null. Columns other than the two named are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .memory import release

WORDS = "bucket int, block long, n int, words binary"
CODES = "block long, bucket int, n int, counts binary, ids binary"
#: Words that the tokenizer gets at once; its answers are far larger than the words.
ENCODED = 4096
OUT = "doc_id long, ids binary, n_tokens long, decoded string"

# White space as the tokenizer's pattern engine knows it. str.split() also splits at these four.
_MORE = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")


def split(text: str) -> list[str]:
    """The stretches of a text without white space."""
    return _WORD.findall(text) if _MORE.search(text) else text.split()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[str]:
    """Pieces by id; as many as the vocabulary has, whatever the corpus."""
    found = _tokenizer(path)
    return [found.id_to_token(i) or "" for i in range(max(found.get_vocab(with_added_tokens=True).values()) + 1)]


def _texts(row) -> Iterator[list[str]]:
    """The words of each text of a block, one text at a time: all words of a block at once are many times its bytes."""
    data, offsets = B.texts(row)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield split(data[a:b].tobytes().decode("utf-8"))


def _distinct(row) -> list[str]:
    seen: set[str] = set()
    for text in _texts(row):
        seen.update(text)
    return sorted(seen)


def _ranges(words: list[str], bits: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - bits) for w in words), np.int64, len(words))


def encode_corpus(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Per document: its token ids (little-endian unsigned 32-bit), how many, and what they decode to."""
    table = B.store(docs, id_col, text_col)
    bits = B.key_bits(table)

    def distinct(row):
        words = _distinct(row)
        bucket = _ranges(words, bits)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rows = [(int(b), row.block, int(cuts[b + 1] - cuts[b]), squeeze(" ".join([words[i] for i in order[cuts[b] : cuts[b + 1]]]).encode())) for b in np.flatnonzero(np.diff(cuts))]
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "words"])

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        tokenizer = _tokenizer(tokenizer_path)
        expand = zstandard.ZstdDecompressor().decompress
        lists = [expand(x).decode().split(" ") for x in pdf["words"]]
        table = dict.fromkeys(w for words in lists for w in words)
        every = list(table)
        for a in range(0, len(every), ENCODED):
            words = every[a : a + ENCODED]
            for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
                table[w] = e.ids
        release()
        counts, ids = [], []
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for words in lists:
            found = [table[w] for w in words]
            counts.append(squeeze(np.fromiter(map(len, found), "<u4", len(found)).tobytes()))
            ids.append(squeeze(np.fromiter((i for x in found for i in x), "<u4").tobytes()))
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "n": pdf["n"], "counts": counts, "ids": ids})

    codes = B.each(table, distinct, WORDS).groupBy("bucket").applyInPandas(encode, CODES)

    def join(row, answers):
        words = _distinct(row)
        bucket = _ranges(words, bits)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        expand = zstandard.ZstdDecompressor().decompress
        pieces = _pieces(tokenizer_path)
        ids_of, text_of = {}, {}
        for b, counts, ids in zip(answers["bucket"], answers["counts"], answers["ids"], strict=True):
            ids = expand(ids)
            end = np.cumsum(np.frombuffer(expand(counts), "<u4")).tolist()
            values = np.frombuffer(ids, "<u4").tolist()
            a = 0
            for i, z in zip(order[cuts[b] : cuts[b + 1]].tolist(), end, strict=True):
                ids_of[words[i]] = ids[4 * a : 4 * z]
                if decode and z > a:
                    text_of[words[i]] = " ".join([pieces[v] for v in values[a:z]])
                a = z
        rows = []
        for i, text in enumerate(_texts(row)):
            ids = b"".join([ids_of[w] for w in text])
            rows.append((row.ids[i], ids, len(ids) // 4, " ".join([text_of[w] for w in text if w in text_of]) if decode else None))
        return pd.DataFrame(rows, columns=["doc_id", "ids", "n_tokens", "decoded"]).astype({"doc_id": "Int64"})

    return B.meet(table, codes, join, OUT)


def word_table(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """The distinct words of a corpus with the ids of each: word, ids."""
    found = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+")).alias("word")).filter("word <> ''").distinct()

    def encode(frames):
        for pdf in frames:
            pdf["ids"] = [e.ids for e in _tokenizer(tokenizer_path).encode_batch(pdf["word"].tolist(), add_special_tokens=False)]
            yield pdf

    return found.mapInPandas(encode, "word string, ids array<int>")


def piece_table(spark, tokenizer_path: str) -> DataFrame:
    """The vocabulary: id, piece. Its size is the tokenizer's, not the corpus's."""
    return spark.createDataFrame(list(enumerate(_pieces(tokenizer_path))), "id int, piece string")


def decode_ids(coded: DataFrame, tokenizer_path: str, key_col: str, ids_col: str) -> DataFrame:
    """key, decoded: the pieces of an array of ids, joined by one space, by a join with the (bounded) vocabulary."""
    each = coded.select(F.col(key_col).alias("key"), F.posexplode_outer(ids_col).alias("at", "id"))
    named = each.join(F.broadcast(piece_table(coded.sparkSession, tokenizer_path)), "id", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))), lambda x: x["piece"]), " ")
    return named.groupBy("key").agg(text.alias("decoded"))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded; digests of both."""
    import public_tokenizers

    out = encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
