"""Language identification with a bidirectional gated recurrent network over bytes.

Two small GRUs read a stretch of bytes from either end; a softmax over both states labels every position, and a
document's probabilities are the mean over all positions of the whole text. Texts are cut into stretches of a fixed number of
bytes so that all stretches advance together; nothing is left out. The network is trained in numpy by
backpropagation through time on a bounded sample of labelled rows (`sample`; of different texts the smallest hashes win, so
that the choice doesn't depend on partitioning), of which it reads PLACES stretches spread evenly over the whole text; languages are the labels
that the training rows hold, all of them.

Nulls, and texts with no letter: `und`, score 0. Very long texts: stretch by stretch, in bounded batches. No training rows:
every text with letters is `und` with score 0. Repeated rows get a row each; null ids stay null. Ties of probability: the label that
sorts first. The label, the source and the id are never inputs of a prediction. Columns of docs that are named like the two answers are replaced by
them; other columns stay whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import release, small_batches

HIDDEN = 8
STRETCH = 96
BATCH = 2048
#: What stands for no byte.
PAD = 256
#: Labelled rows that training uses, and stretches of each.
SAMPLE, PLACES = 1600, 16
#: Updates, whatever the sample's size, and stretches in each.
UPDATES, UPDATE_ROWS = 400, 256
LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _run(table: np.ndarray, u: np.ndarray, x: np.ndarray, mask: np.ndarray | None, keep: bool):
    """States of one GRU over the columns of x (batch by time); mask holds the state where a text has ended."""
    h_size = u.shape[0]
    h = np.zeros((len(x), h_size), np.float32)
    states, kept = [], []
    for t in range(x.shape[1]):
        a = table[x[:, t]]
        g = h @ u
        zr = _sigmoid(a[:, : 2 * h_size] + g[:, : 2 * h_size])
        z, r = zr[:, :h_size], zr[:, h_size:]
        c = np.tanh(a[:, 2 * h_size :] + r * g[:, 2 * h_size :])
        new = h + z * (c - h)
        if mask is not None:
            new = np.where(mask[:, t, None], new, h)
        if keep:
            kept.append((h, z, r, c, g[:, 2 * h_size :]))
        states.append(new)
        h = new
    return states, kept


class Network:
    """Weights by name, and what they say about a batch of stretches."""

    def __init__(self, weights: dict[str, np.ndarray], langs: list[str]):
        self.w, self.langs = weights, langs

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 3) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {}
        for side in "fb":
            w[f"{side}x"] = normal(256, 3 * h, scale=0.3)
            w[f"{side}h"] = normal(h, 3 * h, scale=0.3)
        w["out"], w["bias"] = normal(2 * h, len(langs), scale=0.3), np.zeros(len(langs), np.float32)
        return cls(w, langs)

    def states(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        w = self.w
        fwd, kf = _run(w["fx"], w["fh"], x, mask, keep)
        bwd, kb = _run(w["bx"], w["bh"], x[:, ::-1], None if mask is None else mask[:, ::-1], keep)
        return np.concatenate([np.stack(fwd, 1), np.stack(bwd[::-1], 1)], axis=2), kf, kb

    def ready(self) -> dict[str, np.ndarray]:
        """The weights gate by gate, halved where a sigmoid is a tanh of half its input, and a row PAD that keeps the state."""
        h, out = HIDDEN, {}
        for side in "fb":
            x, u = self.w[f"{side}x"], self.w[f"{side}h"]
            for i, (gate, scale) in enumerate((("z", 0.5), ("r", 0.5), ("c", 1.0))):
                rows = np.vstack([x[:, i * h : (i + 1) * h] * np.float32(scale), np.full((1, h), -1e4 if gate == "z" else 0, np.float32)])
                out[f"{side}x{gate}"] = np.ascontiguousarray(rows, np.float32)
                out[f"{side}h{gate}"] = np.ascontiguousarray(u[:, i * h : (i + 1) * h] * np.float32(0.5))
        return out

    def positions(self, x: np.ndarray, ready: dict[str, np.ndarray]) -> np.ndarray:
        """Probabilities (language by time by text) at each position of x (time by text; PAD where a text has ended)."""
        states = {}
        for side, xs in (("f", x), ("b", x[::-1])):
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            a, g = {k: np.empty_like(h) for k in "zrc"}, {k: np.empty_like(h) for k in "zrc"}
            kept = np.empty((len(x), *h.shape), np.float32)
            for t in range(len(x)):
                for k in "zrc":
                    np.take(ready[f"{side}x{k}"], xs[t], axis=0, out=a[k], mode="clip")
                    np.dot(h, ready[f"{side}h{k}"], out=g[k])
                for k in "zr":
                    a[k] += g[k]
                    np.tanh(a[k], out=a[k])
                    a[k] += np.float32(1)
                g["c"] *= a["r"]
                a["c"] += g["c"]
                np.tanh(a["c"], out=a["c"])
                a["c"] -= h
                a["c"] *= a["z"]
                a["c"] *= np.float32(0.5)
                h = np.add(h, a["c"], out=kept[t])
            states[side] = kept if side == "f" else kept[::-1]
        n = len(self.langs)
        f = np.dot(self.w["out"][:HIDDEN].T, states["f"].reshape(-1, HIDDEN).T)
        b = np.dot(self.w["out"][HIDDEN:].T, np.ascontiguousarray(states["b"]).reshape(-1, HIDDEN).T)
        f += b
        f += self.w["bias"][:, None]
        f -= f.max(axis=0)
        np.exp(f, out=f)
        f /= f.sum(axis=0)
        return f.reshape(n, *x.shape)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        s, kf, kb = self.states(x, mask, keep=True)
        logit = s @ self.w["out"] + self.w["bias"]
        p = np.exp(logit - logit.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[np.arange(len(y)), :, y] -= 1
        p *= mask[:, :, None] / np.float32(mask.sum())
        grad = {"out": np.einsum("nth,ntl->hl", s, p), "bias": p.sum(axis=(0, 1))}
        ds = p @ self.w["out"].T
        h = HIDDEN
        for side, kept, dside, xs, ms in (("f", kf, ds[:, :, :h], x, mask), ("b", kb, ds[:, ::-1, h:], x[:, ::-1], mask[:, ::-1])):
            u = self.w[f"{side}h"]
            gx, gu = np.zeros_like(self.w[f"{side}x"]), np.zeros_like(u)
            dh = np.zeros((len(x), h), np.float32)
            for t in reversed(range(x.shape[1])):
                before, z, r, c, gc = kept[t]
                m = ms[:, t, None]
                dh = dh + dside[:, t]
                dn = np.where(m, dh, 0)
                da_c = dn * z * (1 - c * c)
                da_z = dn * (c - before) * z * (1 - z)
                da_r = da_c * gc * r * (1 - r)
                da = np.concatenate([da_z, da_r, da_c], axis=1)
                dg = np.concatenate([da_z, da_r, da_c * r], axis=1)
                np.add.at(gx, xs[:, t], da)
                gu += before.T @ dg
                dh = np.where(m, dn * (1 - z), dh) + dg @ u.T
            grad[f"{side}x"], grad[f"{side}h"] = gx, gu
        return grad

    def train(self, texts: list[bytes], labels: list[int], rate: float = 0.02, seed: int = 5) -> Network:
        x, mask, owner = stretches(texts)
        y = np.asarray(labels)[owner]
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, UPDATES + 1) if len(x) else ():
            if len(order) < UPDATE_ROWS:  # the sample is gone over again in another order
                order = np.concatenate([order, *[rng.permutation(len(x)) for _ in range(-(-UPDATE_ROWS // len(x)))]])
            part, order = order[:UPDATE_ROWS], order[UPDATE_ROWS:]
            now = rate * (1 - (step - 1) / UPDATES) + 1e-4
            for k, g in self.gradients(x[part], mask[part], y[part]).items():
                g = np.clip(g, -1, 1)
                mean[k] = np.float32(0.9) * mean[k] + np.float32(0.1) * g
                square[k] = np.float32(0.99) * square[k] + np.float32(0.01) * g * g
                self.w[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def stretches(texts: list[bytes], size: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts as rows of `size`, which of them are real, and whose they are."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = -(-lens // size)
    owner = np.repeat(np.arange(len(texts)), rows)
    start = np.concatenate([[0], np.cumsum(rows)[:-1]]) * size if len(rows) else rows
    x, mask = np.zeros(int(rows.sum()) * size, np.uint8), np.zeros(int(rows.sum()) * size, bool)
    at = np.arange(int(lens.sum())) + np.repeat(start - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) if len(lens) else np.zeros(0, np.int64)
    x[at] = np.frombuffer(b"".join(texts), np.uint8)
    mask[at] = True
    return x.reshape(-1, size), mask.reshape(-1, size), owner


def pooled(net: Network, texts: Iterable[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text, in batches of bounded size."""
    total, ready, lens = [], net.ready(), []
    pending: list[tuple[int, bytes]] = []

    def work() -> None:
        x, mask, owner = stretches([b for _, b in pending])
        ids = np.asarray([i for i, _ in pending])[owner]
        for a in range(0, len(x), BATCH):
            real = mask[a : a + BATCH].T
            p = net.positions(np.where(real, x[a : a + BATCH].T.astype(np.intp), PAD), ready)
            p *= real
            for row, share in zip(ids[a : a + BATCH].tolist(), p.sum(axis=1).T, strict=True):
                total[row] += share
        pending.clear()

    held, most = 0, STRETCH * BATCH * 4
    for i, text in enumerate(texts):
        total.append(np.zeros(len(net.langs)))
        lens.append(len(text))
        for a in range(0, len(text), most):
            pending.append((i, text[a : a + most]))
            held += -(-len(pending[-1][1]) // STRETCH) * STRETCH
            if held >= most:
                work()
                held = 0
    if pending:
        work()
    return np.asarray(total).reshape(-1, len(net.langs)) / np.maximum(1, np.asarray(lens, np.int64))[:, None]


def fit(labelled: DataFrame, text_col: str, lang_col: str, sample: int = SAMPLE) -> Network:
    """Train on at most `sample` labelled rows, as many of each language as there are, copies once."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}  # as many as there are languages
    langs = sorted(counts)
    if not langs:
        return Network.fresh(langs)
    each, parts = max(1, sample // len(langs)), 1 << 20
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(parts, 4 * each * parts // n + 1))])
    few = rows.filter(F.pmod("h", F.lit(parts)) < F.element_at(share, F.col("lang")))
    last = F.greatest(F.length("text") - STRETCH, F.lit(0))
    # a short text whole: its stretches would overlap
    spread = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.substring("text", F.floor(last * i / (PLACES - 1)).cast("int") + 1, F.lit(STRETCH)))
    pieces = F.when(F.length("text") <= STRETCH * PLACES, F.array("text")).otherwise(spread)
    few = few.select("lang", "h", pieces.alias("pieces")).dropDuplicates(["lang", "h"])
    best = few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(parts)), "h"))).filter(F.col("at") <= each)
    some = sorted(best.select("lang", "h", "pieces").collect())
    texts = [(p.encode("utf-8", "replace"), langs.index(r.lang)) for r in some for p in r.pieces]
    return Network.fresh(langs).train([t for t, _ in texts], [y for _, y in texts])


def predict(docs: DataFrame, net: Network, text_col: str, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with two more columns: the language with the highest pooled probability, and that probability."""
    small_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast((net.w, net.langs))  # a few kilobytes

    @F.pandas_udf("lang string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        net = Network(*packed.value)
        if not net.langs:
            return pd.DataFrame({"lang": "und", "score": 0.0}, index=texts.index)
        p = pooled(net, ((x or "").encode("utf-8", "replace") for x in texts))
        release()
        best = p.argmax(axis=1)
        return pd.DataFrame({"lang": [net.langs[i] for i in best], "score": np.clip(p.max(axis=1), 0, 1)})

    some = F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    said = label(F.when(some, F.col(text_col)))
    both = f"_said_{uuid.uuid4().hex}"
    lang, score = F.when(some, F.col(both)["lang"]).otherwise("und"), F.when(some, F.col(both)["score"]).otherwise(0.0)
    rest = [c for c in docs.columns if c not in (lang_out, score_out)]
    return docs.withColumn(both, said).select(*rest, lang.alias(lang_out), score.alias(score_out))


def held_out(id_col: str) -> Column:
    """Documents that take no part in learning: a quarter, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learnt from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    net = fit(docs.filter("not held_out"), "text", "lang")
    return predict(docs.drop("lang"), net, "text").select("doc_id", "held_out", "lang_pred", "score")
