"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauscope.llm.common import crc

#: Bytes of a chunk, bytes that neighbours share, bytes that a filter sees, and its step.
CHUNK, SHARED, WIDTH, STEP = 1024, 64, 8, 4


@dataclass
class Net:
    """Byte vectors, filters over WIDTH bytes, and weights of the pooled activations."""

    embed: np.ndarray    # 256 x dims
    kernel: np.ndarray   # WIDTH x dims x filters
    bias: np.ndarray     # filters
    weight: np.ndarray   # 2 * filters: of the maxima and of the mean over chunks of the maxima
    offset: np.ndarray   # 1

    @staticmethod
    def fresh(seed: int, dims: int = 8, filters: int = 16) -> Net:
        r = np.random.default_rng(seed)
        return Net(r.normal(0, 0.5, (256, dims)).astype(np.float32), r.normal(0, 0.2, (WIDTH, dims, filters)).astype(np.float32),
                   np.zeros(filters, np.float32), r.normal(0, 0.1, 2 * filters).astype(np.float32), np.zeros(1, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def chunks(text: str | None) -> np.ndarray:
    """The UTF-8 bytes of the whole text as rows of CHUNK bytes that overlap by SHARED; zeros fill up the last row."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-(len(data) - SHARED) // (CHUNK - SHARED)))
    padded = np.zeros((n - 1) * (CHUNK - SHARED) + CHUNK, np.uint8)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::CHUNK - SHARED]


def pooled(net: Net, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest activation of every filter in every chunk, and the byte at which its window starts."""
    tables = np.einsum("bd,wdf->wbf", net.embed, net.kernel)
    steps = (CHUNK - WIDTH) // STEP + 1
    act = tables[0][rows[:, 0:steps * STEP:STEP]]
    for w in range(1, WIDTH):
        act += tables[w][rows[:, w:w + (steps - 1) * STEP + 1:STEP]]
    best = act.argmax(axis=1)
    return np.take_along_axis(act, best[:, None], 1)[:, 0] + net.bias, best * STEP


def logits(net: Net, rows: np.ndarray, doc: np.ndarray, n: int, block: int = 512) -> np.ndarray:
    """One value per document from all its chunks; ``doc`` tells each chunk's document, in order."""
    f = len(net.bias)
    top, total = np.zeros((n, f), np.float32), np.zeros((n, f), np.float32)
    for at in range(0, len(rows), block):
        value = np.maximum(pooled(net, rows[at:at + block])[0], 0)
        np.maximum.at(top, doc[at:at + block], value)
        np.add.at(total, doc[at:at + block], value)
    mean = total / np.maximum(np.bincount(doc, minlength=n), 1)[:, None]
    return top @ net.weight[:f] + mean @ net.weight[f:] + net.offset[0]


def train(texts: list[str], labels: np.ndarray, seed: int = 7, steps: int = 1200, batch: int = 32, rate: float = 0.01) -> Net:
    """Fit by ``steps`` steps of Adam on the log-loss; only the window that wins a pool has a gradient."""
    net = Net.fresh(seed)
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in net.arrays()]
    rng, step, f = np.random.default_rng(seed), 0, len(net.bias)
    rows = [chunks(t) for t in texts]
    while step < steps:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            x = np.concatenate([rows[i] for i in part])
            sizes = np.array([len(rows[i]) for i in part])
            doc, first = np.repeat(np.arange(len(part)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            raw, start = pooled(net, x)
            value = np.maximum(raw, 0)
            top = np.maximum.reduceat(value, first)
            mean = np.add.reduceat(value, first) / sizes[:, None]
            p = 1 / (1 + np.exp(-(top @ net.weight[:f] + mean @ net.weight[f:] + net.offset[0])))
            g = ((p - labels[part]) / len(part)).astype(np.float32)
            wins = (value == top[doc]) & (raw > 0)
            wins = wins / np.maximum(np.add.reduceat(wins, first), 1)[doc]
            d = (g[doc, None] * (net.weight[:f] * wins + net.weight[f:] / sizes[doc, None]) * (raw > 0)).astype(np.float32)
            seen = x[np.arange(len(x))[:, None, None], start[:, :, None] + np.arange(WIDTH)]      # chunk, filter, width
            vec = net.embed[seen]
            kernel = np.einsum("cf,cfwd->wdf", d, vec)
            embed = np.zeros_like(net.embed)
            np.add.at(embed, seen, np.einsum("cf,wdf->cfwd", d, net.kernel))
            grads = [embed, kernel, d.sum(0), np.concatenate([g @ top, g @ mean]), np.array([g.sum()])]
            step += 1
            for a, grad, (m, v) in zip(net.arrays(), grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2048, folds: int = 5) -> Net | None:
    """A net learned from at most ``sample`` labelled rows; None without labels.

    Rows whose crc32(doc_id as text) is divisible by ``folds`` are held out. Of the others each
    label gives its ``sample / 2`` ids with the smallest hash, and of an id that stands in several documents one text
    (the smallest by hash) is taken: so the one task that learns never holds more than ``sample`` texts, and only the
    weights (some kB) go to the driver.
    """
    fold = crc(F.col("doc_id").cast("string")) % folds
    open_ = labels.where(F.col("quality").isin(0, 1) & (fold != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = None
    for label in (0, 1):
        some = open_.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(text=frame["text"].fillna("")).sort_values(["doc_id", "text"])
        net = train(frame["text"].tolist(), frame["quality"].to_numpy(np.float32))
        return pd.DataFrame({"part": range(5), "values": [a.ravel().astype(float) for a in net.arrays()]})

    found = sorted(tuple(r) for r in rows.groupBy().applyInPandas(learn, "part int, values array<double>").collect())
    if not found:
        return None
    return Net(*[np.asarray(v, np.float32).reshape(a.shape) for (_, v), a in zip(found, Net.fresh(0).arrays(), strict=True)])


def score(docs: DataFrame, net: Net, rows: int = 256) -> DataFrame:
    """``doc_id, score`` of every row: probability that the text is of quality. Nothing but the text is looked at."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                parts = [chunks(t) for t in batch.column("text").to_pylist()]
                doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                z = logits(net, np.concatenate(parts), doc, len(parts)).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, limit: float = 0.3, folds: int = 5, sample: int = 2048) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per document.

    The network sees the bytes of the whole text in overlapping chunks; every filter keeps its
    largest answer in a chunk, and largest and mean answer over the chunks give one probability.
    Null texts score as empty ones. Without any usable label every score is 0.5. A row without an
    id is never held out. An empty table gives no rows.
    """
    net = fit(docs, labels, sample, folds)
    scored = score(docs, net) if net else docs.select("doc_id", F.lit(0.5).alias("score"))
    held = F.coalesce(crc(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
