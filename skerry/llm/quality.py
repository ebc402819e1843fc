"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over the whole text, and the text is
covered by chunks that overlap by a filter's width, so no place escapes a filter.
Each filter is max-pooled within each chunk; the chunks' values are combined by
their maximum and their mean into one logistic unit. Training is Adam on a
bounded, balanced sample of labelled rows; max-pooling lets only one place of each
chunk and filter carry a gradient.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import chunks

EMBED, WIDTH, FILTERS, CHUNK = 6, 6, 16, 384
#: Windows that are multiplied at once.
STRETCH = 100_000


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 2 * FILTERS + 1: maxima, means, constant


def _windows(network: Network, raw: np.ndarray) -> np.ndarray:
    """Each place's embedded window, places x WIDTH * EMBED (a view of the embedded bytes)."""
    x = np.ascontiguousarray(network.embed[raw]).reshape(-1)
    step = x.strides[0]
    return np.lib.stride_tricks.as_strided(x, (len(raw) - WIDTH + 1, WIDTH * EMBED), (EMBED * step, step))


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded by zeros at its end for a last window; begin of each chunk, text of each chunk."""
    pad = b"\0" * (WIDTH - 1)
    raw = np.frombuffer(b"".join(t + pad if t else b"\0" + pad for t in texts), np.uint8)
    size = np.array([max(len(t), 1) for t in texts])
    at = np.cumsum(size + WIDTH - 1) - size - WIDTH + 1
    count = -(-size // CHUNK)
    text = np.repeat(np.arange(len(texts)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return raw, at[text] + step * CHUNK, text


def _pooled(network: Network, texts: list[bytes], where: bool = False):
    """Chunks x FILTERS maxima (ReLU), text of each chunk, and the places of the maxima if asked.

    Chunks are pooled STRETCH windows at a time, so activations of a long text are never held as a whole.
    """
    raw, begin, text = _layout(texts)
    pads = np.append(begin[1:], len(raw))
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, pads - WIDTH + 1, pads)
    top = np.empty((len(begin), FILTERS), np.float32)
    best = np.empty((len(begin), FILTERS), np.int64) if where else None
    for a in range(0, len(begin), STRETCH // CHUNK):
        b = min(a + STRETCH // CHUNK, len(begin))
        low = begin[a]
        act = _windows(network, raw[low : end[b - 1] + WIDTH - 1]) @ network.filters
        if where:
            best[a:b] = np.array([act[x:y].argmax(0) + x for x, y in zip(begin[a:b] - low, end[a:b] - low)])
            top[a:b] = np.take_along_axis(act, best[a:b], 0)
            best[a:b] += low
        else:
            edges = np.stack((begin[a:b], end[a:b]), 1).reshape(-1) - low
            top[a:b] = np.maximum.reduceat(act, edges[:-1], axis=0)[::2]
    return np.maximum(top + network.bias, 0), text, best, raw


def _combine(pool: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.searchsorted(text, np.arange(n))
    count = np.bincount(text, minlength=n)[:, None]
    return np.hstack((np.maximum.reduceat(pool, begin, axis=0), np.add.reduceat(pool, begin, axis=0) / count, np.ones((n, 1), pool.dtype))), count


def scores(network: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    pool, text, _, _ = _pooled(network, texts)
    z = _combine(pool, text, len(texts))[0] @ network.head
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _batches(order: np.ndarray, texts: list[bytes], most: int, limit: int = 400_000) -> Iterator[np.ndarray]:
    """Rows in order, most at once, and no more than limit bytes unless one text is longer."""
    begin, size = 0, 0
    for i, j in enumerate(order):
        if i > begin and (i - begin == most or size + len(texts[j]) > limit):
            yield order[begin:i]
            begin, size = i, 0
        size += len(texts[j])
    yield order[begin:]


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 700, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Network:
    """At least steps of Adam on log loss, both labels weighing the same; the same rows give the same network."""
    epochs = max(8, -(-steps * batch // len(texts)))
    share = float(labels.mean())
    weigh = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.Generator(np.random.PCG64(seed))
    f = np.float32
    net = Network(rng.normal(0, 0.5, (256, EMBED)).astype(f), rng.normal(0, 0.3, (WIDTH * EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, 2 * FILTERS + 1).astype(f))
    parts = [net.embed, net.filters, net.bias, net.head]
    m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for some in _batches(order, texts, batch):
            pool, text, best, raw = _pooled(net, [texts[j] for j in some], True)
            x, count = _combine(pool, text, len(some))
            z = np.clip(x @ net.head, -30, 30)
            dz = ((1 / (1 + np.exp(-z)) - labels[some]) * weigh[some] / len(some)).astype(f)
            g_head = x.T @ dz + f(1e-4) * net.head
            dx = dz[:, None] * net.head[None]
            d_pool = (dx[:, FILTERS : 2 * FILTERS] / count)[text]
            d_pool = d_pool + np.where(pool >= x[text, :FILTERS], dx[text, :FILTERS], 0)
            d_pool = np.where(pool > 0, d_pool, 0).astype(f)
            windows = raw[best[:, :, None] + np.arange(WIDTH)]  # chunks x FILTERS x WIDTH: the bytes that won
            inputs = net.embed[windows].reshape(*best.shape, -1)
            g_filters = np.einsum("cfi,cf->if", inputs, d_pool)
            back = d_pool[:, :, None] * net.filters.T[None]
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, windows.reshape(-1), back.reshape(-1, EMBED))
            t += 1
            for k, g in enumerate((g_embed, g_filters, d_pool.sum(0), g_head)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                parts[k] -= (rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(f)
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_label: int = 800, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_bytes: int = 64 << 20) -> Network:
    """Fit on about ``per_label`` whole texts of each label, ``sample_bytes`` in all (documented bounds), drawn by a seeded hash of doc_id.

    A document labelled more than once takes the larger mean label; null labels
    and null doc_ids are passed over. Of the rows drawn, those come first whose
    hash is smallest; one that would go beyond ``sample_bytes`` is passed over.
    Without both labels every text scores 0.5.
    """
    given = F.col(f"`{id_col}`")
    known = labels.where(F.col(label_col).isNotNull() & given.isNotNull())
    known = (known if learn is None else known.where(learn)).groupBy(given.alias("known")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    blank = Network(np.zeros((256, EMBED), np.float32), np.zeros((WIDTH * EMBED, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1, np.float32))
    if len(counts) < 2:
        return blank
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("known")), F.lit(1 << 30))
    rate = F.when(F.col("label") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    sample = known.withColumn("draw", draw).where(F.col("draw") < rate * float(1 << 30))
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    texts = docs.select(given.alias("known"), body.alias("body"))
    drawn = texts.select("known", F.octet_length("body").alias("size")).join(F.broadcast(sample), "known")
    room, chosen = sample_bytes, []
    for r in sorted(drawn.groupBy("known", "draw").agg(F.max("size").alias("size")).collect(), key=lambda r: (r["draw"], r["known"])):  # about 2 * per_label rows
        if r["size"] <= room:
            room -= r["size"]
            chosen.append((r["known"],))
    if not chosen:
        return blank
    ids = docs.sparkSession.createDataFrame(chosen, f"known {dict(sample.dtypes)['known']}")
    longest = texts.join(F.broadcast(sample.select("known", "label").join(F.broadcast(ids), "known")), "known").groupBy("known", "label").agg(F.max(F.struct(F.octet_length("body").alias("size"), "body")).alias("best"))
    found = sorted((r["known"], bytes(r["best"]["body"]), r["label"]) for r in longest.collect())
    if len({y for _, _, y in found}) < 2:
        return blank
    return fit([x for _, x, _ in found], np.array([y for _, _, y in found], np.float32))


def score(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on). Whole texts are scored; null and empty texts get the score of one empty chunk."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = [np.zeros(0)]
            for _, texts in chunks([pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])], "text", 500_000):
                out.append(scores(shared.value, texts))
            yield pa.array(np.concatenate(out))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    from pyspark.sql.pandas.functions import arrow_udf

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, arrow_udf(run, "double")(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
