"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network in numpy.

Every hashed word has a sparse random index vector; a word's context vector is the sum of the index vectors of its
neighbours over all documents, summed by Spark. A document is the mean of the context vectors of its words, the mean of
their index vectors, and a few shares of characters. The network is trained on a bounded sample of labelled documents;
a temperature, fitted on a part of the sample that the weights have not seen, calibrates its probabilities.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import word_blocks

BUCKETS, WIDTH, NONZERO, REACH = 8192, 64, 2, 2
#: Labelled documents of each class in the sample, on average at most; the rest are read for their scores alone.
SAMPLE_DOCS = 3000
HIDDEN, EPOCHS, RATE = 32, 60, 0.01
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_KINDS = np.array([1 if c in _MARKS else 2 if 48 <= c < 58 else 3 if 65 <= c < 91 else 0 for c in range(256)], np.int8)
FEATURES = 2 * WIDTH + 6


def index_vectors(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


class _BucketOf(dict):
    """Bucket of each word: letters and digits of a word are hashed apart from its marks, so that decorated words meet."""

    def __missing__(self, word: bytes) -> int:
        marks = word.translate(None, _PLAIN)
        number = zlib.crc32(marks * 8 if 2 * len(marks) > len(word) or len(marks) >= 2 else word) % BUCKETS
        if len(self) < 500_000:
            self[word] = number
        return number


_PLAIN = bytes(c for c in range(256) if c not in _MARKS)


def buckets_of(data: bytes, of: _BucketOf) -> np.ndarray:
    parts = [np.fromiter(map(of.__getitem__, words), np.int32, len(words)) for words in word_blocks(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _bytes(batch, column: int):
    for value in batch.column(column):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def context_vectors(docs: DataFrame, text: str = "text", seed: int = 0) -> np.ndarray:
    """(BUCKETS, WIDTH) context vectors from every word of every text, of length one or zero."""

    def count(batches):
        places, signs = index_vectors(seed)
        of, total = _BucketOf(), np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            texts = _bytes(batch, 0)
            while part := list(islice(texts, 256)):
                gap = np.full(REACH, -1, np.int32)  # no word sees the next text's words
                ids = np.concatenate([x for d in part for x in (buckets_of(d, of), gap)])
                for step in range(1, REACH + 1):
                    a, b = ids[:-step], ids[step:]
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both].astype(np.int64), b[both].astype(np.int64)
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(x * WIDTH + places[y, k], signs[y, k], BUCKETS * WIDTH)
        whole = total.reshape(BUCKETS, WIDTH)
        at = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(whole[at].astype(np.float32)), pa.list_(pa.float32()))], ["row", "v"])

    sums = [F.sum(F.col("v")[i].cast("double")).alias(f"s{i}") for i in range(WIDTH)]
    data = docs.select(F.encode(F.col(text), "UTF-8").alias("_text"))
    summed = data.mapInArrow(count, "row long, v array<float>").groupBy("row").agg(*sums).toPandas()  # BUCKETS rows at most
    whole = np.zeros((BUCKETS, WIDTH))
    if len(summed):
        whole[summed["row"].to_numpy(int)] = summed.drop(columns="row").to_numpy(float)
    return (whole / (np.linalg.norm(whole, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def word_table(contexts: np.ndarray, seed: int = 0) -> np.ndarray:
    """Context and index vector of every bucket side by side."""
    places, signs = index_vectors(seed)
    index = np.zeros((BUCKETS, WIDTH), np.float32)
    np.add.at(index, (np.arange(BUCKETS)[:, None], places), signs)
    return np.concatenate([contexts, index], 1)


def features(texts: list[bytes], words: np.ndarray, of: _BucketOf) -> np.ndarray:
    """(texts, FEATURES): pooled word vectors and shares of marks, digits, capitals, repeated words, log length, none."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, data in enumerate(texts):
        ids = buckets_of(data, of)
        if not len(ids):
            out[i, -1] = 1
            continue
        number = np.bincount(ids, minlength=BUCKETS)
        at = np.flatnonzero(number)
        out[i, : 2 * WIDTH] = number[at] @ words[at] / len(ids)
        kinds = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=4)[1:] / len(data)
        out[i, 2 * WIDTH:-1] = [*kinds, 1 - len(at) / len(ids), np.log10(1 + len(ids))]
    return out


class Network:
    """Two layers with a rectifier between them, and a temperature for the final score."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.spread, self.temperature = mean, spread, 1.0
        self.w = [rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.spread @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        x = (x - self.mean) / self.spread
        hidden = np.maximum(x @ self.w[0] + self.w[1], 0)
        error = weight * (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -40, 40))) - y) / weight.sum()
        below = np.outer(error, self.w[2]) * (hidden > 0)
        return [x.T @ below, below.sum(0), hidden.T @ error, error.sum(keepdims=True)]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Adam with weight decay on four fifths of the rows; the temperature with the least log loss on the other fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5:]
    net = Network(x[used].mean(0), x[used].std(0) + 1e-3, seed)
    first, second, step = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    for epoch in range(epochs):
        used = rng.permutation(used)
        for s in range(0, len(used), 128):
            part, step = used[s:s + 128], step + 1
            for i, g in enumerate(net.gradient(x[part], y[part], weight[part])):
                g = g + 1e-4 * net.w[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.w[i] = net.w[i] - RATE * (1 - epoch / epochs) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if len(held):
        z, t = net.logit(x[held]), y[held]

        def loss(temperature: float) -> float:
            return float((weight[held] * np.logaddexp(0, np.where(t > 0.5, -z, z) / temperature)).sum())

        net.temperature = min((2.0 ** (i / 8) for i in range(-16, 33)), key=loss)
    return net


def in_training(key: str = "doc_id", parts: int = 4, held: int = 2) -> Column:
    """False for held-out rows: those whose key's CRC-32, as text, leaves ``held``. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts != held


def fit(docs: DataFrame, labels: DataFrame, words: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE_DOCS) -> Network | None:
    """A network from labelled rows: of each class about ``sample`` (the smallest hashes of their keys), weighed to the whole.

    Labels other than 0 and 1 and rows of either table without a partner take no part; a key with both labels counts with
    both. Without a row there is no network.
    """
    given = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).alias("y")).distinct()
    number = {r.y: r.n for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not number:
        return None
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, sample / number.get(1, sample)))).otherwise(F.lit(min(1.0, sample / number.get(0, sample))))
    drawn = given.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < rate * (1 << 30))
    drawn = drawn.withColumnRenamed(key, "of")
    kept = docs.select(key, F.encode(F.col(text), "UTF-8").alias("_text")).join(F.broadcast(drawn), F.col(key) == F.col("of"))

    def pool(batches):
        of = _BucketOf()
        for batch in batches:
            x = features(list(_bytes(batch, 0)), words, of)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["y", "h", "x"])

    rows = kept.select("_text", F.col("y").cast("int").alias("y"), F.xxhash64(F.lit("order"), "of", "_text").alias("h")).mapInArrow(
        pool, "y int, h long, x array<float>").orderBy("h", "y").limit(8 * sample).toArrow()
    if not rows.num_rows:
        return None
    y = np.asarray(rows.column("y").combine_chunks()).astype(float)
    x = np.stack([np.asarray(v, np.float32) for v in rows.column("x").to_pylist()]).astype(float)
    weight = np.where(y == 1, max(1.0, number.get(1, 0) / sample), max(1.0, number.get(0, 0) / sample))
    return train(x, y, weight)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.7) -> DataFrame:
    """``(key, score, predicted)`` per row of ``docs``: the calibrated probability of label 1, and whether it is ``least``.

    Labels are used where ``in_training(key)`` holds, word vectors come from all texts. A null text counts as empty; empty
    texts are scored, too. Repeated rows are scored repeatedly; a null key is kept; without any label all scores are 0.5.
    Only ``key`` and ``text`` of ``docs`` and ``key`` and ``label`` of ``labels`` are read.
    """
    kind = docs.schema[key].dataType.simpleString()
    words = word_table(context_vectors(docs, text))
    network = fit(docs.where(in_training(key)), labels.where(in_training(key)), words, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast((words, network))

    def run(batches):
        (words, network), of = shared.value, _BucketOf()
        for batch in batches:
            texts, parts = _bytes(batch, 1), []
            while part := list(islice(texts, 1024)):
                parts.append(network.probability(features(part, words, of)) if network else np.full(len(part), 0.5))
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= least).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(key, F.encode(F.col(text), "UTF-8").alias("_text")).mapInArrow(run, f"{key} {kind}, score double, predicted int")
