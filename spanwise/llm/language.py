"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A document's UTF-8 bytes are cut into windows; two gated recurrent units read each window forwards and backwards, a softmax
over both states labels every byte, and a document's probabilities are the means of its labels' log probabilities,
normalised. Training is backpropagation through time on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Documents of each language in the training sample, on average at most, and bytes taken from each of them.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 512
WINDOW, BATCH, HIDDEN = 128, 2048, 8


class ByteTagger:
    """Gated recurrent units in both directions. Weights per direction: byte table (256, 3H), recurrent (3H, H), candidate bias (H)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.hidden, self.w = hidden, {}
        for side in "fb":
            self.w[f"x{side}"] = draw(256, 3 * hidden, scale=0.3)
            self.w[f"u{side}"] = draw(3 * hidden, hidden, scale=hidden**-0.5)
        self.w["o"] = draw(classes, 2 * hidden, scale=hidden**-0.5)
        self.w["c"] = np.zeros((classes, 1), np.float32)

    def run(self, data: np.ndarray, side: str, keep: bool = False):
        """States (T, H, B) of windows ``data`` (T, B). Rows of a state: update gate, reset gate, candidate."""
        h, (steps, n) = self.hidden, data.shape
        table, u = self.w[f"x{side}"], self.w[f"u{side}"]
        state, states, saved = np.zeros((h, n), np.float32), np.empty((steps, h, n), np.float32), [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = np.ascontiguousarray(table[data[t]].T)
            r = u @ state
            gates = a[: 2 * h] + r[: 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            cand = np.tanh(a[2 * h:] + gates[h:] * r[2 * h:])
            if keep:
                saved[t] = (state, gates, cand, r[2 * h:])
            state = cand + gates[:h] * (state - cand)
            states[t] = state
        return states, saved

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(T, classes, B): log probabilities of the label of every byte."""
        both = np.concatenate([self.run(data, "f")[0], self.run(data, "b")[0]], 1)
        z = np.matmul(self.w["o"], both) + self.w["c"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def step(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all unmasked bytes and its gradient, by backpropagation through time."""
        h, (steps, n) = self.hidden, data.shape
        runs = {s: self.run(data, s, keep=True) for s in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 1)
        z = np.matmul(self.w["o"], both) + self.w["c"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        total = mask.sum()
        loss = -float((np.log(p[:, target, np.arange(n)] + 1e-30) * mask).sum() / total)
        p[:, target, np.arange(n)] -= 1
        p *= (mask / total)[:, None, :]
        g = {"o": np.einsum("tcb,thb->ch", p, both, optimize=True), "c": p.sum((0, 2))[:, None]}
        back = np.matmul(self.w["o"].T, p)
        for side, part in (("f", back[:, :h]), ("b", back[:, h:])):
            saved, u = runs[side][1], self.w[f"u{side}"]
            gx, gu, carry = np.zeros((256, 3 * h), np.float32), np.zeros_like(u), np.zeros((h, n), np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                state, gates, cand, rc = saved[t]
                d = part[t] + carry
                update, reset = gates[:h], gates[h:]
                dc = d * (1 - update) * (1 - cand * cand)
                du = d * (state - cand) * update * (1 - update)
                dr = dc * rc * reset * (1 - reset)
                da = np.concatenate([du, dr, dc])
                dh = np.concatenate([du, dr, dc * reset])
                np.add.at(gx, data[t], da.T)
                gu += dh @ state.T
                carry = d * update + u.T @ dh
            g[f"x{side}"], g[f"u{side}"] = gx, gu
        return loss, g


def train(windows: np.ndarray, masks: np.ndarray, labels: np.ndarray, classes: int, steps: int = 250, batch: int = 256,
          rate: float = 0.02, hidden: int = HIDDEN, seed: int = 0) -> ByteTagger:
    """Adam on random batches of windows (N, T) with byte masks and one label each; languages are drawn equally often."""
    model, rng = ByteTagger(classes, hidden, seed), np.random.default_rng(seed)
    by = [np.flatnonzero(labels == c) for c in range(classes)]
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    for i in range(1, steps + 1):
        pick = np.array([rng.choice(by[c]) for c in rng.integers(0, classes, batch)])
        _, g = model.step(np.ascontiguousarray(windows[pick].T), np.ascontiguousarray(masks[pick].T), labels[pick])
        norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
        pace = rate * (1 - i / (steps + 1))
        for k, v in g.items():
            v = v / norm
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            model.w[k] -= pace * (mean[k] / (1 - 0.9**i)) / (np.sqrt(square[k] / (1 - 0.99**i)) + 1e-6)
    return model


def cut_windows(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, size) of all bytes, and which places hold one."""
    n = -(-len(data) // size)
    padded = np.zeros(n * size, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded.reshape(n, size), (np.arange(n * size) < len(data)).astype(np.float32).reshape(n, size)


def in_training(key: str = "doc_id", parts: int = 4, held: int = 2) -> Column:
    """False for held-out rows: those whose key's CRC-32, as text, leaves ``held``. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts != held


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", docs: int = SAMPLE_DOCS,
        size: int = SAMPLE_BYTES, steps: int = 250) -> tuple[ByteTagger | None, list[str]]:
    """A trained network and its languages, from rows of ``labelled`` with a label and a letter.

    Bounded: of each label about ``docs`` rows (those with the smallest hashes of their key) and ``size`` bytes at a hashed
    place. Rows with a null label or text take no part; without any, there is no network.
    """
    usable = labelled.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), key).alias("draw"))
    counts = {r.label: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None, []
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, docs / n)))))
    place = F.floor(F.pmod(F.xxhash64("draw"), F.lit(1 << 20)) / float(1 << 20) * F.greatest(F.length("text") - size // 2, F.lit(1))) + 1
    picked = usable.where(F.pmod("draw", F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)).select(
        "label", F.substring("text", place.cast("int"), F.lit(size)).alias("part"), "draw").orderBy("draw", "label")
    sample = picked.limit(4 * docs * len(counts)).collect()
    names = sorted({r.label for r in sample})
    parts = [cut_windows(r.part.encode()[:size], WINDOW) for r in sample]
    labels = np.concatenate([np.full(len(w), names.index(r.label)) for (w, _), r in zip(parts, sample)])
    return train(np.concatenate([w for w, _ in parts]), np.concatenate([m for _, m in parts]), labels, len(names), steps), names


def _pooled(model: ByteTagger, classes: int, texts: list[bytes]) -> np.ndarray:
    """Sums of the log probabilities of all bytes of each text."""
    sums, held, rows, n = np.zeros((len(texts), classes)), [], [], 0

    def flush():
        owner = np.concatenate([np.full(len(w), i) for i, (w, _) in zip(rows, held)])
        data, mask = np.concatenate([w for w, _ in held]), np.concatenate([m for _, m in held])
        for s in range(0, len(data), BATCH):
            p = model.log_probabilities(np.ascontiguousarray(data[s:s + BATCH].T))
            np.add.at(sums, owner[s:s + BATCH], np.einsum("tcb,bt->bc", p, mask[s:s + BATCH], optimize=True))
        held.clear()
        rows.clear()

    for i, data in enumerate(texts):
        for s in range(0, len(data), BATCH * WINDOW):
            held.append(cut_windows(data[s:s + BATCH * WINDOW], WINDOW))
            rows.append(i)
            n += len(held[-1][0])
            if n >= 4 * BATCH:
                flush()
                n = 0
    if held:
        flush()
    return sums


def label_texts(model: ByteTagger | None, names: list[str], texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and its pooled probability of each text; ``und`` and 0 where there is no letter or no network."""
    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if names and LETTER.search(t.decode("utf-8", "replace"))]
    if at:
        chosen = [texts[i] for i in at]
        mean = _pooled(model, len(names), chosen) / np.array([len(t) for t in chosen])[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, row in zip(at, p):
            best[i], score[i] = names[int(row.argmax())], row.max()
    return best, score


def predict(docs: DataFrame, model: ByteTagger | None, names: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` per row: the language with the largest pooled probability, and that probability.

    Whole texts are labelled, byte by byte. Null texts and texts without a letter are ``und`` with score 0, and so is
    everything where no language was learned. Equal probabilities go to the smaller name. Only ``key`` and ``text`` are read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            best, score = label_texts(model, names, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return docs.select(key, F.encode(F.col(text), "UTF-8").alias("_text")).mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: ByteTagger | None, names: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with a probability of ``least`` or more; ``und`` ones go."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [(v.as_py() or "").encode("utf-8", "replace") for v in batch.column(at)]
            _, score = label_texts(model, names, texts)
            yield batch.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
