"""Language-model scores from a hidden Markov model of word classes.

A word's class is a hash of its last letters, so classes need no table. Latent states emit classes, and within a class words
follow their counts in all training texts: P(text) = P(class sequence) * product of P(word | class). States are trained by
Baum-Welch: every partition runs scaled forward and backward recursions over its whole texts, Spark sums the expected
counts, the driver re-estimates, until the likelihood settles. A text's class likelihood is the exact scaled forward recursion over all its tokens.

Word counts are joined without a table that every task would have to hold: texts fall into hashed blocks of bounded size,
each block's distinct words are joined with the counted words, and come back to the block with their counts.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.common import broadcast_checked, stored, word_blocks

CLASSES, STATES, ENDING = 4096, 8, 4  # the hash of an ending gives 12 bits
#: Bytes of text in a block, tokens whose forward values are held at a time, words that a task counts before it passes them on.
BLOCK_TEXT, HELD, COUNTED = 32 << 20, 125_000, 500_000
#: Tokens of a sequence that is trained on in runs, and of a run.
LONG, RUN = 1 << 14, 1 << 10
#: Bytes of class numbers that are trained on side by side; most tasks that score; rows of one key and text that are scored once.
TOGETHER, TASKS, OFTEN = 16 << 20, 4000, 64
#: Texts and rounds that give starting values; gain a token (natural log) of a round over all texts that ends the training.
START_TEXTS, START_ROUNDS, SETTLED = 1500, 8, 0.01
END = b""  # no word is empty, so the end of a text can be counted among the words


def class_of(word: bytes) -> int:
    """Class of a word: a multiplicative hash of its last ``ENDING`` bytes."""
    return int.from_bytes(word[-ENDING:].rjust(ENDING, b"\0"), "big") * 2654435761 % (1 << 32) >> 20


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def class_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of all texts in a row, and the number of tokens of each; a text's end has a class of its own."""
    data = b"\n".join(texts) + b"\n"
    letters = np.frombuffer(data.lower(), np.uint8)
    blank = _BLANK[letters]
    last = np.flatnonzero(blank[1:] & ~blank[:-1])  # last byte of every word
    value, alive = letters[last].astype(np.uint64), np.ones(len(last), bool)
    for back in range(1, ENDING):
        at = np.maximum(last - back, 0)
        alive = alive & (last >= back) & ~blank[at]
        value |= np.where(alive, letters[at], 0).astype(np.uint64) << np.uint64(8 * back)
    ids = (value * np.uint64(2654435761) & np.uint64((1 << 32) - 1)) >> np.uint64(20)
    ends = np.cumsum([len(t) + 1 for t in texts])  # a text ends with the line feed put behind it
    owner = np.searchsorted(ends, last, "right")
    out = np.full(len(last) + len(texts), CLASSES, np.int32)
    out[np.arange(len(last)) + owner] = ids
    return out, np.bincount(owner, minlength=len(texts)) + 1


def sequences_of(texts: list[bytes]) -> list[np.ndarray]:
    flat, size = class_ids(texts)
    return np.split(flat, np.cumsum(size)[:-1]) if len(texts) else []


def _parts(texts, most: int = 1 << 20):
    """Texts of an iterable in lists of about ``most`` bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class Model:
    """Start, transition (from, to) and emission (class, state) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        emit = rng.gamma(2.0, size=(CLASSES + 1, STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def estimated(cls, counts: np.ndarray) -> Model:
        """From expected counts: start row, transition rows, then emission rows; a little is added everywhere."""
        start, move, emit = counts[0] + 0.1, counts[1:1 + STATES] + 0.1, counts[1 + STATES:] + 0.02
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each whole sequence, all of them step by step side by side."""
        size = np.array([len(s) for s in sequences])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.zeros(0, np.int32)
        at, size = np.cumsum(size[order]) - size[order], size[order]
        total, state, live, ones = np.zeros(len(order)), np.tile(self.start, (len(order), 1)), len(order), np.ones(STATES)
        for t in range(size[0] if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            state = state[:live] if t == 0 else state[:live] @ self.move
            state = state * self.emit[flat[at[:live] + t]]
            scale = state @ ones
            state /= scale[:, None]
            total[:live] += np.log(scale)
        out = np.empty(len(order))
        out[order] = total
        return out

    def _forward(self, ids: np.ndarray, at: np.ndarray, state: np.ndarray | None, start: np.ndarray):
        """Emissions, scaled forward values and scales of the steps that start ``at``; ``state`` are those one step before."""
        emit, ones = self.emit[ids], np.ones(STATES)
        forward, scale = np.empty_like(emit), np.empty(len(ids))
        for a, b in zip(at[:-1], at[1:]):
            state = emit[a:b] * (start if state is None else state[:b - a] @ self.move)
            scale[a:b] = state @ ones
            state = np.divide(state, scale[a:b, None], out=forward[a:b])
        return emit, forward, scale

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """Expected counts over whole sequences, all of them step by step side by side, and their total log likelihood.

        A sequence of more than ``LONG`` tokens is cut into runs of ``RUN``; what the rest of the sequence says at their
        edges comes from the products of the runs' transfer matrices, so the counts are those of the whole sequence.
        """
        counts, total = self._expected([s for s in sequences if len(s) <= LONG])
        for s in sequences:
            if len(s) > LONG:
                runs = [s[i:i + RUN] for i in range(0, len(s), RUN)]
                found, logs = self._expected(runs, *self._edges(runs))
                counts += found
                total += logs
        return counts, total

    def _transfer(self, runs: np.ndarray) -> np.ndarray:
        """For each row of equally long runs the matrix from its first state to its last, up to a factor."""
        state = np.tile(np.eye(STATES), (len(runs), 1, 1))
        for t in range(runs.shape[1]):
            state = (state if t == 0 else state @ self.move) * self.emit[runs[:, t], None, :]
            state /= state.max((1, 2), keepdims=True)
        return state

    def _edges(self, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Forward values before each run (zero before the first), and backward values at each run's end."""
        through = np.concatenate([self._transfer(np.stack(runs[:-1])), self._transfer(runs[-1][None])])
        before, leave = np.zeros((len(runs) + 1, STATES)), np.ones((len(runs), STATES))
        for k in range(len(runs)):
            after = (self.start if k == 0 else before[k] @ self.move) @ through[k]
            before[k + 1] = after / after.sum()
        for k in range(len(runs) - 2, -1, -1):
            ahead = self.move @ (through[k + 1] @ leave[k + 1])
            leave[k] = ahead / (before[k + 1] @ ahead)
        return before[:-1], leave

    def _expected(self, sequences: list[np.ndarray], entry: np.ndarray | None = None, leave: np.ndarray | None = None):
        """``expected`` of sequences, or of the runs of one with the values at their edges.

        Forward values are held for windows of about ``HELD`` tokens; between them only the states at the edges are kept.
        """
        counts, total, ones = np.zeros((1 + STATES + CLASSES + 1, STATES)), 0.0, np.ones(STATES)
        if not sequences:
            return counts, total
        start = self.start if entry is None else np.vstack([self.start, entry[1:] @ self.move])
        ids, at = _side_by_side(sequences)  # runs of one sequence keep their order
        cuts = np.unique(np.append(np.searchsorted(at, np.arange(0, at[-1], HELD)), len(at) - 1))
        edges = [None]
        for s, e in zip(cuts[:-2], cuts[1:-1]):
            edges.append(self._forward(ids[at[s]:at[e]], at[s:e + 1] - at[s], edges[-1], start)[1][at[e - 1] - at[s]:].copy())
        back = np.ones((0, STATES))
        for s, e, edge in reversed(list(zip(cuts[:-1], cuts[1:], edges))):
            here, part = at[s:e + 1] - at[s], ids[at[s]:at[e]]
            emit, forward, scale = self._forward(part, here, edge, start)
            total += float(np.log(scale).sum())
            for t in range(e - s - 1, -1, -1):
                a, b = here[t], here[t + 1]
                after, back = back, np.ones((b - a, STATES)) if leave is None else leave[:b - a].copy()
                back[:len(after)] = after  # the others end here
                before = forward[here[t - 1]:here[t - 1] + b - a] if t else None if edge is None else edge[:b - a]
                share = forward[a:b] * back
                if before is None and entry is not None:
                    before = entry  # its row 0 is zero, as nothing stands before the first run
                if before is not None:
                    back *= emit[a:b]
                    back /= scale[a:b, None]
                    counts[1:1 + STATES] += self.move * (before.T @ back)
                    back = back @ self.move.T
                forward[a:b] = share / (share @ ones)[:, None]  # the place of the forward values, which are used up
            if edge is None:
                counts[0] = forward[:here[1]].sum(0) if entry is None else forward[0]
            for k in range(STATES):
                counts[1 + STATES:, k] += np.bincount(part, forward[:, k], CLASSES + 1)
        return counts, total


def _side_by_side(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sequences, longest first, ordered by their place in the sequence, and where each place starts."""
    size = np.array([len(s) for s in sequences])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    live = np.cumsum(np.bincount(size)[::-1])[::-1][1:]
    at = np.concatenate([[0], np.cumsum(live)])
    place = np.arange(at[-1]) - np.repeat(np.cumsum(size) - size, size)
    ids = np.empty(at[-1], np.int32)
    ids[at[place] + np.repeat(np.arange(len(size)), size)] = np.concatenate([sequences[i] for i in order])
    return ids, at


def _bytes(batch, column: int):
    for value in batch.column(column):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def in_training(key: str = "doc_id", parts: int = 7, held: int = 2) -> Column:
    """False for held-out rows: those whose key's CRC-32, as text, leaves ``held``. A null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts != held


def classes(training: DataFrame, text: str = "text") -> DataFrame:
    """``(ids)`` of every text: the classes of all its tokens, two bytes each."""

    def run(batches):
        for batch in batches:
            for part in _parts(_bytes(batch, 0)):
                yield pa.RecordBatch.from_arrays([pa.array([s.astype("<i2").tobytes() for s in sequences_of(part)], pa.binary())], ["ids"])

    return training.select(F.encode(F.col(text), "UTF-8").alias("_text")).mapInArrow(run, "ids binary")


def _counted(data: DataFrame, model: Model, label: str) -> tuple[np.ndarray, float]:
    """Expected counts and log likelihood over all texts of ``data(ids)``, summed by Spark and stored."""

    def count(batches):
        total, likelihood = np.zeros((1 + STATES + CLASSES + 1, STATES)), 0.0
        for part in _parts((x for batch in batches for x in _bytes(batch, 0)), TOGETHER):
            found, logs = model.expected([np.frombuffer(x, "<i2") for x in part])
            total += found
            likelihood += logs
        rows = [*total, np.full(STATES, likelihood)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows, pa.list_(pa.float64()))], ["row", "n"])

    sums = [F.sum(F.col("n")[k]).alias(f"s{k}") for k in range(STATES)]
    whole = stored(data.mapInArrow(count, "row long, n array<double>").groupBy("row").agg(*sums), label).toPandas()  # a row per class, state and start
    if whole.empty:
        return np.zeros((1 + STATES + CLASSES + 1, STATES)), 0.0
    rows = whole.sort_values("row").drop(columns="row").to_numpy(float)
    return rows[:-1], float(rows[-1, 0])


def _started(some: DataFrame, seed: int) -> Model:
    """A model after ``START_ROUNDS`` rounds over the bounded table ``some(ids)``, all in one task."""

    def run(batches):
        model, own = Model.random(seed), [np.frombuffer(x, "<i2") for batch in batches for x in _bytes(batch, 0)]
        for _ in range(START_ROUNDS if own else 0):
            model = Model.estimated(model.expected(own)[0])
        rows = [model.start, *model.move, *model.emit]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows, pa.list_(pa.float64()))], ["row", "n"])

    rows = some.repartition(1).mapInArrow(run, "row long, n array<double>").toPandas().sort_values("row")["n"].tolist()
    return Model(rows[0], np.array(rows[1:1 + STATES]), np.array(rows[1 + STATES:])) if rows else Model.random(seed)


def fit(training: DataFrame, text: str = "text", settled: float = SETTLED, seed: int = 0) -> Model:
    """Baum-Welch over all whole texts until a round gains less than ``settled`` (natural log) a token.

    Starting values come from ``START_ROUNDS`` rounds over ``START_TEXTS`` whole texts, which are the first by hash; every
    round over all texts is stored. Without texts the model is the random one.
    """
    data = stored(classes(training, text), "hmm-classes")
    some = stored(data.orderBy(F.xxhash64("ids"), "ids").limit(START_TEXTS), "hmm-start")
    model, before, turn = _started(some, seed), -np.inf, 0
    while True:
        counts, likelihood = _counted(data, model, f"hmm-round-{turn}")
        tokens = counts[1 + STATES:].sum()
        if not tokens:
            return Model.random(seed)
        model = Model.estimated(counts)
        if likelihood / tokens - before < settled:
            return model
        before, turn = likelihood / tokens, turn + 1


def word_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """``(word, class, c)``: how often each token stands in all training texts; the end of a text is the empty word."""

    def count(batches):
        seen = Counter()

        def batch_of():
            words = list(seen)
            classes = [class_of(w) if w else CLASSES for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(classes, pa.int32()),
                                              pa.array(list(seen.values()), pa.int64())], ["word", "class", "c"])
            seen.clear()

        for batch in batches:
            for data in _bytes(batch, 0):
                for words in word_blocks(data.lower()):
                    seen.update(words)
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield from batch_of()
        yield from batch_of()

    data = training.select(F.encode(F.col(text), "UTF-8").alias("_text"))
    return data.mapInArrow(count, "word string, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


def _apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers of which a repartitioning into ``n`` parts puts one into each."""
    number = F.col("id").cast("int")
    dealt = spark.range(64 * n).groupBy(F.pmod(F.hash(number), F.lit(n))).agg(F.min(number).alias("least"))  # n rows
    return [r.least for r in dealt.collect()]


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``, from a model of ``training``.

    ``base_score`` is the add-one unigram score, ``score`` the log10 probability by the hidden Markov model. A null or empty
    text is its end alone. Repeated rows are returned repeatedly, rows of one key and text that stand more than ``OFTEN``
    times are scored once; a null key is kept; without training texts all words are unknown. Only ``key`` and ``text`` are
    read. Texts fall into blocks of about ``BLOCK_TEXT`` bytes by hash; a task takes one, beyond ``TASKS`` blocks a few.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    model = fit(training, text)
    known = stored(word_counts(training, text), "hmm-words")
    totals = known.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # a row per class
    inside = np.zeros(CLASSES + 1)
    inside[totals["class"].to_numpy(int)] = totals["n"] + totals["v"]
    n, v = int(totals["n"].sum()), int(totals["v"].sum())
    shared = spark.sparkContext.broadcast((model, np.log10(inside + 1)))
    if blocks is None:
        blocks = max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BLOCK_TEXT))
    tasks = min(blocks, max(TASKS, -(-blocks // 16)))
    same = [F.xxhash64(key, text).alias("_same"), F.hash(text, key).alias("_also")]
    rows = docs.select(F.col(key).alias("_key"), F.encode(F.col(text), "UTF-8").alias("_text"), *same)
    names = ["_same", "_also"]
    often = stored(rows.groupBy(*names).count().where(F.col("count") > OFTEN).select(*names), "hmm-often")
    repeated = not often.isEmpty()
    carried = [*names, "_one", "_key"] if repeated else [*names, "_key"]  # a constant would part the shuffles of the texts
    if repeated:  # their texts are scored once and their rows stay where they are
        often = broadcast_checked(often)
        held = rows.join(often, names, "left_semi").select("_key", *names)
        once = rows.join(often, names, "left_semi").groupBy(*names).agg(F.first("_key").alias("_key"), F.first("_text").alias("_text"))
        rows = rows.join(often, names, "left_anti").withColumn("_one", F.lit(False)).unionByName(once.withColumn("_one", F.lit(True)))
    block = F.pmod("_same", F.lit(blocks)).cast("int")
    if blocks == tasks:
        block = F.element_at(F.lit(_apart(spark, blocks)), block + 1)
    rows = rows.select(*carried, "_text", block.alias("block")).repartition(tasks, "block")

    def distinct(batches):
        """Words of each block, which one task reads; a word is given again only where a block has very many of them."""
        seen: dict[int, set] = {}

        def give():
            for block, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int32)),
                                                  pa.array(list(words), pa.binary()).cast(pa.string())], ["block", "word"])
            seen.clear()

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), _bytes(batch, batch.schema.get_field_index("_text"))):
                own = seen.setdefault(block, set())
                own.add(END)
                for words in word_blocks(data.lower()):
                    own.update(words)
                if len(own) > 2 * COUNTED:
                    yield from give()
        yield from give()

    words = rows.mapInArrow(distinct, "block int, word string")  # of all columns, so that one shuffle of the texts serves twice
    found = words.join(known.select("word", "c"), "word").repartition(tasks, "block")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        hmm, inside = shared.value
        count = dict(zip(right.column("word").cast(pa.binary()).to_pylist(), right.column("c").to_pylist()))
        get = count.get
        sizes, known_n, base, within, sequences = [], [], [], [], []
        texts = (value.as_buffer().to_pybytes() if value.is_valid else b"" for value in left.column("_text"))
        for part in _parts(texts):
            for data, ids in zip(part, sequences_of(part)):
                c = np.concatenate([*(np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)) for ws in word_blocks(data.lower())),
                                    np.array([get(END, 0)])])
                logs = np.log10(c + 1)
                sizes.append(len(c))
                known_n.append(int((c > 0).sum()))
                base.append(float(logs.sum() - len(c) * np.log10(n + v + 1)))
                within.append(float(logs.sum() - inside[ids].sum()))
                sequences.append(ids)
        likelihood = hmm.log_likelihoods(sequences) / np.log(10)
        return pa.table({
            **{c: left.column(c) for c in carried}, "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known_n, pa.int64()),
            "train_tokens": pa.array([n] * len(sizes), pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(likelihood + np.array(within), pa.float64())})

    out = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    whole = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        scored, f"_same long, _also int, {'_one boolean, ' if repeated else ''}_key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    if not repeated:
        return whole.select(F.col("_key").alias(key), *out)
    whole = stored(whole, "hmm-scored")
    ones = broadcast_checked(stored(whole.where("_one").select(*names, *out), "hmm-ones"))
    return whole.where("NOT _one").select(F.col("_key").alias(key), *out).unionByName(
        held.join(ones, names).select(F.col("_key").alias(key), *out))
