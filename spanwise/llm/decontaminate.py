"""Benchmark decontamination by latent semantic retrieval.

The columns of the term matrix are the benchmark's words; every text becomes the sequence of its columns once. Over all
passages of all texts, Spark sums document frequencies, then the randomised sketch ``A'AW`` of the TF-IDF matrix A; the
sketch's eigenvectors (single-pass Nystroem form of the randomised SVD) give every word a latent vector. Overlapping
windows of every text are compared with every benchmark item of fitting length by the cosine of their latent vectors;
latent neighbours are the candidates for paraphrases. Copies are also found by rare-word seeds: a copy misses so few of an
item's words that a window with it holds a known number of the item's rarer half, whatever the latent space makes of it.
Candidates are then checked exactly: longest common subsequence of words, and for a paraphrase also whether the item's
answer (its last words) is there in order. Items too short for that are found where they stand word for word.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.common import BLOCK_BYTES, stored

#: Dimensions of the sketch; words of a block and of a passage; blocks by which window lengths differ.
SKETCH, BLOCK, PASSAGE, GRADES = 64, 8, 32, (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Power of the inverse document frequency in the term weights: rare words lead the latent directions.
RARITY = 3
#: Benchmark items that are searched at once; more are searched in turns.
ITEMS_AT_ONCE = 20_000
#: Items with fewer words are found only word for word.
SHORT = 5
#: Bytes of the table that marks the words of some windows at a time.
MARKS = 1 << 21
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def text_blocks(text: str):
    """Lower-cased words without ASCII punctuation, of a whole text, in blocks."""
    start = 0
    while start < len(text):
        end = start + BLOCK_BYTES
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end].lower().encode("utf-8", "replace").translate(_PLAIN).split()
        start = end


def words_of(text: str) -> list[bytes]:
    return [w for words in text_blocks(text) for w in words]


@dataclass
class Benchmark:
    """Items and their columns; ``fit`` adds document frequencies, latent word vectors and the items by window length."""

    ids: pa.Array
    items: list[np.ndarray]
    known: dict[bytes, int]
    idf: np.ndarray | None = None
    vectors: np.ndarray | None = None
    groups: dict[int, np.ndarray] = field(default_factory=dict)
    latent: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return "<i2" if len(self.known) < 32_000 else "<i4"

    def columns(self, text: str) -> np.ndarray:
        """The column of every word of a text; -1 for words that the benchmark does not have."""
        get = self.known.get
        parts = [np.fromiter(map(get, words, repeat(-1)), self.kind, len(words)) for words in text_blocks(text)]
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)


def read_benchmarks(benchmark: DataFrame, item: str = "item_id", text: str = "text"):
    """Benchmarks of at most about ``ITEMS_AT_ONCE`` items. Items without words (null and empty ones too) match nothing."""
    held, n = [], benchmark.count()
    turns = -(-n // ITEMS_AT_ONCE)
    for part in range(turns):
        rows = benchmark.where(F.pmod(F.xxhash64(item, text), F.lit(turns)) == part)
        read = rows.select(F.col(item).alias("item"), F.col(text).alias("text")).distinct().toArrow().combine_chunks()
        words = [words_of(t.as_py() or "") for t in read["text"]]
        order = sorted((k for k, ws in enumerate(words) if ws), key=lambda k: (str(read["item"][k].as_py()), words[k]))
        if order:
            known = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
            held.append(Benchmark(read["item"].combine_chunks().take(pa.array(order)), [np.array([known[w] for w in words[k]]) for k in order], known))
    return held


def _texts(batch: pa.RecordBatch, column: int):
    for value in batch.column(column):
        yield value.as_py() or ""


def encoded(docs: DataFrame, bench: Benchmark, key: str, text: str) -> DataFrame:
    """``(_key, columns, seen)``, stored: the columns of every row's text; one more row per task with document frequencies."""
    width = len(bench.known)

    def run(batches):
        total, kind = np.zeros(width + 1, np.int64), None
        for batch in batches:
            out, some, kind = [], [], batch.column(0).type

            def add():
                flags = np.zeros((len(some), width + 1), bool)
                for i, columns in enumerate(some):
                    flags[i, columns] = True  # the last column is for all other words
                total[:] += flags.sum(0)
                total[-1] += len(some) - flags[:, -1].sum()
                some.clear()

            for text_ in _texts(batch, 1):
                columns = bench.columns(text_)
                out.append(columns.tobytes())
                some.append(columns)
                if len(some) == 64:
                    add()
            add()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], ["_key", "columns", "seen"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["_key", "columns", "seen"])

    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("columns", T.BinaryType()), T.StructField("seen", T.BinaryType())])
    return stored(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema), "leaks-encoded")


def fit(coded: DataFrame, bench: Benchmark, seed: int = 0) -> Benchmark:
    """Document frequencies and latent word vectors from every passage of every encoded text."""
    spark, width, kind = coded.sparkSession, len(bench.known), bench.kind

    def add_up(batches):
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(total)], ["c", "n"])

    # one row per word of the benchmark and one for the number of texts
    sums = coded.where("seen IS NOT NULL").select("seen").mapInArrow(add_up, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(width + 1)
    frequency[sums["c"].to_numpy(int)] = sums["n"]
    bench.idf = np.log((frequency[-1] + 2) / (frequency[:-1] + 1)).clip(0).astype(np.float32)
    weights = (bench.idf / max(float(bench.idf.max()), 1e-6)) ** RARITY
    shared = spark.sparkContext.broadcast(weights)

    def sketch(batches):
        weights = shared.value
        random = np.random.default_rng(seed).normal(0, 1, (width, SKETCH)).astype(np.float32) * weights[:, None]
        heavy, total = np.append(weights > 0, False), np.zeros((width, SKETCH), np.float32)

        def add(columns: np.ndarray, passage: np.ndarray) -> None:
            weight = weights[columns]
            starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(columns))))
            sums = np.add.reduceat(random[columns], starts, axis=0)
            sums /= np.add.reduceat(weight * weight, starts)[:, None]
            order = np.argsort(columns, kind="stable")
            ordered = columns[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            total[ordered[first]] += np.add.reduceat(sums[of[order]] * weight[order][:, None], first, axis=0)

        held, number, size, base = [], [], 0, 0
        for batch in batches:
            for value in batch.column(0):
                columns = np.frombuffer(value.as_buffer(), kind)
                at = np.flatnonzero(heavy[columns])
                held.append(columns[at])
                number.append(base + at // PASSAGE)
                base, size = base + len(columns) // PASSAGE + 1, size + len(at)
                if size >= 1 << 15:
                    add(np.concatenate(held), np.concatenate(number))
                    held, number, size = [], [], 0
        if size:
            add(np.concatenate(held), np.concatenate(number))
        at = np.flatnonzero(total.any(1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float32()))], ["c", "v"])

    sums = [F.sum(F.col("v")[i].cast("double")).alias(f"s{i}") for i in range(SKETCH)]
    summed = coded.where("columns IS NOT NULL").select("columns").mapInArrow(sketch, "c long, v array<float>").groupBy("c").agg(*sums).toPandas()
    whole = np.zeros((width, SKETCH))
    if len(summed):
        whole[summed["c"].to_numpy(int)] = summed.drop(columns="c").to_numpy(float)
    draw = np.random.default_rng(seed).normal(0, 1, (width, SKETCH))
    whole += 1e-6 * max(float(np.linalg.norm(whole)), 1e-6) * draw
    core = draw.T @ whole
    values, basis = np.linalg.eigh((core + core.T) / 2)
    root = basis / np.sqrt(np.maximum(values, 1e-9 * max(values.max(), 1e-9)))
    bench.vectors = (np.linalg.svd(whole @ root, full_matrices=False)[0] * weights[:, None]).astype(np.float32)
    need = np.array([-(-(len(w) + BLOCK - 1) // BLOCK) for w in bench.items])  # a window of so many blocks holds the item wherever it starts
    grades = [g for g in GRADES if g < need.max()] + [int(need.max())]
    widths = np.array([min(g for g in grades if g >= n) for n in need])
    long = np.array([len(w) >= SHORT for w in bench.items])
    for blocks in sorted(set(widths[long].tolist())):
        bench.groups[blocks] = np.flatnonzero((widths == blocks) & long)
        own = np.stack([bench.vectors[bench.items[i]].sum(0) for i in bench.groups[blocks]])
        bench.latent[blocks] = own / (np.linalg.norm(own, axis=1, keepdims=True) + 1e-12)
    return bench


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel recursion over ``b``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def match(item: list, window: list, verbatim: float, paraphrase: float, answer: float) -> tuple[float, float] | None:
    """Shares of the item and of its answer (the last quarter, three words at least) that stand in the window in order."""
    share = common_subsequence(item, window) / len(item)
    if share < paraphrase:
        return None
    last = item[-max(3, len(item) // 4):]
    kept = common_subsequence(last, window) / len(last)
    return (share, kept) if share >= verbatim or kept >= answer else None


class Search:
    """Finds benchmark items in encoded texts; one per task."""

    def __init__(self, bench: Benchmark, cosine: float, verbatim: float, paraphrase: float, answer: float):
        self.bench, self.cosine, self.limits = bench, cosine, (verbatim, paraphrase, answer)
        self.most, self.width = max(bench.groups, default=1), len(bench.known)
        self.lists = [i.tolist() for i in bench.items]
        self.vectors = np.append(bench.vectors, np.zeros((1, bench.vectors.shape[1]), np.float32), 0)  # column -1 is for all other words
        size = np.array([len(i) for i in bench.items])
        # words of an item that a paraphrase and a copy hold at least
        self.some, self.most_words = (np.ceil(size * share - 1e-9).astype(int) for share in (paraphrase, verbatim))
        self.blocks, self.padded, self.row = np.zeros(len(size), int), {}, np.zeros(len(size), int)
        seeds = []
        self.hits = np.zeros(len(size), int)
        for blocks, items in bench.groups.items():
            self.blocks[items], self.row[items] = blocks, np.arange(len(items))
            self.padded[blocks] = np.full((len(items), size[items].max()), self.width)
            for row, i in enumerate(items):
                words = bench.items[i]
                self.padded[blocks][row, :len(words)] = words
                missed = len(words) - self.most_words[i]
                rare = words[np.argsort(-bench.idf[words], kind="stable")][:max(missed + 1, (len(words) + 1) // 2)]
                self.hits[i] = len(rare) - missed
                seeds += [(int(w), int(i)) for w in set(rare.tolist())]
        seeds = np.array(sorted(seeds), int).reshape(-1, 2)
        self.seed_items = seeds[:, 1]
        self.seeds = np.append(np.bincount(seeds[:, 0], minlength=self.width), 0)
        self.first_seed = np.cumsum(self.seeds) - self.seeds
        self.short: dict[int, dict[tuple, list[int]]] = {}
        for i, words in enumerate(self.lists):
            if len(words) < SHORT:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(i)
        self.codes = {n: np.unique([int(self.code(np.array(w), n)[0]) for w in items]) for n, items in self.short.items()}

    def code(self, columns: np.ndarray, size: int) -> np.ndarray:
        """One number for each run of ``size`` words; equal for equal runs."""
        runs, out = len(columns) - size + 1, np.zeros(1, np.int64)
        for k in range(size):
            out = out * (self.width + 1) + columns[k:k + runs].astype(np.int64) + 1
        return out

    def neighbours(self, held: np.ndarray, blocks: int, doubled: dict) -> tuple[np.ndarray, np.ndarray]:
        """(first block, item) of the windows of ``blocks`` blocks that are close to an item in the latent space."""
        items = self.bench.groups[blocks]
        place = np.flatnonzero(held[blocks:] - held[:-blocks] >= self.some[items].min())  # others hold too few words of any item
        total, done = None, 0
        for size in sorted(doubled, reverse=True):
            while done + size <= blocks:
                part = doubled[size][place + done]
                total = part if total is None else total + part
                done += size
        length = np.sqrt(np.einsum("ij,ij->i", total, total)) + 1e-12
        at, which = np.nonzero(total @ self.bench.latent[blocks].T >= self.cosine * length[:, None])
        place, item = place[at], items[which]
        enough = held[place + blocks] - held[place] >= self.some[item]
        return place[enough], item[enough]

    def seeded(self, columns: np.ndarray, blocks_in_all: int) -> tuple[np.ndarray, np.ndarray]:
        """(first block, item) of all windows that hold as many of an item's seeds as a copy must."""
        at = np.flatnonzero(self.seeds[columns])
        many = self.seeds[columns[at]]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item = self.seed_items[np.repeat(self.first_seed[columns[at]], many) + nth]
        cell, count = np.unique(item * blocks_in_all + np.repeat(at // BLOCK, many), return_counts=True)
        total, item = np.concatenate([[0], np.cumsum(count)]), cell // blocks_in_all
        end = np.searchsorted(cell, cell + self.blocks[item])
        hit = np.flatnonzero(total[end] - total[:-1] >= self.hits[item])
        if not len(hit):
            return hit, hit
        # the item may start before its first seed
        cell, back = cell[hit], self.blocks[item[hit]]
        before = np.arange(back.sum()) - np.repeat(np.cumsum(back) - back, back)
        place, item = np.repeat(cell % blocks_in_all, back) - before, np.repeat(item[hit], back)
        return place[place >= 0], item[place >= 0]

    def holding(self, rows: np.ndarray, place: np.ndarray, item: np.ndarray, blocks: int, least: np.ndarray) -> np.ndarray:
        """Which windows hold at least ``least`` of their item's words, in any order."""
        step = max(1, MARKS // (self.width + 1))
        marks, out = np.zeros((step, self.width + 1), bool), np.zeros(len(place), bool)
        for s in range(0, len(place), step):
            some = rows[place[s:s + step, None] + np.arange(blocks)].reshape(len(place[s:s + step]), -1)
            line = np.arange(len(some))[:, None]
            marks[line, some] = True
            marks[:, -1] = False
            out[s:s + step] = marks[line, self.padded[blocks][self.row[item[s:s + step]]]].sum(1) >= least[item[s:s + step]]
            marks[line, some] = False
        return out

    def candidates(self, columns: np.ndarray):
        """(item, first word, words of the window) in ``columns``, whose texts end with empty blocks.

        Latent neighbours that hold enough words for a paraphrase, and windows with enough seeds and words for a copy.
        """
        rows = columns.reshape(-1, BLOCK)
        step = self.vectors[rows[:, 0]]
        for k in range(1, BLOCK):
            step += self.vectors[rows[:, k]]
        power, doubled = step, {1: step}
        while 2 * max(doubled) <= self.most:
            size = max(doubled)
            power = power.copy()
            power[:-size] += doubled[size][size:]
            doubled[2 * size] = power
        held = np.concatenate([[0], np.cumsum((rows >= 0).sum(1))])
        near, copied = self.seeded(columns, len(rows))
        for blocks in self.bench.groups:
            place, item = self.neighbours(held, blocks, doubled)
            enough = self.holding(rows, place, item, blocks, self.some)
            mine = self.blocks[copied] == blocks
            place_, item_ = near[mine], copied[mine]
            copy = self.holding(rows, place_, item_, blocks, self.most_words)
            for cell in np.unique(np.concatenate([item[enough] * len(rows) + place[enough], item_[copy] * len(rows) + place_[copy]])).tolist():
                yield cell // len(rows), cell % len(rows) * BLOCK, blocks * BLOCK

    def word_for_word(self, columns: np.ndarray):
        """(item, first word) of the first place of each short item in the columns of one text."""
        for size, items in self.short.items():
            if len(columns) >= size:
                runs = self.code(columns, size)
                at = np.flatnonzero(np.isin(runs, self.codes[size]))
                for place in at[np.unique(runs[at], return_index=True)[1]].tolist():
                    yield from ((i, place) for i in items.get(tuple(columns[place:place + size].tolist()), ()))

    def run(self, texts) -> list[dict]:
        """For each encoded text of an iterable, the best match of each item: shares and first word of the window."""
        own, starts, parts, size, out, first = [], [], [], 0, [], 0

        def flush():
            nonlocal own, starts, parts, size, first
            for item, place, length in self.candidates(np.concatenate(parts)) if parts and self.bench.groups else ():
                k = int(np.searchsorted(starts, place, "right")) - 1
                at = place - starts[k]
                found = match(self.lists[item], own[k][at:at + length].tolist(), *self.limits)
                if found and found > out[first + k].get(item, ((-1.0, -1.0), 0))[0]:
                    out[first + k][item] = (found, at)
            first += len(own)
            own, starts, parts, size = [], [], [], 0

        for columns in texts:
            out.append({i: ((1.0, 1.0), at) for i, at in self.word_for_word(columns)})
            starts.append(size)
            own.append(columns)
            empty = -len(columns) % BLOCK + self.most * BLOCK
            parts += [columns, np.full(empty, -1, self.bench.kind)]
            size += len(columns) + empty
            if size >= 1 << 16:
                flush()
        flush()
        return out


#: Limits of a match: cosine of the latent vectors, common subsequence of a copy and of a paraphrase, answer.
LIMITS = {"cosine": 0.5, "verbatim": 0.8, "paraphrase": 0.6, "answer": 0.75}


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **limits) -> DataFrame:
    """``(key, item_id, share, answer_share, first_word)``: each benchmark item found in each row's whole text.

    ``share`` is the part of the item's words that stands in the best window in order, ``answer_share`` that of its last
    quarter. Null texts are empty and match nothing; repeated rows are reported repeatedly; rows with a null key are
    reported with a null; items with equal texts are all reported; items of fewer than ``SHORT`` words count where they
    stand word for word; an empty table on either side gives no rows. Only ``key`` and ``text`` are read; of two result
    columns of one name the later one gets underscores behind it.
    """
    names = [key]
    for name in (item, "share", "answer_share", "first_word"):
        while name in names:
            name += "_"
        names.append(name)
    kinds = [docs.schema[key].dataType, benchmark.schema[item].dataType, T.DoubleType(), T.DoubleType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    out = docs.sparkSession.createDataFrame([], schema)
    for bench in read_benchmarks(benchmark, item):
        coded = encoded(docs, bench, key, text)
        shared = docs.sparkSession.sparkContext.broadcast(fit(coded, bench))

        def run(batches, shared=shared):
            search = Search(shared.value, **{**LIMITS, **limits})
            for batch in batches:
                found = search.run(np.frombuffer(v.as_buffer(), search.bench.kind) for v in batch.column(1))
                rows = [(k, i, *best) for k, hits in enumerate(found) for i, best in sorted(hits.items())]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    search.bench.ids.take(pa.array([r[1] for r in rows], pa.int64())),
                    pa.array([r[2][0] for r in rows], pa.float64()), pa.array([r[2][1] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.int64())], names)

        out = out.unionByName(coded.where("columns IS NOT NULL").select("_key", "columns").mapInArrow(run, schema))
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **limits) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found. Null and empty texts stay."""
    at = docs.columns.index(text)
    kept = docs
    for bench in read_benchmarks(benchmark, item):
        shared = docs.sparkSession.sparkContext.broadcast(fit(encoded(docs, bench, key, text), bench))

        def run(batches, shared=shared):
            search = Search(shared.value, **{**LIMITS, **limits})
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in search.run(map(search.bench.columns, _texts(batch, at)))]))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
