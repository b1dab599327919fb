"""Groups of near copies by Jaccard similarity of word shingles.

Every text gets the minima of its shingles' hashes under ``BANDS`` times ``ROWS`` permutations; texts that agree in all rows
of one band meet. Two texts of similarity 0.8 fail to meet with a probability of 3e-6, those of 0.9 with 1e-12. The last byte
of every minimum makes a text's sketch; pairs whose sketches agree in fewer than ``AGREE`` of the places (which a pair at 0.8
does with a probability of 1e-6) go no further. In a band's bucket all are first compared with one of them, in a few rounds;
these pairs, a few for every text, are checked on the whole sets of shingles. Then the texts outside of a bucket's largest
group are compared with all that they are not yet joined to, inside tasks, a chunk of the one against a chunk of the other:
by sketches, which leaves the texts that agree with any other, and those again by their whole sets. Only texts leave the
first step, and only as many links as join the groups leave the second, so neither a large group of copies nor a large
bucket of texts that have less than the wanted similarity makes rows with the square of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import broadcast_checked, stored, word_blocks
from spanwise.llm.components import components

SEED = 42
#: Bands, and rows of a band.
BANDS, ROWS = 32, 5
#: Rounds in which a bucket's texts are compared with one of them; share of a sketch that must agree.
STARS, AGREE = 2, 0.65
#: Texts of a chunk of sketches, bytes of a chunk of sets; cells of the table of sets and shingles that is held at a time.
CHUNK, CHUNK_BYTES, CELLS = 64, 1 << 18, 1 << 22
_RUN = 512


def shingles(data: bytes, words: int = 5):
    """Hashes of the shingles of ``words`` words of lower-cased ``data``, in runs; fewer words are one shingle, none give none."""
    carry, some = [], False
    for block in word_blocks(data.lower()):
        block = carry + block
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(block[i:] for i in range(words)))]
        carry = block[len(block) - words + 1:] if len(block) >= words else block
        if hashes:
            some = True
            yield np.array(hashes, np.uint64)
    if carry and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def shingle_set(data: bytes, words: int = 5) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(data, words)]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def text_number(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``(key, node, sketch, b0, b1, ...)`` of every row: a number for its text, the sketch, and a number for each band."""
    kind = docs.schema[key].dataType.simpleString()
    random = np.random.default_rng(SEED)
    turn = random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
    odd = random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    mix = random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = random.integers(0, 1 << 63, BANDS, dtype=np.uint64)
    names = [f"b{i}" for i in range(BANDS)]

    def run(batches):
        for batch in batches:
            least = np.full((batch.num_rows, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
            for i, value in enumerate(batch.column(2)):
                for hashes in shingles(value.as_buffer().to_pybytes() if value.is_valid else b"", words):
                    low = hashes.astype(np.uint32)[:, None]
                    for s in range(0, len(low), _RUN):
                        np.minimum(least[i], ((low[s:s + _RUN] ^ turn) * odd).min(0), out=least[i])
            small = [r.tobytes() for r in least.astype(np.uint8)]
            bands = (least.reshape(-1, BANDS, ROWS) * mix).sum(2, dtype=np.uint64) + base
            bands ^= bands >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary()),
                                              *(pa.array(np.ascontiguousarray(b).view(np.int64)) for b in bands.T)], [key, "node", "sketch", *names])

    return docs.select(key, text_number(text).alias("node"), F.encode(F.col(text), "UTF-8").alias("_text")).mapInArrow(
        run, f"{key} {kind}, node long, sketch binary, " + ", ".join(f"{b} long" for b in names))


def _rows_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sketches agree enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_rows_of(batch.column(2)) == _rows_of(batch.column(3))).mean(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same >= AGREE))

    one, two = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _chunks(cells: DataFrame, whole: str, rows: int, columns: list[str]) -> DataFrame:
    """Each bucket's texts outside of its largest group against all its texts, ``(place, outside, inside)``, a chunk a row.

    ``whole`` is the size of a text; chunks hold about ``rows`` of it.
    """
    out = F.col("root") != F.col("most")
    sizes = cells.groupBy("place").agg(F.sum(F.expr(whole)).alias("all"), F.sum(F.when(out, F.expr(whole))).alias("few")).where("few IS NOT NULL")
    sized = cells.join(broadcast_checked(stored(sizes, "copies-sizes")), "place")

    def side(some: DataFrame, size: str, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col(size) / rows)).alias("chunk")
        return some.groupBy("place", part).agg(F.collect_list(F.struct(*columns)).alias(name)).drop("chunk")

    return side(sized.where(out), "few", "outside").join(side(sized, "all", "inside"), "place").select("place", "outside", "inside")


def _sides(batch: pa.RecordBatch):
    """For each row of a batch of chunks both sides, as a list of column slices."""
    sides = []
    for column in (batch.column(1), batch.column(2)):
        flat = column.flatten()
        sides.append((np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), flat.flatten()))
    for i in range(batch.num_rows):
        yield [[c[at[i]:at[i + 1]] for c in columns] for at, columns in sides]


def _agree(one: list, two: list) -> np.ndarray:
    """Which texts of two sides, of different groups, have sketches that agree enough."""
    same = np.zeros((len(one[0]), len(two[0])), bool)
    sketch, sketch_ = _rows_of(one[2]), _rows_of(two[2])
    for i in range(len(sketch)):
        same[i] = (sketch[i] == sketch_).mean(1) >= AGREE
    return same & (one[1].to_numpy()[:, None] != two[1].to_numpy())


def _similar(one: list[np.ndarray], two: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets of two lists have a similarity of ``least`` or more; shared shingles are counted for all pairs at once."""
    sizes = [np.array([len(x) for x in side]) for side in (one, two)]
    _, number = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    own = np.repeat(np.arange(len(one) + len(two)), np.concatenate(sizes))
    order = np.argsort(number, kind="stable")
    number, own = number[order], own[order]
    shared, wide = np.zeros((len(one), len(two))), 1 + CELLS // (len(one) + len(two))
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, wide):
        part = slice(*np.searchsorted(number, [start, start + wide]))
        has = np.zeros((len(one) + len(two), min(wide, int(number[-1]) + 1 - start)), np.float32)
        has[own[part], number[part] - start] = 1
        shared += has[:len(one)] @ has[len(one):].T
    every = sizes[0][:, None] + sizes[1] - shared
    return (every == 0) | (shared / np.maximum(every, 1) >= least)  # two empty sets are alike


def _across(now: DataFrame, sketches: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links ``(a, b)`` that join the groups of ``now(place, node, root)`` as all similar pairs of a bucket's texts would."""
    sizes = now.groupBy("place", "root").count()
    most = sizes.join(sizes.groupBy("place").agg(F.max("count").alias("count")), ["place", "count"]).groupBy("place").agg(F.min("root").alias("most"))
    cells = stored(now.join(broadcast_checked(stored(most, "copies-most")), "place"), "copies-cells")

    def agreeing(batches):
        for batch in batches:
            for place, (one, two) in zip(batch.column(0), _sides(batch)):
                same = _agree(one, two)
                some = np.unique(np.concatenate([one[0].to_numpy()[same.any(1)], two[0].to_numpy()[same.any(0)]]))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), place.as_py())), pa.array(some)], ["place", "node"])

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_buffer().to_pybytes(), words).tobytes() for t in batch.column(1)], pa.binary())], ["node", "whole"])

    def joining(batches):
        for batch in batches:
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while above.get(x, x) != x:
                    above[x] = x = above.get(above[x], above[x])
                return x

            a, b = [], []
            for one, two in _sides(batch):
                same = _agree(one, two)
                rows, columns = np.flatnonzero(same.any(1)), np.flatnonzero(same.any(0))
                if not len(rows):
                    continue
                sets = [[np.frombuffer(side[3][int(i)].as_buffer(), np.uint64) for i in at] for side, at in ((one, rows), (two, columns))]
                hit = np.nonzero(_similar(*sets, least) & same[np.ix_(rows, columns)])
                x, y = rows[hit[0]], columns[hit[1]]
                for i, j, p, q in zip(one[0].to_numpy()[x].tolist(), two[0].to_numpy()[y].tolist(), one[1].to_numpy()[x].tolist(), two[1].to_numpy()[y].tolist()):
                    p, q = top(p), top(q)
                    if p != q:
                        above[p] = q
                        a.append(min(i, j))
                        b.append(max(i, j))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = ["node", "root", "sketch"]
    close = stored(_chunks(stored(cells.join(sketches, "node"), "copies-sketched"), "1", CHUNK, columns).mapInArrow(
        agreeing, "place long, node long").distinct(), "copies-close")
    wanted = close.select("node").distinct()
    sets = stored(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(hashed, "node long, whole binary"), "copies-sets")
    held = cells.join(close, ["place", "node"], "left_semi").join(sketches, "node").join(sets, "node")
    return _chunks(stored(held, "copies-held"), "length(whole) + 160", CHUNK_BYTES, [*columns, "whole"]).mapInArrow(
        joining, "a long, b long").distinct()


def _alike(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets of shingles have a similarity of ``least`` or more."""

    def run(batches):
        sets: dict[int, np.ndarray] = {}

        def of(node, text):
            if node not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[node] = shingle_set(text.as_buffer().to_pybytes(), words)
            return sets[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = [jaccard(of(x, s), of(y, t)) >= least for x, y, s, t in zip(a, b, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, first: DataFrame | None = None
) -> DataFrame:
    """``(key, node, component)`` for every row of ``docs``: numbers for its text and for the group of texts that it belongs to.

    Texts whose sets of ``words``-word shingles have a Jaccard similarity of ``least`` or more are linked; a group holds
    all that links reach. Texts without words are alike. Pairs ``first(a, b)`` of texts' numbers are checked before those
    that bands bring together, whether they share a band or not.
    """
    own = stored(sketches(docs, key, text, words), "copies-sketches")
    bands = [f"b{i}" for i in range(BANDS)]
    places = own.groupBy("node").agg(*(F.first(b).alias(b) for b in bands)).select("node", F.explode(F.array(*bands)).alias("place"))
    places = stored(places, "copies-places")
    shared = places.groupBy("place").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("place")
    met = stored(places.join(shared, "place"), "copies-met")
    small = stored(own.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch")), "copies-small")
    nodes = met.select("node") if first is None else met.select("node").union(first.select("a")).union(first.select("b"))
    wanted = broadcast_checked(stored(nodes.distinct(), "copies-wanted"))
    texts = stored(docs.select(text_number(text).alias("node"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
                   .join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "copies-texts")
    tested = roots = None
    if first is not None and not first.isEmpty():
        tested, found = first, stored(_alike(first, texts, words, least), "copies-links")
        if not found.isEmpty():
            roots = components(found, "copies")

    def placed() -> DataFrame:
        """The rows of ``met`` with the group found so far, in buckets that hold more than one."""
        now = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").select(
            "place", "node", F.coalesce("root", "node").alias("root"))
        several = now.groupBy("place").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("place")
        return stored(now.join(several, "place"), "copies-open")

    for turn in range(STARS + 1):
        now = placed()
        if now.isEmpty():
            break
        if turn < STARS:
            salt = F.lit(int(np.random.default_rng(turn).integers(0, 1 << 62)))
            star = now.groupBy("place").agg(F.min(F.col("node").bitwiseXOR(salt)).bitwiseXOR(salt).alias("with"))
            heads = star.join(now.select("place", F.col("node").alias("with"), F.col("root").alias("other")), ["place", "with"])
            pairs = _agreeing(now.join(heads, "place").where("root <> other").select(
                F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct(), small)
            pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "copies-pairs")
            found = stored(_alike(pairs, texts, words, least), "copies-links")
            tested = pairs if tested is None else tested.unionByName(pairs)
        else:
            found = stored(_across(now, small, texts, words, least), "copies-links")
        if not found.isEmpty():
            # the groups found so far go on as a link from each text to its group's smallest
            roots = components(found if roots is None else found.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))), "copies")
    if roots is None:
        return own.select(key, "node", F.col("node").alias("component"))
    return own.select(key, "node").join(roots, "node", "left").select(key, "node", F.coalesce("root", "node").alias("component"))
