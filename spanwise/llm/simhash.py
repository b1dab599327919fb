"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only where they meet at an anchor, a word of a covering code. The code is a direct sum of
perfect cyclic codes (binary Golay codes of length 23, covering radius 3, and a Hamming code of length 15, radius 1) over
the low bits; the rest is free. Two fingerprints that differ in at most ``t`` bits have a midpoint within ``h = ceil(t/2)``
bits of both. The midpoint's own anchor lies, block by block, within the covering radius, so both fingerprints are within
the radius of every block plus ``h`` bits in total of that anchor. Each fingerprint is therefore sent to every anchor
within covering radius plus ``h`` (about 61 of 2^24 for t = 4), and every link meets at one anchor at least: the result is
exact. More blocks are used as the number of distinct fingerprints grows, so that buckets stay short.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import fresh, stored, word_blocks
from spanwise.llm.components import components
from spanwise.llm.near_copies import near_copies, text_number

SEED = 42
#: Block codes: length, number of parity bits, generator polynomial, covering radius. Fixed values of the Golay and Hamming codes.
GOLAY, HAMMING = (23, 11, 0b110001110101, 3), (15, 4, 0b10011, 1)
CODES = {1: [GOLAY], 2: [GOLAY, GOLAY], 3: [GOLAY, GOLAY, HAMMING]}
#: Distinct fingerprints up to which one and two blocks are used.
BLOCK_STEPS = (1 << 12, 1 << 27)
#: Rows of one anchor beyond which its bucket is cut into pieces that are compared pair by pair of pieces.
HOT_ROWS = 1 << 16
_SHIFT_RUN = 512


def fingerprint(data: bytes, words: int = 4) -> int:
    """64-bit SimHash of the shingles of ``words`` words of lower-cased ``data``; fewer words are one shingle, none give 0."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for block in word_blocks(data.lower()):
        block = carry + block
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(block[i:] for i in range(words)))]
        carry = block[len(block) - words + 1:] if len(block) >= words else block
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            counts += bits.sum(0, dtype=np.int64)
            total += len(hashes)
    if not total and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``(key, fp)``: the fingerprint of every row's whole text, as a signed long. A null text counts as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)),
                               np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], [key, "fp"])

    return docs.select(key, F.encode(F.col(text), "UTF-8").alias("_text")).mapInArrow(run, f"{key} {kind}, fp long")


def _remainders(values: np.ndarray, parity: int, polynomial: int, length: int) -> np.ndarray:
    out = values.copy()
    for bit in range(length - 1, parity - 1, -1):
        out = np.where(out >> bit & 1, out ^ (polynomial << (bit - parity)), out)
    return out


class Anchors:
    """Anchors near fingerprints: for each block and excess over its covering radius, the patterns to each near code word."""

    def __init__(self, blocks: int, spare: int):
        self.spare, self.tables, shift = spare, [], 0
        for length, parity, polynomial, radius in CODES[blocks]:
            low = _remainders(np.arange(1 << 12), parity, polynomial, length)
            high = _remainders(np.arange(1 << max(0, length - 12)) << 12, parity, polynomial, length)
            lists = []
            for excess in range(spare + 1):
                weights = range(radius + 1) if excess == 0 else [radius + excess]
                patterns = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(length), w)])
                syndromes = low[patterns & 4095] ^ high[patterns >> 12]
                order = np.argsort(syndromes, kind="stable")
                number = np.bincount(syndromes, minlength=1 << parity)
                lists.append((patterns[order], np.cumsum(number) - number, number))
            self.tables.append((shift, length, parity, low, high, lists))
            shift += length

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors, for all anchors within the covering radius plus the spare bits."""
        rows, keys, used = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
        for shift, length, parity, low, high, lists in self.tables:
            value = ((fps >> np.uint64(shift)) & np.uint64((1 << length) - 1)).astype(np.int64)
            syndrome, parts = low[value & 4095] ^ high[value >> 12], []
            for excess, (patterns, starts, number) in enumerate(lists):
                take = np.flatnonzero(used + excess <= self.spare)
                own = syndrome[rows[take]]
                n = number[own]
                again = np.repeat(take, n)
                at = np.arange(len(again)) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
                word = (value[rows[again]] ^ patterns[at]) >> parity
                parts.append((rows[again], keys[again] << (length - parity) | word, used[again] + excess))
            rows, keys, used = (np.concatenate(x) for x in zip(*parts))
        return rows, keys


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component: as few links as the pairs need."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _long_run(fps: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is linked in a long bucket: found ones leave the rest, so a dense cluster is cheap."""
    found, rest = [], np.unique(fps)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            hit, reached = np.zeros(len(rest), bool), []
            for p in front:
                near = (np.bitwise_count(rest ^ p) <= threshold) & ~hit
                if near.any():
                    found.append((np.full(int(near.sum()), p), rest[near]))
                    reached.append(rest[near])
                    hit |= near
                    if hit.all():
                        break
            front, rest = np.concatenate(reached) if reached else rest[:0], rest[~hit]
    return found


def bucket_links(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all pairs within ``threshold`` bits that share a key. ``keys`` is sorted."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    long, parts = ends - starts > _SHIFT_RUN, []
    for s, e in zip(starts[long], ends[long]):
        parts += _long_run(fps[s:e], threshold)
    short = np.repeat(~long & (ends - starts > 1), ends - starts)
    k, f = keys[short], fps[short]
    left = np.repeat((ends - starts), ends - starts)[short] - 1 - (np.arange(len(keys)) - np.repeat(starts, ends - starts))[short]
    at, gap, held = np.arange(len(k)), 0, 0
    while True:
        gap += 1
        at = at[left[at] >= gap]
        if not len(at):
            break
        hit = at[np.bitwise_count(f[at] ^ f[at + gap]) <= threshold]
        hit = hit[f[hit] != f[hit + gap]]
        if len(hit):
            parts.append((f[hit], f[hit + gap]))
            held += len(hit)
            if held > 2_000_000:
                parts, held = [_forest(*(np.concatenate(x) for x in zip(*parts)))], 0
    if not parts:
        return fps[:0], fps[:0]
    return _forest(*(np.concatenate(x) for x in zip(*parts)))


def links(prints: DataFrame, threshold: int = 4, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(a, b)``: links that connect exactly the distinct fingerprints ``prints(fp)`` joined by steps of ``threshold`` bits."""
    spare, n = (threshold + 1) // 2, prints.count()
    anchors = Anchors(1 + sum(n > limit for limit in BLOCK_STEPS), spare)

    def replicas(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for s in range(0, len(fps), 4096):
                rows, keys = anchors.near(fps[s:s + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[s:s + 4096][rows].view(np.int64))], ["anchor", "fp"])

    def crowded(batches):
        for batch in batches:
            _, keys = anchors.near(np.asarray(batch.column(0)).view(np.uint64))
            keys, number = np.unique(keys, return_counts=True)
            keep = number >= 8  # an anchor that is rarer in every batch cannot become hot before the batches are very many
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(number[keep])], ["anchor", "n"])

    def compare(batches):
        held = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = int(np.argmax(same))  # the last bucket may go on in the next batch
            held = [x[cut:] for x in now]
            if cut:
                yield from done([x[:cut] for x in now])
        if held is not None:
            yield from done(held)

    def done(cols):
        run = np.cumsum(np.concatenate([[0], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)]))
        a, b = bucket_links(run, cols[2].view(np.uint64), threshold)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    met = prints.select("fp").mapInArrow(replicas, "anchor long, fp long").withColumn("piece", F.lit(0))
    hot = stored(prints.select("fp").mapInArrow(crowded, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
                 .where(F.col("n") > hot_rows), "simhash-hot")
    if not hot.isEmpty():
        # a hot bucket is cut into m pieces by fingerprint; each pair of pieces is one bucket of at most about 2 * hot_rows
        m = F.coalesce(F.ceil(F.col("n") / hot_rows).cast("int") + 1, F.lit(1))
        own = F.pmod(F.xxhash64("fp"), m).cast("int")
        met = met.drop("piece").join(hot, "anchor", "left").withColumn("m", m).withColumn("own", own).select(
            "anchor", "fp", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"), "own", "m").select(
            "anchor", "fp", (F.least("own", "other") * F.col("m") + F.greatest("own", "other")).cast("int").alias("piece"))
    by = ["anchor", "piece"]
    return met.select(*by, "fp").repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, threshold: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id, n_exact)`` for every row of ``docs``.

    Rows whose fingerprints differ in at most ``threshold`` bits are linked; ``component_id`` is the smallest ``key`` that
    can be reached, ``n_exact`` counts the rows with the same fingerprint. A null or empty text has fingerprint zero and is
    linked like any other. A row with a null key is kept, and its component's id is the smallest known key (null if none).
    Repeated rows are returned repeatedly. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    own = stored(fingerprints(docs, key, text, words), "simhash-prints")
    distinct = stored(own.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n_exact")), "simhash-distinct")
    found = components(links(distinct, threshold), "simhash")
    roots = found.join(distinct.select(F.col("fp").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    named = stored(found.join(roots, "root").select(F.col("node").alias("fp"), "least"), "simhash-named")
    known = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n_exact")
    return own.join(known, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_exact")


def text_links(docs: DataFrame, text: str = "text", words: int = 5, threshold: int = 4) -> DataFrame:
    """``(a, b)``: links between the numbers of different texts, as few as join what steps of ``threshold`` bits join."""
    own = stored(fingerprints(docs.select(text_number(text).alias("node"), F.col(text).alias("text")), "node", "text", words), "simhash-prints")
    distinct = stored(own.groupBy("fp").agg(F.min("node").alias("first")), "simhash-distinct")
    one, two = (distinct.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}")) for c in "ab")
    across = links(distinct, threshold).join(one, "a").join(two, "b").select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    same = own.join(distinct, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return across.unionByName(same).distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near-duplicates: the one with the smallest ``key``.

    Texts whose SimHash fingerprints meet at an anchor and differ in at most four bits are looked at first, then those that
    ``near_copies`` brings together, which are less alike; in both cases a Jaccard similarity of ``least`` or more makes
    near-duplicates. Of repeated rows of one key and text one stays, too. Rows without a key stay, as they cannot be told from each other.
    """
    node, id_ = fresh(docs, "_node", "_id")
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    linked = stored(text_links(slim, "text", words), "simhash-links")
    found = stored(near_copies(slim, "id", "text", words, least, linked), "copies-found")
    firsts = found.groupBy("component").agg(F.min("id").alias("first"))
    heads = stored(found.join(firsts, "component").where(F.col("id") == F.col("first")).groupBy("component", "first").agg(F.min("node").alias("head")), "copies-heads")
    groups = stored(found.join(heads, "component").where(F.col("id").isNotNull()).select(
        F.col("id").alias(id_), F.col("node").alias(node), ((F.col("id") == F.col("first")) & (F.col("node") == F.col("head"))).alias("stays")), "copies-groups")
    by = [id_, node]  # one key may stand on different texts
    others = groups.where("NOT stays").select(*by).distinct()
    again = stored(groups.where("stays").groupBy(*by).count().where("count > 1").select(*by), "copies-again")
    kept = docs.withColumns({id_: F.col(key), node: text_number(text)}).join(others, by, "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, by, "left_anti").unionByName(kept.join(again, by, "left_semi").dropDuplicates(by))
    return kept.select(*docs.columns)
