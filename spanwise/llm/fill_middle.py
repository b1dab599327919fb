"""Fill-in-the-middle texts: whole texts cut at unit boundaries that a Fenwick tree finds.

A unit is a word with the white space before it, or white space that ends a text. A text is seen as blocks of ``BLOCK``
bytes; a Fenwick tree holds the units that end in each block and the code points that begin in it. A binary-lifting descent
finds the block in which the unit before a cut ends, with the units and code points before that block; only this block is
then looked at again. Texts are independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a tree's block, bytes counted at a time, bytes of text in a batch of results.
BLOCK, RUN, BATCH = 4096, 1 << 20, 32 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def unit_ends(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """Whether a unit ends with each byte of ``data[start:end]``: a word before white space, or the text itself."""
    blank = _BLANK[data[start:end + 1]]
    if end < len(data):
        return ~blank[:-1] & blank[1:]
    return np.append(~blank[:-1] & blank[1:], np.ones(min(1, len(blank)), bool))


def first_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return data & 0xC0 != 0x80


class TextTree:
    """Fenwick tree over a text's blocks: row 0 counts unit ends, row 1 code points."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        blocks = -(-len(data) // BLOCK)
        self.sums = np.zeros((2, blocks + 1), np.int64)
        for start in range(0, len(data), RUN):
            end = min(start + RUN, len(data))
            edges, first = np.arange(0, end - start, BLOCK), 1 + start // BLOCK
            self.sums[0, first:first + len(edges)] = np.add.reduceat(unit_ends(self.data, start, end), edges, dtype=np.int64)
            self.sums[1, first:first + len(edges)] = np.add.reduceat(first_bytes(self.data[start:end]), edges, dtype=np.int64)
        self.units, self.points = self.sums.sum(1).tolist()
        step = 1
        while step <= blocks:
            low = np.arange(step, blocks + 1 - step, 2 * step)
            self.sums[:, low + step] += self.sums[:, low]
            step *= 2

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the text's first ``units`` units."""
        if not units:
            return 0, 0
        block, points, last = 0, 0, self.sums.shape[1] - 1
        for bit in reversed(range(last.bit_length())):
            there = block + (1 << bit)
            if there <= last and self.sums[0, there] < units:
                block, units, points = there, units - int(self.sums[0, there]), points + int(self.sums[1, there])
        start = block * BLOCK
        ends = np.flatnonzero(unit_ends(self.data, start, min(start + BLOCK, len(self.data))))
        end = start + int(ends[units - 1]) + 1
        return end, points + int(first_bytes(self.data[start:end]).sum())


def fill_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, share: int = 50, spm_share: int = 80,
) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs``.

    ``n`` units are cut at two places that follow from ``seed`` and the key. ``share`` percent of the rows are turned round,
    ``spm_share`` percent of these into ``<S>suffix<P>prefix<M>middle`` (spm), the others into
    ``<P>prefix<S>suffix<M>middle`` (psm); the rest stay as they are (plain), and so do empty texts and those that hold one of
    the three marks. A null text is empty; a null key counts as empty text in the seed. Equal rows have equal results; other
    columns are not read; an empty table gives an empty result. Prefix and middle lengths are null for plain rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | marked | (numbers[2] % 100 >= share), "plain").when(numbers[3] % 100 < spm_share, "spm").otherwise("psm")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    fields = ["key", "n", "form", "prefix_chars", "middle_chars", "output"]

    def turned(data: bytes, form: str, one: int, two: int) -> tuple:
        tree = TextTree(data)
        n = tree.units
        if form == "plain":
            return n, None, None, data
        cuts = sorted((one % (n + 1), two % (n + 1)))
        (a, points_a), (b, points_b) = tree.cut(cuts[0]), tree.cut(cuts[1])
        head, tail = marks[0] + data[:a], marks[1] + data[b:]
        return n, points_a, points_b - points_a, (tail + head if form == "spm" else head + tail) + marks[2] + data[a:b]

    def run(batches):
        for batch in batches:
            rows, held, first = [], 0, 0
            for i, values in enumerate(zip(batch.column(1), *(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                rows.append(turned(values[0].as_buffer().to_pybytes(), *values[1:]))
                held += len(rows[-1][-1])
                if held >= BATCH or i + 1 == batch.num_rows:
                    n, before, between, output = zip(*rows)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(first, len(rows)), pa.array(n, pa.int64()), batch.column(2).slice(first, len(rows)),
                        pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], fields)
                    rows, held, first = [], 0, i + 1

    given = docs.select(F.col(key).alias("key"), whole.cast("binary").alias("whole"), form.alias("form"),
                        numbers[0].alias("one"), numbers[1].alias("two"))
    out = given.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` of this ``form`` was made of."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    at = lambda *places: F.concat(*(F.get(part, F.lit(i)) for i in places))
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))
