"""Benchmark decontamination: short test items found inside long documents.

An item counts as found if the document holds at least ``PER_CENT`` per cent of the item's distinct word
shingles. Items are partitioned by the size of their shingle set, and each partition has its own
number of minima: an item's signature is the shingle with the smallest hash under each of these
functions. A minimum lies in the document with a probability equal to the containment, so the
chance that none of k does is at most ``0.2 ** k``, below 1e-6 from ten on; small
items keep every shingle. Documents are searched with their whole shingle sets: a signature on
their side as well would lose short items, since a document's minimum lies in the item only with
|item| / |document|. Each hit is verified by exact containment of the full sets.

Documents are one pass without an exchange. The items go to the tasks in blocks of at most
``BLOCK`` shingles, so what a task holds is bounded whatever the size of the benchmark.

Defined results: documents and items without words match nothing. An item of fewer than five
words is one shingle of its own length and is sought as that run of words. Rows with a NULL id
are searched too. Repeated rows, of documents or items, give repeated pairs. Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.shingles import Hasher, mix

WORDS = 5
PER_CENT = 80
#: Size partitions of the items: the largest set of each, and the number of minima.
PARTITIONS = [(12, 12), (64, 12), (512, 16), (1 << 62, 24)]
BLOCK = 2_000_000
PAIRS = "doc_id bigint, item_id bigint, n_common bigint, n_shingles bigint"


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The signature of one item, by its size partition."""
    limit, count = next(p for p in PARTITIONS if len(shingles) <= p[0])
    if len(shingles) <= count:
        return shingles
    seeds = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(shingles[np.argmin(mix(shingles[None, :] ^ seeds[:, None]), axis=1)])


class ItemIndex:
    """A block of items: their signatures as one sorted table, and their full sets for the check."""

    def __init__(self, items: list[tuple[int | None, int, np.ndarray]]) -> None:
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, _, s in items]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {w for _, w, _ in items}:
            parts = [(k, _minima(s)) for k, (_, w, s) in enumerate(items) if w == width]
            keys = np.concatenate([m for _, m in parts])
            owners = np.concatenate([np.full(len(m), k, np.int64) for k, m in parts])
            order = np.argsort(keys, kind="stable")
            self.by_width[width] = keys[order], owners[order]

    def search(self, hasher: Hasher, text: str | None) -> Iterator[tuple[int | None, int, int]]:
        for width, (keys, owners) in self.by_width.items():
            found = hasher.all_shingles(text, width)
            if not len(found):
                continue
            low = np.searchsorted(keys, found, "left")
            hit = keys[np.minimum(low, len(keys) - 1)] == found
            if not hit.any():
                continue
            values = np.unique(found[hit])
            first, last = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
            candidates = np.unique(np.concatenate([owners[a:b] for a, b in zip(first, last, strict=True)]))
            whole = np.unique(found)
            for k in candidates.tolist():
                items = self.sets[k]
                at = np.minimum(np.searchsorted(whole, items), len(whole) - 1)
                common = int((whole[at] == items).sum())
                if common * 100 >= PER_CENT * len(items):
                    yield self.ids[k], common, len(items)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            width = min(WORDS, len(hasher.words(text)))
            if width:
                rows.append((item, width, hasher.shingles(text, width).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
            ["item_id", "width", "shingles"],
        )


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int | None, int, np.ndarray]]]:
    """The items in blocks of about ``limit`` shingles. Partitions come to the driver one by one."""
    block, size = [], 0
    for row in items.toLocalIterator():
        shingles = np.frombuffer(row["shingles"], np.uint64)
        block.append((row["item_id"], row["width"], shingles))
        size += len(shingles)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items = Hasher(), ItemIndex(block.value)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                doc = batch.column(0)[k].as_py()
                rows += [(doc, *pair) for pair in items.search(hasher, batch.column(1)[k].as_py())]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_common", "n_shingles"])

    return run


def contained_items(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """``doc_id, item_id, n_common, n_shingles``: the items that each document holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    wanted = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    shingled = wanted.mapInArrow(_items, "item_id bigint, width int, shingles binary")
    found = None
    for part in _blocks(shingled, block):
        shared = spark.sparkContext.broadcast(part)
        pairs = rows.mapInArrow(_search(shared), PAIRS)
        found = pairs if found is None else found.unionByName(pairs)
    return spark.createDataFrame([], PAIRS) if found is None else found


def _clean(block):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, items = Hasher(), ItemIndex(block.value)
        for texts in batches:
            yield texts.map(lambda t: next(items.search(hasher, t), None) is None).astype(bool)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "boolean")


def without_items(docs: DataFrame, items: DataFrame, text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, with all columns: a filter, without an exchange."""
    wanted = items.select(F.col("item_id").cast("long"), "text").mapInArrow(_items, "item_id bigint, width int, shingles binary")
    kept = docs
    for part in _blocks(wanted, block):
        kept = kept.filter(_clean(docs.sparkSession.sparkContext.broadcast(part))(F.col(text_column)))
    return kept


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs with their containment, for the registered query."""
    pairs = contained_items(docs, items)
    return pairs.withColumn("containment", F.col("n_common") / F.col("n_shingles"))
