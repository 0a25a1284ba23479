"""Near-duplicate documents by MinHash and an LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes), the set's 16-byte
   key and a signature of ``TREES * DEEPEST`` minima. Texts with one set are one class.
2. The forest: each tree is an order of the classes sorted by its own stretch of the signature.
   The orders are range-partitioned, so a region of alike signatures spreads over tasks. A class
   without a neighbour that shares the first ``SHALLOWEST`` minima has no candidate in that tree.
3. Depth adapts to each region: a prefix shared by a light region (``UNIT`` of work at most) ends
   it, a heavier one goes a minimum deeper. What is still heavy at ``DEEPEST`` is cut into blocks,
   and every pair of blocks is a unit of work: no candidate is dropped.
4. A unit compares all its classes on full sets and returns the links' spanning forest, so a group
   of n near copies gives some n links, not n squared. Units with equal members run once.
5. Components of the links, by randomised contraction, name every document's group.

A pair at a Jaccard similarity of s shares a prefix of d minima in a tree with probability
s ** d. Twenty trees miss a pair at 0.85 with probability 6e-9 at depth 3 and 4e-7 at depth 4, and
a pair at 0.8 with 6e-7 and 3e-5.

Defined results: a NULL text, or one without words, has no shingles and links with nothing; its
component is its own id. A text of fewer than five words is one shingle. Rows with equal ids are
one document for the component; a row with a NULL id is linked with nothing, its component is
NULL and it is kept. An empty table gives an empty result. Only the id and text columns are read,
so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.components import components
from dialoom.llm.shingles import Hasher, MinHash, set_key
from dialoom.session import materialize

PER_CENT = 85  # of the registered query
TREES = 20
SHALLOWEST, DEEPEST = 3, 4
#: Work of a unit: shingles of its classes, with ``ROW_WORK`` for each class.
UNIT, ROW_WORK = 400_000, 500

SIGNED = "doc_id bigint, n_shingles bigint, node binary, signature binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, minhash = Hasher(), MinHash(TREES * DEEPEST)
    for batch in batches:
        sizes, nodes, signatures = [], [], []
        for k in range(batch.num_rows):
            shingles = hasher.shingles(batch.column(1)[k].as_py())
            sizes.append(len(shingles))
            nodes.append(set_key(shingles))
            signatures.append(minhash.signature(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "node", "signature"],
        )


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted slice, the rows whose neighbour shares the shallowest prefix, and its two ends.

    What lies beyond an end is another task's, so the ends stay; counting sorts them out later.
    """
    prefix = 1 + 4 * SHALLOWEST
    last: pa.RecordBatch | None = None
    joined = True  # whether the row held back is known to stay
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
        heads = [x[:prefix] for x in whole.column(0).to_pylist()]
        alike = np.array([a == b for a, b in zip(heads[:-1], heads[1:], strict=True)], bool)
        before = np.concatenate(([joined], alike))
        keep = before[:-1] | alike
        yield whole.slice(0, len(heads) - 1).filter(pa.array(keep))
        last, joined = whole.slice(len(heads) - 1), bool(before[-1])
    if last is not None:
        yield last


def _forest(classes: DataFrame) -> DataFrame:
    """``key, node, n_shingles``: tree number and path of every class that has a neighbour."""
    paths = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.concat(
            F.to_binary(F.lpad(F.hex(t), 2, "0"), F.lit("hex")),
            F.substring("signature", t * (4 * DEEPEST) + 1, F.lit(4 * DEEPEST)),
        ),
    )
    rows = classes.select(F.explode(paths).alias("key"), "node", "n_shingles")
    placed = rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return placed.mapInArrow(_with_neighbours, "key binary, node binary, n_shingles bigint")


def _regions(forest: DataFrame) -> DataFrame:
    """``region, blocks, node``: each class in its regions, the depth chosen by the region's work."""
    work = F.col("n_shingles") + F.lit(ROW_WORK)
    rest, done = forest, None
    for depth in range(SHALLOWEST, DEEPEST + 1):
        at = rest.withColumn("region", F.substring("key", 1, 1 + 4 * depth))
        sums = at.groupBy("region").agg(F.count("*").alias("rows"), F.sum(work).alias("work")).filter("rows > 1")
        sized = at.join(sums, "region")
        blocks = F.least(F.ceil(F.col("work") / F.lit(UNIT)), F.col("rows")).cast("int")
        light = sized if depth == DEEPEST else sized.filter(F.col("work") <= UNIT)
        part = light.select("region", blocks.alias("blocks"), "node")
        done = part if done is None else done.unionByName(part)
        if depth < DEEPEST:
            rest = materialize(sized.filter(F.col("work") > UNIT).select("key", "node", "n_shingles"))
    return done


def _units(regions: DataFrame) -> DataFrame:
    """``unit, node``: regions as units of work, heavy ones as pairs of blocks, equal ones once."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = regions.select("region", "node", own.alias("own"), other.alias("other"))
    rows = materialize(
        rows.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "node").distinct()
    )
    # Members are compared by two hashes of the set and its size.
    members = rows.groupBy("unit").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    wanted = members.filter("n > 1").groupBy("n", "x", "y").agg(F.min("unit").alias("unit")).select("unit")
    return materialize(rows.join(wanted, "unit", "left_semi"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        found = [hasher.shingles(batch.column(0)[k].as_py()) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
            ["node", "shingles"],
        )


def linked(sets: list[np.ndarray], per_cent: int = PER_CENT, columns: int = 4096) -> np.ndarray:
    """Which sets are linked, as a square matrix of flags, from exact intersection sizes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owners, column = owners[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    common = np.zeros((len(sets), len(sets)), np.float64)
    # Columns come in order, so each stretch of them is a slice.
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [begin, begin + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[owners[a:b], column[a:b] - begin] = 1.0
        common += block @ block.T  # below 2 ** 24, so exact
    union = sizes[:, None] + sizes[None, :] - common
    return 100 * common >= per_cent * union


def forest_of(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its component."""
    label = np.arange(len(links))
    while True:
        lower = np.where(links, label[None, :], len(links)).min(axis=1)
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _verify(per_cent: int):
    """Links within each unit. Rows come sorted by unit; one unit is held at a time."""

    def links_of(nodes: list[bytes], sets: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
        root = forest_of(linked(sets, per_cent))
        at = [k for k in range(len(nodes)) if root[k] != k]
        return [nodes[k] for k in at], [nodes[root[k]] for k in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sets = None, [], []
        for batch in batches:
            a, b = [], []
            for k, u in enumerate(batch.column(0).to_pylist()):
                if u != unit:
                    if len(nodes) > 1:
                        x, y = links_of(nodes, sets)
                        a, b = a + x, b + y
                    unit, nodes, sets = u, [], []
                nodes.append(batch.column(1)[k].as_py())
                sets.append(np.frombuffer(batch.column(2)[k].as_py(), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        if len(nodes) > 1:
            a, b = links_of(nodes, sets)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_cent: int = PER_CENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked at a Jaccard similarity of ``per_cent`` or more; the trees are made for 80
    and above.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = materialize(texts.mapInArrow(_sign, SIGNED))
    named = signed.filter("doc_id is not null and node is not null")
    classes = materialize(
        named.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        )
    )
    forest = materialize(_forest(classes.select("node", "n_shingles", "signature")))
    units = _units(_regions(forest))
    wanted = units.select("node").distinct()
    readers = materialize(classes.join(wanted, "node", "left_semi").select(F.col("first_id").alias("doc_id")))
    sets = texts.join(readers, "doc_id", "left_semi").select("text").mapInArrow(_sets, "node binary, shingles binary")
    # An id that stands on several rows may give a set twice, or one that is not wanted.
    sets = materialize(sets).dropDuplicates(["node"])
    placed = units.join(sets, "node").repartition("unit").sortWithinPartitions("unit").select("unit", "node", "shingles")
    links = materialize(placed.mapInArrow(_verify(per_cent), "a binary, b binary"))
    # Rows of one id are one document, so its classes belong together.
    twins = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    several = named.select("doc_id", F.col("node").alias("b")).join(twins.select("doc_id", "a"), "doc_id")
    roots = components(links.unionByName(several.select("a", "b")))
    grouped = classes.select("node", "first_id").join(roots, "node")
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = materialize(grouped.join(lowest, "root").select("node", "component_id"))
    ids = classes.select("node", "first_id").join(moved, "node", "left").select(
        "node", F.coalesce("component_id", "first_id").alias("component_id")
    )
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
        .select("doc_id", "n_shingles", found.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_copies(docs: DataFrame, per_cent: int = 80) -> DataFrame:
    """One document of each group, with all columns: the one with the smallest id."""
    copies = near_duplicates(docs, per_cent=per_cent).filter(~F.col("kept")).select("doc_id")
    return docs.join(materialize(copies), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
