"""Links between shingle sets that meet in buckets, and the groups that the links make.

A bucket holds sets that may be alike. Its pairs are compared on full sets, exactly, without a pair
table and without all pairs of a group:

1. Every set goes to its largest bucket. A heavy bucket is cut into blocks, and a few pivots of the
   bucket join every block, so that copies of one text are linked in one pass over the bucket.
2. Components of these links are labels. One set of every label in a bucket is compared with those
   of its other labels, which joins most labels of one group.
3. What is left are pairs of different labels in one bucket: light buckets are compared as a whole,
   heavy ones by pairs of blocks. A label with much of a bucket has blocks of its own, which are not
   compared with each other.

Before sets are read, sketches thin each unit of work: of the tokens that fall into one cell, a
sketch has the parity, so two sketches differ in no more cells than their sets in tokens. Pairs that
differ too much for the threshold, or have one label, are no candidates; what hangs together by
candidates is a unit. Sketches take a hundredth of their sets.

So a bucket of n copies costs some n comparisons, whatever n; the pairs across labels, and no other
pairs, are left for the last pass, and none of these is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.components import components
from dialoom.llm.shingles import Hasher, mix, set_key
from dialoom.session import materialize

#: Work of a unit: shingles of its sets, with ``ROW_WORK`` for each set.
UNIT, ROW_WORK = 400_000, 500
PIVOTS = 8
#: Sets of a bucket that is thinned as a whole. Larger ones are cut into units first.
THINNED = 3000
#: Keys that are broadcast when a table of keys is joined: those with the most rows.
HOT = 1000


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row per key. The ``HOT`` keys with the largest ``weight`` (rows) are
    broadcast, so no key beyond a thousandth of all rows goes through an exchange."""
    top = materialize(keys.orderBy(F.col(weight).desc(), *on).limit(HOT))
    rest = keys.join(F.broadcast(top.select(*on)), on, "left_anti")
    others = [c for c in keys.columns if c not in on]
    marked = rows.join(F.broadcast(top.withColumn("_hot", F.lit(True))), on, "left")
    hot = marked.filter("_hot").drop("_hot")
    cold = marked.filter("_hot is null").drop("_hot", *others).join(rest, on, how)
    return hot.unionByName(cold)


def read_sets(texts: DataFrame, n: int = 5) -> DataFrame:
    """``node, shingles`` of the column ``text``: keys and sorted hashes of the distinct n-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [hasher.shingles(batch.column(0)[k].as_py(), n) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                ["node", "shingles"],
            )

    return texts.select("text").mapInArrow(run, "node binary, shingles binary")


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in a power of two of cells, a quarter to half as many as tokens."""
    cells = 64
    while 2 * cells < len(tokens):
        cells *= 2
    counts = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def candidates(sizes: list[int], sketches: list[bytes], per_cent: int, labels: list[bytes] | None = None) -> list[int]:
    """For each set the smallest one that it hangs together with by candidate pairs (of different labels)."""
    near = np.zeros((len(sizes), len(sizes)), bool)
    if len(sizes) <= 12:  # whole numbers are the quickest way for few sets
        numbers = [int.from_bytes(x, "little") for x in sketches]
        for b in range(1, len(sizes)):
            for a in range(b):
                small, large = (a, b) if len(sketches[a]) <= len(sketches[b]) else (b, a)
                if len(sketches[large]) > 2 * len(sketches[small]) or labels and labels[a] == labels[b]:
                    continue  # sizes too far apart, or joined already
                x, y, cells = numbers[small], numbers[large], 8 * len(sketches[small])
                if len(sketches[large]) > len(sketches[small]):
                    y = (y >> cells) ^ (y & ((1 << cells) - 1))
                near[a, b] = near[b, a] = (x ^ y).bit_count() * (100 + per_cent) <= (sizes[a] + sizes[b]) * (100 - per_cent)
        return groups_of(near)
    size = np.array(sizes, np.int64)
    widths = np.array([len(x) for x in sketches])
    bits = {}
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        raw = np.frombuffer(b"".join(sketches[k] for k in at), np.uint8).reshape(len(at), width)
        bits[int(width)] = at, np.unpackbits(raw, axis=1, bitorder="little")

    def compare(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> None:
        x, y = x.astype(np.float32), y.astype(np.float32)
        differ = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)  # whole numbers below 2 ** 24
        found = differ * (100 + per_cent) <= (size[a][:, None] + size[b][None, :]) * (100 - per_cent)
        near[np.ix_(a, b)] = found
        near[np.ix_(b, a)] = found.T

    for width, (a, x) in bits.items():
        compare(a, x, a, x)
        if 2 * width in bits:  # cells of the wider ones fold onto the narrower ones
            b, y = bits[2 * width]
            compare(a, x, b, y[:, : 8 * width] ^ y[:, 8 * width :])
    if labels:
        names = {label: k for k, label in enumerate(set(labels))}
        number = np.array([names[label] for label in labels])
        near &= number[:, None] != number[None, :]
    return groups_of(near)


def groups_of(near: np.ndarray) -> list[int]:
    """For each row of a symmetric matrix of flags the smallest row that it hangs together with."""
    label = np.full(len(near), -1)
    for seed in range(len(near)):
        if label[seed] < 0:
            label[seed], reached = seed, np.array([seed])
            while len(reached):
                reached = np.flatnonzero(near[reached].any(axis=0) & (label < 0))
                label[reached] = seed
    return label.tolist()


def _thin(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units as the groups that their candidates make. Rows come sorted by unit."""
        unit, rows = None, []
        out: list[tuple[int, bytes]] = []

        def settle() -> None:
            nodes, sizes, sketches, labels = zip(*rows, strict=True)
            group = candidates(sizes, sketches, per_cent, labels)
            met: dict[int, int] = {}
            for root in group:
                met[root] = met.get(root, 0) + 1
            for node, root in zip(nodes, group, strict=True):
                if met[root] > 1:
                    name = mix(np.array([unit], np.int64).view(np.uint64) + np.uint64(root)).view(np.int64)
                    out.append((int(name[0]), node))

        for batch in batches:
            for u, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if u != unit:
                    if len(rows) > 1:
                        settle()
                    unit, rows = u, []
                rows.append(row)
            yield _unit_rows(out)
            out.clear()
        if len(rows) > 1:
            settle()
        yield _unit_rows(out)

    return run


def _unit_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([u for u, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.binary())], ["unit", "node"]
    )


def _thinned(units: DataFrame, per_cent: int) -> DataFrame:
    """``unit, node`` of the candidates' groups in ``unit, node, n_shingles, sketch, label``, equal groups once."""
    rows = units.select("unit", "node", "n_shingles", "sketch", "label")
    placed = rows.repartition("unit").sortWithinPartitions("unit", "node")
    return _once(placed.mapInArrow(_thin(per_cent), "unit bigint, node binary"))


def linked(sets: list[np.ndarray], per_cent: int, columns: int = 4096) -> np.ndarray:
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


def _links(units: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Spanning forests of the links within each unit."""
    placed = units.join(sets.hint("merge"), "node").repartition("unit").sortWithinPartitions("unit").select("unit", "node", "shingles")
    return materialize(placed.mapInArrow(_verify(per_cent), "a binary, b binary"))


def _once(units: DataFrame) -> DataFrame:
    """``unit, node`` with units of equal members kept once; they compare by their size and two hashes."""
    rows = materialize(units.distinct())
    members = rows.groupBy("unit").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    wanted = members.filter("n > 1").groupBy("n", "x", "y").agg(F.min("unit").alias("unit")).select("unit")
    return materialize(rows.join(wanted, "unit", "left_semi"))


def _blocks(work: str, count: str) -> Column:
    return F.least(F.ceil(F.col(work) / F.lit(UNIT)), F.ceil(F.col(count) / 2)).cast("int")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("work").alias("total"))


def _home_units(home: DataFrame) -> DataFrame:
    """``unit`` and all columns of ``bucket, node, work, ...``: blocks of heavy buckets, each with the bucket's pivots."""
    sums = materialize(_sums(home, "bucket").filter("n > 1"))
    sized = materialize(join_hot(home, sums, ["bucket"], "n").withColumn("blocks", _blocks("total", "n")))
    own = sized.withColumn("unit", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    # Pivots: the smallest hash in each of a few lanes of the bucket.
    columns = [c for c in home.columns if c != "bucket"]
    first = sized.filter("blocks > 1").withColumn("lane", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PIVOTS)))
    least = F.min(F.struct(F.xxhash64("node", F.lit(2)).alias("h"), *columns)).alias("m")
    pivots = first.groupBy("bucket", "blocks", "lane").agg(least).select("bucket", "blocks", *[f"m.{c}" for c in columns])
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block")
    everywhere = pivots.select("*", block).withColumn("unit", F.xxhash64("bucket", "block"))
    return own.select("unit", *columns).unionByName(everywhere.select("unit", *columns)).dropDuplicates(["unit", "node"])


def _cross_units(rows: DataFrame) -> DataFrame:
    """``unit`` and all columns of rows of heavy buckets: pairs of blocks that may hold different labels."""
    columns = [c for c in rows.columns if c != "bucket"]
    # A label with more than a unit's work has cells of its own, the others share cells.
    own_cells = F.when(F.col("total") > UNIT, F.col("label")).otherwise(F.lit(b""))
    parts = materialize(_sums(rows, "bucket", "label").withColumn("owner", own_cells))
    plan = parts.groupBy("bucket", "owner").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    plan = materialize(plan.select("bucket", "owner", "n", _blocks("total", "n").alias("blocks")))
    owned = parts.filter("owner <> x''").select("bucket", "label", "n", "owner")
    placed = join_hot(rows, owned, ["bucket", "label"], "n", "left").withColumn("owner", F.coalesce("owner", F.lit(b""))).drop("n")
    placed = join_hot(placed, plan, ["bucket", "owner"], "n").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block")
    cell = plan.select("bucket", "owner", block).select("bucket", F.struct("owner", "block").alias("x"))
    pairs = cell.join(cell.withColumnRenamed("x", "y"), "bucket").filter(
        (F.col("x") <= F.col("y")) & ((F.col("x.owner") != F.col("y.owner")) | (F.col("x.owner") == F.lit(b"")))
    )
    unit = F.xxhash64("bucket", "x", "y").alias("unit")
    sides = pairs.select("bucket", "x.*", unit).unionByName(pairs.select("bucket", "y.*", unit)).distinct()
    return placed.join(sides, ["bucket", "owner", "block"]).select("unit", *columns)


def links_in_buckets(
    members: DataFrame, facts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], per_cent: int
) -> DataFrame:
    """``a, b``: links that join all sets linked within some bucket.

    ``members`` has distinct rows ``bucket, key, n`` (longs; ``n`` the rows of the bucket), ``facts``
    a row ``key, node, n_shingles, sketch`` for each key; both are read several times, so they
    should be written tables. ``sets_of`` gives ``node, shingles`` for a table of nodes.
    """
    work = (F.col("n_shingles") + ROW_WORK).alias("work")
    plain = facts.select("key", "node", "n_shingles", "sketch", work)
    own = F.col("node").alias("label")

    def compared(units: DataFrame) -> DataFrame:
        units = materialize(units)
        return _links(units, sets_of(materialize(units.select("node").distinct())), per_cent)

    # Neither side of these joins is small by design, so none is left to a size.
    home = members.groupBy("key").agg(F.max(F.struct("n", "bucket")).alias("h")).select("key", "h.bucket")
    home = materialize(home.join(plain.hint("merge"), "key").drop("key").withColumn("label", own))
    links = compared(_thinned(_home_units(home), per_cent))

    labels = materialize(components(links).select("node", F.col("root").alias("label")))
    named = plain.join(labels, "node").select("key", "label", "node")
    heads = members.join(named.hint("merge"), "key").groupBy("bucket", "label").agg(
        F.count("*").alias("rows"), F.max("n").alias("n"), F.min(F.struct(F.xxhash64("node", "bucket"), "key")).alias("m")
    )
    heads = materialize(heads.select("bucket", "label", "rows", "n", "m.key"))
    sums = heads.groupBy("bucket").agg(F.count("*").alias("heads"))
    few = heads.join(sums.filter(F.col("heads").between(2, THINNED)).select("bucket"), "bucket", "left_semi")
    few = materialize(few.select(F.col("bucket").alias("unit"), "label", "key")).join(plain.hint("merge"), "key")
    links = links.unionByName(compared(_thinned(few, per_cent)))
    # A bucket with one label has no pair across labels, whatever is joined later.
    one = heads.filter("rows = n").select("bucket")
    members = materialize(members.join(one, "bucket", "left_anti"))

    labels = materialize(components(links).select("node", F.col("root").alias("label")))
    named = materialize(plain.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    rest = members.join(named.hint("merge"), "key").drop("key")
    light = _thinned(rest.filter(F.col("n") <= THINNED).withColumnRenamed("bucket", "unit"), per_cent)
    heavy = _cross_units(materialize(rest.filter(F.col("n") > THINNED).drop("n")))
    return links.unionByName(compared(_once(light.unionByName(_thinned(heavy, per_cent)))))


def grouped(signed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``signed`` (``doc_id, n_shingles, node``).

    ``classes`` has one row ``node, first_id, n`` (smallest id and number of rows) per distinct set
    of rows with an id, ``links`` joins nodes. Rows of one id are one document, so its sets belong together. A row without an id has
    no component; one without a set is its own.
    """
    whole = signed.select("doc_id", "n_shingles", "node")
    named = whole.filter("doc_id is not null and node is not null")
    twins = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    several = named.select("doc_id", F.col("node").alias("b")).join(twins.select("doc_id", "a"), "doc_id")
    roots = components(links.unionByName(several.select("a", "b")))
    members = classes.select("node", "first_id").join(roots, "node")
    lowest = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = materialize(members.join(lowest, "root").select("node", "component_id"))
    ids = materialize(
        classes.select("node", "first_id", "n").join(moved, "node", "left").select(
            "node", "n", F.coalesce("component_id", "first_id").alias("component_id")
        )
    )
    # Rows without a set or an id need no join and stay where they are.
    found = join_hot(named, ids, ["node"], "n").select("doc_id", "n_shingles", "component_id")
    others = whole.filter("doc_id is null or node is null")
    return found.unionByName(others.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
