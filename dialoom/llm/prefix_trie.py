"""The trie of shared conversation prefixes, by a z-fast trie over hashed turns.

1. Turns are numbered within their conversation and replaced by 128-bit hashes; a conversation is
   cut into stretches of ``STRETCH`` turns, so that a very long one spreads over tasks. The head of
   each rebuilt conversation comes from its hundred's first one.
2. The hash of a prefix is a running sum of turn hashes salted with their depth, so that stretches
   are summed apart and shifted by the stretches before them.
3. The stretches are range-partitioned by their first prefixes. Each task inserts its stretches,
   batch by batch, into z-fast tries: compacted nodes, found by a hash table whose keys are the
   prefixes at the nodes' two-fattest depths. A fat binary search over a stretch's depths finds
   its exit node in a logarithmic number of probes; the node's edge is split there. Then the edges
   are expanded into one row per depth, and equal prefixes of several tasks are added up.
4. Subtree sums: a conversation's path holds all ancestors of the nodes whose smallest member it
   is. Their values become sums from the path's end up, one row per turn of a conversation, added
   up per prefix. No row is sent to each of its ancestors.

Defined results: rows with a NULL id are left out; a NULL turn comes first; rows of equal turn
follow their role and then the MD5 of their text; a NULL role or text is the empty one. Equal rows
are turns each. A hundred without a first conversation gives no head. An empty table has no nodes.
Only the four named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import whole
from dialoom.llm.shingles import mix
from dialoom.operators.ordering import position_within
from dialoom.session import materialize

HUNDRED = 100  # conversations that share a head
HEADS = 6  # a head has fewer turns than this
STRETCH = 4096
#: Prefixes that a task's tries hold before they are written out and begun anew.
HELD = 1_000_000
LEADING = 8  # prefixes that place a stretch
NO_ENDS = hashlib.sha256(b"").hexdigest()
_SALTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted nodes over strings of prefix hashes that begin at one depth, ``start``.

    The first hash of a string is the one at ``start``; strings with different ones are trees apart.
    """

    def __init__(self, start: int) -> None:
        self.start = start
        self.strings: list[list[int]] = []
        self.handles: dict[int, int] = {}  # prefix at a node's two-fattest depth -> node
        self.children: dict[int, int] = {}  # prefix one deeper than a node -> the child there
        self.roots: dict[int, int] = {}
        self.extent: list[int] = []  # depth of each node
        self.parent: list[int] = []
        self.of: list[int] = []  # a string that goes through the node
        self.count: list[int] = []
        self.least: list[int] = []

    def at(self, node: int, depth: int) -> int:
        return self.strings[self.of[node]][depth - self.start]

    def _add(self, extent: int, parent: int, string: int) -> int:
        self.extent.append(extent)
        self.parent.append(parent)
        self.of.append(string)
        self.count.append(0)
        self.least.append(0)
        return len(self.extent) - 1

    def _handle(self, node: int) -> int:
        return self.at(node, two_fattest(self.extent[self.parent[node]], self.extent[node]))

    def exit_node(self, root: int, ids: list[int]) -> int:
        """The deepest node whose whole prefix the string has, by fat binary search."""
        start = self.start
        node, low, high = root, start, start + len(ids) - 1
        while low < high:
            depth = two_fattest(low, high)
            met = self.handles.get(ids[depth - start])
            if met is None:
                high = depth - 1
            elif (end := self.extent[met]) < start + len(ids) and ids[end - start] == self.at(met, end):
                node, low = met, end
            else:  # the string leaves within the edge above this node
                return self.parent[met]
        return node

    def insert(self, ids: list[int], count: int, least: int) -> bool:
        """Add a string that ``count`` conversations have, the smallest of them ``least``; False if it was there."""
        start, string = self.start, len(self.strings)
        last = start + len(ids) - 1
        self.strings.append(ids)
        root = self.roots.get(ids[0])
        used = root is None
        if root is None:
            self.roots[ids[0]] = root = self._add(start, -1, string)
        node = self.exit_node(root, ids)
        while (depth := self.extent[node]) < last:
            child = self.children.get(ids[depth + 1 - start])
            used = True
            if child is None:
                leaf = self._add(last, node, string)
                self.children[ids[depth + 1 - start]] = leaf
                self.handles[self._handle(leaf)] = leaf
                node = leaf
                break
            # The last depth that string and edge share: equal prefixes have equal hashes.
            low, high = depth + 1, min(self.extent[child], last)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if ids[middle - start] == self.at(child, middle) else (low, middle - 1)
            if low == self.extent[child]:
                node = child
                continue
            del self.handles[self._handle(child)]
            split = self._add(low, node, self.of[child])
            self.children[ids[depth + 1 - start]] = split
            self.children[self.at(child, low + 1)] = child
            self.parent[child] = split
            self.handles[self._handle(split)] = split
            self.handles[self._handle(child)] = child
            node = split
        if not used:
            self.strings.pop()
        self.least[node] = min(self.least[node], least) if self.count[node] else least
        self.count[node] += count
        return used

    def expand(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """``prefix, parent prefix, depth, string, members, smallest member`` of every depth of every edge."""
        for node in sorted(range(len(self.extent)), key=self.extent.__getitem__, reverse=True):
            above, string = self.parent[node], self.of[node]
            ids, start = self.strings[string], self.start
            if above < 0:
                if start == 0:
                    yield ids[0], 0, 0, string, self.count[node], self.least[node]
                continue
            for depth in range(self.extent[above] + 1, self.extent[node] + 1):
                yield ids[depth - start], ids[depth - start - 1], depth, string, self.count[node], self.least[node]
            self.least[above] = min(self.least[above], self.least[node]) if self.count[above] else self.least[node]
            self.count[above] += self.count[node]


# Conversations as stretches of hashes.


def _stretches(conversations: DataFrame) -> DataFrame:
    """``conv_id, stretch, first, turns``: rebuilt conversations, ``first`` the depth before the first turn."""
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), whole("role").alias("role"), whole("text").alias("text")
    )
    hashed = turns.select(
        "conv_id", "turn", "role", F.md5("text").alias("mark"), F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("b"), "text", "role", F.length("role")).alias("b"), F.length("text").cast("long").alias("chars"),
    )
    placed = position_within(hashed, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "mark"], "pos")
    turn = F.struct("pos", "a", "b", "chars")
    # A stretch has a bounded number of turns, so none of these lists grows with the table.
    own = placed.groupBy("conv_id", F.floor((F.col("pos") - 1) / STRETCH).alias("stretch")).agg(
        F.sort_array(F.collect_list(turn)).alias("own")
    )
    own = materialize(own)
    heads = own.filter((F.col("stretch") == 0) & (F.col("conv_id") % HUNDRED == 0)).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head")
    )
    of_head = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    keyed = own.withColumn("h", of_head).withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    joined = keyed.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,chars:bigint>>")), F.lit(1), F.col("h"))
    joined = joined.withColumn("head", head)
    rest = F.slice("own", F.col("h") + 1, F.size("own"))
    begin = F.col("stretch") == 0
    return joined.select(
        "conv_id", "stretch",
        F.when(begin, F.lit(0)).otherwise(F.col("stretch") * STRETCH + F.size("head") - F.col("h")).cast("long").alias("first"),
        F.when(begin, F.concat("head", rest)).otherwise(F.col("own")).alias("turns"),
    )


_PATHS = "conv_id bigint, stretch bigint, first bigint, place binary, a binary, b binary, chars binary, sum_a bigint, sum_b bigint"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of salted turn hashes from each stretch's start on."""
    for batch in batches:
        turns = batch.column(3)
        offsets = turns.offsets.to_numpy()
        flat = turns.values
        a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (1, 2))
        chars = flat.field(3).to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[list] = [[] for _ in range(6)]
        for first, begin, end in zip(batch.column(2).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            depth = mix(np.arange(first + 1, first + 1 + end - begin, dtype=np.uint64))
            x = np.cumsum(mix(a[begin:end] ^ (depth * _SALTS[0])), dtype=np.uint64)
            y = np.cumsum(mix(b[begin:end] ^ (depth * _SALTS[1])), dtype=np.uint64)
            out[0].append(first.to_bytes(8, "big") + x[:LEADING].astype(">u8").tobytes())
            out[1].append(x.tobytes())
            out[2].append(y.tobytes())
            out[3].append(chars[begin:end].tobytes())
            out[4].append(int(x[-1].astype(np.int64)) if len(x) else 0)
            out[5].append(int(y[-1].astype(np.int64)) if len(y) else 0)
        kinds = [pa.binary()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in range(3)), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))],
            [c.split()[0] for c in _PATHS.split(", ")],
        )


def _shifted(paths: DataFrame) -> DataFrame:
    """The stretches with ``base_a, base_b``, the hash at their start: sums over the earlier stretches, modulo 2 ** 64."""
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    # As many rows as stretches: a conversation of a billion turns has a quarter of a million.
    total = lambda c: F.pmod(F.sum(F.col(c).cast("decimal(20,0)")).over(earlier).cast("decimal(38,0)"), two64).cast("string")
    sums = paths.select("conv_id", "stretch", total("sum_a").alias("base_a"), total("sum_b").alias("base_b")).filter("stretch > 0")
    zero = lambda c: F.coalesce(c, F.lit("0")).alias(c)
    return paths.join(sums, ["conv_id", "stretch"], "left").select(
        "conv_id", "stretch", "first", "place", "a", "b", "chars", zero("base_a"), zero("base_b")
    )


def _prefixes(a: bytes, b: bytes, base_a: str, base_b: str) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the prefix hashes, the one at the start included."""
    x = np.concatenate((np.zeros(1, np.uint64), np.frombuffer(a, np.uint64))) + np.uint64(int(base_a))
    y = np.concatenate((np.zeros(1, np.uint64), np.frombuffer(b, np.uint64))) + np.uint64(int(base_b))
    return x, y


_NODES = "a bigint, b bigint, up_a bigint, up_b bigint, depth bigint, chars bigint, n_convs bigint, conv_id bigint"


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All distinct prefixes of a task's stretches, with their members."""
    low = (1 << 64) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def written(tries: dict[int, tuple[ZFastTrie, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _NODES.split(", ")])

        for start, (trie, texts) in tries.items():
            for prefix, up, depth, string, members, least in trie.expand():
                chars = int(texts[string][depth - start - 1]) if depth else 0
                rows.append((signed(prefix >> 64), signed(prefix & low), signed(up >> 64), signed(up & low), depth, chars, members, least))
                if len(rows) == 50_000:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    tries: dict[int, tuple[ZFastTrie, list[np.ndarray]]] = {}
    held = 0
    for batch in batches:
        conv, first, a, b, chars, base_a, base_b = (batch.column(k).to_pylist() for k in (0, 2, 4, 5, 6, 7, 8))
        # Equal strings of a batch go in together.
        same: dict[tuple[int, int, int], list[int]] = {}
        strings = []
        for k in range(len(conv)):
            x, y = _prefixes(a[k], b[k], base_a[k], base_b[k])
            strings.append([(p << 64) | q for p, q in zip(x.tolist(), y.tolist(), strict=True)])
            same.setdefault((first[k], strings[k][0], strings[k][-1]), []).append(k)
        for (start, _, _), members in same.items():
            k = members[0]
            trie, texts = tries.setdefault(start, (ZFastTrie(start), []))
            if trie.insert(strings[k], len(members), min(conv[m] for m in members)):
                texts.append(np.frombuffer(chars[k], np.int64))
                held += len(strings[k])
        if held > HELD:
            yield from written(tries)
            tries, held = {}, 0
    yield from written(tries)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, from rows sorted by node and id, one at a time."""
    key, state, n = None, hashlib.sha256(), 0
    for batch in batches:
        out = []
        for a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (a, b) != key:
                if n:
                    out.append((*key, n, state.hexdigest()))
                key, state, n = (a, b), hashlib.sha256(), 0
            state.update(b"," * (n > 0) + str(conv).encode())
            n += 1
        yield _end_rows(out)
    if n:
        yield _end_rows([(*key, n, state.hexdigest())])


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["a", "b", "n_ends", "ends_sha256"])


def _subtree_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch, per depth of its path, the sums of its conversation's own nodes from there down.

    Own nodes are those whose smallest member the conversation is; ``later_*`` are the sums over
    the conversation's later stretches.
    """
    for batch in batches:
        first, a, b, base_a, base_b, depths, leaves, saved, later_leaves, later_saved = (
            batch.column(k).to_pylist() for k in range(10)
        )
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for k in range(batch.num_rows):
            x, y = _prefixes(a[k], b[k], base_a[k], base_b[k])
            values = np.zeros((2, len(x)), np.int64)
            if depths[k]:
                at = np.array(depths[k], np.int64) - first[k]
                values[0, at], values[1, at] = leaves[k], saved[k]
            values[:, -1] += (later_leaves[k], later_saved[k])
            sums = np.cumsum(values[:, ::-1], axis=1)[:, ::-1]
            # The depth at a later stretch's start is its predecessor's last.
            keep = slice(0 if first[k] == 0 else 1, None)
            any_ = sums[:, keep].any(axis=0)
            for part, v in zip(parts, (x.view(np.int64), y.view(np.int64), sums[0], sums[1]), strict=True):
                part.append(v[keep][any_])
        none = [np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p or none)) for p in parts], ["a", "b", "n_leaves", "saved_tokens"])


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations."""
    paths = materialize(_shifted(materialize(_stretches(conversations).mapInArrow(_paths, _PATHS))))
    placed = paths.repartitionByRange("place", "conv_id", "stretch").sortWithinPartitions("place")
    parts = placed.mapInArrow(_tries, _NODES)
    same = [F.min(c).alias(c) for c in ("up_a", "up_b", "depth", "chars")]
    nodes = materialize(parts.groupBy("a", "b").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    # A conversation ends where its last stretch does.
    path = paths.select("conv_id", "stretch", F.col("a").alias("x"), F.col("b").alias("y"), "base_a", "base_b")
    end = materialize(path.mapInArrow(_last_prefix, "conv_id bigint, stretch bigint, a bigint, b bigint"))
    end = end.groupBy("conv_id").agg(F.max(F.struct("stretch", "a", "b")).alias("at")).select("at.a", "at.b", "conv_id")
    # A SHA-256 is sequential, so one node's ids pass through one task, as a stream.
    sorted_ends = end.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    ends = sorted_ends.mapInArrow(_ends, "a bigint, b bigint, n_ends bigint, ends_sha256 string")
    children = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    none = F.lit(0).cast("long")
    full = materialize(
        nodes.join(children, ["a", "b"], "left").join(ends, ["a", "b"], "left").select(
            "a", "b", "up_a", "up_b", "conv_id", "depth", "chars", "n_convs", F.coalesce("n_children", none).alias("n_children"),
            F.coalesce("n_ends", none).alias("n_ends"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    shares = _shares(paths, full)
    up = full.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.lit(True).alias("is_up"))
    over_root = (F.col("depth") == 0).alias("is_root")
    joined = full.select("*", over_root).join(shares, ["a", "b"]).join(up, ["up_a", "up_b"], "left")
    return joined.select(
        "conv_id", "depth", F.when(~F.col("is_root"), F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), "ends_sha256", "n_ends",
    )


def _last_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, base_a, base_b = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        last = [_prefixes(*row) for row in zip(x, y, base_a, base_b, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array([int(p[k][-1].astype(np.int64)) for p in last], pa.int64()) for k in (0, 1))],
            ["conv_id", "stretch", "a", "b"],
        )


def _shares(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, n_leaves, saved_tokens`` of every node's subtree."""
    leaf = (F.col("n_children") == 0).cast("long").alias("leaf")
    own = nodes.select("conv_id", "depth", leaf, ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    # Depths run one behind the first turn of a stretch: its last depth is the next one's start.
    spans = paths.select("conv_id", "stretch", "first", (F.col("first") + F.length("a") / 8).cast("long").alias("last"))
    guess = F.greatest(F.floor((F.col("depth") - 1) / STRETCH), F.lit(0))
    # A head may shift the stretches by up to HEADS turns, so a depth lies in its own or the next stretch.
    near = own.withColumn("stretch", F.explode(F.array_distinct(F.array(guess, F.greatest(F.floor((F.col("depth") + HEADS - 1) / STRETCH), F.lit(0))))))
    inside = (F.col("depth") <= F.col("last")) & ((F.col("depth") > F.col("first")) | (F.col("depth") == 0))
    dealt = near.join(spans, ["conv_id", "stretch"]).filter(inside)
    lists = dealt.groupBy("conv_id", "stretch").agg(F.collect_list(F.struct("depth", "leaf", "saved")).alias("own"))
    totals = lists.select(
        "conv_id", "stretch", "own", F.aggregate("own", F.lit(0).cast("long"), lambda t, v: t + v["leaf"]).alias("l"),
        F.aggregate("own", F.lit(0).cast("long"), lambda t, v: t + v["saved"]).alias("s"),
    )
    none = F.lit(0).cast("long")
    every = paths.join(totals, ["conv_id", "stretch"], "left")
    after = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(1, Window.unboundedFollowing)
    later = (
        every.select("conv_id", "stretch", F.coalesce("l", none).alias("l"), F.coalesce("s", none).alias("s"))
        .select("conv_id", "stretch", F.sum("l").over(after).alias("later_l"), F.sum("s").over(after).alias("later_s"))
        .filter("later_l <> 0 or later_s <> 0")
    )
    rows = every.join(later, ["conv_id", "stretch"], "left").select(
        "first", "a", "b", "base_a", "base_b", F.col("own.depth").alias("depths"), F.col("own.leaf").alias("leaves"),
        F.col("own.saved").alias("saved"), F.coalesce("later_l", none), F.coalesce("later_s", none),
    )
    shares = rows.mapInArrow(_subtree_shares, "a bigint, b bigint, n_leaves bigint, saved_tokens bigint")
    return shares.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def digest(conversations: DataFrame) -> DataFrame:
    """The registered query: the nodes, without the count of conversations that end there."""
    return prefix_nodes(conversations).drop("n_ends")


_STEP = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(str_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: " + _STEP.format("xor(c, d)") + "), 4294967295)"

SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {HUNDRED} AS base, ({_CRC} % {HEADS})::INTEGER AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt),
paths AS (
  SELECT conv_id, depth, length(text) AS chars,
         md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS p FROM ordered
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ends AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p.depth, p.p, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(p.chars) AS chars,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE e.depth = p.depth), '')) AS ends_sha256
  FROM paths p JOIN ends e ON e.conv_id = p.conv_id GROUP BY p.depth, p.p),
linked AS (SELECT n.*, u.p AS up FROM nodes n LEFT JOIN paths u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
children AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY up, depth),
counted AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c ON c.up = l.p AND c.depth = l.depth),
subtrees AS (
  SELECT a.p, a.depth, sum((n.n_children = 0)::INTEGER) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM counted n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.p, a.depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON s.p = n.p AND s.depth = n.depth
LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.up AND u.depth = n.depth - 1
"""
