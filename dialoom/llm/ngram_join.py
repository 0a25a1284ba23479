"""Similarity self-join of word n-gram sets by prefixes of tokens and token combinations.

The tokens of a text are its distinct ``N``-word shingles. Two sets with a Jaccard similarity of at
least the threshold differ in few tokens: of a set of n, at most ``slack(n)`` are missing in the
other one.

1. Frequent tokens: every task keeps a summary of ``COUNTERS`` counters over all tokens of its texts
   (what is taken from one counter is taken from ``COUNTERS`` others), and the summaries are added
   up. Tokens with more than a ``COUNTERS``-th of all occurrences are classes 2 and 3, so at most
   ``COUNTERS`` of them are broadcast; all others are rare, class 1.
2. Tokens are ordered by class and hash. A prefix runs from the front until it makes
   ``slack(n) + 1`` steps. A rare token is a step and is indexed alone. Class k tokens fall into
   groups by their hash, a group's first k - 1 tokens are no step, so the prefix extends; its
   k-token combinations within groups are indexed. Two similar sets share an indexed key: in the
   shorter one's prefix, tokens of no common key are at most the k - 1 of each group, so more than
   ``slack`` tokens would be missing.
3. A key holds a band of sizes as well; a set whose partner may lie in the next band is indexed in
   both. Keys of one set only are dropped, the others are buckets.
4. A rare token is indexed with its place in the set, a combination with the number of rare tokens.
   If a rare token is the first that two sets have in common, none of the tokens before it is; if
   none is rare, no rare token is. So two sizes and places tell whether sets that meet there can be
   similar, and a set without a possible partner leaves the bucket.
5. Buckets are compared on full sets, first for groups of copies, then across what these have
   joined (``linking``). Components of the links name every document's group.

Defined results: a NULL text, or one without words, has no tokens and links with nothing; a text
of fewer than ``N`` words is one token. Equal sets are linked. Rows with equal ids are one document;
a row with a NULL id is linked with nothing and its component is NULL. An empty table gives an
empty result. Only the id and text columns are read, so other columns cannot clash. Links are
returned as classes, not counted: counting would compare all pairs of a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.linking import grouped, links_in_buckets, read_sets, sketch
from dialoom.llm.shingles import Hasher, mix, set_key
from dialoom.session import materialize

N = 3
PER_CENT = 90
LEAST_PER_CENT = 80  # below it, small sets could be similar without a common key
COUNTERS = 1 << 16
#: A token with so many times the share of a frequent one is in class 3.
VERY = 16
#: Ratio of a band's largest size to its least; at least 100 / ``LEAST_PER_CENT``.
BAND = 1.25
FOLD = 1 << 20  # tokens that a summary takes in at a time
#: Sets of a bucket whose places are compared. Larger buckets stay whole.
PLACED = 1000
_ADD = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << 64) - 1


def slack(size: int, per_cent: int) -> int:
    """How many tokens of a set may be missing in a similar one."""
    return size * (100 - per_cent) // 100


class Frequent:
    """Counts of the most frequent tokens; each count is too low by a ``size``-th of all tokens at most."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.tokens, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.n += len(tokens)
        if self.n >= FOLD:
            self.fold()

    def fold(self) -> None:
        found, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.n = [], 0
        both, place = np.unique(np.concatenate((self.tokens, found)), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        total[place[: len(self.tokens)]] += self.counts
        total[place[len(self.tokens) :]] += counts
        if len(both) > self.size:
            total -= np.partition(total, len(both) - self.size - 1)[len(both) - self.size - 1]
        keep = total > 0
        self.tokens, self.counts = both[keep], total[keep]


_READ = "doc_id bigint, n_shingles bigint, node binary, key bigint, sketch binary, token bigint, n bigint"


def _key(node: bytes) -> int:
    """The front of a set's key, which stands for it where rows are many."""
    return int.from_bytes(node[:8], "big", signed=True)


def _read(n: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every text, then a task's frequent tokens."""
        hasher, frequent = Hasher(), Frequent(counters)
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for k in range(batch.num_rows):
                tokens = hasher.shingles(batch.column(1)[k].as_py(), n)
                frequent.add(tokens)
                sizes.append(len(tokens))
                nodes.append(set_key(tokens))
                sketches.append(sketch(tokens) if len(tokens) else None)
            none = pa.nulls(batch.num_rows, pa.int64())
            keys = pa.array([None if node is None else _key(node) for node in nodes], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), keys, pa.array(sketches, pa.binary()), none, none],
                [c.split()[0] for c in _READ.split(", ")],
            )
        frequent.fold()
        size = len(frequent.tokens)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(size, kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())),
                pa.array(frequent.tokens.view(np.int64)), pa.array(frequent.counts),
            ],
            [c.split()[0] for c in _READ.split(", ")],
        )

    return run


class Indexer:
    """The keys of a set. ``tokens`` (sorted) are the frequent ones, ``classes`` their classes."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray, per_cent: int) -> None:
        self.tokens, self.classes, self.per_cent = tokens, classes, per_cent

    def bands(self, size: int) -> list[int]:
        band = lambda n: int(math.log(n) / math.log(BAND) + 1e-9)
        return sorted({band(size), band(size * 100 // self.per_cent)})

    def groups(self, band: int, k: int) -> int:
        """Groups of a class: as many as fill with some 2 * k tokens of a prefix."""
        return max(1, (slack(int(BAND**band), self.per_cent) + 1) // (k + 1))

    def keys(self, found: np.ndarray) -> np.ndarray:
        """``found`` are the sorted tokens of a set."""
        return self.placed(found)[0]

    def placed(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys, and how many tokens of the set stand before a key's; all rare ones do before a combination."""
        if not len(found):
            return found, np.empty(0, np.int64)
        steps = slack(len(found), self.per_cent) + 1
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
            kind = np.where(self.tokens[at] == found, self.classes[at], 1)
        else:
            kind = np.ones(len(found), np.int8)
        rare = found[kind == 1][:steps]
        out, places = [], []
        for band in self.bands(len(found)):
            salt = mix(np.array([band], np.uint64) * _ADD + np.uint64(1))
            out.append(mix(rare ^ salt))
            places.append(np.arange(len(rare)))
            if len(rare) < steps:
                out.append(self._combined(found, kind, steps - len(rare), band))
                places.append(np.full(len(out[-1]), len(rare)))
        keys, place = np.concatenate(out), np.concatenate(places)
        order = np.lexsort((place, keys))
        keys, place = keys[order], place[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        return keys[first], place[first]

    def _combined(self, found: np.ndarray, kind: np.ndarray, steps: int, band: int) -> np.ndarray:
        keys: list[int] = []
        for k in (2, 3):
            several = self.groups(band, k)
            groups: dict[int, list[int]] = {}
            tokens = found[kind == k]
            place = (mix(tokens + np.uint64(k)) % np.uint64(several)).tolist()
            for token, group in zip(tokens.tolist(), place, strict=True):
                if not steps:
                    break
                members = groups.setdefault(group, [])
                members.append(token)
                steps -= len(members) >= k
            for members in groups.values():
                for chosen in combinations(members, k):
                    key = band * 8 + k
                    for token in chosen:
                        key = ((key ^ token) * 0x9E3779B97F4A7C15 + (key >> 29)) & _WORD
                    keys.append(key)
        return mix(np.array(keys, np.uint64))


_INDEX = "bucket bigint, key bigint, size int, rest int"


def _index(shared, n: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``_INDEX`` of every set; one that a task has met before is not indexed again."""
        hasher, indexer, met = Hasher(), Indexer(*shared.value, per_cent), set()
        for batch in batches:
            buckets, places, keys, sizes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], [], []
            for k in range(batch.num_rows):
                tokens = hasher.shingles(batch.column(0)[k].as_py(), n)
                node = set_key(tokens)
                if node is None or node in met:
                    continue
                met.add(node)
                found, place = indexer.placed(tokens)
                buckets.append(found)
                places.append(place)
                keys.append(_key(node))
                sizes.append(len(tokens))
                counts.append(len(found))
            repeated = lambda of: np.repeat(np.array(of, np.int64), np.array(counts, np.int64))  # noqa: B023, E731
            size = repeated(sizes)
            rest = size - np.concatenate(places)
            columns = np.concatenate(buckets).view(np.int64), repeated(keys), size.astype(np.int32), rest.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _INDEX.split(", ")])

    return run


def paired(bucket: np.ndarray, size: np.ndarray, rest: np.ndarray, per_cent: int) -> np.ndarray:
    """Which rows, sorted by bucket and size, have a possible partner in their bucket.

    Of two sets of one bucket no more than the smaller ``rest`` can be common.
    """
    kept, size, rest = np.zeros(len(bucket), bool), size.astype(np.int64), rest.astype(np.int64)
    waiting, step = [np.arange(len(bucket)), np.arange(len(bucket))], 1
    while any(map(len, waiting)):
        for k, by in enumerate((step, -step)):
            at = waiting[k]
            at = at[~kept[at] & (at + by >= 0) & (at + by < len(bucket))]
            to = at + by
            # Sizes only part further along a bucket.
            near = (bucket[at] == bucket[to]) & (100 * np.minimum(size[at], size[to]) >= per_cent * np.maximum(size[at], size[to]))
            at, to = at[near], to[near]
            both = (100 + per_cent) * np.minimum(rest[at], rest[to]) >= per_cent * (size[at] + size[to])
            kept[at[both]] = kept[to[both]] = True
            waiting[k] = at[~both]
        step += 1
    return kept


def _paired(per_cent: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a possible partner in their bucket, each once, and all rows of buckets of more than ``limit``.
        Rows come sorted by bucket and size; of a larger bucket no more than a batch is held."""
        whole, last = None, None  # the bucket that is passed on as it comes, the row before
        held = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int32)] * 2

        def output(rows: list[np.ndarray], kept: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in rows[:2]], ["bucket", "key"])

        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if not len(rows[0]):
                continue
            # Rows of one set come together.
            again = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            new = np.concatenate(([last != (rows[0][0], rows[1][0])], ~again))
            last = rows[0][-1], rows[1][-1]
            passed = new & (rows[0] == whole) if whole is not None else np.zeros(len(new), bool)
            if passed.any():
                yield output(rows, passed)
            held = [np.concatenate((a, b[new & ~passed])) for a, b in zip(held, rows, strict=True)]
            if not len(held[0]):
                continue
            begin = int(np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))[-1])
            done, held = [c[:begin] for c in held], [c[begin:] for c in held]
            yield output(done, _partners(done, per_cent, limit))
            if len(held[0]) > limit:
                whole = held[0][0]
                yield output(held, np.ones(len(held[0]), bool))
                held = [c[:0] for c in held]
        yield output(held, _partners(held, per_cent, limit))

    return run


def _partners(rows: list[np.ndarray], per_cent: int, limit: int) -> np.ndarray:
    """``paired`` of ``bucket, key, size, rest``; larger buckets than ``limit`` stay."""
    _, at, n = np.unique(rows[0], return_inverse=True, return_counts=True)
    kept = n[at] > limit
    small = np.flatnonzero(~kept & (n[at] > 1))
    kept[small] = paired(*(rows[k][small] for k in (0, 2, 3)), per_cent)
    return kept


def frequent_tokens(read: DataFrame, counters: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with more than a ``counters``-th of all occurrences, sorted, and their classes."""
    total = read.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    counts = read.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") * counters > total).collect()  # fewer than counters, as their sum is at most total
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    classes = np.array([3 if r["n"] * counters > VERY * total else 2 for r in rows], np.int8)
    order = np.argsort(tokens)
    return tokens[order], classes[order]


def joined(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_cent: int = PER_CENT, n: int = N) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row, linked at a similarity of ``per_cent`` or more."""
    if not LEAST_PER_CENT <= per_cent <= 100:
        raise ValueError(f"per_cent must lie between {LEAST_PER_CENT} and 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    read = materialize(texts.mapInArrow(_read(n, COUNTERS), _READ))
    shared = spark.sparkContext.broadcast(frequent_tokens(read))
    signed = read.filter("token is null").select("doc_id", "n_shingles", "node", "key", "sketch")
    first = [F.first(c).alias(c) for c in ("n_shingles", "key", "sketch")]
    named = signed.filter("doc_id is not null and node is not null")
    classes = materialize(named.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), *first))
    keys = texts.filter("doc_id is not null").select("text").mapInArrow(_index(shared, n, per_cent), _INDEX)
    # A set that several tasks have met comes several times here, one behind the other.
    placed = keys.repartition("bucket").sortWithinPartitions("bucket", "size", "key")
    met = materialize(placed.mapInArrow(_paired(per_cent, PLACED), "bucket bigint, key bigint"))
    several = met.groupBy("bucket").agg(F.count("*").alias("n"))
    members = materialize(met.join(several.hint("merge"), "bucket"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        # Written, so that its size is known before the texts are moved for the join.
        readers = materialize(classes.join(nodes, "node", "left_semi").select(F.col("first_id").alias("doc_id")).distinct())
        # An id that stands on several rows gives the sets of all; only the wanted ones stay.
        found = read_sets(texts.join(readers, "doc_id", "left_semi"), n)
        return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    return grouped(signed, classes, links_in_buckets(members, classes, sets_of, per_cent))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return joined(docs)
