"""The prefix trie, the similarity join of word trigrams and whitened embeddings."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialoom.llm import linking, ngram_join, prefix_trie, whitening
from dialoom.llm.shingles import Hasher


class TestWhitening:
    SCHEMA = "vec_id int, embedding array<double>"

    def test_eigenvectors_of_symmetric_matrices(self):
        draw = np.random.default_rng(0)
        for n in (1, 2, 3, 5, 64, 150):
            a = draw.standard_normal((n, n + 3))
            m = a @ a.T
            values, vectors = whitening.principal(m, 4)
            assert values == pytest.approx(np.linalg.eigvalsh(m)[::-1][:4], rel=1e-12)
            assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
            assert np.abs(m @ vectors - vectors * values).max() < 1e-10 * values[0]
        # Clusters, equal eigenvalues, rank one, nothing.
        close = np.diag([5.0, 5 + 1e-13, 5 - 1e-12, 1, 1, 0])
        turn = np.linalg.qr(draw.standard_normal((6, 6)))[0]
        for m, count in ((close, 4), (turn @ close @ turn.T, 4), (np.eye(6) * 3, 4), (np.ones((5, 5)), 1), (np.zeros((3, 3)), 0)):
            values, vectors = whitening.principal((m + m.T) / 2, 4)
            assert len(values) == count
            assert np.abs(vectors.T @ vectors - np.eye(count)).max(initial=0) < 1e-10
            assert np.abs(m @ vectors - vectors * values).max(initial=0) < 1e-10

    def test_sturm_counts(self):
        draw = np.random.default_rng(1)
        d, e = draw.standard_normal(30), draw.standard_normal(29)
        e[7] = 0.0
        exact = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
        at = np.linspace(-4, 4, 50)
        assert (whitening.sturm_count(d, e, at) == [(exact < x).sum() for x in at]).all()

    def test_whole_table_against_numpy(self, spark, sf):
        table = spark.read.parquet(f"{sf}/embeddings.parquet")
        table = table.unionByName(table.limit(7)).withColumn("n", F.lit("own"))
        got = whitening.digest(table).toPandas()
        rows = table.toPandas()
        x = np.floor(np.array(rows.embedding.tolist(), float) * 256).astype(int)
        fit = np.unique(x, axis=0)
        n, s = len(fit), fit.sum(axis=0)
        values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
        values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
        want = (x - s / n) @ vectors / np.sqrt(values)
        assert len(got) == 4 * len(rows) and (got.n == n).all()
        by = {i: w for i, w in zip(rows.vec_id, want, strict=True)}
        spread = dict(zip(rows.vec_id, ((n * x - s) ** 2).sum(axis=1), strict=True))
        signs = np.zeros(4)
        for r in got.itertuples():
            w = by[r.vec_id][r.component - 1]
            assert abs(abs(w) - abs(r.whitened)) < 1e-9 and r.deviation == spread[r.vec_id]
            if abs(w) > 1e-6:
                sign = np.sign(w * r.whitened)
                assert signs[r.component - 1] in (0, sign)
                signs[r.component - 1] = sign
        trace = np.trace(np.cov(fit.T, bias=True))
        assert got.groupby("component").explained.first().tolist() == pytest.approx((values / trace).tolist())
        assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9

    def test_odd_vectors(self, spark):
        nan, inf = float("nan"), float("inf")
        rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [-inf, 0.0]), (6, []), (None, [0.5, 0.25, 0.125]),
                (7, [0.5, 0.25, 0.125]), (8, [-0.0, 0.0]), (9, [1e300, -1e300]), (9, [0.3, 0.2])]
        got = whitening.digest(spark.createDataFrame(rows, self.SCHEMA)).collect()
        assert {r.vec_id for r in got} == {6, None, 7, 8, 9}
        assert {r.n for r in got} == {4}  # 6 and 8 are one vector once their ends are filled
        assert all(r.deviation is None for r in got)  # beyond a long
        small = spark.createDataFrame([r for r in rows if r[1] is None or len(r[1]) != 2 or r[1][0] != 1e300], self.SCHEMA)
        got = whitening.digest(small).collect()
        assert {r.n for r in got} == {3} and max(r.component for r in got) == 2
        for gone in (small.limit(0), small.filter("vec_id = 7"), small.filter("vec_id < 6")):
            assert whitening.digest(gone).collect() == []

    def test_exact_sums_beyond_doubles(self):
        moments = whitening.Moments(3, [1 << 62, -5])
        x = np.array([[(1 << 61) + 3, 7], [0, 0]])
        assert moments.deviations(x) == [None, None]
        near = whitening.Moments(1 << 40, [1 << 41, 0])
        x = np.array([[2, 1], [1, 0], [2, 0]])
        assert near.deviations(x) == [None, None, 0]
        assert np.abs(whitening.Moments(2, [(1 << 53) + 1, 1]).centred(np.array([[1 << 52, 0]])) - [[-0.5, -0.5]]).max() == 0


class TestTrie:
    SCHEMA = "conv_id long, turn long, role string, text string"

    def rows(self):
        draw = random.Random(1)
        rows = []
        for c in [*range(12), 100, 101, 203, 205, -3, 300, *range(301, 340)]:
            for t in range(draw.randint(1, 40) if c % 100 else draw.choice([1, 3, 40])):
                if c < 12:
                    turn = None if draw.random() < 0.1 else draw.randint(0, 5)
                    rows.append((c, turn, draw.choice([None, "u", "a"]), draw.choice([None, "", "x", "yy"])))
                else:
                    rows.append((c, t, "u", "same" if c % 3 else str(c // 5)))
        return [*rows, (None, 1, "a", "b"), (400, 1, "u", "x"), (401, 1, "u", "long " * 50_000)]

    def compare(self, spark, rows):
        got = prefix_trie.digest(spark.createDataFrame(rows, self.SCHEMA).withColumn("depth", F.lit("own"))).toPandas()
        frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})
        connection = duckdb.connect()
        connection.register("conversations", frame)
        want = connection.execute(prefix_trie.SQL).df()
        plain = lambda d: sorted(tuple(None if pd.isna(v) else v for v in row) for row in d[sorted(want.columns)].astype(object).values.tolist())
        key = lambda row: tuple((v is None, str(v)) for v in row)
        assert sorted(map(key, plain(got))) == sorted(map(key, plain(want)))
        assert set(got.columns) == set(want.columns)

    def test_against_sql(self, spark):
        self.compare(spark, self.rows())

    def test_long_conversations_are_cut_and_tries_begun_anew(self, spark, monkeypatch):
        monkeypatch.setattr(prefix_trie, "STRETCH", 7)
        monkeypatch.setattr(prefix_trie, "HELD", 40)
        self.compare(spark, self.rows())

    def test_empty_table(self, spark):
        assert prefix_trie.digest(spark.createDataFrame([], self.SCHEMA)).collect() == []

    def test_two_fattest(self):
        for low in range(40):
            for high in range(low + 1, 60):
                best = max(range(low + 1, high + 1), key=lambda f: f & -f)
                assert prefix_trie.two_fattest(low, high) == best

    def test_exit_nodes_and_members_against_plain_prefixes(self):
        draw = random.Random(5)
        for start in (0, 9):
            trie, members = prefix_trie.ZFastTrie(start), defaultdict(list)
            for n in range(400):
                ids = [start]
                for _ in range(draw.randint(0, 30)):
                    ids.append(hash((ids[-1], draw.choice([0, 0, 0, 0, 0, 1]))))
                weight = draw.randint(1, 3)
                # The exit node is the deepest compacted node on the string's path.
                if n:
                    at = {trie.at(node, trie.extent[node]): trie.extent[node] for node in range(len(trie.extent))}
                    deepest = max(at[i] for i in ids if i in at)
                    node = trie.exit_node(trie.roots[start], ids)
                    assert ids[trie.extent[node] - start] == trie.at(node, trie.extent[node])
                    child = trie.children.get(ids[trie.extent[node] + 1 - start]) if trie.extent[node] - start < len(ids) - 1 else None
                    assert trie.extent[node] == deepest or trie.extent[child] <= deepest
                trie.insert(ids, weight, n)
                for prefix in ids:
                    members[prefix] += [n] * weight
            got = {prefix: (count, least) for prefix, _, _, _, count, least in trie.expand()}
            want = {prefix: (len(ns), min(ns)) for prefix, ns in members.items() if start == 0 or prefix != start}
            assert got == want


class TestNgramJoin:
    SCHEMA = "doc_id long, text string"

    def plain(self, rows, per_cent, n):
        hasher, parent = Hasher(), {i: i for i, _ in rows if i is not None}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        sets = [(i, frozenset(hasher.shingles(t, n).tolist())) for i, t in rows]
        named = [(i, s) for i, s in sets if i is not None]
        owners, common = defaultdict(list), Counter()
        for k, (_, s) in enumerate(named):
            for token in s:
                owners[token].append(k)
        for ks in owners.values():
            common.update((a, b) for j, b in enumerate(ks) for a in ks[:j])
        for (a, b), c in common.items():
            if 100 * c >= per_cent * (len(named[a][1]) + len(named[b][1]) - c):
                x, y = find(named[a][0]), find(named[b][0])
                parent[max(x, y)] = min(x, y)
        return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)

    def rows(self):
        draw = random.Random(3)
        text = lambda k: [f"w{draw.randrange(300)}" for _ in range(k)]
        rows, common = [], text(60)
        for _ in range(30):
            base = text(draw.choice([1, 2, 3, 5, 11, 30, 80, 200]))
            for _ in range(draw.randint(1, 12)):
                words = list(base)
                for _ in range(draw.randint(0, max(1, len(words) // 30))):
                    words[draw.randrange(len(words))] = f"x{draw.randrange(50)}"
                rows.append((len(rows), " ".join(words + ["tail"] * (draw.random() < 0.2))))
        for _ in range(120):
            words = list(common)
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(60)] = f"y{draw.randrange(9)}"
            rows.append((len(rows), " ".join(words).upper()))
        extra = [(None, "a b c d"), (None, " ".join(common)), (7, "zz yy xx"), (7, " ".join(common)), (9001, None), (9002, ""), (9003, " \t"), (9004, "a"),
                 (9005, "A"), (9006, "a b"), (9007, "b a"), (9008, "v w x y z " * 8000), (9009, "V w x y z " * 8000 + "q")]
        return rows + extra

    def compare(self, spark, rows, per_cent=90, n=3):
        docs = spark.createDataFrame(rows, self.SCHEMA).withColumn("node", F.lit("own"))
        got = ngram_join.joined(docs, per_cent=per_cent, n=n).collect()
        assert Counter(tuple(r) for r in got) == self.plain(rows, per_cent, n)

    def test_against_plain_sets(self, spark):
        self.compare(spark, self.rows())

    @pytest.mark.parametrize("per_cent", [80, 90, 100])
    def test_token_combinations_and_blocks(self, spark, monkeypatch, per_cent):
        monkeypatch.setattr(ngram_join, "COUNTERS", 64)
        monkeypatch.setattr(ngram_join, "VERY", 3)
        monkeypatch.setattr(linking, "UNIT", 4000)
        monkeypatch.setattr(linking, "THINNED", 20)
        self.compare(spark, self.rows(), per_cent)

    def test_similar_sets_share_a_key(self):
        draw = np.random.default_rng(4)
        tokens = np.unique(draw.integers(0, 1 << 63, 4000)).astype(np.uint64)
        classes = np.where(draw.random(len(tokens)) < 0.5, 2, 3).astype(np.int8)
        for per_cent in (80, 90):
            for share in (1.0, 0.7, 0.1):  # of the tokens that are frequent
                known = draw.random(len(tokens)) < share
                indexer = ngram_join.Indexer(tokens[known], classes[known], per_cent)
                for size in [*range(4, 40), 100, 700]:
                    a = draw.choice(tokens, size, replace=False)
                    # As unlike as the threshold lets a pair be.
                    least = -(-per_cent * size // 100)
                    shared = draw.choice(a, least, replace=False)
                    union = 100 * least // per_cent
                    b = np.concatenate([shared, draw.choice(np.setdiff1d(tokens, a), union - size, replace=False)])
                    assert np.isin(indexer.keys(np.sort(a)), indexer.keys(np.sort(b))).any(), (per_cent, share, size)

    def test_similar_sets_stay_in_a_bucket(self):
        draw = np.random.default_rng(8)
        tokens = np.unique(draw.integers(0, 1 << 63, 4000)).astype(np.uint64)
        known = draw.random(len(tokens)) < 0.3
        for per_cent in (80, 90):
            indexer = ngram_join.Indexer(tokens[known], np.full(known.sum(), 2, np.int8), per_cent)
            for size in [*range(4, 40), 100, 700]:
                a = draw.choice(tokens, size, replace=False)
                least = -(-per_cent * size // 100)
                union = 100 * least // per_cent
                b = np.concatenate([draw.choice(a, least, replace=False), draw.choice(np.setdiff1d(tokens, a), union - size, replace=False)])
                rows = [(key, len(x), len(x) - place) for x in (a, b) for key, place in zip(*indexer.placed(np.sort(x)), strict=True)]
                bucket, sizes, rest = map(np.array, zip(*sorted(rows), strict=True))
                assert ngram_join.paired(bucket, sizes, rest, per_cent).any(), (per_cent, size)

    def test_partners_of_a_bucket(self):
        draw = np.random.default_rng(9)
        rows = {}
        for key in range(600):
            size = int(draw.integers(1, 60))
            rows.update({(int(bucket), key): (size, size - int(draw.integers(0, 1 + size // 5))) for bucket in draw.integers(0, 90, 4) // 3 * draw.integers(0, 2, 4)})
        table = sorted((bucket, size, key, rest) for (bucket, key), (size, rest) in rows.items())
        owners = defaultdict(list)
        for bucket, size, key, rest in table:
            owners[bucket].append((key, size, rest))
        for limit in (1000, 15):
            fits = lambda a, b: 190 * min(a[2], b[2]) >= 90 * (a[1] + b[1])
            want = sorted((bucket, a[0]) for bucket, of in owners.items() for a in of if len(of) > limit or any(a != b and fits(a, b) for b in of))
            twice = [row for row in table for _ in range(1 + (row[2] % 3 == 0))]
            columns = [np.array(c) for c in zip(*[(b, k, s, r) for b, s, k, r in twice], strict=True)]
            for step in (1, 7, 5000):
                batches = (pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], ["bucket", "key", "size", "rest"]) for i in range(0, len(twice), step))
                got = [row for batch in ngram_join._paired(90, limit)(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                assert sorted(got) == want

    def test_unlike_texts_with_a_common_token_make_few_buckets(self, spark, monkeypatch):
        """Two texts that share a run of words, but can't be similar, are not looked at again."""
        monkeypatch.setattr(ngram_join, "COUNTERS", 64)
        rows = [(2 * k + i, " ".join([f"v{k}x{i}x{j}" for j in range(90 + i * 9 * (k % 2))] + [f"s{k}x{j}" for j in range(5)])) for k in range(100) for i in range(2)]
        met, found = [], ngram_join.links_in_buckets
        monkeypatch.setattr(ngram_join, "links_in_buckets", lambda members, *rest: (met.append(members.count()), found(members, *rest))[1])
        self.compare(spark, rows)
        assert met[0] < 30  # 68 rows share a key

    def test_frequent_tokens_are_found_in_bounded_memory(self):
        draw = np.random.default_rng(6)
        frequent = ngram_join.Frequent(50)
        heavy = draw.integers(0, 1 << 63, 20).astype(np.uint64)
        for _ in range(100):
            frequent.add(np.concatenate([draw.integers(0, 1 << 63, 500).astype(np.uint64), np.repeat(heavy, 30)]))
            if frequent.n > 3000:
                frequent.fold()
                assert len(frequent.tokens) <= 50
        frequent.fold()
        counts = dict(zip(frequent.tokens.tolist(), frequent.counts.tolist(), strict=True))
        assert all(3000 - 110_000 // 50 <= counts[t] <= 3000 for t in heavy.tolist())

    def test_a_large_group_of_copies_costs_in_proportion(self, spark, monkeypatch):
        """Rows sent to be compared in full, for one group of two sizes."""
        monkeypatch.setattr(linking, "UNIT", 20_000)
        draw = random.Random(9)
        base = [f"w{k}" for k in range(200)]
        sent = []
        units = linking._links
        monkeypatch.setattr(linking, "_links", lambda u, s, p: (sent.append(u.count()), units(u, s, p))[1])
        for size in (400, 1600):
            rows = [(i, " ".join(f"x{i}" if draw.random() < 0.004 else w for w in base)) for i in range(size)]
            sent.clear()
            got = ngram_join.joined(spark.createDataFrame(rows, self.SCHEMA)).collect()
            assert Counter(tuple(r) for r in got) == self.plain(rows, 90, 3)
            assert sum(sent) < 3 * size

    def test_threshold_and_empty_table(self, spark):
        docs = spark.createDataFrame([], self.SCHEMA)
        assert ngram_join.joined(docs).collect() == []
        with pytest.raises(ValueError, match="per_cent"):
            ngram_join.joined(docs, per_cent=50)
