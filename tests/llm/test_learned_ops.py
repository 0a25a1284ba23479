"""HTML extraction, near-duplicates, decontamination, token files and language ID."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialoom.llm import boosting, decontamination, html_main, html_tree, language_id, near_dedup, token_output
from dialoom.llm.components import components
from dialoom.llm.shingles import Hasher, MinHash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]


def shingles_of(text, n=5):
    w = words_of(text)
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 5))) for _ in range(n))


def edited(draw, text, share):
    return " ".join(w if draw.random() > share else prose(draw, 1) for w in text.split())


class TestShingles:
    def test_counts_like_sets_of_words(self):
        hasher = Hasher()
        texts = [None, "", " \t\n", "One", "one  TWO\x0bthree", "a b c d e", "a b c d e f a b c d e f", "Ünï É x y z w é 😀 q", "x " * 70_000]
        for text in texts:
            assert len(hasher.shingles(text)) == len(shingles_of(text)), text
        assert (hasher.shingles("A b\tc  D e f") == hasher.shingles("a B c d\ne F")).all()
        assert not np.isin(hasher.shingles("ab c d e f"), hasher.shingles("a bc d e f")).any()

    def test_signature_estimates_similarity(self):
        draw = np.random.default_rng(1)
        minhash = MinHash(2000)
        a = draw.integers(0, 1 << 63, 1000).astype(np.uint64)
        b = np.concatenate([a[:850], draw.integers(0, 1 << 63, 150).astype(np.uint64)])
        assert (minhash.signature(a) == minhash.signature(b)).mean() == pytest.approx(850 / 1150, abs=0.05)


class TestNearDedup:
    def plain(self, rows, per_cent=85):
        parent = {k: k for k in {r[0] for r in rows} if k is not None}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        sets = [(k, shingles_of(t)) for k, t, *_ in rows if k is not None]
        for i, (a, s) in enumerate(sets):
            for b, t in sets[:i]:
                if s and t and 100 * len(s & t) >= per_cent * len(s | t):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        return {k: find(k) for k in parent}

    def compare(self, spark, rows, per_cent=85):
        got = near_dedup.near_duplicates(frame(spark, rows), per_cent=per_cent).collect()
        assert len(got) == len(rows)
        want = self.plain(rows, per_cent)
        sizes = {}
        for k, t, *_ in rows:
            sizes.setdefault(k, set()).add(len(shingles_of(t)))
        for r in got:
            assert r.n_shingles in sizes[r.doc_id]
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id], r
                assert r.kept == (r.doc_id == r.component_id)

    def test_groups_and_odd_rows(self, spark):
        draw = random.Random(3)
        texts = [None, "", "\n", "one two", "ONE two", "one two three", "a b c d e", "a b c d f"]
        for size in (2, 3, 7, 40):
            base = prose(draw, draw.choice([12, 60, 300]))
            texts += [edited(draw, base, draw.choice([0, 0.005, 0.01, 0.02])) for _ in range(size)]
        passage = prose(draw, 60)
        texts += [f"{prose(draw, 20)} {passage} {prose(draw, 20)}" for _ in range(60)] + [prose(draw, 20_000)] * 3
        draw.shuffle(texts)
        rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
        rows += [(None, texts[20], "en", "s", 0), (5, texts[5], "en", "s", 0), (7, texts[30], None, None, None)]
        self.compare(spark, rows)

    def test_a_heavy_region_is_cut_into_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(near_dedup, "UNIT", 8_000)
        draw = random.Random(5)
        base = prose(draw, 120)
        rows = [(i, edited(draw, base, draw.choice([0.01, 0.02, 0.04])), "en", "s", 0) for i in range(160)]
        self.compare(spark, rows)
        self.compare(spark, rows, 80)

    def test_stage_keeps_one_of_each_group(self, spark):
        rows = [(3, "a b c d e f", "en", "s", 0), (1, "A B C D E F", "en", "s", 0), (2, "x y z", "en", "s", 0), (None, None, None, None, None)]
        docs = frame(spark, rows).withColumn("node", F.lit("own"))
        kept = near_dedup.without_copies(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {1, 2, None}
        assert near_dedup.without_copies(frame(spark, [])).collect() == []

    def test_links_against_plain_sets(self):
        draw = np.random.default_rng(2)
        base = np.unique(draw.integers(0, 1 << 63, 300)).astype(np.uint64)
        sets = [np.sort(draw.choice(base, draw.integers(200, len(base)), replace=False)) for _ in range(30)]
        got = near_dedup.linked(sets, columns=64)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                common = len(np.intersect1d(a, b))
                assert got[i, j] == (100 * common >= 85 * (len(a) + len(b) - common))
        chain = np.eye(9, dtype=bool) | np.eye(9, k=1, dtype=bool) | np.eye(9, k=-1, dtype=bool)
        assert set(near_dedup.forest_of(chain)) == {0}

    def test_components_of_chains_and_stars(self, spark):
        links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1301)}) == 1
        assert got[0] != got[1000]
        assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


class TestDecontamination:
    ITEM = "item_id bigint, text string"

    def test_against_plain_sets(self, spark):
        draw = random.Random(4)
        items = [(i, prose(draw, n)) for i, n in enumerate([3, 5, 9, 14, 40, 59, 700, 2, 30])] + [(90, None), (91, " "), (4, "dup of four")]
        docs = []
        for i in range(120):
            text = prose(draw, draw.choice([0, 3, 50, 2000]))
            for _, item in draw.sample(items, 2):
                cut = text.split()
                at = draw.randint(0, len(cut))
                text = " ".join([*cut[:at], edited(draw, item or "", draw.choice([0, 0, 0.02, 0.2])).upper(), *cut[at:]])
            docs.append((i, text, "en", "s", 0))
        docs += [(200, None, None, None, None), (None, items[4][1], "en", "s", 0), (3, items[5][1], "en", "s", 0)]
        want = []
        for k, text, *_ in docs:
            w = words_of(text)
            for item, t in items:
                q = shingles_of(t)
                n = min(5, len(words_of(t)))
                have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
                if q and 100 * len(q & have) >= 80 * len(q):
                    want.append((k, item, len(q & have), len(q)))
        for block in (decontamination.BLOCK, 40):
            found = decontamination.contained_items(frame(spark, docs), frame(spark, items, self.ITEM), block=block)
            got = [tuple(r) for r in found.collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
            kept = decontamination.without_items(frame(spark, docs), frame(spark, items, self.ITEM), block=block)
            dirty = {(k, t) for k, t, *_ in docs if any(w[0] == k for w in want)}
            assert kept.count() == sum((k, t) not in dirty or k == 3 and not self._hit(t, items) for k, t, *_ in docs)

    def _hit(self, text, items):
        w = words_of(text)
        for _, t in items:
            q, n = shingles_of(t), min(5, len(words_of(t)))
            have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            if q and 100 * len(q & have) >= 80 * len(q):
                return True
        return False

    def test_empty_sides(self, spark):
        docs, items = frame(spark, [(1, "a b c d e", "en", "s", 0)]), frame(spark, [(1, "a b c d e")], self.ITEM)
        assert decontamination.contained_items(docs.limit(0), items).collect() == []
        assert decontamination.contained_items(docs, items.limit(0)).collect() == []
        assert decontamination.without_items(docs, items.limit(0)).count() == 1
        assert decontamination.without_items(docs, items).count() == 0


class TestTokenOutput:
    def test_round_trip(self, spark, tmp_path):
        from tokenizers import Tokenizer

        draw = random.Random(6)
        texts = ["Hello, World! it's 2024", None, "", "a|b | c || d", "<|endoftext|> x <|ENDOFTEXT|>. «Äß», İI. a.b.. c's' D''", "É́ ñ o p \x1c q\x85r", "ΟΔΟΣ ́x",
                 prose(draw, 20_000), "😀" * 50, "\t\n\r", "don't|we're 'S"]
        rows = [(draw.randint(-5, 300), t, "en", "s", 0) for t in texts * 3] + [(None, "no id", None, None, None)]
        docs = frame(spark, rows).withColumn("ids", F.lit("own"))
        path = str(tmp_path / "orc")
        token_output.write_tokens(docs, path, token_output.default_tokenizer())
        plain = Tokenizer.from_file(token_output.default_tokenizer())
        encode = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        stored = token_output.read_tokens(spark, path).collect()
        assert sorted((repr(r.doc_id), list(r.ids)) for r in stored) == sorted((repr(k), encode(t)) for k, t, *_ in rows)
        got = token_output.summary(spark, path).orderBy("start").collect()
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in got]
        assert ids[0] is None and ids[1:] == sorted(ids[1:])
        sums = sorted(zlib.crc32(np.array(encode(t), "<u4").tobytes()) for _, t, *_ in rows)
        assert sorted(r.ids_crc32 for r in got) == sums

    def test_words_are_forgotten_and_learned_again(self, monkeypatch):
        monkeypatch.setattr(token_output, "REMEMBERED", 3)
        encoder = token_output.WordEncoder(token_output.default_tokenizer())
        for text in ("one two three four", "five six", "one | two", "", "One, two! one"):
            ids, sizes = encoder.encode_all(pa.array([text, text]))
            assert list(ids) == [*encoder.ids(text), 2] * 2 and list(sizes) == [len(ids) // 2] * 2

    def test_ids_are_the_library_s_on_random_characters(self):
        draw = random.Random(11)
        pool = [*map(chr, range(1, 0x250)), *"\u0300\u0301\u03a3\u2028\u3000\u4e2d\U0001f600\ufb01\u1e9e\u0345\u0130\u0130", "<|endoftext|>", "<|", "|>", "'s"]
        pool += [" "] * 60 + list("abcDEF .,!|'") * 12
        texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 60))) for _ in range(4000)] + [None, "", " "]
        encoder = token_output.WordEncoder(token_output.default_tokenizer())
        for begin in range(0, len(texts), 1500):
            part = texts[begin : begin + 1500]
            ids, sizes = encoder.encode_all(pa.array(part))
            want = [[*encoder.ids(t or ""), 2] for t in part]
            assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]

    def test_words_are_cut_before_their_closing_marks_without_a_capture(self):
        """Captures took four fifths of the time of cutting words into parts."""
        assert "(" not in token_output._SPLIT
        words = pa.array(["skipped", "", "a", "a.b..", "...", "é\u0301!", "É,", "x<|", "7-", "\u4e2d|", "a_"]).slice(1)
        cores, tails, parts = token_output._cores_and_tails(words)
        got = [(parts[int(a)].as_py(), parts[int(b)].as_py()) for a, b in zip(cores, tails, strict=True)]
        assert got == [
            ("", ""), ("a", ""), ("a.b", ".."), ("...", ""), ("é\u0301!", ""), ("é", ","), ("x<|", ""), ("7", "-"), ("\u4e2d", "|"), ("a", "_")
        ]

    def test_hashes_of_words_are_their_own(self):
        words = pa.array(["", "a", "b", "ab", "ba", "aa", "a\x00", "é", "x" * 70_000, "x" * 70_001])
        first, second = token_output._Hash()(words)
        again = token_output._Hash()(words.slice(3))
        assert len(set(first.tolist())) == len(set(second.tolist())) == len(words)
        assert (again[0] == first[3:]).all() and (again[1] == second[3:]).all()

    def test_empty_table_and_pruning(self, spark, tmp_path):
        assert token_output.digest(frame(spark, [])).collect() == []
        path = str(tmp_path / "orc")
        token_output.write_tokens(frame(spark, [(i, f"text {i}", "en", "s", 0) for i in range(100)]), path, token_output.default_tokenizer())
        one = token_output.read_tokens(spark, path).filter("doc_id = 42")
        assert "EqualTo(doc_id,42)" in one._jdf.queryExecution().toString() and one.count() == 1


class TestLanguage:
    def docs(self, n=300):
        draw = random.Random(8)
        sounds = {"aa": ["ka", "ta", "na", "ra"], "bb": ["sch", "ung", "ein", "ich"], "cc": ["que", "eau", "oi", "ent"]}
        make = lambda g: " ".join("".join(draw.choice(sounds[g]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(4, 60)))
        return [(i, make(g), g, "s", 0) for i in range(n) for g in [draw.choice(list(sounds))]]

    def test_held_out_accuracy(self, spark):
        rows = self.docs()
        got = language_id.digest(frame(spark, rows)).collect()
        truth = {r[0]: r[2] for r in rows}
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert 0 <= r.score <= 1
        held = [r for r in got if r.held_out]
        assert len(held) > 30 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)

    def test_labels_of_held_out_rows_do_not_matter(self, spark):
        rows = self.docs(150)
        swapped = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 5 == 0 else g, None, 1) for k, t, g, *_ in rows]
        key = lambda rows: sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.digest(frame(spark, rows)).collect())
        assert key(rows) == key(swapped)

    def test_odd_texts(self, spark):
        rows = [*self.docs(150), (1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "12 + 4 = \n!", "bb", "s", 0), (None, "kata nara", None, None, None),
                (1003, "𐐀𐐁 kata", None, "s", 0), (1004, "kata " * 100_000, "aa", "s", 0), (1004, "kata " * 100_000, "aa", "s", 0)]
        got = language_id.digest(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1000, 1001, 1002))
        assert by[1004].lang_pred == "aa"
        kept = language_id.identified(frame(spark, rows).withColumn("score", F.lit("own")))
        assert kept.columns == [*[c.split()[0] for c in DOCS.split(", ")], "score"]
        assert not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}

    def test_rare_languages_are_learned_from_a_small_sample(self, spark):
        draw = random.Random(4)
        rows = [r for r in self.docs(800) if r[2] != "cc"]
        word = lambda: "".join(draw.choice(["zhu", "xia", "qing", "wo"]) for _ in range(3))
        rows += [(1000 + i, " ".join(word() for _ in range(20)), "zz", "s", 0) for i in range(8)] + [(2000, "жщы фщю " * 5, "yy", "s", 0), (2003, "5", "xx", "s", 0)]
        assert all(zlib.crc32(str(k).encode()) % 5 for k in (2000, 2003))
        model = language_id.train(frame(spark, rows), sample=20)
        assert model.languages == ["aa", "bb", "yy", "zz"]
        got = {r.doc_id: r.lang_pred for r in language_id.predict(frame(spark, rows), model).collect()}
        assert all(got[1000 + i] == "zz" for i in range(8)) and got[2000] == "yy"

    def test_no_labels_and_one_language(self, spark):
        assert language_id.digest(frame(spark, [])).collect() == []
        got = language_id.digest(frame(spark, [(i, "kata", None, "s", 0) for i in range(9)])).collect()
        assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
        got = language_id.digest(frame(spark, [(i, "kata", "aa", "s", 0) for i in range(9)])).collect()
        assert {(r.lang_pred, r.score) for r in got} == {("aa", 1.0)}

    def test_elastic_net_gives_zeros(self):
        draw = np.random.default_rng(0)
        rows = [(np.append(np.sort(draw.choice(500, 20, replace=False)), 1 << language_id.BITS), np.append(np.full(20, 0.2), 1.0)) for _ in range(200)]
        rows = [(np.append([1000 + k % 2], f), np.append([1.0], v)) for k, (f, v) in enumerate(rows)]
        labels = np.arange(200) % 2
        weights, _ = language_id.train_ftrl(rows, labels, 2)
        assert (weights[1000:1002] != 0).all() and (weights == 0).mean() > 0.9

    def test_temperature(self):
        draw = np.random.default_rng(0)
        true = draw.normal(size=(4000, 3)) * 2
        p = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
        labels = np.array([draw.choice(3, p=q) for q in p])
        assert language_id.fit_temperature(true * 4, labels) == pytest.approx(4, rel=0.1)


class TestHtml:
    def trees(self, spark):
        draw = random.Random(9)
        rows = []
        for i in range(60):
            body = "".join(f"<p>{prose(draw, draw.randint(5, 60))}." for _ in range(draw.randint(2, 8)))
            rows.append((i, f"http://x/{i}", f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>{prose(draw, 1)}</a></ul></nav>"
                         f'<div class="ad">{prose(draw, 6)}</div><article><h1>{prose(draw, 4)}</h1>{body}</article><footer>&copy; {prose(draw, 6)}</footer>'))
        pages = frame(spark, rows, "page_id bigint, url string, html string")
        return rows, pages, html_main.train(pages)

    def test_extraction(self, spark):
        rows, pages, model = self.trees(spark)
        got = {r.page_id: r.text for r in html_main.extract(pages, model).collect()}
        for k, _, page in rows:
            inner = page.split("<article>")[1].split("</article>")[0]
            title, rest = inner.removeprefix("<h1>").split("</h1>")
            assert got[k] == "\n\n".join([title, *[p for p in rest.split("<p>") if p]])
        # Other layouts than the one trained on.
        draw, right = random.Random(10), 0
        for _, _, page in rows[:40]:
            paragraphs = [p for p in page.split("</h1>")[1].split("</article>")[0].split("<p>") if p]
            made = html_main.rebuilt("A title", paragraphs, [prose(draw, 5) for _ in range(5)], draw)
            nodes = html_tree.preorder(html_tree.parse(made))
            number = {id(n): k for k, n in enumerate(nodes)}
            want = "\n\n".join(html_tree.blocks(nodes[0], {k for k, n in enumerate(nodes) if n.label}, number))
            clean = made.replace(' data-main="1"', "").replace(' data-main="0"', "")
            right += html_main.extract_pages([clean], model)[0] == want
        assert right >= 36

    def test_hand_made_layouts(self, spark):
        model = html_main.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
        nouns = ("road", "river", "field", "market", "winter", "summer")
        texts = [f"The {w} of the valley was long and quiet, and people walked there every day, talking of old things." for w in nouns]
        ps, title = lambda k: "".join(f"<p>{t}</p>" for t in texts[:k]), "A quiet valley"
        h1, last = f"<h1>{title}</h1>", f"<p>{texts[4]}</p>"
        cells = ["Year", "People", "1990", "1,200", "2000", "1,450"]
        table = "<table><tr><th>{}</th><th>{}</th></tr><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*cells)
        talk = f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{texts[5]}</p></div><div class="comment"><p>I liked it.</p></div></section>'
        side = "<aside class=sidebar><h3>More</h3><ul><li><a href=/1>One story</a></li><li><a href=/2>Two stories</a></li></ul></aside>"
        whole = "Read the whole report of the valley here"
        cases = [
            (f"<article>{h1}{ps(4)}</article>", texts[:4]),
            (f"<article>{h1}{ps(3)}{table}{last}</article>", [*texts[:3], *cells, texts[4]]),
            (f"<article>{h1}{ps(2)}<p><a href=/x>{texts[3]}</a></p>{last}</article>", [*texts[:2], texts[3], texts[4]]),
            (f"<article>{h1}{ps(3)}<p><a href=/x>{whole}</a></p>{last}</article>", [*texts[:3], whole, texts[4]]),
            (f"<div class=post>{h1}{ps(5)}</div>", texts[:5]),
            (f"<div>{h1}{ps(5)}</div>", texts[:5]),
            (f"<div><div><div>{h1}{ps(5)}</div></div></div>", texts[:5]),
            (f"<article>{h1}{ps(2)}<pre>x = 1; y = 2</pre>{last}</article>", [*texts[:2], "x = 1; y = 2", texts[4]]),
            (f"<article>{h1}{ps(2)}<dl><dt>Valley</dt><dd>A low place.</dd><dt>Hill</dt><dd>A high place.</dd></dl>{last}</article>",
             [*texts[:2], "Valley", "A low place.", "Hill", "A high place.", texts[4]]),
            (f"<article>{h1}{ps(2)}<figure><img src=x><figcaption>The valley in spring</figcaption></figure>{last}</article>", [*texts[:2], "The valley in spring", texts[4]]),
            (f"<article>{h1}{ps(2)}<h2>What to see</h2><ul><li>The old mill</li><li>The stone bridge</li></ul>{last}</article>",
             [*texts[:2], "What to see", "The old mill", "The stone bridge", texts[4]]),
            (f"<article>{h1}{ps(4)}</article>{talk}", texts[:4]),
            (f"<article>{h1}{ps(4)}</article>{side}", texts[:4]),
            (f"<div class=post>{h1}{ps(4)}<div class=cookie-notice>We use cookies. <button>ok</button></div></div>{talk}", texts[:4]),
        ]
        nav = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/c>Contact</a></li></ul></nav><div class=ad>Buy now cheap things</div>"
        foot = "<footer><p>&copy; 2024 Some Site. All rights reserved.</p></footer>"
        got = html_main.extract_pages([f"<html><head><title>x</title></head><body>{nav}{main}{foot}</body></html>" for main, _ in cases], model)
        assert got == ["\n\n".join([title, *want]) for _, want in cases]

    def test_broken_and_empty_pages(self, spark):
        _, _, model = self.trees(spark)
        pages = [None, "", "plain", "<", "<p", "</div></p>", "<!-- never closed <p>x", "<script>var a = '<p>';", "<div>" * 3000 + "x", "<p a='" * 500,
                 "<a href=\"x>y\">" + "z" * 200_000, "&#0;&#xD800;&bogus;&amp", "<table><tr><td>a<td>b<tr><td>c</table>", "<title>x"]
        got = html_main.extract_pages(pages, model)
        assert len(got) == len(pages) and all(isinstance(t, str) for t in got)
        assert got[0] == got[1] == ""

    def test_blocks_and_references(self):
        root = html_tree.parse("<body><p> a&amp;b&nbsp;c <b>d<br>e\n\n f</b><p>g<script>h</script> &lt;i&gt;<ul><li>j<li>k</ul>l<!-- m -->n &am</p>")
        number = {id(n): k for k, n in enumerate(html_tree.preorder(root))}
        assert html_tree.blocks(root, None, number) == ["a&b c d e f", "g <i>", "j", "k", "ln &am"]

    def test_head_ends_without_its_end_tag(self):
        text = lambda page: "\n".join(html_tree.blocks(html_tree.parse(page), None, {}))
        long = "<p>One.</p><div>Two.</div>"
        for head in ("<title>x</title>", "<meta charset=x><title>x</title><noscript><img src=x></noscript>", "<script>a</script>"):
            for start in ("<body>", "<body class=story>", ""):
                page = f"<html><head>{head}{start}{long}</body></html>"
                assert text(page) == "One.\nTwo." == text(page.replace(start or "<p>", "</head>" + (start or "<p>"), 1))
        assert html_tree.parse("<html><head><title>x</title><body class=story><p>a").names == ["story"]
        assert text("<head><title>x</title>Plain text <p>b") == "Plain text\nb"
        assert text("<head><title>x<body><p>a</p>") == "a"
        assert text("<p>a</p><head><p>b</p>") == "a\nb"

    def test_hidden_elements_hide_no_more_than_themselves(self):
        text = lambda page: "\n".join(html_tree.blocks(html_tree.parse(page), None, {}))
        assert text('<p>a <svg width="1"/> b</p><p>c <svg><path d="M0"/><title/><style/><text>no</text></svg> d</p>') == "a b\nc d"
        assert text("<p>a <svg href=x/><text>no</text></svg> b</p>") == "a b"
        assert text("<div>a <svg><path></div><p>b</p><svg><g>no</g></svg><p>c") == "a\nb\nc"
        assert text("<svg><path><p>a</p><svg><foreignObject><p>no</p></foreignObject></svg><p>b") == "a\nb"
        for tag in ("svg", "noscript", "template", "object", "select", "datalist", "iframe", "noframes"):
            assert text(f"<div><p>a</p><{tag}><p>b</p></div><p>c</p>") == "a\nb\nc"
            assert "no" not in text(f"<div><p>a</p><{tag}><desc>no</desc></{tag}></div><p>c</p>")
        assert text("<noscript><p>no<noscript>no</noscript><p>a") == "a"

    def test_long_quoted_values_stay_in_their_tag(self):
        text = lambda page: "\n".join(html_tree.blocks(html_tree.parse(page), None, {}))
        for size in (10, 5_000, 500_000):
            for quote in "\"'":
                value = ("x" * size + "<p class=ad>no</p>") * 2
                root = html_tree.parse(f"<body><div data-a={quote}{value}{quote} class=story>a</div><p title = {quote}>{value}{quote}>b</p>")
                assert html_tree.blocks(root, None, {}) == ["a", "b"]
                assert [n.names for n in html_tree.preorder(root)] == [[], ["story"], []]
        assert html_tree.parse("<div data-a='<p class=\"ad\">' class=story>a").children[0].names == ["story"]
        # A quote that opens no value ends nothing; one that is never closed leaves the tag as it was.
        assert text("<p title=don't>a</p><p b'c>d</p><p>it's</p>") == "a\nd\nit's"
        assert text('<p>a</p><p title="b>c</p><p>d') == "a\nc\nd"
        assert text("<p a=\"" * 20_000 + ">" + "<p a='" * 20_000) == ""

    def test_formulas_are_kept(self):
        page = '<p>So <math display="inline"><mrow><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup><mspace/></mrow></math> holds.</p><p>Next.</p>'
        assert html_tree.blocks(html_tree.parse(page), None, {}) == ["So a=b2 holds.", "Next."]
        assert html_tree.blocks(html_tree.parse("<p>a <math/> b</p><p>c <math><mi>d</mi><p>e"), None, {}) == ["a b", "c d", "e"]

    def test_decoding_is_consistent(self):
        root = html_tree.parse("<body><div><div><p>a</p></div><p>b</p></div><p>c</p></body>")
        nodes = html_tree.preorder(root)
        draw = np.random.default_rng(1)
        for _ in range(200):
            margin = draw.normal(size=len(nodes)) * 3
            kept = html_main.decode(nodes, margin)
            number = {id(n): k for k, n in enumerate(nodes)}
            for k in kept:
                up = nodes[k].parent
                # Above a kept node: kept ones, then mere paths; never a kept one above a path.
                states = []
                while up is not None:
                    states.append(number[id(up)] in kept)
                    up = up.parent
                assert states == sorted(states, reverse=True)

    def test_boosting_learns(self):
        draw = np.random.default_rng(0)
        x = draw.normal(size=(2000, 5))
        y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
        trees = boosting.fit(x, y, np.ones(2000), trees=30)
        new = draw.normal(size=(1000, 5))
        assert ((trees.margin(new) > 0) == ((new[:, 0] > 0) ^ (new[:, 3] > 0.5))).mean() > 0.95

    def test_empty_table(self, spark):
        pages = frame(spark, [], "page_id bigint, url string, html string")
        assert html_main.digest(pages).collect() == []
