"""Main text of HTML pages: boosted trees over DOM nodes, decoded top-down.

A page becomes a tree of block elements. Boosted trees judge every node by its subtree's density
of text, links and punctuation, by the tokens of its own and its ancestors' attributes, by depth
and by its siblings. A dynamic program then gives each node one of three states: ``in`` (its text
counts), ``path`` (main text lies below, its own text does not count) or ``out``. Below ``out``
everything is out, and below ``in`` nothing is a mere path, so no choice contradicts another.

The model is trained on a bounded sample of pages, ``SAMPLE`` in expectation, chosen by a hash of
the id, each with bounded parts (``SAMPLE_...``). Their own markup labels them (what lies in an article or main element, and what lies in
navigation, footers and marked boxes); each also lends its paragraphs to pages rebuilt in other
layouts, with tables, link paragraphs, code, figures and definitions in the article, and with
notices, side columns, forms and reader comments, so that names of elements alone do not decide. Extraction is one pass over whole pages without an exchange.

Defined results: a NULL or empty page, or one without main text, has the empty text. Broken
markup is read as browsers do where that is simple: open paragraphs and list items end at the
next block, unmatched end tags are skipped, a cut-off page ends where it ends. Repeated rows are
extracted each. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import boosting
from dialoom.llm.common import hash_fraction
from dialoom.llm.html_tree import Node, blocks, features, parse, preorder

SAMPLE = 150
#: Bounds on what one sampled page lends to the training: characters of paragraphs for rebuilt layouts, characters of a
#: title or another text, other texts, nodes. None of them touches extraction, which reads whole pages.
SAMPLE_CHARS, SAMPLE_SHORT, SAMPLE_OTHERS, SAMPLE_NODES = 20_000, 300, 200, 2_000
#: Rebuilt layouts of each sampled page.
LAYOUTS = 4
PATH_COST = 0.3
SEPARATOR = "\n\n"  # between blocks

#: Names that layouts use, fixed values.
_MAIN = ['article', 'main', 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"',
         'section class="article-body"', 'div class="story"', 'div role="main"', 'div class="post-content"', 'div class="text"', 'div', 'div', 'article']
_MENU = ['nav', 'div class="menu"', 'ul class="nav"', 'div id="navbar"', 'div class="breadcrumb"', 'div role="navigation"']
_TOP = ['header', 'div class="header"', 'div id="masthead"', 'div class="banner"']
_FOOT = ['footer', 'div class="footer"', 'div id="footer"', 'div class="bottom"', 'div class="copyright"']
_SIDE = ['aside', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'section class="related-posts"']
_AD = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="sponsored"', 'div class="promo"', 'div id="ad-1"', 'aside class="advertisement"']
_NOTICE = ['div class="notice"', 'div class="cookie-notice"', 'div id="cookie-consent"', 'div class="alert"', 'div class="popup"', 'div class="cookie-banner"']
_FORM = ['form', 'form class="newsletter"', 'div class="subscribe"', 'form id="login"', 'div class="signup"', 'form class="search"']
_TALK = ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'div class="discussion"', 'ol class="comments"', 'div class="comments-area"']
_SHARE = ['div class="share"', 'div class="social"', 'div class="tags"', 'ul class="social-links"']
_OUT = set("nav header footer aside form".split())
_OUT_NAMES = set(
    "nav menu navbar breadcrumb header masthead banner footer sidebar widget related ad ads advert advertisement sponsored promo notice "
    "cookie consent popup form search login subscribe newsletter signup comment comments discussion share social".split()
)


def weak_labels(nodes: list[Node]) -> bool:
    """Set each node's label from the page's own markup; False if it names no main element."""
    found = any(n.tag in ("article", "main") or "main" in n.names for n in nodes)
    for n in nodes:
        inside = n.parent.label if n.parent is not None else 0
        if n.tag in ("article", "main"):
            n.label = 1
        elif (n.tag in _OUT and not inside) or n.tag in ("nav", "form", "footer", "aside") or _OUT_NAMES & set(n.names):
            n.label = 0
        else:
            n.label = inside
    return found


def _closed(opening: str, inner: str, label: int) -> str:
    tag = opening.split()[0]
    return f'<{opening} data-main="{label}">{inner}</{tag}>'


def rebuilt(title: str, paragraphs: list[str], other: list[str], draw: random.Random) -> str:
    """A page with these paragraphs as its main text in another layout; ``data-main`` marks the truth."""
    pick = draw.choice
    some = lambda n: " ".join(pick(other) for _ in range(n))
    links = lambda n: "".join(f'<li><a href="#">{" ".join(pick(other).split()[:2])}</a></li>' for _ in range(n))
    long = lambda: pick(paragraphs) if paragraphs else some(3)
    item = lambda: f"<p>{pick([long(), some(1), some(2)])}</p>"

    def bit(text: str) -> str:
        """A few words of a paragraph, or a number: what cells, terms and captions hold."""
        words = text.split() or ["x"]
        at = draw.randrange(len(words))
        return " ".join(words[at : at + draw.choice([1, 1, 2, 3, 6])]) if draw.random() < 0.75 else f"{draw.randint(1, 30_000):,}"

    def table(cell, rows: int, columns: int) -> str:
        head = "<tr>" + "".join(f"<th>{cell()}</th>" for _ in range(columns)) + "</tr>"
        lines = "".join("<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(columns)) + "</tr>" for _ in range(rows))
        head = f"<thead>{head}</thead>" if draw.random() < 0.3 else head
        return f"<table>{head if draw.random() < 0.8 else ''}{f'<tbody>{lines}</tbody>' if draw.random() < 0.3 else lines}</table>"

    def inset(p: str) -> str:
        """Parts of an article that are no plain paragraphs."""
        cell = lambda: bit(p)
        return pick([
            lambda: table(cell, draw.randint(1, 5), draw.randint(2, 4)),
            lambda: f'<p><a href="#">{p}</a></p>',
            lambda: f'<p><a href="#">{" ".join(p.split()[:8])}</a></p>',
            lambda: f"<pre>{pick([p[:80], f'<code>{p[:60]}</code>'])}</pre>",
            lambda: f"<figure><img src=a.png><figcaption>{bit(p)} {bit(p)}</figcaption></figure>",
            lambda: "<dl>" + "".join(f"<dt>{bit(p)}</dt><dd>{p[:70]}</dd>" for _ in range(draw.randint(1, 4))) + "</dl>",
            lambda: f"<{pick(['ul', 'ol'])}>" + "".join(f"<li>{bit(p)}" for _ in range(draw.randint(2, 6))) + "</ul>",
            lambda: f"<{(tag := pick(['h2', 'h3']))}>{bit(p)}</{tag}>",
        ])()

    body = []
    for k, p in enumerate(paragraphs):
        body.append(f"<p>{p}</p>" if draw.random() < 0.9 else f"<h2>{p[:50]}</h2><p>{p}</p>" if draw.random() < 0.5 else f"<blockquote><p>{p}</p></blockquote>")
        if draw.random() < 0.25:
            body.append(inset(p))
        if k and draw.random() < 0.05:
            body.append(f"<ul><li>{p[:60]}</li><li>{p[60:120] or p}</li></ul>")
        for names, chance in ((_AD, 0.04), (_SHARE, 0.02), (_FORM, 0.02), (_SIDE, 0.02), (_NOTICE, 0.02)):
            if draw.random() < chance:
                body.append(_closed(pick(names), pick([some(2), item(), f"<p>{some(1)}</p><input><button>ok</button>"]), 0))
    talk = lambda: _closed(pick(_TALK), f"<h3>{some(1)}</h3>" + "".join(
        pick([f'<div class="comment"><p>{long()}</p></div>', f"<p>{some(1)}</p>", f"<li>{long()}</li>"]) for _ in range(draw.randint(1, 5))), 0)
    heading = f"<h1>{title}</h1>"
    if draw.random() < 0.2:
        heading = f"<header>{heading}</header>"
    inner = heading + "".join(body)
    if draw.random() < 0.25:
        inner += talk()
    main = _closed(pick(_MAIN), inner, 1)
    while draw.random() < 0.2:
        main = _closed(pick(["div", "div", "section", 'div class="row"']), main, 0)
    before = [
        _closed(pick(_MENU), f"<ul>{links(draw.randint(3, 9))}</ul>", 0) if draw.random() < 0.85 else "",
        _closed(pick(_TOP), pick([f"<a>{some(1)}</a>", f"<p>{some(1)}</p>", f"<h2>{some(1)}</h2><ul>{links(3)}</ul>"]), 0) if draw.random() < 0.5 else "",
        _closed(pick(_AD), pick([some(1), item()]), 0) if draw.random() < 0.5 else "",
        _closed(pick(_NOTICE), pick([some(2), item()]) + "<button>ok</button>", 0) if draw.random() < 0.4 else "",
    ]
    after = [
        talk() if draw.random() < 0.4 else "",
        _closed(pick(_SIDE), pick([f"<h3>{some(1)}</h3><ul>{links(4)}</ul>", item() + item(), table(lambda: str(draw.randint(1, 31)), 5, 7), f'<p><a href="#">{long()}</a></p>']), 0) if draw.random() < 0.5 else "",
        _closed(pick(_FORM), f"<label>{some(1)}</label><input><button>ok</button>", 0) if draw.random() < 0.4 else "",
        _closed(pick(_AD), pick([some(1), item()]), 0) if draw.random() < 0.3 else "",
        _closed(pick(_FOOT), pick([f"&copy; {some(1)}", item(), f"<ul>{links(4)}</ul>"]), 0) if draw.random() < 0.9 else "",
    ]
    draw.shuffle(before)
    whole = "".join(before) + main + "".join(after)
    return f'<html><body data-main="0">{_closed(pick(["div", "div class=wrapper", "div id=page"]), whole, 0)}</body></html>'


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled pages: the page's features and labels, its title, main paragraphs and other texts."""
    for batch in batches:
        out = []
        for page in batch.column(0).to_pylist():
            root = parse(page)
            nodes = preorder(root)
            if not weak_labels(nodes):
                continue
            number = {id(n): k for k, n in enumerate(nodes)}
            main = blocks(root, {k for k, n in enumerate(nodes) if n.label}, number)
            rest = blocks(root, {k for k, n in enumerate(nodes) if not n.label}, number)
            size, kept = 0, []
            for text in main[1:]:
                size += len(text)
                if size > SAMPLE_CHARS:
                    break
                kept.append(text)
            labels = np.array([n.label or 0 for n in nodes], np.int8)
            x = features(nodes).astype(np.float32)
            if len(nodes) > SAMPLE_NODES:  # evenly over the page
                at = np.linspace(0, len(nodes) - 1, SAMPLE_NODES).astype(int)
                x, labels = x[at], labels[at]
            others = [t[:SAMPLE_SHORT] for t in rest[:SAMPLE_OTHERS]]
            out.append((x.tobytes(), labels.tobytes(), (main or [""])[0][:SAMPLE_SHORT], kept, others))
        kinds = [pa.binary(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], kinds[i]) for i in range(5)], ["x", "y", "title", "main", "other"]
        )


def train(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", sample: int = SAMPLE) -> boosting.Trees:
    """Boosted trees from a bounded sample of the pages."""
    total = pages.count()
    draw = hash_fraction(F.col(id_column), F.md5(F.coalesce(F.col(html_column), F.lit(""))), seed=4)
    chosen = pages.filter(draw < F.lit(min(1.0, sample / max(total, 1)))).select(html_column)
    found = chosen.mapInArrow(_pieces, "x binary, y binary, title string, main array<string>, other array<string>").collect()
    found.sort(key=lambda r: (r["title"], r["x"]))
    # Without any labelled page, a few plain sentences stand in.
    stock = [("Title", [f"This is sentence {k}, and it goes on for a while, as sentences do." * (1 + k % 4) for k in range(6)], ["Home", "About us", "All rights reserved", "Read more"])]
    xs, ys, dice = [], [], random.Random(4)
    width = features(preorder(parse(""))).shape[1]
    for r in found:
        xs.append(np.frombuffer(r["x"], np.float32).reshape(-1, width))
        ys.append(np.frombuffer(r["y"], np.int8))
    sources = [(r["title"], r["main"], r["other"]) for r in found] or stock * 20
    for title, main, other in sources:
        for _ in range(LAYOUTS):
            paragraphs = dice.sample(main, dice.randint(1, len(main))) if main else stock[0][1]
            nodes = preorder(parse(rebuilt(title, paragraphs, [t for t in other if t] or stock[0][2], dice)))
            xs.append(features(nodes))
            ys.append(np.array([n.label or 0 for n in nodes], np.int8))
    x, y = np.vstack(xs).astype(float), np.concatenate(ys).astype(float)
    weight = np.concatenate([np.full(len(v), 1 / np.sqrt(len(v))) for v in ys])
    return boosting.fit(x, y, weight / weight.mean())


def decode(nodes: list[Node], margin: np.ndarray) -> set[int]:
    """Numbers of the nodes whose text counts, by the best consistent choice of states."""
    number = {id(n): k for k, n in enumerate(nodes)}
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    inside, path, out = yes.copy(), no - PATH_COST, no.copy()
    for k in range(len(nodes) - 1, 0, -1):
        up = number[id(nodes[k].parent)]
        inside[up] += max(inside[k], out[k])
        path[up] += max(inside[k], path[k], out[k])
        out[up] += out[k]
    state = ["out"] * len(nodes)
    kept = set()
    for k, n in enumerate(nodes):
        above = state[number[id(n.parent)]] if n.parent is not None else "path"
        if above == "out":
            continue
        options = {"in": inside[k], "out": out[k]} if above == "in" else {"in": inside[k], "path": path[k], "out": out[k]}
        state[k] = max(options, key=options.get)
        if state[k] == "in":
            kept.add(k)
    return kept


def extract_pages(pages: list[str | None], model: boosting.Trees, together: int = 64) -> list[str]:
    """The main text of each page; pages are judged several at a time."""
    out = []
    for begin in range(0, len(pages), together):
        trees = [preorder(parse(p)) for p in pages[begin : begin + together]]
        margins = model.margin(np.vstack([features(nodes) for nodes in trees]))
        ends = np.cumsum([len(nodes) for nodes in trees])
        for nodes, margin in zip(trees, np.split(margins, ends[:-1]), strict=True):
            number = {id(n): k for k, n in enumerate(nodes)}
            out.append(SEPARATOR.join(blocks(nodes[0], decode(nodes, margin), number)))
    return out


def extract(pages: DataFrame, model: boosting.Trees, html_column: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns, with the main text as column ``name``."""
    shared = pages.sparkSession.sparkContext.broadcast(
        (model.cuts, model.start, model.feature, model.border, model.value)
    )

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = boosting.Trees(*shared.value)
        for batch in batches:
            yield pd.Series(extract_pages(batch.tolist(), trees), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pages.withColumn(name, F.pandas_udf(run, "string").asNondeterministic()(F.col(html_column)))


def digest(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of the registered query."""
    found = extract(pages.select("page_id", "url", "html"), train(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
