"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the variables of a tree; each has evidence from its tag, names and
text, and each pair of parent and child a potential. Messages summed upward and downward give every
element's exact marginal of being content. Weights and potentials maximise the likelihood of labelled pages.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm.common import fresh, query, small_batches, table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
LABEL = re.compile(r'data-content="([01])"')
WORD = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?…。！？](?:\s|$|[\"'»”)])")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe".split())
UNSEEN = frozenset("template svg select button object canvas audio video datalist annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q s "
                   "samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}


@dataclass
class Page:
    """Block elements in page order: parent (-1: none), evidence, label if given; and the blocks of text."""

    parent: list[int] = field(default_factory=list)
    evidence: list[list[str]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of block elements and the text blocks; inline elements belong to the block around them.

    Unseen elements leave nothing behind once their own end tag comes. If they end otherwise, with an element around them or with the page,
    what follows their start tag was not theirs and stays. Formulas are text of their block.
    """
    page = Page([-1], [["bias", "t:page"]], [-1])
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    links = [0, 0]  # characters of the open block, of which in links
    stats: dict[int, list[int]] = {}
    inside_link = 0
    in_formula = False
    hidden: list[tuple] = []  # open unseen elements: name, open blocks, and all that is to be as it was
    endless: set[str] = set()  # raw elements that no end tag follows any more

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            node = stack[-1][1]
            page.blocks.append((node, text))
            mine = stats.setdefault(node, [0, 0, 0, 0])
            mine[0] += links[0]
            mine[1] += links[1]
            mine[2] |= bool(SENTENCE.search(text))
            mine[3] |= "©" in text
        pieces.clear()
        links[:] = [0, 0]

    def say(text: str) -> None:
        if text:
            text = entities.unescape(text)
            pieces.append(text)
            size = len(text.strip())
            links[0] += size
            links[1] += size * bool(inside_link)

    at = 0
    while True:
        m = TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if name in RAW:
            if not closing and name not in endless:
                end = re.compile(rf"</{name}(?![a-zA-Z0-9])[^>]*>?", re.I).search(source, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(source)
                else:
                    endless.add(name)
            continue
        own_end = (attributes or "").rstrip().endswith("/")
        if name == "math":
            in_formula = not closing and not own_end
            continue
        if name in UNSEEN:
            if not closing and not (own_end and name == "svg"):
                node = stack[-1][1]
                hidden.append((name, len(stack), list(pieces), list(links), len(page.parent), len(page.blocks), node, list(stats.get(node, ())), inside_link))
            elif closing and any(h[0] == name for h in hidden):
                while hidden[-1][0] != name:
                    hidden.pop()
                _, depth, pieces[:], links[:], nodes, blocks, node, before, inside_link = hidden.pop()
                del stack[depth:], page.parent[nodes:], page.evidence[nodes:], page.label[nodes:], page.blocks[blocks:]
                for k in [k for k in stats if k >= nodes]:
                    del stats[k]
                stats.pop(node, None)
                if before:
                    stats[node] = before
            continue
        if in_formula:
            if name not in CLOSES_P:
                continue
            in_formula = False
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                inside_link = 0 if closing else 1
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    inside_link = 0
                    break
            while hidden and hidden[-1][1] > len(stack):
                hidden.pop()
            continue
        floor = hidden[-1][1] - 1 if hidden else 0
        if name in CLOSES_P:
            for k in range(len(stack) - 1, floor, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "caption", "object"):
                    break
        elif name in ENDS:
            ends, limit = ENDS[name]
            for k in range(len(stack) - 1, floor, -1):
                if stack[k][0] in limit:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    if name not in ("tr", "tbody"):
                        break
        if name in VOID:
            continue
        seen = ["bias", "t:" + name]
        if attributes:
            for value in NAMES.findall(attributes):
                seen += ["c:" + w for w in WORD.findall((value[0] or value[1] or value[2]).lower())]
            if HIDDEN.search(attributes):
                seen.append("hidden")
        given = LABEL.search(attributes) if attributes else None
        page.parent.append(stack[-1][1])
        page.evidence.append(seen)
        page.label.append(int(given[1]) if given else -1)
        if not attributes.rstrip().endswith("/") or name not in ("path", "g"):
            stack.append((name, len(page.parent) - 1))
    flush()
    for node, (size, linked, sentence, mark) in stats.items():
        share = linked / max(size, 1)
        page.evidence[node] += ["size:" + ("a" if size < 15 else "b" if size < 50 else "c" if size < 120 else "d"),
                                "links:" + ("none" if not linked else "few" if share < 0.3 else "many" if share < 0.7 else "all")]
        if sentence:
            page.evidence[node].append("sentence")
        if mark:
            page.evidence[node].append("mark")
    return page


@dataclass
class TreeModel:
    """``weight`` of each kind of evidence for content; ``pair``[parent][child], in logarithms."""

    index: dict[str, int]
    weight: np.ndarray
    pair: np.ndarray


class Forest:
    """Arrays of many pages at once, layer by layer."""

    def __init__(self, pages: list[Page], index: dict[str, int]) -> None:
        sizes = [len(p.parent) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, self.start)]) if pages else np.zeros(0, int)
        depth = np.zeros(len(self.parent), int)
        for s, e in zip(self.start[:-1], self.start[1:]):  # parents come before their children
            for i in range(s + 1, e):
                depth[i] = depth[self.parent[i]] + 1
        self.layers = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        pairs = [(s + i, index[w]) for p, s in zip(pages, self.start) for i, seen in enumerate(p.evidence) for w in seen if w in index]
        self.node, self.kind = np.array(pairs, int).reshape(-1, 2).T

    def marginals(self, model: TreeModel) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element; joint [parent][child] of each element and its parent (roots: zeros)."""
        n = len(self.parent)
        belief = np.zeros((n, 2))
        belief[:, 1] = np.bincount(self.node, model.weight[self.kind], n)
        up = np.zeros((n, 2))
        for layer in reversed(self.layers):
            up[layer] = np.logaddexp(model.pair[:, 0] + belief[layer, :1], model.pair[:, 1] + belief[layer, 1:])
            np.add.at(belief, self.parent[layer], up[layer])
        joint = np.zeros((n, 2, 2))
        total = belief.copy()  # of roots already the whole
        for layer in self.layers:
            above = total[self.parent[layer]] - up[layer]
            total[layer] = belief[layer] + np.logaddexp(above[:, :1] + model.pair[0], above[:, 1:] + model.pair[1])
            both = above[:, :, None] + model.pair[None] + belief[layer][:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[layer] = both / both.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint


def train(sources: list[str], steps: int = 300, rate: float = 0.1, shrink: float = 0.001) -> TreeModel:
    """Maximum likelihood on pages whose outermost elements carry ``data-content``; containers of both are content."""
    pages = [parse(s) for s in sources]
    for page in pages:
        for i in range(1, len(page.label)):
            if page.label[i] < 0:
                page.label[i] = page.label[page.parent[i]]
        for i in range(len(page.label) - 1, 0, -1):
            if page.label[i] < 0:
                page.label[i] = 0
            if page.label[i] == 1:
                up = page.parent[i]
                page.label[up] = 1 if page.label[up] != 0 or up == 0 else 0
        page.label[0] = max(page.label[0], 0)
    words = sorted({w for p in pages for seen in p.evidence for w in seen})
    model = TreeModel({w: i for i, w in enumerate(words)}, np.zeros(len(words)), np.zeros((2, 2)))
    forest = Forest(pages, model.index)
    label = np.array([y for p in pages for y in p.label])
    child = np.flatnonzero(forest.parent >= 0)
    counted = np.zeros((2, 2))
    np.add.at(counted, (label[forest.parent[child]], label[child]), 1)
    wanted = np.bincount(forest.kind, label[forest.node], len(words))
    moments = [np.zeros(len(words)), np.zeros(len(words)), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        marginal, joint = forest.marginals(model)
        gw = (wanted - np.bincount(forest.kind, marginal[forest.node], len(words))) / len(pages) - shrink * model.weight
        gp = (counted - joint.sum(axis=0)) / len(pages) - shrink * model.pair
        for k, (g, x) in enumerate(((gw, model.weight), (gp, model.pair))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * g * g
            x += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return model


def main_texts(sources: list[str], model: TreeModel) -> list[str]:
    """The content blocks of each page, in page order, joined by line feeds."""
    pages = [parse(s) for s in sources]
    forest = Forest(pages, model.index)
    content = forest.marginals(model)[0] >= 0.5
    return ["\n".join(text for node, text in page.blocks if content[start + node]) for page, start in zip(pages, forest.start)]


def labelled_pages(count: int = 1500, seed: int = 11) -> list[str]:
    """Labelled training pages: frames, articles and page furniture as people build them, put together at random."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        return words(5, 18).capitalize() + rng.choice(["."] * 8 + ["!", "?"])

    def prose() -> str:
        if rng.random() < 0.25:
            return sentence() if rng.random() < 0.6 else words(1, 4)
        text = " ".join(sentence() for _ in range(rng.randint(1, 7)))
        return text if rng.random() > 0.2 else f'{sentence()} <a href="/x">{words(1, 3)}</a> {text} <b>{words(1, 2)}</b>.'

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(rng.randint(low, high)))

    def pick(*names: str) -> str:
        return f'{rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    no = 'data-content="0"'

    def article() -> str:
        out = [f"<h1>{words(3, 9).capitalize()}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.2:
            out.append(f"<p {pick('byline author', 'meta', 'post-meta')} {no}>By <a href='/a'>{words(1, 2)}</a></p>")
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                out.append(f"<p>{prose()}</p>" if rng.random() < 0.8 else f"<p>{prose()}<br>{prose()}")
            elif kind < 0.76:
                out.append(f"<h{rng.choice('234')}>{words(2, 6).capitalize()}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.89:
                out.append("<table><tbody>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</tbody></table>")
            elif kind < 0.92:
                out.append(f"<div>{prose()}</div>")
            elif kind < 0.94:
                out.append(f"<pre>{words(4, 12)}</pre>")
            else:
                out.append(furniture(True))
        return "".join(out)

    def comment() -> str:
        return rng.choice(["<div class='comment'>{}</div>", "<li class='comment'>{}</li>", "<article class='comment'>{}</article>", "<p>{}</p>"]).format(
            rng.choice([f"<p>{prose()}</p>", f"<b>{words(1, 2)}</b> {prose()}", f"<p class='author'>{words(1, 2)}</p><p>{prose()}</p>"]))

    def furniture(within: bool = False) -> str:
        kinds = [
            lambda: f"<div {pick('ad', 'ads', 'advert', 'advertisement', 'ad-banner', 'sponsored', 'promo')} {no}>{rng.choice([sentence(), words(2, 6), prose(), '<p>' + prose() + '</p>'])}</div>",
            lambda: f"<div {pick('notice', 'cookie-notice', 'alert', 'cookie-banner', 'consent', 'message', 'paywall', 'warning')} {no}>{rng.choice([prose(), '<p>' + prose() + '</p>'])}</div>",
            lambda: f"<div {pick('share', 'social', 'share-bar', 'sharing')} {no}><ul>{links(2, 5)}</ul></div>",
            lambda: f"<div {pick('related', 'related-posts', 'more', 'recommended', 'read-more')} {no}><h3>{words(1, 3)}</h3><ul>{links(2, 5)}</ul></div>",
            lambda: f"<form {no}><label>{words(1, 3)}</label><input name='q'><p>{sentence()}</p></form>",
            lambda: f"<div {pick('newsletter', 'subscribe', 'signup')} {no}><form><p>{sentence()}</p><input name='mail'></form></div>",
            lambda: f"<aside {rng.choice(['', pick('sidebar', 'note', 'widget')])} {no}>{rng.choice(['<p>' + prose() + '</p>', f'<h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul>', prose()])}</aside>",
        ]
        outer = [
            lambda: f"<nav {rng.choice(['', pick('nav', 'menu', 'navbar')])} {no}>{rng.choice([f'<ul>{links(3, 8)}</ul>', f'<a href=/>{words(1, 2)}</a> <a href=/b>{words(1, 2)}</a>'])}</nav>",
            lambda: f"<header {rng.choice(['', pick('header', 'site-header', 'masthead', 'banner')])} {no}>{rng.choice([words(1, 4), f'<h1>{words(1, 4)}</h1><p>{sentence()}</p>', f'<div class=logo>{words(1, 2)}</div>'])}</header>",
            lambda: f"<footer {rng.choice(['', pick('footer', 'site-footer')])} {no}>{rng.choice(['&copy; ' + words(1, 2) + ' &middot; ' + sentence(), '<p>' + prose() + '</p>', f'<ul>{links(2, 6)}</ul><p>&copy; {words(1, 3)}</p>'])}</footer>",
            lambda: f"<div {pick('menu', 'nav', 'navigation', 'topbar', 'main-menu', 'header', 'top')} {no}><ul>{links(3, 8)}</ul></div>",
            lambda: f"<ul {pick('menu', 'nav', 'breadcrumb', 'breadcrumbs', 'links', 'tags', 'pagination')} {no}>{links(2, 6)}</ul>",
            lambda: f"<div {pick('sidebar', 'side', 'widget', 'rightbar', 'sidebar-right')} {no}><h3>{words(1, 3)}</h3>{rng.choice([f'<ul>{links(2, 6)}</ul>', '<p>' + prose() + '</p>'])}</div>",
            lambda: f"<div {pick('footer', 'copyright', 'legal', 'bottom', 'disclaimer')} {no}>{rng.choice(['<p>' + prose() + '</p>', '&copy; ' + words(2, 5), prose()])}</div>",
            lambda: f"<section {pick('comments', 'comment-list', 'discussion', 'responses', 'reviews')} {no}><h2>{words(1, 3)}</h2>{''.join(comment() for _ in range(rng.randint(1, 4)))}</section>",
            lambda: f"<div {pick('comments', 'comments-area', 'commentlist', 'comment', 'replies')} {no}>{''.join(comment() for _ in range(rng.randint(1, 4)))}</div>",
            lambda: f"<ol {pick('commentlist', 'comments')} {no}>{''.join('<li>' + prose() + '</li>' for _ in range(rng.randint(1, 4)))}</ol>",
        ]
        return rng.choice(kinds if within else kinds + 2 * outer)()

    out = []
    for _ in range(count):
        frame = rng.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content"><div class="post">{}</div></div>',
                            '<div class="article-body">{}</div>', '<div class="entry-content">{}</div>', '<section class="story">{}</section>', "<div>{}</div>", "{}", "<section>{}</section>",
                            '<article class="post"><header>{}</header></article>', '<div class="main text">{}</div>', '<article itemprop="articleBody">{}</article>'])
        frame = frame.replace(">{}", ' data-content="1">{}', 1) if ">{}" in frame else '<div data-content="1">{}</div>'
        before = "".join(furniture() for _ in range(rng.randint(0, 4)))
        after = "".join(furniture() for _ in range(rng.randint(0, 4)))
        wrap = rng.choice(["{}"] * 3 + ['<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>', "<div>{}</div>"])
        out.append("<html><body>" + wrap.format(before + frame.format(article()) + after) + "</body></html>")
    return out


def extract(pages: DataFrame, model: TreeModel, source: str = "html", text: str = "text", n_chars: str = "n_chars", group: int = 64) -> DataFrame:
    """All columns of ``pages`` with the main text and its number of code points.

    Null and empty pages, and pages without content, give the empty text. Character references are decoded, white
    space within a block becomes one space, ``br`` counts as white space. Broken or cut-off markup is read as
    browsers do: what is open at the end is closed, a cut-off tag is dropped. ``group`` pages are computed at once.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = [v or "" for v in batch]
            yield pd.Series([t for at in range(0, len(values), group) for t in main_texts(values[at:at + group], sent.value)], dtype=object)

    made, = fresh(pages, "__main")
    return small_batches(pages).withColumn(made, read(F.col(source))).withColumns({text: F.col(made), n_chars: F.length(made).cast("long")}).drop(made)


@query("op2_html_extraction")
def op2_html_extraction(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, train(labelled_pages())).select("page_id", "url", "text", "n_chars")
