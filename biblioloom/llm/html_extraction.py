"""Operator 4, HTML extraction by a tree-structured graphical model.

A tolerant parser turns a page into a tree of block elements; inline elements only add text. Every
block is a binary variable, *content* or not. Node potentials weigh its tag, cues in its class, id
and role, the length of its own text and the share of links; edge potentials, one table for each
kind of child, tie parent and child. Sum-product messages go up to the root and down again, which
gives the exact marginals of a tree; blocks of marginal ``THRESHOLD`` and more are content.

Weights are trained by maximum likelihood (the same messages give the expected features) on
labelled pages made by ``labelled_pages``: articles in many layouts with menus, site headers,
footers, sidebars, notices, adverts, forms and reader comments around them.

Heads, scripts, styles, what stands in for them or for frames, and comments never hold text; the text of
formulas and drawings does. Attributes are read as browsers do. Character references are decoded, white space
inside a block becomes one space, blocks are joined in page order by one space; nothing is capped.

Defined results: null or empty html gives an empty text; broken markup (unclosed or cut tags,
stray ends) is read as a browser would, roughly; repeated rows are extracted each; null ids and
urls stay null; deep nesting needs no recursion.
"""

from __future__ import annotations

import html as entities
import random
import re
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.common import small_batches

THRESHOLD = 0.5
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

# Elements by their role in the tree.
RAW = frozenset("script style noscript template iframe noembed noframes title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var label svg math g text tspan textpath path circle ellipse rect line polygon polyline defs use symbol desc"
    " mi mo mn ms mrow msup msub msubsup mfrac msqrt mroot mtext mstyle mspace mover munder munderover mtable mtr mtd semantics annotation".split()
)
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary address".split())
SPECIAL = frozenset("nav aside footer header form menu dialog button select fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu"
    " nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
TAGS = (
    "p h1 h2 h3 h4 h5 h6 li ul ol div section article main nav aside footer header form table tr td blockquote pre figure button"
    " body html dl dt dd"
).split()
CUES = (
    "nav menu breadcrumb breadcrumbs pagination toc",
    "header masthead logo topbar tagline branding",
    "footer colophon copyright legal",
    "sidebar side aside widget related recommended popular trending",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "cookie cookies consent notice alert popup modal newsletter subscribe gdpr message",
    "comment comments reply replies respond discussion disqus",
    "form login search signup contact",
    "share social tags meta byline author date",
    "article content main post entry story body text page",
)
CUE_OF = {w: k for k, words in enumerate(CUES) for w in words.split()}
TAG_OF = {t: k for k, t in enumerate(TAGS)}
LENGTHS, LINKS = (1, 25, 80, 200), (0.01, 0.4, 0.8)
BASE = len(TAGS) + 1
N_FEATURES = BASE + len(CUES) + len(LENGTHS) + 1 + len(LINKS) + 1 + 1
N_EDGES = 3

#: Quotes hold a value only after ``=``; elsewhere, and where none closes them, they are characters like others.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)*+)>")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORDS = re.compile(r"[a-z]+")
XMP_END = re.compile(r"</xmp[^>]*>", re.I)
MARK = "data-y="


def marked(block: Block, attributes: str) -> None:
    """The label of a page made for training (``labelled_pages``)."""
    at = attributes.find(MARK)
    if at >= 0:
        block.label = int(attributes[at + len(MARK) + 1] == "1")


class Block:
    __slots__ = ("tag", "parent", "cues", "chars", "links", "label", "last")

    def __init__(self, tag: str, parent: int, names: str):
        self.tag, self.parent = tag, parent
        self.cues = {CUE_OF[w] for w in WORDS.findall(names.lower()) if w in CUE_OF} if names else ()
        self.chars = self.links = 0
        self.label = None
        self.last = ""


def parse(page: str, told=None) -> tuple[list[Block], list[list]]:
    """Blocks in page order (parents first), and [block, text] segments in page order.

    ``told`` (block, attributes as they stand) sees every block; training reads its labels by it.
    """
    blocks, stack, segments = [Block("#root", -1, "")], [0], []
    at, n, in_link, fresh = 0, len(page), 0, True

    def add(text: str) -> None:
        nonlocal fresh
        if not text:
            return
        own = stack[-1]
        if fresh or not segments or segments[-1][0] != own:
            segments.append([own, []])
            fresh = False
        segments[-1][1].append(text)
        if in_link:
            blocks[own].links += len(text.strip())

    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            add(entities.unescape(page[at:]))
            break
        if open_at > at:
            add(entities.unescape(page[at:open_at]))
        nxt = page[open_at + 1 : open_at + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", open_at):
                end = page.find("-->", open_at + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", open_at)
                at = n if end < 0 else end + 1
            continue
        if not (nxt.isalpha() or nxt == "/" and page[open_at + 2 : open_at + 3].isalpha()):
            add("<")
            at = open_at + 1
            continue
        m = TAG.match(page, open_at)
        if not m:  # the page ends inside a tag
            break
        at, closing, tag = m.end(), m.group(1), m.group(2).lower()
        if closing:
            if tag == "a":
                in_link = 0
            elif tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if blocks[stack[k]].tag == tag:
                        del stack[k:]
                        break
                fresh = True
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
            if end:
                at = end.end() if end.group()[1] == "/" else end.start()
            continue
        if tag == "xmp":  # text as it stands
            end = XMP_END.search(page, at)
            fresh = True
            add(page[at : end.start()] if end else page[at:])
            at, fresh = end.end() if end else n, True
            continue
        if tag in RAW:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = n if not end else max(page.find(">", end.start()) + 1, end.end())
            fresh = True
            continue
        if tag == "br" or tag == "wbr" or tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                fresh = True
            continue
        if tag in INLINE:
            in_link = in_link or tag == "a"
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "td", "th", "tr"):
            for k in range(len(stack) - 1, 0, -1):
                own = blocks[stack[k]].tag
                if own == "p":
                    del stack[k:]
                    break
                if own not in TEXTS:
                    break
        if tag in SIBLINGS:
            stops = SIBLINGS[tag]
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            for k in range(len(stack) - 1, 0, -1):
                own = blocks[stack[k]].tag
                if own in same:
                    del stack[k:]
                    break
                if own in stops or own in ("table", "div", "section"):
                    break
        found = m.group(3)
        names = " ".join(x or y or z for x, y, z in NAMES.findall(found)) if found and not found.isspace() else ""
        blocks.append(Block(tag, stack[-1], names))
        if told is not None:
            told(blocks[-1], found)
        stack.append(len(blocks) - 1)
        fresh, in_link = True, 0
    out = []
    for own, parts in segments:
        text = " ".join("".join(parts).split())
        if text:
            blocks[own].chars += len(text)
            blocks[own].last = text[-1]
            out.append([own, text])
    return blocks, out


def edge_kind(tag: str) -> int:
    return 2 if tag in ("td", "th") else 0 if tag in TEXTS else 1 if tag in SPECIAL else 2


def features(blocks: list[Block]) -> list[list[int]]:
    """Indices of the features that hold for each block."""
    chars, links = [b.chars for b in blocks], [b.links for b in blocks]
    for i in range(len(blocks) - 1, 0, -1):
        chars[blocks[i].parent] += chars[i]
        links[blocks[i].parent] += links[i]
    out = []
    for i, b in enumerate(blocks):
        found = [TAG_OF.get(b.tag, BASE - 1)]
        found += [BASE + c for c in b.cues]
        at = BASE + len(CUES)
        found.append(at + sum(b.chars >= e for e in LENGTHS))
        at += len(LENGTHS) + 1
        share = links[i] / chars[i] if chars[i] else 0.0
        found.append(at + sum(share >= e for e in LINKS))
        if b.last and b.last in ".!?…:”\"":
            found.append(N_FEATURES - 1)
        out.append(found)
    return out


def beliefs(blocks: list[Block], found: list[list[int]], node: list, edge: list) -> tuple[list[float], list]:
    """Marginals of content, and for each child the joint marginals with its parent (row: parent)."""
    n = len(blocks)
    up = [[1.0, 1.0] for _ in range(n)]
    sent = [(1.0, 1.0)] * n
    for i in range(n):
        s = 0.0
        for f in found[i]:
            s += node[f]
        s = min(max(s, -30.0), 30.0)
        up[i][1] = exp(s)
    kinds = [edge_kind(b.tag) for b in blocks]
    for i in range(n - 1, 0, -1):
        e, (u0, u1) = edge[kinds[i]], up[i]
        m0, m1 = e[0][0] * u0 + e[0][1] * u1, e[1][0] * u0 + e[1][1] * u1
        z = m0 + m1
        sent[i] = (m0 / z, m1 / z)
        p = up[blocks[i].parent]
        p[0] *= m0 / z
        p[1] *= m1 / z
        z = p[0] + p[1]
        p[0] /= z
        p[1] /= z
    down = [(1.0, 1.0)] * n
    marginal = [up[0][1] / (up[0][0] + up[0][1])] + [0.0] * (n - 1)
    pairs = [None] * n
    for i in range(1, n):
        p = blocks[i].parent
        a0 = up[p][0] * down[p][0] / max(sent[i][0], 1e-300)
        a1 = up[p][1] * down[p][1] / max(sent[i][1], 1e-300)
        e, (u0, u1) = edge[kinds[i]], up[i]
        j = (a0 * e[0][0] * u0, a0 * e[0][1] * u1, a1 * e[1][0] * u0, a1 * e[1][1] * u1)
        z = sum(j) or 1.0
        j = tuple(x / z for x in j)
        pairs[i] = j
        marginal[i] = j[1] + j[3]
        d0, d1 = a0 * e[0][0] + a1 * e[1][0], a0 * e[0][1] + a1 * e[1][1]
        z = d0 + d1 or 1.0
        down[i] = (d0 / z, d1 / z)
    return marginal, pairs


def train(pages: list[str], rounds: int = 90, rate: float = 0.4, shrink: float = 3e-4) -> tuple[list, list]:
    """Maximum-likelihood node weights and edge tables from pages whose blocks carry labels."""
    data = []
    for page in pages:
        blocks, _ = parse(page, marked)
        gold = [b.label for b in blocks]
        size, good = [0] * len(blocks), [0] * len(blocks)
        for i in range(len(blocks) - 1, -1, -1):
            if gold[i] is None and blocks[i].chars and blocks[i].parent >= 0:
                k = blocks[i].parent
                while k > 0 and gold[k] is None:
                    k = blocks[k].parent
                gold[i] = gold[k] or 0
            size[i] += blocks[i].chars
            good[i] += blocks[i].chars * (gold[i] or 0)
            if i:
                size[blocks[i].parent] += size[i]
                good[blocks[i].parent] += good[i]
        gold = [int(2 * g > s) if y is None else y for y, g, s in zip(gold, good, size, strict=True)]
        data.append((blocks, features(blocks), gold))
    node, edge = np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2))
    g2n, g2e = np.full(N_FEATURES, 1e-8), np.full((N_EDGES, 2, 2), 1e-8)
    total = sum(len(b) for b, _, _ in data)
    for _ in range(rounds):
        gn, ge = -shrink * node, -shrink * edge
        tables = np.exp(edge).tolist()
        for blocks, found, gold in data:
            marginal, pairs = beliefs(blocks, found, node.tolist(), tables)
            for i, b in enumerate(blocks):
                miss = (gold[i] - marginal[i]) / total
                for f in found[i]:
                    gn[f] += miss
                if i:
                    k, j = edge_kind(b.tag), pairs[i]
                    ge[k, gold[b.parent], gold[i]] += 1 / total
                    ge[k] -= np.array(j).reshape(2, 2) / total
        g2n += gn**2
        g2e += ge**2
        node += rate * gn / np.sqrt(g2n)
        edge += rate * ge / np.sqrt(g2e)
    return node.tolist(), np.exp(edge).tolist()


def labelled_pages(n: int = 320, seed: int = 5) -> list[str]:
    """Pages with labels (``data-y``), made from layouts and invented words."""
    r = random.Random(seed)
    syllables = "an ba ce di el fo ga hi in jo ka le mo nu or pe qui ra se ti un ve wa xi yo za".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + "."
    text = lambda a=1, b=5: " ".join(sentence() for _ in range(r.randint(a, b)))
    pick = r.choice

    def attrs(names: list[str]) -> str:
        return pick((f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{word()} {pick(names)}"'))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def menu() -> str:
        inner = f"<ul>{links(r.randint(2, 9))}</ul>"
        return pick((f'<nav data-y="0">{inner}</nav>', f'<div data-y="0"{attrs(["menu", "nav", "breadcrumb"])}>{inner}</div>'))

    def top() -> str:
        inner = pick((f"<h1>{words(1, 3)}</h1><p>{words(2, 6)}</p>", f'<a href="/">{words(1, 3)}</a>{menu()}', f"<h2>{words(1, 3)}</h2>"))
        return pick((f'<header data-y="0">{inner}</header>', f'<div data-y="0"{attrs(["header", "masthead", "topbar", "logo"])}>{inner}</div>'))

    def bottom() -> str:
        inner = pick((f"&copy; {words(1, 2)} &middot; {sentence()}", f"<p>{text(1, 2)}</p><ul>{links(3)}</ul>", f"<p>Copyright {words(1, 3)}</p>"))
        return pick((f'<footer data-y="0">{inner}</footer>', f'<div data-y="0"{attrs(["footer", "colophon", "legal"])}>{inner}</div>'))

    def side() -> str:
        inner = pick((f"<h3>{words(1, 3)}</h3><ul>{links(5)}</ul>", f"<p>{text(1, 3)}</p>", f"<h2>{words(1, 2)}</h2><p>{text(1, 2)}</p>"))
        return pick((f'<aside data-y="0">{inner}</aside>', f'<div data-y="0"{attrs(["sidebar", "widget", "related", "side"])}>{inner}</div>'))

    def advert() -> str:
        inner = pick((text(1, 2), f"<p>{text(1, 3)}</p>", f'<a href="/x">{words(2, 5)}</a>'))
        return f'<div data-y="0"{attrs(["ad", "ads", "advert", "promo", "sponsored", "banner"])}>{inner}</div>'

    def notice() -> str:
        inner = pick((f"<p>{text(1, 3)}</p><button>{words(1, 2)}</button>", text(1, 2)))
        return f'<{(t := pick(("div", "section")))} data-y="0"{attrs(["cookie", "notice", "consent", "alert", "newsletter", "popup"])}>{inner}</{t}>'

    def form() -> str:
        return f'<form data-y="0"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button><p>{sentence()}</p></form>'

    def comments() -> str:
        inner = "".join(f"<{pick(('div', 'li', 'div', 'li', 'article'))} data-y=\"0\"{attrs(['comment', 'reply'])}><p>{text(1, 3)}</p>" for _ in range(r.randint(1, 4)))
        return f'<{(t := pick(("section", "div", "ol")))} data-y="0"{attrs(["comments", "discussion", "replies"])}><h3>{words(1, 2)}</h3>{inner}</{t}>'

    def body() -> str:
        parts = [f"<{(h := pick(('h1', 'h1', 'h2')))}>{pick((words(2, 12), sentence()))}</{h}>"]
        if r.random() < 0.2:
            parts = [f'<header data-y="1">{parts[0]}</header>']
        odd = r.random()
        if odd < 0.1:
            return parts[0]
        if odd > 0.8:  # many very short paragraphs
            short = lambda: pick((sentence(1, 3), words(1, 3), word()))
            parts += [f"<p>{short() if r.random() < 0.85 else text(1, 6)}</p>" for _ in range(r.randint(5, 50))]
            return "".join(parts)
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if odd >= 0.25 and r.random() < 0.06:  # text without a paragraph of its own
                parts.append(f"<div>{pick((text(1, 2), sentence(), words(2, 8)))}</div>")
            elif odd < 0.25:  # without sentences: junk, lists of words, one word over and over
                parts.append(f"<p>{pick((words(1, 60), f'{word()} ' * r.randint(5, 80), ' | '.join(words(5, 60).split()), '*** '.join(words(5, 60).split())))}</p>")
            elif kind < 0.78:
                parts.append(pick((f"<p>{text(1, 6)}</p>", f"<p>{word()}.</p>", f"<p><b>{sentence()}<br><p>{text()}</p>", f"<p>{text(1, 2)}")))
            elif kind < 0.86:
                parts.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.92:
                parts.append("<ul>" + "".join(f"<li>{text(1, 2)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.935:
                parts.append(f"<blockquote><p>{text(1, 2)}</p></blockquote>")
            elif kind < 0.95:
                parts.append(pick((f"<div>{pick((text(1, 2), words(2, 5)))}</div>", f"<pre>{words(2, 20)}</pre>", f"<figure><figcaption>{sentence()}</figcaption></figure>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>")))
            else:
                parts.append(pick((advert, side, notice))())
        return "".join(parts)

    pages = []
    for _ in range(n):
        inner = body()
        article = pick(
            (
                f'<article data-y="1">{inner}</article>', f'<article data-y="1">{inner}</article>', f'<main data-y="1">{inner}</main>',
                f'<main><article data-y="1">{inner}</article></main>', f'<div data-y="1"{attrs(["content", "post", "entry", "story", "main"])}>{inner}</div>',
                f'<section data-y="1"{attrs(["article", "content", "post"])}>{inner}</section>',
            )
        )
        before = [f() for f in (menu, top, advert, notice, form, side) if r.random() < 0.45]
        after = [f() for f in (side, comments, form, advert, bottom, menu) if r.random() < 0.45]
        bare = r.random() < 0.12  # the article's blocks stand in the body itself
        r.shuffle(before)
        r.shuffle(after)
        middle = inner if bare else article
        if r.random() < 0.3 and not bare:
            middle = f'<div class="{pick(("wrapper", "container", "layout"))}">{article}{side() if r.random() < 0.5 else ""}</div>'
        if r.random() < 0.2 and not bare:  # tables that hold the page together, mostly without telling names
            cell = lambda y, x, names: f'<td data-y="{y}"{attrs(names) if r.random() < 0.5 else ""}>{x}</td>'
            flat = "<br>".join(f'<a href="/{word()}">{words(1, 2)}</a>' for _ in range(r.randint(2, 8)))
            cells = [cell(0, flat, ["nav", "menu"]), cell(1, inner, ["content", "main"])]
            middle = f"<table><tr>{''.join(cells)}</tr><tr>{cell(0, 'Copyright ' + words(2, 4), ['footer', 'legal'])}</tr></table>"
        pages.append(f"<html><body{' data-y=\"1\"' if bare else ''}>" + "".join([*before, middle, *after]) + pick(("</body></html>", "")))
    return pages


def extract(page: str | None, node: list, edge: list) -> str:
    blocks, segments = parse(page or "")
    if not segments:
        return ""
    marginal, _ = beliefs(blocks, features(blocks), node, edge)
    return " ".join(text for own, text in segments if marginal[own] >= THRESHOLD)


def extract_pages(pages: DataFrame, model: tuple[list, list]) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    small_batches(pages.sparkSession)
    node, edge = model

    def work(batches):
        for batch in batches:
            texts = [extract(h, node, edge) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kept = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return kept.mapInArrow(work, SCHEMA)
