"""Main-text extraction with a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has binary features: its tag, its
ancestors' tags and the words of their class, id and role attributes, and properties of its text (length, share of
link text, punctuation, place). A chain over the blocks with two labels (content or not) is trained by maximum
likelihood and decoded by Viterbi; the text is the content blocks, joined by line feeds in page order.

Labelled pages: pages with an article or main element label themselves, as what stands inside it, less what stands in
inner navigation, asides, footers, forms, adverts and comments. So that the chain rests neither on that one tag nor on the
layout of these pages, each such page is also rewritten: its blocks stand in lists, tables, quotes, definition lists,
preformatted text and headings under other containers, and menus, side bars, notices, adverts, forms and comments stand
around and between them, made of the words of other pages. Attribute words of the nearest elements are features apart
from those farther up; those of html and body are none.

Defined results: a null or empty page has an empty text. Unclosed and stray tags are tolerated. Repeated rows are
extracted alike. Character references are decoded, white space in a block becomes one space, blocks without text are
dropped. Without any self-labelling page, the tags named above decide alone.
"""

from __future__ import annotations

import html as html_lib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import small_batches, table

# Tags by kind.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template svg iframe head title canvas".split())
RAW_TEXT_TAGS = frozenset("script style iframe title".split())  # without an end tag they go on to the page's end
CLOSED_BY_SAME = {"p": ("p",), "li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
CLOSE_PARAGRAPH = BLOCK_TAGS - {"button", "label", "option", "body", "html"}
# Words of class, id and role attributes that are features, those of other blocks by kind, with their tags.
CONTENT_WORDS = "article body content entry main page post story text".split()
BOILER = {
    "menu": ("nav ul div", "bar breadcrumb breadcrumbs links menu nav navbar navigation pager pagination tags toolbar"),
    "header": ("header div", "banner brand head header login logo masthead pagetop top"),
    "footer": ("footer div", "bottom contentinfo copyright foot footer legal"),
    "side": ("aside div section", "author meta popular recommended related side sidebar teaser widget"),
    "notice": ("div section", "alert consent cookie cookies gdpr modal notice notification popup"),
    "advert": ("div aside", "ad ads advert advertisement promo sponsor sponsored"),
    "form": ("form div", "form newsletter search share sharing signup social subscribe"),
    "comments": ("section div ol ul", "comment comments discussion disqus replies reply respond response responses"),
}
BOILER_WORDS = sorted({w for _, words in BOILER.values() for w in words.split()})
ATTRIBUTE_WORDS = frozenset(CONTENT_WORDS) | frozenset(BOILER_WORDS)
NEAR = 3  # elements, from the block's own upwards, whose attribute words are features apart from those farther up

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[str, ...]  # features of the ancestors and the block's own element
    linked: int  # characters of link text


class Path(tuple):
    """(tags and attribute words of all elements down to one, attribute words of the nearest NEAR elements)."""

    __slots__ = ()

    @property
    def features(self) -> tuple[str, ...]:
        return self[0] + tuple(sorted({f"near:{w}" for words in self[1] for w in words}))


ROOT = Path(((), ()))
_PATHS: dict[tuple, Path] = {}


def _path(parent: Path, tag: str, attributes: str) -> Path:
    # Attributes of the root elements describe the whole page, not a part of it.
    key = (parent, tag, attributes if "=" in attributes and tag not in ("html", "body") else "")
    found = _PATHS.get(key)
    if found is None:
        words = {w for _, value in ATTRIBUTE.findall(key[2]) for w in WORD.findall(CAMEL.sub(r"\1 \2", value).lower())} & ATTRIBUTE_WORDS
        far = {f"in:{tag}", *(f"at:{w}" for w in words)}.union(parent[0])
        found = Path((tuple(sorted(far)), (*parent[1], tuple(sorted(words)))[-NEAR:]))
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[key] = found
    return found


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text of a page."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, Path]] = [("html", ROOT)]
    parts: list[str] = []
    unclosed: set[str] = set()  # skipped elements that have no end tag from here on
    linked, links, position, end = 0, 0, 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it, so none is looked for there

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][0], stack[-1][1].features, min(linked, len(text))))
            parts.clear()
        linked = 0

    while position < end:
        m = TOKEN.search(page, position, last) if position < last else None
        until = m.start() if m else end
        if not m and (comment := page.find("<!--", position)) >= 0:
            until = comment  # without an end, it goes on to the page's
        if until > position:
            parts.append(page[position:until])
            if links:
                linked += until - position
        if not m:
            break
        position = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                flush()
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    del stack[depth:]
            continue
        attributes = m[3]
        if tag in SKIPPED_TAGS:
            if attributes.endswith("/"):
                continue
            if tag in unclosed:
                continue
            close = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body)", re.I).search(page, position)
            if close:
                position = close.end()
            elif tag in RAW_TEXT_TAGS:
                break
            else:
                unclosed.add(tag)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if tag in CLOSE_PARAGRAPH and stack[-1][0] == "p":
                stack.pop()
            for same in CLOSED_BY_SAME.get(tag, ()):
                if stack[-1][0] == same:
                    stack.pop()
                    break
            if tag not in VOID_TAGS:
                stack.append((tag, _path(stack[-1][1], tag, attributes)))
        elif tag == "img" or tag == "input":
            parts.append(" ")
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(found):
        size, words = len(b.text), b.text.count(" ") + 1
        marks = b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?")
        own = [
            "bias", f"tag:{b.tag}", *b.path, f"words:{min(int(np.log2(words)), 8)}", f"links:{(4 * b.linked + size - 1) // size if size else 0}",
            f"marks:{min(4, 20 * marks // words)}", f"from:{min(i, 4)}", f"to:{min(len(found) - 1 - i, 4)}", f"stop:{b.text[-1] in '.!?…:;'}",
            f"first:{'upper' if b.text[0].isupper() else 'other'}",
        ]
        if "©" in b.text:
            own.append("copyright")
        out.append(own)
    return out


@dataclass
class Chain:
    names: dict[str, int]
    emit: np.ndarray  # [features, 2]
    move: np.ndarray  # [2, 2]

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.names.get
        return np.array([self.emit[[j for f in row if (j := get(f)) is not None]].sum(0) for row in rows]).reshape(-1, 2)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The most probable labels of one page (Viterbi)."""
        n = len(scores)
        best, back = scores[0].copy(), np.zeros((n, 2), np.int64)
        for t in range(1, n):
            through = best[:, None] + self.move
            back[t] = through.argmax(0)
            best = through.max(0) + scores[t]
        labels = np.zeros(n, np.int64)
        labels[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Chain:
    """Maximum likelihood by forward and backward passes over all pages together, with Adam steps."""
    # Longest first: the pages that reach a place are then the first ones, and places follow each other in flat arrays.
    pages = sorted((p for p in pages if p[1]), key=lambda p: -len(p[1]))
    names: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                names.setdefault(f, len(names))
    count = len(pages)
    distinct: dict[tuple[str, ...], int] = {}  # blocks with equal features are scored once
    kind, y, starts = [], [], [0]
    for t in range(len(pages[0][1])):
        for rows, labels in itertools.takewhile(lambda p: len(p[1]) > t, pages):
            kind.append(distinct.setdefault(tuple(rows[t]), len(distinct)))
            y.append(labels[t])
        starts.append(len(y))
    kind, y = np.array(kind), np.array(y)
    later = np.arange(starts[1], len(y))
    earlier = np.concatenate([np.arange(starts[t - 1], starts[t - 1] + starts[t + 1] - starts[t]) for t in range(1, len(starts) - 1)] or [later])
    final = np.ones(len(y), bool)
    final[earlier] = False  # the last block of each page
    cell = np.repeat(np.arange(len(distinct)), [len(row) for row in distinct])
    ids = np.array([names[f] for row in distinct for f in row])
    gold = np.eye(2)[y]
    gold_move = np.bincount(2 * y[earlier] + y[later], minlength=4).reshape(2, 2)
    # The page of each block, by its place among those of equal rank.
    page = np.concatenate([np.arange(starts[t + 1] - starts[t]) for t in range(len(starts) - 1)])
    emit, move = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, steps + 1):
        s = np.stack([np.bincount(cell, weights=emit[ids, k], minlength=len(distinct)) for k in (0, 1)], 1)[kind]
        alpha, beta = s.copy(), np.zeros_like(s)
        for t in range(1, len(starts) - 1):
            before = alpha[starts[t - 1] : starts[t - 1] + starts[t + 1] - starts[t]]
            alpha[starts[t] : starts[t + 1]] += np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
        for t in range(len(starts) - 2, 0, -1):
            after = s[starts[t] : starts[t + 1]] + beta[starts[t] : starts[t + 1]]
            beta[starts[t - 1] : starts[t - 1] + len(after)] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
        total = np.empty(count)
        total[page[final]] = np.logaddexp(alpha[final, 0], alpha[final, 1])
        off = np.exp(alpha + beta - total[page][:, None]) - gold
        joint = np.exp(alpha[earlier][:, :, None] + move + (s + beta)[later][:, None, :] - total[page[later]][:, None, None])
        off = np.stack([np.bincount(kind, weights=off[:, k], minlength=len(distinct)) for k in (0, 1)], 1)[cell]
        down = np.stack([np.bincount(ids, weights=off[:, k], minlength=len(names)) for k in (0, 1)], 1) / count + ridge * emit
        down_move = (joint.sum(0) - gold_move) / count + ridge * move
        for value, gradient, i in ((emit, down, 0), (move, down_move, 2)):
            state[i] = 0.9 * state[i] + 0.1 * gradient
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * gradient**2
            value -= rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.999**step)) + 1e-8)
    return Chain(names, emit, move)


EXCLUDED = frozenset({"in:nav", "in:aside", "in:footer", "in:form", *(f"at:{w}" for w in BOILER_WORDS)})


def own_labels(found: list[Block]) -> list[int] | None:
    """Labels of a page with an article or main element; None for other pages."""
    inside = [("in:article" in b.path or "in:main" in b.path) for b in found]
    if not any(inside):
        return None
    return [int(ok and not EXCLUDED.intersection(b.path)) for ok, b in zip(inside, found)]


# Containers for rewritten pages, as (tag, attributes), and forms of content in them, as (outer tags, tags of the
# blocks, least and most words of a block).
CONTENT_PLACES = [("div", 'class="content"'), ("div", 'class="post"'), ("div", 'id="main"'), ("section", 'class="article-body"'), ("div", 'class="entry-content"'), ("div", ""), ("main", ""), ("article", ""), ("div", 'class="story"'), ("div", 'class="page"'), ("div", 'class="text"'), ("body", "")]
CONTENT_FORMS = [
    ("ul", "li", 1, 15), ("ol", "li", 1, 15), ("ul li", "p", 3, 40), ("table tbody tr", "td th", 1, 6), ("table tr", "td th", 1, 6),
    ("table tbody tr td", "p", 1, 30), ("dl", "dt dd", 1, 20), ("", "pre", 3, 100), ("figure", "pre figcaption", 2, 60),
    ("", "blockquote", 5, 60), ("blockquote", "p", 5, 60), ("", "h2 h3 h4 h5", 1, 9), ("", "div", 3, 100), ("div", "div", 3, 60),
    ("section", "h2 h3 p", 2, 60), ("details", "summary p", 2, 40), ("section", "address center", 2, 30),
]
WRAPPERS = [("div", 'class="has-sidebar"'), ("div", 'class="sticky-header"'), ("div", 'id="page-top"'), ("div", 'class="with-nav"'), ("div", 'class="wrap"')]


def rewritten(found: list[Block], labels: list[int], words: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A labelled page with its content blocks in other forms under another container, and with other blocks around and between
    them; one of 20 is left without content."""
    out, marks = [], []

    def put(parent: Path, tag: str, text: str, label: int, linked: bool = False) -> None:
        path = parent if tag == "" else _path(parent, tag, "")
        out.append(Block(text, tag, path.features, len(text) if linked else 0))
        marks.append(label)

    def prose(low: int, high: int) -> str:
        start = rng.randrange(max(1, len(words) - high))
        text = " ".join(words[start : start + rng.randint(low, high)])
        return text[:1].upper() + text[1:] if rng.random() < 0.5 else text

    def down(path: Path, tags: str) -> Path:
        for tag in tags.split():
            path = _path(path, tag, "")
        return path

    def extra(kind: str, parent: Path) -> None:
        tags, names = BOILER[kind]
        tag = rng.choice(tags.split())
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 or kind == "menu" and rng.random() < 0.2
        path = _path(parent, tag, "" if bare else f'{rng.choice(["class", "id", "role"])}="{rng.choice(names.split())}"')
        # What stands deeper in such an element belongs to it, too.
        inside = down(path, rng.choice(["", "", "", "div", "ul", "ol li", "div div", "ul li div", "table tr"]))
        many = kind in ("menu", "side", "comments", "form")
        if many and rng.random() < 0.4:
            put(path, rng.choice(["h2", "h3", "h4", "p"]), prose(1, 4), 0)
        for _ in range(rng.randint(1, 5 if many else 2)):
            long = kind in ("comments", "side", "notice", "advert", "form") and rng.random() < 0.6
            text = prose(6, 60) if long else prose(1, 6)
            link = kind in ("menu", "side") and rng.random() < 0.8 or kind == "footer" and rng.random() < 0.4
            inner = rng.choice("label button option p div".split() if kind == "form" else "li p p div div blockquote".split())
            put(inside, inner if rng.random() < 0.8 else rng.choice(["p", "div"]), f"© {text}" if kind == "footer" and rng.random() < 0.5 else text, 0, link)

    def content(b: Block, parent: Path) -> None:
        if rng.random() < 0.4:
            put(parent, b.tag if b.tag not in ("article", "main", "body", "html") else "p", b.text, 1)
            return
        outer, tags, low, high = rng.choice(CONTENT_FORMS)
        parent, parts, at = down(parent, outer), b.text.split(), 0
        for _ in range(8):
            size = rng.randint(low, high)
            text = " ".join(parts[at : at + size]) if rng.random() < 0.9 else str(rng.randint(0, 9999))
            if not text:
                break
            put(parent, rng.choice(tags.split()), text, 1, rng.random() < 0.05)
            at += size

    body = down(ROOT, "body")
    if rng.random() < 0.15:
        body = _path(body, *rng.choice(WRAPPERS))
    for kind in ("notice", "menu", "header", "advert"):
        if rng.random() < 0.6:
            extra(kind, body)
    inner = body
    if rng.random() < 0.95:
        tag, attributes = rng.choice(CONTENT_PLACES)
        place = inner = body if tag == "body" else _path(body, tag, attributes)
        kept = [b for b, label in zip(found, labels) if label]
        for i, b in enumerate(kept):
            content(b, place)
            if rng.random() < 0.25 and i + 1 < len(kept):
                extra(rng.choice(["advert", "notice", "form", "side", "menu", "comments"]), place)
    for kind in rng.sample(["comments", "form", "side", "notice"], 4):
        if rng.random() < 0.4:
            extra(kind, inner if rng.random() < 0.6 else body)
    if rng.random() < 0.8:
        extra("footer", body)
    return out, marks


#: Characters of a page that the chain is trained on, at most.
LONGEST = 200_000


def train(pages: DataFrame, sample: int = 300, variants: int = 3, seed: int = 11) -> Chain | None:
    """Fit on up to `sample` different self-labelled pages of up to LONGEST characters (documented bounds), the least by a
    hash of the page, and their rewrites."""
    marked = pages.where((F.length("html") <= LONGEST) & F.col("html").rlike("(?i)<(article|main)[ >]")).select("html", F.xxhash64("html").alias("h"))
    # The hashes alone are sorted; copies of a page count once.
    chosen = marked.select("h").distinct().orderBy("h").limit(sample).collect()
    held = pages.sparkSession.createDataFrame([(r["h"],) for r in chosen], "h long")
    found = marked.join(F.broadcast(held), "h").groupBy("h").agg(F.min("html").alias("html"))
    texts = [r["html"] for r in sorted(found.collect(), key=lambda r: r["h"])]
    rng = random.Random(seed)
    found = [(b, y) for b in map(blocks, texts) if b and (y := own_labels(b)) and any(y)]
    if not found:
        return None
    words = [w for b, _ in found for block in b for w in block.text.split()]
    labelled = found + [rewritten(b, y, words, rng) for b, y in found for _ in range(variants)]
    return fit([(features(b), list(y)) for b, y in labelled])


def main_text(page: str | None, chain: Chain | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    if chain is None:
        labels = own_labels(found) or [int(not EXCLUDED.intersection(b.path)) for b in found]
    else:
        labels = chain.decode(chain.scores(features(found)))
    return "\n".join(b.text for b, y in zip(found, labels) if y)


def extract(pages: DataFrame, chain: Chain | None) -> DataFrame:
    """All columns of `pages` but html, with `text` and `n_chars`, replacing columns of these names."""
    pages = pages.drop("text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # as many weights as there are feature names: fixed lists
    kept = [f for f in pages.schema.fields if f.name != "html"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h if isinstance(h, str) else None, shared.value) for h in batch["html"]]
            yield batch.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.mapInPandas(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), train(pages))
