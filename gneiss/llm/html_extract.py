"""HTML extraction: a chain over the leaf blocks of a page, trained on labelled pages and decoded by Viterbi."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, slices, small_batches
from .crf import Chain, fit
from .dom import Block, leaf_blocks

TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table", "p", "blockquote", "pre", "figure", "dialog", "address", "section")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TERMS = (
    frozenset("article content post entry story body text prose main articlebody".split()),
    frozenset("nav navbar menu navigation breadcrumb breadcrumbs crumbs topbar toolbar tabs pagination pager toc".split()),
    frozenset("footer foot copyright legal colophon contentinfo".split()),
    frozenset("header masthead head banner logo branding".split()),
    frozenset("sidebar side aside widget rail complementary related recommended trending popular".split()),
    frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion promoted commercial".split()),
    frozenset("comment comments reply replies discussion disqus respond feedback commentlist".split()),
    frozenset("cookie cookies consent notice notices alert gdpr popup modal overlay dialog message warning banner".split()),
    frozenset("form search subscribe newsletter signup login signin".split()),
    frozenset("share sharing social follow tags tag meta byline author".split()),
)
#: Parts of compound names that say nothing about the kind of a block.
NEUTRAL = frozenset("area box block bottom column container content group inner item items left list main outer page panel right row section site slot small top unit wrap wrapper".split())
KNOWN = NEUTRAL.union(*TERMS)
WIDTH = 2 + len(TAGS) + 2 * len(TERMS) + 7


@lru_cache(100_000)
def term_groups(name: str) -> frozenset[int]:
    """The groups of TERMS that a class name or id stands for.

    A compound counts only if all its parts are known: ``ad-1`` and ``site-footer`` do, ``side-effects`` and ``ad-hoc``
    are names of something else.
    """
    parts = [p for p in re.findall(r"[a-z]+|[^\W\d_a-z]+", name)]
    if not parts or not KNOWN.issuperset(parts):
        return frozenset()
    return frozenset(g for g, group in enumerate(TERMS) if not group.isdisjoint(parts))


def block_features(blocks: list[Block]) -> np.ndarray:
    """Ancestor tags, class names and ids, then length, links, ending and symbols."""
    out = np.zeros((len(blocks), WIDTH))
    named = 2 + len(TAGS)
    for i, b in enumerate(blocks):
        tags = frozenset(b.tags)
        words = b.text.count(" ") + 1
        row = out[i]
        row[:2] = 1.0, not tags.isdisjoint(HEADINGS)
        row[2:named] = [t in tags for t in TAGS]
        for shift, names in ((named, b.terms), (named + len(TERMS), b.ids)):
            for name in names:
                for g in term_groups(name):
                    row[shift + g] = 1.0
        row[-7:] = min(np.log1p(words), 6.0) / 6.0, words <= 3, words >= 25, b.linked, b.linked > 0.6, b.text[-1:] in ".!?\"'”»。", "©" in b.text or "·" in b.text
    return out


def practice_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Labelled pages made up for training: varied layouts, each block marked as article or not.

    Labels come from the part of the page that wrote the block, not from names: on some pages all names are
    meaningless, and sections of articles have ids that elsewhere name boilerplate.
    """
    rng = random.Random(seed)

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrstmd") for _ in range(rng.randint(2, 9))) for _ in range(n))

    def sentence(n: int) -> str:
        return words(n).capitalize() + rng.choice(".....!?")

    pages = []
    for _ in range(count):
        parts: list[str] = []
        marks: list[bool] = []

        def put(markup: str, *kinds: bool) -> None:
            parts.append(markup)
            marks.extend(kinds)

        def items(n: int) -> str:
            return "".join(f'<li><a href="#">{words(rng.randint(1, 3))}</a></li>' for _ in range(n))

        def menu() -> None:
            n = rng.randint(2, 8)
            wrap = rng.choice(('<nav>{}</nav>', '<div class="menu">{}</div>', '<nav class="navbar">{}</nav>', '<div id="navigation" role="navigation">{}</div>', '<header><nav>{}</nav></header>'))
            put(wrap.format(f"<ul>{items(n)}</ul>"), *[False] * n)

        def advert() -> None:
            wrap = rng.choice(('<div class="ad">{}</div>', '<div class="advert">{}</div>', '<aside class="sponsored">{}</aside>', '<div id="ad-1" class="ads">{}</div>', '<section class="promo"><p>{}</p></section>'))
            put(wrap.format(sentence(rng.randint(3, 25))), False)

        def notice() -> None:
            wrap = rng.choice(('<div class="cookie-notice"><p>{}</p></div>', '<div class="notice">{}</div>', '<div role="alert" class="alert">{}</div>', '<div id="consent">{}</div>', '<p class="notice">{}</p>'))
            put(wrap.format(sentence(rng.randint(5, 30))), False)

        def side() -> None:
            n = rng.randint(1, 5)
            wrap = rng.choice(('<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div class="related">{}</div>', '<aside class="widget">{}</aside>', '<div id="sidebar" class="side">{}</div>'))
            if rng.random() < 0.5:
                put(wrap.format(f"<h3>{words(2)}</h3><ul>{items(n)}</ul>"), False, *[False] * n)
            else:
                put(wrap.format("".join(f"<p>{sentence(rng.randint(4, 25))}</p>" for _ in range(n))), *[False] * n)

        def form() -> None:
            wrap = rng.choice(('<form>{}</form>', '<form class="search">{}</form>', '<div class="newsletter"><form>{}</form></div>'))
            put(wrap.format(f"<label>{words(3)}</label><input name=q><p>{sentence(6)}</p><button>{words(1)}</button>"), *[False] * 2)

        def comments() -> None:
            n = rng.randint(1, 5)
            wrap = rng.choice(('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>'))
            one = rng.choice(('<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', '<article class="comment"><p>{}</p></article>', '<p>{}</p>'))
            put(wrap.format("".join(one.format(sentence(rng.randint(4, 40))) for _ in range(n))), *[False] * n)

        def header() -> None:
            put(rng.choice(('<header><h1>{}</h1></header>', '<div class="header"><p>{}</p></div>', '<header class="masthead">{}</header>', '<div id="banner">{}</div>')).format(words(rng.randint(1, 8))), False)

        def article() -> None:
            inner: list[str] = []
            kinds: list[bool] = []
            if rng.random() < 0.8:
                inner.append(f"<h{(h := rng.choice('112'))}>{words(rng.randint(3, 12))}</h{h}>")
                kinds.append(True)
            for _ in range(rng.choice((1, 1, 2)) if bare and rng.random() < 0.5 else rng.randint(1, 14)):
                kind = rng.random()
                if kind < 0.6:
                    inner.append(f"<p>{' '.join(sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 4)))}</p>")
                    kinds.append(True)
                elif kind < 0.7:
                    inner.append(f"<p><b>{sentence(rng.randint(1, 8))}<br>")
                    kinds.append(True)
                elif kind < 0.75:
                    inner.append(f"<h2>{words(rng.randint(1, 6))}</h2>")
                    kinds.append(True)
                elif kind < 0.8:
                    n = rng.randint(1, 5)
                    inner.append("<ul>" + "".join(f"<li>{sentence(rng.randint(2, 15))}</li>" for _ in range(n)) + "</ul>")
                    kinds += [True] * n
                elif kind < 0.82:
                    inner.append(f"<blockquote>{sentence(rng.randint(5, 20))}</blockquote>")
                    kinds.append(True)
                elif kind < 0.86:
                    inner.append(f"<p>{words(4)} <a href=x>{words(rng.randint(1, 6))}</a> {sentence(4)}</p>")
                    kinds.append(True)
                elif kind < 0.88:
                    inner.append(f"<p><a href=x>{sentence(rng.randint(3, 15))}</a></p>")
                    kinds.append(True)
                elif kind < 0.9:
                    n = rng.randint(1, 3)
                    name = rng.choice("related notes side header notice menu warning banner tags form message share summary results method".split())
                    inner.append(f'<section id="{name}"><h2>{words(2)}</h2>' + "".join(f"<p>{sentence(rng.randint(5, 40))}</p>" for _ in range(n)) + "</section>")
                    kinds += [True] * (n + 1)
                elif kind < 0.91:
                    inner.append(f"<figure><img src=x><figcaption>{sentence(rng.randint(2, 12))}</figcaption></figure>")
                    kinds.append(True)
                elif kind < 0.92:
                    inner.append(f'<table><tr><td>{words(2)}</td><td>{words(1)}</td></tr></table>')
                    kinds += [True] * 2
                elif kind < 0.97:
                    inner.append(f'<div class="{rng.choice(("ad", "advert", "share", "related", "newsletter", "notice"))}">{sentence(rng.randint(2, 15))}</div>')
                    kinds.append(False)
                else:
                    inner.append(f"<aside><p>{sentence(rng.randint(3, 15))}</p></aside>")
                    kinds.append(False)
            if rng.random() < 0.12:  # reader comments at the end of the article element
                n = rng.randint(1, 3)
                one = rng.choice(('<section id="comments">{}</section>', '<div id="comments">{}</div>', '<section class="comments">{}</section>', '<div class="comments"><h3>Comments</h3>{}</div>'))
                inner.append(one.format("".join(f"<p>{sentence(rng.randint(3, 30))}</p>" for _ in range(n))))
                kinds += [False] * (n + ("h3" in one))
            wrap = rng.choice(("<article>{}</article>",) * 4 + (f'<div id="{words(1)}-{words(1)}">{{}}</div>',) + ("<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main" class="post-body">{}</div>', '<section class="entry-content">{}</section>', '<div role="main">{}</div>', '<div class="story">{}</div>', "<div>{}</div>"))
            if bare and rng.random() < 0.6:
                wrap = rng.choice(("{}", "<div>{}</div>", f'<div id="{words(1)}-{words(1)}"><div>{{}}</div></div>'))
            put(wrap.format("".join(inner)), *kinds)

        bare = rng.random() < 0.15  # nothing but the article
        for make, share in () if bare else ((notice, 0.25), (header, 0.5), (menu, 0.8), (form, 0.2), (advert, 0.5), (side, 0.2)):
            if rng.random() < share:
                make()
        if bare and rng.random() < 0.4:
            put(rng.choice(("{}", "<div>{}</div>", "<div><p>{}</p></div>")).format(sentence(rng.randint(4, 40))), True)
        else:
            article()
        for make, share in () if bare else ((advert, 0.2), (side, 0.3), (comments, 0.35), (form, 0.2), (notice, 0.1)):
            if rng.random() < share:
                make()
        if not bare and rng.random() < 0.85:
            put(rng.choice(("<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer">{}</div>', '<div id="footer"><small>{}</small></div>')).format(f"&copy; {words(1)} &middot; {sentence(rng.randint(2, 14))}"), False)
        body = "".join(parts)
        if not bare and rng.random() < 0.1:
            body = re.sub(r'(class|id)="[^"]*"', lambda m: f'{m.group(1)}="{words(1)}-{rng.randint(1, 99)}"', body)
        pages.append((f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{body}</body></html>", marks))
    return pages


@lru_cache(1)
def train() -> Chain:
    """Fit the block chain on ``practice_pages``; the pages of a table are held out, none of them is read."""
    sequences = []
    for page, marks in practice_pages():
        blocks = leaf_blocks(page)
        if len(blocks) != len(marks):
            raise RuntimeError("a practice page is read other than it was written")
        sequences.append((block_features(blocks), np.array(marks, np.int64)))
    return fit(sequences, l2=1e-4)


def main_text(page: str | None, chain: Chain) -> str:
    return main_texts([page], chain)[0]


def main_texts(pages: list[str | None], chain: Chain) -> list[str]:
    """The article of each page: blocks that the chain marks, joined in page order by one space."""
    blocks = [leaf_blocks(p) for p in pages]
    lengths = np.array([len(b) for b in blocks], np.int64)
    if not lengths.sum():
        return [""] * len(pages)
    marks = chain.viterbi(np.concatenate([block_features(b) for b in blocks]), lengths).tolist()
    out, at = [], 0
    for own in blocks:
        out.append(" ".join(b.text for b, m in zip(own, marks[at : at + len(own)]) if m))
        at += len(own)
    return out


def extract_main_text(pages: DataFrame, chain: Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of the whole html of every row.

    Scripts, styles, forms' controls, hidden elements and markup never count; of the visible leaf blocks those
    that Viterbi decoding marks as article are kept. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by one space. A null, empty or text-free page gives an empty
    text; broken markup is read as far as it goes; repeated rows are repeated; null ids and urls are passed on;
    other columns are ignored.
    """

    def read(batches):
        for batch in slices(batches, 256):
            pages = batch.column(2).to_pylist()
            texts = main_texts(pages, chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return small_batches(pages).select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")).mapInArrow(read, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; odd rows as in ``extract_main_text``."""
    return extract_main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), train())
