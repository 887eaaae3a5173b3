import random
from html.parser import HTMLParser

import numpy as np
import pytest

from gneiss.llm import html_extract
from gneiss.llm.dom import leaf_blocks


@pytest.fixture(scope="module")
def chain():
    return html_extract.train()


def test_held_out_pages(chain):
    right = total = 0
    for page, marks in html_extract.practice_pages(300, seed=1234):
        blocks = leaf_blocks(page)
        assert len(blocks) == len(marks)
        got = chain.viterbi(html_extract.block_features(blocks), np.array([len(blocks)]))
        right += int((got == np.array(marks)).sum())
        total += len(marks)
    assert right / total > 0.98


def test_whole_article(chain):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
    <article><h1>A title of some words</h1><p><b>First sentence of it.<br><p>Caf&eacute; &amp; bar&nbsp;open,   with
    spaces and <i>inl</i>ine markup.</p><p>Third &lt;one&gt;.</p></article>
    <section class="comments"><p>I liked it a lot!</p></section><form><label>Mail</label><input><button>Go</button></form>
    <footer>&copy; example &middot; All rights.</footer></body></html>"""
    assert html_extract.main_text(page, chain) == "A title of some words First sentence of it. Café & bar open, with spaces and inline markup. Third <one>."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</div></p>", "<script>", "<!--", "<a href='x", "<html><body></body></html>", "<" * 3000, "<p>" * 5000 + "x", "<div class=\"" + "a " * 3000, "&#0; &bogus; &#x110000;"])
def test_broken_pages(page, chain):
    assert isinstance(html_extract.main_text(page, chain), str)


def test_hidden_and_raw_content():
    assert [b.text for b in leaf_blocks("<p hidden>no</p><p style='display: none'>no</p><p>yes</p><textarea><p>no</p></textarea><noscript>no</noscript><template><p>no</p></template>")] == ["yes"]


def test_frame(spark, chain):
    rows = [(1, "u", "<article><p>Some words that make a sentence of the article, and more of them.</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<nav><a>x</a></nav>")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted((tuple(r) for r in html_extract.extract_main_text(df, chain).collect()), key=repr)
    text = "Some words that make a sentence of the article, and more of them."
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0), (1, "u", "", 0)], key=repr)
    assert html_extract.extract_main_text(df.limit(0), chain).count() == 0


def test_hidden_is_the_name_of_an_attribute_only():
    for shown in ('title="Hidden gems of Rome"', "data-title='The hidden truth'", 'aria-label="a hidden b"', 'data-x="a/hidden"', "data-hidden=1", 'title = "x hidden y" class=a', 'alt=it"s href=hidden'):
        assert [b.text for b in leaf_blocks(f"<article {shown}><p>Some text.</p></article>")] == ["Some text."], shown
    for away in ("hidden", "HIDDEN", 'hidden=""', "class=a hidden", 'class="a"hidden', "title='x' hidden=hidden", 'title="Hidden gems" style="display: none"', "hidden/"):
        assert leaf_blocks(f"<div {away}>Some text.</div>") == [], away
    (block,) = leaf_blocks('<p title="class=no hidden" class="yes you" ID=three>Some text.</p>')
    assert (block.terms, block.ids) == ({"yes", "you"}, {"three"})


ARTICLE = "<article><h1>A title of some words</h1><p>First paragraph of the article has some words in it.</p>{}<p>Last paragraph of the article, with more words.</p></article>"
FIRST, LAST = "A title of some words First paragraph of the article has some words in it.", "Last paragraph of the article, with more words."


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<div id="side-effects"><p>Nausea and headache are common in adults.</p></div>', "Nausea and headache are common in adults."),
        ('<section id="related"><p>Work on this began long ago in many places.</p></section>', "Work on this began long ago in many places."),
        ('<div class="ad-hoc"><p>Networks of this kind form by themselves.</p></div>', "Networks of this kind form by themselves."),
        ("<p><a href=x>Read the whole report here.</a></p>", "Read the whole report here."),
        ("<p>Area is <math><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup><annotation>no</annotation></math> here.</p>", "Area is πr2 here."),
        ('<div class="ad">Buy this now.</div>', ""),
        ('<aside><p>Other things that you may like to read.</p></aside>', ""),
        ('<section id="comments"><p>I liked it a lot!</p></section>', ""),
    ],
)
def test_inside_the_article(inner, text, chain):
    page = "<nav><ul><li><a href=/>Home</a></li></ul></nav>" + ARTICLE.format(inner) + "<footer>&copy; x</footer>"
    assert html_extract.main_text(page, chain) == " ".join(t for t in (FIRST, text, LAST) if t)


def test_nothing_but_a_block(chain):
    for wrap in ("<p>{}</p>", '<div id="side-effects"><p>{}</p></div>', "<html><body><div>{}</div></body></html>"):
        assert html_extract.main_text(wrap.format("Nausea and headache are common in adults."), chain) == "Nausea and headache are common in adults."


def test_names_count_as_a_whole():
    named = {n: html_extract.term_groups(n) for n in ("side", "side-effects", "ad-1", "ad-hoc", "site-footer", "cookie_notice", "étage", "", "42", "related-posts-box")}
    assert {n for n, g in named.items() if g} == {"side", "ad-1", "site-footer", "cookie_notice"}


class Rule(HTMLParser):
    """The text of the article element, block by block, with what is never text left out: the rule for plain pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.away = 0
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.away += tag in ("script", "style", "nav", "footer", "aside") or ("class", "ad") in attrs
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.away -= tag in ("script", "style", "nav", "footer", "aside", "div")
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and self.away <= 0:
            self.blocks[-1] += data

    def text(self):
        return " ".join(filter(None, (" ".join(b.split()) for b in self.blocks)))


def test_plain_pages_match_the_rule(chain):
    """Pages of another make than the practice pages, against a reading by the standard parser."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(1, 9)))
    say = lambda n: (" ".join(word() for _ in range(n))).capitalize() + rng.choice(".?!")
    wrong = 0
    for _ in range(200):
        body = "".join(rng.choice((f"<p>{say(rng.randint(4, 60))}", f"<p>{say(9)}<br>{say(7)} &amp; {say(5)}</p>", f"<h2>{say(4)[:-1]}</h2>", f"<ul><li>{say(8)}</li><li>{say(6)}</li></ul>", f"<p><i>{say(5)}</i>   {say(8)}</p>", f'<div class="ad">{say(9)}</div>')) for _ in range(rng.randint(3, 12)))
        page = f"<html><body><nav><ul>{''.join(f'<li><a href=#>{word()}</a></li>' for _ in range(rng.randint(2, 7)))}</ul></nav><article><h1>{say(8)}</h1><p>{say(30)}</p>{body}</article><footer>&copy; {say(5)}</footer></body></html>"
        rule = Rule()
        rule.feed(page)
        rule.close()
        wrong += html_extract.main_text(page, chain) != rule.text()
    assert wrong <= 4
