"""Main texts of hand-written pages whose layouts are unlike those that the chain is trained on."""

import itertools

import numpy as np
import pytest

from tickloom.llm import html_crf

DATA = "/root/testdata/sf0.01"
A = "The river rose by two metres overnight, and the lower town was cut off until noon."
B = "Engineers had warned of this for years. Nobody wanted to pay for a second dam, however."
C = "A spokesman said that repairs would begin in spring."
MENU = '<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a><li><a href="/s">Sport</a></ul></nav>'
FOOT = "<footer><p>© 2024 The Paper. All rights reserved.</p></footer>"

# Page and its main text, by name.
PAGES = {
    "comments inside": (f"{MENU}<article><h1>Flood in town</h1><p>{A}</p><p>{B}</p><section class='comments'><h3>Comments</h3><p>I saw it myself, and it was much worse than they say here.</p></section></article>{FOOT}", ["Flood in town", A, B]),
    "comments list": (f"{MENU}<div class='post'><h1>Flood in town</h1><p>{A}</p><p>{B}</p></div><ol class='comment-list'><li><div><p>I saw it myself, and it was worse.</p></div><li><div><p>Thanks for this, Anna. Very good.</p></div></ol>{FOOT}", ["Flood in town", A, B]),
    "newsletter inside": (f"{MENU}<article><h1>Flood in town</h1><p>{A}</p><div class='newsletter'><p>Get the best stories by mail.</p><button>Sign up</button></div><p>{B}</p></article>{FOOT}", ["Flood in town", A, B]),
    "form inside": (f"{MENU}<main><h1>Flood in town</h1><p>{A}</p><form><label>Your mail</label><input name='m'><button>Send</button></form><p>{B}</p></main>{FOOT}", ["Flood in town", A, B]),
    "table": (f"{MENU}<article><h1>Flood in town</h1><p>{A}</p><table><tr><th>Year</th><th>Level</th></tr><tr><td>1999</td><td>4.2 m</td></tr></table><p>{B}</p></article>{FOOT}", ["Flood in town", A, "Year", "Level", "1999", "4.2 m", B]),
    "list": (f"{MENU}<article><h1>Flood in town</h1><p>{A}</p><ul><li>Bring water and food.</li><li>Leave the car at home.</li></ul><p>{B}</p></article>{FOOT}", ["Flood in town", A, "Bring water and food.", "Leave the car at home.", B]),
    "pre": (f"{MENU}<article><h1>How to count</h1><p>{A}</p><pre>for i in range(3):\n    print(i)</pre><p>{B}</p></article>{FOOT}", ["How to count", A, "for i in range(3): print(i)", B]),
    "pre and list first": (f"{MENU}<article><pre>make all</pre><ul><li>Run the tests.</li><li>Read the log.</li></ul><p>{A}</p></article>{FOOT}", ["make all", "Run the tests.", "Read the log.", A]),
    "quote": (f"{MENU}<article><h1>Flood in town</h1><blockquote><p>{C}</p></blockquote><p>{A}</p></article>{FOOT}", ["Flood in town", C, A]),
    "definitions": (f"{MENU}<article><h1>Words of the dam</h1><dl><dt>Weir</dt><dd>A low wall across a river.</dd><dt>Sluice</dt><dd>A gate that lets water pass.</dd></dl><p>{B}</p></article>{FOOT}", ["Words of the dam", "Weir", "A low wall across a river.", "Sluice", "A gate that lets water pass.", B]),
    "headings": (f"{MENU}<article><h1>Flood in town</h1><h2>The night</h2><p>{A}</p><h3>Warnings</h3><p>{B}</p></article>{FOOT}", ["Flood in town", "The night", A, "Warnings", B]),
    "figure": (f"{MENU}<article><h1>Flood in town</h1><figure><img src='a.png'><figcaption>The lower town at dawn.</figcaption></figure><p>{A}</p></article>{FOOT}", ["Flood in town", "The lower town at dawn.", A]),
    "div soup": (f"<div class='menu'><a href='/'>Home</a> <a href='/n'>News</a></div><div><div>{A}</div><div>{B}</div></div><div class='sidebar'><div><a href='/x'>More of this</a></div></div><div class='footer'>© 2024 The Paper</div>", [A, B]),
    "no container": (f"{MENU}<h1>Flood in town</h1><p>{A}</p><p>{B}</p>{FOOT}", ["Flood in town", A, B]),
    "page words far up": (f"<body class='home has-sidebar'><div class='has-sidebar'>{MENU}<div class='entry-content'><p>{A}</p><p>{B}</p></div></div>{FOOT}", [A, B]),
    "side and advert inside": (f"{MENU}<article><h1>Flood in town</h1><p>{A}</p><aside><p>Read also: the dam that never was built.</p></aside><div class='ad'>Buy boats now, half price!</div><p>{B}</p></article>{FOOT}", ["Flood in town", A, B]),
    "cookie notice": (f"<div id='cookie-banner'><p>We use cookies to give you a better site. Do you agree with that?</p><button>Accept</button></div>{MENU}<article><p>{A}</p></article>{FOOT}", [A]),
    "only menus": (f"{MENU}<div class='sidebar'><ul><li><a href='/x'>More</a></ul></div>{FOOT}", []),
}


@pytest.fixture(scope="module")
def chain(spark):
    return html_crf.train(spark.read.parquet(f"{DATA}/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_layout(chain, name):
    page, wanted = PAGES[name]
    if "<body" not in page:
        page = f"<body>{page}</body>"
    assert html_crf.main_text(f"<!DOCTYPE html><html><head><title>x</title></head>{page}</html>", chain).split("\n") == (wanted or [""])


def test_fit_is_where_the_gradient_of_all_paths_vanishes():
    rng = np.random.default_rng(5)
    pages = [([["bias", f"a{rng.integers(3)}", f"b{rng.integers(2)}"] for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 4, 5, 3)]
    ridge = 0.05
    chain = html_crf.fit(pages, steps=4000, rate=0.02, ridge=ridge)

    def loss(emit, move):
        total = 0.0
        for rows, labels in pages:
            scores = html_crf.Chain(chain.names, emit, move).scores(rows)
            paths = [
                sum(scores[t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))
                for p in itertools.product((0, 1), repeat=len(rows))
            ]
            gold = sum(scores[t, k] for t, k in enumerate(labels)) + sum(move[a, b] for a, b in itertools.pairwise(labels))
            total += np.logaddexp.reduce(paths) - gold
        return total / len(pages) + ridge / 2 * ((emit**2).sum() + (move**2).sum())

    for value in (chain.emit, chain.move):
        for place in np.ndindex(value.shape):
            kept, sides = value[place], []
            for off in (1e-4, -1e-4):
                value[place] = kept + off
                sides.append(loss(chain.emit, chain.move))
            value[place] = kept
            assert abs(sides[0] - sides[1]) / 2e-4 < 2e-3


def test_pages_of_empty_tables_repeated_rows_and_clashing_names(spark, chain):
    rows = [(1, None, "u", "x"), (1, None, "u", "x"), (None, "<article><p>a b</p></article>", None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = sorted(tuple(r) for r in html_crf.extract(pages.select("page_id", "html", "url", "text"), None).select("n_chars", "text").collect())
    assert got == [(0, ""), (0, ""), (3, "a b")]
    assert html_crf.train(pages.limit(0)) is None
    assert html_crf.extract(pages.limit(0), chain).count() == 0
