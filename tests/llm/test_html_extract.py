import html
import itertools
import re

import numpy as np
import pytest

from lmprep.llm import html_extract as ex
from lmprep.llm.html_layouts import labelled_pages
from lmprep.llm.html_tree import blocks, parse
from lmprep.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def all_blocks(source):
    page = parse(source)
    return blocks(page, [True] * len(page.nodes))


@pytest.mark.parametrize("source,want", [
    ("", []),
    ("just text &amp; more&nbsp;&#33;", ["just text & more !"]),
    ("<p><b>one<br><p>two</b> three</p>tail", ["one", "two three", "tail"]),
    ("<div>a<p>b</div>c", ["a", "b", "c"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<script>var t='</p><p>x';</script>a<style>p{}</style><!-- <p>no --> b", ["a b"]),
    ("a<!-- never closed <p>b", ["a"]),
    ("<p title='a>b' x=\"c>d\">e <i class=x>f</i>g", ["e fg"]),
    ("<p title=\"open>a</p><p>b", ["a", "b"]),
    ("<p title=it's>a</p> don't", ["a", "don't"]),
    ("1 < 2 and <3</p></div></b>x", ["1 < 2 and <3", "x"]),
    ("<p>a \n\t b</p ><P>c</P><textarea>no</textarea><select><option>no</select>", ["a b", "c"]),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes", ["yes"]),
    ("<p>cut <a hre", ["cut"]),
])
def test_blocks(source, want):
    assert all_blocks(source) == want


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(2)
    pages = [parse("<div><p>a</p><ul><li>b</ul></div>"), parse("x"), parse("<p>1<p>2<p>3")]
    trees = ex.forest(pages, [ex.features(p) for p in pages], {})
    unary, pair = rng.normal(size=(len(trees.parents), 3)), rng.normal(size=(3, 3))
    found, joint, log_z = ex.sum_product(trees, unary, pair)
    want_z, edges, first = 0.0, np.zeros((3, 3)), 0
    for p in pages:
        n = len(p.nodes)
        total, marginal, own = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for states in itertools.product(range(3), repeat=n):
            links = [(states[v.parent], states[i]) for i, v in enumerate(p.nodes) if i]
            weight = np.exp(sum(unary[first + i, s] for i, s in enumerate(states)) + sum(pair[e] for e in links))
            total += weight
            marginal[range(n), states] += weight
            for e in links:
                own[e] += weight
        assert np.allclose(found[first : first + n], marginal / total)
        want_z, edges, first = want_z + np.log(total), edges + own / total, first + n
    assert np.isclose(log_z, want_z) and np.allclose(joint, edges)


def test_gradient_is_the_slope_of_the_likelihood():
    labelled = [(p, ex.marked_states(p)) for p in map(parse, labelled_pages(5, seed=9))]
    named = [ex.features(p) for p, _ in labelled]
    index = {f: i for i, f in enumerate(sorted({f for page in named for n in page for f in n}))}
    trees, states = ex.forest([p for p, _ in labelled], named, index), np.concatenate([s for _, s in labelled])
    rng = np.random.default_rng(1)
    weights, pair = rng.normal(size=(len(index), 3)), rng.normal(size=(3, 3))
    _, slope, steep = ex.likelihood(trees, states, weights, pair)
    value = lambda w, p: ex.likelihood(trees, states, w, p)[0]
    for i, s in [(0, 0), (3, 1), (7, 2), (11, 1)]:
        step = np.zeros_like(weights)
        step[i, s] = 1e-5
        assert np.isclose((value(weights + step, pair) - value(weights - step, pair)) / 2e-5, slope[i, s], atol=1e-4)
    for at in [(0, 1), (1, 1), (2, 0)]:
        step = np.zeros((3, 3))
        step[at] = 1e-5
        assert np.isclose((value(weights, pair + step) - value(weights, pair - step)) / 2e-5, steep[at], atol=1e-4)


@pytest.fixture(scope="module")
def model():
    return ex.fit([(p, ex.marked_states(p)) for p in map(parse, labelled_pages(ex.LAYOUTS))])


def test_held_out_layouts(model):
    pages = [parse(p) for p in labelled_pages(300, seed=31)]
    want = [blocks(p, (ex.marked_states(p) == ex.CONTENT).tolist()) for p in pages]
    got = model.extract(pages)
    assert np.mean([a == b for a, b in zip(got, want)]) >= 0.94
    shown = [np.array([not n.hidden for n in p.nodes]) for p in pages]
    right = [((m[:, 1] > 0.5) == (ex.marked_states(p) == ex.CONTENT))[s] for p, m, s in zip(pages, model.marginals(pages), shown)]
    assert np.concatenate(right).mean() >= 0.985


PROSE = "It was late when they came to the harbour, and nobody had lit the lamps. The boats lay still."


@pytest.mark.parametrize("part", [
    f"<nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav>", f"<header><h1>Daily</h1><p>{PROSE}</p></header>",
    f"<footer><p>{PROSE}</p></footer>", f"<aside><p>{PROSE}</p><p>{PROSE}</p></aside>", f"<div class='sidebar'><h3>More</h3><p>{PROSE}</p></div>",
    f"<div class='cookie-notice'><p>{PROSE}</p></div>", f"<div class=ad>{PROSE}</div>", f"<div id='advertisement'><p>{PROSE}</p></div>",
    f"<form><label>Name</label><input><p>{PROSE}</p></form>",
    f"<section class='comments'><h2>Comments</h2>{f'<div class=comment><p>{PROSE}</p></div>' * 6}</section>",
    f"<div id=comments><ul>{f'<li><p>{PROSE}</p></li>' * 5}</ul></div>",
])
def test_parts_that_are_no_article(model, part):
    text = f"<h1>The harbour</h1><p>{PROSE}</p><p>{PROSE} {PROSE}</p><ul><li>One lamp.</li></ul>"
    want = ["The harbour", PROSE, f"{PROSE} {PROSE}", "One lamp."]
    for kind in ("article", "main", "div class=content", "div class=post-body"):
        name = kind.split()[0]
        for page in (f"<body>{part}<{kind}>{text}</{name}></body>", f"<body><div><{kind}>{text}</{name}></div>{part}</body>"):
            assert model.extract([parse(page)]) == [want], page


def article(source):
    inside = re.sub("</?b>", "", re.search("<article>(.*?)</article>", source, re.S)[1]).replace("<br>", " ")
    parts = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in parts if x)


def test_query_equals_the_marked_article(spark):
    rows = QUERIES["op12_html_extract"](spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_pages(spark, model):
    long = f"<article><p>{PROSE * 20_000}</p></article>"
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>" + "</div>" * 3000
    sources = [None, "", " \n", "<!--", "<script>x", "<nav><a>Home</a></nav>", long, long, deep, "<article><p>é &copy; \U0001f600.</article>"]
    df = spark.createDataFrame([(i, s, "a", 1) for i, s in enumerate(sources)], "page_id long, html string, text string, n_chars int")
    got = {r.page_id: r for r in df.select("page_id", "text", ex.main_text(df, model=model).alias("found")).collect()}
    assert [got[i].found.text for i in range(6)] == [""] * 6 and all(r.text == "a" for r in got.values())
    assert got[6].found == got[7].found and got[6].found.text == PROSE * 20_000 and got[6].found.n_chars == len(PROSE) * 20_000
    assert got[9].found.text == "é © \U0001f600." and got[9].found.n_chars == 6
    empty = df.where("false")
    assert empty.select(ex.main_text(empty).alias("t")).collect() == []
