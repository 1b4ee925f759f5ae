"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable with three states: a frame that holds content beside other things, content, and neither. Weights on an element's
features (its name, words of class and id, length, links and sentences of its text) and on the states of parent and child give the joint
probability of a page's states. Sum-product messages go up and down the tree, level by level over all pages of a
batch at once, and yield exact marginals; text belongs to the article where its element's marginal of content is above one half.

The weights maximise the penalised likelihood of labelled pages: made-up layouts of many kinds, and pages of the table at hand that say themselves
what their article is. The latter are a sample of bounded size, those with the least hashes; extraction reads all pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lmprep.llm.arrow import chunks, struct, text_list
from lmprep.llm.html_layouts import labelled_pages
from lmprep.llm.html_tree import Page, blocks, parse

FRAME, CONTENT, OTHER = range(3)
#: Pages of the table and made-up pages that the model is fitted on, at most.
SAMPLE, LAYOUTS = 100, 500
#: Steps of the fit, its rate, and the weight of the penalty on squared weights.
STEPS, RATE, PENALTY = 100, 0.25, 0.0001
#: Names of elements and of classes that are never part of an article.
NEVER = frozenset("aside footer form nav".split())
NEVER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie footer form login menu nav navbar "
    "navigation newsletter notice pager pagination popup promo related reply sidebar share signup social sponsor sponsored subscribe "
    "widget".split()
)
#: Elements that tell what all below them is.
TELLING = frozenset("article aside footer form header main nav section".split())
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


def _size(n: int) -> int:
    """0, 1-2, 3-5, 6-11, 12-23 and so on, up to 7 for 48 and more: any long text is like another."""
    return 0 if n == 0 else 1 if n < 3 else min(7, int(math.log2(n / 1.5)) + 1)


def features(page: Page) -> list[list[str]]:
    """Names of each node's features."""
    count = len(page.nodes)
    words, linked, sentences, own = ([0] * count for _ in range(4))
    for run in page.runs:
        if run is not None:
            node, text, link = run
            n = len(text.split())
            words[node] += n
            own[node] += n
            linked[node] += n * link
            sentences[node] += len(_SENTENCE.findall(text))
    for i in range(count - 1, 0, -1):  # children come after their parents
        up = page.nodes[i].parent
        words[up] += words[i]
        linked[up] += linked[i]
        sentences[up] += sentences[i]
    out: list[list[str]] = []
    above: list[frozenset[str]] = []
    for i, node in enumerate(page.nodes):
        inherited = above[node.parent] if i else frozenset()
        telling = [f"below {node.tag}"] if node.tag in TELLING else []
        telling += [f"below name {w}" for w in node.words]
        above.append(inherited.union(telling) if telling else inherited)
        if node.hidden:
            out.append(["hidden"])
            continue
        links = 0 if not words[i] else 1 + int(3 * linked[i] / words[i])
        found = ["any", f"tag {node.tag}", f"words {_size(words[i])}", f"own {_size(own[i])}", f"links {links}"]
        found.append(f"sentences {_size(sentences[i])}")
        found.append(f"rate {int(min(3, 30 * sentences[i] / max(1, words[i])))}")
        found += [f"name {w}" for w in node.words] or ["unnamed"]
        out.append(found + sorted(inherited))
    return out


def marked_states(page: Page) -> np.ndarray:
    """States by ``data-label`` marks."""
    marks = [n.attributes.get("data-label") for n in page.nodes]
    return _states(page, [m == "text" for m in marks], [m == "none" for m in marks])


def own_states(page: Page) -> np.ndarray | None:
    """States of a page that says what its article is; None for one that does not."""
    never = [n.tag in NEVER or not NEVER_WORDS.isdisjoint(n.words) for n in page.nodes]
    for says in (
        lambda n: n.attributes.get("itemprop") == "articleBody",
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or n.attributes.get("role") == "main",
    ):
        roots = [says(n) and not out for n, out in zip(page.nodes, never)]
        if any(roots):
            return _states(page, roots, never)
    return None


def _states(page: Page, text: list[bool], other: list[bool]) -> np.ndarray:
    out = np.full(len(page.nodes), OTHER)
    for i, node in enumerate(page.nodes):
        above = out[node.parent] if i else OTHER
        inside = above == CONTENT or (text[i] and not _below(page, other, i))
        out[i] = CONTENT if inside and not other[i] and not node.hidden else OTHER
    for i in range(len(out) - 1, 0, -1):
        up = page.nodes[i].parent
        if out[i] != OTHER and out[up] == OTHER:
            out[up] = FRAME
    return out


def _below(page: Page, other: list[bool], i: int) -> bool:
    while i >= 0:
        if other[i]:
            return True
        i = page.nodes[i].parent
    return False


@dataclass(frozen=True)
class Forest:
    """Trees of many pages: parents (-1 at roots) and the nodes of each level, and (node, feature) pairs."""

    parents: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray
    feature: np.ndarray
    starts: np.ndarray


def forest(pages: list[Page], named: list[list[list[str]]], index: dict[str, int]) -> Forest:
    starts = np.cumsum([0, *(len(p.nodes) for p in pages)])
    parents = np.array([n.parent + s if n.parent >= 0 else -1 for p, s in zip(pages, starts) for n in p.nodes], int)
    depths = np.array([n.depth for p in pages for n in p.nodes], int)
    order = np.argsort(depths, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depths[order])) + 1)
    pairs = [(i, index[f]) for i, found in enumerate(f for page in named for f in page) for f in found if f in index]
    node, feature = np.array(pairs, int).reshape(-1, 2).T
    return Forest(parents, levels, node, feature, starts)


def _added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by ``at``."""
    columns = [np.bincount(at, weights=values[:, j], minlength=size) for j in range(values.shape[1])]
    return np.stack(columns, axis=1)


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def sum_product(trees: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of all nodes, expected pairs of states over all edges, and the logarithm of the partition function.

    ``unary`` is a log potential per node and state, ``pair[parent, child]`` per edge.
    """
    inside, messages = unary.copy(), np.zeros_like(unary)
    for level in reversed(trees.levels[1:]):
        messages[level] = _sum(pair[None] + inside[level][:, None, :], 2)
        up = trees.parents[level]
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])  # children of a node stand together in their level
        inside[up[first]] += np.add.reduceat(messages[level], first)
    outside = np.zeros_like(unary)
    joint = np.zeros((3, 3))
    log_z = float(_sum(inside[trees.levels[0]], 1).sum())
    for level in trees.levels[1:]:
        up = trees.parents[level]
        rest = inside[up] + outside[up] - messages[level]
        edge = rest[:, :, None] + pair[None] + inside[level][:, None, :]
        outside[level] = _sum(rest[:, :, None] + pair[None], 1)
        edge -= _sum(edge.reshape(len(level), 9), 1)[:, None, None]
        joint += np.exp(edge).sum(axis=0)
    belief = inside + outside
    return np.exp(belief - _sum(belief, 1)[:, None]), joint, log_z


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def unary(self, trees: Forest) -> np.ndarray:
        return _added(trees.node, self.weights[trees.feature], len(trees.parents))

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        trees = forest(pages, [features(p) for p in pages], self.index)
        found, _, _ = sum_product(trees, self.unary(trees), self.pair)
        return [found[a:b] for a, b in zip(trees.starts[:-1], trees.starts[1:])]

    def extract(self, pages: list[Page]) -> list[list[str]]:
        """Blocks of each page's main text."""
        return [blocks(p, (m[:, CONTENT] > 0.5).tolist()) for p, m in zip(pages, self.marginals(pages))]


def likelihood(trees: Forest, states: np.ndarray, weights: np.ndarray, pair: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the states and its gradients."""
    model = Model({}, weights, pair)
    unary = model.unary(trees)
    found, joint, log_z = sum_product(trees, unary, pair)
    below = trees.parents >= 0
    observed = np.bincount(3 * states[trees.parents[below]] + states[below], minlength=9).reshape(3, 3)
    off = -found
    off[np.arange(len(states)), states] += 1
    slope = _added(trees.feature, off[trees.node], len(weights))
    value = float(unary[np.arange(len(states)), states].sum() + (observed * pair).sum()) - log_z
    return value, slope, observed - joint


def fit(labelled: list[tuple[Page, np.ndarray]], steps: int = STEPS) -> Model:
    """Weights of the greatest penalised likelihood, by steps with momentum and a rate for each weight."""
    pages = [p for p, _ in labelled]
    named = [features(p) for p in pages]
    index = {f: i for i, f in enumerate(sorted({f for page in named for found in page for f in found}))}
    trees, states = forest(pages, named, index), np.concatenate([s for _, s in labelled])
    values = [np.zeros((len(index), 3)), np.zeros((3, 3))]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        _, *slopes = likelihood(trees, states, *values)
        for v, m, s, g in zip(values, mean, square, slopes):
            g = g / len(pages) - PENALTY * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += RATE * min(1.0, 2 - 2 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(index, *values)


def train(table: DataFrame, html: str = "html", sample: int = SAMPLE, layouts: int = LAYOUTS) -> Model:
    """A model for ``table``: ``layouts`` made-up pages, and the ``sample`` pages with the least hashes among those that label themselves."""
    text = F.col(f"`{html}`")
    says = text.isNotNull() & F.lower(text).rlike(r"<(article|main)\b|articlebody|role=.?main")
    able = table.where(says).select(text.alias("html"), F.xxhash64(text).alias("hash"))
    least = [r["hash"] for r in able.select("hash").distinct().orderBy("hash").limit(sample).collect()]  # hashes alone, pages later
    found = able.where(F.col("hash") <= max(least, default=0)).dropDuplicates(["hash"]) if least else able.limit(0)
    pages = [parse(p) for p in labelled_pages(layouts)]
    labelled = [(p, marked_states(p)) for p in pages]
    own = [parse(r["html"]) for r in found.orderBy("hash").collect()]  # at most ``sample``
    labelled += [(p, s) for p in own if (s := own_states(p)) is not None]
    return fit(labelled)


_OUT = {"text": pa.string(), "n_chars": pa.int64()}


def main_text(table: DataFrame, html: str = "html", model: Model | None = None) -> Column:
    """struct(text, n_chars) of each row's page; the model is fitted on ``table`` if none is given.

    A null or empty page, and one without an article, has an empty text. Pages of any length are read whole; page order is kept, equal pages have
    equal texts. Without pages that label themselves, or any pages at all, the model knows the made-up layouts alone. Rows and
    columns of ``table`` are as they were.
    """
    model = train(table, html) if model is None else model
    shipped = table.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    @F.arrow_udf("text string, n_chars long")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts: list[str] = []
            for part in chunks(batch):
                texts += ["\n\n".join(b) for b in shipped.value.extract([parse(t) for t in text_list(part)])]
            yield struct({"text": texts, "n_chars": [len(t) for t in texts]}, _OUT)

    return extract(F.col(f"`{html}`"))
