"""Main text of web pages with a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, and each stretch of text between block
boundaries is a leaf. Every node is content, boilerplate or (elements only) a mixture. Its own
evidence is its tag, the words of its class, id and role, and for leaves length, share of link
text and punctuation. Parent and child are tied by a potential for each pair of states. Both kinds
of numbers are counted on labelled pages: those of ``labelled_pages`` and a
bounded sample (``TRAIN_PAGES``) of given pages whose markup names the article. Sum-product
messages go up and then down the tree, level by level for a whole batch of pages; leaves whose
marginal favours content are the text.

Scripts, styles, form controls and other text that a browser doesn't show as page text are no
leaves. Hidden elements end with their end tag, with that of a block around them or with what can't
stand in them (anything that a head can't hold ends the head).

Definite results: null or empty html gives an empty text; repeated rows get equal results;
nesting may be of any depth. An empty table has no rows; other columns are left alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import hashed_sample
from cloakframe.llm.labelled_pages import pages as labelled_pages
from cloakframe.llm.words import blocks

TRAIN_PAGES = 400
BOILER, CONTENT, MIXED = 0, 1, 2
_SMOOTH = 0.5
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption label".split()
)
RAW_TAGS = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
HIDDEN_TAGS = frozenset(
    "head noscript template svg math select button datalist object audio video canvas map".split()
)
#: What may stand in <head>; any other start tag or text ends a head that is still open.
HEAD_TAGS = frozenset("head html base basefont bgsound link meta title noscript noframes style script template".split())
#: Start tags that end an open <svg> or <math>, outside of the parts of these that hold HTML.
NOT_FOREIGN = BLOCK_TAGS - {"body", "html"} | frozenset("body b big br code em embed i img s small span strong sub sup u".split())
HTML_IN_FOREIGN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: What a start tag ends if it is the innermost open block.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TAGS}


class Tree:
    """Nodes of one page: parent, evidence (names of features), and text of leaves."""

    __slots__ = ("parent", "features", "text", "mark")

    def __init__(self):
        self.parent, self.features, self.text, self.mark = [-1], [("tag=root",)], [None], [None]

    def add(self, parent, features, text=None, mark=None) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.mark.append(mark)
        return len(self.parent) - 1


def leaf_features(text: str, linked: int) -> tuple[str, ...]:
    n = len(text.split())
    share = linked / max(len(text), 1)
    return (
        f"words={min(n.bit_length(), 6)}",
        "links=" + ("none" if share == 0 else "some" if share < 0.4 else "most"),
        "end=" + ("stop" if text.rstrip()[-1:] in tuple(".!?\"'”…") else "open"),
        *(("rights",) if "©" in text else ()),
    )


def parse(source: str, marks: bool = False) -> Tree:
    """The tree of a page; ``marks`` also notes the labels of training pages."""
    tree = Tree()
    stack = [(0, "root")]
    pieces: list[str] = []
    linked = at = 0
    in_link = False
    hidden: list[str] = []  # the open hidden element, and what is open inside it

    def close_leaf():
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            if text.strip():
                tree.add(stack[-1][0], leaf_features(text, linked), text)
            pieces.clear()
        linked = 0

    def take(raw: str):
        nonlocal linked
        if hidden == ["head"] and raw.strip():
            hidden.clear()
        if not hidden and raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text)

    def end_hidden(name: str):
        """What is open inside a hidden element and ends before the start tag ``name``."""
        if hidden == ["head"]:
            if name not in HEAD_TAGS:
                hidden.clear()
        elif name == "body" and hidden[0] == "head":
            hidden.clear()
        elif name in ("select", "button") and name in hidden:
            del hidden[hidden.index(name) :]
        elif name in ("input", "textarea") and hidden[-1] == "select":
            hidden.pop()
        elif name in NOT_FOREIGN:
            for k in range(len(hidden) - 1, -1, -1):
                if hidden[k] not in ("svg", "math"):
                    break
                del hidden[k]

    n = len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            take(source[at:])
            break
        if m.start() > at:
            take(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
                continue
            if hidden:
                if name in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                    continue
                if name != "body" and not any(name == tag for _, tag in stack):
                    continue
                hidden.clear()
            if name in BLOCK_TAGS:
                close_leaf()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == name:
                        del stack[k:]
                        break
            continue
        if hidden:
            end_hidden(name)
        if name in RAW_TAGS:
            end = _END_OF[name].search(source, at)
            at = end.end() if end else n
        elif hidden:
            inside = name in HIDDEN_TAGS or name in BLOCK_TAGS or name in HTML_IN_FOREIGN
            if inside and name not in ("head", "html", "body", "hr") and not m[3].endswith("/"):
                hidden.append(name)
        elif name in HIDDEN_TAGS:
            if not m[3].endswith("/"):
                hidden.append(name)
        elif name == "body":
            close_leaf()
        elif name in BLOCK_TAGS:
            close_leaf()
            if stack[-1][1] == "p" and name != "label":
                stack.pop()
            while stack[-1][1] in ENDS.get(name, ()):
                stack.pop()
            if name == "hr":
                continue
            attributes = m[3]
            features = [f"tag={name}"]
            for value in _NAMES.findall(attributes) if attributes else ():
                features += [f"name={w}" for w in _WORD.findall(value.lower()) if len(w) > 1]
            mark = None
            if marks:
                words = re.sub(r"\"[^\"]*\"", "", attributes).split()
                mark = "main" if "main" in words else "not" if "not" in words else None
            stack.append((tree.add(stack[-1][0], tuple(dict.fromkeys(features)), None, mark), name))
        elif name == "br":
            take(" ")
        elif name == "a":
            in_link = True
        if name in ("head", "html") and not hidden:
            continue
    close_leaf()
    return tree


@dataclass
class Model:
    """Log potentials: of each feature for each state, of (parent, child), and of the root."""

    number: dict[str, int]
    feature: np.ndarray
    pair: np.ndarray


def labels_of(tree: Tree, content_leaf: list[bool]) -> list[int | None]:
    """States of all nodes given those of the leaves; None for elements without text."""
    n = len(tree.parent)
    some = [[False, False] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            some[i][int(content_leaf[i])] = True
        if i:
            for k in (0, 1):
                some[tree.parent[i]][k] |= some[i][k]
    states = {(True, False): BOILER, (False, True): CONTENT, (True, True): MIXED}
    return [states.get(tuple(s)) for s in some]


def _marked(tree: Tree) -> list[bool]:
    inside = [False] * len(tree.parent)
    for i in range(1, len(inside)):
        inside[i] = {"main": True, "not": False}.get(tree.mark[i], inside[tree.parent[i]])
    return inside


_OUTSIDE = re.compile(r"tag=(nav|aside|footer|header|form)$|name=(ad|ads|advert|comment|comments|menu|sidebar)$")


def _by_markup(tree: Tree) -> list[bool] | None:
    """Leaves of the one article of a page, or None where markup doesn't name just one."""
    articles = [i for i, f in enumerate(tree.features) if f[0] == "tag=article"]
    if len(articles) != 1:
        return None
    inside = [False] * len(tree.parent)
    for i in range(articles[0], len(inside)):
        if i == articles[0]:
            inside[i] = True
        elif inside[tree.parent[i]]:
            inside[i] = not any(_OUTSIDE.match(f) for f in tree.features[i])
    return inside


def fit(sources: list[str]) -> Model:
    """Potentials from the labelled pages and those of ``sources`` that markup labels.

    The given pages together weigh at most as much as the labelled ones, so that one site's habits
    don't outvote all others.
    """
    parts: list[tuple[Tree, list[bool], float]] = []
    own = labelled_pages()
    for source in own:
        tree = parse(source, marks=True)
        parts.append((tree, _marked(tree), 1.0))
    given = [(t, m) for t in map(parse, sources) if (m := _by_markup(t)) is not None]
    parts += [(t, m, min(1.0, len(own) / len(given))) for t, m in given]
    total = np.zeros(3)
    kinds: dict[str, Counter] = {}
    pair = np.full((3, 3), _SMOOTH)
    for tree, inside, weight in parts:
        states = labels_of(tree, inside)
        for i, state in enumerate(states):
            if state is None or i == 0:
                continue
            if tree.text[i] is None:
                total[state] += weight
            for f in tree.features[i]:
                kinds.setdefault(f, Counter())[state] += weight
            if (up := states[tree.parent[i]]) is not None:
                pair[up, state] += weight
    names = sorted(kinds)
    count = np.array([[kinds[f][s] for s in range(3)] for f in names])
    groups = [f.partition("=")[0] for f in names]
    feature = np.zeros((len(names), 3))
    for group in set(groups):
        at = [i for i, g in enumerate(groups) if g == group]
        if group in ("words", "links", "end", "tag"):
            whole = count[at].sum(0)
            feature[at] = np.log((count[at] + _SMOOTH) / (whole + _SMOOTH * len(at)))
        else:  # words of names are each present or not
            feature[at] = np.log((count[at] + _SMOOTH) / (total + 2 * _SMOOTH))
            feature[at] = np.maximum(feature[at], feature[at].max(1, keepdims=True) - 4)
    return Model({f: i for i, f in enumerate(names)}, feature, np.log(pair / pair.sum(1, keepdims=True)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(model: Model, trees: list[Tree]) -> list[np.ndarray]:
    """Probability of each state for all nodes of several trees, by messages up and down."""
    sizes = [len(t.parent) for t in trees]
    base = np.append(0, np.cumsum(sizes))
    parent = np.concatenate([np.array(t.parent) + b for t, b in zip(trees, base)])
    root = np.zeros(len(parent), bool)
    root[base[:-1]] = True
    depth = np.zeros(len(parent), np.int64)
    own = np.zeros((len(parent), 3))
    leaf = np.zeros(len(parent), bool)
    node, feature = [], []
    number = model.number
    for t, b in zip(trees, base.tolist()):
        deep = [0] * len(t.parent)
        for i in range(1, len(deep)):
            deep[i] = deep[t.parent[i]] + 1
            leaf[b + i] = t.text[i] is not None
            for f in t.features[i]:
                k = number.get(f)
                if k is not None:
                    node.append(b + i)
                    feature.append(k)
        depth[b : b + len(deep)] = deep
    np.add.at(own, np.array(node, np.int64), model.feature[np.array(feature, np.int64)])
    own[leaf, MIXED] = -np.inf
    own[root] = np.log([0.05, 0.05, 0.9])
    order = np.argsort(depth, kind="stable")
    starts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    levels = [order[a:b] for a, b in zip(starts[:-1], starts[1:])]
    below = own.copy()  # own evidence and messages from children
    message = np.zeros_like(own)
    for at in reversed(levels[1:]):
        message[at] = _log_sum(model.pair[None] + below[at][:, None, :], 2)
        np.add.at(below, parent[at], message[at])
    belief = below.copy()
    for at in levels[1:]:
        from_parent = belief[parent[at]] - message[at]
        belief[at] = below[at] + _log_sum(from_parent[:, :, None] + model.pair[None], 1)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    p /= p.sum(1, keepdims=True)
    return [p[a:b] for a, b in zip(base[:-1], base[1:])]


def main_texts(model: Model, sources: list[str]) -> list[str]:
    trees = [parse(s) for s in sources]
    out = []
    for tree, p in zip(trees, marginals(model, trees)):
        kept = [
            " ".join(text.split())
            for text, content in zip(tree.text, (p[:, CONTENT] >= 0.5).tolist())
            if text is not None and content
        ]
        out.append("\n".join(kept))
    return out


def train(pages: DataFrame, sample: int = TRAIN_PAGES, most_chars: int = 100_000) -> Model:
    """Fit on at most ``sample`` pages, chosen by a hash; pages over ``most_chars`` aren't chosen."""
    fit_for = pages.where((F.length("html") <= most_chars) & F.col("html").contains("<article"))
    key = F.xxhash64(F.lit("labelled sample"), "page_id", "html")
    chosen = hashed_sample(fit_for.select("page_id", "html"), key, sample, pages.count())
    return fit([r.html for r in chosen.select("html").collect()])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def work(batches):
        for batch in blocks(batches, "html"):
            found = main_texts(shared.value, [h or "" for h in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(found, pa.string()),
                    pa.array([len(t) for t in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
