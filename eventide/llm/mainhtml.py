"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A leaf block is a run of text between two block-level tags. Its features are the tags, classes, ids and roles of all its
ancestors and what its text looks like; a block is main text or not, and neighbours tend to be alike. Weights maximise the
likelihood of labelled pages (forward-backward); a page is decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_text, bounded_batches

#: Fixed values of HTML: elements that part blocks, that have no end tag, and whose content isn't shown text.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head iframe script style svg template textarea title".split())
#: Of these, the ones whose content ends with the page where it has no end tag.
RAW = frozenset("iframe script style textarea title".split())
#: What a start tag closes where it is innermost.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LABEL = re.compile(r"\bdata-label\s*=\s*[\"']?main\b")
#: White space is what Unicode calls so, no-break spaces too.
SPACES = re.compile(r"\s+")
UNEVEN = re.compile(r"[^\S ]|  |^ | $")


class Node:
    """An open element: its tag, and the features that it and its ancestors give a block."""

    __slots__ = ("tag", "parent", "features", "children", "label", "score")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.children, self.score = tag, parent, {}, None
        names = {f"t:{tag}"}
        for m in ATTRIBUTE.finditer(attributes):
            names.update(f"c:{x}" for x in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if x)
        self.features = names | parent.features if parent else names
        self.label = bool(LABEL.search(attributes)) or (parent is not None and parent.label)

    def child(self, tag: str, attributes: str) -> Node:
        found = self.children.get((tag, attributes))
        if found is None:
            found = self.children[tag, attributes] = Node(tag, self, attributes)
            tree_size[0] += 1
        return found


tree_size = [0]


class Block(NamedTuple):
    node: Node
    text: str
    in_links: int


def tidy(text: str) -> str:
    """Character references decoded, each run of white space one space, none at the ends."""
    if "&" in text:
        text = html.unescape(text)
    return SPACES.sub(" ", text).strip(" ") if UNEVEN.search(text) else text


def leaf_blocks(page: str, root: Node) -> list[Block]:
    """Blocks in page order; inline tags and comments vanish, a line break is white space, hidden elements have no text."""
    out: list[Block] = []
    node, pieces, at, links, linked, end = root, [], 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = tidy("".join(pieces))
            if text:
                out.append(Block(node, text, linked))
            pieces, linked = [], 0

    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            pieces.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        closing, name, attributes = m.groups()
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
            if closing:
                links, above = 0, node
                while above is not root and above.tag != name:
                    above = above.parent
                if above is not root:
                    node = above.parent
            else:
                if node.tag == "p" and name not in ("button", "label", "option", "select"):
                    node = node.parent
                shut = CLOSES.get(name, ())
                while node.tag in shut:
                    node = node.parent
                if name not in VOID and not attributes.endswith("/"):
                    node = node.child(name, attributes)
        elif name in HIDDEN:
            if not closing and not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(name)}[\s/>]" if name != "head" else r"</head[\s/>]|<body[\s/>]", re.I).search(page, at)
                at = over.start() if over else (end if name in RAW else at)
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            pieces.append(" ")
    flush()
    return out


def text_features(blocks: list[Block]) -> list[tuple[str, ...]]:
    """What each block's text looks like: its length, its share of link text, its end, a copyright sign; lengths and links beside it."""
    sizes, links = [], []
    for b in blocks:
        size = (b.text.count(" ") + 1).bit_length()
        sizes.append(size if size < 7 else 7)
        links.append(0 if not b.in_links else 1 if 3 * b.in_links < len(b.text) else 2 if 3 * b.in_links < 2 * len(b.text) else 3)
    shapes = [f"{s}{k}" for s, k in zip(sizes, links)]
    out, last = [], len(blocks) - 1
    for i, b in enumerate(blocks):
        out.append(
            (
                f"len:{sizes[i]}",
                f"link:{links[i]}",
                f"before:{shapes[i - 1] if i else ''}",
                f"after:{shapes[i + 1] if i < last else ''}",
                "end:1" if b.text[-1] in ".!?" else "end:0",
                "copy:1" if "©" in b.text else "copy:0",
                f"edge:{int(i == 0)}{int(i == last)}",
                f"in:{b.node.tag}",
            )
        )
    return out


class Field(NamedTuple):
    """Weights of features for main text; of neighbours [left][right]; of the first block."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def emissions(self, blocks: list[Block]) -> list[float]:
        get, out = self.weights.get, []
        for b, own in zip(blocks, text_features(blocks)):
            node = b.node
            if node.score is None:
                node.score = sum(get(f, 0.0) for f in node.features)
            score = node.score
            for f in own:
                score += get(f, 0.0)
            out.append(score)
        return out

    def decode(self, emissions: list[float]) -> list[bool]:
        """Viterbi: the likeliest labels, ties to not main."""
        if not emissions:
            return []
        (t00, t01), (t10, t11) = self.step
        no, yes, back = self.start[0], self.start[1] + emissions[0], []
        for e in emissions[1:]:
            from_no, from_yes = (no + t00, no + t01), (yes + t10, yes + t11)
            back.append((from_yes[0] > from_no[0], from_yes[1] > from_no[1]))
            no, yes = max(from_no[0], from_yes[0]), max(from_no[1], from_yes[1]) + e
        labels = [yes > no]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, page: str, root: Node) -> str:
        blocks = leaf_blocks(page, root)
        return " ".join([b.text for b, main in zip(blocks, self.decode(self.emissions(blocks))) if main])


def log_partition(emissions: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains padded to one length: log Z of each, P(main) of each place, and the summed expected neighbours [left][right]."""
    n, longest = emissions.shape
    score = np.stack([np.zeros_like(emissions), emissions], axis=2)
    fore, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    fore[:, 0] = start + score[:, 0]
    for t in range(1, longest):
        fore[:, t] = np.logaddexp(fore[:, t - 1, 0, None] + step[0], fore[:, t - 1, 1, None] + step[1]) + score[:, t]
    rows = np.arange(n)
    log_z = np.logaddexp(fore[rows, lengths - 1, 0], fore[rows, lengths - 1, 1])
    for t in range(longest - 2, -1, -1):
        ahead = score[:, t + 1] + back[:, t + 1]
        here = np.logaddexp(step[:, 0] + ahead[:, 0, None], step[:, 1] + ahead[:, 1, None])
        back[:, t] = np.where((t + 1 < lengths)[:, None], here, 0.0)
    inside = np.arange(longest) < lengths[:, None]
    main = np.where(inside, np.exp(fore[:, :, 1] + back[:, :, 1] - log_z[:, None]), 0.0)
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            log = fore[:, :-1, a] + step[a, b] + score[:, 1:, b] + back[:, 1:, b] - log_z[:, None]
            pairs[a, b] = np.exp(log[inside[:, 1:]]).sum()
    return log_z, main, pairs


def fit(pages: Iterable[str], rounds: int = 200, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Weights that maximise the likelihood of the labels in ``pages`` (elements with data-label="main"), by Adam."""
    chains = [blocks for page in pages if (blocks := leaf_blocks(page, Node("", None, "")))]
    if not chains:
        return Field({}, ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0))
    number: dict[str, int] = {}
    lengths = np.array([len(c) for c in chains])
    shape = (len(chains), lengths.max())
    truth, cells, ids = np.zeros(shape, np.int64), [], []
    for i, blocks in enumerate(chains):
        for t, (b, found) in enumerate(zip(blocks, text_features(blocks))):
            truth[i, t] = b.node.label
            own = [number.setdefault(f, len(number)) for f in (*sorted(b.node.features), *found)]
            cells += [i * shape[1] + t] * len(own)
            ids += own
    cells, ids = np.array(cells), np.array(ids)
    inside = np.arange(shape[1]) < lengths[:, None]
    both = inside[:, 1:]
    seen = np.array([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum() for b in range(2)] for a in range(2)])
    theta = np.zeros(len(number) + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emissions = np.bincount(cells, weights=theta[ids], minlength=truth.size).reshape(shape)
        _, main, pairs = log_partition(emissions, lengths, theta[-6:-2].reshape(2, 2), theta[-2:])
        off = (main - truth * inside).ravel()
        begins = np.array([(truth[:, 0] == 0).sum() - (1 - main[:, 0]).sum(), (truth[:, 0] == 1).sum() - main[:, 0].sum()])
        slope = np.concatenate([np.bincount(ids, weights=off[cells], minlength=len(number)), (pairs - seen).ravel(), -begins]) / len(chains) + ridge * theta / len(chains)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= rate * (1 - 0.9 * (k - 1) / rounds) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    t = theta[-6:-2].tolist()
    return Field({f: float(theta[i]) for f, i in number.items()}, ((t[0], t[1]), (t[2], t[3])), tuple(theta[-2:].tolist()))


def main_text(pages: DataFrame, field: Field, tree_limit: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``: the main text of the whole ``html``, and its code points.

    Blocks are joined in page order by one space. A null or empty page, and one without main text, gives an empty text;
    null ids and urls and repeated rows are kept; an empty table gives an empty result. Other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field)  # weights of the bounded training pages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node("", None, "")
        for b in batches:
            texts = []
            for page in as_text(b.column(2)):
                if tree_size[0] > tree_limit:  # ancestors are kept from page to page, as long as they are few
                    root, tree_size[0] = Node("", None, ""), 0
                texts.append(shared.value.extract(page, root))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
