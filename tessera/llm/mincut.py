"""Main text of web pages by minimum cut.

A page becomes a graph of its text blocks and of the elements around them:

* A block's capacity to a terminal is the log-odds of a classifier over its own text
  (length, links, punctuation), within bounds.  The classifier is fitted here, on the blocks
  of a bounded sample of the pages: those whose nearest landmark element is ``article`` or
  ``main`` against those in ``nav``, ``footer``, ``aside`` and their like.  Names and elements
  are no inputs of it.
* An element's capacity is what its tag, class, id and role say, times the blocks that it
  holds, again within bounds: names weigh, they do not veto.
* Ties by proximity in the document: of a block to its element, of an element to its parent
  (times its blocks), and of neighbouring blocks, less with their distance in the tree.

The minimum cut labels all of them at once; the blocks on the content side are the text.
Nodes whose own capacity outweighs their ties, nodes with one tie, and empty nodes between
two others are settled first, which takes linear time; what is left goes through maximum
flow.  Capacities of both kinds are of one order, so that a short paragraph goes with its
article, and a sentence in an advert with the advert.

Edge cases: a null or empty page, and one without content, gives the empty text; broken
markup is read leniently (unclosed elements, stray end tags, unterminated comments, quotes
and tags); repeated rows are separate pages; an empty table gives an empty result; pages
are read whole, whatever their length or depth, in linear time; other columns are ignored.
Fallback text of objects, maps, drawings and media counts as text where it stands.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What elements mean in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template iframe head title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of one group; one that opens closes an open one, up to the nearest of the containers.
GROUPS = (
    (frozenset({"p"}), frozenset("td th table button object".split())),
    (frozenset({"li"}), frozenset("ul ol menu".split())),
    (frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"tr"}), frozenset({"table"})),
    (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"option"}), frozenset({"select"})),
)
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset select noscript".split())
# Words in class, id and role that tell boilerplate from content, and such as go with either.
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adbox adsbygoogle alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer discussion disqus feedback footer form gdpr header legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices "
    "notification pagination popup promo promotion rail recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets complementary contentinfo".split()
)
GOOD_NAMES = frozenset("article body content entry main post prose story text".split())
NEUTRAL_NAMES = frozenset("area bar block bottom box container global group inner item items left link links list main outer page panel primary right secondary section site slot the top unit wrap wrapper".split())

# Capacities, in thousandths.
SCALE = 1000
#: What elements say for each block they hold, and once for themselves.
LANDMARK, NAMED, HINTED, CONCEALED = 8000, 7000, 800, 20000
#: A block's own capacity lies between these.
LEAST, MOST = -1400, 2500
TIE_ELEMENT, TIE_PARENT, TIE_NEXT = 5000, 3000, 1500

#: Weights from which the fit starts, and at which it stays where the pages say nothing: bias, doublings of words,
#: share of links in eighths, ends like a sentence.
START = np.array([-1.0, 0.5, -0.5, 0.8])

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]|\Z")
_OUTSIDE = re.compile(r"[^<>\"']*")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/]|$)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CONCEALS = re.compile(r"display\s*:\s*none")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    depth: int
    says: int
    inside: int  # 1 in an article, -1 in a landmark of boilerplate, 0 elsewhere
    groups: int
    blocks: int = 0


@dataclass(slots=True)
class Block:
    text: str
    element: int
    linked: int


def _named(value: str) -> int:
    """What a class, id or role says."""
    says = 0
    for name in value.split():
        parts = [w.lower() for w in _PART.findall(name)]
        bad = [w for w in parts if w in BAD_NAMES]
        if name.lower() in BAD_NAMES or bad and all(w in BAD_NAMES or w in NEUTRAL_NAMES for w in parts):
            says = min(says, -NAMED)
        elif bad:
            says -= HINTED
        elif parts and all(w in GOOD_NAMES or w in NEUTRAL_NAMES for w in parts) and any(w in GOOD_NAMES for w in parts):
            says += 2 * HINTED
        elif any(w in GOOD_NAMES for w in parts):
            says += HINTED
    return says


def _evidence(tag: str, attrs: str, inside: int) -> tuple[int, int]:
    """What an element says, and the landmark that it and its descendants are in."""
    says = 0
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _CONCEALS.search(value):
                return -CONCEALED, -1
            if name in ("class", "id", "role"):
                said = _named(value)
                # An article has headers and notes of its own.
                says += 0 if inside == 1 and said < 0 and not {w.lower() for w in _PART.findall(value)} & BAD_NAMES - {"header", "meta", "tags"} else said
    if tag in GOOD_TAGS:
        return LANDMARK, 1
    if tag in BAD_TAGS or tag == "header" and inside != 1:
        return -LANDMARK, -1
    return max(-NAMED, min(NAMED, says)), inside


class _Tags:
    """Reads tags one after another; every byte is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.strict = page, True
        self.absent: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Like str.find; what is not found once is not looked for again."""
        if what in self.absent:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.absent.add(what)
        return k

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``, or a ``<`` in place of it; -1 if nowhere."""
        page, k = self.page, at
        while self.strict:
            k = _OUTSIDE.match(page, k).end()
            if k >= len(page):
                break
            if page[k] in "<>":
                return k
            k = page.find(page[k], k + 1) + 1
            if not k:
                break
        self.strict = False  # an unclosed quote: from here on quotes mean nothing
        return self.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(text before, tag with a slash if it closes, attributes); the last tag is empty."""
        page, at, n = self.page, 0, len(self.page)
        text: list[str] = []
        while m := _OPEN.search(page, at):
            text.append(page[at : m.start()])
            lead = m[0]
            if lead == "<!--":
                k = self.find("-->", m.end())
                at = k + 3 if k >= 0 else n
                continue
            if lead == "<![CDATA[":
                k = self.find("]]>", m.end())
                text.append(html.escape(page[m.end() : k if k >= 0 else n]))
                at = k + 3 if k >= 0 else n
                continue
            if lead in ("<!", "<?"):
                k = self.find(">", m.end())
                at = k + 1 if k >= 0 else n
                continue
            name_end = _NAME_END.search(page, m.end()).start()
            k = self.end(name_end)
            if k < 0:
                text.append(page[m.start() :])
                at = n
                break
            tag = page[m.start() + 1 : name_end].lower().partition("<")[0]
            yield "".join(text), tag, page[name_end:k]
            text.clear()
            at = k + (page[k] == ">")
            if tag in HIDDEN and not page[name_end:k].rstrip().endswith("/"):
                skip = self.closing(tag, at)
                at = skip if skip >= 0 else at if tag in ("head", "title") else n
        text.append(page[at:])
        yield "".join(text), "", ""

    def closing(self, tag: str, at: int) -> int:
        """Where the content of a raw element ends."""
        if tag in self.absent:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(self.page, at)
        if m is None:
            self.absent.add(tag)
            return -1
        return m.end()


def read(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page, in order, with white space turned into single spaces, and the elements around them."""
    blocks: list[Block] = []
    elements = [Element("", -1, 0, 0, 0, 0)]
    stack, is_open = [0], Counter()
    parts: list[str] = []
    linked, link_depth = 0, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, stack[-1], linked))
        parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link_depth
        while len(stack) > depth:
            is_open[elements[stack.pop()].tag] -= 1
        if len(stack) < link_depth:
            link_depth = 0

    for raw, tag, attrs in _Tags(page):
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_depth:
                linked += len(text.strip())
        if not tag or tag in HIDDEN:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                link_depth = 0
            elif tag in BLOCK:
                end_block()
                if is_open[tag]:
                    k = len(stack) - 1
                    while elements[stack[k]].tag != tag:
                        k -= 1
                    pop_to(k)
            continue
        if tag == "a":
            link_depth = len(stack)
        if tag in BLOCK:
            end_block()
            groups = elements[stack[-1]].groups
            for g, (members, _) in enumerate(GROUPS):
                if (g == 0 or tag in members) and elements[stack[-1]].groups >> g & 1:
                    k = len(stack) - 1
                    while elements[stack[k]].tag not in members:
                        k -= 1
                    pop_to(k)
            groups = elements[stack[-1]].groups
        if tag in VOID:
            parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        for g, (members, stops) in enumerate(GROUPS):
            if tag in stops:
                groups &= ~(1 << g)
            if tag in members:
                groups |= 1 << g
        parent = stack[-1]
        says, inside = _evidence(tag, attrs, elements[parent].inside)
        stack.append(len(elements))
        is_open[tag] += 1
        elements.append(Element(tag, parent, elements[parent].depth + 1, says, inside, groups))
    end_block()
    for b in blocks:
        elements[b.element].blocks += 1
    for e in reversed(elements[1:]):
        elements[e.parent].blocks += e.blocks
    return blocks, elements


def features(b: Block) -> tuple[int, int, int]:
    """Doublings of words (up to 64), share of links in eighths, ends like a sentence: few values each."""
    n = b.text.count(" ") + 1
    return min(n, 64).bit_length(), min(8, 8 * b.linked // len(b.text)), int(b.text[-1] in ".!?:;\"”»…")


def fit(cells: list[tuple], strength: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Weights by penalised logistic regression on counts ``(doublings, links, sentence, content, n)``; START without blocks of both labels."""
    y = np.array([c[3] for c in cells], float)
    n = np.array([c[4] for c in cells], float)
    if not len(cells) or not 0 < (y * n).sum() < n.sum():
        return START
    # Either label counts half, and all blocks together as much as a few hundred: the start keeps its say.
    n = np.where(y > 0, n / (y * n).sum(), n / ((1 - y) * n).sum()) * min(500.0, n.sum()) / 2
    x = np.array([(1, *c[:3]) for c in cells], float)
    w = START.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - strength * (w - START)
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        w = w + np.linalg.solve(curvature, gradient)
    return w


def graph(blocks: list[Block], elements: list[Element], weights: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Own capacities (blocks first, then elements; positive for content) and ties."""
    m, scale = len(blocks), weights.tolist()
    own = [max(LEAST, min(MOST, round(SCALE * sum(w * x for w, x in zip(scale, (1, *features(b)), strict=True))))) for b in blocks]
    own += [e.says * (1 + e.blocks) if e.blocks else 0 for e in elements]
    ties = {(i, m + b.element): TIE_ELEMENT for i, b in enumerate(blocks)}
    for k, e in enumerate(elements[1:], 1):
        if e.blocks:
            ties[m + e.parent, m + k] = TIE_PARENT * (1 + e.blocks)
    for i in range(1, m):
        a, b, apart = blocks[i - 1].element, blocks[i].element, 0
        while a != b:
            apart += 1
            if elements[a].depth >= elements[b].depth:
                a = elements[a].parent
            else:
                b = elements[b].parent
        ties[i - 1, i] = round(TIE_NEXT / (1 + apart / 2))
    return own, ties


def min_cut(scores: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Labels (True: content) that minimise the scores lost plus the ties cut; undecided nodes are boilerplate."""
    n = len(scores)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        if c:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    tied = [sum(x.values()) for x in near]
    own, label = list(scores), [None] * n
    follows: list[tuple[int, int]] = []
    gone = [False] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if gone[i]:
            continue
        if abs(own[i]) >= tied[i]:
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                tied[j] -= near[j].pop(i)
                queue.append(j)
        elif len(near[i]) == 1:
            (j, c), = near[i].items()
            own[j] += own[i]
            tied[j] -= near[j].pop(i)
            follows.append((i, j))
            queue.append(j)
        elif len(near[i]) == 2 and own[i] == 0:
            (j, c), (k, d) = near[i].items()
            both = min(c, d)
            for a, b in ((j, k), (k, j)):
                tied[a] += both - near[a].pop(i)
                near[a][b] = near[a].get(b, 0) + both
                queue.append(a)
            follows.append((i, j if c >= d else k))
        else:
            continue
        gone[i], near[i], tied[i] = True, {}, 0
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        for i, side in zip(rest, _source_side([own[i] for i in rest], [{at[j]: c for j, c in near[i].items()} for i in rest]), strict=True):
            label[i] = side
    for i, j in reversed(follows):
        label[i] = label[j]
    return [bool(x) for x in label]


def _source_side(own: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Maximum flow from the content terminal to the boilerplate terminal by blocking flows; which nodes the source still reaches."""
    n = len(own)
    s, t = n, n + 1
    cap: list[dict[int, int]] = [dict(x) for x in near] + [{}, {}]
    for i, c in enumerate(own):
        a, b = (s, i) if c > 0 else (i, t)
        cap[a][b] = abs(c)
        cap[b].setdefault(a, 0)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 0 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        todo = [iter(list(cap[u])) for u in range(n + 2)]
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= flow
                    cap[b][a] += flow
                k = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if cap[a][b] == 0)
                del path[k + 1 :]
                continue
            v = next((v for v in todo[u] if cap[u][v] > 0 and level[v] == level[u] + 1), None)
            if v is None:
                path.pop()
            else:
                path.append(v)


def main_blocks(page: str | None, weights: np.ndarray = START) -> tuple[list[str], int, int]:
    """The blocks of a page that the minimum cut calls content, the number of all, and of those that their own score would label otherwise."""
    blocks, elements = read(page) if page else ([], [])
    if not blocks:
        return [], 0, 0
    own, ties = graph(blocks, elements, weights)
    keep = min_cut(own, ties)
    return [b.text for b, k in zip(blocks, keep, strict=False) if k], len(blocks), sum((own[i] > 0) != keep[i] for i in range(len(blocks)))


def main_text(page: str | None, weights: np.ndarray = START) -> str:
    """The main text of a page: its blocks joined by empty lines."""
    return "\n\n".join(main_blocks(page, weights)[0])


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells: Counter = Counter()
        for page in batch.column(0).to_pylist():
            blocks, elements = read(page)
            for b in blocks:
                e = elements[b.element]
                if e.inside:
                    cells[*features(b), int(e.inside > 0)] += 1
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array([*(k[i] for k in cells)], pa.int32()) for i in range(4)] + [pa.array(list(cells.values()), pa.int64())], names=["a", "b", "c", "content", "n"])


def learn(pages: DataFrame, train_pages: int = 400) -> np.ndarray:
    """Weights from the landmarks of about ``train_pages`` distinct pages of ``pages(html)``, chosen by hash.

    Only counts of feature values, some hundred at most, reach the driver.
    """
    rows = pages.count()
    share = min(1.0, train_pages / rows) if rows else 0.0
    u = F.shiftrightunsigned(F.xxhash64("html"), 11).cast("double") / float(2**53)
    chosen = pages.where(F.col("html").isNotNull()).withColumn("u", u).where(F.col("u") <= share).groupBy("u").agg(F.first("html").alias("html"))
    cells = chosen.select("html").mapInArrow(_count_cells, "a int, b int, c int, content int, n long").groupBy("a", "b", "c", "content").agg(F.sum("n").alias("n"))
    return fit(sorted(tuple(r) for r in cells.collect()))


def extract(df: DataFrame, train_pages: int = 400) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_changed) of each row of ``df(page_id, url, html)``.

    ``n_changed``: blocks to which the cut gave another label than their own score.
    """
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = learn(pages, train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(x, weights) for x in batch.column(2).to_pylist()]
            texts = ["\n\n".join(t) for t, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([c for *_, c in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_changed"],
            )

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_changed long")
