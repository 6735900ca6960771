"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is read into its block elements. Each has features of its own tag and attribute tokens, of its subtree (text, tags,
links, density), of its depth and of its siblings; boosted trees give it a probability to be inside the main text, outside
of it, or mixed (a wrapper of both). The decoder then picks the most probable states for the whole tree at once, by
dynamic programming from the leaves, among those that don't contradict each other: below an outside node all is outside,
below an inside node nothing is mixed. The text is that of the inside nodes.

The model is trained where it is used, on `training_pages` pages that training.py makes up with known states: a bounded
sample that doesn't grow with the input. Scripts, styles, templates, comments and head elements never enter the tree.

Edge cases: a null or empty page has an empty text; unclosed and truncated markup is closed at the end of the page;
a null id or URL is carried along; repeated rows give equal texts; an empty table gives no rows; texts are neither cut nor
capped. Columns other than id, URL and html are not carried.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm import boosting
from sparsefold.llm.common import read

NAME = "op1_html_text"

#: Elements by what they do to the text, and attribute tokens that tend to mark one side or the other.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("button canvas datalist head iframe math noembed noframes noscript object option script select style svg template textarea title video audio".split())
RAW = frozenset("script style textarea title noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
TAG_GROUPS = (frozenset({"nav", "menu"}), frozenset({"footer"}), frozenset({"aside"}), frozenset({"header"}), frozenset({"form", "fieldset", "dialog"}), frozenset({"article", "main"}), frozenset({"p", "blockquote", "pre"}), frozenset({"h1", "h2", "h3", "h4", "h5", "h6"}), frozenset({"li", "ul", "ol", "dl", "dd", "dt"}), frozenset({"div", "section"}), frozenset({"table", "tr", "td", "th", "tbody", "thead"}), frozenset({"html", "body"}))
AGAINST = frozenset("ad ads adv advert advertisement banner bar bottom breadcrumb breadcrumbs byline categories comment comments consent contact cookie cookies copyright cta discussion disqus footer form gdpr header hidden login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup privacy promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar top trending warning widget".split())
FOR = frozenset("article articlebody body content entry main page post story text".split())

#: Fixed value: what short texts of comments, notices and sign-up boxes tend to say.
CUES = re.compile(r"\b(?:[0-9]+ (?:comments?|replies|responses|thoughts)|comments?:?$|says\b|wrote:|replied|reply\b|log in|sign (?:in|up)|leave a|cookies?\b|consent|privacy|accept|subscribe|newsletter|notifications?)", re.I)
CONTROLS = frozenset("button input select textarea label".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^"'>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")

IN, OUT, MIXED = range(3)
#: Pages whose nodes are scored at a time.
BLOCK = 256


@dataclass
class Page:
    """Block elements in page order; node 0 is the page itself. runs: (node, text) in page order, node -1 a break."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    attributes: list[str] = field(default_factory=lambda: [""])
    start: list[int] = field(default_factory=lambda: [0])
    tags: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    stops: list[int] = field(default_factory=lambda: [0])
    legal: list[int] = field(default_factory=lambda: [0])
    cues: list[int] = field(default_factory=lambda: [0])
    controls: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)
    length: int = 0


def parse(source: str) -> Page:
    """Read a page into its block elements and text runs."""
    page = Page(length=len(source))
    stack, linked, at, size = [0], False, 0, len(source)
    opened: Counter[str] = Counter()
    ends: dict[str, dict[int, int]] = {}
    parent, tags, attrs, starts, counts, chars, links, stops, legal, runs = page.parent, page.tag, page.attributes, page.start, page.tags, page.chars, page.linked, page.stops, page.legal, page.runs
    cues, controls = page.cues, page.controls

    def text(a: int, b: int) -> None:
        s = source[a:b]
        node = stack[-1]
        if "&" in s:
            s = entities.unescape(s)
        runs.append((node, s))
        n = len(s) if not s.isspace() else 0
        chars[node] += n
        stops[node] += s.count(".") + s.count(",")
        if n < 200 and ("\u00a9" in s or "opyright" in s):
            legal[node] += 1
        if 0 < n < 160 and CUES.search(s):
            cues[node] += 1
        if linked:
            links[node] += n

    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            text(at, size)
            break
        if m.start() > at:
            text(at, m.start())
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        counts[stack[-1]] += 1
        if name in CONTROLS and not m[1]:
            controls[stack[-1]] += 1
        if m[1]:  # an end tag
            if name == "a":
                linked = False
            elif name in BLOCKS:
                runs.append((-1, ""))
                if opened[name]:
                    while (popped := tags[stack.pop()]) != name:
                        opened[popped] -= 1
                    opened[name] -= 1
                    linked = False
        elif name in SKIPPED:
            if name in RAW:
                closing = _closing(name).search(source, at)
                at = closing.end() if closing else size
            elif not m[3].endswith("/"):
                if name not in ends:
                    ends[name] = _ends(source, name)
                at = ends[name].get(at, at)
            runs.append((-1, ""))
        elif name in BLOCKS:
            runs.append((-1, ""))
            closed = CLOSES.get(name, ())
            while tags[stack[-1]] == "p" or tags[stack[-1]] in closed:
                opened[tags[stack.pop()]] -= 1
            if name in VOID:
                continue
            opened[name] += 1
            parent.append(stack[-1])
            stack.append(len(tags))
            tags.append(name)
            attrs.append(m[3])
            starts.append(m.start())
            for column in (counts, chars, links, stops, legal, cues, controls):
                column.append(0)
        elif name == "a":
            linked = True
        elif name == "br":
            runs.append((-1, ""))
    return page


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I)


def _ends(source: str, name: str) -> dict[int, int]:
    """From where each element of a skipped kind opens to where it ends, in one pass; unclosed ones aren't in it, so only
    their tags are skipped. A head without an end is one of these."""
    found, waiting = {}, []
    for m in re.finditer(rf"<(/?){name}\b[^>]*+(?:>|\Z)", source, re.I):
        if not m[1]:
            waiting.append(m.end())
        elif waiting:
            found[waiting.pop()] = m.end()
    return found


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[int, int]:
    """How many attribute tokens speak against and for a node."""
    words = [w for found in ATTRIBUTE.findall(attributes) for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found)).lower())]
    return sum(w in AGAINST for w in words), sum(w in FOR for w in words)


def _group(tag: str) -> int:
    return next((i for i, g in enumerate(TAG_GROUPS) if tag in g), -1)


GROUP = {t: _group(t) for t in BLOCKS} | {"": -1}
FEATURES = len(TAG_GROUPS) + 40


def features(page: Page) -> list[list[float]]:
    """One row per node: tag group, attribute tokens, subtree density, depth and sibling statistics."""
    n, parent = len(page.tag), page.parent
    tags, chars, linked, stops, legal = page.tags[:], page.chars[:], page.linked[:], page.stops[:], page.legal[:]
    cues, controls = page.cues[:], page.controls[:]
    nodes, paragraphs, children, kin = [1] * n, [t == "p" for t in page.tag], [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        tags[p] += tags[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        legal[p] += legal[i]
        cues[p] += cues[i]
        controls[p] += controls[i]
        nodes[p] += nodes[i]
        paragraphs[p] += paragraphs[i]
        children[p] += 1
    depth, place, against, favour, bad, good, same = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, {}
    for i in range(n):
        bad[i], good[i] = _marks(page.attributes[i]) if page.attributes[i] else (0, 0)
        if i:
            p = parent[i]
            depth[i], place[i] = depth[p] + 1, kin[p]
            kin[p] += 1
            edge = GROUP[page.tag[p]]
            against[i] = against[p] + bad[p] + (0 <= edge <= 4)
            favour[i] = favour[p] + good[p] + (edge == 5)
            same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    whole, rows, log = max(1, chars[0]), [], math.log1p
    before, after, last, largest = [0] * n, [0] * n, {}, [0] * n  # node 0 stands for no sibling
    for i in range(1, n):
        p = parent[i]
        before[i] = last.get(p, 0)
        after[before[i]], last[p] = i, i
        largest[p] = max(largest[p], chars[i])
    dense = [linked[i] / max(1, chars[i]) for i in range(n)]
    for i in range(n):
        p = max(parent[i], 0)
        c, group = chars[i], GROUP[page.tag[i]]
        row = [0.0] * FEATURES
        if group >= 0:
            row[group] = 1.0
        siblings = children[p] if i else 1
        row[len(TAG_GROUPS) :] = (
            bad[i], good[i], against[i], favour[i], depth[i], place[i], place[i] / siblings, siblings, same[p, page.tag[i]] / siblings if i else 1.0,
            log(c), log(page.chars[i]), c / whole, c / max(1, chars[p]), c / (1 + tags[i]), linked[i] / max(1, c), stops[i] / max(1, c), log(paragraphs[i]), log(nodes[i]),
            c / nodes[i], page.start[i] / max(1, page.length), chars[p] / nodes[p], children[i], legal[i] / nodes[i],
            *(f for s in (before[i], after[i]) for f in ((log(chars[s]), dense[s], GROUP[page.tag[s]], chars[s] / nodes[s]) if i and s else (-1.0, -1.0, -2.0, -1.0))),
            dense[p], c / max(1, largest[p]) if i else 1.0, log(largest[p]),
            cues[i] / nodes[i], controls[i] / nodes[i], cues[before[i]] / nodes[before[i]] if i and before[i] else -1.0, cues[after[i]] / nodes[after[i]] if i and after[i] else -1.0, cues[p] / nodes[p], page.cues[i],
        )
        rows.append(row)
    return rows


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The difference of log-probabilities up to which a heading's own score is no proof.
UNSURE = 3.0


def with_headings(page: Page, scores: np.ndarray) -> np.ndarray:
    """Scores in which a heading, or a block of nothing but one, leans on what it heads: the more inside one of the next two
    siblings that have text, unless its own scores are clear."""
    n = len(page.tag)
    chars, children, below = page.chars[:], [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        children[page.parent[i]] += 1
        below[page.parent[i]] = i
    out = scores.copy()
    nexts: dict[int, list[int]] = {}
    for i in range(n - 1, 0, -1):
        ahead = nexts.setdefault(page.parent[i], [])
        heads = page.tag[i] in HEADINGS or children[i] == 1 and page.tag[below[i]] in HEADINGS and not page.chars[i]
        if heads and ahead:
            headed = max(ahead[-2:], key=lambda k: scores[k, IN])
            for k in {i, below[i]} if children[i] == 1 else {i}:
                if abs(scores[k, IN] - scores[k, OUT]) <= UNSURE:
                    out[k, [IN, OUT]] = (scores[k, [IN, OUT]] + 2 * scores[headed, [IN, OUT]]) / 3
        if chars[i] and not heads:
            ahead.append(i)
    return out


def decode(parent: list[int], scores: np.ndarray) -> list[int]:
    """The states with the highest sum of log-probabilities among those that don't contradict along the tree."""
    best = scores.tolist()
    n = len(parent)
    for i in range(n - 1, 0, -1):
        inside, outside, mixed = best[i]
        up = best[parent[i]]
        up[IN] += inside if inside > outside else outside
        up[OUT] += outside
        up[MIXED] += max(inside, outside, mixed)
    states = [0] * n
    allowed = {IN: (IN, OUT), OUT: (OUT,), MIXED: (IN, OUT, MIXED)}
    for i in range(n):
        among = allowed[states[parent[i]]] if i else (MIXED, IN, OUT)
        states[i] = max(among, key=best[i].__getitem__)
    return states


def text_of(page: Page, states: list[int]) -> str:
    """The text of the inside nodes: one space for each run of white space and between blocks."""
    out = []
    for node, s in page.runs:
        if node < 0:
            out.append(" ")
        elif states[node] == IN:
            out.append(s)
    return " ".join("".join(out).split())


def extract(sources: list[str | None], model: boosting.Boosted) -> list[str]:
    """Main texts of some pages."""
    texts = []
    for at in range(0, len(sources), BLOCK):
        pages = [parse(s or "") for s in sources[at : at + BLOCK]]
        scores = model.log_probabilities(np.array([row for p in pages for row in features(p)]))
        ends = np.cumsum([len(p.tag) for p in pages])
        for p, s in zip(pages, np.split(scores, ends[:-1]), strict=True):
            # a page without block elements is all text
            texts.append(text_of(p, decode(p.parent, with_headings(p, s)) if len(p.tag) > 1 else [IN]))
    return texts


@lru_cache(maxsize=2)
def trained(training_pages: int = 1500, seed: int = 11) -> boosting.Boosted:
    """The model, fitted on made-up pages; some ten seconds, once per process."""
    from sparsefold.llm.training import labelled_pages

    rows, states = [], []
    for source in labelled_pages(training_pages, seed):
        page = parse(source)
        rows += features(page)
        states += known_states(page)
    x, y = np.array(rows), np.array(states)
    return boosting.fit(x[y >= 0], y[y >= 0], classes=3, trees=80, rate=0.2, share=0.35)


def known_states(page: Page) -> list[int]:
    """The states that a made-up page carries; -1 for nodes that it has none for. Text outside of all elements is inside."""
    found = [re.search(r'data-state="(\w+)"', a) for a in page.attributes]
    states = [{"in": IN, "out": OUT, "mixed": MIXED}[m[1]] if m else -1 for m in found]
    states[0] = IN if page.chars[0] else MIXED
    return states


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = 1500) -> DataFrame:
    """Per row: id, URL, text and n_chars."""
    model = trained(training_pages)
    kinds = dict(df.select(F.col(id_col), F.col(url_col)).dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint"

    def run(batches):
        for batch in batches:
            texts = extract(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return df.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_texts(read(spark, sf_dir, "pages"))
