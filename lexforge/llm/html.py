"""Main text of web pages by tag-path ratios.

Every text node has a path of tags (with their class names) from the root. For
each path of a page the length of its texts and their punctuation are summed and
divided by its nodes: prose paths have long, punctuated nodes, menus short ones
without. Text and punctuation ratios are fused into one score, smoothed over the
page's node order, and weighed by what the tags and names on the path say. Paths
above the page's threshold are content. The container that holds most of the
content then takes in the short nodes inside it (headlines, one-word
paragraphs), but not the parts whose names mark them and whose scores stay below
the threshold, nor lists of links; blocks on other content paths stay, unless
the page declares its article.

Paths are integers of a trie that is built in one pass over the page, and sums
go up the trie once, so the time is linear in the page, however deep or broken
its markup is.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lexforge.runtime import bounded_batches, col, fresh, map_arrow

#: Elements that are never part of an article (a form is not, either, unless it encloses the page's prose), and those that have no end tag; fixed by HTML.
NEVER = frozenset("head script style noscript template nav header footer aside button select option textarea input label iframe object svg canvas video audio dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title")}
INLINE = frozenset("p b i em strong span a u pre font h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl div section table tbody tr".split())
DECLARED = ("article", "main")
#: Words in class, id or role that mark a part around the article; words that say nothing about it; words that turn a header into the article's own.
MARKING = re.compile(
    r"ads?|advert\w*|banners?|promo\w*|sponsor\w*|nav\w*|menus?|breadcrumbs?|sidebars?|header|masthead|footer|cookies?\w*|consent|gdpr|notices?|notifications?|alerts?|popup|modal|newsletter|signup|subscribe|share|sharing|social|related|recommend\w*|teasers?|comments?|disqus|replies|reply|respond|complementary|contentinfo|search|login|pagination|pager|toolbar|widgets?",
    re.I,
)
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button card cards column container content entry footer form global group header image images inner item items left link links list main name outer page panel post posts right section site story text thread title top unit wrap wrapper".split()
)
HEADS = frozenset(("article", "entry", "post", "story"))
#: Words before a mark that say what a wrapper has beside the article, not that it is around it.
BESIDE = re.compile(r"(?:^|[\s_-])(?:has|with|no|without)[_-]+[\w-]*", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that an opening tag closes when they are open beneath their nearest container.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
OPENING = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
#: Elements of running text, and words of the line at a page's end that is none.
PROSE = frozenset("p blockquote pre h1 h2 h3".split())
COPYRIGHT = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)
#: Headings and names of lists of links that belong to an article, and how long links without punctuation are in others.
REFERENCES = re.compile(r"\b(?:references?|refs?|sources?|bibliograph\w*|citations?|cited|footnotes?|endnotes?|notes|literature|further reading|external links|quellen\w*|literatur\w*|einzelnachweise|références|sources|bibliografía|referencias|fuentes)\b", re.I)
LONG_LINK = 30
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Standard deviation of the smoothing over nodes, share of the mean score that content paths reach, and their least score.
SMOOTHING, THRESHOLD, FLOOR = 1.0, 0.5, 0.5
#: Weights of a path: under a declared article, under names that only mark, and under names that mark among other words.
ARTICLE, MARKED, MIXED = 3.0, 0.01, 0.6
#: Share of the content's characters that the container holds, share of linked characters from which a path is no prose, and the links and their share that make a list of links.
COVER, LINKED, LINKS, LINK_SHARE = 0.8, 0.5, 3, 0.9


class Paths:
    """The tag paths of one page as a trie; a path's number is larger than its parent's."""

    def __init__(self):
        self._known: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.outside, self.linked, self.declared, self.mark = [0], [""], [False], [False], [False], [0.0]

    def __len__(self) -> int:
        return len(self.parent)

    def step(self, at: int, tag: str, names: str, hidden: bool) -> int:
        key = (at, f"{tag}.{names}!" if hidden else f"{tag}.{names}")
        path = self._known.get(key)
        if path is None:
            path = self._known[key] = len(self.parent)
            inside = self.declared[at]
            # A heading group inside the article belongs to it.
            never = hidden or tag in NEVER and not (tag == "header" and inside)
            self.parent.append(at)
            self.tag.append(tag)
            self.outside.append(self.outside[at] or never)
            self.linked.append(self.linked[at] or tag == "a")
            self.declared.append(inside or tag in DECLARED)
            self.mark.append(0.0 if tag in ("html", "body", *DECLARED) else marking(names, inside))
        return path

    def sums(self, own: list) -> list:
        """Of each path, the sum over all paths that begin with it."""
        out = list(own)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out


def marking(names: str, inside: bool) -> float:
    """The weight of an element's names if they mark it as a part around the article, else 0."""
    found = 0.0
    for name in BESIDE.sub(" ", names).split() if names else ():
        words = [w.lower() for w in WORD.findall(name)]
        marks = {w for w in words if MARKING.fullmatch(w)}
        if not marks or marks == {"header"} and (inside or HEADS.intersection(words)):
            continue
        found = MARKED if all(w in marks or w in NEUTRAL for w in words) else max(found, MIXED) if found != MARKED else found
    return found


def _attributes(said: str) -> tuple[str, bool]:
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(said):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() in ("class", "id", "role"):
            names.append(value)
        elif m[1].lower() == "style":
            hidden = hidden or UNSEEN.search(value) is not None
        elif m[1].lower() == "hidden" or value.lower() == "true":
            hidden = True
    return " ".join(names), hidden


class TagEnds:
    """Where tags end: at the first > outside quotes; where a quote is never closed, at the first > of all.

    What follows an opening quote is found once, so that all tags of a page are
    read in linear time.
    """

    def __init__(self, page: str):
        self._page, self._after, self._unclosed = page, {}, {}

    def _close(self, at: int) -> int:
        quote = self._page[at]
        if at >= self._unclosed.get(quote, len(self._page)):
            return -1
        close = self._page.find(quote, at + 1)
        if close < 0:
            self._unclosed[quote] = at
        return close

    def end(self, start: int) -> int:
        """The place of the > of a tag whose name ends at ``start``, or -1."""
        at, passed = start, []
        while True:
            m = STOP.search(self._page, at)
            if m is None or m[0] == ">":
                found = m.start() if m else -1
                break
            if m.start() in self._after:
                found = self._after[m.start()]
                break
            passed.append(m.start())
            close = self._close(m.start())
            if close < 0:
                found = -1
                break
            at = close + 1
        self._after.update(dict.fromkeys(passed, found))
        return found if found >= 0 else self._page.find(">", start)


class _Open:
    """The open elements: by their order, and where each tag and each block is open."""

    def __init__(self, paths: Paths):
        self._paths, self._tags, self._at, self._by_tag, self._blocks = paths, [], [], defaultdict(list), []

    @property
    def path(self) -> int:
        return self._at[-1] if self._at else 0

    def last(self, tags) -> int:
        return max((self._by_tag[t][-1] for t in tags if self._by_tag.get(t)), default=-1)

    def last_block(self) -> int:
        return self._blocks[-1] if self._blocks else -1

    def push(self, tag: str, names: str, hidden: bool) -> None:
        self._at.append(self._paths.step(self.path, tag, names, hidden))
        self._by_tag[tag].append(len(self._tags))
        if tag in BLOCKS:
            self._blocks.append(len(self._tags))
        self._tags.append(tag)

    def cut(self, to: int) -> None:
        while len(self._tags) > to:
            tag = self._tags.pop()
            self._at.pop()
            self._by_tag[tag].pop()
            if tag in BLOCKS:
                self._blocks.pop()

    def close(self, tag: str) -> None:
        at = self.last((tag,))
        # An inline end tag does not reach out of its block; that of a list of options does, as theirs may be left out.
        if at >= 0 and (tag in BLOCKS or tag in NEVER or at > self.last_block()):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """End what an opening tag ends."""
        if tag == "body":
            while self._tags and self._tags[-1] != "html":
                self.cut(len(self._tags) - 1)
        elif tag in BLOCKS and tag != "html":
            # A paragraph, and what is open in it, ends where a block begins.
            at = self.last(("p",))
            if at >= 0 and at == self.last_block():
                self.cut(at)
        if tag in CLOSES:
            at = self.last(CLOSES[tag])
            while at > self.last(KEEPS[tag]):
                self.cut(at)
                at = self.last(CLOSES[tag]) if tag == "tr" else -1


def nodes(page: str) -> tuple[Paths, list[tuple[int, int, str]]]:
    """The paths of a page and its text nodes (path, block, text) in page order; broken markup is put up with."""
    paths, out = Paths(), []
    stack, ends, last = _Open(paths), TagEnds(page), page.rfind(">")
    block, begun, at, end = 0, 0, 0, len(page)

    def text(upto: int) -> None:
        if upto > begun:
            out.append((stack.path, block, html.unescape(page[begun:upto])))

    while True:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            break
        if page.startswith("<!--", at):
            text(at)
            close = page.find("-->", at + 4)
            begun = at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            text(at)
            begun = at = page.find(">", at) + 1
            continue
        m = OPENING.match(page, at)
        if not m:
            at += 1
            continue
        text(at)
        close = ends.end(m.end())
        said, tag = page[m.end() : close], m[2].lower()
        begun = at = close + 1
        if tag == "br":
            out.append((stack.path, block, " "))
            continue
        if tag in BLOCKS:
            block += 1
        if m[1]:
            stack.close(tag)
            continue
        stack.make_room(tag)
        if tag in VOID or said.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            over = RAW[tag].search(page, at)
            close = page.find(">", over.end()) if over else -1
            begun = at = close + 1 if close >= 0 else end
            continue
        stack.push(tag, *(_attributes(said) if said else ("", False)))
    text(end)
    return paths, out


def _smoothed(values: list[float]) -> list[float]:
    reach = int(3 * SMOOTHING)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SMOOTHING**2))
    centre = slice(reach, reach + len(values))
    return (np.convolve(values, kernel)[centre] / np.convolve(np.ones(len(values)), kernel)[centre]).tolist()


def path_scores(paths: Paths, inside: list[tuple[int, int, str]]) -> dict[int, float]:
    """Fused and smoothed text and punctuation ratios of each path, before weights."""
    sums: dict[int, list[float]] = {}
    for path, _, text in inside:
        s = sums.setdefault(path, [0, 0, 0])
        if not paths.linked[path]:
            s[0] += len(text.strip())
            s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    # One mark more than there is, so that unpunctuated prose counts by its length.
    fused = {p: math.sqrt(chars / n * (1 + marks / n)) for p, (chars, marks, n) in sums.items()}
    totals = dict.fromkeys(fused, 0.0)
    for (path, *_), v in zip(inside, _smoothed([fused[x[0]] for x in inside]), strict=True):
        totals[path] += v
    return {p: math.sqrt(fused[p] * t / sums[p][2]) for p, t in totals.items()}


def leave_forms(paths: Paths, inside: list[tuple[int, int, str]]) -> list[bool]:
    """Which paths are in a form that is a part of the page.

    A form round the page, as some frameworks write it, is none: one that holds
    every declared article, or else the greater part of the prose.
    """
    n, forms = len(paths), [k for k in range(len(paths)) if paths.tag[k] == "form"]
    out = [False] * n
    if not forms:
        return out
    prose = [0] * n
    for path, _, text in inside:
        prose[path] += len(text.strip()) if not paths.linked[path] and PUNCTUATION.search(text) else 0
    under, articles = paths.sums(prose), _declared(paths)
    part = {k for k in forms if not (articles[k] == articles[0] if articles[0] else 2 * under[k] > under[0])}
    for k in range(1, n):
        out[k] = out[paths.parent[k]] or k in part
    return out


def _declared(paths: Paths) -> list[int]:
    """Of each path, how many declared articles begin with it."""
    return paths.sums([int(paths.tag[k] in DECLARED and not paths.outside[k] and not paths.mark[k]) for k in range(len(paths))])


def _unmarked_prose(paths: Paths, inside: list[tuple[int, int, str]]) -> bool:
    """Whether there is running text under no name that marks."""
    clean = [True] * len(paths)
    for k in range(1, len(paths)):
        clean[k] = clean[paths.parent[k]] and not paths.mark[k]
    return any(clean[p] and not paths.linked[p] and (paths.tag[p] in PROSE or paths.tag[paths.parent[p]] in PROSE) and PUNCTUATION.search(t) and not COPYRIGHT.search(t) for p, _, t in inside)


def path_weights(paths: Paths, inside: list[tuple[int, int, str]], chars: list[int]) -> tuple[list[float], list[bool]]:
    """What the tags and names on each path say of it, and whether its last step's names mark it.

    The names of an element that encloses the article do not count. It does if
    it holds every declared article and the greater part of the page's text, or,
    where none is declared, ``COVER`` of that text, and no running text of the
    page is free of such names: comments may be longer than the article.
    """
    under, n = paths.sums(chars), len(paths)
    articles = _declared(paths)
    free = not articles[0] and any(paths.mark) and _unmarked_prose(paths, inside)
    out, marked = [1.0] * n, [False] * n
    for k in range(1, n):
        p = paths.parent[k]
        wraps = articles[k] == articles[0] and 2 * under[k] > under[0] if articles[0] else not free and under[k] >= COVER * under[0]
        marked[k] = paths.mark[k] > 0 and not wraps
        out[k] = out[p] * (paths.mark[k] if marked[k] else 1.0) * (ARTICLE if paths.declared[k] and not paths.declared[p] else 1.0)
    return out, marked


def _container(paths: Paths, chars: list[int]) -> int:
    """The deepest path that still covers most of the content's characters, above the paragraphs themselves."""
    under, depth, best = paths.sums(chars), [0] * len(paths), 0
    for k in range(1, len(paths)):
        depth[k] = depth[paths.parent[k]] + 1
        if under[k] >= COVER * under[0] and depth[k] > depth[best] and paths.tag[k] not in INLINE:
            best = k
    # An element that is declared as the article holds all of it, lists and tables, too.
    top = best
    while top and paths.tag[top] not in DECLARED:
        top = paths.parent[top]
    return top or best


def _references(paths: Paths, inside: list[tuple[int, int, str]]) -> list[bool]:
    """Paths of links in a declared article that are references: punctuated or long ones, and those under a heading that says so."""
    n, heading = len(paths), False
    said, chars, links = [0] * n, [0] * n, [0] * n
    for path, _, text in inside:
        if re.fullmatch("h[1-6]", paths.tag[path]):
            heading = REFERENCES.search(text) is not None
        elif paths.linked[path] and paths.declared[path]:
            links[path] += 1
            chars[path] += len(text.strip())
            said[path] += 1 if heading or PUNCTUATION.search(text) else 0
    said, chars, links = paths.sums(said), paths.sums(chars), paths.sums(links)
    return [links[k] > 0 and (2 * said[k] > links[k] or chars[k] >= LONG_LINK * links[k]) for k in range(n)]


def _left_out(paths: Paths, marked: list[bool], score: list[float], chars: list[int], linked: list[int], nodes_: list[int], least: float, references: list[bool]) -> list[bool]:
    """Paths under names that mark and with scores under ``least``, and lists of nothing but links that are no references."""
    total, all_, links, count = paths.sums([s * c for s, c in zip(score, chars, strict=True)]), paths.sums(chars), paths.sums(linked), paths.sums(nodes_)
    out = [False] * len(paths)
    for k in range(1, len(paths)):
        poor = total[k] < least * all_[k]
        menu = not references[k] and paths.tag[k] in LISTS and count[k] >= LINKS and links[k] >= LINK_SHARE * all_[k]
        out[k] = out[paths.parent[k]] or poor and (marked[k] or menu)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by line ends; empty if there is none."""
    paths, found = nodes(page or "")
    found = [x for x in found if not paths.outside[x[0]]]
    inside = [x for x in found if x[2].strip()]
    in_form = leave_forms(paths, inside)
    found, inside = ([x for x in y if not in_form[x[0]]] for y in (found, inside))
    if not inside:
        return ""
    n = len(paths)
    chars, linked, count = [0] * n, [0] * n, [0] * n
    for path, _, text in inside:
        size = len(text.strip())
        chars[path] += size
        linked[path] += size if paths.linked[path] else 0
        count[path] += 1 if paths.linked[path] else 0
    weight, marked = path_weights(paths, inside, chars)
    score = [0.0] * n
    for path, s in path_scores(paths, inside).items():
        score[path] = s * weight[path]
    sure = [c * w for c, w in zip(chars, weight, strict=True)]
    least = max(THRESHOLD * sum(s * c for s, c in zip(score, sure, strict=True)) / max(sum(sure), 1e-9), FLOOR)
    content = {p for p, *_ in inside if score[p] >= least and linked[p] < LINKED * chars[p]}
    if not content and not (content := {p for p, *_ in inside if weight[p] >= 1}):
        return ""
    top = _container(paths, [c if p in content else 0 for p, c in enumerate(chars)])
    bare = paths.tag[top] in ("", "html", "body")
    dropped = _left_out(paths, marked, score, chars, linked, count, least, _references(paths, inside))
    holds = _below(paths, top)
    above, k = {top}, top
    while k:
        k = paths.parent[k]
        above.add(k)
    blocks: dict[int, list[tuple[int, str]]] = {}
    for path, block, text in found:
        if path in content or not dropped[path]:
            blocks.setdefault(block, []).append((path, text))

    def headline(path: int) -> bool:
        """Whether a node outside the content paths heads the content: a title beside or above the container."""
        return paths.tag[path] == "h1" and paths.parent[path] in above or bare and re.fullmatch("h[1-6]", paths.tag[path]) is not None

    def wanted(block: list[tuple[int, str]]) -> bool:
        if any(headline(p) for p, _ in block):
            return True
        if not bare:
            if any(holds[p] for p, _ in block):
                return True
            # Content beside the container stays, unless an element is declared as the article.
            if paths.declared[top]:
                return False
        # Outside a container a block goes by the greater part of it, so that what is set off inside a paragraph stays.
        return 2 * sum(len(t.strip()) for p, t in block if p in content) > sum(len(t.strip()) for _, t in block)

    lines = [" ".join("".join(t for _, t in block).split()) for _, block in sorted(blocks.items()) if wanted(block)]
    return "\n".join(x for x in lines if x)


def _below(paths: Paths, top: int) -> list[bool]:
    out = [False] * len(paths)
    out[top] = True
    for k in range(top + 1, len(paths)):
        out[k] = out[paths.parent[k]]
    return out


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without its html, with text (never null) and n_chars (long).

    A null or empty page gives an empty text. Every page is treated on its own,
    so repeated rows and empty tables need no rule. Columns already named text
    or n_chars are replaced.
    """
    made = {"text", "n_chars", html_column.lower()}
    kept, raw = [c for c in pages.columns if c.lower() not in made], fresh(pages, "html")
    schema = StructType([*(pages.schema[c] for c in kept), *StructType.fromDDL("text string, n_chars bigint").fields])

    def run(batches):
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return map_arrow(bounded_batches(pages.select(*map(col, kept), col(html_column).cast("string").alias(raw))), run, schema)
