"""Main-text extraction from web pages by tag-path ratios (operator 9).

A page becomes a sequence of text blocks, each with its root-to-leaf tag path (inline
formatting does not count; divisions and sections count with their class).  Text length,
punctuation and link text are aggregated per path; a path's ratio is the root of its
characters a block times the root of one more than its marks a block.  Ratios are smoothed
over neighbouring blocks of the same part of the page (siblings, or where the parent of
one is above the other and not the page's body), and a path has its best block's value,
less the share of link text.  That is fused with what the markup declares, as a weight:
``DECLARED`` in article and main, where these hold half of the text, and then ``BESIDE``
for all else; ``REJECTED`` for menus, headers, footers, sidebars, notices, adverts, forms
and comments, by element, role, class or id; 1 without a declaration.  A path is content
if its weighted ratio reaches ``share`` of the best ratio without a weight (of parts that
are not rejected; with none there is no text).  A heading goes with the block after it.

Scripts, styles, hidden elements and other text that no page shows are no blocks at all.
A rejected inline element rejects its own text.  Character references are decoded, white
space inside a block becomes one space, and blocks are joined in page order by line feeds.
Null and empty html gives an empty text, an empty table an empty result; rows that repeat
are extracted each for itself; columns beside page_id, url and html are ignored, whatever
their names.  Of paths with equal ratios all stay or none.  Time is linear in the page,
however long it is or deep its elements are.  Row-local: no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from clausemill.llm.common import steps

#: Element names by role.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
UNSEEN = frozenset("head script style textarea title noscript iframe template svg canvas button select option object audio video".split())
REJECTS = frozenset("nav header footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main".split())
#: Elements whose class is part of the path.
CLASSED = frozenset("div section ul ol dl table blockquote article main p".split())
DECLARED, BESIDE, REJECTED = 1e3, 0.1, 1e-6
#: Link text in a path's characters from which on its blocks are no text between content.
LINKED = 0.5
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element closes open ones of these names, up to the scope in the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class and id that name what is no content.
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended footer header masthead comment comments commentlist reply replies respond disqus discussion pagination pager toolbar copyright disclaimer skip".split())
#: A class that has, or has not, such a part: noise words after these do not count.
FLAGS = frozenset("has no not with without".split())
#: Words for the form of a part; what it is stands before them.
FORMS = frozenset("list lists item items box boxes area areas wrap wrapper container holder section sections block blocks bar panel form forms thread group row inner outer top bottom left right content body text title link links button buttons icon icons post posts entry entries slot unit zone".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、]")


def _named_noise(value: str, whole: bool) -> bool:
    """Whether a name in a class or id says that the part is no content; ``whole``: by the word for what it is, not by any."""
    if not NOISE.intersection(x.lower() for x in _NAME.findall(value)):
        return False
    for name in value.split():
        words = [x.lower() for x in _NAME.findall(name)]
        words = words[: next((i for i, x in enumerate(words) if x in FLAGS), None)]
        if whole:
            while words and (words[-1] in FORMS or words[-1].isdigit()):
                words.pop()
            words = words[-1:]
        if NOISE.intersection(words):
            return True
    return False


def _noise(tag: str, attributes: str, within: bool) -> tuple[bool, bool, bool, str]:
    """Whether an element is not shown, is rejected by what it is, by its names, and its class for the path; ``within`` an article or main."""
    if tag in UNSEEN:
        return True, False, False, ""
    rejected = tag in REJECTS
    names = {"class": "", "id": ""}
    if attributes:
        for key, *values in _ATTR.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, False, False, ""
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, False, ""
            rejected = rejected or key == "role" and value.lower() in ROLES
            if key in names:
                names[key] = value
    label = names["class"].strip().lower()
    if tag in ("html", "body"):
        return False, rejected, False, label
    if tag in CONTAINERS or tag in INLINE:
        return False, rejected, _named_noise(names["class"], True), label
    # in an article the ids of sections, headings and paragraphs are anchors
    anchor = within and (tag not in ("div", "ul", "ol") or "section" in label.split())
    return False, rejected, _named_noise(names["class"], within) or not anchor and _named_noise(names["id"], within), label


@dataclass(slots=True)
class Block:
    """A block of text: its path (a node of the page's tree of paths), characters of link text, and the marked element around it."""

    path: int
    text: str
    linked: int
    mark: int
    rejected: bool
    within: bool


class Paths:
    """The tag paths of a page as a tree: parent, last step and depth of each; 0 is the root."""

    def __init__(self):
        self.parent, self.step, self.depth = [0], [""], [0]
        self.known: dict[tuple[int, str], int] = {}

    def child(self, path: int, step: str) -> int:
        if (key := (path, step)) not in self.known:
            self.known[key] = len(self.step)
            self.parent.append(path)
            self.step.append(step)
            self.depth.append(self.depth[path] + 1)
        return self.known[key]

    def spans(self) -> tuple[list[int], list[int]]:
        """Of each path its place before and behind all paths below it, in one walk; a path is above another if its span holds the other's."""
        below: list[list[int]] = [[] for _ in self.step]
        for p in range(1, len(self.step)):
            below[self.parent[p]].append(p)
        first, last, at, stack = [0] * len(self.step), [0] * len(self.step), 0, [(0, 0)]
        while stack:
            p, k = stack.pop()
            if not k:
                first[p] = at = at + 1
            if k < len(below[p]):
                stack += [(p, k + 1), (below[p][k], 0)]
            else:
                last[p] = at
        return first, last

    def related(self, p: int, q: int, spans: tuple[list[int], list[int]]) -> bool:
        """Whether two paths are siblings, or the parent of one is above the other and not the page's body."""
        above, below = sorted((self.parent[p], self.parent[q]), key=self.depth.__getitem__)
        if p == q or above == below:
            return True
        return self.step[above] not in ("", "html", "body") and spans[0][above] <= spans[0][below] and spans[1][below] <= spans[1][above]


def _dropped(marks: list[tuple[int, str]], sizes: list[int]) -> list[bool]:
    """Which marked elements (place of the one around, kind) are left out with all their text; ``sizes``: characters right inside each.

    A noise name drops its part, unless the part holds a main; or it holds an article
    or most of the text, and neither a main nor an article outside of all such parts
    stands beside it.
    """
    n = len(marks)
    size, noisy = list(sizes), [False] * n
    for m in range(n - 1, 0, -1):
        size[marks[m][0]] += size[m]
    for m in range(1, n):
        noisy[m] = marks[m][1] == "noise" or noisy[marks[m][0]]
    mains, articles = ([int(kind == k and size[m] > 0) for m, (_, kind) in enumerate(marks)] for k in ("main", "article"))
    around = [a + (b and not c) for a, b, c in zip(mains, articles, noisy, strict=True)]
    beside = list(around)
    for m in range(n - 1, 0, -1):
        for counts in (mains, articles, beside):
            counts[marks[m][0]] += counts[m]
    out = [False] * n
    for m in range(1, n):
        up, kind = marks[m]
        around[m] += around[up]
        alone = beside[0] == beside[m] + around[up]
        spared = mains[m] or alone and (articles[m] or 2 * size[m] > size[0])
        out[m] = out[up] or kind == "noise" and not spared
    return out


def blocks(page: str) -> tuple[list[Block], Paths]:
    """Text blocks in page order, with what the markup declares of them."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, unseen, rejected, marked, path around
    opened: dict[str, list[int]] = {}  # places in the stack of each tag's open elements
    paths, path = Paths(), 0
    marks, mark = [(0, "")], 0  # elements that names or tags mark, and the innermost open one
    unseen = rejected = within = links = anchors = 0
    mute: list = []  # an inline element whose text is left out: tag, depth
    parts: list[str] = []

    def flush():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, min(links, len(text)), mark, rejected > 0, within > 0))
            parts.clear()
        links = 0

    def last(names) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=-1)

    def cut(size: int):
        nonlocal unseen, rejected, path, mark, within
        while len(stack) > size:
            tag, bad, reject, marked, path = stack.pop()
            opened[tag].pop()
            unseen -= bad
            rejected -= reject
            within -= tag in CONTAINERS
            if marked:
                mark = marks[mark][0]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not unseen and not mute:
            parts.append(text)
            if anchors:
                links += len(text.strip())
        if not m:
            break
        at = max(m.end(), at + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    anchors = max(0, anchors - 1)
                if mute and mute[0] == tag:
                    mute[1] -= 1
                    if not mute[1]:
                        mute.clear()
            elif tag not in VOID:
                flush()
                mute.clear()
                if opened.get(tag):
                    cut(opened[tag][-1])
            continue
        if tag in INLINE:
            if tag == "a":
                anchors = 1
            if mute:
                mute[1] += mute[0] == tag
            elif m[3].strip():
                hidden, reject, named, _ = _noise(tag, m[3], True)
                if hidden or reject or named:
                    mute += [tag, 1]
            continue
        if tag in VOID:
            if not unseen and not mute:
                parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in RAW:  # content up to the end tag is no markup, and no text of the page
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        flush()
        mute.clear()
        anchors = 0
        if tag in P_CLOSERS and last(("p",)) > last(("td", "th", "li", "div", "article", "section", "body", "button")):
            cut(opened["p"][-1])
        if tag in CLOSES:
            names, scope = CLOSES[tag]
            while (own := last(names)) > last(scope):
                cut(own)
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        bad, reject, named, label = _noise(tag, m[3], within > 0)
        kind = (tag if not named else "") if tag in CONTAINERS else "noise" if named else ""
        if kind:
            marks.append((mark, kind))
            mark = len(marks) - 1
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, bad, reject, bool(kind), path))
        unseen += bad
        rejected += reject
        within += tag in CONTAINERS
        path = paths.child(path, f"{tag}.{label}" if label and tag in CLASSED else tag)
    flush()
    sizes = [0] * len(marks)
    for b in out:
        if not b.rejected:
            sizes[b.mark] += len(b.text)
    named = _dropped(marks, sizes)
    for b in out:
        b.rejected = b.rejected or named[b.mark]
    return out, paths


def ratios(own: list[Block], paths: Paths) -> dict[int, float]:
    """Each path's smoothed ratio less its share of link text, without weights."""
    sums: dict[int, list[int]] = {}
    for b in own:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_MARKS.findall(b.text))
        s[3] += b.linked
    raw = {p: math.sqrt(c / k) * math.sqrt(1 + m / k) for p, (k, c, m, _) in sums.items()}
    best, spans = dict.fromkeys(raw, 0.0), paths.spans()
    for i, b in enumerate(own):
        near = [raw[b.path]]
        for o in own[max(0, i - 1) : i] + own[i + 1 : i + 2]:
            if b.rejected == o.rejected and b.within == o.within and paths.related(b.path, o.path, spans):
                near.append(raw[o.path])
        best[b.path] = max(best[b.path], sum(near) / len(near))
    return {p: best[p] * (1 - 0.95 * min(1.0, linked / max(1, c))) for p, (_, c, _, linked) in sums.items()}


def content(page: str | None, share: float = 0.3) -> tuple[list[Block], list[bool]]:
    """The blocks of a page, and which are content; ``share`` is the threshold against the best ratio."""
    own, paths = blocks(page or "")
    ratio = ratios(own, paths)
    fair = [b for b in own if not b.rejected]
    if not fair:
        return own, [False] * len(own)
    declares = 2 * sum(len(b.text) for b in fair if b.within) >= sum(len(b.text) for b in fair)
    limit = share * max(ratio[b.path] for b in fair)

    def weight(b: Block) -> float:
        return REJECTED if b.rejected else 1.0 if not declares else DECLARED if b.within else BESIDE

    chosen = [weight(b) * ratio[b.path] >= limit for b in own]
    if any(chosen):  # quotations, short paragraphs and the like: nothing but links is left out between content
        share_of: dict[int, list[int]] = {}
        for b in own:
            s = share_of.setdefault(b.path, [0, 0])
            s[0] += b.linked
            s[1] += len(b.text)
        first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
        for i in range(first + 1, last):
            b = own[i]
            chosen[i] = chosen[i] or not b.rejected and (b.within or not declares) and share_of[b.path][0] < LINKED * share_of[b.path][1]
    for i in range(len(own) - 2, -1, -1):
        b, after = own[i], own[i + 1]
        if not b.rejected and not after.rejected and b.within == after.within and paths.step[b.path].split(".")[0] in HEADINGS:
            chosen[i] = chosen[i] or chosen[i + 1]
    return own, chosen


def extract(page: str | None, share: float = 0.3) -> str:
    """Main text of a page."""
    own, chosen = content(page, share)
    return "\n".join(b.text for b, c in zip(own, chosen, strict=True) if c)


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches):
        for batch in steps(batches, "html"):
            found = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
