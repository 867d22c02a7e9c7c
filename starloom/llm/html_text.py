"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm._shared import text_slices

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Browsers read these as raw text to their end tag, or to the end of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Markup that is not the page's text; without an end tag only the start tag is passed over.
SKIPPED = frozenset("noscript template svg object audio video canvas annotation annotation-xml".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics none".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label wbr".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An open element of the first kind ends where one of the second begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option", "optgroup"}}
#: Elements nested deeper are read as if they stood at this depth, as browsers do.
DEEPEST = 512
LISTS = frozenset("ul ol dl menu table select".split())
APART = frozenset("head nav footer aside button select fieldset menu dialog input label legend optgroup option datalist output progress meter map applet marquee".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What orders text within a container, and so belongs to it.
STRUCTURE = frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre p figure figcaption header hgroup details summary".split()) | HEADINGS
#: Words of class, id or role that mark what is not the article, and what is.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar topnav subnav breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer foot colophon copyright sidebar aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner teaser outbrain taboola cookie cookies consent gdpr notice notification alert modal popup overlay "
    "comment comments commentlist respond reply replies disqus discussion feedback share sharing social follow newsletter subscribe subscription signup login register search searchbox related recommended "
    "recommendations trending popular tags tagcloud toc skip hidden contentinfo complementary banners dialog".split()
)
#: Words that make a mark a statement about the page, as in ``with-sidebar``.
WITHOUT = frozenset("has with without no".split())
OWN = frozenset(["header"])
MAIN_WORDS = frozenset("article articlebody main maincontent postcontent postbody entrycontent entry storybody".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
_PUNCTUATION = re.compile("[.,;:!?…。，、；：！？¿¡]")


@dataclass
class Block:
    path: str
    inside: str
    apart: bool
    main: bool
    doubts: tuple[int, ...]
    mains: tuple[int, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Doubt:
    """An element that only class words, or being a form, set apart: ``words`` as in _marks(); ``holds`` an article or main."""

    words: int
    holds: bool


def _marks(name: str, attributes: str, inside: bool = False) -> tuple[str, bool, int, bool]:
    """An element's label in paths, whether it is hidden, what its words say, and whether they name the article.

    Words that set it apart are 2 if they are all of a class, id or role, 1 if they are parts of it
    only. ``inside`` an article, a header is the article's own, with its title.
    """
    if not attributes.strip():
        return name, False, 0, False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes) if m[1]}
    bare = {m[5].lower() for m in _ATTRIBUTE.finditer(attributes) if m[5]}
    named = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
    main, apart = False, 0
    own = OWN if inside else {"form"} if name == "form" else frozenset()
    for token in named.split():
        whole = re.sub("[^a-z]", "", token.lower())
        words = {w.lower() for w in _WORDS.findall(token)} | {whole}
        main = main or whole in MAIN_WORDS
        noise = (words - own) & NOISE_WORDS
        if noise and not words & WITHOUT:
            apart = max(apart, 2 if whole in noise else 1)
    style = re.sub(r"\s", "", found.get("style", "").lower())
    hidden = "hidden" in bare or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    first = found.get("class", "").split()
    return f"{name}.{first[0].replace('/', '|')}" if first else name, hidden, 0 if main else apart, main


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the elements of a name end, by the end of their start tags; nested ones are paired, those without an end tag left out."""
    tags = re.compile(rf"<!--.*?(?:--!?>|\Z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\Z)|<(/?){re.escape(name)}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.I | re.S)
    out, open_ = {}, []
    for m in tags.finditer(page):
        if m[2] == "/" and open_:
            out[open_.pop()] = m.end()
        elif m[2] == "" and not m[3].rstrip().endswith("/"):
            open_.append(m.end())
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, each with its tag path; markup is read forgivingly, as browsers do."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, int]] = []
    state = ["", False, False, (), ()]
    doubts: dict[int, Doubt] = {}
    opened = 0
    ends: dict[str, dict[int, int]] = {}
    links, raw_until, at = 0, None, 0
    current: Block | None = None

    def renew() -> None:
        nonlocal current
        state[:] = ["/".join(x[1] for x in stack), any(x[2] for x in stack), any(x[3] for x in stack), tuple(x[4] for x in stack if x[4] in doubts), tuple(x[4] for x in stack if x[3])]
        current = None

    def put(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if not text.strip():
                return
            container = "/".join(x[1] for x in stack[:-1])
            current = Block(state[0], container, *state[1:])
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    def close(k: int) -> None:
        del stack[k:]
        renew()

    while m := _TOKEN.search(page, at):
        put(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if ending:
            if name == "a":
                links = max(0, links - 1)
            elif name in INLINE or name in VOID:
                if name == "br":
                    put(" ")
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        links = 0
                        break
                    if stack[k][0] in ("article", "body") and name in ("div", "p", "span"):
                        break
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            put(" ")
            continue
        if name in SKIPPED:
            if not attributes.rstrip().endswith("/"):
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = ends[name].get(at, at)
            put(" ")
            continue
        if name == "a":
            links = 1
            continue
        if name in INLINE:
            label, hidden, words, _ = _marks(name, attributes)
            if not hidden and not words:
                continue
            if name not in ends:
                ends[name] = _ends(page, name)
            end = ends[name].get(at, at)
            if hidden or not _ARTICLE.search(page, at, end):
                at = end
            continue
        if name == "br" or name in VOID and name != "hr":
            put(" ")
            continue
        if name in PARAGRAPH_ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "button", "body"):
                    break
        for k in range(len(stack) - 1, -1, -1):
            if name in SIBLINGS.get(stack[k][0], ()):
                del stack[k:]
                break
            if stack[k][0] in LISTS:
                break
        if name == "body":
            stack[:] = [x for x in stack if x[0] != "head"]
        links = 0
        if name == "hr":
            renew()
            continue
        inside = any(x[0] == "article" for x in stack)
        label, apart, words, main = _marks(name, attributes, inside)
        if name == "body":
            apart, words = False, 0
        if len(stack) < DEEPEST:
            opened += 1
            if name in MAIN:
                for x in stack:
                    if x[4] in doubts:
                        doubts[x[4]].holds = True
            if words == 2 or (words and name not in MAIN) or name == "form":
                doubts[opened] = Doubt(words, name in MAIN)
            stack.append((name, label, apart or name in APART or (name == "header" and not inside), main or name in MAIN, opened))
        renew()
    put(html.unescape(page[at:]))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    out = [b for b in out if b.text]
    _settle(out, doubts)
    return out


def _settle(blocks: list[Block], doubts: dict[int, Doubt]) -> None:
    """Set apart the blocks of elements that only words, or being a form, set apart; those that hold the text stay.

    From the outermost in: what is, or has in it, an article or main stays if one of these has more
    text than any outside such elements, or, with none outside, than all outside. Where no article is
    outside, a form, or what only parts of classes set apart, stays too if it has more text than all
    else. Linked text does not count. Parts of classes weigh less than whole ones: they are settled first.
    """
    sizes: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = defaultdict(int)
    for b in blocks:
        if not b.apart:
            sizes[b.doubts, b.mains] += max(0, len(b.text) - b.linked)
    seen: set[int] = set()
    #: How many doubts, from the outermost, are settled in favour of each group.
    depth = dict.fromkeys(sizes, 0)
    last = {k: max((d for d in k[0] if doubts[d].words == 2 and not doubts[d].holds), default=0) for k in sizes}
    while any(n < len(k[0]) for k, n in depth.items()):
        outside, whole, inner = (defaultdict(int) for _ in range(3))
        bare = 0
        for k, n in depth.items():
            if n == len(k[0]):
                bare += sizes[k]
                if k[1]:
                    outside[k[1][0]] += sizes[k]
            elif last[k] <= (outer := k[0][n]):
                whole[outer] += sizes[k]
                m = bisect_left(k[1], outer)
                if m < len(k[1]):
                    inner[outer, k[1][m]] += sizes[k]
        most = max(outside.values(), default=0)
        loose = {d: n for d, n in whole.items() if doubts[d].words < 2 and not doubts[d].holds and not most}
        beside = sum(loose.values())
        holders: dict[int, int] = defaultdict(int)
        for (d, _), n in inner.items():
            if doubts[d].holds:
                holders[d] = max(holders[d], n)
        stays = {d for d, n in holders.items() if doubts[d].words < 2 and n > (most or bare)}
        stays = stays or {d for d, n in holders.items() if n > (most or bare + beside)}
        stays = stays or {d for d, n in loose.items() if n > bare + beside - n}
        if not stays:
            break
        seen |= stays
        for k, n in depth.items():
            depth[k] = n + (n < len(k[0]) and k[0][n] in stays)
    for b in blocks:
        b.apart = b.apart or not seen.issuperset(b.doubts)


@dataclass
class PathScores:
    """Of each tag path: how much of its text is linked, its score, and whether it is content."""

    linked: dict[str, float]
    score: dict[str, float]
    good: set[str]


def path_scores(blocks: list[Block]) -> PathScores:
    """Tag-path ratios of blocks in page order.

    Text length and punctuation of the nodes of a path are summed up and taken a node; their fusion is the
    product of both logarithms (a paragraph counts as one more mark) and of the share of text that
    is not linked. A path's score is the mean of its nodes' scores after smoothing along the page with
    weights 1, 2, 1. The threshold is 0.4 of the page's mean score a character.
    """
    nodes, chars, points, linked = (defaultdict(float) for _ in range(4))
    for b in blocks:
        nodes[b.path] += 1
        chars[b.path] += len(b.text)
        points[b.path] += len(_PUNCTUATION.findall(b.text))
        linked[b.path] += min(b.linked, len(b.text))
    dense = {p: linked[p] / chars[p] for p in nodes}
    fused = {p: math.log1p(chars[p] / nodes[p]) * math.log1p(points[p] / nodes[p] + (_tag(p) == "p")) * (1 - dense[p]) for p in nodes}
    own = [fused[b.path] for b in blocks]
    score: dict[str, float] = defaultdict(float)
    for i, b in enumerate(blocks):
        score[b.path] += (own[max(0, i - 1)] + 2 * own[i] + own[min(len(own) - 1, i + 1)]) / 4 / nodes[b.path]
    threshold = 0.4 * sum(score[p] * chars[p] for p in score) / sum(chars.values())
    return PathScores(dense, dict(score), {p for p in score if score[p] >= threshold and dense[p] <= 0.5})


def _tag(path: str) -> str:
    return path.rpartition("/")[2].split(".")[0]


def content_of(blocks: list[Block]) -> list[str]:
    """Texts of the content blocks.

    What tags, classes, ids or roles set apart is left out (see _settle()), and where an article is marked only it
    counts. Then path_scores() chooses the paths, within a marked article too. Beside chosen paths, blocks of
    the same container stay, in its lists, tables and quotes as well; so do headings above or right before
    what stays and the first-level headings of a marked article. Mostly linked blocks stay only there, as a
    marked article's lists of sources.
    """
    open_ = [b for b in blocks if not b.apart]
    chosen = [b for b in open_ if b.main] or open_
    if not chosen:
        return []
    paths = path_scores(chosen)
    around = {b.inside for b in chosen if b.path in paths.good}
    above = {c[:i] for c in around for i in range(len(c) + 1) if i == len(c) or c[i] == "/"}
    kept = [False] * len(chosen)
    for i in range(len(chosen) - 1, -1, -1):
        b, last = chosen[i], _tag(chosen[i].path)
        kept[i] = b.path in paths.good
        if not kept[i] and (b.main or paths.linked[b.path] <= 0.5):
            kept[i] = _near(b.inside, around) or last in HEADINGS and (b.inside in above or b.main and last == "h1" or i + 1 < len(chosen) and kept[i + 1])
    return [b.text for b, k in zip(chosen, kept, strict=True) if k]


def _near(inside: str, around: set[str]) -> bool:
    """Whether a container is one of ``around``, or in one with nothing but text structure between."""
    while inside not in around:
        inside, _, last = inside.rpartition("/")
        if last.split(".")[0] not in STRUCTURE:
            return False
    return True


def main_text(page: str | None) -> str:
    """The main text of one whole page: its blocks joined by two line ends; empty if there is none."""
    return "\n\n".join(content_of(blocks_of(page or "")))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per page, from its whole html.

    Null and empty pages, and pages without an article, give an empty text; very long ones are read whole.
    Repeated rows and null ids are answered row by row; other columns are not read, whatever their names;
    an empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
