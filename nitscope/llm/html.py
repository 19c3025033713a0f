"""Main text of web pages by the maximum-scoring subsequence.

A page is read once into a sequence of words, in blocks (runs of text between block-level tags), and tags. A word scores
between 0 and 1: what a logistic regression over its block's surroundings says for main text. A tag scores a negative
weight: the more often it stands where main text meets other text and not within main text, the lower. Both are learned
from labelled pages, and nothing else decides. A linear scan finds the contiguous region of the largest sum, and the
blocks in it whose words score more than 0 are the main text. Tags of elements that hold no such block count nothing, so
that an advert or a form amid the article is left out and does not cut it.

Defined cases: null or empty html has the empty text, and so has a page without a region of positive score; markup
that is cut off at the end of the page is no text; unknown or unclosed tags are skipped; of regions with equal sums the
first, then the longest is taken; very long texts and attributes are read whole, in linear time; columns of the names
main_text and n_chars are replaced, others are passed on whatever their names; repeated rows give equal results each; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitscope.runtime import unused

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title head datalist map".split())
_RAW = "script|style|noscript|template|iframe|svg|math|canvas|textarea|title|object"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LANDMARKS = frozenset(("article", "main"))
#: An open element of the left kind ends where one of the right kinds begins.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
#: What may stand in a head; any other element or text ends it.
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+>|<[a-zA-Z!?/][^>]*+\Z",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Names that pages give to what is not the article, and to what is.
OFF_NAMES = (
    "nav menu breadcrumb sidebar footer header masthead banner ad ads advert advertisement sponsor sponsored promo notice cookie "
    "consent alert gdpr newsletter signup subscribe subscription login search share social related recommended popular trending comment respond "
    "discussion reply disclaimer copyright legal pagination pager toolbar widget popup modal overlay tag-cloud form outbrain taboola "
    "navigation navbar topbar notification recommendation recommend feedback marketing offer adsbygoogle adsense leaderboard disqus thread "
    "replies side rail teaser affiliate signin register tagline skip dropdown ticker warning announcement"
)
MAIN_NAMES = "content article post entry story body text main-content post-content entry-content article-body page"
#: Kinds of surroundings that are made for each name.
SHAPES = 6
#: Features by which a block is in an article.
ARTICLE = frozenset(("inside", ".article", ".post", ".entry", ".story"))
#: Words that a tag outweighs for each nat, beyond the first, by which it is more frequent at a border of main text.
BORDER = 2.0
#: The least that any tag takes away.
LEAST_TAG = 0.01


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word[-1] == "s" else word


#: An article of such a name (a reader's comment, a teaser) is not the page's.
_OFF, _MAIN = (frozenset("." + _singular(w) for name in names.split() for w in name.split("-")) for names in (OFF_NAMES, MAIN_NAMES))


@dataclass
class Block:
    """`tags` are those since the block before: (name, first, end), with the range of the blocks in the tag's element.
    Names end in `*` where other blocks' elements lie in the tag's own; that of an end tag begins with `/`, and within an
    article, by its element or a name, all begin with `in `."""

    text: str
    features: frozenset[str]
    words: int
    tags: list[tuple[str, int, int]]
    label: str = ""


@dataclass
class _Open:
    """An open element with what holds for all that lies in it: features (from the article inwards, where there is one),
    label, whether it is in an article."""

    name: str
    features: frozenset[str]
    label: str
    article: bool
    landmark: bool
    first: int
    tag: list
    holds: bool = False


@lru_cache(maxsize=65536)
def _frame(name: str, attrs: str) -> tuple[frozenset[str], str]:
    """Features and label of an element: its name and the words of its class, id and role, in the singular."""
    out = {f"<{name}>"} if name in BLOCKS and name not in ("html", "body") else set()
    for groups in _NAMES.findall(attrs) if name not in ("html", "body") else ():
        for word in _PARTS.findall("".join(groups)):
            out.add("." + _singular(word.lower()))
    if _HIDDEN.search(attrs):
        out.add("hidden")
    return frozenset(out), "main" if "data-main" in attrs else "off" if "data-off" in attrs else ""


def read(html: str) -> list[Block]:
    """The blocks of a page in order, each with the tags since the one before."""
    blocks: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    tags: list[list] = []
    open_names: Counter[str] = Counter()
    linked = total = silent = 0
    in_link, landmark = False, False

    def flush() -> None:
        nonlocal linked, total, tags
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            here = stack[-1] if stack else _Open("", frozenset(), "", False, False, 0, [])
            features = here.features
            if linked >= 0.8 * total:
                features |= {"links"}
            if here.name in HEADINGS:
                features |= {"heading"}
            blocks.append(Block(text, features, text.count(" ") + 1, tags, here.label or "off"))
            tags = []
        linked = total = 0

    def text_of(a: int, b: int) -> None:
        nonlocal linked, total
        if stack and stack[-1].name == "head" and html[a:b].strip():
            close()
        if a < b and not silent:
            piece = html[a:b]
            parts.append(piece)
            n = len(piece) - piece.count(" ")
            total, linked = total + n, linked + n * in_link

    def place() -> str:
        return "in " * bool(stack and stack[-1].article)

    def opened(name: str, attrs: str) -> _Open:
        own, label = _frame(name, attrs)
        outer = stack[-1] if stack else None
        is_landmark, off = name in LANDMARKS, own & _OFF
        article = bool(outer and outer.article) or bool(is_landmark or own & _MAIN) and not off
        inside = bool(outer and outer.landmark)
        first = is_landmark and not off and not inside  # what holds the article says nothing of it
        return _Open(name, own if first or not outer else outer.features | own, label or (outer.label if outer else ""), article, inside or first, len(blocks), tags[-1])

    def close() -> _Open:
        nonlocal silent
        e = stack.pop()
        silent -= e.name in SILENT
        open_names[e.name] -= 1
        e.tag[0], e.tag[2] = e.tag[0] + "*" * e.holds, len(blocks)
        return e

    at = 0
    for m in _TOKEN.finditer(html):
        text_of(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if stack and stack[-1].name == "head" and not m["end"] and name not in IN_HEAD:
            close()
        if name == "a":
            in_link = not m["end"]
        if name not in BLOCKS and name not in SILENT:
            if name == "br" or name in CELLS:
                parts.append(" ")
            continue
        flush()
        in_link = False
        if m["end"]:
            if open_names[name]:
                while (e := close()).name != name:
                    pass
                tags.append([f"{place()}/{name}{'*' * e.holds}", e.first, len(blocks)])
        elif name in VOID:
            tags.append([place() + name, len(blocks), len(blocks)])
        else:
            while stack and name in CLOSES.get(stack[-1].name, ()):
                close()
            if stack:
                stack[-1].holds = True
            tags.append([place() + name, len(blocks), 0])
            stack.append(opened(name, (m["attrs"] or "").removesuffix("/")))
            open_names[name] += 1
            silent += name in SILENT
            landmark |= stack[-1].landmark
    text_of(at, len(html))
    flush()
    while stack:
        close()
    if landmark:
        for b in blocks:
            inside = "<article>" in b.features or "<main>" in b.features
            b.features |= {"inside"} if inside else {"outside"}
    for b in blocks:
        if "heading" in b.features and b.features & {"<header>", ".header"} and b.features & ARTICLE:
            b.features = b.features - {"<header>", ".header"} | {"title in article"}
    return blocks


def labelled_pages() -> list[str]:
    """Labelled pages, made by rule: layouts of the article with kinds of surroundings in and around it, among both
    such as have telling names, such as have none and such as have names that say nothing.
    data-main and data-off mark what is main text and what is not; the features do not look at them."""
    main_names = MAIN_NAMES.split()
    layouts = ["<article data-main>{}</article>", "<main data-main>{}</main>", "<main><article data-main>{}</article></main>", "<body data-main>{}</body>", "<section data-main>{}</section>"]
    layouts += [f'<div {k}="{n}" data-main>{{}}</div>' for n, k in product(main_names, ("class", "id"))]
    layouts += ["<div data-main>{}</div>", '<div class="{x}" data-main>{}</div>', '<div class="{x}"><div class="{x}" data-main>{}</div></div>']
    body = "<h1>Ato be</h1><p>Ce da ef go hi jo ku la me ni.</p><p>Op <a href='#'>qu</a> ra.</p><p>Si to um va we.</p>"
    more = "<h2>Sa</h2><h3>Si</h3><h4>So</h4><h5>Su</h5><h6>Sy</h6><p><a href='#'>La li</a></p><dl><dt>Ka</dt><dd>Ke</dd></dl><ul><li>Tu va</li><li>We <a href='#'>xi</a> yo zu</li></ul><blockquote>Ab ce di</blockquote><pre>x = 1</pre><figure><figcaption>Fa gu</figcaption></figure><table><tr><td>Ha</td><td>je</td></tr></table><div>Ki lo mu no.</div>Pe qi<div>Re su ti</div><div class='{x}'>Um vo</div><div><p>We xa</p><p>Ya zo</p></div><section><h2>Ab</h2><p>Ce di</p></section><section><p>Fo gu</p><p>Ha</p></section><h1>Je ki</h1>"
    around, every, apart, title = range(4)
    kinds = [("<nav data-off><ul><li><a href='/a'>Ab</a></li><li><a href='/c'>Ce</a></li></ul></nav>", every), ("<footer data-off>Ab ce di <p>fo gu</p></footer>", every), ("<aside data-off><p>Ab ce di fo</p></aside>", every)]
    kinds += [("<form data-off><p>Ab ce</p><label>di</label></form>", every), ("<header data-off><h2>Ab</h2><p>Ce di fo</p></header>", around), ("<header><h1 data-main>Ab ce</h1><p data-off>Di fo gu</p></header>", title)]
    kinds += [("<dialog data-off>Ab ce di</dialog>", every), ("<dialog data-off><p>Ab ce</p></dialog>", every), ("<fieldset data-off><legend>Ab</legend><p>Ce</p></fieldset>", every), ("<menu data-off><ul><li>Ab</li></ul></menu>", every), ("<div hidden data-off><p>Ab ce</p><p>Di</p></div>", every), ("<footer data-off><div>Ab</div><ul><li>Ce</li></ul></footer>", every), ("<aside data-off><h3>Ab</h3><ul><li>Ce</li></ul></aside>", every), ("<form data-off><div>Ab</div><p>Ce</p></form>", every), ("<nav data-off><p>Ab</p><h3>Ce</h3></nav>", every), ("<menu data-off><li>Ab</li></menu>", every), ("<div hidden data-off>Ab ce</div>", every), ("<ul data-off><li><a href='#'>Ab</a></li><li><a href='#'>Ce</a></li></ul>", around)]
    plain = ["<div data-off>Ab ce di fo</div>", "<div class='{x}' data-off><p>Ab ce</p></div>", "<div class='{x}' data-off>Ab ce</div>", "<div class='{x}' data-off><div><p>Ab</p><p>Ce di</p></div></div>", "<div class='{x}' data-off><ul><li><a href='#'>Ab</a></li><li><a href='#'>Ce</a></li></ul></div>", "<p data-off>Ab ce</p>"]
    kinds += [(k, apart) for k in plain] * 3
    named = []
    for i, n in enumerate(OFF_NAMES.split()):
        both = f"{n}-{main_names[i % len(main_names)]}"
        named += [(f'<div class="{n}" data-off>Ab ce di fo gu</div>', every), (f'<section id="{n}" data-off><h3>Ab</h3><p>Ce di fo gu</p><p>Ha ji</p></section>', every), (f'<p class="{n}" data-off>Ab ce</p>', every), (f'<div id="{n}" data-off><p>Ab ce</p><ul><li>Di</li></ul></div>', every), (f'<div class="{both}" data-off><p>Ab ce di</p></div>', every), (f'<section class="{both}s" data-off><h2>Ab</h2><ul><li>Ab ce di</li></ul></section>', every)]
    assert len(named) == SHAPES * len(OFF_NAMES.split())
    out = []
    for i, (kind, where) in enumerate(kinds + named):
        for j, layout in enumerate(layouts):
            name = (i - len(kinds)) // SHAPES
            if name >= 0 and j != name % 3 and (name + j) % 6:  # named ones in a landmark and in a sixth of the layouts
                continue
            outside = kind if where in (around, every, apart) else ""
            within = kind if where == every or where == title and j < 3 else ""
            main = layout.replace("{}", ("<p>Na</p>" if (i + j) % 4 == 3 else "") + body + within + (more if (i + j) % 2 else "") + "<p>Zo.</p>")
            page = f"<html><head><title>Ab</title></head>{outside}{main}{outside}</html>"
            out.append(page.replace("{x}", f"q{(7 * i + j) % 97}x"))  # digits are no part of a name: what is left is `q` and `x`
    return out


def _regression(blocks: list[Block], rounds: int, ridge: float) -> tuple[float, dict[str, float]]:
    """Bias and weights of a logistic regression of the label on the features; equal rows are one with a weight."""
    rows = Counter((b.features, b.label == "main") for b in blocks)
    names = sorted({f for features, _ in rows for f in features})
    place = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((len(rows), len(names) + 1)), np.array([main for _, main in rows], float)
    x[:, -1], n = 1, np.array(list(rows.values()), float)
    for i, (features, _) in enumerate(rows):
        x[i, [place[f] for f in features]] = 1
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps
        p = 1 / (1 + np.exp(-(x @ w)))
        curve = x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (n * (p - y)) + ridge * w)
    return float(w[-1]), dict(zip(names, w[:-1].tolist(), strict=True))


def _counted(blocks: list[Block], heard: list[bool]) -> Iterator[list[str]]:
    """For each block, the names of the tags since the block before whose elements hold a block that is heard."""
    before = [0, *accumulate(heard)]
    for b in blocks:
        yield [t for t, first, end in b.tags if before[end] > before[first]]


@lru_cache(maxsize=1)
def learn(rounds: int = 25, ridge: float = 0.01) -> dict:
    """Weights from the labelled pages: of features, by logistic regression; of tags, by the share of the gaps between main
    and other text that hold them against that of the gaps within main text, where a scan would meet both texts. Tags of
    an element without others in it belong to its words and take the least away."""
    pages = [read(page) for page in labelled_pages()]
    bias, word = _regression([b for page in pages for b in page], rounds, ridge)
    model, seen, gaps = {"bias": bias, "word": word, "tag": {}}, {}, [1, 1]
    for page in pages:
        heard = [word_score(b.features, model) > 0 for b in page]
        passed, last = [], None
        for b, h, names in zip(page, heard, _counted(page, heard), strict=True):
            passed += names
            if h:
                now = b.label == "main"
                if last is not None and (now or last):
                    gaps[now != last] += 1
                    for t in {t for t in passed if t[-1] == "*"}:
                        seen.setdefault(t, [1, 1])[now != last] += 1
                passed, last = [], now
    model["tag"] = {t: min(-LEAST_TAG, -BORDER * (float(np.log(border / gaps[1] / (within / gaps[0]))) - 1)) for t, (within, border) in seen.items()}
    return model


def word_score(features: frozenset[str], model: dict) -> float:
    """Between 0 and 1: twice the probability of main text over one half."""
    z = model["bias"] + sum(model["word"].get(f, 0.0) for f in features)
    return max(0.0, float(np.tanh(z / 2)))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[a, b) with the largest sum, the first and longest of equals; (0, 0) if no sum is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best > 0 and found[0] == start:
            best, found = total, (start, i + 1)
    return found


def main_text(html: str | None, model: dict) -> str:
    blocks = read(html or "")
    each = [word_score(b.features, model) for b in blocks]
    tag = model["tag"]
    cost = [sum(tag.get(t, -LEAST_TAG) for t in names) for names in _counted(blocks, [s > 0 for s in each])]
    a, z = best_region([x for b, s, c in zip(blocks, each, cost, strict=True) for x in (c, s * b.words)])
    return "\n".join(x.text for i, (x, s) in enumerate(zip(blocks, each, strict=True)) if a <= 2 * i + 1 < z and s > 0)


def extract(pages: DataFrame, html: str = "html", model: dict | None = None) -> DataFrame:
    """`pages` without `html`, plus main_text and n_chars (its code points)."""
    model = model or learn()
    keep = [c for c in pages.columns if c not in (html, "main_text", "n_chars")]
    given = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`").alias(unused("__html", pages.columns)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, model) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "main_text", "n_chars"])

    return given.mapInArrow(run, f"{kinds}{', ' if keep else ''}main_text string, n_chars long")
