"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Parts that are marked as something else are out: menus, page headers and
footers, sidebars, notices, adverts, forms, reader comments; by element name, or by a class, id or role token of known
meaning (a whole token such as "comments" or "site-footer", never a word inside another, as in "has-comments"). If every
article or main element of a page stood in a part that is out by such a token or by a form or header, the marks around the
largest are void: layouts name their columns so.

Pass one decides by length, link density, stop words and what a block says of itself. Anywhere, short blocks that speak as
notices do ("accept cookies", outside articles also "all rights reserved") are bad. Being inside an article is a reason to stay, not a verdict: there
enough length and stop words decide good, runs of short links decide bad, and the rest is undecided. Outside, link density
decides bad; long text with many stop words is good by itself, and where no article holds decided text, so are paragraphs of
medium length in a run of text that is long enough together, with up to three short blocks that lead it (a title, a name, a
date) and one that ends it. On pages whose words are of none of the stop-word languages, length and links decide alone. Pass two gives each
undecided (mostly short) block the label of its nearest decided neighbour: inside an article of those decided there, outside
of those outside, marked parts included; neighbours at one distance that disagree make it good inside an article, bad outside.

Time and memory are linear in a page's length, whatever it holds: tags are scanned once from left to right, an unclosed
quote ends at the next ">", and closing tags without an open element cost nothing. Pages are independent: no shuffle, one
page's memory at a time. Null html is an empty page with empty text; equal rows give equal rows; a page without tags is one
block; if nothing on a page can be decided, what no mark speaks against stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of a block's characters inside links from which it is navigation, outside an article.
LINKS = 0.33
#: Blocks of fewer characters can't be decided by their words; outside articles blocks of LONG characters are good, or runs of such.
SHORT, LONG = 70, 200
#: Blocks of fewer characters can be notices; so many short link blocks in a row are a menu; so many short blocks lead a text.
NOTICE, MENU, LEAD = 160, 2, 3
STOP_LOW, STOP_HIGH = 0.12, 0.25
#: A page with a smaller share of stop words than this is in another language.
KNOWN = 0.05

STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were what when which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une "
    "als auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nach nicht noch oder sein sich sie sind über um und von war wie zu zum "
    "al como con cuando del el ella en entre era es esa ese esta este fue ha hay la las lo los más me no o para pero por que se si sin sobre su sus también un una y".split()
)

#: What notices, adverts and forms say, in the four languages; and what footers say, which an article may say of itself too.
_PROMPTS = re.compile(
    r"(?<!\w)(?:(?:accept|use|uses|using|manage|allow|reject) (?:all |our |these |the )?cookies|cookie (?:policy|settings|preferences)|"
    r"sign (?:up|in) (?:to|for|now|here)|subscribe (?:to|now|here)|log ?in to|share this|follow us|advertisements?|sponsored (?:content|post|by)|skip to (?:main )?content|click here to|"
    r"cookies? (?:akzeptieren|zulassen|verwenden)|newsletter abonnieren|jetzt anmelden|accepter (?:les |nos )?cookies|abonnez-vous|aceptar (?:las |nuestras )?cookies|suscríbete)(?!\w)",
    re.I,
)
_LEGAL = re.compile(
    r"(?<!\w)(?:privacy policy|terms of (?:use|service)|all rights reserved|alle rechte vorbehalten|datenschutzerklärung|tous droits réservés|politique de confidentialité|"
    r"todos los derechos reservados|política de privacidad)(?!\w)|[©®]",
    re.I,
)

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|[!?])")
_PLAIN = re.compile(r"[^>\"']*+")
_NAMES = re.compile(r"""(?:\A|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+>", re.I) for x in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
_IN_HEAD = frozenset("meta link title style script base noscript template".split())
#: Elements whose content is never main text; elements that are no text at all, with blocks inside or not.
_OUT = frozenset("nav footer aside form dialog menu head fieldset".split())
_HELD = frozenset("noscript template svg object canvas audio video".split())
_DROPPED = frozenset("button select datalist".split())
#: Parts that are out by name but may hold a whole page.
_SOFT = frozenset("form fieldset header".split())
#: Tokens of class, id or role that mark a part as out, alone or joined to words of the second list.
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe "
    "popup modal overlay sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist reply replies respond disqus share sharing social "
    "related recommended login signup search pagination pager skip toolbar copyright legal complementary contentinfo".split()
)
_PLACES = frozenset(
    "site page global main top bottom left right primary secondary upper lower inner outer box boxes wrap wrapper container section area region block blocks list lists item items group row col column "
    "bar panel slot unit text body content title heading link links button buttons icon icons form post posts article articles story stories thread header head template part widget field id".split()
)
_HEADER_WORDS = frozenset(["header", "topbar"])
_MAIN_WORDS = frozenset("article main main-content post-content entry-content article-body article-content post-body story-body".split())


def _tokens(attrs: str) -> set[str]:
    return {t for m in _NAMES.findall(attrs) for t in "".join(m).lower().split()} if "=" in attrs else set()


def _marked(tokens: set[str]) -> bool:
    """Whether a token says that the part is not main text: of its words one says so, the others only where it stands."""
    for t in tokens:
        words = _PART.findall(t)
        if any(w in _OUT_WORDS for w in words) and all(w in _OUT_WORDS or w in _PLACES for w in words):
            return True
    return False


class _Mark:
    """A part that is out, inside another such part or not; soft marks can be void."""

    __slots__ = ("out", "parent", "set", "soft")

    def __init__(self, parent: _Mark | None, soft: bool):
        self.parent, self.soft, self.set, self.out = parent, soft, True, True


def _void_around(mains: list[_Mark | None], size: list[int], marks: list[_Mark]) -> None:
    """Where every article stands in a part that is out, soft marks around the largest are void. Marks are in order of opening."""
    if not mains or any(m is None for m in mains):
        return
    m = mains[size.index(max(size))]
    while m is not None:
        m.set = m.set and not m.soft
        m = m.parent
    for m in marks:
        m.out = m.set or (m.parent is not None and m.parent.out)


def blocks(html: str) -> list[tuple[str, float, bool, bool]]:
    """(text, share of it in links, whether it is inside a main element, whether it is in a part that is out), in page order."""
    found: list[tuple[str, float, int, _Mark | None]] = []
    text: list[str] = []
    linked = total = 0
    stack: list[tuple[str, _Mark | None, int, bool, bool]] = []  # open elements: name, mark, number of the article, no text, inline; these hold for what is inside
    opened: Counter[str] = Counter()
    marks: list[_Mark] = []
    mains: list[_Mark | None] = []
    mark: _Mark | None = None
    leaf: _Mark | None = None
    main, dropped = 0, False

    def close() -> None:
        nonlocal linked, total, leaf
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                found.append((whole, linked / max(total, 1), main, leaf or mark))
            text.clear()
        linked = total = 0
        leaf = None

    def add(piece: str) -> None:
        nonlocal linked, total
        if piece and not dropped:
            text.append(piece)
            n = len(piece.strip())
            total += n
            linked += n if opened["a"] else 0

    def push(name: str, new: bool, soft: bool, is_main: bool = False, drop: bool = False, inline: bool = False) -> None:
        nonlocal mark, main, dropped
        if new:
            mark = _Mark(mark, soft)
            marks.append(mark)
        if is_main:
            mains.append(mark)
            main = main or len(mains)
        dropped = dropped or drop
        stack.append((name, mark, main, dropped, inline))
        opened[name] += 1

    def pop(to: int) -> None:
        nonlocal mark, main, dropped
        for x in stack[to:]:
            opened[x[0]] -= 1
        del stack[to:]
        _, mark, main, dropped, _ = stack[-1] if stack else ("", None, 0, False, False)

    def pop_name(name: str) -> None:
        if opened[name]:
            i = len(stack) - 1
            while stack[i][0] != name:
                i -= 1
            pop(i)

    at, last = 0, html.rfind(">")
    while at <= last:  # no tag ends beyond the last ">"
        m = _TAG.search(html, at, last)
        if m is None:
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<!--":
                end = html.find("-->", at - 2)  # "<!-->" is a whole comment
                at = end + 3 if end >= 0 else len(html)
            else:
                at = html.find(">", at) + 1
            continue
        begin = at
        while html[at := _PLAIN.match(html, at).end()] != ">":  # the next quote counts if it is closed before the last ">"
            end = html.find(html[at], at + 1, last)
            if end < 0:
                at = html.find(">", at)
                break
            at = end + 1
        attrs, name, ending = html[begin:at], name.lower(), bool(m[1])
        at += 1
        if opened["head"] and not ending and name not in _IN_HEAD:
            close()
            pop_name("head")
        if name in _RAW:
            if not ending:
                e = _RAW[name].search(html, at, last + 1)
                at = e.end() if e else len(html)
            continue
        if name in _VOID:
            if name == "br":
                add(" ")
            continue
        if name in _HELD:
            if ending:
                pop_name(name)
            elif not attrs.endswith("/"):
                push(name, False, False, drop=True)
            continue
        if name not in _BLOCK:
            if ending:
                for i in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
                    if not stack[i][4] or stack[i][0] == name:
                        if stack[i][4]:
                            pop(i)
                        break
            elif name == "a":
                if stack and stack[-1][0] == "a":
                    pop(len(stack) - 1)
                push("a", False, False, inline=True)
            elif name in _DROPPED or (attrs and _marked(_tokens(attrs))):
                push(name, False, False, drop=True, inline=True)
            continue
        close()
        i = len(stack)
        while i and stack[i - 1][4]:  # an inline element doesn't outlive its block
            i -= 1
        if i < len(stack):
            pop(i)
        if name in _LEAF:
            if attrs and not ending and _marked(_tokens(attrs)):
                leaf = _Mark(mark, False)
                marks.append(leaf)
            continue
        if ending:
            pop_name(name)
            continue
        if name in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        tokens = _tokens(attrs)
        by_word = name not in ("html", "body") and bool(tokens) and (_marked(tokens) or (not main and bool(tokens & _HEADER_WORDS)))
        out = name in _OUT or (name == "header" and not main) or by_word
        push(name, out, name not in _OUT or name in _SOFT, name in ("article", "main") or bool(tokens & _MAIN_WORDS and name in ("div", "section")))
    if at < len(html):
        add(html[max(at, 0) :])
    close()
    size = [0] * len(mains)
    for t, _, number, _ in found:
        if number:
            size[number - 1] += len(t)
    _void_around(mains, size, marks)
    return [(t, share, number > 0, m is not None and m.out) for t, share, number, m in found]


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))


def notice(text: str, main: bool) -> bool:
    """Whether a short block says of itself that it is a notice, an advert or a form, outside articles also that it is a footer."""
    return len(text) < NOTICE and (_PROMPTS.search(text) is not None or (not main and _LEGAL.search(text) is not None))


def _runs(flags: list[bool]) -> Iterator[range]:
    """Maximal runs of true flags."""
    at = 0
    for flag, group in groupby(flags):
        n = len(list(group))
        if flag:
            yield range(at, at + n)
        at += n


def first_labels(found: list[tuple[str, float, bool, bool]]) -> list[int]:
    """1 good, 0 bad, -1 undecided, of each block by itself and the run that it stands in; the language is told from all of them."""
    share = [0.0 if out or len(text) < SHORT else stop_share(text) for text, _, _, out in found]
    weight = [0 if out or len(text) < SHORT else len(text) for text, _, _, out in found]
    known = sum(s * w for s, w in zip(share, weight, strict=True)) >= KNOWN * sum(weight)
    said = [notice(text, main) for text, _, main, _ in found]
    speaks = [len(b[0]) >= SHORT and b[1] <= LINKS and not b[3] and not n and (s >= STOP_LOW or not known) for b, s, n in zip(found, share, said, strict=True)]
    labels = []
    for (text, links, main, out), s, is_notice, is_text in zip(found, share, said, speaks, strict=True):
        if out or is_notice or (not main and links > LINKS):
            labels.append(0)
        elif main:
            labels.append(1 if is_text else -1)
        elif len(text) < SHORT:
            labels.append(-1)
        elif len(text) >= LONG and (s >= STOP_HIGH or not known):
            labels.append(1)
        else:
            labels.append(0 if known and s < STOP_LOW else -1)
    for run in _runs([main and not out and links > LINKS and len(text) < SHORT for text, links, main, out in found]):
        if len(run) >= MENU:
            for i in run:
                labels[i] = 0
    if not any(x and b[2] for x, b in zip(speaks, found, strict=True)):
        for run in _runs([not b[2] and not b[3] and b[1] <= LINKS and not n for b, n in zip(found, said, strict=True)]):
            if sum(len(found[i][0]) for i in run if speaks[i]) >= LONG:
                for i in run:  # what has few stop words amid text, as a list of names, is undecided
                    labels[i] = 1 if speaks[i] else -1 if labels[i] == 0 else labels[i]
                first = next(i for i in run if labels[i] == 1)
                last = next(i for i in reversed(run) if labels[i] == 1)
                for i in (*range(max(run[0], first - LEAD), first), *range(last + 1, min(last + 2, run[-1] + 1))):
                    labels[i] = 1 if len(found[i][0]) < SHORT else labels[i]
    return labels


def inherit(found: list[tuple[str, float, bool, bool]], labels: list[int]) -> list[int]:
    """Labels in which undecided blocks follow their nearest decided neighbour of the same region, inside main elements or outside."""
    out, n = list(labels), len(found)
    for inside in (True, False):
        region = [i for i in range(n) if found[i][2] == inside]
        votes = [i for i in region if labels[i] >= 0 and not (inside and found[i][3])]
        at = 0
        for i in region:
            if labels[i] >= 0:
                continue
            while at < len(votes) and votes[at] < i:
                at += 1
            before, after = (votes[at - 1] if at else None), (votes[at] if at < len(votes) else None)
            if before is None and after is None:
                out[i] = int(inside)
            elif before is None or after is None:
                out[i] = labels[after if before is None else before]
            elif labels[before] == labels[after] or i - before < after - i:
                out[i] = labels[before]
            else:
                out[i] = labels[after] if after - i < i - before else int(inside)
    return out


def main_text(html: str) -> str:
    found = blocks(html)
    labels = first_labels(found)
    if not any(x == 1 for x in labels) and not any(b[2] and not b[3] for b in found) and any(x < 0 for x in labels) and all(x < 0 or b[3] for x, b in zip(labels, found, strict=True)):
        labels = [int(x < 0) for x in labels]  # nothing to inherit from but marked parts: what no mark speaks against stays
    else:
        labels = inherit(found, labels)
    return "\n\n".join(b[0] for b, x in zip(found, labels, strict=True) if x)


def extract(pages: DataFrame, html: str = "html", key: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """key columns, text and n_chars (its code points) per row of pages."""
    schema = ", ".join([f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in key] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py() or "") for v in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*key, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*key, html])).mapInArrow(run, schema)
