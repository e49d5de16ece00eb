"""HTML extraction by a suffix array over the host's pages, with article markup protected.

A small scanner cuts a page into blocks. Each page's blocks, those in menus and footers as well,
go into its host's group, where the token streams are concatenated and the suffix array is built
by prefix doubling up to LONG tokens. It finds the substrings of LONG tokens or more that occur on
two pages or more, and beside it runs of whole blocks below that length are counted by page
(``least_pages``). What a block is decides what the repeats mean for it:

- PROTECTED, inside a marked-up article (or main element): stays. Quoted and copied articles are
  repeats too, and a suffix array alone would cut them.
- SUSPECT, inside an article under a class or id that only begins like boilerplate ("share-price"): goes if a
  repeat covers it, stays if it is the page's own. Where the name speaks of comments, adverts or consent
  ("comment-list", "reader-comments", "google-ad"), its container is a token of the page's structure, which goes
  into a second array: a container that another page of the host has in the same place goes with whatever
  text it holds, one that only this page has stays. On a host of one page the name alone decides.
- OPEN, on a page without such markup: what repeats cover goes, the unique runs stay.
- DROPPED, in a menu, footer, sidebar, advert or comments by element, role or whole class name, in a form
  whose fields outweigh its text, or outside the article of a page that has one: goes, but its text counts as a repeat for others.

A host of more than GROUP_CHARS characters of html doesn't fit a task. There the same windows are
compared in Spark by 64-bit key: every window has an anchor, the ANCHOR tokens in it with the
least hash, which the same window has everywhere; anchors on two pages or more are found first, and
only windows around such an anchor are compared whole. So a repeat is found wherever its pages are.

Defined results: null and empty html give an empty text; cut-off tags and elements end with the
page; an article without text is none; repeated rows are extracted each and count as one page where
their url and id agree; a null url is a host of its own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import cut_lineage, join_hot, read_table

#: Tokens of a repeat that is cut wherever it lies, and of whole blocks that are cut if enough pages have them.
LONG, MIDDLE, SHORT = 30, 10, 4
ANCHOR = 15
GROUP_CHARS = 16_000_000
#: Up to so many large hosts are broadcast by name.
MAX_LISTED = 100_000
DROPPED, SUSPECT, OPEN, PROTECTED = range(4)

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
HIDDEN_FIELD = re.compile(r"""\btype\s*=\s*["']?hidden\b""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
NOT_TEXT = frozenset("nav footer aside menu button select dialog head".split())
FIELDS = frozenset("input select button".split())
#: A form of fewer words a field is one; a form around a page's text isn't.
FIELD_WORDS = 12
WITHIN_P = INLINE | {"br"}
MARKED = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice sidebar"
    " menu navbar nav navigation breadcrumb breadcrumbs header masthead footer comment comments respond disqus share sharing social"
    " related newsletter subscribe signup popup modal overlay widget login pagination pager toolbar".split()
)
#: Marks that a paragraph or heading can bear for what it tells.
OF_CONTENT = frozenset("banner promo promotion notice header related social share sharing overlay widget menu navigation signup popup".split())
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote figcaption dt dd".split())
#: What a container's name says of comments, adverts and consent wherever it stands in it, unless a word before denies it.
SPEAKING = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus respond newsletter consent gdpr".split())
COOKIE_WORDS = frozenset("notice banner bar consent popup message policy warning info".split())
DENIED = frozenset("no not without has is".split())
#: "site-header" is marked as "header" is; "comments-open" tells how a page is set, not what an element holds.
WHOLE_SITE = frozenset("site main primary secondary top bottom global".split())
FLAGS = frozenset("open opened closed on off none free enabled disabled active inactive allowed".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of each; values without quotes."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def is_mark(name: str) -> bool:
    """Whether a class name or id is a mark, begins with one, or is one of the whole site's."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if len(parts) > 1 and (parts[-1] in FLAGS or (parts[0] == "sidebar" and parts[-1] in ("left", "right"))):
        return False
    return bool(parts) and (parts[0] in MARKED or (len(parts) == 2 and parts[0] in WHOLE_SITE and parts[1] in MARKED))


def speaks(name: str) -> bool:
    """Whether a class name or id of several words speaks of comments, adverts or consent."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if len(parts) < 2 or parts[-1] in FLAGS or parts[0] in DENIED:
        return False
    return any(p in SPEAKING for p in parts) or (any(p in ("cookie", "cookies") for p in parts) and any(p in COOKIE_WORDS for p in parts))


def marked_as(attributes: dict[str, str], main: bool = False, inside: bool = False, element: str = "div") -> int:
    """DROPPED, SUSPECT (by a name that only begins like a mark, ``inside`` an article, or that speaks of
    boilerplate) or OPEN; class and id don't count for a main element.
    """
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    if hidden or attributes.get("role", "").lower() in ROLES or ("style" in attributes and NOT_SHOWN.search(attributes["style"])):
        return DROPPED
    names = [] if main else f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if not names:
        return OPEN
    if element in TEXT_LEVEL:
        names = [n for n in names if not OF_CONTENT & {p.lower() for p in PARTS.findall(n)[:1]}]
    if any(n.lower() in MARKED for n in names):
        return DROPPED
    if any(map(is_mark, names)):
        return SUSPECT if inside else DROPPED
    return SUSPECT if any(map(speaks, names)) else OPEN


def signature(name: str, attributes: dict[str, str]) -> str:
    """An element as a token of a page's structure: its name, class and id without numbers."""
    return f"{name}.{re.sub('[0-9]+', '', attributes.get('class', ''))}#{re.sub('[0-9]+', '', attributes.get('id', ''))}"


def read_page(html: str) -> tuple[list[str], list[int]]:
    """All blocks of text in page order and what each of them is."""
    blocks, kinds, _ = read_structure(html)
    return blocks, kinds


def read_structure(html: str) -> tuple[list[str], list[int], list[str]]:
    """``read_page``, and for each SUSPECT block the outermost container that speaks of boilerplate, as the
    signatures of what it stands in and of itself ("" for others).
    """
    blocks: list[str] = []
    kinds: list[int] = []
    zones: list[str] = []
    holders: list[str] = []
    stack: list[tuple] = []  # element, zone inside it, what its text is, the container it is in, name and attributes, blocks and fields before it
    zone, state, holder, text, fields = "open", OPEN, "", [], 0

    def end_block() -> None:
        if text:
            words = unescape("".join(text)).split()
            if words:
                blocks.append(" ".join(words))
                kinds.append(state)
                zones.append(zone)
                holders.append(holder)
            text.clear()

    def end_form(begun: int, before: int) -> None:
        words = sum(b.count(" ") + 1 for b in blocks[begun:])
        if words < FIELD_WORDS * (fields - before):
            kinds[begun:] = [DROPPED] * (len(kinds) - begun)

    def close(depth: int) -> None:
        nonlocal zone, state, holder
        below = stack[depth - 1][1:4] if depth else ("open", OPEN, "")
        if below != (zone, state, holder) or any(s[0] not in INLINE for s in stack[depth:]):
            end_block()
        for s in stack[depth:]:
            if s[0] == "form":
                end_form(*s[5:])
        del stack[depth:]
        zone, state, holder = below

    at = 0
    for m in PIECE.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                end_block()
                fields += m[1].lower() == "textarea"
            continue
        name = name.lower()
        if m[2]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None and (name not in INLINE or all(s[0] in INLINE for s in stack[depth:])):
                close(depth)
            continue
        fields += name in FIELDS and not HIDDEN_FIELD.search(m[4])
        if name in VOID:
            if name not in INLINE:
                end_block()
            continue
        if name not in WITHIN_P:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] not in INLINE), None)
            if depth is not None and stack[depth][0] == "p":
                close(depth)
            if name == "li":
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ("li", "ul", "ol")), None)
                if depth is not None and stack[depth][0] == "li":
                    close(depth)
            end_block()
        attributes = attributes_of(m[4]) if m[4].strip(" /") else {}
        main = name in ("article", "main") or attributes.get("role", "").lower() == "main"
        mark = OPEN if not attributes or name in ("html", "body") else marked_as(attributes, main, zone != "open", name)
        begun, before = len(blocks), fields
        if main and mark == OPEN:
            end_block()
            begun = len(blocks)
            zone, state = ("article" if name == "article" else "main" if zone == "open" else zone), OPEN
        else:
            if name in NOT_TEXT or (name == "header" and zone == "open"):
                mark = DROPPED
            if mark < state:
                end_block()
                state = mark
                if mark == SUSPECT and any(map(speaks, f"{attributes.get('class', '')} {attributes.get('id', '')}".split())):
                    holder = f"{signature(*stack[-1][4]) if stack else ''}\n{signature(name, attributes)}"
            begun = len(blocks)
        if m[4].endswith("/") and name not in INLINE:
            zone, state, holder = stack[-1][1:4] if stack else ("open", OPEN, "")
            continue
        stack.append((name, zone, state, holder, (name, attributes), begun, before))
    if at < len(html):
        text.append(html[at:])
    end_block()
    for s in stack:
        if s[0] == "form":
            end_form(*s[5:])
    there = {z for z, k in zip(zones, kinds) if k}
    own = next((kind for kind in ("article", "main") if kind in there), None)
    if own is None:
        kinds = [OPEN if k == SUSPECT and not h else k for k, h in zip(kinds, holders)]
    else:
        kinds = [(PROTECTED if k == OPEN else k) if z == own else DROPPED for k, z in zip(kinds, zones)]
    return blocks, kinds, [h if k == SUSPECT else "" for h, k in zip(holders, kinds)]


def page_blocks(html: str) -> tuple[list[str], bool]:
    """The blocks that markup keeps, and whether an article (or main element) holds them."""
    blocks, kinds = read_page(html)
    return [b for b, k in zip(blocks, kinds) if k != DROPPED], PROTECTED in kinds or SUSPECT in kinds


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by the first ``depth`` tokens, and for each suffix in it whether its first
    ``depth`` tokens differ from those of the one before.

    Prefix doubling: suffixes are ranked by their first 2**k tokens, two ranks at a distance make
    the rank of twice the length, and the last step overlaps the two halves to end at ``depth``.
    """
    n, width = len(tokens), 1
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        step = min(width, depth - width)
        second = np.zeros(n, np.int64)
        if step:
            second[: max(0, n - step)] = rank[step:]
        key = rank * np.int64(n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        if width + step >= depth:
            return order, new
        rank[order] = np.cumsum(new)
        width += step


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which tokens lie in a substring of ``long`` tokens or more that occurs on two pages or more."""
    n = len(tokens)
    if n < long:
        return np.zeros(n, bool)
    order, new = suffix_order(tokens, long)
    first = np.flatnonzero(new)
    pages = page[order]
    apart = np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first)
    starts = order[apart[np.cumsum(new) - 1]]
    starts = starts[starts <= n - long]
    steps = np.zeros(n + 1, np.int64)
    steps[starts] += 1
    steps[starts + long] -= 1
    return np.cumsum(steps[:-1]) > 0


def block_runs(blocks: list[str]) -> Iterator[tuple[int, int, str]]:
    """First token, end and text of the shortest run of whole blocks from each block that has SHORT
    tokens or more, if it has fewer than LONG: menus of one-word items and notices, not phrases inside prose.
    """
    ends = np.cumsum([b.count(" ") + 1 for b in blocks]).tolist()
    for i in range(len(blocks)):
        start = ends[i - 1] if i else 0
        j = next((j for j in range(i, min(len(blocks), i + SHORT)) if ends[j] - start >= SHORT), None)
        if j is not None and ends[j] - start < LONG:
            yield start, ends[j], "\n".join(blocks[i : j + 1])


def least_pages(tokens: int, pages: int) -> int:
    """On how many of a host's pages a run of whole blocks has to be: 3, or all of 2; a hundredth if it is under MIDDLE tokens."""
    return max(2, min(3, pages), -(-pages // 100) if tokens < MIDDLE else 0)


class Page:
    """A page's streams: ``kept`` of what may stay, ``rest`` of what goes; ``open`` tells which tokens of ``kept`` may go.
    holders: the containers of the SUSPECT blocks.
    """

    def __init__(self, blocks: Iterable[str], kinds: str, holders: Iterable[str] = ()) -> None:
        self.blocks = [(b, int(k)) for b, k in zip(blocks, kinds)]
        self.holders = list(holders)
        own = [(b, k) for b, k in self.blocks if k != DROPPED]
        self.kept, self.rest = _words(b for b, _ in own), _words(b for b, k in self.blocks if k == DROPPED)
        sizes = [b.count(" ") + 1 for b, _ in own]
        self.kinds = np.repeat(np.array([k for _, k in own], np.int8), sizes)
        self.open = self.kinds != PROTECTED

    def runs(self) -> Iterator[tuple[int, int, str, int]]:
        """First token in ``kept``, end and text of each run of whole unprotected blocks, and what it is."""
        at, part, begin = 0, [], 0
        for block, kind in [*((b, k) for b, k in self.blocks if k != DROPPED), ("", PROTECTED)]:
            if kind == PROTECTED or (part and part[-1][1] != kind):
                yield from ((begin + s, begin + e, run, part[0][1]) for s, e, run in block_runs([b for b, _ in part]))
                part, begin = [], at
            if kind != PROTECTED:
                part.append((block, kind))
            at += block.count(" ") + 1
            if kind == PROTECTED:
                begin = at

    def held(self) -> Iterator[tuple[int, int, str]]:
        """First token in ``kept`` and end of each block in a container that speaks of boilerplate, and the container."""
        at, holders = 0, iter(self.holders)
        for block, kind in self.blocks:
            if kind != DROPPED:
                end = at + block.count(" ") + 1
                if kind == SUSPECT and (holder := next(holders, "")):
                    yield at, end, holder
                at = end

    def run_texts(self) -> set[str]:
        """The runs that count for others: those of unprotected blocks and those of dropped ones."""
        return {run for _, _, run, _ in self.runs()} | {run for _, _, run in block_runs([b for b, k in self.blocks if k == DROPPED])}

    def text(self, gone: np.ndarray) -> str:
        gone = gone & self.open
        return " ".join(w for w, g in zip(self.kept, gone) if not g) if gone.any() else " ".join(self.kept)


def _page_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [read_structure(h) for h in batch["html"]]
        lists = lambda rows: pd.Series(rows, batch.index, object)
        blocks, kinds = lists([b for b, _, _ in read]), ["".join(map(str, k)) for _, k, _ in read]
        holders = lists([[x for x, kind in zip(h, k) if kind == SUSPECT] for _, k, h in read])
        yield batch.assign(page_id=batch["page_id"].astype("Int64"), blocks=blocks, kinds=kinds, holders=holders).drop(columns="html")


def _words(blocks: Iterable[str]) -> list[str]:
    return [w for b in blocks for w in b.split(" ")]


def _texts(rows: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"page_id": rows["page_id"].astype("Int64"), "url": rows["url"], "text": pd.array(texts, "object")})


def repeated_containers(pages: list[tuple[int, Page]], many: int) -> set[str]:
    """Of the containers that speak of boilerplate those that two pages have, by the suffix array of the pages' structure
    tokens (what a container stands in, then itself); all of them on a host of one page.
    """
    found = [(number, holder) for number, page in pages for holder in dict.fromkeys(h for _, _, h in page.held())]
    if many < 2 or not found:
        return {h for _, h in found}
    names: dict[str, int] = {}
    outer, inner = ([names.setdefault(part, len(names)) for part in (h.split("\n")[k] for _, h in found)] for k in (0, 1))
    tokens = np.stack([outer, inner, -1 - np.arange(len(found))], 1).ravel()  # the last ends a container, unlike any other token
    again = repeated_tokens(tokens, np.repeat([n for n, _ in found], 3), 2)
    return {h for (_, h), repeated in zip(found, again[::3]) if repeated}


def _host_text(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts of one host's pages, without what their streams repeat."""
    known: dict[str, int] = {}
    read, ids, sizes = [Page(b, k, h) for b, k, h in zip(rows["blocks"], rows["kinds"], rows["holders"])], [], []
    number = {page: k for k, page in enumerate(dict.fromkeys(rows["page"]))}
    for k, page in enumerate(read):
        for stream in (page.kept, page.rest):
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in stream), np.int32, len(stream)))
            ids.append(np.array([-1 - 2 * k - (stream is page.rest)], np.int32))  # ends the stream, unlike any other token
        sizes.append(len(page.kept) + len(page.rest) + 2)
    del known
    tokens = np.concatenate(ids)
    gone = repeated_tokens(tokens, np.repeat([number[p] for p in rows["page"]], sizes), LONG)
    on: dict[str, set[int]] = {}
    for name, page in zip(rows["page"], read):
        for run in page.run_texts():
            on.setdefault(run, set()).add(name)
    everywhere = repeated_containers([(number[name], page) for name, page in zip(rows["page"], read)], len(number))
    texts, at = [], 0
    for page, size in zip(read, sizes):
        own = gone[at : at + len(page.kept)]
        for start, end, holder in page.held():
            if holder in everywhere:
                own[start:end] = True
        for start, end, run, kind in page.runs():
            if len(on[run]) >= (2 if kind == SUSPECT else least_pages(end - start, len(number))):
                own[start:end] = True
        texts.append(page.text(own))
        at += size
    return _texts(rows, texts)


def _hashes(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, object), categorize=False) if strings else np.zeros(0, np.uint64)


def gram_keys(hashed: np.ndarray, size: int, host: int) -> np.ndarray:
    """A 64-bit key of the host and each ``size`` tokens, given the tokens' hashes."""
    n = len(hashed) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    made = np.full(n, np.uint64(size))
    for k in range(size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    made = made * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(host)
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xD6E8FEB86659FD93)
    return made ^ (made >> np.uint64(32))


def windows_of(page: Page, host: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the kept stream, then the other: keys of its windows of LONG tokens, of their anchors, and
    whether a token of the window may go.
    """
    for stream, may_go in ((page.kept, page.open), (page.rest, None)):
        hashed = _hashes(stream)
        keys, grams = gram_keys(hashed, LONG, host), gram_keys(hashed, ANCHOR, host)
        if not len(keys):
            yield keys, keys, np.zeros(0, bool)
            continue
        anchors = np.lib.stride_tricks.sliding_window_view(grams, LONG - ANCHOR + 1).min(1)
        wanted = np.zeros(len(keys), bool) if may_go is None else np.lib.stride_tricks.sliding_window_view(may_go, LONG).any(1)
        yield keys, anchors, wanted


def _host_number(host: str) -> int:
    return int(_hashes([host])[0])


def run_keys(runs: Iterable[str], host: int) -> np.ndarray:
    """A 64-bit key of the host and each run of blocks."""
    return (_hashes(list(runs)) * np.uint64(0x165667B19E3779F9) + np.uint64(host)).view(np.int64)


def _pages(batch: pd.DataFrame) -> Iterator[tuple[int, int, Page]]:
    for page, host, blocks, kinds, holders in zip(batch["page"], batch["host"], batch["blocks"], batch["kinds"], batch["holders"]):
        yield page, _host_number(host), Page(blocks, kinds, holders)


def _distinct(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys that are wanted at least once, and the others."""
    found, row = np.unique(keys, return_inverse=True)
    some = np.bincount(row, weights=wanted, minlength=len(found)) > 0
    return found[some].view(np.int64), found[~some].view(np.int64)


def _page_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(page, wanted, others: distinct anchors; runs, least, more: distinct runs). ``least`` goes with ``runs``;
    ``more`` only count for others.
    """
    for batch in batches:
        out = []
        for (name, host, page), pages in zip(_pages(batch), batch["pages"]):
            (_, a, wa), (_, b, wb) = windows_of(page, host)
            least = {run: 2 if kind == SUSPECT else least_pages(end - start, pages) for start, end, run, kind in page.runs()}
            more = sorted(page.run_texts() - set(least))
            least |= {holder: min(2, pages) for _, _, holder in page.held()}
            out.append((name, *_distinct(np.concatenate([a, b]), np.concatenate([wa, wb])), run_keys(least, host), np.array([*least.values()], np.int64), run_keys(more, host)))
        yield pd.DataFrame(out, columns=["page", "wanted", "others", "runs", "least", "more"])


def _window_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(page, wanted, others) of the distinct windows of a page around one of its ``anchors``."""
    for batch in batches:
        out = []
        for (name, host, page), anchors in zip(_pages(batch), batch["anchors"]):
            (ka, aa, wa), (kb, ab, wb) = windows_of(page, host)
            near = np.isin(np.concatenate([aa, ab]).view(np.int64), np.asarray(anchors, np.int64))
            out.append((name, *_distinct(np.concatenate([ka, kb])[near], np.concatenate([wa, wb])[near])))
        yield pd.DataFrame(out, columns=["page", "wanted", "others"])


def _without_repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for (_, host, page), windows, runs in zip(_pages(batch), batch["windows"], batch["runs"]):
            steps = np.zeros(len(page.kept) + 1, np.int64)
            keys = gram_keys(_hashes(page.kept), LONG, host).view(np.int64)
            starts = np.flatnonzero(np.isin(keys, np.asarray([] if windows is None else windows, np.int64)))
            steps[starts] += 1
            np.add.at(steps, starts + LONG, -1)
            own = [*page.runs(), *page.held()]
            for k in np.flatnonzero(np.isin(run_keys([r[2] for r in own], host), np.asarray([] if runs is None else runs, np.int64))):
                steps[own[k][0]] += 1
                steps[own[k][1]] -= 1
            texts.append(page.text(np.cumsum(steps[:-1]) > 0))
        yield _texts(batch, texts)


def _repeated(keys: DataFrame) -> DataFrame:
    """(page, keys): the keys of each page that two pages or more have and that some page wants."""
    every = keys.select("page", F.explode("wanted").alias("key"), F.lit(True).alias("wanted")).unionByName(
        keys.select("page", F.explode("others").alias("key"), F.lit(False).alias("wanted"))
    )
    seen = every.groupBy("key").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.max("wanted").alias("some"), F.count("*").alias("n"))
    found = seen.where("low <> high AND some").select("key", "n")
    return join_hot(every.select("page", "key"), found, "key", "n").groupBy("page").agg(F.collect_set("key").alias("keys"))


def _large_hosts_text(rows: DataFrame, schema: str) -> DataFrame:
    """What ``_host_text`` gives, for hosts of any number of pages: windows and runs are compared by key in Spark."""
    keys = cut_lineage(rows.mapInPandas(
        _page_keys, "page long, wanted array<long>, others array<long>, runs array<long>, least array<long>, more array<long>"
    ))
    near = _repeated(keys).withColumnRenamed("keys", "anchors")
    windows = cut_lineage(rows.join(near, "page").mapInPandas(_window_keys, "page long, wanted array<long>, others array<long>"))
    long = _repeated(windows).withColumnRenamed("keys", "windows")
    own = keys.select("page", F.explode(F.arrays_zip("runs", "least")).alias("r")).select("page", F.col("r.runs").alias("key"), F.col("r.least").alias("least")).distinct()
    runs = own.unionByName(keys.select("page", F.explode("more").alias("key"), F.lit(None).cast("long").alias("least")).distinct())
    often = runs.groupBy("key").agg(F.countDistinct("page").alias("n"), F.min("least").alias("_least")).where("n >= _least").drop("_least")
    short = join_hot(own.select("page", "key"), often, "key", "n").groupBy("page").agg(F.collect_set("key").alias("runs"))
    return rows.join(long, "page", "left").join(short, "page", "left").mapInPandas(_without_repeats, schema)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of ``pages``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.lower(host).alias("host"))
    rows = rows.withColumn("page", F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    hosts = rows.groupBy("host").agg(F.count("*").alias("rows"), F.sum(F.length("html")).alias("chars"))
    large = cut_lineage(hosts.where(F.col("chars") > GROUP_CHARS).select("host", "rows"))
    n_large = large.count()
    schema = "page_id long, url string, text string"
    parsed = "page_id long, url string, host string, page long, blocks array<string>, kinds string, holders array<string>"
    listed = F.broadcast(large) if n_large <= MAX_LISTED else large
    small = rows.join(listed, "host", "left_anti").mapInPandas(_page_blocks, parsed).groupBy("host").applyInPandas(_host_text, schema)
    if not n_large:
        return small
    # the pages of large hosts, with how many their host has
    own = rows.join(listed.drop("rows"), "host", "left_semi") if n_large <= MAX_LISTED else join_hot(rows, large, "host", "rows").drop("rows")
    counted = own.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    own = own.join(F.broadcast(counted), "host") if n_large <= MAX_LISTED else join_hot(own, counted, "host", "pages")
    own = own.mapInPandas(_page_blocks, parsed + ", pages long")
    return small.unionByName(_large_hosts_text(own, schema))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html": op7_html}
ORACLE_SQL: dict[str, str] = {}
