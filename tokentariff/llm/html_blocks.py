"""Text blocks of an HTML page with the element path of each, for use inside tasks."""

from __future__ import annotations

import html
import re

import xxhash

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = re.compile(r"class|id|role|hidden|style", re.I)
# Elements by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s "
    "samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article section div nav aside body".split())
# What is never part of an article, by element and by word of a class, id or role.
OUTSIDE = frozenset(
    "nav header footer aside form button select option menu dialog head object audio video "
    "canvas".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets search contentinfo complementary alert "
    "dialog".split())
# What is no part of an article even inside its slot: elements, and a whole class, id or role.
NEVER = frozenset(
    "nav aside form button select option menu dialog head object audio video canvas".split())
NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored comment comments commentlist disqus"
    .split())
ARTICLE = frozenset(["article", "main"])
WORDS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "parent", "text", "outside", "article", "links", "never")

    def __init__(self, path, parent, text, outside, article, links, never):
        self.path, self.parent, self.text = path, parent, text
        self.outside, self.article, self.links, self.never = outside, article, links, never


def _attributes(source: str) -> tuple[str, bool]:
    """Class, id and role in one text, and whether the element is hidden."""
    named, hidden = [], False
    for match in ATTRIBUTE.finditer(source):
        name = match[1].lower()
        value = next((v for v in match.groups()[1:] if v is not None), "")
        if name in ("class", "id", "role"):
            named.append(value.lower())
        elif name == "hidden" or name == "aria-hidden" and value == "true" \
                or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return " ".join(named), hidden


def blocks_and_paths(page: str | None) -> tuple[list[Block], dict[str, tuple[str, int]]]:
    """Blocks of text in page order, and path -> (parent path, number of elements)."""
    blocks: list[Block] = []
    paths: dict[str, tuple[str, int]] = {}
    stack: list[tuple[str, str, bool, bool, bool]] = []  # tag, path, outside, article, never
    held: list[str] = []
    linked = 0
    anchors = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            tag, path, outside, article, never = next(
                (x for x in reversed(stack) if x[0] not in INLINE), ("", "", False, False, False))
            parent = path.rpartition("/")[0]
            blocks.append(Block(path, parent, text, outside or bool(stack and stack[-1][2]),
                                article, linked / len(text), never or bool(stack and stack[-1][4])))
        linked = 0

    def close(at: int):
        nonlocal anchors
        for tag, *_ in stack[at:]:
            if tag not in INLINE:
                flush()
            anchors -= tag == "a"
        del stack[at:]

    page = page or ""
    place, end = 0, len(page)
    while place < end:
        match = TOKEN.search(page, place)
        text = page[place:match.start() if match else end]
        if text:
            text = html.unescape(text)
            held.append(text)
            if anchors:
                linked += len(text.strip())
        if not match:
            break
        place = match.end()
        if match[1]:
            tag = match[1].lower()
            if tag in INLINE and tag != "a" and not any(x[0] == tag for x in stack):
                continue
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE:
                flush()
            if at is None:
                continue
            if tag in INLINE and any(x[0] not in INLINE for x in stack[at:]):
                continue  # a stray end tag of a format doesn't end the block around it
            close(at)
        elif match[2]:
            tag = match[2].lower()
            named, hidden = _attributes(match[3]) if NAMING.search(match[3]) else ("", False)
            if tag == "br":
                held.append(" ")
                continue
            if tag not in INLINE:
                flush()
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(f"</{tag}\\s*>", re.I).search(page, place)
                place = stop.end() if stop else end
                continue
            if tag not in INLINE:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
                if at is not None and not any(x[0] in ("td", "th", "button") for x in stack[at:]):
                    close(at)
                ends = CLOSED_BY.get(tag)
                if ends:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in ends:
                            close(i)
                            break
                        if stack[i][0] in SCOPES:
                            break
            if tag in ARTICLE:
                at = next((i for i, x in enumerate(stack) if x[0] in OUTSIDE), None)
                if at is not None:
                    close(at)
            above = stack[-1] if stack else ("", "", False, False, False)
            mine = WORDS.findall(named)
            inside = above[3] and tag == "header"
            never = above[4] or hidden or tag in NEVER or (
                tag not in ("html", "body") and not NEVER_NAMES.isdisjoint(named.split()))
            # Inside an article other words in names are its own: a section may be about search.
            listed = NEVER_NAMES if above[3] else OUTSIDE_WORDS
            outside = above[2] or never or (tag in OUTSIDE and not inside) or (
                tag not in ("html", "body") and not listed.isdisjoint(
                    named.split() if above[3] else mine))
            path = above[1]
            if tag not in INLINE:
                label = f"{tag}.{named}" if named else tag
                parent, path = path, f"{path}/{label}"
                paths[path] = (parent, paths[path][1] + 1 if path in paths else 1)
            anchors += tag == "a"
            stack.append((tag, path, outside, above[3] or tag in ARTICLE, never))
    while stack and stack[-1][0] in INLINE:
        stack.pop()
    flush()
    return blocks, paths


def token_hash(path: str, text: str = "") -> int:
    """A signed 64-bit hash of an element path, or of a text at one."""
    value = xxhash.xxh3_64_intdigest(f"{path}\x00{text}".encode("utf-8", "surrogatepass"))
    return value - 2**64 if value >= 2**63 else value
