"""Leaf blocks of an HTML page: runs of text between block-level tags, with the elements around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# a tag, a comment or a declaration; a quoted attribute may hold ">", an unclosed one ends with the page
MARKUP = re.compile(r"""<!--(?:.*?-->|.*$)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>|$)?""",
                    re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Elements whose text is never part of a page's prose
SILENT = {"script", "style", "template", "noscript", "head", "title", "svg", "iframe", "object", "canvas", "math"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}  # up to their end tag there is no markup
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
# an opening tag ends these open elements, up to one of the barriers
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"}}
BARRIERS = {"ul", "ol", "dl", "table", "select", "body", "html", "menu"}
P_STAYS = INLINE | VOID - {"hr"} | {"button", "label", "select", "textarea", "option", "optgroup", "object", "video", "audio"}


@dataclass
class Element:
    tag: str
    names: str = ""  # class, id, role and the like, in lower case
    hidden: bool = False
    main: bool = False  # label of a training page
    other: bool = False  # the same, for what is inserted into an article


@dataclass
class Block:
    text: str
    path: list[Element] = field(default_factory=list)
    linked: int = 0  # characters inside links


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(source)}


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text in page order; white space inside a block is one blank, character references are decoded."""
    open_, blocks = [], []
    parts: list[str] = []
    path: list[Element] = []
    linked = silent = at = 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, path, linked))
        parts, linked = [], 0

    def add(text):
        nonlocal path, linked
        if silent or not text:
            return
        text = html.unescape(text)
        if not any(parts) or not path:
            path = list(open_)
        parts.append(text)
        if any(e.tag == "a" for e in open_):
            linked += len(text.strip())

    def close(n):
        nonlocal silent
        for e in open_[n:]:
            silent -= e.tag in SILENT
        del open_[n:]

    while m := MARKUP.search(page, at):  # from the end of raw text on: what looks like markup inside it is none
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[4] is None:  # a quote that does not close
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        if tag not in INLINE and tag != "br":
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i].tag == tag:
                    close(i)
                    break
            continue
        if tag not in P_STAYS:
            _end(open_, {"p"}, BARRIERS | {"td", "th", "button", "object"}, close)
        if tag in ENDS:
            _end(open_, ENDS[tag], BARRIERS, close)
        if tag in VOID or m[3].endswith("/") and tag in SILENT:
            continue
        given = attributes(m[3]) if m[3].strip() else {}
        style = given.get("style", "").replace(" ", "").lower()
        names = " ".join(given.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop")).strip()
        open_.append(Element(tag, names, "hidden" in given or "display:none" in style or given.get("aria-hidden") == "true",
                             "data-main" in given, "data-other" in given))
        silent += tag in SILENT
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            add(page[at:stop])
            at = stop
    rest = page[at:]
    add(rest if not re.match(r"</?[a-zA-Z]", rest) else "")
    flush()
    return blocks


def _end(open_, tags, barriers, close):
    for i in range(len(open_) - 1, -1, -1):
        if open_[i].tag in tags:
            close(i)
            return
        if open_[i].tag in barriers:
            return
