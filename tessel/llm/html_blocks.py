"""HTML to blocks: a page's leaf sequence, each block with its path of tags and its text.

A block is the text between two bounds of block-level elements (or line breaks); inline markup does not cut it. A small
tokenizer takes markup apart; it repairs what pages get wrong most: unclosed inline elements, paragraphs and list items,
closing tags without an opening one, pages that break off. Scripts, styles, templates, comments, titles, text areas and
selection lists give no blocks; a template or list that is never closed is read like any other element, a script, style,
title or text area goes on to the page's end. What stands in other elements (formulas, drawings, ``noscript``, objects,
frames, media) is text like any other, for the labeller to judge.

Time is linear in the page's length and depth is bounded: of a path deeper than 2 * ``DEPTH`` elements the outermost and the
innermost ones are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|(?P<text>[^<]+|<)",
    re.S,
)
#: Elements whose content is no text, and whether one that is never closed reaches to the page's end.
SILENT = {"script": True, "style": True, "textarea": True, "title": True, "template": False, "select": False}
CLOSERS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in SILENT}
DEPTH = 32
NAME = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr"
    # Formulas, drawings and what stands in for media flow with the text around them.
    " annotation maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle"
    " msub msubsup msup mtable mtd mtext mtr munder munderover semantics"
    " audio canvas circle defs desc ellipse g iframe line noscript object path polygon polyline rect svg text tspan use video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a new element closes if it is open, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block-level elements that leave a paragraph open are none: all of them close it.
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main nav ol section table tbody td th thead ul".split())


class Block(NamedTuple):
    path: tuple[str, ...]  # tags and names, outermost first, such as ("body", "div", ".ad")
    text: str
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf sequence in page order; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    open_: Counter[str] = Counter()  # elements on the stack by name: what is not open needs no search
    unclosed: set[str] = set()  # names that no closing tag follows any more
    linked = links = 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                shown = stack if len(stack) <= 2 * DEPTH else [*stack[:DEPTH], *stack[-DEPTH:]]
                out.append(Block(tuple(x for tag, names in shown if tag not in INLINE for x in (tag, *names)), text, linked))
            held.clear()
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal links
        links -= sum(tag == "a" for tag, _ in stack[at:])
        for tag, _ in stack[at:]:
            open_[tag] -= 1
        del stack[at:]

    place, last = 0, page.rfind(">")
    while m := TOKEN.match(page, place):
        place = m.end()
        text = m["text"]
        if place > last and text == "<":  # no tag can end any more
            text, place = page[place - 1 :], len(page)
        if text is not None:
            held.append(text)
            if links:
                linked += len(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in SILENT and not m["end"] and tag not in unclosed:
            stop = CLOSERS[tag].search(page, place)
            if stop:
                place = stop.end()
                continue
            if SILENT[tag]:
                break
            unclosed.add(tag)
        inline = tag in INLINE
        if not inline:
            close()
        if m["end"]:
            if not open_[tag]:
                continue
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    pop_to(at)
                    break
                if inline and stack[at][0] not in INLINE:
                    break
            continue
        if not inline:
            wanted = CLOSES.get(tag, set()) | {"p"}
            for at in range(len(stack) - 1, -1, -1) if any(open_[x] for x in wanted) else ():
                if stack[at][0] in wanted:
                    pop_to(at)
                    break
                if stack[at][0] in CONTAINERS and stack[at][0] not in ("td", "th"):
                    break
        if tag in VOID or (m["rest"] or "").endswith("/") and tag in ("br", "hr", "img"):
            continue
        names = ()
        if m["rest"]:
            found = [(k.lower(), next(v for v in values if v is not None)) for k, *values in ((a, b or c or d or "") for a, b, c, d in NAME.findall(m["rest"]))]
            names = tuple(f".{part}" for _, value in found for part in re.split(r"[^a-z0-9]+", value.lower()) if part)
        stack.append((tag, names))
        open_[tag] += 1
        if tag == "a":
            links += 1
    close()
    return out
