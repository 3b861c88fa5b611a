"""Web pages as trees of block elements: a forgiving reader, blocks of text, and features of the elements."""

import re
from html import unescape

from emberlog.llm.frames import ship_with_tasks

ship_with_tasks(__name__)

# Fixed values of HTML: elements without end tag, elements inside a line, elements whose content is no markup, elements that
# are never shown, and elements that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style textarea title template iframe noembed noframes noscript select datalist object svg math".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Start tags of these do not end an open paragraph.
IN_PARAGRAPH = INLINE | VOID | HIDDEN - {"select"} | {"button", "canvas", "audio", "video", "option", "body", "html"} - {"hr"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][^\s=>"'/]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
NAME_PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
MEASURES = ("own", "whole", "links", "stops", "kids", "first", "seen", "inputs", "sign")


class Page:
    """Elements in page order (parents first) and the text runs (element, run, starts a block)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.names, self.label = [-1], ["page"], [()], [0]
        self.links, self.inputs = [0], [0]
        self.runs: list[tuple[int, str, bool]] = []
        self._open = [("page", 0, False)]
        self._fresh = True
        end = 0
        while match := TOKEN.search(html, end):
            self._text(html[end : match.start()])
            end = match.end()
            if match[1]:
                self._close(match[1].lower())
            elif tag := match[2] or match[4]:
                tag = tag.lower()
                self._start(tag, match[3] if match[2] else match[5])
                if tag in RAW:
                    stop = re.compile(f"</{tag}[\\s/>]", re.I).search(html, end)
                    end = stop.start() if stop else len(html)
        self._text(html[end:])

    def _text(self, raw: str) -> None:
        _, node, hidden = self._open[-1]
        if raw and not hidden:
            text = unescape(raw) if "&" in raw else raw
            self.runs.append((node, text, self._fresh))
            self._fresh = False
            if any(tag == "a" for tag, _, _ in self._open):
                self.links[node] += len(text.strip())

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in IN_PARAGRAPH:
            self._pop({"p"}, {"button", "td", "th", "table", "div", "li", "section", "article", "blockquote"})
        if tag in CLOSES:
            self._pop(*CLOSES[tag])
        inline, hidden = tag in INLINE, self._open[-1][2] or tag in HIDDEN
        node = self._open[-1][1]
        self._fresh |= not inline
        if tag == "br":
            self.runs.append((node, " ", self._fresh))
        if tag in ("input", "button", "select", "textarea"):
            self.inputs[node] += 1
        named = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        words = " ".join(named.get(k, "") for k in ("class", "id", "role"))
        if not inline or words.strip():
            parts = NAME_PART.findall(CAMEL.sub(r"\1 \2", words).lower())
            self.parent.append(node)
            node = len(self.tag)
            self.tag.append(tag)
            self.names.append(tuple(dict.fromkeys(parts)))
            self.label.append(int(named.get("data-y", 0)) if named.get("data-y", "0").isdigit() else 0)
            self.links.append(0)
            self.inputs.append(0)
        if tag not in VOID:
            self._open.append((tag, node, hidden))

    def _close(self, tag: str) -> None:
        self._fresh |= tag not in INLINE
        if tag != "page":
            self._pop({tag}, set())

    def _pop(self, tags: set[str], fence: set[str]) -> None:
        """Close the innermost open element of ``tags`` and all in it, unless one of ``fence`` is in between."""
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in tags:
                del self._open[i:]
                return
            if self._open[i][0] in fence:
                return

    def blocks(self, keep: list[bool]) -> list[str]:
        """The text blocks of the kept elements in page order."""
        out, held = [], []
        for node, text, fresh in self.runs:
            if fresh:
                out.append(" ".join("".join(held).split()))
                held = []
            if keep[node]:
                held.append(text)
        out.append(" ".join("".join(held).split()))
        return [block for block in out if block]

    def measures(self) -> list[list[float]]:
        """Per measure of MEASURES one number for each element."""
        n = len(self.tag)
        own, marks, sign, first, seen = [0] * n, [0] * n, [0] * n, [-1] * n, 0
        for node, text, _ in self.runs:
            size = len(text.strip())
            if first[node] < 0:
                first[node] = seen
            seen += size
            own[node] += size
            marks[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
            if "\u00a9" in text or "opyright" in text[:200]:
                sign[node] = 1
        whole, links, stops, inputs, kids = own[:], self.links[:], marks, self.inputs[:], [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            whole[p] += whole[i]
            links[p] += links[i]
            stops[p] += stops[i]
            inputs[p] += inputs[i]
            kids[p] += 1
            if first[i] < 0:
                first[i] = seen
            if first[p] < 0 or first[i] < first[p]:
                first[p] = first[i]
        return [own, whole, links, stops, kids, first, [seen] * n, inputs, sign]
