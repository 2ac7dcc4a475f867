"""A forgiving reader of HTML: nodes of a page in document order."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas".split())  # never text of the page
TEXT_ONLY = frozenset("title textarea".split())
BLOCK = frozenset("html head body title article main nav header footer aside section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form "
                  "fieldset legend figure figcaption blockquote pre address details summary hr button select option textarea dialog menu center".split())
CLOSES_P = BLOCK - frozenset("button select option textarea".split())
# An opening tag ends these open ones, unless one of the others lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARK = re.compile(r"""\b(class|id|role|data-main|data-not)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""\shidden(?=[\s>=/]|$)|display\s*:\s*none""", re.IGNORECASE)
ENDINGS = {name: re.compile(f"</{name}", re.IGNORECASE) for name in (*RAW, *TEXT_ONLY)}


class Page:
    """Nodes of one page: ``parent``, ``tag`` (empty for text), ``marks`` (class, id, role), ``text`` and ``block`` of text nodes."""

    def __init__(self, source: str):
        self.parent, self.tag, self.marks, self.text, self.block = [-1], ["#page"], [""], [""], [0]
        self.spaces: list[tuple[int, int, str]] = []  # white space between nodes: (next node, block, text)
        self.blocks, self.open = 0, [0]
        self._read(source)

    def _add(self, tag: str, marks: str = "", text: str = "") -> int:
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.marks.append(marks)
        self.text.append(text)
        self.block.append(self.blocks)
        return len(self.tag) - 1

    def _characters(self, piece: str) -> None:
        if not piece:
            return
        if piece.isspace():
            self.spaces.append((len(self.tag), self.blocks, piece))
        else:
            self._add("", text=html.unescape(piece) if "&" in piece else piece)

    def _pop(self, wanted: set[str] | frozenset[str], barrier: set[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[at]]
            if tag in wanted:
                del self.open[at:]
                return
            if tag in barrier:
                return

    def _start(self, name: str, rest: str) -> None:
        if name in CLOSES_P:
            self._pop({"p"}, {"table", "td", "th", "button", "#page"})
        if name in ENDS:
            self._pop(*ENDS[name])
        if name in BLOCK:
            self.blocks += 1
        if name == "br":
            self.spaces.append((len(self.tag), self.blocks, " "))
        if name in VOID:
            return
        marks = ""
        if rest:
            marks = " ".join((f"{k.lower()} " if k.lower().startswith("data") else "") + (a or b or c) for k, a, b, c in MARK.findall(rest))
            if "hidden" in rest or "display" in rest:
                marks += " hidden" if HIDDEN.search(rest) else ""
        node = self._add(name, marks)
        if not rest.endswith("/") or name not in ("svg", "math"):
            self.open.append(node)

    def _end(self, name: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[at]] == name:
                del self.open[at:]
                break
            if name not in BLOCK and self.tag[self.open[at]] in BLOCK:
                break  # an inline end tag doesn't close blocks
        if name in BLOCK:
            self.blocks += 1

    def _read(self, s: str) -> None:
        at, size, last = 0, len(s), s.rfind(">")
        while at < size:
            start = s.find("<", at)
            if start < 0 or start > last:
                self._characters(s[at:])
                return
            follow = s[start + 1:start + 2]
            if not (follow.isascii() and follow.isalpha()) and follow not in ("/", "!", "?"):
                end = s.find("<", start + 1)  # a bare sign, part of the text
                end = size if end < 0 else end
                self._characters(s[at:end])
                at = end
                continue
            if start > at:
                self._characters(s[at:start])
            if s.startswith("<!--", start):
                end = s.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            end = s.find(">", start)
            if follow in ("!", "?"):
                at = end + 1
                continue
            tag = s[start + 1:end]
            for quote in ('"', "'"):
                if tag.count(quote) % 2 and f"={quote}" in tag.replace(" ", ""):  # the sign stands inside a value
                    close = s.find(quote, end)
                    further = s.find(">", close) if close >= 0 else -1
                    if further >= 0:
                        end = further
                        tag = s[start + 1:end]
                    break
            at = end + 1
            closing = follow == "/"
            m = NAME.match(tag, 1 if closing else 0)
            if not m:
                continue
            name = m[0].lower()
            if closing:
                self._end(name)
                continue
            if name in RAW or name in TEXT_ONLY:
                done = ENDINGS[name].search(s, at)
                stop = done.start() if done else size
                if name in TEXT_ONLY:
                    self._start(name, tag[m.end():])
                    self._characters(s[at:stop])
                    self._end(name)
                elif not tag.endswith("/"):
                    at = stop
                    continue
                at = stop
                continue
            self._start(name, tag[m.end():])

    def blocks_of(self, keep: list[bool]) -> str:
        """The kept blocks in order, white space as single spaces."""
        parts: dict[int, list[tuple[int, str]]] = {}
        for node, tag in enumerate(self.tag):
            if not tag and keep[node]:
                parts.setdefault(self.block[node], []).append((2 * node + 1, self.text[node]))
        for node, block, text in self.spaces:
            if block in parts:
                parts[block].append((2 * node, text))
        out = (" ".join("".join(t for _, t in sorted(p, key=lambda x: x[0])).split()) for _, p in sorted(parts.items()))
        return "\n".join(line for line in out if line)
