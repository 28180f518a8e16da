"""Reading markup leniently: formulas in a text, and their presentation or content part.

The reader never fails: unknown entities stay as they are, stray text and missing end tags are tolerated,
prefixes and letter case of tags are dropped. What the elements mean is the business of the two parsers.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Fixed value: the class of elements whose content is LaTeX between dollar signs.
LATEX_CLASS = "math-container"
_DOLLARS = re.compile(r"(?<!\\)\$+")


class Element:
    """An element with its attributes, its text up to the first child, and its children."""

    __slots__ = ("tag", "attrib", "text", "children")

    def __init__(self, tag: str, attrib: dict[str, str] | None = None) -> None:
        self.tag, self.attrib, self.text, self.children = tag, attrib or {}, "", []

    def find(self, tag: str, **attrib: str) -> Element | None:
        """First descendant in document order with that tag and those attributes."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if x.tag == tag and all(x.attrib.get(k) == v for k, v in attrib.items()):
                return x
            todo.extend(reversed(x.children))
        return None

    def without(self, drop: Element | None) -> Element:
        """The same element without one descendant."""
        out = Element(self.tag, self.attrib)
        out.text = self.text
        out.children = [c.without(drop) for c in self.children if c is not drop]
        return out


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]

    @staticmethod
    def _name(tag: str) -> str:
        return tag.rpartition(":")[2]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(self._name(tag), {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Element(self._name(tag), {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        name = self._name(tag)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == name:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1].children:
            self.open[-1].text += data


def read(text: str) -> Element:
    """Element tree of a piece of markup, below an element without a name."""
    r = _Reader()
    r.feed(text)
    r.close()
    return r.root


def formulas(text: str | None) -> list[str]:
    """Formulas of a document in order, of any length; LaTeX ones as ``$...$``.

    A formula in markup goes from a ``math`` tag, whatever its prefix, to the next end tag of that name. A LaTeX formula is
    the first one between unescaped dollar signs in an element of the class for it, up to that element's first end tag.
    """
    out: list[str] = []
    text = text or ""
    at = text.find("<")
    while at >= 0 and (end := text.find(">", at)) >= 0:
        name, _, attributes = text[at + 1 : end].partition(" ")
        name = name.split(maxsplit=1)[0] if name.strip() else ""
        after = None
        if name.rpartition(":")[2] == "math" and not text[at + 1 : end].endswith("/"):
            after = _end_of(text, end + 1, "math")
            if after is not None:
                out.append(text[at:after])
        elif f'class="{LATEX_CLASS}"' in attributes and not name.startswith("/"):
            stop = text.find("</", end)
            inner = _DOLLARS.split(text[end + 1 : stop]) if stop >= 0 else []
            if len(inner) > 2 and inner[1]:
                out.append(f"${inner[1]}$")
            after = stop if stop >= 0 else None
        at = text.find("<", end if after is None else after)
    return out


def _end_of(text: str, at: int, tag: str) -> int | None:
    """Place after the next end tag of a name, whatever its prefix; null if there is none."""
    while (at := text.find("</", at)) >= 0 and (end := text.find(">", at)) >= 0:
        if text[at + 2 : end].rpartition(":")[2].strip() == tag:
            return end + 1
        at = end
    return None


def isolate(formula: str, *, content: bool) -> Element:
    """The ``math`` element with only its content or only its presentation part."""
    math = read(formula).find("math")
    if math is None:
        raise ValueError("no math element")
    math = math.without(math.find("annotation", encoding="application/x-tex"))
    wanted, other = ("MathML-Content", "MathML-Presentation") if content else ("MathML-Presentation", "MathML-Content")
    part = math.find("annotation-xml", encoding=wanted)
    if part is not None:
        whole = Element("math", math.attrib)
        whole.children = part.children
        return whole
    return math.without(math.find("annotation-xml", encoding=other))
