"""A small document tree over the standard HTML tokenizer, for what structure extraction asks of it."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: "Element | None"):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    @property
    def id(self) -> str:
        return self.attrs.get("id", "")

    def walk(self) -> Iterator["Element"]:
        """The elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def up(self) -> Iterator["Element"]:
        """This element and those around it, innermost first."""
        node = self
        while node is not None:
            yield node
            node = node.parent

    def first(self, want) -> "Element | None":
        return next((e for e in self.walk() if want(e)), None)

    def text(self, skip=lambda e: None) -> str:
        """All text below; ``skip`` may give a replacement for an element's text."""
        out, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    out.append(child)
                    continue
                instead = skip(child)
                if instead is None:
                    stack.append(iter(child.children))
                    break
                out.append(instead)
            else:
                stack.pop()
        return "".join(out)

    def drop(self, unwanted) -> None:
        """Take the elements below that are unwanted out, with all that is in them."""
        stack = [self]
        while stack:
            node = stack.pop()
            node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c)]
            stack.extend(c for c in node.children if not isinstance(c, str))

    def html(self) -> str:
        """The markup of what is below."""
        out, stack = [], [(None, iter(self.children))]
        while stack:
            node, children = stack[-1]
            for child in children:
                if isinstance(child, str):
                    raw = node is not None and node.name in ("script", "style")
                    out.append(child if raw else escape(child, quote=False))
                    continue
                out.append("<" + child.name + "".join(f' {k}="{escape(v)}"' for k, v in child.attrs.items()) + ">")
                if child.name not in VOID:
                    stack.append((child, iter(child.children)))
                    break
            else:
                stack.pop()
                if node is not None:
                    out.append(f"</{node.name}>")
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.leave("p", ("section", "div", "article", "li", "td", "blockquote"))
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.children.append(element)
        if tag not in VOID:
            self.now = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.name == tag:
            self.now = self.now.parent

    def leave(self, tag, barred=()):
        for e in self.now.up():
            if e.name in barred:
                return
            if e.name == tag and e.parent is not None:
                self.now = e.parent
                return

    def handle_endtag(self, tag):
        self.leave(tag)

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
