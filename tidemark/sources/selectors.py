"""CSS selectors over a page's elements: what list specs need, and no more.

Supported are types, ids, classes, attributes (there, =, ^=, *=), :not(), :has(), :first-of-type, :last-child, the combinators
" ", ">" and "+", and lists by commas. Others are a ValueError, so that a spec with a slip doesn't read nothing in silence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PART = re.compile(r"""(?P<type>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[\^*]?=)"(?P<value>[^"]*)")?\]|:(?P<pseudo>first-of-type|last-child)|:(?P<inner>not|has)\((?P<arg>(?:[^()]|\([^()]*\))*)\)""")


class Element:
    """A tag with its attributes, parent, and content (elements and texts in order)."""

    __slots__ = ("tag", "attrs", "parent", "content")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.content = tag, attrs, parent, []

    def children(self) -> list[Element]:
        return [x for x in self.content if isinstance(x, Element)]

    def below(self) -> Iterator[Element]:
        """All elements within, in the order of the page."""
        stack = self.children()[::-1]
        while stack:
            at = stack.pop()
            yield at
            stack += at.children()[::-1]

    def text(self, without: frozenset[Element] = frozenset()) -> str:
        """Texts within, joined by blanks, but for scripts, styles and the elements of without."""
        out, stack = [], self.content[::-1]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            elif at.tag not in ("script", "style") and at not in without:
                stack += at.content[::-1]
        return " ".join(out)


class _Builder(HTMLParser):
    """Elements of a page as they're written; an end tag closes the nearest open one of its name, or nothing."""

    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.content.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.content.append(data)


def page(html: str) -> Element:
    """Root over a page's elements; broken pages give what can be read."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


Step = tuple[str, tuple[dict, ...]]  # a combinator with what stands before, and the tests of one element


@lru_cache(maxsize=512)
def compiled(selector: str) -> tuple[tuple[Step, ...], ...]:
    """Alternatives of a selector, each as its steps from left to right."""
    out, steps, tests, joint, at = [], [], [], " ", 0
    text = re.sub(r"\s*([>+,])\s*", r"\1", selector.strip())
    while at < len(text):
        if text[at] in " >+,":
            if not tests:
                raise ValueError(f"not a selector: {selector}")
            steps.append((joint, tuple(tests)))
            tests, joint = [], text[at]
            if joint == ",":
                out.append(tuple(steps))
                steps, joint = [], " "
            at += 1
        elif m := _PART.match(text, at):
            tests.append({k: v for k, v in m.groupdict().items() if v is not None})
            at = m.end()
        else:
            raise ValueError(f"not a selector: {selector} at {text[at:]}")
    if not tests:
        raise ValueError(f"not a selector: {selector}")
    return (*out, (*steps, (joint, tuple(tests))))


def _fits(e: Element, test: dict) -> bool:
    if "type" in test:
        return test["type"] in ("*", e.tag)
    if "id" in test:
        return e.attrs.get("id") == test["id"]
    if "cls" in test:
        return test["cls"] in e.attrs.get("class", "").split()
    if "attr" in test:
        have, value = e.attrs.get(test["attr"]), test.get("value", "")
        return have is not None and {"=": have == value, "^=": value != "" and have.startswith(value), "*=": value != "" and value in have, None: True}[test.get("op")]
    if "inner" in test:
        found = matches(e, test["arg"]) if test["inner"] == "not" else next(select(e, test["arg"]), None) is not None
        return found == (test["inner"] == "has")
    siblings = e.parent.children() if e.parent is not None else [e]
    return siblings[-1] is e if test["pseudo"] == "last-child" else next(x for x in siblings if x.tag == e.tag) is e


def _reached(e: Element, steps: tuple[Step, ...]) -> bool:
    """Whether e fits the last step, and what stands before it the steps before."""
    joint, tests = steps[-1]
    if not all(_fits(e, t) for t in tests):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if joint == "+":
        siblings = e.parent.children() if e.parent is not None else [e]
        at = siblings.index(e)
        return at > 0 and _reached(siblings[at - 1], rest)
    up = e.parent
    while up is not None and up.parent is not None:
        if _reached(up, rest):
            return True
        up = up.parent if joint == " " else None
    return False


def matches(e: Element, selector: str) -> bool:
    return any(_reached(e, steps) for steps in compiled(selector))


def select(e: Element, selector: str) -> Iterator[Element]:
    """Elements within e that fit, in the order of the page; what a selector asks of ancestors may lie outside e."""
    return (x for x in e.below() if matches(x, selector))


def first(e: Element, selector: str) -> Element | None:
    return next(select(e, selector), None)
