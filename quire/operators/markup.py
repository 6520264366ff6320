"""Tree operators on XHTML fragments: protect, canonicalise, restore, split, parse.

A small tolerant reader turns a fragment into nodes; writing escapes text and attributes again.  Everything
here is plain Python on strings, for use inside Arrow-batched functions; columns are at the end.  Trees are as deep
as a page has elements that are never closed, so nothing here calls itself a level down.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\[\[(?:IMG|CODE|MEDIA)_\d+\]\]")
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z_][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WRAPPERS = frozenset(("section", "div", "article", "main", "body"))
BLOCKS = frozenset(("figure", "pre", "div", "section"))
FORBIDDEN = frozenset(("script", "style", "img", "svg", "object", "iframe", "link"))


@dataclass(eq=False)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def add(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
            self.children.append(child)
        elif child:
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
            else:
                self.children.append(child)

    def steps(self) -> Iterator[tuple[Node, int, Node | str | None]]:
        """What is below, in document order: its parent, place and itself; None where a parent's children end."""
        stack = [(self, enumerate(self.children))]
        while stack:
            node, rest = stack[-1]
            for i, c in rest:
                yield node, i, c
                if isinstance(c, Node):
                    stack.append((c, enumerate(c.children)))
                    break
            else:
                stack.pop()
                yield node, len(node.children), None

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        left = [self]
        while left:
            node = left.pop()
            if node is not self:
                yield node
            left += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def above(self, names: Iterable[str]) -> Node | None:
        n = self.parent
        while n is not None and n.name not in names:
            n = n.parent
        return n

    def replace(self, *new: Node | str) -> None:
        siblings = self.parent.children
        at = next(i for i, c in enumerate(siblings) if c is self)
        siblings[at : at + 1] = new
        for n in new:
            if isinstance(n, Node):
                n.parent = self.parent

    def unwrap(self) -> None:
        self.replace(*self.children)

    def text(self, separator: str = "", strip: bool = False) -> str:
        """Texts below, an empty one for an element without children; ``strip`` trims each and leaves out the empty."""
        parts = [c or "" for _, i, c in self.steps() if isinstance(c, str) or c is None and not i]
        if strip:
            parts = [p for p in (p.strip() for p in parts) if p]
        return separator.join(parts)

    def inner(self) -> str:
        out = []
        for n, _, c in self.steps():
            if isinstance(c, Node):
                out.append(f"{c.open_tag()}>" if c.children else f"{c.open_tag()}/>")
            elif c is not None:
                out.append(html.escape(c, quote=False))
            elif n.children and n is not self:
                out.append(f"</{n.name}>")
        return "".join(out)

    def open_tag(self, without: str = "") -> str:
        return f"<{self.name}" + "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items() if k != without)

    def markup(self) -> str:
        return f"{self.open_tag()}>{self.inner()}</{self.name}>" if self.children else f"{self.open_tag()}/>"


def unescaped(text: str) -> str:
    """Text with its character references decoded.  One without its semicolon is none, as in XML, and stays."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def parse(fragment: str) -> Node:
    """A root over the fragment's nodes.  End tags close what they can; open elements end with the fragment."""
    root = Node("root")
    at, now = 0, root
    for m in _MARK.finditer(fragment):
        now.add(unescaped(fragment[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            now.add(m[1])
        elif m[3] is None:
            continue
        elif m[2]:
            n: Node | None = now
            while n is not None and n.name != m[3]:
                n = n.parent
            if n is not None and n.parent is not None:
                now = n.parent
        else:
            raw = m[4].rstrip()
            closed = raw.endswith("/")
            attrs = {k: unescaped(v[1:-1] if v[:1] in "\"'" else v) if v else "" for k, v in _ATTRIBUTE.findall(raw[:-1] if closed else raw)}
            node = Node(m[3], attrs)
            now.add(node)
            if not closed:
                now = node
    now.add(unescaped(fragment[at:]))
    return root


def estimate_tokens(text: str) -> int:
    plain = len(text.encode("ascii", "ignore"))
    return max(1, (plain + 2) // 3 + 2 * (len(text) - plain))


def protect(fragment: str) -> tuple[str, dict[str, str]]:
    """Images, figures, code and media give way to placeholders on lines of their own; and what each stands
    for.  Numbers run through figures, then images, then code and media, so they aren't in reading order."""
    root, held = parse(fragment), {}
    if TOKEN.search(root.text()):
        raise ValueError("the source already holds placeholders")

    def shield(node: Node, kind: str) -> None:
        token = f"[[{kind}_{len(held) + 1}]]"
        held[token] = node.markup()
        node.replace(f"\n{token}\n")

    for figure in root.find("figure"):
        shield(figure, "IMG" if figure.find("img") else "MEDIA")
    for image in root.find("img"):
        shield(image, "IMG")
    atoms = ("pre", "svg", "object", "code")
    for node in root.find(*atoms):
        if node.above(atoms) is None:
            shield(node, "CODE" if node.name in ("pre", "code") else "MEDIA")
    return root.inner(), held


def token_error(fragment: str, expected: list[str]) -> str | None:
    """What is wrong with a fragment's placeholders; None if they are as expected."""
    found = TOKEN.findall(fragment)
    missing, invented = sorted(set(expected).difference(found)), sorted(set(found).difference(expected))
    twice = sorted({t for t in found if found.count(t) > 1})
    moved = not missing and not invented and found != expected
    return f"lacking {missing}, unknown {invented}, repeated {twice}, out of order: {moved}" if missing or invented or twice or moved else None


def _texts(node: Node) -> Iterator[tuple[Node, int]]:
    """Places of text nodes in document order."""
    return ((n, i) for n, i, c in node.steps() if isinstance(c, str))


def canonicalize(fragment: str, expected: list[str]) -> str:
    """Keeps where placeholders stand and gives them the expected names in order: surplus ones go, lacking ones
    come at the end, and those in attributes are cut out."""
    root = parse(fragment)
    for node in root.walk():
        for k, v in list(node.attrs.items()):
            if TOKEN.search(v):
                rest = TOKEN.sub("", v).strip()
                if rest:
                    node.attrs[k] = rest
                else:
                    del node.attrs[k]
    names = iter(expected)
    for node, i in list(_texts(root)):
        node.children[i] = TOKEN.sub(lambda _: next(names, ""), node.children[i])
    rest = list(names)
    if rest:
        root.add("\n" + "\n".join(rest) + "\n")
    return root.inner()


def restore(fragment: str, held: dict[str, str]) -> str:
    """Puts protected objects back, those inside others too; blocks leave the paragraphs around them."""
    root = parse(fragment)
    while True:
        places = [(n, i) for n, i in _texts(root) if TOKEN.search(n.children[i])]
        if not places:
            break
        for node, i in reversed(places):
            text, new, at = node.children[i], [], 0
            for m in TOKEN.finditer(text):
                if m[0] not in held:
                    raise ValueError(f"no object is held for {m[0]}")
                new += [text[at : m.start()], *parse(held[m[0]]).children]
                at = m.end()
            new = [x for x in [*new, text[at:]] if x != ""]
            for x in new:
                if isinstance(x, Node):
                    x.parent = node
            node.children[i : i + 1] = new
    for block in root.find(*BLOCKS):
        around = block.above(("p",))
        if around is not None:
            around.unwrap()
    return root.inner()


def units(fragment: str, limit: int, references: dict[str, str] | None = None) -> list[str]:
    """The smallest pieces a fragment over the limit is cut into; each keeps the wrappers around it."""
    held = references or {}
    size = lambda text: estimate_tokens(TOKEN.sub(lambda m: held.get(m[0], m[0]), text))
    written = lambda n: n.markup() if isinstance(n, Node) else html.escape(n, quote=False)
    out: list[str] = []
    opened: set[int] = set()

    left: list[tuple[Node | str, list[Node]]] = [(child, []) for child in reversed(parse(fragment).children)]
    while left:
        node, shells = left.pop()
        text = written(node)
        if size(text) > limit and isinstance(node, Node) and node.name in WRAPPERS and node.children:
            left += [(child, [*shells, node]) for child in reversed(node.children)]
            continue
        if size(text) > limit and not (isinstance(node, Node) and node.name in WRAPPERS):
            raise ValueError("a block that can't be divided is over the limit of --chunk-tokens")
        for shell in reversed(shells):
            text = shell.open_tag("id" if id(shell) in opened else "") + f">{text}</{shell.name}>"
        opened.update(id(s) for s in shells)
        out.append(text)
    return out


def split_chapter(fragment: str, limit: int = 20_000, references: dict[str, str] | None = None) -> list[str]:
    """Parts of at most about ``limit`` estimated tokens, cut between whole blocks; a heading begins a part."""
    held = references or {}
    size = lambda text: estimate_tokens(TOKEN.sub(lambda m: held.get(m[0], m[0]), text))
    if size(fragment) <= limit:
        return [fragment]
    parts = [""]
    for unit in units(fragment, limit, references):
        if parts[-1] and (size(parts[-1] + unit) > limit or re.match(r"\s*<h[12][\s>]", unit)):
            parts.append("")
        parts[-1] += unit
    return [p for p in parts if p]


def parse_response(response: str, existing: dict[str, str], normalise: Callable[[str], str] | None = None) -> tuple[str, str, dict[str, str]]:
    """Body, title and terms of a response of a summary section and a glossary list; raises what is wrong."""
    upper = response.upper()
    if "<!DOCTYPE" in upper or "<!ENTITY" in upper:
        raise ValueError("answers may define no document type or entities")
    try:
        strict = ElementTree.fromstring(f"<root>{response}</root>")
    except ElementTree.ParseError:
        raise ValueError("the answer is no well-formed XHTML; give the two elements and nothing around them") from None
    if len(strict) != 2 or any(((strict.text or "") + "".join(x.tail or "" for x in strict)).split()):
        raise ValueError("the answer must be one section and one dl")
    root = parse(response)
    if normalise:
        convert(root, normalise)
    of = lambda name, role: next((c for c in root.children if isinstance(c, Node) and c.name == name and c.attrs.get("data-role") == role), None)
    summary, glossary = of("section", "summary"), of("dl", "glossary")
    if summary is None or glossary is None or not summary.attrs.get("data-title"):
        raise ValueError("the summary section, its data-title or the glossary dl is missing")
    violations = policy(summary)
    if violations:
        raise ValueError(violations[0])
    entries = [c for c in glossary.children if isinstance(c, Node) and c.name in ("dt", "dd")]
    if len(entries) % 2 or any(e.name != ("dt", "dd")[i % 2] for i, e in enumerate(entries)):
        raise ValueError("dt and dd must come in pairs")
    terms: dict[str, str] = {}
    for term, rendering in zip((e.text().strip() for e in entries[::2]), (e.text().strip() for e in entries[1::2])):
        if not term or not rendering:
            raise ValueError("a term or its rendering is empty")
        if existing.get(term, rendering) != rendering:
            raise ValueError(f"term conflict: {term!r} is {existing[term]!r} already")
        terms[term] = rendering
    return summary.inner(), summary.attrs["data-title"], terms


def policy(tree: Node) -> list[str]:
    """What generated markup may not hold."""
    out = []
    for n in tree.walk():
        if n.name in FORBIDDEN:
            out.append("generated scripts, styles or pictures; use placeholders")
        if any(k.lower().startswith("on") for k in n.attrs):
            out.append("generated event handlers")
        if n.attrs.get("href", "").lower().startswith(("javascript:", "data:")):
            out.append("generated href of an unsafe scheme")
    return out


def convert(root: Node, normalise: Callable[[str], str]) -> None:
    """Normalises prose and ``data-title``; code keeps its text."""
    for node, i in list(_texts(root)):
        if node.name not in ("code", "pre") and node.above(("code", "pre")) is None:
            node.children[i] = normalise(node.children[i])
    for n in root.walk():
        if n.attrs.get("data-title"):
            n.attrs["data-title"] = normalise(n.attrs["data-title"])


def image_attributes(markup: str) -> list[str]:
    """Every image's attributes, written alike and sorted: a multiset to compare."""
    return sorted(repr(sorted(n.attrs.items())) for n in parse(markup).find("img"))


def ensure_anchors(body: str, original: str, index: int) -> str:
    """Ids once each, ids for headings, and stubs at the start for the original's anchors that have gone."""
    root, seen = parse(body), set()
    for n in root.walk():
        if n.attrs.get("id") in seen and "id" in n.attrs:
            del n.attrs["id"]
        elif "id" in n.attrs:
            seen.add(n.attrs["id"])
    for number, heading in enumerate(root.find("h1", "h2"), 1):
        if not heading.attrs.get("id"):
            name = f"c{index}-heading-{number}"
            while name in seen:
                name += "-a"
            heading.attrs["id"] = name
            seen.add(name)
    for n in parse(original).walk():
        if "id" in n.attrs and n.attrs["id"] not in seen:
            seen.add(n.attrs["id"])
            root.children.insert(0, Node("span", {"id": n.attrs["id"]}, parent=root))
    return root.inner()


# Columns.  The functions are made when asked for, as workers import this module without a session.


def protect_column(fragment: Column) -> Column:
    """``protect`` of a column; what can't be protected is an error, not a failure."""

    @F.pandas_udf("struct<xhtml: string, tokens: array<string>, markup: array<string>, error: string>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for x in values:
            try:
                text, held = protect(x or "")
                rows.append((text, list(held), list(held.values()), None))
            except ValueError as e:
                rows.append((None, [], [], str(e)))
        return pd.DataFrame(rows, columns=["xhtml", "tokens", "markup", "error"])

    return run(fragment)


def restore_column(fragment: Column, tokens: Column, markup: Column) -> Column:
    @F.pandas_udf("string")
    def run(f: pd.Series, t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else restore(x, dict(zip(y, z))) for x, y, z in zip(f, t, m)], dtype=object)

    return run(fragment, tokens, markup)


def canonicalize_column(fragment: Column, expected: Column) -> Column:
    @F.pandas_udf("string")
    def run(f: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else canonicalize(x, list(y)) for x, y in zip(f, e)], dtype=object)

    return run(fragment, expected)


def split_column(fragment: Column, limit: int) -> Column:
    """Parts of a column of fragments; what can't be split gives one part and an error."""

    @F.pandas_udf("struct<parts: array<string>, error: string>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for x in values:
            try:
                rows.append((split_chapter(x or "", limit), None))
            except ValueError as e:
                rows.append(([x], str(e)))
        return pd.DataFrame(rows, columns=["parts", "error"])

    return run(fragment)
