"""A small reader of wikitext: templates, links, and the fields of an infobox.  Standard library only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..schemas import FIELDS, RELATIVES, SPELLINGS


@dataclass
class Link:
    title: str
    text: str | None = None

    @property
    def shown(self) -> str:
        return self.text if self.text else self.title


@dataclass
class Template:
    name: str
    #: (key or None, nodes) in order.
    params: list[tuple[str | None, list]] = field(default_factory=list)

    def values(self) -> list[str]:
        """What the parameters show: a named one its name, another its value; ``cat`` is left out."""
        shown = [k.strip() if k is not None else plain(v) for k, v in self.params]
        return [x for x in shown if x != "cat"]


_MARKS = re.compile(r"\{\{|\}\}|\[\[|\||=")


@dataclass
class _Open:
    """A template whose end has not been met."""

    part: int
    #: (start, end, node) of what was closed within it, and how many of these lie before the part.
    inner: list[tuple[int, int, Link | Template]] = field(default_factory=list)
    before: int = 0
    name: str | None = None
    key: str | None = None
    params: list[tuple[str | None, list]] = field(default_factory=list)

    def take(self, text: str, end: int, after: int) -> list:
        nodes = _between(text, self.part, end, self.inner[self.before :])
        self.part, self.before = after, len(self.inner)
        return nodes

    def finish(self, text: str, end: int, after: int) -> None:
        nodes = self.take(text, end, after)
        if self.name is None:
            self.name = plain(nodes).strip()
        else:
            self.params.append((self.key, nodes))
        self.key = None


def _between(text: str, start: int, end: int, inner: list) -> list:
    nodes: list = []
    for a, b, node in inner:
        nodes += [text[start:a]] if a > start else []
        nodes.append(node)
        start = b
    return nodes + ([text[start:end]] if end > start else [])


def parse(text: str) -> list:
    """Nodes: str, Link or Template.  One pass; openings that nothing closes are text."""
    top: list[tuple[int, int, Link | Template]] = []
    stack: list[_Open] = []
    starts: list[int] = []
    at, links = 0, True
    while mark := _MARKS.search(text, at):
        at, what = mark.end(), mark.group()
        inner = stack[-1].inner if stack else top
        if what == "{{":
            stack.append(_Open(at))
            starts.append(mark.start())
        elif what == "[[":
            end = text.find("]]", at) if links else -1
            links = end >= 0
            if links:
                title, bar, shown = text[at:end].partition("|")
                at = end + 2
                inner.append((mark.start(), at, Link(title, shown if bar else None)))
        elif stack and what == "=":
            own = stack[-1]
            if own.name is not None and own.key is None:
                own.key = plain(own.take(text, mark.start(), at)).strip()
        elif stack:
            own = stack[-1]
            own.finish(text, mark.start(), at)
            if what == "}}":
                stack.pop()
                (stack[-1].inner if stack else top).append((starts.pop(), at, Template(own.name or "", own.params)))
    return _between(text, 0, len(text), top + [x for own in stack for x in own.inner])


def walk(nodes: list):
    todo = [iter(nodes)]
    while todo:
        n = next(todo[-1], None)
        if n is None:
            todo.pop()
            continue
        yield n
        if isinstance(n, Template):
            todo.append(x for _, value in n.params for x in value)


_MARKUP = re.compile(r"<!--.*?-->|<ref\b[^>]*/>|<ref\b.*?</ref\s*>|<[^>]*>|'{2,}", flags=re.S)


def plain(nodes: list) -> str:
    """Text without markup; templates, comments, references, tags and quote marks vanish."""
    text = "".join([n if isinstance(n, str) else n.shown if isinstance(n, Link) else "" for n in nodes])
    return _MARKUP.sub("", text) if "<" in text or "''" in text else text


def simple(nodes: list) -> list:
    """Without reference templates, links cut down to what they show."""
    kept = [n for n in nodes if not (isinstance(n, Template) and ("ref" in n.name or "wob" in n.name))]
    return [Link(n.shown) if isinstance(n, Link) else n for n in kept]


def names(nodes: list) -> list[str]:
    out = []
    for n in simple(nodes):
        if isinstance(n, Template) and n.params:
            shown = [k if k is not None else plain(v) for k, v in n.params]
            if len(shown) == 1:
                n = shown[0]
            elif "highprince" in shown[0].lower():
                n = f"{shown[0]} of {shown[1]}"
            elif "army" in shown[0].lower():
                n = f"{shown[1]} {shown[0]}"
        out.append(n)
    return [x for x in (x.strip() for x in plain(out).split(",")) if x]


def abilities(nodes: list) -> list[str]:
    out: list[str] = []
    for n in walk(simple(nodes)):
        if isinstance(n, Link):
            out.append(n.title.lower())
        elif isinstance(n, Template) and "tag" in n.name:
            p = [x.lower() for x in n.values()]
            if len(p) == 1:
                out.append(p[0])
            elif p and p[0] in ("shard", "vessel", "splinter"):
                out += [p[0], f"{p[0]} of {p[1]}"]
            elif p and p[0] == "squire":
                out.append(f"squire ({p[1].split()[-1]})")
    return out


def _filled(nodes: list, title, special=None) -> str:
    out = []
    for n in nodes:
        if isinstance(n, Link):
            n = title(n.title.strip())
        elif isinstance(n, Template):
            p = n.values()
            n = p[0] if len(p) == 1 else special(p) if special and special(p) else ", ".join(p)
        out.append(n)
    return plain(out).strip()


def residence(nodes: list, prefixes: dict[str, str]) -> str:
    nodes = [re.sub("<br>", ", ", n) if isinstance(n, str) else n for n in simple(nodes)]
    out = re.sub(r"\s?\([\w\s]+\)", "", _filled(nodes, str.title))
    return next((v for k, v in prefixes.items() if out.startswith(k)), out)


def ethnicity(nodes: list, joined: dict[str, str]) -> str:
    nodes = [n.replace(" and ", ", ") if isinstance(n, str) else n for n in simple(nodes)]
    out = _filled(nodes, str, lambda p: "Noble" if "Noble" in p or "noble" in p else None).title()
    return joined.get(out, out)


def family(nodes: list) -> str | None:
    nodes = simple(nodes)
    links = [n for n in nodes if isinstance(n, Link) and "category" not in n.title.lower()]
    if not links:
        return None
    return links[0].title.strip() if len(links) == 1 else _filled(nodes, str)


def field_name(key: str) -> str | None:
    key = re.sub(r"[^a-z\-]", "", key.lower()).removesuffix("-raw")
    key = SPELLINGS.get(key, key)
    return key if key in FIELDS else None


@dataclass
class Dims:
    """Value tables of a corpus; each maps lower-case raw values, or shown book titles, to normal ones."""

    demonyms: dict[str, str] = field(default_factory=dict)
    species: dict[str, str] = field(default_factory=dict)
    books: dict[str, str | None] = field(default_factory=dict)
    titles: tuple[str, ...] = ()
    #: Raw values with one of these words name a subspecies of the general kind.
    kinds: dict[str, str] = field(default_factory=dict)
    residences: dict[str, str] = field(default_factory=dict)
    ethnicities: dict[str, str] = field(default_factory=dict)
    #: Patterns that the ids of a key's chapters start with; null for a key without chapters.
    chapters: dict[str, str | None] = field(default_factory=dict)
    #: The entity that a moniker of several means unless an answer says otherwise.
    defaults: dict[str, int] = field(default_factory=dict)


def record(content: str, dims: Dims, box: str = "character") -> dict:
    """What the infobox of a page says; ``has_template``, ``has_box`` and ``deleted`` tell why there is nothing."""
    found = [n for n in walk(parse(content)) if isinstance(n, Template)]
    out: dict = {"has_template": bool(found), "deleted": any("deleted" in t.name.lower() for t in found)}
    info = next((t for t in found if t.name.strip().lower() == box), None)
    out["has_box"] = info is not None
    if info is None or out["deleted"]:
        return out
    for k, nodes in info.params:
        key = field_name(k or "")
        if key is None:
            continue
        text = plain(nodes)
        if key == "books":
            value = [b for b in (dims.books.get(n.shown.strip()) for n in nodes if isinstance(n, Link)) if b]
        elif key == "nationality":
            value = dims.demonyms.get(text.lower().strip())
        elif key == "species":
            value, low = dims.species.get(text.lower().strip()), text.lower()
            general = next((g for w, g in dims.kinds.items() if w in low), None)
            if value is not None and general:
                out["subspecies"], value = value, general
        elif key == "residence":
            value = residence(nodes, dims.residences)
        elif key == "ethnicity":
            value = ethnicity(nodes, dims.ethnicities)
        elif key == "abilities":
            value = abilities(nodes)
        elif key == "profession":
            value = text.lower().strip()
        elif key == "groups":
            value = "".join(n if isinstance(n, str) else n.shown if isinstance(n, Link) else "" for n in nodes).strip()
        elif key == "family":
            value = family(nodes)
        elif key in RELATIVES:
            value = [n.title.replace("_", " ") for n in walk(nodes) if isinstance(n, Link)]
        elif key in ("titles", "aliases", "name"):
            value = names(nodes)
        elif key == "unnamed":
            value = text.lower().startswith("y")
        elif key == "died":
            value = True
        else:
            value = text.strip()
        out[key] = value
    if out.get("name"):
        out["aliases"] = out.get("aliases", []) + out.pop("name")
    return out
