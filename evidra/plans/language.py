"""The query language: lexer, parser, syntax tree, rendering.

From tight to loose: NOT, NEAR/n, AND, OR.  A field prefix scopes the next
primary only; there is no implicit AND.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

FIELDS = ("all", "title", "abstract", "title_abstract", "keywords", "author", "journal", "affiliation")
ALIASES = {f: f for f in FIELDS} | {
    "ti": "title", "abs": "abstract", "title-abstract": "title_abstract", "tiab": "title_abstract", "keyword": "keywords", "kw": "keywords",
    "au": "author", "source": "journal", "aff": "affiliation",
}
VOCABULARIES = {"mesh": "MeSH", "mesh_terms": "MeSH"}
DEFAULT_FIELDS = ("title", "abstract", "keywords")


class QueryError(ValueError):
    """The expression is not in the language; says where."""


@dataclass(frozen=True)
class Term:
    value: str

    @property
    def wild(self) -> bool:
        return "*" in self.value or "?" in self.value


@dataclass(frozen=True)
class Phrase:
    value: str


@dataclass(frozen=True)
class Vocabulary:
    vocabulary: str
    term: str
    explode: bool = True


@dataclass(frozen=True)
class Field:
    field: str
    child: "Node"


@dataclass(frozen=True)
class Not:
    child: "Node"


@dataclass(frozen=True)
class Near:
    left: "Node"
    right: "Node"
    distance: int

    def __post_init__(self) -> None:
        if self.distance < 0:
            raise ValueError("a distance is 0 or more")


@dataclass(frozen=True)
class Boolean:
    operator: str
    children: tuple["Node", ...]

    def __post_init__(self) -> None:
        if self.operator not in ("AND", "OR") or len(self.children) < 2:
            raise ValueError("AND or OR of two children at least")


Node = Term | Phrase | Vocabulary | Field | Not | Near | Boolean

_LEXER = re.compile(
    r"""(?P<space>\s+)|(?P<open>\()|(?P<close>\))|(?P<colon>:)|(?P<near>NEAR\s*/\s*\d+)|(?P<and>AND\b)|(?P<or>OR\b)|(?P<not>NOT\b)|(?P<phrase>"(?:[^"\\]|\\.)*")|(?P<word>[^\s():]+)""",
    re.I,
)


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEXER.match(text, at)
        if m is None:
            raise QueryError(f"unexpected character at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.end = tokenize(text), 0, len(text)

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].kind if self.at + ahead < len(self.tokens) else ""

    def take(self) -> Token:
        if self.at >= len(self.tokens):
            raise QueryError(f"unexpected end at {self.end}")
        self.at += 1
        return self.tokens[self.at - 1]

    def level(self, kind: str, below) -> Node:
        parts = [below()]
        while self.peek() == kind:
            self.take()
            parts.append(below())
        return Boolean(kind.upper(), tuple(parts)) if len(parts) > 1 else parts[0]

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            t = self.tokens[self.at]
            raise QueryError(f"unexpected {t.value!r} at {t.at}; join terms by AND, OR or NEAR/n")
        return node

    def either(self) -> Node:
        return self.level("or", self.both)

    def both(self) -> Node:
        return self.level("and", self.near)

    def near(self) -> Node:
        node = self.negated()
        while self.peek() == "near":
            n = int(self.take().value.rsplit("/", 1)[1])
            node = Near(node, self.negated(), n)
        return node

    def negated(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Not(self.negated())
        return self.primary()

    def primary(self) -> Node:
        t = self.take()
        if t.kind == "open":
            node = self.either()
            if self.peek() != "close":
                raise QueryError(f"the parenthesis at {t.at} is not closed")
            self.take()
            return node
        if t.kind == "phrase":
            return Phrase(re.sub(r"\\(.)", r"\1", t.value[1:-1]))
        if t.kind != "word":
            raise QueryError(f"unexpected {t.value!r} at {t.at}")
        if self.peek() != "colon":
            return Term(t.value)
        name = t.value.lower()
        self.take()
        if name in VOCABULARIES:
            child = self.primary()
            if not isinstance(child, Term | Phrase):
                raise QueryError(f"{t.value}: takes a term or a phrase, at {t.at}")
            return Vocabulary(VOCABULARIES[name], child.value)
        if name not in ALIASES:
            raise QueryError(f"unknown field {t.value!r} at {t.at}")
        return Field(ALIASES[name], self.primary())


def parse(text: str) -> Node:
    if not text or not text.strip():
        raise QueryError("the query is empty")
    return _Parser(text).whole()


def _quoted(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def render(node: Node) -> str:
    """Canonical text; parses to the same tree, with parentheses wherever they are needed for that."""

    def inner(child: Node, *loose: type) -> str:
        text = render(child)
        return f"({text})" if isinstance(child, loose) else text

    match node:
        case Term(value):
            return value
        case Phrase(value):
            return _quoted(value)
        case Vocabulary(vocabulary, term):
            return f"{vocabulary.lower()}:{_quoted(term)}"
        case Field(name, child):
            return f"{name}:{inner(child, Boolean, Not, Near)}"
        case Not(child):
            return f"NOT {inner(child, Boolean, Near)}"
        case Near(left, right, n):
            return f"{inner(left, Boolean)} NEAR/{n} {inner(right, Boolean, Near)}"
        case Boolean(op, children):
            return f" {op} ".join(inner(c, Boolean) for c in children)
    raise TypeError(type(node))


def walk(node: Node) -> Iterator[Node]:
    yield node
    for name in ("child", "left", "right"):
        if hasattr(node, name):
            yield from walk(getattr(node, name))
    for child in getattr(node, "children", ()):
        yield from walk(child)


def literal(node: Node) -> str | None:
    return node.value if isinstance(node, Term | Phrase) else None


def has_field(node: Node) -> bool:
    return any(isinstance(n, Field) for n in walk(node))


@dataclass(frozen=True)
class Search:
    """An expression with year bounds and default fields; errors show at once."""

    expression: str
    year_from: int | None = None
    year_to: int | None = None
    fields: tuple[str, ...] = DEFAULT_FIELDS
    tree: Node = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "tree", parse(self.expression))
        if self.year_from is not None and self.year_to is not None and self.year_from > self.year_to:
            raise ValueError("year_from is after year_to")

    @property
    def canonical(self) -> str:
        return render(self.tree)

    @classmethod
    def of(cls, tree: Node, **bounds) -> "Search":
        return cls(render(tree), **bounds)


@dataclass(frozen=True)
class Concept:
    """Terms and headings that mean one thing; terms with a space become phrases."""

    terms: tuple[str, ...] = ()
    mesh: tuple[str, ...] = ()

    def tree(self) -> Node:
        parts = [Phrase(t) if " " in t else Term(t) for t in self.terms] + [Vocabulary("MeSH", m) for m in self.mesh]
        if not parts:
            raise ValueError("a concept needs a term or a heading")
        return parts[0] if len(parts) == 1 else Boolean("OR", tuple(parts))


def _all(*concepts: Concept | None) -> Node:
    trees = [c.tree() for c in concepts if c is not None]
    if not trees:
        raise ValueError("no concept is given")
    return trees[0] if len(trees) == 1 else Boolean("AND", tuple(trees))


def pico(population: Concept | None = None, intervention: Concept | None = None, comparison: Concept | None = None, outcome: Concept | None = None) -> Node:
    return _all(population, intervention, comparison, outcome)


def peco(population: Concept | None = None, exposure: Concept | None = None, comparison: Concept | None = None, outcome: Concept | None = None) -> Node:
    return _all(population, exposure, comparison, outcome)
