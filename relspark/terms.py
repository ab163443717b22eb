"""Terms of the relation algebra: immutable trees, built in Python or by the parser.

A term denotes a set of (source, target) pairs. ``a | b`` is union, ``a & b`` intersection, ``a - b``
difference, ``a >> b`` composition, ``~a`` converse and ``-a`` complement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Term:
    def __or__(self, other: Term) -> Term:
        return Union(self, other)

    def __and__(self, other: Term) -> Term:
        return Inter(self, other)

    def __sub__(self, other: Term) -> Term:
        return Diff(self, other)

    def __rshift__(self, other: Term) -> Term:
        return Compose(self, other)

    def __invert__(self) -> Term:
        return Converse(self)

    def __neg__(self) -> Term:
        return Compl(self)

    def parts(self) -> list[Term]:
        return [v for f in fields(self) if isinstance(v := getattr(self, f.name), Term)]

    def walk(self) -> Iterator[Term]:
        yield self
        for part in self.parts():
            yield from part.walk()

    def rebuilt(self, change) -> Term:
        """The same term with ``change`` applied to each part."""
        return type(self)(*[change(v) if isinstance(v, Term) else v for v in (getattr(self, f.name) for f in fields(self))])


@dataclass(frozen=True)
class Rel(Term):
    """A declared relation; name and signature identify it."""

    name: str
    src: str | None = None
    tgt: str | None = None


@dataclass(frozen=True)
class Id(Term):
    concept: str | None = None


@dataclass(frozen=True)
class Full(Term):
    src: str | None = None
    tgt: str | None = None


@dataclass(frozen=True)
class Atom(Term):
    value: object
    concept: str | None = None


@dataclass(frozen=True)
class Compare(Term):
    op: str  # one of < > <= >=
    concept: str | None = None


@dataclass(frozen=True)
class _Binary(Term):
    left: Term
    right: Term


@dataclass(frozen=True)
class _Unary(Term):
    of: Term


class Union(_Binary):
    pass


class Inter(_Binary):
    pass


class Diff(_Binary):
    pass


class Compose(_Binary):
    pass


class Product(_Binary):
    pass


class RightResidual(_Binary):
    """``l \\ r``: x and y such that whatever l relates to x, r relates to y."""


class LeftResidual(_Binary):
    """``l / r``: x and y such that l relates x to all that r relates y to."""


class Diamond(_Binary):
    """``l <> r``: x and y such that l's targets of x are exactly r's sources of y."""


class RelAdd(_Binary):
    """``l ! r``: x and y such that every z has x l z or z r y."""


class Equiv(_Binary):
    pass


class Incl(_Binary):
    pass


class Converse(_Unary):
    pass


class Compl(_Unary):
    pass


class Plus(_Unary):
    pass


class Star(_Unary):
    pass


class Reduce(_Unary):
    """``r%``: the pairs of r that no longer path of r makes superfluous."""


ONE = "ONE"

# Binding strength as written, loosest first.
_LEVEL = {Equiv: 1, Incl: 1, Union: 2, Inter: 2, Diff: 4, LeftResidual: 5, RightResidual: 5, Diamond: 5, Compose: 6, RelAdd: 6, Product: 6, Compl: 7, Converse: 8, Plus: 8, Star: 8, Reduce: 8}
_SIGN = {Equiv: "=", Incl: "|-", Union: "\\/", Inter: "/\\", Diff: "-", LeftResidual: "/", RightResidual: "\\", Diamond: "<>", Compose: ";", RelAdd: "!", Product: "#", Converse: "~", Plus: "+", Star: "*", Reduce: "%"}


def show(term: Term) -> str:
    """The term as script text, which parses back to it."""

    def leaf(name: str, *concepts: str | None) -> str:
        return name if None in concepts else f"{name}[{'*'.join(dict.fromkeys(concepts) if len(set(concepts)) == 1 and len(concepts) == 1 else concepts)}]"

    if isinstance(term, Rel):
        return leaf(term.name, term.src, term.tgt)
    if isinstance(term, Id):
        return leaf("I", term.concept)
    if isinstance(term, Full):
        return leaf("V", term.src, term.tgt)
    if isinstance(term, Atom):
        text = '"' + term.value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(term.value, str) else str(term.value).upper() if isinstance(term.value, bool) else str(term.value)
        return leaf("{" + text + "}", term.concept)
    if isinstance(term, Compare):
        return leaf(f"({term.op})", term.concept)
    level = _LEVEL[type(term)]
    put = lambda t, strict: f"({show(t)})" if _LEVEL.get(type(t), 9) < level + strict else show(t)
    if isinstance(term, Compl):
        return "-" + put(term.of, 1)
    if isinstance(term, _Unary):
        return put(term.of, 0) + _SIGN[type(term)]
    same = isinstance(term, (Union, Inter, Compose, RelAdd, Product))
    left = put(term.left, 1)
    right = show(term.right) if same and type(term.right) is type(term) else put(term.right, 1)
    return f"{left} {_SIGN[type(term)]} {right}"
