"""A plain-Python evaluator over sets of pairs: what the DataFrames are tested against, for small data only."""

from __future__ import annotations

from .terms import ONE, Atom, Compare, Compl, Compose, Converse, Diamond, Diff, Equiv, Full, Id, Incl, Inter, LeftResidual, Plus, Product, Reduce, Rel, RelAdd, RightResidual, Star, Term, Union

Pairs = frozenset[tuple]


class SetEvaluator:
    """``relations``: (name, src, tgt) -> pairs; ``atoms``: concept -> atoms; terms must be typed; ``ends`` gives signatures."""

    def __init__(self, relations: dict, atoms: dict, ends):
        self.relations, self.atoms, self.ends = relations, atoms, ends

    def concept(self, name: str) -> set:
        return {1} if name == ONE else set(self.atoms[name])

    def full(self, t: Term) -> Pairs:
        a, b = self.ends(t)
        return frozenset((x, y) for x in self.concept(a) for y in self.concept(b))

    def __call__(self, t: Term) -> Pairs:
        ev = self
        match t:
            case Rel(name, a, b):
                return frozenset(self.relations[name, a, b])
            case Id(c):
                return frozenset((x, x) for x in self.concept(c))
            case Full():
                return self.full(t)
            case Atom(v, c):
                return frozenset((x, x) for x in self.concept(c) if x == v)
            case Compare(op, c):
                test = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
                return frozenset((x, y) for x in self.concept(c) for y in self.concept(c) if test(x, y))
            case Union(a, b):
                return ev(a) | ev(b)
            case Inter(a, b):
                return ev(a) & ev(b)
            case Diff(a, b):
                return ev(a) - ev(b)
            case Converse(a):
                return frozenset((y, x) for x, y in ev(a))
            case Compl(a):
                return self.full(t) - ev(a)
            case Compose(a, b):
                right = ev(b)
                return frozenset((x, w) for x, y in ev(a) for z, w in right if y == z)
            case Product(a, b):
                return frozenset((x, w) for x, _ in ev(a) for _, w in ev(b))
            case RightResidual(a, b):
                left, right = ev(a), ev(b)
                return frozenset((x, y) for x, y in self.full(t) if all((z, y) in right for z, w in left if w == x))
            case LeftResidual(a, b):
                left, right = ev(a), ev(b)
                return frozenset((x, y) for x, y in self.full(t) if all((x, z) in left for w, z in right if w == y))
            case Diamond(a, b):
                left, right = ev(a), ev(b)
                return frozenset((x, y) for x, y in self.full(t) if {z for w, z in left if w == x} == {z for z, w in right if w == y})
            case RelAdd(a, b):
                left, right, middle = ev(a), ev(b), self.concept(self.ends(a)[1])
                return frozenset((x, y) for x, y in self.full(t) if all((x, z) in left or (z, y) in right for z in middle))
            case Plus(a):
                known = set(ev(a))
                while new := {(x, w) for x, y in known for z, w in known if y == z} - known:
                    known |= new
                return frozenset(known)
            case Star(a):
                return ev(Plus(a)) | ev(Id(self.ends(a)[0]))
            case Reduce(a):
                return ev(a) - ev(Compose(a, Plus(a)))
            case Equiv(a, b):
                return self.full(t) - (ev(a) ^ ev(b))
            case Incl(a, b):
                return self.full(t) - (ev(a) - ev(b))
        raise TypeError(type(t).__name__)
