"""Class expressions in Manchester syntax, as the nested lists that axioms are made of."""

from __future__ import annotations

import re

_WORD = re.compile(r"""\s+|(?P<iri><[^>\s]*>)|(?P<quoted>'(?:[^'\\]|\\.)*')|(?P<text>"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^[^\s(),{}]+)?)|(?P<mark>[(){},])|(?P<name>[^\s(){},<>"']+)""")
#: Keywords of restrictions, and what they make.
_QUANTIFIERS = {"some": "ObjectSomeValuesFrom", "only": "ObjectAllValuesFrom", "value": "ObjectHasValue"}
_COUNTS = {"min": "ObjectMinCardinality", "max": "ObjectMaxCardinality", "exactly": "ObjectExactCardinality"}
_TOP = "owl:Thing"


class _Reader:
    def __init__(self, text: str, names: dict[str, str]):
        self.toks, self.at, self.names, self.text = [], 0, names, text
        at = 0
        while at < len(text):
            m = _WORD.match(text, at)
            if not m:
                raise SyntaxError(f"unexpected {text[at : at + 20]!r} in {text!r}")
            at = m.end()
            if m.lastgroup:
                self.toks.append(m[0])

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def take(self, wanted: str = "") -> str:
        t = self.peek()
        if not t or wanted and t != wanted:
            raise SyntaxError(f"expected {wanted or 'more'} at word {self.at} of {self.text!r}")
        self.at += 1
        return t

    def entity(self) -> str:
        t = self.take()
        if t.startswith("<"):
            return t[1:-1]
        if t.startswith('"'):
            return t
        plain = re.sub(r"\\(.)", r"\1", t[1:-1]) if t.startswith("'") else t
        if plain in self.names:
            return self.names[plain]
        if t.startswith("'") or ":" not in t:
            raise SyntaxError(f"no entity is called {plain!r}")
        return t

    def either(self):
        parts = [self.both()]
        while self.peek().lower() == "or":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ["ObjectUnionOf", *parts]

    def both(self):
        parts = [self.one()]
        while self.peek().lower() in ("and", "that"):
            self.take()
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else ["ObjectIntersectionOf", *parts]

    def one(self):
        t = self.peek()
        if t.lower() == "not":
            self.take()
            return ["ObjectComplementOf", self.one()]
        if t == "(":
            self.take()
            x = self.either()
            self.take(")")
            return x
        if t == "{":
            self.take()
            out = ["ObjectOneOf", self.entity()]
            while self.peek() == ",":
                self.take()
                out.append(self.entity())
            self.take("}")
            return out
        if t.lower() == "inverse":
            self.take()
            closed = self.peek() == "("
            if closed:
                self.take()
            role = ["ObjectInverseOf", self.entity()]
            if closed:
                self.take(")")
            return self.restriction(role)
        x = self.entity()
        return self.restriction(x) if self.peek().lower() in {*_QUANTIFIERS, *_COUNTS, "self"} else x

    def restriction(self, role):
        kind = self.take().lower()
        if kind == "self":
            return ["ObjectHasSelf", role]
        if kind == "value":
            return [_QUANTIFIERS[kind], role, self.entity()]
        if kind in _QUANTIFIERS:
            return [_QUANTIFIERS[kind], role, self.one()]
        if kind not in _COUNTS:
            raise SyntaxError(f"expected a restriction, not {kind!r}")
        n = self.take()
        if not n.isdigit():
            raise SyntaxError(f"expected a number, not {n!r}")
        more = self.peek() not in ("", ")", ",") and self.peek().lower() not in ("and", "or", "that")
        return [_COUNTS[kind], n, role, *([self.one()] if more else [])]


def expression(text: str, names: dict[str, str] | None = None):
    """The class expression that ``text`` is; ``names`` maps labels, quoted or not, to entities."""
    r = _Reader(text, names or {})
    out = r.either()
    if r.peek():
        raise SyntaxError(f"unexpected {r.peek()!r} in {text!r}")
    return out


def written(x) -> str:
    """An expression in Manchester syntax."""
    if isinstance(x, str):
        return f"<{x}>" if re.match(r"^[A-Za-z]+://", x) else x
    kind, *a = x
    inside = lambda k: f"({written(k)})" if isinstance(k, list) and k[0] in ("ObjectIntersectionOf", "ObjectUnionOf", *_QUANTIFIERS.values(), *_COUNTS.values(), "ObjectComplementOf") else written(k)
    if kind in ("ObjectIntersectionOf", "ObjectUnionOf"):
        return (" and " if kind == "ObjectIntersectionOf" else " or ").join(map(inside, a))
    if kind == "ObjectComplementOf":
        return f"not {inside(a[0])}"
    if kind == "ObjectOneOf":
        return "{" + ", ".join(map(written, a)) + "}"
    if kind == "ObjectInverseOf":
        return f"inverse({written(a[0])})"
    if kind == "ObjectHasSelf":
        return f"{written(a[0])} Self"
    for word, name in _QUANTIFIERS.items():
        if kind == name:
            return f"{written(a[0])} {word} {inside(a[1])}"
    for word, name in _COUNTS.items():
        if kind == name:
            return f"{written(a[1])} {word} {a[0]}" + (f" {inside(a[2])}" if len(a) > 2 else "")
    raise ValueError(f"no Manchester syntax for {kind}")
