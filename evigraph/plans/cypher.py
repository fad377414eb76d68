"""Text of the bounded graph query language to a syntax tree.

One MATCH with a node or a one-hop pattern (further node patterns make a product), WHERE,
mutations, RETURN with ORDER BY, SKIP and LIMIT.  Anything else is refused by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import ParseError, Unsupported

TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"""
    r"""|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*)|(?P<mark><>|<=|>=|->|<-|[-()\[\]{}:,.=<>*|]))""",
    re.X,
)
CLAUSES = ("MATCH", "OPTIONAL", "WHERE", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "RETURN", "ORDER", "SKIP", "LIMIT")
REFUSED = ("WITH", "UNWIND", "CALL", "FOREACH", "LOAD", "UNION", "DETACH", "XOR", "EXISTS", "CASE")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
MAX_LIST = 256


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class PropRef:
    var: str
    prop: str


@dataclass
class NodePattern:
    var: str
    label: str | None
    props: dict = field(default_factory=dict)


@dataclass
class Pattern:
    node: NodePattern
    rel_var: str | None = None
    rel_type: str | None = None
    target: NodePattern | None = None


@dataclass
class Test:
    ref: PropRef
    op: str  # = <> < <= > >= IN NOT_IN NULL NOT_NULL
    value: object = None


@dataclass
class Bool:
    op: str  # AND OR
    items: list


@dataclass
class Item:
    ref: object  # variable name, PropRef or "*"
    aggregate: str | None = None

    @property
    def name(self) -> str:
        if self.aggregate == "COUNT":
            return "count"
        text = self.ref if isinstance(self.ref, str) else f"{self.ref.var}.{self.ref.prop}"
        return f"{self.aggregate.lower()}({text})" if self.aggregate else text


@dataclass
class Query:
    patterns: list = field(default_factory=list)
    optional: bool = False
    where: object = None
    create: list = field(default_factory=list)
    merge: list = field(default_factory=list)
    set: list = field(default_factory=list)
    remove: list = field(default_factory=list)
    delete: list = field(default_factory=list)
    items: list = field(default_factory=list)
    distinct: bool = False
    order: list = field(default_factory=list)
    skip: object = None
    limit: object = None

    @property
    def mutates(self) -> bool:
        return bool(self.create or self.merge or self.set or self.remove or self.delete)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        if not text[at:].strip():
            break
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ParseError(f"unexpected character at {at}: {text[at:at + 12]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def unquote(text: str) -> str:
    """Decode a literal: a backslash protects itself and the delimiter, nothing else."""
    mark, body, out, i = text[0], text[1:-1], [], 0
    while i < len(body):
        if body[i] == "\\":
            if i + 1 >= len(body) or body[i + 1] not in ("\\", mark):
                raise ParseError("a backslash may only protect a backslash or the delimiter")
            i += 1
        out.append(body[i])
        i += 1
    return "".join(out)


class _Parser:
    def __init__(self, text: str):
        self.tokens = tokenize(text)
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def word(self, *names: str) -> bool:
        kind, text = self.peek()
        return kind == "name" and text.upper() in names

    def take(self, text: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or (text is not None and got.upper() != text.upper()):
            raise ParseError(f"expected {text or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def accept(self, text: str) -> bool:
        if self.peek()[1].upper() == text and self.peek()[0] != "string":
            self.at += 1
            return True
        return False

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "name":
            raise ParseError(f"expected a name, found {text or 'the end'}")
        self.at += 1
        return text

    def literal(self, refs: bool = False):
        kind, text = self.peek()
        if kind == "string":
            self.at += 1
            return unquote(text)
        if kind == "number":
            self.at += 1
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "param":
            self.at += 1
            return Param(text[1:])
        if kind == "name" and text.lower() in ("true", "false", "null"):
            self.at += 1
            return {"true": True, "false": False, "null": None}[text.lower()]
        if text == "[":
            self.at += 1
            values = []
            while not self.accept("]"):
                if values:
                    self.take(",")
                if refs and self.peek()[0] == "name" and self.peek(1)[1] == ".":
                    values.append(self.prop())
                else:
                    values.append(self.literal())
            if len(values) > MAX_LIST:
                raise ParseError(f"a list holds at most {MAX_LIST} values")
            kinds = {type(v) for v in values if not isinstance(v, Param)}
            if len(kinds) > 1:
                raise ParseError("a list holds values of one type")
            return values
        raise ParseError(f"expected a literal, found {text or 'the end'}")

    def prop(self) -> PropRef:
        var = self.name()
        self.take(".")
        return PropRef(var, self.name())

    def node(self) -> NodePattern:
        self.take("(")
        if self.peek()[0] != "name":
            raise Unsupported("a node pattern needs a variable")
        var, label, props = self.name(), None, {}
        if self.accept(":"):
            label = self.name()
            if self.peek()[1] in (":", "|"):
                raise Unsupported("a node pattern has one label")
        if self.accept("{"):
            while not self.accept("}"):
                if props:
                    self.take(",")
                key = self.name()
                self.take(":")
                props[key] = self.literal()
        self.take(")")
        return NodePattern(var, label, props)

    def pattern(self) -> Pattern:
        first = self.node()
        if self.peek()[1] == "<-":
            raise Unsupported("only outgoing patterns")
        if not self.accept("-"):
            return Pattern(first)
        self.take("[")
        var = self.name() if self.peek()[0] == "name" else None
        kind = None
        if self.accept(":"):
            kind = self.name()
        if self.peek()[1] in ("|", "*", "{"):
            raise Unsupported("one relationship type, one hop, no inline properties")
        self.take("]")
        if self.peek()[1] != "->":
            raise Unsupported("only outgoing patterns")
        self.take("->")
        out = Pattern(first, var, kind, self.node())
        if self.peek()[1] in ("-", "<-"):
            raise Unsupported("patterns have one hop")
        return out

    def where(self):
        items = [self.conjunction()]
        while self.accept("OR"):
            items.append(self.conjunction())
        return items[0] if len(items) == 1 else Bool("OR", items)

    def conjunction(self):
        items = [self.test()]
        while self.accept("AND"):
            items.append(self.test())
        return items[0] if len(items) == 1 else Bool("AND", items)

    def test(self):
        if self.word("NOT"):
            raise Unsupported("NOT")
        if self.accept("("):
            inner = self.where()
            self.take(")")
            return inner
        ref = self.prop()
        if self.accept("IS"):
            absent = not self.accept("NOT")
            self.take("NULL")
            return Test(ref, "NULL" if absent else "NOT_NULL")
        if self.accept("NOT"):
            self.take("IN")
            return Test(ref, "NOT_IN", self.literal())
        if self.accept("IN"):
            return Test(ref, "IN", self.literal())
        op = self.take()
        if op not in ("=", "<>", "<", "<=", ">", ">="):
            raise ParseError(f"unknown comparison {op}")
        return Test(ref, op, self.literal())

    def item(self) -> Item:
        kind, text = self.peek()
        if kind == "name" and text.upper() in AGGREGATES and self.peek(1)[1] == "(":
            name = self.name().upper()
            self.take("(")
            if self.word("DISTINCT"):
                raise Unsupported("DISTINCT in an aggregate")
            if name == "COUNT":
                ref = "*" if self.accept("*") else self.name()
            else:
                ref = self.prop()
            self.take(")")
            out = Item(ref, name)
        elif self.peek(1)[1] == ".":
            out = Item(self.prop())
        else:
            out = Item(self.name())
        if self.word("AS"):
            raise Unsupported("AS")
        return out

    def listed(self, one) -> list:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return out

    def assignment(self):
        ref = self.prop()
        self.take("=")
        return ref, self.literal(refs=True)

    def ordering(self):
        ref = self.prop() if self.peek(1)[1] == "." else self.name()
        down = self.accept("DESC")
        if not down:
            self.accept("ASC")
        return ref, down

    def count(self):
        got = self.literal()
        if isinstance(got, bool) or not isinstance(got, (int, Param)) or isinstance(got, int) and got < 0:
            raise ParseError("SKIP and LIMIT take a whole number or a parameter")
        return got

    def query(self) -> Query:
        q, seen = Query(), set()
        while self.peek()[0] != "end":
            word = self.name().upper()
            if word in REFUSED:
                raise Unsupported(word)
            if word not in CLAUSES:
                raise ParseError(f"unexpected {word}")
            if word in seen and word in ("MATCH", "RETURN", "WHERE", "ORDER", "SKIP", "LIMIT"):
                raise Unsupported(f"a second {word}")
            if word == "OPTIONAL":
                q.optional = True
                continue
            seen.add(word)
            if word == "MATCH":
                q.patterns = self.listed(self.pattern)
                if any(p.target for p in q.patterns[1:]):
                    raise Unsupported("further patterns are single nodes")
            elif word == "WHERE":
                q.where = self.where()
            elif word == "CREATE":
                q.create += self.listed(self.pattern)
            elif word == "MERGE":
                q.merge += self.listed(self.pattern)
            elif word == "SET":
                q.set += self.listed(self.assignment)
            elif word == "REMOVE":
                q.remove += self.listed(self.prop)
            elif word == "DELETE":
                q.delete += self.listed(self.name)
            elif word == "RETURN":
                q.distinct = self.accept("DISTINCT")
                q.items = self.listed(self.item)
            elif word == "ORDER":
                self.take("BY")
                q.order = self.listed(self.ordering)
            elif word == "SKIP":
                q.skip = self.count()
            elif word == "LIMIT":
                q.limit = self.count()
        _check(q)
        return q


def _check(q: Query) -> None:
    if not (q.items or q.mutates):
        raise ParseError("a query returns or changes something")
    counts = [i for i in q.items if i.aggregate == "COUNT"]
    if len(counts) > 1:
        raise Unsupported("two COUNTs would share one name")
    if any(i.aggregate for i in q.items) and any(not i.aggregate for i in q.items):
        raise ParseError("aggregates and plain items don't mix: there is no grouping")
    if q.mutates and (q.distinct or q.order or q.skip is not None or q.limit is not None or any(i.aggregate for i in q.items)):
        raise Unsupported("RETURN after a change takes plain items only")
    if not q.patterns and any(p.target for p in [*q.create, *q.merge]):
        raise Unsupported("a relationship is made between nodes that MATCH binds")
    bound = {v for p in [*q.patterns, *q.create, *q.merge] for v in (p.node.var, p.rel_var, p.target and p.target.var) if v}
    used = [i.ref if isinstance(i.ref, str) else i.ref.var for i in q.items]
    used += [r if isinstance(r, str) else r.var for r, _ in q.order] + [r.var for r, _ in q.set] + [r.var for r in q.remove] + q.delete
    for v in used:
        if v != "*" and v not in bound:
            raise ParseError(f"{v} isn't bound")


def parse(text: str) -> Query:
    """The syntax tree of a query."""
    return _Parser(text).query()


def bind(value, params: dict):
    """Replace parameters by their values; an unbound one is an error."""
    if isinstance(value, Param):
        if value.name not in params:
            raise ParseError(f"parameter ${value.name} has no value")
        return params[value.name]
    if isinstance(value, list):
        return [bind(v, params) for v in value]
    return value
