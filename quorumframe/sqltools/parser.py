"""A recursive-descent parser of the recognised query grammar into a nested tree of dicts.

A query: {select, distinct, from, where, group, having, order, limit, offset, set, ctes}.
An expression has a key k: col, star, lit, agg, fn, op, neg, cast, case, sub, win, cmp,
between, in, like, null, exists, not, and, or.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"\s+|--[^\n]*|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\[\w[^\]]*\]|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+|\w+|<=|>=|<>|!=|==|\|\||[^\s\w]", re.S)
AGGREGATES = frozenset("count sum avg min max group_concat total".split())
RESERVED = frozenset("select from where group having order limit offset union intersect except on join inner left right full outer cross natural using and or not in like glob between is null exists as by asc desc distinct all case when then else end with window".split())
SET_OPS = ("union", "intersect", "except")


class ParseError(ValueError):
    """The text is no query of the grammar."""


def tokenize(sql: str) -> list[tuple[str, str]]:
    """(kind, text) tokens: word, num, str, dq (double-quoted), id (other quotes), op; operators in one spelling."""
    out: list[tuple[str, str]] = []
    for m in TOKEN.finditer(sql):
        t = m.group()
        if t[0].isspace() or t.startswith("--"):
            continue
        if t[0] == "'" and len(t) > 1:
            out.append(("str", t[1:-1].replace("''", "'")))
        elif t[0] == '"' and len(t) > 1:
            out.append(("dq", t[1:-1].replace('""', '"')))
        elif t[0] in "`[" and len(t) > 1:
            out.append(("id", t[1:-1]))
        elif t[0].isdigit() or t[0] == "." and len(t) > 1:
            out.append(("num", t))
        elif re.match(r"\w", t):
            out.append(("word", t))
        else:
            t = {"<>": "!=", "==": "="}.get(t, t)
            if t == "=" and out and out[-1] in (("op", ">"), ("op", "<"), ("op", "!")):
                out[-1] = ("op", out[-1][1] + "=")
            else:
                out.append(("op", t))
    return out


class Parser:
    def __init__(self, sql: str) -> None:
        self.ts = tokenize(sql)
        self.i = 0
        # Lower-case word or operator at each place; '' for quoted things and numbers, and beyond the end.
        self.words = [t.lower() if kind == "word" else t if kind == "op" else "" for kind, t in self.ts] + [""] * 8

    def peek(self, ahead: int = 0) -> str:
        """Lower-case word or operator ahead; '' for quoted things, numbers and the end."""
        k = self.i + ahead
        return self.words[k] if k < len(self.words) else ""

    def kind(self, ahead: int = 0) -> str:
        return self.ts[self.i + ahead][0] if self.i + ahead < len(self.ts) else "end"

    def take(self, *want: str) -> bool:
        """Take the next tokens if they are these words or operators."""
        i, n = self.i, len(want)
        if i < len(self.words) and self.words[i] == want[0] and (n == 1 or self.words[i + 1 : i + n] == list(want[1:])):
            self.i += n
            return True
        return False

    def need(self, want: str) -> None:
        if not self.take(want):
            raise ParseError(f"{want} expected at token {self.i}")

    def name(self) -> str:
        kind, t = self.ts[self.i] if self.i < len(self.ts) else ("end", "")
        if kind in ("id", "dq") or kind == "word" and t.lower() not in RESERVED:
            self.i += 1
            return t
        raise ParseError(f"name expected at token {self.i}")

    def statement(self) -> dict:
        q = self.query()
        self.take(";")
        while self.take(";"):
            pass
        if self.i < len(self.ts):
            raise ParseError("text after the query" if self.ts[self.i - 1] != ("op", ";") else "several statements")
        return q

    def query(self) -> dict:
        ctes: dict[str, dict] = {}
        recursive = False
        if self.take("with"):
            recursive = self.take("recursive")
            while True:
                n = self.name().lower()
                if self.take("("):
                    while not self.take(")"):
                        self.i += 1
                        if self.i > len(self.ts):
                            raise ParseError("open bracket")
                self.need("as")
                self.need("(")
                ctes[n] = self.query()
                self.need(")")
                if not self.take(","):
                    break
        left = self.core()
        while self.peek() in SET_OPS:
            op = self.peek()
            self.i += 1
            if self.take("all"):
                op += "_all"
            right = self.core()
            left = {"set": op, "left": left, "right": right}
        if self.take("order", "by"):
            left["order"] = self.order_list()
        if self.take("limit"):
            a = self.number()
            if self.take(","):
                left["offset"], left["limit"] = a, self.number()
            else:
                left["limit"] = a
                if self.take("offset"):
                    left["offset"] = self.number()
        if ctes:
            left["ctes"], left["recursive"] = ctes, recursive
        return left

    def number(self) -> int:
        neg = self.take("-")
        if self.kind() != "num":
            raise ParseError("number expected")
        self.i += 1
        return int(float(self.ts[self.i - 1][1])) * (-1 if neg else 1)

    def order_list(self) -> list[tuple[dict, str]]:
        out = []
        while True:
            e = self.expr()
            d = "desc" if self.take("desc") else "asc"
            self.take("asc")
            out.append((e, d))
            if not self.take(","):
                return out

    def core(self) -> dict:
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        self.need("select")
        q: dict = {"distinct": self.take("distinct"), "select": [], "from": []}
        self.take("all")
        while True:
            e = self.expr()
            alias = None
            if self.take("as"):
                alias = self.alias()
            elif self.kind() in ("id", "dq") or self.kind() == "word" and self.peek() not in RESERVED:
                alias = self.alias()
            q["select"].append({"e": e, "as": alias})
            if not self.take(","):
                break
        if self.take("from"):
            q["from"] = self.from_list()
        if self.take("where"):
            q["where"] = self.expr()
        if self.take("group", "by"):
            q["group"] = [self.expr()]
            while self.take(","):
                q["group"].append(self.expr())
        if self.take("having"):
            q["having"] = self.expr()
        return q

    def alias(self) -> str:
        if self.kind() == "str":
            self.i += 1
            return self.ts[self.i - 1][1]
        return self.name()

    def from_list(self) -> list[dict]:
        """Table items in order: {table|sub, alias, join (None for the first), on, using}."""
        out = [self.table_item(None)]
        while True:
            if self.take(","):
                out.append(self.table_item("cross"))
                continue
            natural = self.take("natural")
            kind = next((k for k in ("inner", "left", "right", "full", "cross") if self.take(k)), None)
            if kind in ("left", "right", "full"):
                self.take("outer")
            if not self.take("join"):
                if natural or kind:
                    raise ParseError("JOIN expected")
                return out
            item = self.table_item("natural" if natural else kind or "inner")
            if self.take("on"):
                item["on"] = self.expr()
            elif self.take("using"):
                self.need("(")
                item["using"] = [self.name()]
                while self.take(","):
                    item["using"].append(self.name())
                self.need(")")
            out.append(item)

    def table_item(self, join: str | None) -> dict:
        item: dict = {"join": join}
        if self.take("("):
            item["sub"] = self.query()
            self.need(")")
        else:
            item["table"] = self.name().lower()
        if self.take("as") or self.kind() in ("id", "dq") or self.kind() == "word" and self.peek() not in RESERVED:
            item["alias"] = self.name().lower()
        return item

    def expr(self) -> dict:
        xs = [self.conjunct()]
        while self.take("or"):
            xs.append(self.conjunct())
        return xs[0] if len(xs) == 1 else {"k": "or", "xs": xs}

    def conjunct(self) -> dict:
        xs = [self.negation()]
        while self.take("and"):
            xs.append(self.negation())
        return xs[0] if len(xs) == 1 else {"k": "and", "xs": xs}

    def negation(self) -> dict:
        if self.take("not"):
            return {"k": "not", "x": self.negation()}
        return self.predicate()

    def predicate(self) -> dict:
        if self.peek() == "exists":
            self.i += 1
            self.need("(")
            q = self.query()
            self.need(")")
            return {"k": "exists", "q": q}
        left = self.additive()
        while True:
            neg = self.peek() == "not" and self.peek(1) in ("in", "like", "glob", "between")
            if neg:
                self.i += 1
            if self.take("between"):
                lo = self.additive()
                self.need("and")
                left = {"k": "between", "x": left, "lo": lo, "hi": self.additive(), "neg": neg}
            elif self.take("in"):
                self.need("(")
                if self.peek() in ("select", "with"):
                    left = {"k": "in", "x": left, "q": self.query(), "neg": neg}
                else:
                    vs = [self.additive()]
                    while self.take(","):
                        vs.append(self.additive())
                    left = {"k": "in", "x": left, "vs": vs, "neg": neg}
                self.need(")")
            elif self.peek() in ("like", "glob"):
                op = self.peek()
                self.i += 1
                left = {"k": "like", "op": op, "x": left, "p": self.additive(), "neg": neg}
            elif self.take("is"):
                n = self.take("not")
                if self.take("null"):
                    left = {"k": "null", "x": left, "neg": n}
                else:
                    left = {"k": "cmp", "op": "is not" if n else "is", "l": left, "r": self.additive()}
            elif self.peek() in ("=", "!=", "<", ">", "<=", ">="):
                op = self.peek()
                self.i += 1
                left = {"k": "cmp", "op": op, "l": left, "r": self.additive()}
            else:
                return left

    def additive(self) -> dict:
        left = self.term()
        while self.peek() in ("+", "-", "||"):
            op = self.peek()
            self.i += 1
            left = {"k": "op", "op": op, "l": left, "r": self.term()}
        return left

    def term(self) -> dict:
        left = self.factor()
        while self.peek() in ("*", "/", "%"):
            op = self.peek()
            self.i += 1
            left = {"k": "op", "op": op, "l": left, "r": self.factor()}
        return left

    def factor(self) -> dict:
        if self.take("-"):
            return {"k": "neg", "x": self.factor()}
        if self.take("+"):
            return self.factor()
        kind = self.kind()
        if kind == "end":
            raise ParseError("the text ends too early")
        if self.take("("):
            if self.peek() in ("select", "with"):
                q = self.query()
                self.need(")")
                return {"k": "sub", "q": q}
            e = self.expr()
            self.need(")")
            return e
        if self.take("*"):
            return {"k": "star", "t": None}
        if kind == "num":
            self.i += 1
            t = self.ts[self.i - 1][1]
            return {"k": "lit", "v": float(t) if re.search(r"[.eE]", t) else int(t)}
        if kind == "str":
            self.i += 1
            return {"k": "lit", "v": self.ts[self.i - 1][1]}
        word = self.peek()
        if word == "null":
            self.i += 1
            return {"k": "lit", "v": None}
        if word == "case":
            return self.case()
        if word == "cast" and self.peek(1) == "(":
            self.i += 2
            e = self.expr()
            self.need("as")
            kind_name = self.name()
            if self.take("("):
                while not self.take(")"):
                    self.i += 1
                    if self.i > len(self.ts):
                        raise ParseError("open bracket")
            self.need(")")
            return {"k": "cast", "x": e, "as": kind_name.lower()}
        if kind == "word" and self.peek(1) == "(" and word not in RESERVED:
            return self.call(word)
        n = self.name()
        if self.take("."):
            if self.take("*"):
                return {"k": "star", "t": n.lower()}
            return {"k": "col", "t": n.lower(), "c": self.name().lower()}
        return {"k": "col", "t": None, "c": n.lower(), "dq": n if kind == "dq" else None}

    def case(self) -> dict:
        self.need("case")
        base = None if self.peek() == "when" else self.expr()
        whens = []
        while self.take("when"):
            c = self.expr()
            self.need("then")
            whens.append((c, self.expr()))
        other = self.expr() if self.take("else") else None
        self.need("end")
        return {"k": "case", "x": base, "whens": whens, "else": other}

    def call(self, name: str) -> dict:
        self.i += 2
        distinct = self.take("distinct")
        args: list[dict] = []
        if not self.take(")"):
            args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
            self.need(")")
        agg = name in AGGREGATES and not (name in ("min", "max") and len(args) > 1)
        out = {"k": "agg" if agg else "fn", "f": name, "distinct": distinct, "args": args}
        if self.take("filter", "("):
            self.need("where")
            out["filter"] = self.expr()
            self.need(")")
        if self.take("over"):
            self.need("(")
            part, order = [], []
            if self.take("partition", "by"):
                part = [self.additive()]
                while self.take(","):
                    part.append(self.additive())
            if self.take("order", "by"):
                order = self.order_list()
            frame = []
            while self.peek() != ")":
                if self.kind() == "end":
                    raise ParseError("open window")
                frame.append(self.ts[self.i][1].lower())
                self.i += 1
            self.need(")")
            return {"k": "win", "x": out, "partition": part, "order": order, "frame": " ".join(frame)}
        return out


def parse(sql: str, legacy: bool = False) -> dict:
    """The tree of one query; raises ParseError for anything else.

    legacy: only the first key of GROUP BY and ORDER BY counts, one direction
    holds for the whole list, and a LIMIT is taken as 1.
    """
    q = Parser(sql or "").statement()
    if legacy:
        for x in walk_queries(q):
            if x.get("group"):
                x["group"] = x["group"][:1]
            if x.get("order"):
                x["order"] = [(x["order"][0][0], x["order"][-1][1])]
            if x.get("limit") is not None:
                x["limit"] = 1
    return q


def children(node) -> list:
    """Nodes right below a query, an expression or a list."""
    if isinstance(node, dict):
        return [v for k, v in node.items() if isinstance(v, (dict, list, tuple))]
    return [x for x in node if isinstance(x, (dict, list, tuple))]


def walk(node, into_queries: bool = True):
    """All dict nodes at and below; into_queries False stops at inner queries."""
    if isinstance(node, dict):
        yield node
    for c in children(node):
        if not into_queries and isinstance(c, dict) and ("select" in c or "set" in c):
            continue
        yield from walk(c, into_queries)


def walk_queries(q: dict):
    """All queries at and below."""
    return (n for n in walk(q) if "select" in n or "set" in n)


def cores(q: dict) -> list[dict]:
    """The plain selects of a query with set operators, left to right."""
    return [*cores(q["left"]), *cores(q["right"])] if "set" in q else [q]


def sides(q: dict) -> tuple[dict, list[tuple[str, dict]]]:
    """The first select and the (operator, select) pairs after it."""
    if "set" not in q:
        return q, []
    first, rest = sides(q["left"])
    return first, [*rest, (q["set"], q["right"])]
