"""Write a parsed query as Spark SQL: dialect differences, and instance lifting.

Lifting adds the instance to every table, join, group, set operation and limit,
so one Spark job answers a query for all instances of a database. A query that
cannot be lifted raises Unsupported and is run for each instance.
"""

from __future__ import annotations

import re

from .parser import walk

INST, ORD = "__inst", "__ord"


class Unsupported(ValueError):
    """The query cannot be written this way."""


# Date formats of strftime and their patterns here.
DATE_PATTERNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}
CASTS = {"int": "bigint", "integer": "bigint", "real": "double", "float": "double", "double": "double", "numeric": "double", "decimal": "double", "text": "string", "varchar": "string", "char": "string"}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Renderer:
    """schema: table -> {column: type}; views: table -> view name; both in lower case."""

    def __init__(self, schema: dict[str, dict[str, str]], views: dict[str, str], lift: bool = False, instances: str = "") -> None:
        self.schema, self.views, self.lift, self.instances = schema, views, lift, instances
        self.ctes: dict[str, dict[str, str]] = {}
        self.count = 0

    def scope(self, q: dict, outer: list) -> list:
        """[(alias, {column: type})] of a select; inner scopes see outer ones after their own."""
        own = []
        for item in q["from"]:
            if "sub" in item:
                self.count += 1
                item.setdefault("alias", f"q{self.count}")
                cols = self.outputs(item["sub"], outer)
            else:
                item.setdefault("alias", item["table"])
                cols = self.ctes.get(item["table"]) or self.schema.get(item["table"])
                if cols is None:
                    raise Unsupported(f"no such table: {item['table']}")
            own.append((item["alias"], cols))
        return own

    def outputs(self, q: dict, outer: list) -> dict[str, str]:
        """Names and types of the columns of a query."""
        while "set" in q:
            q = q["left"]
        own = self.scope(q, outer)
        out: dict[str, str] = {}
        for k, x in enumerate(q["select"]):
            if x["e"]["k"] == "star":
                for a, cols in own:
                    if x["e"]["t"] in (None, a):
                        out |= cols
            else:
                out[self.output_name(x, k)] = self.kind(x["e"], [own, *outer])
        return out

    @staticmethod
    def output_name(x: dict, k: int) -> str:
        return (x["as"] or (x["e"]["c"] if x["e"]["k"] == "col" else f"c{k}")).lower()

    def find(self, e: dict, scopes: list) -> tuple[str, str] | None:
        """(alias, type) of a column, from the innermost scope that has it."""
        for own in scopes:
            for alias, cols in own:
                if e["t"] in (None, alias) and e["c"] in cols:
                    return alias, cols[e["c"]]
        return None

    def kind(self, e: dict, scopes: list) -> str:
        """int, double, text, bool or unknown."""
        k = e["k"]
        if k == "col":
            f = self.find(e, scopes)
            return f[1] if f else "text" if e.get("dq") else "unknown"
        if k == "lit":
            return {int: "int", float: "double", str: "text"}.get(type(e["v"]), "unknown")
        if k == "neg":
            return self.kind(e["x"], scopes)
        if k == "op":
            a, b = self.kind(e["l"], scopes), self.kind(e["r"], scopes)
            return "text" if e["op"] == "||" else "int" if a == b == "int" else "double"
        if k == "cast":
            return {"bigint": "int", "double": "double", "string": "text"}.get(CASTS.get(e["as"], "string"), "unknown")
        if k == "agg":
            if e["f"] == "count":
                return "int"
            return "double" if e["f"] in ("avg", "total") else "text" if e["f"] == "group_concat" else self.kind(e["args"][0], scopes)
        if k == "fn":
            return {"length": "int", "instr": "int", "upper": "text", "lower": "text", "substr": "text", "trim": "text", "replace": "text", "strftime": "text", "julianday": "double"}.get(e["f"], "unknown")
        if k == "case":
            return self.kind(e["whens"][0][1], scopes)
        if k == "sub":
            return next(iter(self.outputs(e["q"], scopes).values()))
        return "bool" if k in ("cmp", "between", "in", "like", "null", "exists", "not", "and", "or") else "unknown"

    def value(self, e: dict, scopes: list, names: dict | None = None) -> str:
        """An expression as a value: conditions become 0 and 1."""
        text = self.expr(e, scopes, names)
        return f"CAST({text} AS INT)" if self.kind(e, scopes) == "bool" else text

    def expr(self, e: dict, scopes: list, names: dict | None = None) -> str:
        r = lambda x: self.expr(x, scopes, names)
        v = lambda x: self.value(x, scopes, names)
        k = e["k"]
        if k == "col":
            f = self.find(e, scopes)
            if f:
                return f"{quote(f[0])}.{quote(e['c'])}"
            if e.get("dq") is not None and e["t"] is None:
                return self.literal(e["dq"])
            if names and e["t"] is None and e["c"] in names:
                return "(" + self.value(names[e["c"]], scopes) + ")"
            raise Unsupported(f"no such column: {e['c']}")
        if k == "lit":
            return self.literal(e["v"])
        if k == "star":
            return "*"
        if k == "neg":
            return f"(- {v(e['x'])})"
        if k == "op":
            a, b = v(e["l"]), v(e["r"])
            if e["op"] == "/" and self.kind(e["l"], scopes) == self.kind(e["r"], scopes) == "int":
                return f"({a} div {b})"
            return f"({a} {e['op']} {b})"
        if k == "cmp":
            op = {"is": "<=>", "is not": "<=>"}.get(e["op"], e["op"])
            text = f"({v(e['l'])} {op} {v(e['r'])})"
            return f"(NOT {text})" if e["op"] == "is not" else text
        n = "NOT " if e.get("neg") else ""
        if k == "between":
            return f"({v(e['x'])} {n}BETWEEN {v(e['lo'])} AND {v(e['hi'])})"
        if k == "like":
            if e["op"] == "glob":
                pattern = re.escape(str(e["p"].get("v", ""))).replace(r"\*", ".*").replace(r"\?", ".")
                return f"({n}{v(e['x'])} RLIKE {self.literal('^' + pattern + '$')})"
            return f"({v(e['x'])} {n}ILIKE {v(e['p'])})"
        if k == "null":
            return f"({v(e['x'])} IS {n}NULL)"
        if k == "not":
            return f"(NOT {r(e['x'])})"
        if k in ("and", "or"):
            return "(" + f" {k.upper()} ".join(r(x) for x in e["xs"]) + ")"
        if k == "in":
            if "vs" in e:
                return f"({v(e['x'])} {n}IN ({', '.join(map(v, e['vs']))}))"
            inner = self.query(e["q"], scopes)
            if not self.lift:
                return f"({v(e['x'])} {n}IN ({inner}))"
            if n:
                raise Unsupported("NOT IN is not lifted")
            col = quote(next(iter(self.outputs(e["q"], scopes))))
            return f"((({self.inst(scopes)}, {v(e['x'])})) IN (SELECT {INST}, {col} FROM ({inner})))"
        if k == "exists":
            inner = self.query(e["q"], scopes)
            if not self.lift:
                return f"(EXISTS ({inner}))"
            if self.correlated(e["q"], scopes):
                raise Unsupported("correlated EXISTS is not lifted")
            return f"({self.inst(scopes)} IN (SELECT {INST} FROM ({inner})))"
        if k == "sub":
            inner = self.query(e["q"], scopes)
            if not self.lift:
                return f"({inner})"
            q = e["q"]
            if "set" in q or q.get("group") or not self.aggregates(q) or self.correlated(q, scopes):
                raise Unsupported("only uncorrelated aggregates are lifted as scalars")
            self.count += 1
            col = quote(next(iter(self.outputs(q, scopes))))
            return f"(SELECT max({col}) FROM ({inner}) s{self.count} WHERE s{self.count}.{INST} = {self.inst(scopes)})"
        if k == "cast":
            kind = CASTS.get(e["as"])
            if kind is None:
                raise Unsupported(f"cast to {e['as']}")
            return f"try_cast({v(e['x'])} AS {kind})"
        if k == "case":
            base = f" {v(e['x'])}" if e["x"] else ""
            test = v if e["x"] else r
            return f"(CASE{base} " + " ".join(f"WHEN {test(c)} THEN {v(x)}" for c, x in e["whens"]) + (f" ELSE {v(e['else'])}" if e["else"] else "") + " END)"
        if k == "win":
            part = ([self.inst(scopes)] if self.lift else []) + [v(x) for x in e["partition"]]
            inside = (f"PARTITION BY {', '.join(part)} " if part else "") + (f"ORDER BY {self.order(e['order'], scopes, names)} " if e["order"] else "") + e["frame"]
            return f"{v(e['x'])} OVER ({inside.strip()})"
        return self.call(e, v, r)

    def call(self, e: dict, v, r) -> str:
        f, args = e["f"], [v(a) for a in e["args"]]
        only = f" FILTER (WHERE {r(e['filter'])})" if e.get("filter") else ""
        d = "DISTINCT " if e["distinct"] else ""
        if f == "strftime" and len(args) == 2 and e["args"][0].get("v"):
            pattern = re.sub(r"%\w", lambda m: DATE_PATTERNS.get(m.group(), "?"), e["args"][0]["v"])
            if "?" in pattern:
                raise Unsupported("strftime pattern")
            text = f"date_format({args[1]}, '{pattern}')"
        elif f == "julianday" and len(args) == 1:
            text = f"(unix_timestamp(CAST({args[0]} AS timestamp)) / 86400.0 + 2440587.5)"
        elif f == "date" and len(args) == 1:
            text = f"date_format({args[0]}, 'yyyy-MM-dd')"
        elif f == "group_concat":
            text = f"array_join(collect_list({d}CAST({args[0]} AS string)){only}, {args[1] if len(args) > 1 else repr(',')})"
        elif f == "total":
            text = f"coalesce(sum({d}{args[0]}){only}, 0.0D)"
        elif f in ("min", "max") and len(args) > 1:
            text = f"{'least' if f == 'min' else 'greatest'}({', '.join(args)})"
        elif f == "substr" and len(args) == 3 and e["args"][1].get("v") == 0:
            text = f"substr({args[0]}, 1, {args[2]} - 1)"
        elif f in ("count", "sum", "avg", "min", "max", "coalesce", "ifnull", "nullif", "abs", "round", "length", "upper", "lower", "substr", "replace", "trim", "ltrim", "rtrim", "instr", "rank", "dense_rank", "row_number", "ntile", "percent_rank", "cume_dist", "lag", "lead", "first_value", "last_value"):
            text = f"{f}({d}{', '.join(args)}){only}"
        else:
            raise Unsupported(f"no such function: {f}")
        return text

    @staticmethod
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else f"{v}L" if abs(v) > 2**31 - 1 else str(v)

    def inst(self, scopes: list) -> str:
        return f"{quote(scopes[0][0][0])}.{INST}"

    def correlated(self, q: dict, scopes: list) -> bool:
        """Whether a query names a column that only an outer scope has."""
        for n in walk(q):
            if n.get("k") == "col":
                inner = [self.scope(s, []) for s in walk(q) if "select" in s]
                if not any(self.find(n, [o]) for o in inner) and self.find(n, scopes):
                    return True
        return False

    @staticmethod
    def aggregates(q: dict) -> bool:
        return any(n.get("k") == "agg" and not n.get("window") for x in [q["select"], q.get("having") or {}] for n in walk(x, False)) and not any(n.get("k") == "win" for n in walk(q["select"], False))

    def order(self, items: list, scopes: list, names: dict | None) -> str:
        """ORDER BY keys; numbers are output positions and stay."""
        return ", ".join(f"{self.value(e, scopes, names)} {d.upper()}" for e, d in items)

    def query(self, q: dict, outer: list | None = None, top: bool = False) -> str:
        outer = outer or []
        head = ""
        if q.get("ctes"):
            if q.get("recursive") or self.lift and any("order" in c for c in q["ctes"].values()):
                raise Unsupported("recursive WITH")
            done = []
            for name, c in q["ctes"].items():
                done.append(f"{quote(name)} AS ({self.query(c)})")
                self.ctes[name] = self.outputs(c, [])
            head = "WITH " + ", ".join(done) + " "
        if "set" not in q:
            return head + self.core(q, outer, q.get("order"), q.get("limit"), q.get("offset"), top)
        op = q["set"].replace("_", " ").upper()
        body = f"({self.query({k: v for k, v in q['left'].items()}, outer)}) {op} ({self.query(q['right'], outer)})"
        if not q.get("order") and q.get("limit") is None and not top:
            return head + body
        names = list(self.outputs(q, outer))
        cols = ", ".join(quote(n) for n in names)
        keys = ", ".join(f"{self.position(e, names)} {d.upper()}" for e, d in q.get("order", []))
        if self.lift:
            rn = f"ROW_NUMBER() OVER (PARTITION BY {INST} ORDER BY {keys or INST})"
            cut = f" WHERE {ORD} > {q.get('offset') or 0} AND {ORD} <= {(q.get('offset') or 0) + q['limit']}" if q.get("limit") is not None and q["limit"] >= 0 else ""
            inner = f"SELECT {INST}, {cols}, {rn} AS {ORD} FROM ({body})"
            return head + f"SELECT {INST}, {cols}{', ' + ORD if top else ''} FROM ({inner}){cut}"
        tail = (f" ORDER BY {keys}" if keys else "") + self.limit(q.get("limit"), q.get("offset"))
        return head + f"SELECT {cols} FROM ({body}){tail}"

    @staticmethod
    def position(e: dict, names: list[str]) -> str:
        if e["k"] == "lit" and isinstance(e["v"], int):
            return quote(names[e["v"] - 1])
        if e["k"] == "col" and e["c"] in names:
            return quote(e["c"])
        raise Unsupported("order of a set operation by an expression")

    @staticmethod
    def limit(n: int | None, offset: int | None) -> str:
        return (f" LIMIT {n}" if n is not None and n >= 0 else "") + (f" OFFSET {offset}" if offset else "")

    def core(self, q: dict, outer: list, order: list | None, limit: int | None, offset: int | None, top: bool) -> str:
        if not q["from"]:
            if self.lift:
                raise Unsupported("a query without tables is not lifted")
            return "SELECT " + ", ".join(f"{self.value(x['e'], outer)} AS {quote(self.output_name(x, k))}" for k, x in enumerate(q["select"]))
        own = self.scope(q, outer)
        scopes = [own, *outer]
        names = {x["as"].lower(): x["e"] for x in q["select"] if x["as"]}
        aggregated = bool(q.get("group")) or self.aggregates(q)
        groups = [self.group_key(e, q, scopes, names) for e in q.get("group", [])]
        lone = [n for x in q["select"] for n in walk(x["e"], False) if n.get("k") == "agg"]
        extreme = lone[0] if len(lone) == 1 and lone[0]["f"] in ("min", "max") and not lone[0]["distinct"] else None

        def item(e: dict) -> str:
            text = self.value(e, scopes, names)
            if not aggregated or text in groups or any(n.get("k") in ("agg", "win") for n in walk(e, False)) or not any(n.get("k") in ("col", "star") for n in walk(e, False)):
                return text
            if extreme:
                return f"{extreme['f']}_by({text}, {self.value(extreme['args'][0], scopes, names)})"
            return f"any_value({text})"

        select, outs = [], []
        for k, x in enumerate(q["select"]):
            if x["e"]["k"] == "star":
                for a, cols in own:
                    if x["e"]["t"] in (None, a):
                        for c in cols:
                            outs.append(c if c not in outs else f"{c}_{len(outs)}")
                            select.append(f"{item({'k': 'col', 't': a, 'c': c})} AS {quote(outs[-1])}")
            else:
                n = self.output_name(x, k)
                outs.append(n if n not in outs else f"{n}_{len(outs)}")
                select.append(f"{item(x['e'])} AS {quote(outs[-1])}")
        where = [self.expr(q["where"], scopes, names)] if q.get("where") else []
        from_ = self.from_text(q, own, scopes, outer)
        having = f" HAVING {self.expr(q['having'], scopes, names)}" if q.get("having") else ""
        keys = []
        for e, d in order or []:
            if e["k"] == "lit" and isinstance(e["v"], int) and 0 < e["v"] <= len(outs):
                keys.append((quote(outs[e["v"] - 1]), d))
            elif e["k"] == "col" and e["t"] is None and e["c"] in outs and (e["c"] in names or not self.find(e, scopes)):
                keys.append((quote(e["c"]), d))
            else:
                keys.append((item(e), d))
        body = from_ + (f" WHERE {' AND '.join(where)}" if where else "")
        inst = [self.inst(scopes)] if self.lift else []
        if aggregated and (groups or inst):
            body += " GROUP BY " + ", ".join([*inst, *groups])
        body += having
        if not self.lift:
            sort = f" ORDER BY {', '.join(f'{t} {d.upper()}' for t, d in keys)}" if keys else ""
            return f"SELECT {'DISTINCT ' if q['distinct'] else ''}{', '.join(select)} FROM {body}{sort}{self.limit(limit, offset)}"
        cols = ", ".join(quote(n) for n in outs)
        hidden = [f"k{i}" for i in range(len(keys))]
        extra = [f"{t} AS {h}" for (t, _), h in zip(keys, hidden) if not t.startswith("`") or "." in t]
        named = [h if not t.startswith("`") or "." in t else t for (t, _), h in zip(keys, hidden)]
        if q["distinct"] and extra:
            raise Unsupported("DISTINCT with other order keys is not lifted")
        text = f"SELECT {'DISTINCT ' if q['distinct'] else ''}{', '.join([inst[0] + ' AS ' + INST, *select, *extra])} FROM {body}"
        if aggregated and not groups and not having:
            # An instance without rows still answers, with 0 for a count and null for the rest.
            fill = [f"coalesce(g.{quote(n)}, 0) AS {quote(n)}" if x["e"].get("k") == "agg" and x["e"]["f"] in ("count", "total") else f"g.{quote(n)}" for n, x in zip(outs, q["select"])]
            text = f"SELECT i.{INST}, {', '.join(fill)} FROM {self.instances} i LEFT JOIN ({text}) g ON i.{INST} = g.{INST}"
            named, keys = [], []
        if keys or limit is not None or top:
            by = ", ".join(f"{n} {d.upper()}" for n, (_, d) in zip(named, keys))
            cut = f" WHERE {ORD} > {offset or 0}" + (f" AND {ORD} <= {(offset or 0) + limit}" if limit is not None and limit >= 0 else "")
            text = f"SELECT {INST}, {cols}{', ' + ORD if top else ''} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {INST} ORDER BY {by or INST}) AS {ORD} FROM ({text})){cut if limit is not None or offset else ''}"
        return text

    def group_key(self, e: dict, q: dict, scopes: list, names: dict) -> str:
        if e["k"] == "lit" and isinstance(e["v"], int) and 0 < e["v"] <= len(q["select"]):
            e = q["select"][e["v"] - 1]["e"]
        return self.value(e, scopes, names)

    def from_text(self, q: dict, own: list, scopes: list, outer: list) -> str:
        first = q["from"][0]["alias"]
        out = ""
        for k, item in enumerate(q["from"]):
            a = item["alias"]
            source = f"({self.query(item['sub'], outer)})" if "sub" in item else quote(item["table"]) if item["table"] in self.ctes else quote(self.views[item["table"]])
            piece = f"{source} {quote(a)}"
            if k == 0:
                out = piece
                continue
            on = []
            if item["join"] == "natural":
                before = {c for _, cols in own[:k] for c in cols}
                on = [f"{self.expr({'k': 'col', 't': None, 'c': c}, [own[:k]])} = {quote(a)}.{quote(c)}" for c in own[k][1] if c in before]
            if item.get("using"):
                on = [f"{self.expr({'k': 'col', 't': None, 'c': c.lower()}, [own[:k]])} = {quote(a)}.{quote(c.lower())}" for c in item["using"]]
            if item.get("on"):
                on.append(self.expr(item["on"], scopes))
            if self.lift:
                if item["join"] in ("right", "full"):
                    raise Unsupported("right and full joins are not lifted")
                on.append(f"{quote(first)}.{INST} = {quote(a)}.{INST}")
            word = {"inner": "JOIN", "natural": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "cross": "JOIN" if on else "CROSS JOIN"}[item["join"]]
            out += f" {word} {piece}" + (f" ON {' AND '.join(on)}" if on else "")
        return out


def render(q: dict, schema: dict[str, dict[str, str]], views: dict[str, str], lift: bool = False, instances: str = "") -> str:
    """Spark SQL of a parsed query. lift: rows carry the instance and, for the outermost query, their order."""
    return Renderer(schema, views, lift, instances).query(q, top=lift)
