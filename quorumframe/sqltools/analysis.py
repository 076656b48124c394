"""Structure of queries: text of expressions, hardness, features, exact match and atomic operations."""

from __future__ import annotations

import functools
from collections import Counter

from . import parser
from .parser import ParseError, cores, sides, walk, walk_queries

MASK = "?"


@functools.lru_cache(50_000)
def parse(sql: str, legacy: bool = False) -> dict:
    """The tree of a query, parsed once a worker for equal texts; nothing here changes a tree."""
    return parser.parse(sql, legacy)


class Scope:
    """Tables of one select: alias -> table name, in order; canonical names T1, T2, … for atomic operations."""

    def __init__(self, q: dict, numbered: bool = False) -> None:
        self.names: dict[str, str] = {}
        for k, item in enumerate(q.get("from", []), 1):
            table = item.get("table") or "(query)"
            shown = f"T{k}" if numbered else table
            self.names.setdefault(item.get("alias") or table, shown)
            self.names.setdefault(table, shown)
        shown = list(dict.fromkeys(self.names.values()))
        self.only = shown[0] if len(shown) == 1 else None

    def table(self, t: str | None) -> str:
        return self.names.get(t, t or "") if t else self.only or ""


def text(e, scope: Scope, mask: bool = False, links: dict[str, str] | None = None) -> str:
    """Canonical text of an expression: aliases resolved, case folded; mask hides literals; links maps columns to one of their foreign-key set."""
    r = lambda x: text(x, scope, mask, links)
    if isinstance(e, tuple):
        return f"{r(e[0])} {e[1]}"
    k = e.get("k")
    if k is None:
        return "(" + query_text(e, mask, links) + ")"
    if k == "col":
        name = f"{scope.table(e['t'])}.{e['c']}".lstrip(".")
        return (links or {}).get(name, name)
    if k == "star":
        return f"{scope.table(e['t'])}.*" if e["t"] else "*"
    if k == "lit":
        return MASK if mask else repr(e["v"])
    if k in ("agg", "fn"):
        only = f" filter (where {r(e['filter'])})" if e.get("filter") else ""
        return f"{e['f']}({'distinct ' if e['distinct'] else ''}{', '.join(map(r, e['args']))}){only}"
    if k in ("op", "cmp"):
        a, b = r(e["l"]), r(e["r"])
        if e["op"] == "=" and b < a:
            a, b = b, a
        return f"{a} {e['op']} {b}"
    if k == "neg":
        return MASK if mask and e["x"].get("k") == "lit" else "-" + r(e["x"])
    if k == "not":
        return "not " + r(e["x"])
    if k == "cast":
        return f"cast({r(e['x'])} as {e['as']})"
    n = "not " if e.get("neg") else ""
    if k == "between":
        return f"{r(e['x'])} {n}between {r(e['lo'])} and {r(e['hi'])}"
    if k == "in":
        return f"{r(e['x'])} {n}in " + ("(" + query_text(e["q"], mask, links) + ")" if "q" in e else "(" + (MASK if mask else ", ".join(sorted(map(r, e["vs"])))) + ")")
    if k == "like":
        return f"{r(e['x'])} {n}{e['op']} {r(e['p'])}"
    if k == "null":
        return f"{r(e['x'])} is {n}null"
    if k in ("exists", "sub"):
        return ("exists " if k == "exists" else "") + "(" + query_text(e["q"], mask, links) + ")"
    if k in ("and", "or"):
        return "(" + f" {k} ".join(sorted(map(r, e["xs"]))) + ")"
    if k == "case":
        return "case " + " ".join(f"when {r(c)} then {r(v)}" for c, v in e["whens"]) + (f" else {r(e['else'])}" if e["else"] else "") + " end"
    if k == "win":
        return f"{r(e['x'])} over (partition by {', '.join(map(r, e['partition']))} order by {', '.join(map(r, e['order']))} {e['frame']})"
    raise ParseError(f"node {k}")


def conjuncts(e: dict | None) -> list[dict]:
    """Conditions joined by AND, flat."""
    if e is None:
        return []
    return [x for c in e["xs"] for x in conjuncts(c)] if e.get("k") == "and" else [e]


def conditions(e: dict | None) -> list[dict]:
    """Single conditions under AND, OR and NOT."""
    if e is None:
        return []
    if e.get("k") in ("and", "or"):
        return [x for c in e["xs"] for x in conditions(c)]
    return conditions(e["x"]) if e.get("k") == "not" else [e]


def query_text(q: dict, mask: bool = False, links: dict[str, str] | None = None) -> str:
    """Canonical text of a query: its parts with select items and conditions sorted."""
    if "set" in q:
        return f"{query_text(q['left'], mask, links)} {q['set']} {query_text(q['right'], mask, links)}"
    p = parts(q, mask, links)
    return "; ".join(f"{k}: {', '.join(sorted(p[k].elements())) if k != 'order' else ', '.join(p[k])}" for k in ("select", "from", "where", "group", "having", "order") if p[k])


def parts(q: dict, mask: bool = True, links: dict[str, str] | None = None) -> dict:
    """Comparable parts of one select as bags of texts (order as a list)."""
    s = Scope(q)
    r = lambda e: text(e, s, mask, links)
    return {
        "select": Counter(r(x["e"]) for x in q["select"]),
        "distinct": Counter(["distinct"] * q["distinct"]),
        "from": Counter(x.get("table") or query_text(x["sub"], mask, links) for x in q["from"]),
        "where": Counter(r(c) for c in conditions(q.get("where"))),
        "where_shape": Counter(n["k"] for n in walk(q.get("where") or {}, False) if n.get("k") in ("and", "or")),
        "group": Counter(r(e) for e in q.get("group", [])),
        "having": Counter(r(c) for c in conditions(q.get("having"))),
        "order": [r(e) for e in q.get("order", [])] + (["limit"] if q.get("limit") is not None else []),
    }


def keywords(q: dict) -> set[str]:
    """Clause and operator words that a query uses."""
    first, rest = sides(q)
    out = {op.split("_")[0] for op, _ in rest}
    for name in ("where", "group", "having"):
        if first.get(name):
            out.add(name)
    top = {**first, **{k: q[k] for k in ("order", "limit") if k in q}}
    if top.get("order"):
        out |= {"order", *(d for _, d in top["order"])}
    if top.get("limit") is not None:
        out.add("limit")
    for n in walk([first.get("where") or {}, first.get("having") or {}, *[x.get("on") or {} for x in first["from"]]], False):
        if n.get("k") in ("or", "in", "like"):
            out.add(n["k"])
        if n.get("k") in ("not", "exists") or n.get("neg"):
            out.add("not" if n.get("k") != "exists" else "exists")
    return out


def nested_count(q: dict) -> int:
    """Queries inside a query: set operands after the first, and subqueries of its conditions and tables."""
    return sum(1 for _ in walk_queries(q)) - 1 - sum("set" in x for x in walk_queries(q))


def hardness_counts(q: dict) -> tuple[int, int, int]:
    """Clause components, nested queries, and other complications of a query."""
    first, _ = sides(q)
    order, limit = q.get("order") or first.get("order"), q.get("limit", first.get("limit"))
    logic = [first.get("where") or {}, first.get("having") or {}, *[x.get("on") or {} for x in first["from"]]]
    flat = list(walk(logic, False))
    clauses = bool(first.get("where")) + bool(first.get("group")) + bool(order) + (limit is not None) + max(0, len(first["from"]) - 1)
    clauses += sum(len(n["xs"]) - 1 for n in flat if n.get("k") == "or") + sum(n.get("k") == "like" for n in flat)
    aggs = sum(n.get("k") == "agg" for n in walk([first["select"], first.get("where") or {}, first.get("group") or [], order or [], first.get("having") or {}], False))
    others = (aggs > 1) + (len(first["select"]) > 1) + (len(conditions(first.get("where"))) > 1) + (len(first.get("group", [])) > 1)
    return clauses, nested_count(q), others


def hardness(sql: str, legacy: bool = False) -> str:
    """easy, medium, hard or extra; 'unparsed' for a text that is no query."""
    try:
        c, n, o = hardness_counts(parse(sql, legacy))
    except ParseError:
        return "unparsed"
    # The bounds of the classes.
    if n == 0:
        if c <= 1 and o == 0:
            return "easy"
        if o <= 2 and c <= 1 or c <= 2 and o < 2:
            return "medium"
        if o > 2 and c <= 2 or 2 < c <= 3 and o <= 2:
            return "hard"
    return "hard" if c <= 1 and o == 0 and n <= 1 else "extra"


def features(sql: str) -> dict[str, int]:
    """Counts that describe a query; all -1 for a text that is no query."""
    names = ("n_tables", "n_joins", "n_nested", "n_conds", "n_aggs", "has_group", "has_order", "has_compare", "has_date", "component1")
    try:
        q = parse(sql)
    except ParseError:
        return dict.fromkeys(names, -1)
    cs = cores(q)
    nodes = list(walk(q))
    low = sql.lower()
    values = (
        len({x["table"] for s in walk_queries(q) for x in s.get("from", []) if "table" in x}), sum(max(0, len(s["from"]) - 1) for s in cs), nested_count(q),
        sum(len(conditions(s.get("where"))) for s in cs), sum(n.get("k") == "agg" for n in nodes), int(any(s.get("group") for s in cs)),
        int(any(s.get("order") for s in walk_queries(q))), int(any(n.get("k") == "cmp" and n["op"] in "<=>=" and n["op"] != "=" for n in nodes)),
        int(any(w in low for w in ("julianday", "strftime", "date("))), hardness_counts(q)[0],
    )
    return dict(zip(names, values))


def join_difficulty(n_joins: int) -> str:
    """easy without a join, medium with one or two, hard with more."""
    return "easy" if n_joins == 0 else "medium" if n_joins <= 2 else "hard"


def foreign_key_links(keys: list[tuple[str, str]]) -> dict[str, str]:
    """Columns of each foreign-key set -> its smallest column."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in keys:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for pair in keys for x in pair}


PARTS = ("select", "select_no_agg", "where", "where_no_op", "group", "having", "order", "logic", "set", "keywords")


def compare(pred: dict, gold: dict, links: dict[str, str] | None = None) -> dict[str, tuple[int, int, int]]:
    """(matched, in the prediction, in the gold) of each part; values are masked, linked columns are one."""
    p, g = parts(sides(pred)[0], True, links), parts(sides(gold)[0], True, links)

    def score(a, b) -> tuple[int, int, int]:
        a, b = Counter(a), Counter(b)
        return sum((a & b).values()), sum(a.values()), sum(b.values())

    bare = lambda bag: Counter({x: n for x, n in ((t.split("(", 1)[-1].rstrip(")"), n) for t, n in bag.items())})
    column = lambda bag: Counter(t.split(" ", 1)[0] for t in bag.elements())
    tail = lambda q, x: ([text(e, Scope(sides(q)[0]), True, links) for e in q.get("order", [])] or x["order"])
    po, go = tail(pred, p), tail(gold, g)
    ps, gs = sides(pred)[1], sides(gold)[1]
    return {
        "select": score(p["select"], g["select"]),
        "select_no_agg": score(bare(p["select"]), bare(g["select"])),
        "where": score(p["where"], g["where"]),
        "where_no_op": score(column(p["where"]), column(g["where"])),
        "group": score(p["group"], g["group"]),
        "having": score(p["having"], g["having"]),
        "order": score([str(po)] if po else [], [str(go)] if go else []),
        "logic": score(p["where_shape"], g["where_shape"]),
        "set": score([f"{op} {query_text(x, True, links)}" for op, x in ps], [f"{op} {query_text(x, True, links)}" for op, x in gs]),
        "keywords": score(keywords(pred), keywords(gold)),
    }


def exact_match(pred_sql: str, gold_sql: str, links: dict[str, str] | None = None) -> bool | None:
    """All parts equal, with the same tables; None if the gold text is no query, False if the prediction is none."""
    try:
        gold = parse(gold_sql)
    except ParseError:
        return None
    try:
        pred = parse(pred_sql)
    except ParseError:
        return False
    same = parts(sides(pred)[0], True, links)["from"] == parts(sides(gold)[0], True, links)["from"] and sides(pred)[0]["distinct"] == sides(gold)[0]["distinct"]
    return same and all(m == p == g for m, p, g in compare(pred, gold, links).values())


def atomic_ops(sql: str) -> list[str] | None:
    """Operations that make up a query, in a fixed order of clauses; None for a text that is no query."""
    try:
        return query_ops(parse(sql))
    except ParseError:
        return None


def query_ops(q: dict) -> list[str]:
    out = []
    for name, body in q.get("ctes", {}).items():
        out += [f"WITH_CTE({name})", "ENTER_SUBQUERY", *query_ops(body), "EXIT_SUBQUERY"]
    if "set" in q:
        out += query_ops(q["left"]) + [q["set"].upper()] + query_ops(q["right"])
    else:
        s = Scope(q, numbered=True)
        r = lambda e: text(e, s)
        for k, item in enumerate(q["from"], 1):
            if "sub" in item:
                out += ["ENTER_SUBQUERY", *query_ops(item["sub"]), "EXIT_SUBQUERY"]
            name = item.get("table", "(query)")
            out.append(f"FROM({name})" if item["join"] is None else f"JOIN({name},{item['join']})")
            out.append(f"ALIAS({name},T{k})")
            for c in conjuncts(item.get("on")):
                out.append(("ON_EQ" if c.get("k") == "cmp" and c["op"] == "=" else "ON_PRED") + f"({r(c)})")
            out += [f"ON_EQ({c})" for c in item.get("using", [])]
        out += [f"WHERE_PRED({t})" for t in sorted(r(c) for c in conjuncts(q.get("where")))]
        out += [f"GROUP_BY({r(e)})" for e in q.get("group", [])]
        out += [f"HAVING_PRED({t})" for t in sorted(r(c) for c in conjuncts(q.get("having")))]
        for x in q["select"]:
            k = x["e"].get("k")
            out.append({"agg": "SELECT_AGG", "col": "SELECT_COL", "star": "SELECT_COL", "win": "SELECT_WIN"}.get(k, "SELECT_EXPR") + f"({r(x['e'])})")
            if k == "win":
                w = x["e"]
                out.append(f"WINDOW(partition_by={','.join(map(r, w['partition']))},order_by={','.join(map(r, w['order']))},frame={w['frame']})")
        if q["distinct"]:
            out.append("DISTINCT")
        for n in walk([q.get("where") or {}, q.get("having") or {}, [x["e"] for x in q["select"]], q.get("order") or []], False):
            if "q" in n:
                out += ["ENTER_SUBQUERY", *query_ops(n["q"]), "EXIT_SUBQUERY"]
    s = Scope(sides(q)[0], numbered=True)
    out += [f"ORDER_BY({text(e, s)})" for e in q.get("order", [])]
    if q.get("limit") is not None:
        out.append(f"LIMIT({q['limit']})")
    return out


def atomic_jaccard(a: str, b: str) -> float:
    """Jaccard of the operation sets; two texts without operations are equal; a text that is no query has none."""
    x, y = set(atomic_ops(a) or []), set(atomic_ops(b) or [])
    return 1.0 if not x and not y else len(x & y) / len(x | y)


LEVELS = ("easy", "medium", "hard", "extra", "all")
