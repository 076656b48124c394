"""Structure of a model's answer: blocks, bare queries, and how the text ends."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick

INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
BLANK = re.compile(rf"[\s{INVISIBLE}]+")
# Tags that enclose a query, and tags that enclose thinking.
CODE_TAGS = frozenset({"answer", "sql", "code", "final", "output", "query"})
THINK_TAGS = frozenset({"think", "thinking", "reasoning", "analysis"})
DELIMITER = re.compile(r"```[\w+-]*|</?(?:" + "|".join(sorted(CODE_TAGS | THINK_TAGS)) + r")>", re.I)
QUERY_START = re.compile(r"(?:(?:\A|\n|[:：>])\s*(?=select\b|with\s+(?:recursive\s+)?\w+\s+as\b)|[.!?。！？]\s*(?=(?-i:SELECT)\b))", re.I)
PROSE_LINE = re.compile(r"\n\s*(?=[A-ZÀ-Þ](?:[a-zà-ÿ'’]|\s|\Z)|[一-鿿])")
SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)）\]】*_]*\Z")
# Words of the query language that matter for where a query may end.
KEYWORDS = frozenset(
    "select distinct all from where and or not in like glob between is null exists join inner left right full outer cross natural on using as group order by having limit offset asc desc union intersect except with case when then else end cast over partition count sum avg min max abs round length lower upper substr".split()
)
# Words after which a query must go on.
DANGLING = frozenset(
    "select distinct all from where and or not in like glob between is exists join inner left right full outer cross natural on using as group order by having limit offset union intersect except with case when then else cast over partition".split()
)
SQL_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[^\]]*\]|\d+(?:\.\d+)?|\w+|<=|>=|<>|!=|==|[^\s\w]", re.S)
COMPARE = frozenset({"=", "==", "!=", "<>", "<", ">", "<=", ">="})


NOTHING_TO_SEE = INVISIBLE + "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# What a transfer that broke off leaves at the end: half an escape, or a broken character.
BROKEN_END = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]?)?|\ufffd+)\Z")


def strip_blank(text: str) -> str:
    """Without blanks and invisible characters at both ends."""
    return text.strip(NOTHING_TO_SEE)


def predicate_done(ts: list[str]) -> bool:
    """Whether the tokens of one condition make a whole condition."""
    if not ts:
        return False
    if ts[0] == "not":
        return predicate_done(ts[1:])
    if ts[0] == "()" and len(ts) == 1:
        return True
    if ts[0] == "exists":
        return ts[1:2] == ["()"]
    if "between" in ts:
        k = ts.index("between")
        return "and" in ts[k + 2 : -1]
    if "is" in ts:
        return ts[-1] == "null" and ts.index("is") > 0
    if "in" in ts:
        return ts.index("in") > 0 and ts[-1] == "()"
    for op in ("like", "glob", *COMPARE):
        if op in ts:
            return 0 < ts.index(op) < len(ts) - 1
    return False


def conditions_done(ts: list[str]) -> bool:
    """Whether AND and OR join whole conditions only."""
    part: list[str] = []
    between = False
    for t in [*ts, "and"]:
        if t == "between":
            between = True
        if t in ("and", "or") and not (t == "and" and between):
            if not predicate_done(part):
                return False
            part = []
            continue
        if t == "and":
            between = False
        part.append(t)
    return not part


CLAUSE_STARTS = frozenset("select from where group having order limit offset union intersect except join on".split())
JOIN_WORDS = frozenset("inner left right full outer cross natural".split())


def clauses_done(ts: list[str]) -> bool:
    """Whether a flat query (brackets as one token) is whole in each of its clauses."""
    parts: list[tuple[str, list[str]]] = []
    for t in ts:
        if t in CLAUSE_STARTS:
            parts.append((t, []))
        elif parts:
            if t not in JOIN_WORDS:
                parts[-1][1].append(t)
        elif t not in ("with", "recursive", "as", ",", "()") and t in KEYWORDS:
            return False
    names = [p for p, _ in parts]
    if "select" not in names or "from" not in names:
        return False
    for k, (name, body) in enumerate(parts):
        if name in ("union", "intersect", "except"):
            if body and body != ["all"] or k + 1 >= len(parts):
                return False
        elif not body:
            return False
        elif name in ("where", "having", "on"):
            if not conditions_done(body):
                return False
        elif name in ("group", "order"):
            if body[0] != "by" or len(body) < 2 or body[-1] == ",":
                return False
        elif name in ("limit", "offset"):
            if not re.fullmatch(r"\d+", body[0]):
                return False
        elif name == "join":
            if k + 1 >= len(parts) or parts[k + 1][0] not in ("on", "join", "where", "group", "order", "limit"):
                return False
        elif name in ("from", "select"):
            if body[-1] == "," or body[0] == ",":
                return False
            if name == "from" and len([t for t in body if t not in (",", "as", ".")]) > 2 + body.count(",") * 2 + body.count("."):
                return False  # words after the table that no clause takes
    return True


def query_state(sql: str) -> str:
    """'cut', 'whole' (closed by a semicolon) or 'open' (may end here, may go on)."""
    s = sql.strip()
    closed = s.endswith(";")
    s = s.rstrip("; \t\r\n")
    ts = [t.lower() for t in SQL_TOKEN.findall(s)]
    if any(t in "'\"`[" for t in ts) or not ts:
        return "cut"
    stack: list[list[str]] = [[]]
    for t in ts:
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                return "cut"
            inner = stack.pop()
            if inner[:1] == ["select"] and not clauses_done(inner):
                return "cut"
            stack[-1].append("()")
        else:
            stack[-1].append(t)
    flat = stack[0]
    if len(stack) > 1 or flat[-1] in DANGLING or flat[-1] in COMPARE or flat[-1] in (",", ".", "+", "-", "/", "!", "||") or not clauses_done(flat):
        return "cut"
    return "whole" if closed else "open"


@dataclass
class Answer:
    """What an answer is made of. ends: empty, open, ellipsis, block, query, sentence or fragment."""

    text: str
    prose: list[str] = field(default_factory=list)
    code: list[str] = field(default_factory=list)
    bare: list[str] = field(default_factory=list)
    bare_ends: list[int] = field(default_factory=list)  # where in text each bare query ends
    ends: str = "empty"

    @property
    def has_query(self) -> bool:
        return any(re.search(r"\b(?:select|with)\b", re.sub(r"--[^\n]*", "", c), re.I) for c in self.code) or bool(self.bare)


def split_bare(prose: str) -> tuple[str, str | None, str]:
    """Prose before a bare query, the query (None: there is none), prose after it."""
    m = QUERY_START.search(prose)
    if not m:
        return prose, None, ""
    before, rest = prose[: m.end()], prose[m.end() :]
    at = 0
    while k := PROSE_LINE.search(rest, at):
        line = rest[k.end() :].split("\n", 1)[0]
        words = re.findall(r"[^\W_]+", line.lower())
        strange = sum(w not in KEYWORDS for w in words)
        if words[:1] and words[0] not in KEYWORDS or strange > 1 and not re.search(r"[=<>()_'\"`\[\]*,;]", line):
            return before, rest[: k.start()], rest[k.end() :]
        at = k.end()
    return before, rest, ""


def read_answer(raw: str | None) -> Answer:
    """Parse an answer with a stack of delimiters."""
    text = strip_blank(raw or "")
    a = Answer(text)
    if not text:
        return a
    stack: list[str] = []
    at = 0
    last = "prose"
    pieces: list[tuple[str, str, int]] = []

    def put(kind: str, piece: str) -> None:
        pieces.append((kind, piece, at))

    for m in DELIMITER.finditer(text):
        t = m.group().lower()
        inside = stack[-1] if stack else ""
        kind = "code" if inside == "```" or inside in CODE_TAGS else "prose"
        put(kind, text[at : m.start()])
        at = m.end()
        if t.startswith("```"):
            if "```" in stack:
                while stack.pop() != "```":
                    pass
            else:
                stack.append("```")
        elif t.startswith("</"):
            name = t[2:-1]
            if name in stack:
                while stack.pop() != name:
                    pass
        elif inside != "```":
            stack.append(t[1:-1])
        last = kind
    inside = stack[-1] if stack else ""
    put("code" if inside == "```" or inside in CODE_TAGS else "prose", text[at:])
    for kind, piece, start in pieces:
        if not strip_blank(piece):
            continue
        if kind == "code":
            a.code.append(piece.strip())
            tail = ("code", piece)
        else:
            before, query, after = split_bare(piece)
            if strip_blank(before):
                a.prose.append(before.strip())
            if query is not None:
                a.bare.append(query.strip())
                a.bare_ends.append(start + len(before) + len(query))
            if strip_blank(after):
                a.prose.append(after.strip())
            tail = ("bare", query) if query is not None and not strip_blank(after) else ("prose", after if query is not None else before)
    if stack or re.search(r"(?:</?[a-z]{0,9}|(?<!`)`` ?)\Z", text, re.I) and not re.search(r"\w\s*<\Z", text):
        a.ends = "open"
    elif text.endswith(("...", "…")) or BROKEN_END.search(text):
        a.ends = "ellipsis"
    elif not strip_blank(text[at:]) if at else False:
        a.ends = "block"
    elif not (a.prose or a.bare or a.code):
        a.ends = "empty"
    elif tail[0] == "bare":
        a.ends = "query"
    else:
        a.ends = "sentence" if SENTENCE_END.search(strip_blank(tail[1])) else "fragment"
    return a


# How one says that one does not do a thing, and the things an answerer is asked to do; every pair of them declines.
NOT_DONE = "can't|cannot|can not|could not|couldn't|won't|will not|would not|wouldn't|shouldn't|should not|must not|may not|unable to|not able to|not feel able to|not allowed to|not permitted to|not permit me to|not let me|not willing to|rather not|refuse to|decline to|have to refuse to|not going to|no way for me to|not in a position to|not comfortable to|impossible to|impossible for me to|not possible to|not possible for me to".split("|")
TASKS = "help|assist|do|answer|comply|write|provide|give|produce|generate|create|supply|share|disclose|reveal|guess|process|handle|fulfil|complete|continue|respond|offer|build|work on|look at|touch|query|turn|translate".split("|")
# What is not made, and in which words; every pair of them declines.
NOTHING = "no query|no sql|no statement|no code|no answer|no select".split("|")
IS_MADE = "is provided|is given|is offered|is written|can be|could be|will be|from me|:".split("|")
# Whole phrases by which an answer declines.
PHRASES = """must decline|have to decline|has to be declined|have to refuse|must refuse|have to pass on|pass on this|leave this one|leave it open|leave unanswered|left unanswered|cannot be answered|can't be answered|could not be answered
cannot be done|can't be done|not possible.|off limits|falls outside|outside of what i|outside my|beyond what i|beyond my|against my|against the rules|do not permit|does not permit|do not have access|don't have access|have no access
not sufficient|insufficient information|ask somebody else|need somebody else|not feel able|no way for me|not in a position|not allowed to|i refuse|i decline|i must refuse
无法回答|无法处理|无法提供|无法完成|无法生成|不能处理|不能回答|不能提供|不能生成|恕难从命|恕我|恕不|不足以|不提供|放弃作答|拒绝|不便|超出了我|不会为|不予|没有权限""".replace("\n", "|").split("|")


def refusals() -> list[str]:
    """All phrases that decline, in lower case with straight quotes."""
    return [f"{a} {b}" for a in NOT_DONE for b in TASKS] + [f"{a}{'' if b == ':' else ' '}{b}" for a in NOTHING for b in IS_MADE] + PHRASES


@lru_cache(1)
def refusal_automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for p in refusals():
        machine.add_word(p, p)
    machine.make_automaton()
    return machine


def declines(text: str) -> bool:
    """Whether the text has a phrase that declines."""
    low = BLANK.sub(" ", text.lower().replace("’", "'"))
    return next(refusal_automaton().iter(low), None) is not None


# What stands for no value, in lower case.
PLACEHOLDERS = frozenset(["", "n/a", "na", "null", "none", "nan", "nil", "-", "--", "---", "—", "...", "…", "?", ".", '""', "''", "``", "{}", "[]", "()", "undefined", "tbd", "todo", "<null>", "<none>", "#n/a", "无", "空"])


def holds_nothing(text: str | None) -> bool:
    """Only blanks, invisible characters, empty markup or a placeholder."""
    bare = strip_blank(DELIMITER.sub(" ", text or ""))
    return bare.lower() in PLACEHOLDERS


LABEL = re.compile(r"(?:\b(?:question|answer|query|prompt|response|frage|antwort|q|a)|问题|回答|问|答)\s*[:：]", re.I)


def letters(text: str) -> str:
    """Letters and digits in lower case."""
    return re.sub(r"[\W_]+", "", text.lower())


class SuffixAutomaton:
    """Suffix automaton of a text; coverage() walks another text through it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.next: list[dict[str, int]] = [{}]
        # first: where in the text the strings of a state end for the first time.
        self.link, self.length, self.first, last = [-1], [0], [0], 0
        for k, c in enumerate(text, 1):
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.first.append(k)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    self.first.append(self.first[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def walk(self, text: str) -> Iterator[tuple[int, int, int]]:
        """For each character of text: its place, the state reached and the length of the longest common substring that ends there."""
        state = size = 0
        for i, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            yield i, state, size

    def coverage(self, text: str, least: int) -> tuple[float, float]:
        """Shares of text, and of the automaton's own text, inside common substrings of at least `least` characters.

        A substring that its own text has several times is marked at its first place there.
        """
        covered = end = 0
        spans: list[tuple[int, int]] = []
        for i, state, size in self.walk(text):
            if size >= least:
                covered += i - max(end, i - size)
                end = i
                spans.append((self.first[state] - size, self.first[state]))
        given = at = 0
        for a, b in sorted(spans):
            if b > at:
                given += b - max(at, a)
                at = b
        return (covered / len(text) if text else 0.0), (given / len(self.text) if self.text else 0.0)


@lru_cache(4096)
def automaton(text: str) -> SuffixAutomaton:
    """The suffix automaton of a prompt; answers to one prompt share it."""
    return SuffixAutomaton(text)


# Shares from which an answer counts as given back, and the shortest substring that counts.
COPIED, RETURNED, LEAST_RUN = 0.9, 0.95, 8


def is_copy(question: str | None, a: Answer) -> bool:
    """The answer gives back the question and nothing else: nearly all of the answer is copied from it, and nearly all of it is in the answer, however often."""
    q = letters(question or "")
    if not q or a.has_query:
        return False
    text = letters(LABEL.sub(" ", DELIMITER.sub(" ", a.text)))
    copied, returned = automaton(q).coverage(text, min(len(q), LEAST_RUN))
    return copied >= COPIED and returned >= RETURNED


def is_cut(question: str | None, sql: str | None, a: Answer) -> bool:
    """Whether an answer lacks its end, by its structure alone."""
    if holds_nothing(a.text):
        return False
    if a.ends == "query":
        state = query_state(a.bare[-1])
        if state == "open":
            mine, other = (BLANK.sub(" ", x).strip().rstrip("; ") for x in (a.bare[-1], sql or ""))
            return len(other) > len(mine) and other.startswith(mine)
        return state == "cut"
    if a.ends in ("open", "ellipsis"):
        return True
    if a.has_query:
        return a.ends == "fragment"
    return not (declines(a.text) or is_copy(question, a))


# Frequent function words of some languages.
STOPWORDS = {
    "en": "the of and to in is are was we with for that a by on as not but from which it this each no so only rows every one who into be has have what how many where when given out an or if there their them than then they these those some because such".split(),
    "de": "dass gegen wurde wurden wir haben hat noch ob bisher soll dürfen kann können durch über sein mehr vorher waren der die das und nicht ist sind mit für von den im des eine ein einer auf wird werden nur zu sich bei dem es weil oder aus wie nach pro so alle denn keine zum zur als".split(),
    "fr": "le la les de des et est sont une un dans pour avec que qui sur par ne pas se ce cette du au aux il elle car plus sans seules lignes chaque on ainsi même aucune dont où".split(),
    "es": "el la los las de del y es son una un en para con que por no se su al lo como más sin cada así solo se filas porque ya está esta este ninguna misma".split(),
    "it": "il lo la i gli le di del della e è sono una un in per con che non si su da al come più senza ogni solo così righe perché nella nel questa stessa nessuna viene dello".split(),
    "pt": "o a os as de do da e é são uma um em para com que não se por no na ao como mais sem cada assim só linhas porque está esta mesma nenhuma pelo pela dos das linha".split(),
    "nl": "de het een en van in is zijn met voor dat op niet die te aan er bij naar om als ook dan maar door over uit wordt alleen rijen elke".split(),
}
VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words):
        VOTES.setdefault(_w, []).append(_lang)
# Short lead words that say nothing about the language of an answer.
LEADS = frozenset("well note ok okay right sure so yes hmm now first answer query sql select 嗯 好 那么".split())
PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def language(text: str) -> tuple[str, int]:
    """The language with most stopword votes and the votes; '' where nothing tells. Chinese, Japanese, Korean and Cyrillic go by script."""
    plain = re.sub(r"\b\w*_\w*\b|(?<!\w)'[^'\n]*'(?!\w)|\"[^\"\n]*\"|`[^`\n]*`", " ", text)
    votes: dict[str, int] = {}
    han = len(re.findall(r"[一-鿿]", plain))
    for name, span in (("ja", "[\u3040-\u30ff]"), ("ko", "[\uac00-\ud7af]"), ("ru", "[\u0400-\u04ff]")):
        if n := len(re.findall(span, plain)):
            votes[name] = n
    if han:
        votes["ja" if votes.get("ja", 0) > han / 4 else "zh"] = han // 2 + votes.get("ja", 0) * (votes.get("ja", 0) > han / 4)
    for w in PLAIN_WORD.findall(plain.lower()):
        if w in VOTES and w not in LEADS:
            for lang in VOTES[w]:
                votes[lang] = votes.get(lang, 0) + 1
    if not votes:
        return "", 0
    best = max(sorted(votes), key=votes.get)
    return best, votes[best]


@lru_cache(16_384)
def asked_in(question: str) -> str:
    """The language of a question; many answers share one."""
    return language(question)[0]


def strays(question: str | None, a: Answer) -> bool:
    """Whether the explaining text is in another language than the question."""
    prose = " \n".join(p for p in a.prose)
    if question:
        prose = prose.replace(question.strip(), " ")
    asked = asked_in(question or "")
    if not asked or not prose:
        return False
    told, n = language(prose)
    return bool(told and asked != told and n >= 4)
