"""Per-document text quality: counts, divergence from language prose, structural kind.

A line is described by three distributions: its characters by class, its words by
class (function words among them), and how its words lie in pieces between
separators. Jensen-Shannon divergence compares them with profiles of sentences in
several languages, of entries and of strange matter; the nearest profile gives the
line its form. Rows of tables and dumped matter are found by counts before that. A
document's kind is the nearest kind by the mass of its line forms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.session import spread

from .answers import STOPWORDS, strip_blank

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
HAN = re.compile(r"[㐀-鿿぀-ヿ가-힯]")
# Further function words of English and German.
MORE_FUNCTION = "about after again all also although am an any because been before being below between both but can cannot could did do does done down during each either else even ever every few had he her here hers him his however i if into itself just least less many may me might more most must my nearly neither never next nor now off once only other our out over own rather same shall she should since some still such than though through thus too under until up upon us very was were what when where whether which while who whom whose why will within without would yet you your aber alle als also am an andere auch beim bei bis da dabei dafür damit dann daran darauf daraus darin davon dazu dein deren deshalb dessen diese dieser dieses doch dort ein einem einen er etwas euch für gegen hier hinter ich ihm ihn ihnen ihr ihre immer in indem ins ja jede jeder jedes jetzt kann kein können man mein mich mir muss müssen neben nein nie niemand noch nun obwohl ohne sehr seit selbst sich sie sind sobald sollte sondern sonst statt trotz um und uns unser unter viel vom vor während wann warum was weder wegen welche wenn wer werden wieder wird wo würde zwar zwischen über".split()
FUNCTION = {w for lang in ("en", "de", "fr", "es", "it", "pt", "nl") for w in STOPWORDS[lang] if len(w) > 1 or w in "aoyeàé"} | set(MORE_FUNCTION)
CELL = re.compile(r"\S+(?: \S+)*")
NO_ALNUM = re.compile(r"[\W_]+")
STRANGE = re.compile(r"[^\W\d_a-zA-ZäöüßÄÖÜéèêàâîïôûçñíóúáãõìòùÉÈÀ㐀-鿿぀-ヿ가-힯]")
BULLET = re.compile(r"\s*(?:[-*+•·–▪◦‣]|\[[ xX]?\]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|#{1,6})\s+")
# Shapes of dumped matter. At the start of a line: hex dumps, log stamps, number vectors.
DUMP_START = re.compile(r"[0-9a-f]{6,8}:?\s+(?:[0-9a-f]{2,4}\s+){4}|\W?\d{1,4}[-:/]\d{2}[-:/]\d{2}\S*\s+(?:\S+\s+)?\w*(?:ERR|WARN|INFO|DEBUG|TRACE|FATAL)|[\[\s]*-?\d+\.\d+(?:,\s?-?\d+\.\d+){3}", re.I)
# Anywhere in it, each with a character that it cannot do without: markup, style rules, progress bars; and encoded runs.
DUMP_INSIDE = (("<", re.compile(r"</?\w+[^>]*>.*</?\w+", re.I)), ("{", re.compile(r"\{[\w-]+:[^}]*\}")), ("%", re.compile(r"\d%\s?\|")))
ENCODED = re.compile(r"[A-Za-z0-9+/=]{40}")


def dumped(line: str) -> bool:
    """Whether a line has the shape of dumped matter."""
    return bool(DUMP_START.match(line) or len(line) >= 40 and ENCODED.search(line) or any(c in line and p.search(line) for c, p in DUMP_INSIDE))


CHARS = ("lower", "upper", "digit", "space", "stop", "pause", "cut", "mark", "han", "other")
WORDS = ("function", "short", "long", "name", "number", "han_function", "han")
PIECES = ("three", "six", "twelve", "more")
HAN_FUNCTION = frozenset("的了在是和不有我们这也与就都而但只把被将对从由为上没未其该")
CUT = re.compile(r"[;；•|\t,，、:：=]+")
TOKEN = re.compile(r"[㐀-鿿぀-ヿ가-힯]|[^\W\d_㐀-鿿぀-ヿ가-힯]+(?:['’][^\W\d_]+)*(?![\w])|[^\W㐀-鿿぀-ヿ가-힯]+")
ASCII_TOKEN = re.compile(r"\w+(?:'[a-zA-Z]+)?", re.ASCII)
# A few lines of each form, from which its profiles are measured, one profile a language or manner.
SAMPLES = {
    ("sentence", "en"): "The second run was not as good as we had hoped, so the team went back to the first plan and checked each step again.\nWhen a rule fails it is often because the words of the question were read in another way than they were meant.\nNobody knows yet whether this will hold for a longer test, but the numbers of the last week point in that direction.\nPeople in the valley keep their boats on the shore until the ice has gone.",
    ("sentence", "en with names"): "Every clerk of Vanora keeps 214 notes in the old archive of Belmir, unless Tesso marked them as lost.\nCompare the copper index of Ralo with the one dated 3371 and return the lower value.\nThe guild of Sorin pays 88 coins for each lamp that Mirella repaired in Tavo, and Dorin keeps zeta lists of them.",
    ("sentence", "de"): "Der zweite Lauf war nicht so gut wie erhofft, deshalb hat die Gruppe den ersten Plan wieder aufgenommen und jeden Schritt noch einmal geprüft.\nOb das auch für einen längeren Versuch gilt, ist noch offen, aber die Zahlen der letzten Woche zeigen in diese Richtung.\nDie meisten Fehler stammen aus einer Tabelle, die bisher niemand gelesen hat.",
    ("sentence", "fr"): "La deuxième série n'était pas aussi bonne que nous l'avions espéré, et le groupe est donc revenu au premier plan pour vérifier chaque étape.\nPersonne ne sait encore si cela vaut pour un essai plus long, mais les chiffres de la semaine vont dans ce sens.",
    ("sentence", "es"): "La segunda prueba no fue tan buena como esperábamos, así que el grupo volvió al primer plan y revisó cada paso otra vez.\nNadie sabe todavía si esto vale para una prueba más larga, pero los números de la última semana van en esa dirección.",
    ("sentence", "zh"): "第二次运行的结果没有我们希望的那么好，所以小组回到了第一个计划，并且重新检查了每一个步骤。\n这些数字还不能说明它在更长的测试中也成立，但是上一周的结果指向同一个方向。\n大部分错误来自一张没有人读过的表，原因是它的名字在文档中写错了。",
    ("sentence", "zh with names"): "检索器对 city_name 的判断没有变化，原因是 price 的取值在两张表中不同。\n第 12 步之后的奖励不再上升，因此我们保留了 old_plan 的结果。\n把 visits 的说明改短以后，效果反而更好。\n下一步计划在 lake_town 上再测一次。\nprice 的提示改善了 Lumi 的取值，原因是缓存在第 80 分钟以后才命中。\nLumi 建议在文档中保留 old_price 这一列。",
    ("sentence", "zh short"): "简短的句子也是句子。我们先看第一张表，再看第二张表。\n目前没有发现问题，大家可以继续使用。city 的写法有两种，先按第一种处理。\nLumi 写了 30 行，Soren 改了 4 行，其余保持原样。\n明天在 lake_town 上去掉旧的说明，再跑一次 price 的测试。\n多数问题来自 lake_town 与主表的关系。大家把 old_price 的说明写得太长，读起来不方便。",
    ("entry", "words"): "missing price in orders\nvotes of the second group\nrename old_name\ncheck city_name spelling\nstep 14\nnext steps\nopen the gate\nResults of table_3\nask Lumi about price\nlake_town.price\nblue paint\nRed Lake Inn",
    ("entry", "settings"): "max_steps = 200\nlearning_rate: 0.001\nseed=17\nuse_cache: true\nmodel_name = small_v2\ntimeout: 30\nverbose: off\nprice_check: on\nowner: Lumi",
    ("entry", "inline"): "step 14; votes of group two; missing price in orders; seed 23; rename old_name; check city_name\nblue paint, two brushes, a ladder, nails, old cloth, tape\nseed 11; step 90; seed 4; step 7; price of ticket",
    ("entry", "zh"): "种子 12\n缺少列 price\n第 3 步\n检查 city_name\n下一步计划\n李明的投票\norders 的 price\n结果表",
    ("entry", "zh inline"): "种子 12; 第 3 步; orders 的 price; 检查 city_name; 种子 907; 李明的投票; 缺失列; 第 44 步\n检查 price; 种子 5; clinic 缺失列; 第 1604 步; visits 的 age\nlake_town_4 缺失列; visits 的 price; Lumi 的投票; 检查 city_name; old_plan 缺失列; Soren 的投票",
    ("odd", "letters"): "xkqoria vbnt zzrwalu qplemi mkjo trwqipaz hufe wqxanit kdzzu pzlerofa qat vvelio xkaj bbdurtez lpoqwi wexzana mnrt bvcqol plkzi wrtqune",
    ("odd", "short letters"): "xkq vbnt zzrw qpl mkj trw\nwqx8 kd2 pz91 q7t vv0 xk4j 22bd\nhgfk lpoq wexz mnrt bvcq plkz wrtq",
    ("odd", "codes"): "a4df1859 e9146c7f 23e44d38 1e5ecba0\nZx81kPq0 mB4tR7 Qw2Lx9 vN5kT8\nid=90ab12 q=44fe09 code=638 w=7c",
}
BLOCK_WEIGHTS = (1.0, 1.6, 0.7)
FORMS = ("sentence", "entry", "row", "odd")
# Mass by line form of each structural kind.
KINDS = {
    "prose": (0.90, 0.06, 0.03, 0.01),
    "list": (0.06, 0.88, 0.04, 0.02),
    "table": (0.04, 0.08, 0.86, 0.02),
    "junk": (0.04, 0.06, 0.02, 0.88),
}


def divergence(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence in bits."""
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a > 0:
            total += a / 2 * math.log2(a / m)
        if b > 0:
            total += b / 2 * math.log2(b / m)
    return max(0.0, total)


@lru_cache(20_000)
def class_of(c: str) -> str:
    """One of CHARS for a character."""
    if HAN.match(c):
        return "han"
    if c.isspace():
        return "space"
    if c.isdigit():
        return "digit"
    if c.isalpha() and (c.islower() or c.isupper()) and (c.isascii() or not STRANGE.match(c)):
        return "lower" if c.islower() else "upper"
    if c in ".!?。！？":
        return "stop"
    if c in ",，、:：":
        return "pause"
    if c in ";；|•=/":
        return "cut"
    return "mark" if c in "'\"()-_“”‘’（）–—%*#`[]《》" else "other"


@lru_cache(50_000)
def word_class(w: str) -> str:
    """One of WORDS for a token."""
    if HAN.match(w):
        return "han_function" if w in HAN_FUNCTION else "han"
    low = w.lower()
    if low in FUNCTION:
        return "function"
    if w.isdigit():
        return "number"
    if not w.replace("'", "").replace("’", "").isalpha():
        return "name"
    return "short" if len(w) <= 3 else "long"


CHAR_AT, WORD_AT = {c: k for k, c in enumerate(CHARS)}, {c: k for k, c in enumerate(WORDS)}


@lru_cache(20_000)
def place_of(c: str) -> int:
    """Place of a character's class in CHARS."""
    return CHAR_AT[class_of(c)]


@lru_cache(200_000)
def word_place(w: str) -> int:
    """Place of a token's class in WORDS."""
    return WORD_AT[word_class(w)]


SIZES = len(CHARS), len(WORDS), len(PIECES)


def characters(line: str) -> list[float]:
    """How often each of CHARS comes."""
    out = [0.0] * SIZES[0]
    for c, k in Counter(line).items():
        out[place_of(c)] += k
    return out


def described(line: str, chars: list[float] | None = None) -> list[float]:
    """The three distributions of a line, one after the other: shares of CHARS, of WORDS (a Han character is a word) and of PIECES.

    PIECES: the words that lie in pieces of at most 3, 6, 12 and more words
    between separators; two Han characters are a word there.
    """
    chars, words, sizes = chars or characters(line), [0.0] * SIZES[1], [0.0] * SIZES[2]
    token = ASCII_TOKEN if line.isascii() else TOKEN
    for x in CUT.split(line):
        size = 0.0
        for w in token.findall(x):
            at = word_place(w)
            words[at] += 1
            size += 0.5 if at >= 5 else 1.0
        if size:
            sizes[0 if size <= 3 else 1 if size <= 6 else 2 if size <= 12 else 3] += size
    out = []
    for v in (chars, words, sizes):
        total = sum(v) or 1.0
        out += [x / total for x in v]
    return out


@lru_cache(1)
def profiles() -> tuple[list[str], np.ndarray]:
    """Forms, and the mean distributions of their sample lines; English and German sentences also in capitals."""
    forms, rows = [], []
    for (form, manner), text in SAMPLES.items():
        for t in [text] + ([text.upper()] if form == "sentence" and manner in ("en", "de") else []):
            forms.append(form)
            rows.append(np.mean([described(x) for x in t.split("\n")], axis=0))
    return forms, np.array(rows)


def entropy(p: np.ndarray) -> np.ndarray:
    """Entropy in bits along the last axis."""
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def divergences(lines: np.ndarray, against: np.ndarray, blocks: tuple[float, ...] = BLOCK_WEIGHTS) -> np.ndarray:
    """Jensen-Shannon divergence of each line from each profile, added over the distributions with their weights."""
    out, at = np.zeros((len(lines), len(against))), 0
    for w, n in zip(blocks, SIZES):
        p, q = lines[:, at : at + n], against[:, at : at + n]
        if w:
            out += w * (entropy((p[:, None, :] + q[None]) / 2) - (entropy(p)[:, None] + entropy(q)[None]) / 2)
        at += n
    return out


def nearest_forms(lines: list[list[float]]) -> list[str]:
    """Form of the nearest profile of each described line."""
    forms, against = profiles()
    out: list[str] = []
    for k in range(0, len(lines), 2000):
        d = divergences(np.array(lines[k : k + 2000]), against)
        out += [forms[i] for i in d.argmin(1)]
    return out


def function_share(words: list[str]) -> float:
    return len([w for w in words if w.lower() in FUNCTION]) / len(words) if words else 0.0


def periodic(s: str) -> bool:
    """Whether s repeats its beginning at a distance of at most a quarter of its length.

    All periods of at most a quarter are multiples of the first place where the
    beginning of three quarters is found again, so one search, of linear time,
    and one comparison decide.
    """
    n = len(s)
    if n < 24:
        return False
    p = s.find(s[: n - n // 4], 1)
    return 0 < p <= n // 4 and s[p:] == s[:-p]


def repeats(text: str) -> bool:
    """One piece, of one or more tokens, over and over through all but the first line and the last token."""
    for part in (text, text.partition("\n")[2]):
        tokens = part.replace(",", " ").replace(";", " ").split()
        if periodic(" ".join(tokens[:-1])) or periodic("".join(tokens)):
            return True
    return False


def cell_count(line: str, sep: str) -> int:
    """Cells of a line for a separator ('  ' stands for runs of blanks); 0 where it makes no cells of a table."""
    if line.count(sep) < (2 if sep in ",;" else 1):
        return 0
    if sep == "  ":
        cells = re.split(r"\s{2,}", line.strip())
    elif sep == "|":
        cells = line.strip().strip("|").split("|")
    else:
        cells = line.split(sep)
    if len(cells) < 2 or any(len(c) > 60 for c in cells) or sep in ",;" and (len(cells) < 3 or any(len(c.split()) > 4 for c in cells)):
        return 0
    if any(re.fullmatch(r"\s*([#=*█.>])\1*\s*", c) for c in cells):
        return 0
    return len(cells)


def rows(lines: list[str]) -> list[bool]:
    """Which lines are rows of the same cells as the other rows of the text."""
    best = [False] * len(lines)
    for sep in ("|", "\t", ";", ",", "  "):
        if sum(sep in x for x in lines) < 3:
            continue
        counts = [cell_count(x, sep) for x in lines]
        common = Counter(c for c in counts if c).most_common(1)
        if not common or common[0][1] < 3 or sep in ",;  " and common[0][1] < 0.5 * sum(c > 0 for c in counts):
            continue
        width = common[0][0]
        body = "".join(x for c, x in zip(counts, lines) if c == width)
        if len(NO_ALNUM.sub("", body)) < 0.4 * len(re.sub(r"[\s|+-]+", "", body)) or function_share([w for w in WORD.findall(body) if len(w) > 1]) >= 0.15:
            continue
        hit = [c == width or bool(re.fullmatch(r"\s*[+|][-+=|: ]{3,}\s*", x)) for c, x in zip(counts, lines)]
        if sep == "  ":
            hit = aligned(lines, hit)
        if sum(hit) > sum(best):
            best = hit
    return best


def aligned(lines: list[str], hit: list[bool]) -> list[bool]:
    """Rows of an aligned table with an empty cell: fewer cells, each beginning where cells of at least half of the full rows do."""
    begins = [{m.start() for m in CELL.finditer(x)} for x in lines]
    common = Counter(b for bs, h in zip(begins, hit) if h for b in bs)
    usual = {b for b, n in common.items() if n >= sum(hit) / 2}
    return [h or len(bs) > 1 and bs <= usual for h, bs in zip(hit, begins)]


@lru_cache(20_000)
def strange(c: str) -> bool:
    """A letter of no usual alphabet."""
    return not NO_ALNUM.match(c) and bool(STRANGE.match(c))


def shape(line: str) -> tuple[float, str, list[float]]:
    """Mass of a line that is no row, its text without a bullet ('' where its shape makes it odd), and its characters."""
    bullet = BULLET.match(line)
    body = line[bullet.end() :] if bullet else line
    chars = characters(body)
    lower, upper, digit, blank, *_, han, other = chars
    alnum, odd = lower + upper + digit + han, 0.0
    if other and not body.isascii():
        odd = sum(strange(c) for c in body)
        alnum += sum(class_of(c) == "other" and not NO_ALNUM.match(c) for c in body)
    mass = len(line.strip()) + 1.5 * han
    size = len(body) - blank or 1
    if alnum / size < 0.5 or odd > 0.15 * size or dumped(line):
        return mass, "", chars
    return mass, body, chars


def join_wrapped(text: str, taken: set[str]) -> list[str]:
    """Lines of each block, joined where the block reads on over its lines (as its function words tell) or has a fixed width."""
    out: list[str] = []
    for block in re.split(r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)", text):
        held: list[str] = []

        def close() -> None:
            if len(held) < 2:
                out.extend(held)
                held.clear()
                return
            words = WORD.findall(" ".join(held))
            wide = all(len(x) >= 40 and len(x.split()) >= 6 for x in held[:-1])
            if (wide or len(words) >= 10 and len(words) >= 3 * len(held) and function_share(words) >= 0.22):
                out.append(" ".join(held))
            else:
                out.extend(held)
            held.clear()

        for x in re.split(r"[\r\n]+", block):
            if not x.strip() or x in taken or BULLET.match(x) or re.search(r"\t|;\s*$", x):
                close()
                if x.strip() and x not in taken:
                    out.append(x)
            else:
                held.append(x)
        close()
    return out


def parts(text: str) -> tuple[Counter, list[tuple[float, list[float]]]]:
    """Masses of a text's lines whose form is settled by counts, and (mass, description) of the others."""
    if repeats(text):
        return Counter(odd=1.0), []
    lines = [x for x in re.split(r"[\r\n]+", text) if x.strip()]
    table = rows(lines)
    mass: Counter = Counter()
    taken = {x for x, is_row in zip(lines, table) if is_row and not dumped(x)}
    for x in lines:
        if x in taken:
            mass["row"] += len(x.strip())
    rest = []
    for x in join_wrapped(text, taken):
        m, body, chars = shape(x)
        if body:
            rest.append((m, described(body, chars)))
        else:
            mass["odd"] += m
    return mass, rest


def line_forms(texts: list[str]) -> list[tuple[float, ...]]:
    """Mass of each of FORMS as shares, for each text; all their lines are compared with the profiles at once."""
    made = [parts(t) for t in texts]
    forms = iter(nearest_forms([x for _, rest in made for _, x in rest]))
    out = []
    for mass, rest in made:
        for m, _ in rest:
            mass[next(forms)] += m
        total = sum(mass.values()) or 1
        out.append(tuple(mass[f] / total for f in FORMS))
    return out


def kind_of(text: str) -> str:
    """Structural kind of one text."""
    return nearest_kind(line_forms([text])[0])


def nearest_kind(forms: tuple[float, ...]) -> str:
    """The nearest structural kind by the mass of line forms."""
    return min(sorted(KINDS), key=lambda k: divergence(forms, KINDS[k]))


STATS = "doc_id bigint, kind string, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, ended_lines double, short_lines double, function_words double, distinct_words double, prose_divergence double"


def counts(text: str, by_class: list[float]) -> tuple:
    """The figures of STATS between kind and prose_divergence."""
    words = WORD.findall(text)
    lines = [x for x in re.split(r"[\r\n]+", text) if x.strip()]
    n = len(text)
    return (
        len(words), len(lines), round(sum(map(len, words)) / len(words), 4) if words else 0.0,
        round(len(re.sub(r"[^\W_]+|\s+", "", text)) / n, 4), round(len(re.sub(r"\D+", "", text)) / n, 4),
        round(sum(x.rstrip()[-1] in ".!?。！？:;\"”" for x in lines) / len(lines), 4), round(sum(len(x.split()) <= 6 for x in lines) / len(lines), 4),
        round(by_class[WORD_AT["function"]] + by_class[WORD_AT["han_function"]], 4), round(len({w.lower() for w in words}) / len(words), 4) if words else 0.0,
    )


def prose_divergence(whole: np.ndarray) -> np.ndarray:
    """Divergence of characters and words of whole texts from the nearest language's prose."""
    forms, against = profiles()
    return divergences(whole, against[[f == "sentence" for f in forms]], (1.0, 1.0, 0.0)).min(1)


def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for df in batches:
        ids, texts = [], []
        for d, t in zip(df.doc_id, df.text):
            if strip_blank(t):
                ids.append(d)
                texts.append(t)
        if not texts:
            continue
        whole = np.array([described(t) for t in texts])
        at = slice(SIZES[0], SIZES[0] + SIZES[1])
        rows = [(d, nearest_kind(f), *counts(t, w[at].tolist()), round(float(p), 4)) for d, t, f, w, p in zip(ids, texts, line_forms(texts), whole, prose_divergence(whole))]
        yield pd.DataFrame(rows, columns=names)


def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Only the kind of each text."""
    for df in batches:
        ids, texts = [], []
        for d, t in zip(df.doc_id, df.text):
            if strip_blank(t):
                ids.append(d)
                texts.append(t)
        yield pd.DataFrame({"doc_id": ids, "kind": [nearest_kind(f) for f in line_forms(texts)]})


def text_quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures and structural kind (prose, list, table or junk) of each document, in one pass without a shuffle.

    Null and blank texts (invisible characters included) and null ids give no
    row; repeated rows repeat theirs; an empty table gives none; other columns
    are ignored. Texts are read whole.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return spread(rows).mapInPandas(figures, STATS)


def structural_kind(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind) as text_quality gives it, without the other figures."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return spread(rows).mapInPandas(kinds, "doc_id bigint, kind string")
