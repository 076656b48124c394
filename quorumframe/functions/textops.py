"""Text operators as Column expressions; null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statements a read-only gate refuses, and how a read-only one starts.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "ATTACH", "DETACH")
STARTS = ("SELECT", "WITH", "EXPLAIN", "PRAGMA")
# Words without content, for keyword matching.
STOP_WORDS = tuple(
    """a an the is are was were be been being of to in on at for with by from and or not
no nor what which who whom whose how many much most more most less least each every
all any some such than then that this these those it its their there here where when
why per our your above below between into over under again further once out up down
find get give show display list count sum average avg min max total number value
values information detail details record records data database table tables column
columns question answer queries query please would could should can will may does
do did done has have had having year month day date time first last""".split()
)


def norm_key(c: Column) -> Column:
    """Lower case, ends trimmed, blanks collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def norm_equal(a: Column, b: Column) -> Column:
    """Equal but for blanks and letter case; two nulls are not equal."""
    return F.coalesce(norm_key(a) == norm_key(b), F.lit(False))


def is_safe_sql(c: Column) -> Column:
    """Read-only gate: a known start within the first 50 characters and none of FORBIDDEN as a word outside '…' strings. Null is refused.

    The word REPLACE is refused as a function too.
    """
    head = F.upper(F.ltrim(F.substring(c, 1, 50)))
    starts = F.greatest(*[head.startswith(s) for s in STARTS])
    body = F.regexp_replace(F.upper(c), r"'[^']*'", "")
    return F.coalesce(starts & ~body.rlike(r"\b(" + "|".join(FORBIDDEN) + r")\b"), F.lit(False))


def clean_prediction(c: Column, inline: bool = False) -> Column:
    """Comment lines (with inline: all -- comments) dropped, closing semicolons cut, blanks collapsed."""
    bare = F.regexp_replace(c, r"--[^\n]*" if inline else r"(?m)^\s*--[^\n]*$", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[; ]+$", "")


def join_operators(c: Column) -> Column:
    """'> =', '< =' and '! =' without their blank."""
    return F.regexp_replace(c, r"([<>!])\s+=", "$1=")


def pin_year(c: Column, year: int = 2020) -> Column:
    """The current-year call replaced by a fixed year, so results do not depend on the day."""
    return F.regexp_replace(c, r"(?i)YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)", str(year))


def drop_distinct(c: Column) -> Column:
    """The word DISTINCT dropped outside '…' strings (a string is matched first and put back)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)('[^']*')|\bdistinct\b", "$1"), r"  +", " ")


def official_transform(c: Column) -> Column:
    """Cleaned, operators joined, DISTINCT dropped, year pinned."""
    return pin_year(drop_distinct(join_operators(clean_prediction(c))))


def has_order_by(c: Column) -> Column:
    """ORDER BY outside '…' strings."""
    return F.regexp_replace(c, r"'[^']*'", "").rlike(r"(?i)\border\s+by\b")


def mentions_order_by(c: Column) -> Column:
    """The characters 'order by' anywhere, strings included."""
    return F.lower(c).contains("order by")


def export_sql(c: Column) -> Column:
    """One line for an evaluator: cleaned with inline comments dropped; SELECT 1 for nothing."""
    return F.coalesce(F.nullif(clean_prediction(c, inline=True), F.lit("")), F.lit("SELECT 1"))


FENCE = r"(?is)```\s*sql\s*\n?(.*?)```"
ANY_FENCE = r"(?s)```\w*\s*\n?(.*?)```"
# To the first semicolon outside quotes; an open quote holds the rest.
STATEMENT = r"""(?is)\b((?:select|with)\b(?:[^;'"]++|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z))*+)"""


def no_comment_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\s*--.*$", "")


def fenced_sql(c: Column) -> Column:
    """Without its comment lines: the first sql fence, else any fence, else the text from SELECT or WITH to a semicolon outside quotes, else all."""
    c = no_comment_lines(c)
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")) for p in (FENCE, ANY_FENCE, STATEMENT)], F.trim(c))


def parse_method(c: Column) -> Column:
    """Which step of fenced_sql answers."""
    c = no_comment_lines(c)
    hit = lambda p: F.trim(F.regexp_extract(c, p, 1)) != ""
    return F.when(c.isNull(), None).when(hit(FENCE), "sql_fence").when(hit(ANY_FENCE), "fence").when(hit(STATEMENT), "statement").otherwise("rest")


def after_thinking(c: Column) -> Column:
    """The text after the last closing think tag."""
    return F.substring_index(c, "</think>", -1)


def last_fence(c: Column) -> Column:
    """The last fenced block; null where there is none."""
    found = F.regexp_extract_all(c, F.lit(ANY_FENCE), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def single_think(c: Column) -> Column:
    """Exactly one opening think tag, at least one closing, exactly one fence."""
    return (F.regexp_count(c, F.lit("<think>")) == 1) & (F.regexp_count(c, F.lit("</think>")) >= 1) & (F.regexp_count(c, F.lit("```")) == 2)


def count_joins(c: Column) -> Column:
    """JOIN words outside '…' strings."""
    return F.regexp_count(F.regexp_replace(c, r"'[^']*'", ""), F.lit(r"(?i)\bjoin\b"))


def named_tables(c: Column) -> Column:
    """Sorted distinct names after FROM and JOIN, without quotes, in lower case."""
    names = F.regexp_extract_all(F.lower(F.regexp_replace(c, r"'[^']*'", "")), F.lit(r"\b(?:from|join)\s+[`\"\[]?(\w+)"), F.lit(1))
    return F.array_sort(F.array_distinct(names))


def references_tables(pred: Column, gold: Column, schema: Column) -> Column:
    """Whether a query names a table of the gold query (of the schema where the gold names none, or begins with WITH): no stub."""
    own = named_tables(gold)
    want = F.when((F.size(own) > 0) & ~F.ltrim(F.lower(gold)).startswith("with"), own).otherwise(schema)
    return F.coalesce(F.arrays_overlap(named_tables(pred), want), F.lit(False))


def quality(c: Column) -> Column:
    """Tie-break score: two off for each table, a thousandth for each character."""
    return F.round(-2.0 * F.size(named_tables(c)) - 0.001 * F.length(c), 6)


def sql_tokens(c: Column) -> Column:
    """Distinct tokens in lower case: words, numbers and operators, strings as one token."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"'[^']*'|\w+|<=|>=|!=|<>|[^\s\w]"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the token sets; two empty texts are equal."""
    x, y = sql_tokens(a), sql_tokens(b)
    union = F.size(F.array_union(x, y))
    return F.round(F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union), 6)


def hash16(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def content_tokens(c: Column) -> Column:
    """Words of letters, digits and underscores in lower case, in order and with repeats, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def token_variants(word: Column) -> Column:
    """A word and its other number: without its s (from four letters on), or with one (from three)."""
    n, s = F.length(word), word.endswith("s")
    other = F.when(s & (n >= 4), F.substring(word, F.lit(1), n - 1)).when(~s & (n >= 3), F.concat(word, F.lit("s")))
    return F.array_compact(F.array(word, other))


def norm_name(c: Column) -> Column:
    """Names in lower case, ends trimmed, hyphens as underscores."""
    return F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))


def norm_value(c: Column) -> Column:
    """Letters a to z and digits of a value in lower case; a null value is an empty text."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^a-z0-9]", "")


def truncate(c: Column, n: int) -> Column:
    """Blanks collapsed; a longer text is cut to n characters, the last three being dots. A null text is empty."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, max(n - 3, 1)), F.lit("...")))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1; a null text has 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.floor(F.length(c) / 4), F.lit(1)))


def split_steps(c: Column) -> Column:
    """Sentences of a reasoning text without empty ones."""
    return F.filter(F.split(F.trim(c), r"(?<=[.!?。])\s+|\n+"), lambda x: F.trim(x) != "")


def corrupt_steps(c: Column, id_: Column, seed: int) -> Column:
    """A later step put before an earlier one with a mark to go back; the place comes from a hash of id and seed. Texts of one step stay."""
    steps = split_steps(c)
    n = F.size(steps)
    at = F.pmod(F.xxhash64(id_, F.lit(seed)), F.greatest(n - 1, F.lit(1))).cast("int")
    new = F.concat(F.slice(steps, F.lit(1), at), F.array(F.element_at(steps, at + 2), F.lit("[BACK]")), F.slice(steps, at + 1, F.greatest(n - at, F.lit(1))))
    return F.when(n > 1, F.array_join(new, " ")).otherwise(c)


def truncate_prompt(c: Column, budget: int, size: Callable[[Column], Column] = estimate_tokens, overhead: int = 0) -> Column:
    """The longest beginning whose size with the template's overhead is within the budget, its end trimmed.

    The cut is found by bisection over the number of characters, as a fold of 32
    steps; size need only not shrink as a text grows.
    """
    n = F.length(c)
    zero = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        fits = size(F.substring(c, F.lit(1), mid)) + overhead <= budget
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(fits, mid).otherwise(acc["lo"]).alias("lo"), F.when(fits, acc["hi"]).otherwise(mid - 1).alias("hi")))

    cut = F.aggregate(F.sequence(F.lit(1), F.lit(32)), zero, halve)["lo"]
    return F.when(size(c) + overhead <= budget, c).otherwise(F.rtrim(F.substring(c, F.lit(1), cut)))


def trim_to_tokens(c: Column, budget: int) -> Column:
    """The longest beginning within a token budget by estimate_tokens."""
    return F.when(estimate_tokens(c) <= budget, c).otherwise(F.substring(c, 1, budget * 4))
