"""Column expressions for text with Python string semantics.

All helpers return JVM-side ``Column`` expressions (whole-stage codegen), no UDFs.
Character classes are spelled out so the same pattern gives the same answer in
Spark (Java regex) and in DuckDB (RE2), which the oracle uses.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python ``str.isspace`` characters: ASCII controls 9-13 and 28-31, NEL and the
# Unicode separators (category Z).
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
NON_WS_RUN = r"[^\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+"
DIGIT = r"\p{Nd}"
# Word tokens of two or more letters/digits/underscore (the usual TF-IDF token rule).
TOKEN = r"[\p{L}\p{N}_]{2,}"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace; NULL stays NULL."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def word_count(c: str | Column) -> Column:
    """``len(str.split())`` with NULL -> 0."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(NON_WS_RUN)), F.lit(0)).cast("bigint")


def char_count(c: str | Column) -> Column:
    """``len(str)`` with NULL -> 0."""
    return F.coalesce(F.length(_c(c)), F.lit(0)).cast("bigint")


def has_digit(c: str | Column) -> Column:
    return _c(c).rlike(DIGIT)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    words = list(words)
    if not words:
        return F.lit(False)
    out = None
    for w in words:
        e = F.contains(text, F.lit(w))
        out = e if out is None else (out | e)
    return out


def count_present(text: Column, words: Sequence[str]) -> Column:
    """Number of distinct lexicon entries that occur as substrings of ``text``."""
    if not words:
        return F.lit(0)
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def weighted_presence(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the lexicon entries present in ``text``."""
    return sum((F.when(F.contains(text, F.lit(w)), F.lit(float(x))).otherwise(F.lit(0.0))
                for w, x in weights.items()), F.lit(0.0))


def truncate_display(c: str | Column, n: int = 100) -> Column:
    """Texts longer than ``n`` characters become their first ``n`` characters + ``...``."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def sql_list(words: Iterable[str]) -> str:
    """Render a lexicon as a SQL list literal (for oracle SQL)."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: English stop words of Spark ML's StopWordsRemover (fixed values).
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd "
    "they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't "
    "weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't "
    "couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would "
).split()


def english_stop_words() -> list[str]:
    """Spark ML's default English stop words; Spark code and SQL oracles use this one list."""
    return list(ENGLISH_STOP_WORDS)
