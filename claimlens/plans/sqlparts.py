"""Reusable SQL fragments for oracle queries (DuckDB dialect)."""

from __future__ import annotations

from claimlens.functions.text import DIGIT, NON_WS_RUN, WS
from claimlens.sources.claims import CLAIMS_NUM_SQL, CLAIMS_TXT_SQL

NUM = f"WITH claims AS ({CLAIMS_NUM_SQL})\n"
TXT = f"WITH claims AS ({CLAIMS_TXT_SQL})\n"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def words(t: str) -> str:
    return f"coalesce(len(regexp_extract_all({t}, '{NON_WS_RUN}')), 0)"


def chars(t: str) -> str:
    return f"coalesce(length({t}), 0)"


def has_digit(t: str) -> str:
    return f"regexp_matches({t}, '{DIGIT}')"


def contains(t: str, w: str) -> str:
    return f"contains({t}, '{w.replace(chr(39), chr(39) * 2)}')"


def count_present(t: str, ws) -> str:
    if not ws:
        return "0"
    return "(" + " + ".join(f"CAST({contains(t, w)} AS INTEGER)" for w in ws) + ")"


def any_present(t: str, ws) -> str:
    if not ws:
        return "false"
    return "(" + " OR ".join(contains(t, w) for w in ws) + ")"


def r6(x: str) -> str:
    return f"round({x}, 6)"
