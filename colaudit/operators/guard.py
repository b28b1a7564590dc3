"""Which statements only read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First words of statements that a read-only connection may send.
READ_KEYWORDS = "select with explain show table values begin start commit rollback savepoint release end set reset discard fetch move close declare prepare deallocate".split()
_NOISE = r"\A(?:\s|/\*(?s:.*?)\*/|--[^\n]*\n)+"


class ReadOnlyViolation(RuntimeError):
    """The target is not safe to audit."""


class WriteAttemptBlocked(ReadOnlyViolation):
    """A statement that may write was stopped before it was sent."""


def first_keyword(sql: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(sql, F.lit("")), _NOISE, ""), r"\A\s*([a-zA-Z]+)", 1))


_LITERAL = r"'[^']*+(?:''[^']*+)*+'"
_COMMENT = r"--[^\n]*+|/\*(?s:.*?)\*/"
_RUNS = r"(?is)\bexplain\b.*\banalyze\b"
_SECOND = r";\s*[^\s;]"
_CHANGES = r"(?is)\b(?:insert\s+into|delete\s+from|merge\s+into)\b|(?<!for )(?<!for no key )\bupdate\b.*\bset\b"


def is_read(sql: Column) -> Column:
    """The first word is in the list; it is no EXPLAIN that runs its statement, no WITH that changes data, and stands alone.

    Literals and comments do not count.
    """
    word = first_keyword(sql)
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), f"({_LITERAL})|{_COMMENT}", "$1 "), _LITERAL, "''")
    return word.isin(*READ_KEYWORDS) & ~((word == "explain") & plain.rlike(_RUNS)) & ~((word == "with") & plain.rlike(_CHANGES)) & ~plain.rlike(_SECOND)


def assert_read(sql: str) -> None:
    """The same rule for one statement on the driver."""
    word = re.match(r"\s*([a-zA-Z]+)", re.sub(_NOISE.replace(r"\A", r"\A", 1), "", sql or ""))
    word = word[1].lower() if word else ""
    plain = re.sub(_LITERAL, "''", re.sub(f"({_LITERAL})|{_COMMENT}", lambda m: (m[1] or "") + " ", sql or ""))
    if word not in READ_KEYWORDS or word == "explain" and re.search(_RUNS, plain) or word == "with" and re.search(_CHANGES, plain) or re.search(_SECOND, plain):
        raise WriteAttemptBlocked(f"not a read: {sql[:80]!r}")
