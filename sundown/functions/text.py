"""Patterns over whole texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is searched for in texts. (?U) gives \b, \w and \s their Unicode meaning.
EMAIL = r"(?iu)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
REDACTED = "[redacted]"
REDACTED_EMAIL = "[redacted-email]"
SENSITIVE = (
    r"(?iuU)(?:"
    r"(?:/home/|/Users/|[A-Za-z]:\\\\)"
    r"|(?:https?://|urn:li:)"
    r"|(?:\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b)"
    r"|(?:\b(?:token|secret|password|cookie)\b\s*[=:])"
    r")"
)
# A statement: a verb, and later on the same line one of its second words.
STATEMENT_VERB = r"(?iuU)\b(?:select|insert|update|delete|merge)\b(.*)"
STATEMENT_WORD = r"(?iuU)\b(?:from|into|set)\b"
LINE_END = r"[\n\r\u0085\u2028\u2029]"
FORBIDDEN = {
    "home path": r"(?:/home/|/Users/)[^/\s]+/",
    "private key": r"-----BEGIN .*PRIVATE KEY-----",
    "credential value": r"(?imuU)(?:token|client_secret|password)\s*[=:]\s*[\"']?[A-Za-z0-9+/=_-]{12,}",
}
SELECT_STAR = r"(?isU)\bselect\s+\*"


def token_pattern(token: str) -> str:
    """The identifier, not inside a longer one."""
    return rf"(?<![A-Za-z0-9_]){re.escape(token)}(?![A-Za-z0-9_])"


def alias_pattern(token: str) -> str:
    return rf"(?iuU)\b{re.escape(token)}\s+as\s+\w+"


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, REDACTED_EMAIL.replace("$", r"\$"))


def names_statement(text: Column) -> Column:
    """Whether a line holds a verb and a second word after it.

    What follows the first verb holds whatever follows a later one, so each line is read twice
    at most, however often it repeats a verb.
    """
    lines = F.split(text, LINE_END)
    return F.exists(lines, lambda line: F.regexp_extract(line, STATEMENT_VERB, 1).rlike(STATEMENT_WORD))


def public_text(text: Column, fallback: str) -> Column:
    """The trimmed text, or the fallback when it is empty or names a path, address, person, statement or secret."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    bad = text.isNull() | (trimmed == "") | trimmed.rlike(SENSITIVE) | names_statement(trimmed)
    return F.when(bad, F.lit(fallback)).otherwise(trimmed)


def forbidden_labels(text: Column) -> Column:
    """Names of the forbidden kinds of content found in the text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in FORBIDDEN.items()]))
