"""Scalar expressions: names, redaction, labels, hashes. Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanline.config import AGENT_PREFIXES, CROSS_CUTTING


def at(as_of: str) -> Column:
    """A time of reference as a timestamp without zone."""
    return F.lit(as_of).cast("timestamp_ntz")


def normalize_agent(c: Column) -> Column:
    """Agent name without its prefix; other sources stay."""
    return F.regexp_replace(c, f"^({'|'.join(map(re.escape, AGENT_PREFIXES))})(?=fd-)", "")


#: Forms of secrets, and what they are replaced by, in the order of application. None spans lines.
REDACTIONS = (
    (r"""(?i)(api[_-]?key|apikey|api[_-]?secret)[ \t\r\f\x0b]*[:=][ \t\r\f\x0b]*['"][^'"\n]{8,}['"]""", "$1=[REDACTED:api_key]"),
    (r"""(?i)(bearer|token|auth)[ \t\r\f\x0b]+[A-Za-z0-9_\\.\-]{20,}""", "$1 [REDACTED:token]"),
    (r"""AKIA[0-9A-Z]{16}""", "[REDACTED:aws_key]"),
    (r"""gh[ps]_[A-Za-z0-9]{36,}""", "[REDACTED:github_token]"),
    (r"""github_pat_[A-Za-z0-9_]{22,}""", "[REDACTED:github_token]"),
    (r"""sk-ant-[A-Za-z0-9\\\-]{20,}""", "[REDACTED:anthropic_key]"),
    (r"""sk-[A-Za-z0-9]{20,}""", "[REDACTED:openai_key]"),
    (r"""[a-zA-Z]+://[^:\n]+:[^@\n]+@[^/ \t\r\n\f\x0b]+""", "[REDACTED:connection_string]"),
    (r"""(?i)(password|passwd|pwd|secret)[ \t\r\f\x0b]*[:=][ \t\r\f\x0b]*['"][^'"\n]{4,}['"]""", "$1=[REDACTED:password]"),
)
#: What a text must not say, letters in either case.
INJECTION = ("<system>", "<instructions>", "ignore previous", "you are now", "disregard", "system:")


def redact(c: Column) -> Column:
    for pattern, to in REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def sanitize(c: Column, most: int = 500) -> Column:
    """Without terminal escapes and controls, cut, redacted; null stays null."""
    c = F.regexp_replace(c, r"\x1b\[[0-9;]*[a-zA-Z]", "")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return redact(F.substring(c, 1, most))


def rejected(c: Column) -> Column:
    """Whether a sanitised text tries to instruct."""
    low = F.lower(c)
    hit = F.lit(False)
    for word in INJECTION:
        hit = hit | F.contains(low, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def is_agent_name(c: Column) -> Column:
    return F.coalesce(c.rlike("^fd-[a-z][a-z0-9-]*$"), F.lit(False))


def is_tool_name(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z][A-Za-z0-9_-]*$"), F.lit(False))


def is_skill_name(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z][a-z0-9-]*(:[a-z][a-z0-9-]*)?$"), F.lit(False))


def is_cross_cutting(c: Column) -> Column:
    return c.isin(*CROSS_CUTTING)


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "t", "yes"), F.lit(False))


def lenient_int(c: Column) -> Column:
    """Truncated toward zero; what is no number is 0."""
    x = c.try_cast("double")
    return F.coalesce(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"), F.lit(0))


def token_estimate(c: Column) -> Column:
    return F.floor(F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")) * 1.3).cast("long")


def week_label(ts: Column) -> Column:
    """Year and week of the year, weeks from Monday, days before the first Monday in week 00."""
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7).cast("string"), 2, "0"))


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def invocation_hash(ts: Column, session: Column, name: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", ts, session, name)), 1, 16)


def doc_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def frontmatter(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?s)---\n(.*?)\n---\n", 1)


def body(c: Column, most: int = 2048) -> Column:
    return F.substring(F.regexp_replace(c, r"^(?s)---\n.*?\n---\n", ""), 1, most)


def workspace_key(path: Column) -> Column:
    """The workspace of a path: of a transcript the folder under projects, of any other path its encoded form."""
    own = F.regexp_extract(path, "(?:^|/)projects/([^/]+)(?:/|$)", 1)
    return F.when(own != "", own).otherwise(F.concat(F.lit("-"), F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/", "-")))


def to_iso(ts: Column) -> Column:
    """An instant in UTC as text, to the second."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sigmoid_goodness(value: Column, middle: Column, spread: Column) -> Column:
    """Near 1 far under the middle, near 0 far over it; a spread of zero counts as one."""
    x = (value - middle) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return F.least(F.greatest(1 - 1 / (1 + F.exp(-x)), F.lit(0.0)), F.lit(1.0))


def ema(classified: Column, observed: Column, alpha: float = 0.3) -> Column:
    return observed * alpha + classified * (1 - alpha)


#: Words of a description and the weights (speed, precision, completeness) of its goal, first match.
GOALS = (
    ("audit", ("audit", "review", "verify", "coverage", "gate", "lint", "check"), (0.1, 0.3, 0.6)),
    ("search", ("search", "retriev", "lookup", "recall", "find", "query", "index"), (0.7, 0.2, 0.1)),
    ("orchestration", ("sequenc", "orchestrat", "phase", "lifecycle", "workflow", "pipeline", "dispatch", "brainstorm", "ship"), (0.15, 0.45, 0.4)),
)
DEFAULT_GOAL = ("default", (0.2, 0.6, 0.2))


def goal_bucket(c: Column) -> Column:
    """A struct (bucket, speed, precision, completeness)."""
    def goal(name, w):
        return F.struct(F.lit(name).alias("bucket"), *(F.lit(x).alias(n) for n, x in zip(("speed", "precision", "completeness"), w, strict=True)))

    out = goal(*DEFAULT_GOAL)
    for name, words, w in reversed(GOALS):
        out = F.when(F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False)), goal(name, w)).otherwise(out)
    return out
