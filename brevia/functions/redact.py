"""Secret masking: passes in a fixed order, each over what the one before it left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import FOLDED, text_of

#: Kinds of secrets, their patterns, and what takes their place.
SECRETS = [
    ("aws_access_key", r"(?U)\bAKIA[0-9A-Z]{16}\b", "<redacted:aws_access_key>"),
    ("github_token", r"(?U)\bgh[pousr]_[A-Za-z0-9]{36,}\b", "<redacted:github_token>"),
    ("slack_token", r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "<redacted:slack_token>"),
    ("openai_key", r"(?U)\bsk-[A-Za-z0-9_-]{20,}\b", "<redacted:openai_key>"),
    ("google_api_key", r"(?U)\bAIza[0-9A-Za-z_-]{35}\b", "<redacted:google_api_key>"),
    ("jwt", r"(?U)\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "<redacted:jwt>"),
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "<redacted:private_key>"),
    ("bearer_token", r"(?iU)\b(bearer)\s+[A-Za-z0-9._-]{16,}", "$1 <redacted:bearer_token>"),
    (
        "assignment_secret",
        r"""(?iU)\b([A-Za-z0-9_]*(?:password|passwd|secret|api[_-]?key|token|access[_-]?key))\b\s*[:=]\s*["']?([^\s"',}]{6,})["']?""",
        "$1=<redacted:assignment_secret>",
    ),
]

#: What every match of a pattern holds, lower-cased where its case doesn't count.
NEEDLES = {
    "aws_access_key": ("AKIA",),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "slack_token": ("xox",),
    "openai_key": ("sk-",),
    "google_api_key": ("AIza",),
    "jwt": ("eyJ",),
    "private_key": ("PRIVATE KEY-----",),
    "bearer_token": ("bearer",),
    "assignment_secret": ("password", "passwd", "secret", "token", "key"),
}
#: Holds wherever a word begins, and is told more quickly than a border of words.
INITIAL = r"(?<![A-Za-z0-9_])"


def may_hold(kind: str, pattern: str, text: Column, lowered: Column) -> Column:
    """False where a text can't match a pattern, told without its regular expression."""
    if kind not in NEEDLES:
        return F.lit(True)
    caseless = pattern.startswith("(?iU)")
    found = [(lowered if caseless else text).contains(n) for n in NEEDLES[kind]] + [text.contains(c) for c in FOLDED if caseless]
    return reduce(lambda a, b: a | b, found)


def redact(df: DataFrame, text: str = "text", out: str = "redacted", hits: str = "secrets") -> DataFrame:
    """Adds the masked text and the number of masks.

    A pattern is looked for where its needles are; no mask completes one, as a name of a secret needs a colon or equals sign after it.
    """
    staged, counts = text_of(F.col(text)), []
    df = df.withColumn("_lower", F.lower(staged))
    for kind, pattern, mask in SECRETS:
        df = df.withColumn(f"_{kind}", staged)
        seen, maybe = F.col(f"_{kind}"), may_hold(kind, pattern, F.col(f"_{kind}"), F.col("_lower"))
        ahead = "" if kind == "private_key" else INITIAL
        df = df.withColumn(f"_in_{kind}", maybe & seen.rlike(ahead + pattern))
        staged = F.when(F.col(f"_in_{kind}"), F.regexp_replace(seen, ahead + pattern, mask)).otherwise(seen)
        counts.append(F.when(F.col(f"_in_{kind}"), F.regexp_count(seen, F.lit(ahead + pattern))).otherwise(0))
    total: Column = sum(counts[1:], counts[0])
    return df.withColumns({out: staged, hits: total.cast("long")}).drop("_lower", *(f"_{p}{k}" for k, _, _ in SECRETS for p in ("", "in_")))
