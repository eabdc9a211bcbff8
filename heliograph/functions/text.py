"""Tokenizers, redaction, byte-safe cuts, path and line helpers.

All are column expressions that stay in the JVM; the only Python function is the stemmer's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"
CODE = r"([A-Z]+(?=[A-Z][a-z])|[A-Z]+[a-z0-9]*|[a-z0-9]+)"
TOKEN_LIMIT = 40

#: Secret patterns, applied in this order; each match becomes REDACTED.
SECRETS = [
    r"sk-[A-Za-z0-9_-]{20,}",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)aws_secret_access_key\s*=\s*[A-Za-z0-9/+=]{40}",
    r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{20,}",
    r"""(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*["']?[A-Za-z0-9._~+/=-]{16,}""",
]
REDACTED = "[REDACTED]"

#: Observation kinds; anything else is "other".
KINDS = ["user_prompt", "assistant_message", "tool_use", "tool_failure", "subagent_start", "subagent_stop", "subagent_message", "task_completed", "session_start", "session_stop", "manual", "other"]

#: File extensions by language.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "sh": "bash", "bash": "bash"}


def default_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of fewer than 40 bytes: the analyzer of the observation index."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD)), lambda t: F.octet_length(t) < TOKEN_LIMIT)


def query_tokens(text: Column) -> Column:
    """Runs of letters and digits of two bytes or more, lower-cased."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(WORD)), F.lower), lambda t: F.octet_length(t) >= 2)


def code_tokens(text: Column, lower: bool = True) -> Column:
    """Identifiers' parts: camelCase, acronyms before words, digits with the run they follow; ASCII only."""
    parts = F.regexp_extract_all(text, F.lit(CODE))
    return F.transform(parts, F.lower) if lower else parts


def path_tokens(text: Column) -> Column:
    """Lower-cased pieces between white space and / _ - ."""
    return F.filter(F.split(F.lower(text), r"[\s/_\-.]+"), lambda t: t != "")


def segment_matches(path: Column, tokens: Column) -> Column:
    """How many of the query's tokens are segments of the path; a repeated token counts again."""
    segments = path_tokens(path)
    return F.size(F.filter(tokens, lambda t: F.array_contains(segments, t)))


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for p in SECRETS:
        out = out | text.rlike(p)
    return out


def redact(text: Column) -> Column:
    """Texts without a secret, nearly all, cost one pass of tests; the others are rewritten pattern by pattern."""
    out = text
    for p in SECRETS:
        out = F.regexp_replace(out, p, REDACTED.replace("$", "\\$"))
    return F.when(has_secret(text), out).otherwise(text)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes of UTF-8 that ends at a character's end.

    One expression for all texts: the cut moves back over continuation bytes (at most three).
    """
    raw = F.encode(text, "UTF-8")
    follows = lambda at: F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")
    cut = F.when(~follows(most), most).when(~follows(most - 1), most - 1).when(~follows(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def truncate_body(text: Column, most: int = 4096) -> Column:
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut_bytes(text, most), F.lit("…[truncated]")))


def truncate_mark(text: Column, most: int) -> Column:
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut_bytes(text, most), F.lit("…")))


def first_line(text: Column, most: int = 200) -> Column:
    return truncate_mark(F.split(text, r"\r?\n")[0], most)


def one_line(text: Column, most: int = 240) -> Column:
    return first_line(F.trim(text), most)


def chunk_windows(text: Column, size: int = 1800) -> Column:
    """Windows of ``size`` characters; for ASCII, of as many bytes. Never empty."""
    n = F.greatest(F.length(text), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def byte_windows(text: Column, size: int = 1800) -> Column:
    """Windows of at most ``size`` bytes of UTF-8 that end at characters' ends. Never empty.

    ASCII texts stay in the JVM; the others go through a vectorised function.
    """

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        def cut(t: str) -> list[str]:
            raw, out, at = t.encode(), [], 0
            while at < len(raw):
                end = min(at + size, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                out.append(raw[at:end].decode())
                at = end
            return out or [""]

        return rows.map(lambda t: None if t is None else cut(t))

    return F.when(F.octet_length(text) == F.length(text), chunk_windows(text, size)).otherwise(run(text))


def slice_lines(source: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, both included; nonsense ranges give an empty text."""
    lines = F.split(source, r"\r?\n")
    ok = (start >= 1) & (end >= start) & (start <= F.size(lines))
    return F.when(ok, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")).otherwise("")


def dedup_hash(session: Column, kind: Column, body: Column) -> Column:
    """SHA-256 of session, kind and the first 500 bytes of the body, parted by zero bytes."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(F.encode(session, "UTF-8"), zero, F.encode(kind, "UTF-8"), zero, F.substring(F.encode(body, "UTF-8"), 1, 500)), 256)


def cache_key(tag: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", tag, text), 256)


def normal_kind(kind: Column) -> Column:
    return F.when(kind.isin(KINDS), kind).otherwise("other")


def language_of(path: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for e, language in LANGUAGES.items():
        out = F.when(extension == e, language).otherwise(out)
    return out


def excluded(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p)
    return out


#: Classes of file events.
EVENT_KINDS = ("create", "modify", "remove", "access")


def coarse_kind(kind: Column) -> Column:
    """The class of a file event, whose name may go on after a bracket, slash or dot; other for the rest."""
    head = F.lower(F.regexp_extract(kind, r"^\s*([A-Za-z]+)", 1))
    return F.when(head.isin(list(EVENT_KINDS)), head).otherwise("other")


def percent_encode(text: Column) -> Column:
    """Everything but letters, digits and -_.~ as %XX of its UTF-8 bytes."""
    form = F.url_encode(text)
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        form = F.regexp_replace(form, a, b)
    return form


def model_tag(path: Column) -> Column:
    """A model file's name without folder and ending, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""))


def file_safe(tag: Column) -> Column:
    return F.regexp_replace(tag, "[^A-Za-z0-9.-]", "_")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def session_body(turns: Column) -> Column:
    """role: content lines of an array of turns (struct role, content)."""
    return F.concat(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n"), F.lit("\n"))
