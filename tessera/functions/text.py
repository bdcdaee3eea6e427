"""Text expressions: redaction, previews, dates, URLs, languages of paths, import paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what is redacted, in this order
SECRETS = [
    r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----",
    r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"AKIA[0-9A-Z]{16}",
    r"gh[ps]_[A-Za-z0-9_]{36,}",
    r"(?i)(postgres|mysql|mongodb|redis)://[^\s'\"]+",
    r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+",
    r"(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*['\"]?[A-Za-z0-9/+=_-]{16,}['\"]?",
]
REDACTED = "[REDACTED]"

# fixed values: languages by extension
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin",
    "kts": "kotlin", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json",
    "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css",
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scrub(c: str | Column, enabled: bool = True) -> Column:
    """The text with secrets redacted; classes are ASCII, as Java's regular expressions have it."""
    out = _col(c)
    for pattern in SECRETS if enabled else []:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(REDACTED))
    return out


def preview(c: str | Column, chars: int) -> Column:
    return F.substring(_col(c), 1, chars)


def summary(c: str | Column, most: int = 120) -> Column:
    """Up to `most` chars as they are, else so many less three and an ellipsis of dots."""
    c = _col(c)
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def clipped(c: str | Column, length: int) -> Column:
    """As summary, but it is the bytes that decide and the chars that are cut."""
    c = _col(c)
    return F.when(F.octet_length(c) <= length, c).otherwise(F.concat(F.substring(c, 1, max(0, length - 3)), F.lit("...")))


def day(c: str | Column) -> Column:
    """dd-mm-yyyy of a timestamp in text, or its first ten chars where it is none."""
    c = _col(c)
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "dd-MM-yyyy"), F.substring(c, 1, 10))


def percent_encoded(c: str | Column) -> Column:
    """Unreserved chars kept, all others as upper-case hex of their UTF-8 bytes."""
    out = F.url_encode(_col(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ticket_url(template: str | Column, ticket: str | Column) -> Column:
    return F.replace(_col(template), F.lit("{ticket}"), percent_encoded(ticket))


def extension(path: str | Column) -> Column:
    """What follows the last dot of the file's name; null without one, or where only a leading dot is."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def language(path: str | Column) -> Column:
    """The language of a path's extension, whose case counts; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def sha256(c: str | Column) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def import_path(c: str | Column) -> Column:
    """The module that an import statement names."""
    t = F.trim(_col(c))
    use = F.regexp_replace(F.trim(F.element_at(F.split(F.trim(F.regexp_replace(F.substring(t, 5, 1 << 30), r";+$", "")), r"\{"), 1)), r"(::)+$", "")
    script = F.regexp_replace(F.regexp_extract(t, r"(?s)^.* from (.*)$", 1), r"^['\"; ]+|['\"; ]+$", "")
    first = lambda skip: F.regexp_extract(F.substring(t, skip, 1 << 30), r"^\s*(\S*)", 1)
    return (
        F.when(t.startswith("use "), F.trim(use))
        .when(t.startswith("import ") & t.contains(" from "), script)
        .when(t.startswith("from "), first(6))
        .when(t.startswith("import "), F.regexp_replace(first(8), r";+$", ""))
        .otherwise(t)
    )


def tokens(c: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9]+)"), 1)
