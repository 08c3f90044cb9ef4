"""Scalar column functions: names, paths, splits, seasons, words and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, FILE_SUFFIXES, SPLIT_RANK, Thresholds

MISSING = "<MISSING>"
#: Line ends of Unicode text; a carriage return and line feed are one.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"
URL = r"(?i)https?://\S+|www\.\S+"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def sanitize_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), 1, 120)


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/]*$", 0)


def extension(c: Column) -> Column:
    """Last suffix in lower case; null for none and for dot files."""
    return F.nullif(F.lower(F.regexp_extract(c, r"[^/.](\.[^./]+)$", 1)), F.lit(""))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def looks_like_path(c: Column) -> Column:
    known = "|".join(x[1:] for x in FILE_SUFFIXES)
    return c.rlike(r"^(/|\./|\.\./|~|[A-Za-z]:[\\/])") | F.lower(c).rlike(rf"\.({known})$") | c.contains("/") | c.contains("\\")


def to_number(c: Column) -> Column:
    """Numbers as doubles, null for what doesn't read as one; a trailing type letter is no number."""
    trimmed = F.trim(c.cast("string"))
    value = F.when(~trimmed.rlike("[dDfF]$"), trimmed).try_cast("double")
    return F.when(~F.isnan(value), value)


def path_tokens(c: Column) -> Column:
    """Lower-case tokens of a path, without single characters and numbers."""
    return F.filter(F.split(F.lower(c), r"[\\/._\-\s]+"), lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$"))


def segment_prefix(c: Column) -> Column:
    """Stem without a closing _<number>; null where there is none."""
    return F.nullif(F.regexp_extract(stem(c), r"^(.+)_\d+$", 1), F.lit(""))


def split_rank(c: Column) -> Column:
    name, out = F.lower(F.trim(c)), F.lit(99)
    for k in (2, 1, 0):
        out = F.when(name.isin(*[n for n, r in SPLIT_RANK.items() if r == k]), F.lit(k)).otherwise(out)
    return out.cast("long")


def season(c: Column) -> Column:
    m = F.month(c)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "autumn")


def to_datetime(c: Column) -> Column:
    formats = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+", " "))


def sentences(c: Column) -> Column:
    """Sentences of a text, cut after . ! ? before blanks; a text without a cut is one."""
    return F.filter(F.split(normalize_whitespace(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def lines(c: Column) -> Column:
    """Lines of a text; a closing line end opens no further one."""
    cut = F.split(c, LINE_END)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def syllables(c: Column) -> Column:
    """Groups of vowels of a word, less a silent closing e, one at least; 0 without letters a-z."""
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    return F.when(letters == "", 0).otherwise(F.greatest(F.when(letters.endswith("e") & (groups > 1), groups - 1).otherwise(groups), F.lit(1))).cast("long")


def relative_duration(start: Column, end: Column, frames: Column) -> Column:
    return F.try_divide(end - start, frames)


def length_bucket(n: Column) -> Column:
    return F.when(n <= 50, "very_short").when(n <= 200, "short").when(n <= 1000, "medium").when(n > 1000, "long")


def risk_level(score: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.when(score >= t.risk_high, "high").when(score >= t.risk_medium, "medium").otherwise("low")


def or_missing(c: Column, mark: str = MISSING) -> Column:
    return F.coalesce(c.cast("string"), F.lit(mark))


def finite(c: Column) -> Column:
    """A number, null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]
