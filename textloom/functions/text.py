"""Column functions over text: trimming, line splitting, casing, scripts, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace accepts.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Regex classes equal to Python's \s, \w and line separators.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
WORD_CLASS = r"[\p{L}\p{N}_]"
LINE_SEPARATORS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"

RAW_LINE = rf"[^{LINE_SEPARATORS}]*+(?:\r\n|[{LINE_SEPARATORS}])|[^{LINE_SEPARATORS}]++"
LINE_ENDING = r"(?:\r\n|\n|\r)\z"

# Character ranges counted as one script each.
SCRIPT_CLASSES = {
    "cyrillic": r"\x{0400}-\x{04ff}",
    # Letters whose case folding starts with an ASCII letter.
    "latin": (
        r"A-Za-z\x{df}\x{130}\x{17f}\x{1f0}\x{1e96}-\x{1e9a}\x{1e9e}\x{212a}\x{fb00}-\x{fb06}"
    ),
    "cjk": r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}",
    "arabic": r"\x{0600}-\x{06ff}",
}
# Fixed value: non-printing characters removed from extracted text.
NONPRINTING = r"(?![\n\t])[\p{Cc}\p{Cf}\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}]"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def leading_space(col: Column) -> Column:
    return F.substring(col, F.lit(1), F.length(col) - F.length(lstrip(col)))


def trailing_space(col: Column) -> Column:
    return F.substring(col, F.length(rstrip(col)) + 1, F.length(col))


def _only_newlines(text: Column) -> Column:
    """Whether every line break of a text is LF or CRLF; byte searches, no regex."""
    rare = ("\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
    found = F.contains(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"))
    for separator in rare:
        found = found | F.contains(text, F.lit(separator))
    return ~found


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and used several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines as an array of (content, ending); no empty line after a final break.

    Line breaks are those of Python's splitlines. Texts with LF or CRLF alone, which is
    nearly all, are cut at single bytes; the others go through a regex.
    """
    def cut(parts: Column) -> Column:
        last = F.size(parts) - 1

        def one(part: Column, i: Column) -> Column:
            crlf = part.endswith("\r")
            content = F.when(crlf, F.substring(part, F.lit(1), F.length(part) - 1)).otherwise(part)
            ending = F.when(i == last, "").when(crlf, "\r\n").otherwise("\n")
            return F.struct(content.alias("content"), ending.alias("ending"))

        kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), last)).otherwise(
            parts
        )
        return F.transform(kept, one)

    plain = let(F.split(text, "\n", -1), cut)
    rare = F.transform(
        F.regexp_extract_all(text, F.lit(RAW_LINE), F.lit(0)),
        lambda raw: F.struct(
            F.regexp_replace(raw, LINE_ENDING, "").alias("content"),
            F.regexp_extract(raw, LINE_ENDING, 0).alias("ending"),
        ),
    )
    return F.when(_only_newlines(text), plain).otherwise(rare)


# Cherokee is the one script that folds to its capitals: two ranges with constant distance.
_CHEROKEE_SMALL = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_CHEROKEE_LARGE = "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))


def _folded(col: Column) -> Column:
    # Capitals first, as several small forms share one. The capital sharp s has no other capital
    # form; naming it also keeps the two case changes apart, which the optimizer would merge.
    capitals = F.replace(F.upper(col), F.lit("\u1e9e"), F.lit("SS"))
    small = F.replace(F.lower(capitals), F.lit("\u03c2"), F.lit("\u03c3"))
    return F.when(
        F.regexp_like(small, F.lit(r"[\x{13f8}-\x{13fd}\x{ab70}-\x{abbf}]")),
        F.translate(small, _CHEROKEE_SMALL, _CHEROKEE_LARGE),
    ).otherwise(small)


def casefold(col: Column) -> Column:
    """Full case folding of Unicode. The dotless i folds to itself and must not become an i."""
    dotless = "\u0131"
    parts = F.transform(F.split(col, dotless, -1), _folded)
    return F.when(F.contains(col, F.lit(dotless)), F.array_join(parts, dotless)).otherwise(
        _folded(col))


def count_class(col: Column, char_class: str) -> Column:
    """Characters of ``col`` inside a regex class."""
    return F.length(F.regexp_replace(col, f"[^{char_class}]++", ""))


def strip_nonprinting(col: Column) -> Column:
    """Drop control, format and variation-selector characters except newline and tab."""
    return F.regexp_replace(col, NONPRINTING, "")


def code_point_label(char: Column) -> Column:
    """``U+`` and at least four hexadecimal digits."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


# A suffix needs a stem before its dots and text after the last one.
SUFFIX = r"[^./\\]\.*(\.[^./\\]+)\z"
# Bytes a name may have, characters of a cut name and of its suffix.
NAME_BYTES, CUT_NAME, CUT_SUFFIX = 200, 180, 20


def sanitize_filename(col: Column) -> Column:
    """Safe base name over both slash kinds; null when nothing usable remains."""
    base = F.element_at(F.split(F.replace(col, F.lit("\\"), F.lit("/")), "/", -1), -1)
    safe = F.btrim(F.regexp_replace(strip(base), r"[^A-Za-z0-9._ -]", "_"), F.lit(" ."))
    suffix = F.regexp_extract(safe, SUFFIX, 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(suffix))
    short = F.substring(suffix, 1, CUT_SUFFIX)
    bounded = F.concat(
        F.substring(stem, F.lit(1), F.greatest(F.lit(1), F.lit(CUT_NAME) - F.length(short))), short
    )
    return F.when(safe == "", None).when(F.octet_length(safe) > NAME_BYTES, bounded).otherwise(safe)


def file_suffix(name: Column) -> Column:
    """Lower-case suffix without its dot; empty when there is none."""
    return F.lower(F.substring(F.regexp_extract(name, SUFFIX, 1), F.lit(2), F.length(name)))


def normalize_language(col: Column) -> Column:
    """Trim, unify separators, drop empty parts and fold case."""
    parts = F.split(F.replace(strip(col), F.lit("_"), F.lit("-")), "-", -1)
    return casefold(F.array_join(F.filter(parts, lambda p: p != ""), "-"))


def normalize_languages(col: Column) -> Column:
    """Ordered distinct language tags; null marks a request with a bad or empty list."""
    tags = F.transform(F.coalesce(col, F.array().cast("array<string>")), normalize_language)
    bad = (F.size(tags) == 0) | F.exists(tags, lambda t: t.isNull() | (t == ""))
    return F.when(~bad, F.array_distinct(tags))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def parse_iso(col: Column) -> Column:
    return F.to_timestamp(F.regexp_replace(col, "Z$", "+00:00"))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, half to even, never negative."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.greatest(F.lit(0).cast("bigint"), F.bround(micros / 1000.0).cast("bigint"))


def safe_translation(text: Column, in_cell: Column, protect: Column) -> Column:
    """Keep a translation on one line, and inside its cell when it is a table cell."""
    one_line = F.regexp_replace(text, r"[\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+", " ")
    no_pipes = F.when(in_cell, F.replace(one_line, F.lit("|"), F.lit(""))).otherwise(one_line)
    run = F.length(no_pipes) - F.length(F.rtrim(no_pipes, F.lit("\\")))
    return F.when(protect & (run % 2 == 1), F.concat(no_pipes, F.lit("\\"))).otherwise(no_pipes)
