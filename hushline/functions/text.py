"""Column functions over text: cleaning, tokens with offsets, syllables, times.

All functions take and return Columns, use built-in expressions only and never
shuffle.  Offsets are 0-based code points, ends are exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from hushline.functions import fixed_values as fv

WS = fv.WHITESPACE
WORD_CHARS = "0-9A-Za-z_"
# ASCII word boundary.  The plain \b of the JVM also knows non-ASCII letters.
BOUNDARY = rf"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))"
# What begins with a word character: one that must be there, or a group of such alternatives.
_FIRST = r"[A-Za-z0-9](?![?*{])"
_WAY = rf"{_FIRST}(?:\\[bs]|[^()\[\]\\|])*"
_OPENS = re.compile(rf"({_FIRST})|\((?:\?:)?({_WAY}(?:\|{_WAY})*)\)(?![?*{{])")
# Same language as \b[\w']+\b under the ASCII rule, without look-around.
TOKEN = rf"[{WORD_CHARS}]+(?:'+[{WORD_CHARS}]+)*"
SPAN_TYPE = "array<struct<word:string,start_idx:int,end_idx:int>>"


def ascii_pattern(pattern: str, case_sensitive: bool = False) -> str:
    """Rewrite \\b and \\s of a pattern so that the JVM matches them as documented."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            # where a word character follows, it is looked at first, and the one before it only then
            opens = _OPENS.match(pattern, i + 2)
            firsts = "".join(sorted({way[0] for way in (opens[1] or opens[2]).split("|")})) if opens else ""
            out.append(rf"(?=[{firsts}])(?<![{WORD_CHARS}])" if opens else BOUNDARY)
            i += 2
        elif two == r"\s":
            out.append(WS if in_class else f"[{WS}]")
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            if two[:1] == "[":
                # a bracket inside a class must be escaped for the JVM
                out.append(r"\[" if in_class else "[")
                in_class = True
            else:
                in_class = in_class and two[:1] != "]"
                out.append(two[:1])
            i += 1
    return ("" if case_sensitive else "(?i)") + "".join(out)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(rf"\A[{WS}]*\z")


def _decode_once(c: Column) -> Column:
    # the ampersand goes last, so that one pass decodes one level only
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")]:
        c = F.regexp_replace(c, f"(?i)&{name};", char)
    return c


def clean_text(c: Column) -> Column:
    """Decode entities up to three levels deep, drop tags, squeeze white space."""
    decoded = c
    for _ in range(3):
        decoded = _decode_once(decoded)
    # almost all cues hold neither entity nor tag
    cleaned = F.regexp_replace(decoded, r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>", "")
    cleaned = F.regexp_replace(cleaned, r"<[^>]*>", "")
    cleaned = F.when(c.rlike("[&<]"), cleaned).otherwise(c)
    return trim_space(F.regexp_replace(cleaned, rf"[{WS}]+", " "))


def sanitize_text(c: Column) -> Column:
    """Strip markup (also unclosed), override tags, control characters and U+FFFD."""
    c = F.regexp_replace(c, r"<[^>]*>?", "")
    c = F.regexp_replace(c, r"\{\\[^}]*\}", "")
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F" + chr(0xFFFD) + "]", "")


def normalize_text(c: Column) -> Column:
    return F.translate(F.lower(c), fv.LOOKALIKE_FROM, fv.LOOKALIKE_TO)


def words(c: Column) -> Column:
    """Tokens of a text, in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# start offset of every step out of (gap before it, own length); appending copies
# the growing array, so long texts are folded block by block
_FOLD = """aggregate({steps}, named_struct('at', {at}, 'starts', cast(array() AS array<int>)), (acc, s) -> named_struct(
    'at', acc.at + s.g + s.w, 'starts', concat(acc.starts, array(acc.at + s.g))))"""
_STARTS = """CASE WHEN size(steps) <= 64 THEN {short}.starts ELSE aggregate(
    transform(sequence(0, cast(floor((size(steps) - 1) / 64) AS int)), b -> b * 64 + 1),
    named_struct('run', named_struct('at', 0, 'starts', cast(array() AS array<int>)), 'done', cast(array() AS array<array<int>>)),
    (blocks, first) -> named_struct('run', {block}, 'done', concat(blocks.done, array(blocks.run.starts))),
    blocks -> flatten(concat(blocks.done, array(blocks.run.starts)))) END""".format(
    short=_FOLD.format(steps="steps", at="0"), block=_FOLD.format(steps="slice(steps, first, 64)", at="blocks.run.at"))


def spans(name: str, pattern: str) -> Column:
    """All matches of a pattern in a column, left to right, with their offsets.

    The engine returns matched strings only; the text between them comes from
    ``split`` with the same pattern, so a running sum of lengths gives offsets.
    An array of one element binds a value that is used more than once.  Written
    as SQL text, which is planned much faster than nested Python lambdas.
    """
    p = sql_string(pattern)
    return F.expr(f"""
        element_at(transform(array(named_struct('w', regexp_extract_all({name}, {p}, 0), 'g', split({name}, {p}, -1))), z -> zip_with(
            z.w,
            element_at(transform(array(zip_with(slice(z.g, 1, size(z.w)), z.w, (g, w) -> named_struct('g', length(g), 'w', length(w)))), steps -> {_STARTS}), 1),
            (w, at) -> named_struct('word', w, 'start_idx', at, 'end_idx', at + length(w)))), 1)""")


def token_spans(name: str) -> Column:
    return spans(name, TOKEN)


def space_words(c: Column) -> Column:
    """White-space separated words, empty ones dropped."""
    return F.filter(F.split(c, rf"[{WS}]+", -1), lambda w: w != "")


def syllables(c: Column) -> Column:
    """Estimated syllables of one word."""
    trimmed = trim_space(F.lower(c))
    letters = F.regexp_replace(trimmed, "[^a-z]", "")
    groups = F.size(F.regexp_extract_all(letters, F.lit("[aeiouy]+"), F.lit(0)))
    count = groups - F.when(letters.endswith("e") & (groups > 1), 1).otherwise(0)
    count = count + F.when(letters.rlike(r"[^aeiouy]le\z"), 1).otherwise(0)
    return (
        F.when(c.isNull() | (c == ""), 0)
        .when(F.length(trimmed) <= 2, 1)
        .when(letters == "", 1)
        .otherwise(F.greatest(F.lit(1), count))
    )


def total_syllables(c: Column) -> Column:
    return F.aggregate(F.transform(space_words(c), syllables), F.lit(0), lambda a, s: a + s)


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_time(ms: Column) -> Column:
    """Milliseconds as m:ss, or h:mm:ss from one hour on."""
    total = F.floor(ms / 1000)
    hours = F.floor(total / 3600)
    minutes = F.floor(F.pmod(total, F.lit(3600)) / 60)
    seconds = F.pmod(total, F.lit(60))
    return F.when(
        hours > 0, F.concat(hours.cast("string"), F.lit(":"), _pad2(minutes), F.lit(":"), _pad2(seconds))
    ).otherwise(F.concat(minutes.cast("string"), F.lit(":"), _pad2(seconds)))


def parse_time(c: Column) -> Column:
    """mm:ss or hh:mm:ss as milliseconds, else null.  Leading digits of a part count."""
    parts = F.transform(
        F.split(c, ":", -1),
        lambda p: F.regexp_extract(p, rf"\A[{WS}]*([+-]?\d+)", 1).try_cast("bigint"),
    )
    valid = F.forall(parts, lambda p: p.isNotNull())
    seconds = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p)
    return F.when(valid & F.size(parts).isin(2, 3), seconds * 1000)


def vtt_time(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm."""
    ms = ms.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(ms / 3600000),
        F.floor(F.pmod(ms, F.lit(3600000)) / 60000),
        F.floor(F.pmod(ms, F.lit(60000)) / 1000),
        F.pmod(ms, F.lit(1000)),
    )


def mask_word(c: Column) -> Column:
    """First and last letter with stars between; up to two letters stay as they are."""
    n = F.length(c)
    return F.when(n <= 2, c).otherwise(
        F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(c, -1, 1))
    )


def excerpt(c: Column, n: int, more: str = "...") -> Column:
    """First n characters, with a mark when something was left out."""
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, more).otherwise(""))
