"""Language codes and names as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hushline.functions import fixed_values as fv, text as T


def _alias_map() -> Column:
    pairs = []
    for code, names in fv.pairs_of(fv.LANGUAGE_ALIASES):
        for name in fv.words_of(names):
            pairs += [F.lit(name), F.lit(code)]
    return F.create_map(*pairs)


def _name_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in fv.pairs_of(fv.LANGUAGE_NAMES) for x in pair])


def language_code(c: Column) -> Column:
    """Two-letter code: a known prefix, else a known alias, else the first two letters."""
    low = T.trim_space(F.lower(c))
    two = F.substring(low, 1, 2)
    known = [code for code, _ in fv.pairs_of(fv.LANGUAGE_ALIASES)]
    return F.when(c.isNull() | (c == ""), "").when(two.isin(known), two).otherwise(F.coalesce(_alias_map()[low], two))


def language_name(c: Column) -> Column:
    """English name of a code by its first five, then first two letters; else the code in capitals."""
    five = F.substring(F.lower(c), 1, 5)
    return F.coalesce(_name_map()[five], _name_map()[F.substring(five, 1, 2)], F.upper(c))


def language_matches(code: Column, preferred: Column) -> Column:
    return F.substring(F.lower(code), 1, 2) == F.substring(F.lower(preferred), 1, 2)


# --- Fixed values: places of a language in a subtitle URL, in order ------------
URL_LANGUAGE = [
    r"[?&]lang=([a-z]{2,3}(?:-[a-z]{2,3})?)",
    r"/([a-z]{2,3})_[a-f0-9]+\.vtt\z",
    r"/([a-z]{2,3})/[^/]+\.(?:vtt|srt|ass)\z",
    r"[_\-.]([a-z]{2,3})\.(?:vtt|srt|ass|ssa)\z",
    r"[_\-.]([a-z]{2,3}(?:-[a-z]{2,3})?)\.(?:vtt|srt|ass|ssa)\z",
]
URL_LANGUAGE_WIDE = [URL_LANGUAGE[0], r"[?&]language=([a-z]{2,3})", *URL_LANGUAGE[1:], r"[_\-]([a-z]{2,3})[._]"]
DATA_KEYS = ["language", "lang", "code", "lc", "srclang"]


def url_language(url: Column, data: Column | None = None, wide: bool = False) -> Column:
    """Language named by a URL, else by a field of ``data`` (a string map), else unknown."""
    found = [F.nullif(F.regexp_extract(url, f"(?i){p}", 1), F.lit("")) for p in (URL_LANGUAGE_WIDE if wide else URL_LANGUAGE)]
    out = [F.lower(f) for f in found]
    if data is not None:
        value = F.coalesce(*[data[k] for k in DATA_KEYS])
        out.append(F.regexp_replace(F.substring(F.lower(value), 1, 3), "-.*", ""))
    return F.coalesce(*out, F.lit("unknown"))
