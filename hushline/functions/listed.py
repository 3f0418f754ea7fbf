"""Listed words, phrases and filler patterns in texts, found in one walk over each text's tokens and pieces.

Spark has no expression that gives matches with their offsets; built-in ones cut and fold a text several times for them.  Here an
Arrow function looks at many texts at once: array operations cut all tokens and pieces and hash them, and only those whose hash is
that of a listed one are compared as strings.  Tokens hold ASCII characters only, so lower case and look-alikes are those of
``text.normalize_text``.  Texts with lists of their own, very long ones and those with a character whose lower case is longer are walked one by one.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import fixed_values as fv, text as T
from hushline.functions.spoken import BLOCK, block_ranges, space_table

MATCH_TYPE = "array<struct<word:string,start_idx:int,end_idx:int,type:string,confidence:double,term:string,context:string>>"
LETTERS = "A-Za-z'"
PIECE = rf"[{LETTERS}]+|[{T.WS}\-]+|[^{LETTERS}{T.WS}\-]"
FILLERS = "_-.*@#$&%!?"
#: Remembered forms of tokens in a worker; it starts anew when it holds more.
MOST_KNOWN = 300_000
#: A longer text is walked by itself, which takes less memory than arrays.
MOST_TOGETHER = 2_000_000
#: A hash is the sum of codes times powers of an odd number: those of characters give that of a word, those of pieces that of a run.
CHAR_STEP, PIECE_STEP, MASK = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 2**64 - 1


def phrase_pieces(phrase: str) -> tuple[str, int, str, str]:
    """Canonical text of a phrase, its number of pieces, first and last piece."""
    pieces = [" " if re.fullmatch(rf"[{T.WS}\-]+", p) else p for p in re.findall(PIECE, phrase)]
    return "".join(pieces), len(pieces), pieces[0], pieces[-1]


def _summed(codes, step: int) -> int:
    """The hash of a sequence of codes."""
    out, power = 0, step
    for c in codes:
        out, power = (out + c * power) & MASK, power * step & MASK
    return out


def _marked(hashes: list[int]) -> tuple[np.ndarray, int]:
    """A table that tells whether a hash may be listed, by its first bits, and how far to shift; few that are not are taken for listed."""
    bits = max(16, (16 * len(hashes)).bit_length())
    table = np.zeros(1 << bits, bool)
    table[[h >> (64 - bits) for h in hashes]] = True
    return table, 64 - bits


def norms(text: Column) -> Column:
    """The distinct normalised tokens of a text."""
    token, looks = T.TOKEN, str.maketrans(fv.LOOKALIKE_FROM, fv.LOOKALIKE_TO)

    def run(text: pa.Array) -> pa.Array:
        find = re.compile(token).findall
        rows = [None if t is None else {w.lower().translate(looks) for w in set(find(t))} for t in text.to_pylist()]
        return pa.array([None if r is None else list(r) for r in rows], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def vocabulary(texts: DataFrame) -> DataFrame:
    """(norm): the normalised tokens of all texts in column ``text``, each seldom more than once for each task.

    Tokens hold ASCII characters only, so bytes are folded by one table and cut at all others; no UTF-8 byte above 127 is ASCII.
    """
    most, ranges = MOST_KNOWN, block_ranges(BLOCK)
    looks = str.maketrans(fv.LOOKALIKE_FROM, fv.LOOKALIKE_TO)
    table = bytes(ord(chr(c).lower().translate(looks)) if re.fullmatch(f"[{T.WORD_CHARS}]", chr(c)) and c < 128 else 39 if c == 39 else 32 for c in range(256))

    def run(batches):
        known = set()
        for b in batches:
            texts = [t for t in b.column(0).cast(pa.binary()).to_pylist() if t]
            for first, last in ranges([len(t) for t in texts]):
                # apostrophes join words, but do not begin or end one
                words = {w.strip(b"'") for w in {*b"\n".join(texts[first:last]).translate(table).split()}} - known - {b""}
                if len(known) > most:
                    known.clear()
                known |= words
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string())], ["norm"])

    return texts.select("text").mapInArrow(run, "norm string")


def run_key(n, term):
    """Key of a run of ``n`` pieces: two runs of equal text may differ in pieces where lower case has more characters."""
    return f"{n}:{term}"


def phrase_keys(phrases: Column) -> Column:
    """struct<key, first, n> of phrases, for ``runs`` and ``said``."""
    key_of, split = run_key, phrase_pieces

    def run(phrases: pa.Array) -> pa.Array:
        out = [split(p.strip()) for p in phrases.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([key_of(n, w) for w, n, _, _ in out], pa.string()), pa.array([o[2] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], ["key", "first", "n"])

    return F.arrow_udf(run, "struct<key:string,first:string,n:int>")(phrases)


def runs(text: Column, sizes: list[int], firsts: dict[str, list[int]] | None = None) -> Column:
    """Keys of the distinct runs of pieces, of the given sizes, or of the sizes that go with their first piece."""
    piece, gap, key_of = PIECE, re.compile(rf"[{T.WS}\-]"), run_key

    def run(text: pa.Array) -> pa.Array:
        cut, out = re.compile(piece).findall, []
        for t in text.to_pylist():
            low = [" " if gap.match(p) else p.lower() for p in cut(t or "")]
            out.append(list({key_of(n, "".join(low[i:i + n])) for i, p in enumerate(low) for n in (sizes if firsts is None else firsts.get(p, ())) if i + n <= len(low)}))
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def scanned(term: str, pattern: str, letters: str | None) -> tuple | None:
    """(term, letters, expression over lower-case text) of a pattern of letters with filler, or nothing for any other pattern.

    Only patterns whose meaning is the same here and in the JVM are taken: they begin with a plain character on a word boundary and use no
    other escapes of letters or digits, no intersections, negations, look-around or possessive parts.  The first character leads, so that
    the search can leap to it.
    """
    w = T.WORD_CHARS
    if not letters or not pattern.isascii() or not re.match(r"\\b[A-Za-z0-9](?![?*+{])", pattern) or re.search(r"\\[A-Zac-z0-9]|&&|\[[\^\[\]]|\(\?|[+*?}]\+|#.*\n", pattern):
        return None
    low = pattern[2:].lower()
    tail = rf"(?![{w}])" if re.search(r"[a-z0-9]\\b\Z", low) else None
    body = T.ascii_pattern(low[1:-2], True) + tail if tail else T.ascii_pattern(low[1:], True)
    return term, letters.lower(), rf"{low[0]}(?<![{w}]{low[0]}){body}"


def hits(text: Column, words: list[str] = (), phrases: list[str] = (), near: dict[str, float] | None = None, found: Column | None = None, close: Column | None = None, said: Column | None = None,
         patterns: list[tuple] = ()) -> Column:
    """struct<t, p, r>: matches of tokens, phrases and patterns.

    ``patterns`` are those that ``scanned`` takes.  ``words``, ``near`` (norm to confidence) and ``phrases`` hold for all rows, ``found`` (array of norms), ``close`` (map) and
    ``said`` (array of phrase keys) for their own row.
    """
    token, piece, gap = T.TOKEN, PIECE, re.compile(rf"[{T.WS}\-]")
    looks, around = str.maketrans(fv.LOOKALIKE_FROM, fv.LOOKALIKE_TO), fv.CONTEXT_CHARS
    sure_at, filled_at, most = fv.EXACT_CONFIDENCE, fv.PATTERN_CONFIDENCE, MOST_KNOWN
    no_fillers, ascii_low = str.maketrans("", "", FILLERS), {c: c + 32 for c in range(65, 91)}
    letters = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'")
    listed, nearby = frozenset(words), dict(near or {})
    split = phrase_pieces

    def index(phrases):
        keys, sizes = set(), {}
        for whole, n, first, _ in phrases:
            keys.add((n, whole))
            sizes.setdefault(first, set()).add(n)
        return keys, sizes

    all_said = index(split(p.strip()) for p in phrases)
    ranges, fillers, together, CHAR, PIECES = block_ranges(BLOCK), FILLERS, MOST_TOGETHER, CHAR_STEP, PIECE_STEP
    in_word = np.array([re.fullmatch(f"[{T.WORD_CHARS}]", chr(c)) is not None and c < 127 for c in range(128)])
    norm_code = np.array([ord(chr(c).lower().translate(looks)) for c in range(128)], np.uint64)
    word_table, word_shift = _marked([_summed(map(ord, w), CHAR) for w in {*listed, *nearby}])
    # kinds of characters in pieces: 1 letters, 2 gaps, 3 others; 4 stands between texts
    kinds = np.where(space_table(), 2, 3).astype(np.uint8)
    kinds[45] = 2
    kinds[[ord(c) for c in letters]] = 1
    pieces_of = [[" " if gap.match(p) else p for p in re.findall(PIECE, p.strip())] for p in phrases]
    wide, gap_hash = not all(p.isascii() for p in phrases), np.uint64(_summed([32], CHAR))
    said_sizes = sorted({len(p) for p in pieces_of})
    said_table, said_shift = _marked([_summed([_summed(map(ord, piece), CHAR) for piece in p], PIECES) for p in pieces_of])

    def run(text: pa.Array, *sent: pa.Array) -> pa.Array:
        find, walk, cut = re.compile(token).findall, re.compile(token).finditer, re.compile(piece).findall
        norm_of, plain_of = {}, {}

        def norm(w):
            if len(norm_of) > most:
                norm_of.clear()
            n = norm_of[w] = w.lower().translate(looks)
            return n

        def to_plain(p):
            if len(plain_of) > most:
                plain_of.clear()
            q = plain_of[p] = " " if gap.match(p) else p.lower()
            return q

        def tokens(t, out, own, far):
            if not any((norm_of.get(w) or norm(w)) in own or norm_of[w] in far for w in find(t)):
                return
            for m in walk(t):
                w = m.group()
                n = norm_of.get(w) or norm(w)
                if n in own:
                    out.append((w, m.start(), m.end(), "exact", sure_at, w.lower(), t[max(0, m.start() - around):m.end() + around]))
                elif n in far:
                    out.append((w, m.start(), m.end(), "fuzzy", far[n], w.lower(), t[max(0, m.start() - around):m.end() + around]))

        def places(t, out, keys, sizes):
            raw = cut(t)
            low = [plain_of.get(p) or to_plain(p) for p in raw]
            if sizes.keys().isdisjoint(low):
                return
            at = None
            for i, p in enumerate(low):
                for n in sizes.get(p, ()):
                    term = "".join(low[i:i + n])
                    if i + n > len(low) or (n, term) not in keys:
                        continue
                    at = at or [0, *accumulate(map(len, raw))]
                    a, b = at[i], at[i + n]
                    # a phrase that begins or ends with another character must not touch a letter
                    if (a > 0 and t[a - 1] in letters and t[a] not in letters) or (b < len(t) and t[b] in letters and t[b - 1] not in letters):
                        continue
                    out.append((t[a:b], a, b, "exact", sure_at, term, t[max(0, a - around):b + around]))

        scans = [(s[0], s[1], re.compile(s[2]).finditer) for s in patterns]

        def filled(t, out):
            bare = t.translate(no_fillers).lower()
            some = [s for s in scans if s[1] in bare]
            if some:
                low = t.lower() if t.isascii() else t.translate(ascii_low)
                for term, _, walk in some:
                    for m in walk(low):
                        a, b = m.span()
                        out.append((t[a:b], a, b, "regex", filled_at, term, t[max(0, a - around):b + around]))

        def sums(codes, step):
            """Running sums of codes times powers, and the factors that make a difference of two the hash of what lies between."""
            n = len(codes) + 1
            if step not in powers or len(powers[step][0]) < n:
                up, down = np.full(n, step, np.uint64), np.full(n, pow(step, -1, 2**64), np.uint64)
                up[0], down[0] = 1, step
                powers[step] = np.multiply.accumulate(up), np.multiply.accumulate(down)
            out = np.zeros(n, np.uint64)
            np.cumsum(codes * powers[step][0][:n - 1], out=out[1:])
            return out, powers[step][1]

        def runs_of(mask):
            """Starts and ends of the runs of true values; the last value is false."""
            edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
            edges = np.concatenate([[0], edges]) if mask[0] else edges
            return edges[::2], edges[1::2]

        def many(first, texts):
            """Matches of texts that have no lists of their own."""
            sep = next(c for c in map(chr, range(10, 0x110000)) if not any(c in t for t in texts) and c not in fillers and kinds[min(ord(c), 65_535)] != 1 and not in_word[min(ord(c), 127)] and c == c.lower())
            whole = sep.join([*texts, ""])
            small = whole.encode().lower().decode()  # lower case of ASCII letters alone
            raw, low = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (whole, small))
            offsets = [0, *accumulate(len(t) + 1 for t in texts)]
            where = np.array(offsets)

            def put(k, at, found):
                """Matches of kind ``k``: (word, start, end, type, confidence, term) at places of ``whole``."""
                of = np.searchsorted(where, at, "right") - 1
                for i, (w, a, b, kind, sure, term) in zip(of.tolist(), found, strict=True):
                    base = offsets[i]
                    rows[k].append((w, a - base, b - base, kind, sure, term, whole[max(base, a - around):min(offsets[i + 1] - 1, b + around)]))
                    owner[k].append(first + i)

            if listed or nearby:
                plain = np.minimum(low, 127)
                starts, ends = runs_of(in_word[plain])
                if len(starts):
                    # apostrophes alone between two runs make them one token
                    quotes = np.cumsum(low == 39)
                    joined = quotes[starts[1:] - 1] - quotes[ends[:-1] - 1] == starts[1:] - ends[:-1]
                    starts, ends = starts[np.append(True, ~joined)], ends[np.append(~joined, True)]
                    total, back = sums(norm_code[plain], CHAR)
                    may = word_table[((total[ends] - total[starts]) * back[starts]) >> word_shift]
                    at, found = [], []
                    for a, b in zip(starts[may].tolist(), ends[may].tolist(), strict=True):
                        w = whole[a:b]
                        n = norm_of.get(w) or norm(w)
                        if n in listed or n in nearby:
                            at.append(a)
                            found.append((w, a, b, *(("exact", sure_at) if n in listed else ("fuzzy", nearby[n])), w.lower()))
                    put(0, at, found)
            if all_said[1]:
                kind = kinds[np.minimum(raw, 65_535)]
                kind[where[1:] - 1] = 4
                starts = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 3)))
                code = low.astype(np.uint64)
                if wide:
                    other = np.flatnonzero(raw > 127)
                    values, back_to = np.unique(raw[other], return_inverse=True)
                    code[other] = np.array([ord(chr(c).lower()) for c in values.tolist()], np.uint64)[back_to]
                else:
                    code[raw == 0x212A] = 107  # the one other character with an ASCII lower case
                code[where[1:] - 1] = 0x110000
                total, back = sums(code, CHAR)
                ends = np.append(starts[1:], len(raw))
                piece_hash = (total[ends] - total[starts]) * back[starts]
                piece_hash[kind[starts] == 2] = gap_hash
                total, back = sums(piece_hash, PIECES)
                bounds, found = np.append(starts, len(raw)), []
                for n in said_sizes:
                    if n >= len(total):
                        continue
                    may = np.flatnonzero(said_table[((total[n:] - total[:-n]) * back[:len(total) - n]) >> said_shift])
                    for a, b in zip(bounds[may].tolist(), bounds[may + n].tolist(), strict=True):
                        w = whole[a:b]
                        if sep in w:
                            continue
                        term = said_of.get(w)
                        if term is None:
                            if len(said_of) > most:
                                said_of.clear()
                            parts = [plain_of.get(p) or to_plain(p) for p in cut(w)]
                            term = said_of[w] = "".join(parts)
                        if (n, term) not in all_said[0]:
                            continue
                        if (a > 0 and whole[a - 1] in letters and w[0] not in letters) or (whole[b:b + 1] in letters and w[-1] not in letters):
                            continue
                        found.append((w, a, b, "exact", sure_at, term))
                found.sort(key=lambda m: m[1:3])
                put(1, [m[1] for m in found], found)
            if scans:
                bare = whole
                for c in fillers:
                    bare = bare.replace(c, "")
                at, found = [], []
                for base, t, l, bare in zip(offsets, texts, small.split(sep), bare.lower().split(sep)):
                    for term, needed, walk in scans:
                        if needed in bare:
                            for m in walk(l):
                                a, b = m.span()
                                at.append(base + a)
                                found.append((t[a:b], base + a, base + b, "regex", filled_at, term))
                put(2, at, found)

        powers, said_of, rows, owner = {}, {}, ([], [], []), ([], [], [])
        texts = text.to_pylist()
        lists = [None, None, None]
        for k, c in zip(given, sent):
            lists[k] = c.to_pylist()
        alone = {i for i, t in enumerate(texts) if t and (len(t) > together or "\u0130" in t or any(c and c[i] for c in lists))}
        for a, b in ranges([len(t or "") for t in texts]):
            many(a, ["" if i in alone else texts[i] or "" for i in range(a, b)])
        for i in sorted(alone):
            mine, far, told = (c[i] if c else None for c in lists)
            keys, sizes = index((w, int(n), cut(w)[0], None) for n, w in (k.split(":", 1) for k in told)) if told else all_said
            own, far = (frozenset(mine) if mine else listed), (dict(far) if far else nearby)
            for k, (wanted, walk_of) in enumerate(((own or far, lambda t, o: tokens(t, o, own, far)), (sizes, lambda t, o: places(t, o, keys, sizes)), (scans, filled))):  # noqa: B023
                if wanted:
                    walk_of(texts[i], rows[k])
                    owner[k].extend([i] * (len(rows[k]) - len(owner[k])))
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
        names = ["word", "start_idx", "end_idx", "type", "confidence", "term", "context"]
        made = []
        for k in range(3):
            of = np.array(owner[k], np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
            got = [rows[k][i] for i in np.argsort(of, kind="stable").tolist()] if alone else rows[k]
            columns = zip(*got, strict=True) if got else [[]] * len(types)
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, d) for c, d in zip(columns, types, strict=True)], names)))
        return pa.StructArray.from_arrays(made, ["t", "p", "r"])

    # no nulls are sent for lists: after each row Spark asks for the size of its batch, which for a list is a walk over all nulls since the last value
    none = F.array().cast("array<string>")
    empty = none, F.map_from_arrays(none, F.array().cast("array<double>")), none
    own = {k: F.coalesce(c, empty[k]) for k, c in enumerate((found, close, said)) if c is not None}
    given = list(own)
    return F.arrow_udf(run, f"struct<t:{MATCH_TYPE},p:{MATCH_TYPE},r:{MATCH_TYPE}>")(text, *own.values())
