"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from fixed patterns with checks (Luhn, parts of an address, numbers of digits).  Further candidates come
from wider patterns and from names of a gazetteer.  Labelers of three sorts (pattern, gazetteer, context) vote on each
candidate or abstain.  Expectation-maximisation over the vote patterns, of which there are at most ``3 ** labelers``
whatever the input, estimates each labeler's reliability and the probability of each pattern.  These soft labels train a
naive Bayes classifier over hashed features of the span and its surroundings, and the candidates that it accepts are
added to the base spans.  A candidate that overlaps a base span is dropped.

Offsets are code points.  Matches are located by putting a mark on both sides of each and adding up the lengths between
marks; a mark that occurs in the text is first replaced by a character that no pattern takes.

Edge cases: a null text is empty; a text without digits, ``@`` or gazetteer names costs one test; repeated rows get their
own results; without candidates no model is trained; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hushline.llm.common import stored, text_of

MARK, NEUTRAL = "\ue000", "\ufffd"
KINDS = ["email", "ip", "card", "phone", "secret", "name"]
BUCKETS = 4_096
ACCEPT = 0.5
EM_ROUNDS = 50

# The possessive forms match the same spans as greedy ones, as what follows them never fits inside, and need no backtracking;
# a local part or number is tried from its start (or the end of the last match) only, as a later start fails the same way.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}

# The gazetteers.
FIRST_NAMES = ["Alice", "Anna", "Carlos", "Claire", "Daniel", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Juan", "Julia", "Karl", "Laura",
               "Lucas", "Maria", "Marie", "Martin", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Thomas"]
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private_key"]
CONTACT_WORDS = ["call", "phone", "tel", "telephone", "mobile", "cell", "fax", "contact", "email", "e-mail", "mail", "write to", "reach"]
PERSON_WORDS = ["mr", "mrs", "ms", "dr", "prof", "name", "dear", "herr", "frau", "monsieur", "madame", "señor", "señora"]
PUBLIC_WORDS = ["sha1", "sha256", "md5", "checksum", "commit", "digest", "uuid", "version", "isbn", "issn", "doi", "serial", "order", "invoice", "part no"]

_SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}+"
_LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[-.\x20][0-9]{3}[-.\x20][0-9]{4}(?![0-9])"
_LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++"
_NUMBER = r"(?<![0-9A-Za-z])[0-9]{12,19}+(?![0-9A-Za-z])"
_NAME = rf"\b(?:{'|'.join(FIRST_NAMES)})\x20\p{{Lu}}\p{{Ll}}++"
CANDIDATE = "|".join((_SECRET, _LOOSE_PHONE, _LOOSE_EMAIL, _NUMBER, _NAME))


def _cut(text: Column, pattern: str) -> Column:
    """The text in pieces, of which every second one is a match; always an odd number."""
    return F.split(F.regexp_replace(F.translate(text, MARK, NEUTRAL), F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK)


def _matches(pieces: Column, with_context: bool = False) -> Column:
    """start, end, value (and what stands before and after) of every second piece."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    sums = lambda all: F.aggregate(all, none, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])

    def one(all: Column, starts: Column, i: Column) -> Column:
        value = F.get(all, i)
        around = [F.lower(F.right(F.get(all, i - 1), F.lit(32))).alias("before"), F.lower(F.left(F.get(all, i + 1), F.lit(16))).alias("after")] if with_context else []
        return F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(value)).alias("end"), value.alias("value"), *around)

    # pieces and their sums are bound to variables, so that each is made once
    bound = F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), F.when(F.size(p) > 1, sums(p)).alias("s")))
    many = lambda b: F.when(F.size(b["p"]) > 1, F.transform(F.sequence(F.lit(1), F.size(b["p"]) - 2, F.lit(2)), lambda i: one(b["p"], b["s"], i)))
    return F.get(F.transform(bound, many), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, d(i)).otherwise(2 * d(i) - F.when(d(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind: int, start, end>>, kind an index into KINDS."""
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def of(kind: str, pattern: str) -> Column:
        good = F.filter(F.coalesce(_matches(_cut(text, pattern)), F.array().cast("array<struct<start:int,end:int,value:string>>")), lambda m: _holds(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(text.rlike(needs[kind]), spans).otherwise(empty)

    return F.concat(*[of(k, p) for k, p in BASE.items()])


def candidates(text: Column) -> Column:
    """Wider matches with what stands around them; null where there are none."""
    return F.when(text.rlike(rf"[0-9@]|\(at\)|\[at\]|{'|'.join(FIRST_NAMES)}"), _matches(_cut(text, CANDIDATE), with_context=True))


def located(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (row, doc_id, base, found): base spans, and the candidates that overlap none of them."""
    whole = text_of(docs, text)
    rows = docs.select(docs[id].alias("doc_id"), base_spans(whole).alias("base"), candidates(whole).alias("found"))
    free = F.filter("found", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", free.alias("found")), "spans")


# --- labelers ---

def _any(words: list[str]) -> str:
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])"


def _kind(value: Column) -> Column:
    """Index into KINDS of a candidate, by its form."""
    return (F.when(value.rlike(r"\(at\)|\[at\]"), KINDS.index("email")).when(value.rlike(r"^[0-9]{12,19}$"), KINDS.index("card"))
            .when(value.rlike(r"^\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}$"), KINDS.index("phone")).when(value.rlike(r"\d"), KINDS.index("secret")).otherwise(KINDS.index("name")))


def votes(c: DataFrame) -> dict[str, Column]:
    """Labelers by name: 1 personal, -1 not, 0 no opinion; from the columns kind, value, before and after."""
    kind = lambda *names: F.col("kind").isin([KINDS.index(n) for n in names])
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    n = F.length("value")
    return {
        "form": vote(kind("phone", "email") | kind("secret") & c["value"].rlike("^([0-9a-f]{32,}|[0-9A-F]{32,})$"), kind("card") & ~luhn(_digits(c["value"]))),
        "mixture": vote(kind("secret") & c["value"].rlike("[a-z]") & c["value"].rlike("[A-Z]") & c["value"].rlike("[0-9]") & (n >= 20), kind("secret") & c["value"].rlike("^[0-9]{4}-?[0-9]{2}-?[0-9]{2}|(.)\\1{7}")),
        "secret_words": vote(kind("secret") & c["before"].rlike(_any(SECRET_WORDS))),
        "names": vote(kind("name")),
        "public_words": vote(F.lit(False), c["before"].rlike(_any(PUBLIC_WORDS))),
        "contact_words": vote(kind("phone", "email", "card") & c["before"].rlike(_any(CONTACT_WORDS))),
        "person_words": vote(kind("name") & c["before"].rlike(_any(PERSON_WORDS) + r"[.:]?\s*$")),
        "assigned": vote(kind("secret") & c["before"].rlike("[=:]\\s*[\"']?$"), kind("card", "secret") & c["before"].rlike(r"[\p{L}\p{N}][.,]?\s+$") & c["after"].rlike(r"^\s")),
    }


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = EM_ROUNDS) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Probability of each vote pattern, and per labeler the chance of each vote in both classes, from pattern counts.

    Two classes, labelers independent given the class; it starts from the majority of votes, and a prior that favours
    labelers which are right more often than not keeps the classes from changing places.
    """
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p, _ in patterns}
    total, rates = sum(n for _, n in patterns), []
    for _ in range(rounds):
        mass = sum(post[p] * n for p, n in patterns)
        share, rates = (mass + 1) / (total + 2), []
        for j in range(len(patterns[0][0]) if patterns else 0):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            seen[1][1] += 3
            seen[-1][0] += 3
            for p, n in patterns:
                seen[p[j]][1] += n * post[p]
                seen[p[j]][0] += n * (1 - post[p])
            sums = [sum(s[k] for s in seen.values()) for k in (0, 1)]
            rates.append({v: (s[0] / sums[0], s[1] / sums[1]) for v, s in seen.items()})
        for p, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(r[v][1] / r[v][0]) for r, v in zip(rates, p, strict=True))
            post[p] = 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))
    return post, rates


# --- the final classifier ---

def _features() -> Column:
    """Hashed features of a candidate: its form, length, and the characters and word next to it."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    word = F.regexp_extract("before", r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1)
    named = {"kind": F.col("kind").cast("string"), "shape": F.left(shape, F.lit(12)), "length": F.least(F.length("value"), F.lit(64)).cast("string"), "word": word,
             "left": F.regexp_replace(F.right("before", F.lit(2)), r"[\p{L}\p{N}]", "a"), "right": F.regexp_replace(F.left("after", F.lit(2)), r"[\p{L}\p{N}]", "a")}
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), v), F.lit(BUCKETS)) for k, v in named.items()])


def added_spans(spans: DataFrame) -> DataFrame:
    """(row, kind, start, end, probability) of the candidates that the classifier accepts."""
    spark = spans.sparkSession
    c = spans.select("row", F.explode("found").alias("c")).select("row", "c.*")
    c = c.withColumn("kind", _kind(F.col("value")))
    cast = votes(c)
    c = stored(c.select("row", "kind", "start", "end", F.array(*[v.cast("int") for v in cast.values()]).alias("votes"), _features().alias("features")), "candidates")
    patterns = [(tuple(r["votes"]), float(r["count"])) for r in c.groupBy("votes").count().collect()]  # at most 3 ** 8 rows
    if not patterns:
        return c.select("row", "kind", "start", "end", F.lit(0.0).alias("probability"))
    post, _ = expectation_maximisation(sorted(patterns))
    soft = F.broadcast(spark.createDataFrame([(list(p), q) for p, q in post.items()], "votes array<int>, soft double"))
    labelled = c.join(soft, "votes")
    counts = labelled.select("soft", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("soft").alias("yes"), F.sum(1 - F.col("soft")).alias("no"))
    t = labelled.agg(F.sum("soft"), F.sum(1 - F.col("soft"))).first()
    weight = F.log((F.col("yes") + 0.5) / (t[0] + 1)) - F.log((F.col("no") + 0.5) / (t[1] + 1))
    model = F.broadcast(stored(counts.select("feature", weight.alias("weight")), "model"))  # at most BUCKETS rows
    scored = c.select("row", "kind", "start", "end", F.explode("features").alias("feature")).join(model, "feature")
    odds = scored.groupBy("row", "kind", "start", "end").agg(F.sum("weight").alias("w"))
    prior = math.log((t[0] + 1) / (t[1] + 1))
    return odds.select("row", "kind", "start", "end", (1 / (1 + F.exp(-(F.col("w") + prior)))).alias("probability")).where(F.col("probability") >= ACCEPT)


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) per document: arrays of (start, kind, end) in order of start, then kind."""
    spans = located(docs, id, text)
    more = added_spans(spans).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    out = spans.select("row", "doc_id", F.array_sort(base).alias("base")).join(more, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))


def listed(spans: Column | str) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def counted(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def masked(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of documents with distinct ids, with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*map(F.lit, KINDS))
    joined = docs.join(found.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans")), docs[id].eqNullSafe(F.col("_id")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substr(text_of(joined, text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    spans = F.coalesce("_spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    out = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text_of(joined, text), acc["at"] + 1)))
    return joined.select(*[(out.alias(c) if c == text else joined[c]) for c in docs.columns])
