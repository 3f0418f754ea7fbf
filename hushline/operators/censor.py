"""Censored and substituted text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import fixed_values as fv, text as T
from hushline.operators import lexicon as L
from hushline.operators.detect import KEYS, MATCH_FIELDS

#: More rows than this in a table of replacements are an error; nothing is cut off.
MOST_REPLACEMENTS = 20_000


def splice(text: Column, edits: Column) -> Column:
    """Replace spans (start_idx, end_idx, put), given in text order; the rest stays."""
    return F.aggregate(
        edits,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, e: F.struct(
            e["end_idx"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start_idx"] - acc["at"]), e["put"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def censor(detected: DataFrame, mark: str = fv.CENSOR_MARK) -> DataFrame:
    """Every match replaced by a mark, also in cues that stay below the threshold."""
    edits = F.transform("matches", lambda m: F.struct(m["start_idx"], m["end_idx"], F.lit(mark).alias("put")))
    text = F.col("text")
    return detected.withColumn("censored_text", F.when(F.size("matches") == 0, text).otherwise(splice(text, edits)))


def gather_matches(cues: DataFrame, matches: DataFrame) -> DataFrame:
    """Match table back to one array per cue, in text order."""
    rows = F.sort_array(F.collect_list(F.struct("start_idx", F.struct(*MATCH_FIELDS).alias("m"))))
    per_cue = matches.groupBy(*KEYS).agg(F.transform(rows, lambda r: r["m"]).alias("matches"))
    return cues.join(per_cue, KEYS, "left").withColumn("matches", F.coalesce("matches", F.expr("array()")))


def all_substitutions(terms: DataFrame, substitutions: DataFrame) -> DataFrame:
    """Every option of every category of the given terms: (term, category, option)."""
    wanted = terms.select(F.lower("term").alias("term")).distinct()
    return wanted.join(L.bounded_broadcast(substitutions), "term").select("term", "category", F.explode("options").alias("option"))


def pick(seed: str, options: Column, *key: Column) -> Column:
    """Repeatable choice: hash of seed and place, modulo the number of options."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])), 1, 8)
    return F.element_at(options, (F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.size(options)) + 1).cast("int"))


@dataclass(frozen=True)
class Replacements:
    """What stands for a normalised word, read once on the driver: the caller's own replacement; emoji for ``monkeys``;
    the category's list or else the silly one; the first root that begins the word, with the rest of it after a dash."""

    own: dict[str, list[str]]
    lists: dict[str, list[str]]
    roots: list[str]
    any_word: list[str] | None = None

    @staticmethod
    def read(substitutions: DataFrame, roots: DataFrame, custom: DataFrame, category: str) -> "Replacements":
        own = {r.term: [r.replacement] for r in L.all_rows(custom, MOST_REPLACEMENTS)}
        if category == "monkeys":
            return Replacements(own, {}, [], list(fv.MONKEYS))
        wanted, found = category if category in fv.SUBSTITUTION_CATEGORIES else "silly", {}
        for r in L.all_rows(substitutions, MOST_REPLACEMENTS):
            of = found.setdefault(r.term.lower(), {})
            of[r.category] = max(of.get(r.category, []), r.options or [])
        lists = {t: of.get(wanted) or of.get("silly") for t, of in found.items()}
        lists = {t: o for t, o in lists.items() if o}
        return Replacements(own, lists, [r.root for r in sorted(L.all_rows(roots, MOST_REPLACEMENTS), key=lambda r: r.root_ord) if r.root in lists])

    def put(self, norm: Column, chosen) -> Column:
        """The replacement of a word; null when nothing fits.  ``chosen`` picks one of an array."""
        array = lambda options: F.array(*map(F.lit, options))
        table = lambda lists: F.create_map(*[c for t, o in lists.items() for c in (F.lit(t), array(o))])
        out = [chosen(F.try_element_at(table(lists), norm)) for lists in (self.own, self.lists) if lists]
        if self.any_word is not None:
            return F.coalesce(*out, chosen(array(self.any_word)))
        for root in self.roots:
            rest = F.concat(chosen(array(self.lists[root])), F.lit("-"), F.substr(norm, F.lit(len(root) + 1)))
            out.append(F.when(norm.startswith(root) & (norm != root), rest))
        return F.coalesce(*out, F.lit(None).cast("string"))


def substitute(
    detected: DataFrame, substitutions: DataFrame, roots: DataFrame, custom: DataFrame, category: str = "silly", seed: str = "0",
) -> DataFrame:
    """Every match replaced by a chosen word, inside the cue's own row: the tables become part of the plan."""
    words, text = Replacements.read(substitutions, roots, custom, category), F.col("text")

    def edit(m: Column) -> Column:
        chosen = lambda options: pick(seed, options, F.col("track_id"), F.col("cue_id"), m["start_idx"])
        put = F.coalesce(words.put(T.normalize_text(m["word"]), chosen), F.lit(fv.CENSOR_MARK))
        return F.struct(m["start_idx"], m["end_idx"], put.alias("put"))

    done = F.when(F.size("matches") == 0, text).otherwise(splice(text, F.transform("matches", edit)))
    return detected.withColumn("censored_text", done)


def resubstitute(
    stored: DataFrame, substitutions: DataFrame, roots: DataFrame, custom: DataFrame, category: str = "silly", seed: str = "0",
) -> DataFrame:
    """Other substitutions for cues that are detected already: findings stay, only ``censored_text`` is made anew from them."""
    return substitute(stored.drop("censored_text"), substitutions, roots, custom, category, seed).select(*stored.columns)
