"""Lexicons, context rules, exempt terms and substitutions as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as P

from hushline.functions import fixed_values as fv, text as T


def all_rows(df: DataFrame, most: int) -> list:
    """All rows of a small table on the driver; an error, never a cut, if it has more than ``most``."""
    rows = rows_up_to(df, most)
    if rows is None:
        raise ValueError(f"a table of at most {most} rows was expected")
    return rows


def rows_up_to(df: DataFrame, most: int) -> list | None:
    """All rows of a table, or nothing if it has more than ``most``; reads no more than that."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def fits(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def bounded_broadcast(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Broadcast hint for a table whose size was checked; a plain table otherwise."""
    return F.broadcast(df) if fits(df, limit) else df


def terms_df(spark: SparkSession, terms: list[str]) -> DataFrame:
    schema = P.StructType([P.StructField("term", P.StringType()), P.StructField("ord", P.IntegerType())])
    return spark.createDataFrame([(t, i) for i, t in enumerate(terms)], schema)


def default_terms(spark: SparkSession) -> DataFrame:
    return terms_df(spark, fv.words_of(fv.DEFAULT_TERMS))


def build_lexicon(terms: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """lexicon(term, norm_term, kind, ord) out of a base list and custom lines.

    A custom line adds its term, or removes it when it begins with a dash.
    Equal normalised terms count once, at their first place.
    """
    base = terms.select("term", "ord")
    if custom is not None:
        lines = custom.select(T.trim_space(F.col("term")).alias("term"), "ord").filter("term <> ''")
        # added terms come after the base list
        added = lines.filter(~F.col("term").startswith("-")).select("term", (F.col("ord") + 1_000_000_000).alias("ord"))
        removed = (
            lines.filter(F.col("term").startswith("-"))
            .select(T.normalize_text(T.trim_space(F.expr("substring(term, 2)"))).alias("norm_term")).distinct())
        base = base.unionByName(added)
    lex = base.withColumn("norm_term", T.normalize_text(F.col("term")))
    lex = lex.groupBy("norm_term").agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord"))
    if custom is not None:
        lex = lex.join(removed, "norm_term", "left_anti")
    kind = F.when(F.instr("norm_term", " ") > 0, "phrase").otherwise("word")
    return lex.select("term", "norm_term", kind.alias("kind"), "ord")


def context_rules(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """context_rules(term, kind, pattern, case_sensitive, ord)."""
    rows = [(t, k, p, c, i) for i, (t, k, p, c) in enumerate(fv.CONTEXT_RULES if rules is None else rules)]
    return spark.createDataFrame(rows, "term string, kind string, pattern string, case_sensitive boolean, ord int")


def exempt_terms(spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
    names = fv.words_of(fv.EXEMPT_TERMS) if terms is None else terms
    return spark.createDataFrame([(t,) for t in names], "term string")


def obfuscated_pattern(letters: str, ending: str = "") -> str:
    """Letters with filler characters between them, on word boundaries."""
    return rf"\b{fv.SPACER.join(letters)}{ending}\b"


def obfuscation_patterns(spark: SparkSession, words: list[tuple] | None = None) -> DataFrame:
    """patterns(term, pattern, letters, ord); a null ``letters`` stands for any other pattern."""
    rows = [(t, obfuscated_pattern(letters, end), letters, i)
            for i, (t, letters, end) in enumerate(fv.OBFUSCATED_WORDS if words is None else words)]
    return spark.createDataFrame(rows, "term string, pattern string, letters string, ord int")


def root_substitutions(spark: SparkSession) -> DataFrame:
    """substitutions(term, category, options): the whole default table, 158 terms in three categories."""
    rows = [(term, c, options) for term, *lists in fv.ROOT_SUBSTITUTIONS for c, options in zip(fv.SUBSTITUTION_CATEGORIES, lists)]
    return spark.createDataFrame(rows, "term string, category string, options array<string>")


def substitution_roots(spark: SparkSession, roots: list[str] | None = None) -> DataFrame:
    names = fv.words_of(fv.SUBSTITUTION_ROOTS) if roots is None else roots
    return spark.createDataFrame([(r, i) for i, r in enumerate(names)], "root string, root_ord int")


def custom_substitutions(lines: DataFrame) -> DataFrame:
    """``word=replacement`` lines to custom(term, replacement); the last line of a word wins."""
    parts = F.split("line", "=", 2)
    rows = lines.filter(F.col("line").contains("=")).select(
        T.normalize_text(T.trim_space(parts[0])).alias("term"), T.trim_space(parts[1]).alias("replacement"), "ord")
    rows = rows.filter("term <> '' and replacement <> ''")
    return rows.groupBy("term").agg(F.max_by("replacement", "ord").alias("replacement"))


def lexicon_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Terms added and removed between two lexicons, whatever their order."""
    a, b = old.select("norm_term"), new.select("norm_term")
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(
        a.exceptAll(b).withColumn("change", F.lit("removed")))
