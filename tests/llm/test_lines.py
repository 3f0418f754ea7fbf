"""Line rules and line deduplication: odd rows, and an index that can be undone."""

import hashlib
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from hushline.llm import line_dedup, line_rules

LONG = "a line that many documents share"
ODD = "doc_id long, text string, source string, row int, dropped string, lines string, n_lines int, host string, key int"


def odd(spark):
    texts = [None, "", "\n\n", LONG, f"{LONG.upper()}  \nown words here", f"\t{LONG}\nx\n{LONG}", "x" * 200_000, f"{LONG}\nlast", "é" * 20, "é" * 20 + " ", "É" * 20]
    rows = [(i, t, "s", 1, "d", "l", 9, "h", 7) for i, t in enumerate(texts)] + [(None, LONG, None, 1, "d", "l", 9, "h", 7)] * 2 + [(7, f"{LONG}\nlast", "s", 1, "d", "l", 9, "h", 7)]
    return spark.createDataFrame(rows, ODD)


def brute(rows):
    """Kept text per (id, text) by the contract; ids of null are one document that is never the largest."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(id)
    out = {}
    for id, text in rows:
        lines = (text or "").split("\n")
        last = lambda k: max(i for i in held[k] if i is not None)
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and last(key(x)) != id)]
        out[id, text] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_of_odd_rows(spark):
    docs = odd(spark)
    got = line_dedup.LineIndex.build(docs).clean(docs)
    assert [c for c in docs.columns if c not in ("n_lines", "dropped")] + ["n_lines", "n_dropped"] == got.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = got.join(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).distinct(), F.expr("doc_id <=> i")).collect()
    assert len(rows) == docs.count()
    assert all((r.n_lines, r.n_dropped, r.text or "") == want[r.doc_id, r.t] for r in rows)


def test_empty_tables(spark):
    docs = odd(spark).where("false")
    assert line_dedup.LineIndex.build(docs).clean(docs).count() == 0
    assert line_rules.judge_lines(docs).count() == 0


def test_index_is_reversible(spark):
    line = lambda k: f"line number {k} of the documents"
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join(line(int(k)) for k in rng.integers(0, 60, 12))) for i in range(80)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    table = lambda index: sorted(map(tuple, index.refs.select("k1", "k2", "n_docs", "last_doc").collect()))
    first, more = rows[:50], rows[45:]
    base = line_dedup.LineIndex.build(frame(first))
    grown = base.insert(frame(more))  # five documents are known already
    assert table(grown) == table(line_dedup.LineIndex.build(frame(rows)))
    shrunk = grown.delete(frame(rows[50:]))
    assert table(shrunk) == table(base)
    assert shrunk.postings.count() == base.postings.count()
    keys = base.refs.select("k1", "k2")
    assert shrunk.probe(keys).where("not known").count() == 0
    never = spark.range(5000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(3)).alias("k2"))
    assert shrunk.probe(never).where("known").count() < 50
    gone = grown.delete(frame(rows))
    assert gone.refs.count() == 0 and gone.postings.count() == 0
    assert gone.probe(keys).where("known").count() == 0  # every mark was taken out


def test_results_come_through_the_filters(spark):
    docs = spark.createDataFrame([(i, f"{LONG}\nown line of document number {i}") for i in range(40)], "doc_id long, text string")
    first, more = docs.where("doc_id < 20"), docs.where("doc_id >= 20")
    base = line_dedup.LineIndex.empty(spark, 1).insert(first)
    right = base.insert(more).clean(docs)
    assert right.where("n_dropped = 1").count() == 39
    # a filter that knows nothing makes every key new, and the shared line is counted in two rows
    blind = replace(base, filters=base.filters.select("shard", F.unhex(F.repeat(F.lit("00"), F.octet_length("cells").cast("int"))).alias("cells")))
    assert blind.insert(more).refs.count() == base.insert(more).refs.count() + 1
    assert blind.insert(more).clean(docs).where("n_dropped = 1").count() != 39


def test_shards_grow_and_others_stay(spark):
    docs = spark.createDataFrame([(i, f"own line of document number {i}\n{LONG}") for i in range(300)], "doc_id long, text string")
    small = line_dedup.LineIndex.empty(spark, 1, keys_per_shard=10).insert(docs.where("doc_id < 100"))
    assert 9 <= small.shards <= 13 and small.filters.count() <= small.shards
    one = small.insert(docs.where("doc_id = 200"))
    cells = lambda index: {r.shard: bytes(r.cells) for r in index.filters.collect()}
    assert one.shards == small.shards and sum(cells(one)[k] != v for k, v in cells(small).items()) <= 1
    wide = one.insert(docs)
    assert wide.shards > 30 and max(r["count"] for r in wide.refs.groupBy("shard").count().collect()) < 40
    table = lambda index: sorted(map(tuple, index.refs.select("k1", "k2", "n_docs", "last_doc").collect()))
    assert table(wide) == table(line_dedup.LineIndex.build(docs)) == table(wide.insert(docs))
    assert wide.probe(wide.refs.select("k1", "k2")).where("not known").count() == 0


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(f"doc-{i:03d}", f"{LONG}\nx") for i in range(9)], "doc_id string, text string")
    got = line_dedup.LineIndex.build(docs).clean(docs)
    assert {r.doc_id: r.text for r in got.collect()} == {f"doc-{i:03d}": "x" if i < 8 else f"{LONG}\nx" for i in range(9)}


def test_cuckoo_filter_is_full_and_exact():
    rng = np.random.default_rng(2)
    k1, k2 = rng.integers(0, 2**63, (2, 13_000)).astype(np.uint64)
    table = line_dedup._new_table(13_000)
    assert line_dedup.cuckoo_add(table, k1, k2) and (table > 0).sum() == 13_000
    assert line_dedup.cuckoo_has(table, k1, k2).all()
    line_dedup.cuckoo_drop(table, k1[:6000], k2[:6000])
    assert line_dedup.cuckoo_has(table, k1[6000:], k2[6000:]).all() and (table > 0).sum() == 7000


def test_line_rules_of_odd_rows(spark):
    docs = odd(spark)
    got = {(r.doc_id, r.text_hash): r for r in line_rules.judge_lines(docs, max_docs=3).collect()}
    texts = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert got.keys() == texts.keys()
    shared = {k for k, t in texts.items() if t and LONG in t.lower() and k[0] is not None}
    assert len(shared) == 4  # more than three documents of host "s"
    for k, r in got.items():
        text = texts[k] or ""
        assert r.n_words == len(text.encode().split()) and r.n_removed_words == (6 * text.lower().count(LONG) if k in shared else 0)
        assert r.depleted == (r.n_removed_words > 0 and r.n_words - r.n_removed_words < 0.5 * r.n_words)
    kept = line_rules.remove_lines(docs, line_rules.judge_lines(docs, max_docs=3))
    assert kept.columns == docs.columns
    assert all(k.doc_id is None or LONG not in (k.text or "").lower() for k in kept.collect())
    assert kept.where("doc_id is null").count() == 2


def test_repeated_words():
    count = lambda t: line_rules.repeated_words(t.encode().split())
    assert (count(""), count("a b c"), count("a a a a"), count("a b c x a b c"), count("a b c a b c a")) == (0, 0, 4, 6, 7)


def test_hash_is_of_text(spark):
    cleaned = line_dedup.LineIndex.build(odd(spark)).clean(odd(spark))
    sha = cleaned.where("doc_id = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256)).first()[0]
    assert sha == hashlib.sha256(b"").hexdigest()
