"""SimHash groups, decontamination, packing and the pipeline, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hushline.llm import decontaminate, near_copies, packing, simhash
from hushline.llm.queries import vocabulary

EXTRA = {"fp": 1, "key": 2, "row": 3, "text_hash": 4, "n": 5, "ids": 6, "hits": 7, "w": 8, "component_id": 9}


def with_clashes(df):
    for k, v in EXTRA.items():
        df = df.withColumn(k, F.lit(v))
    return df


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(pairs):
    """Component ids of (id, fingerprint) pairs by comparing all with all."""
    low = [i for i, _ in pairs]
    while True:
        new = [min(low[b] for b in range(len(pairs)) if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 2) for a in range(len(pairs))]
        if new == low:
            return low
        low = new


def near_groups(texts):
    """Group (smallest id) of each id, by the similarity of all pairs of texts that share a shingle."""
    sets, holders, first, root = {}, {}, {}, {i: i for i in texts}
    for i, t in sorted(texts.items()):
        w = (t or "").encode().lower().split()
        grams = frozenset(b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        root[i] = first.setdefault(grams, i)
        if root[i] == i:
            sets[i] = grams
            for g in grams:
                holders.setdefault(g, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {(a, b) for held in holders.values() for x, a in enumerate(held) for b in held[x + 1:]}:
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: top(i) for i in texts}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_near_copies_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = near_groups({r.doc_id: r.text for r in docs.collect()})
    found = near_copies.groups(docs)
    first = found.groupBy("group").agg(F.min("doc_id").alias("low"))
    assert {r.doc_id: r.low for r in found.join(first, "group").collect()} == want


def test_near_copies_of_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = [None, "", " \n", "One", "one", "two words", "x " * 30_000]
    for k in range(90):  # a chain of edits whose ends have little in common, and copies of its members
        base[rng.randrange(300)] = f"v{k}"
        texts += [" ".join(base)] * (1 + k % 2)
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join([f"q{k}x{i}" for i in range(20)] + passage) for k in range(80)]  # a passage that many share
    frame = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = near_groups(dict(enumerate(texts)))
    for tile, small in ((1024, 32), (8, 0)):
        monkeypatch.setattr(near_copies, "TILE", tile)
        monkeypatch.setattr(near_copies, "SMALL", small)
        found = near_copies.groups(frame)
        kept = simhash.one_of_each(frame, found)
        assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == frame.columns
    assert near_copies.groups(frame.where("false")).count() == 0


def test_pairs_without_the_leader_are_found_in_tiles(spark):
    rng = random.Random(3)
    core = [f"c{k}" for k in range(200)]
    rows = []
    for k in range(40):  # neighbours are similar, the bucket's lowest key is similar to few
        words = core[:]
        for p in range(k, k + 6):
            words[p * 4 % 200] = f"e{p}"
        rows.append((k, " ".join(words)))
    rng.shuffle(rows)
    want = near_groups(dict(rows))
    found = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), found).collect()} == set(want.values())


def test_simhash_groups(spark):
    rng = random.Random(1)
    long = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    texts = [None, "", " \n", "One", "one", "two words", "x " * 30_000]
    for k in range(120):
        copy = list(long)
        for _ in range(k % 6):
            copy[rng.randrange(900)] = f"v{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(4, "one")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = simhash.components(docs, tile=16)
    pairs = [(i, fingerprint(t)) for i, t in rows]
    want = sorted(zip([i for i, _ in pairs], [f"{f:016x}" for _, f in pairs], groups(pairs), strict=True))
    assert sorted(map(tuple, got.select("doc_id", simhash.hex_of(F.col("fp")), "component_id").collect())) == want
    kept = simhash.one_of_each(docs, simhash.components(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want}) and kept.columns == docs.columns
    again = spark.createDataFrame([(5, "text a"), (5, "text b"), (3, "text a"), (None, "text c"), (None, "text c"), (5, "text b")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(again, simhash.components(again)).collect()), key=str) == [(3, "text a"), (5, "text b"), (None, "text c")]
    assert simhash.components(docs.where("false")).count() == 0


def test_tile_links_join_what_all_pairs_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(3), base ^ np.uint64(1 << 40)]))
    links = simhash.tile_links(fps, None)
    assert len(links) == len(fps) - 40  # one tree for each group


def test_decontamination_of_odd_rows(spark):
    long = [f"b{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "Short item, three!"), (3, None), (4, "..."), (10, "short item three"), (5, "É ü"), (6, " ".join(long))], "item_id long, text string")
    docs = [None, "", "a b c", "xx SHORT-item;three yy", " ".join(long[5:18]), " ".join(long[5:17]), " ".join(["pad"] * 400 + long[3:20] + ["pad"] * 9), "word " * 60_000 + "é ü", "É ü", "b5 b6",
            "pad " * 300 + " ".join(long[:13]), "short item three short item three"]
    frame = with_clashes(spark.createDataFrame(list(enumerate(docs)) + [(3, docs[3]), (None, "short item three"), (3, "other text")], "doc_id long, text string"))
    found = decontaminate.contamination(frame, items)
    got = sorted(((r.doc_id, r.n_words, len(r.hits), r.items, r.bad) for r in found.withColumn("bad", decontaminate.contaminated(found)).collect()), key=str)
    short, both = ["10", "2"], ["1", "6"]
    want = [(0, 0, 0, [], False), (1, 0, 0, [], False), (2, 3, 0, [], False), (3, 5, 3, short, True), (3, 5, 3, short, True), (3, 2, 0, [], False), (4, 13, 13, both, True), (5, 12, 0, [], False),
            (6, 426, 17, both, False), (7, 60_002, 0, [], False), (8, 2, 2, ["5"], True), (9, 2, 0, [], False), (10, 313, 13, both, False), (11, 6, 6, short, True), (None, 3, 3, short, True)]
    assert got == sorted(want, key=str)
    assert decontaminate.clean(frame, items).columns == frame.columns and decontaminate.clean(frame, items).count() == 9
    for a, b in ((frame.where("false"), items), (frame, items.where("false"))):
        assert decontaminate.contamination(a, b).count() == a.count() == decontaminate.clean(a, b).count()


def test_every_shared_span_has_a_common_fingerprint(spark):
    rng = random.Random(7)
    span = [f"s{rng.randint(0, 50)}" for _ in range(decontaminate.SPAN)]
    rows = [(i, " ".join([f"l{i}"] * (i % 9) + span + [f"r{i}"] * (i % 5))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(0, " ".join(["q"] * 4 + span + ["z"] * 20))], "item_id long, text string"))
    assert all(len(r.hits) == decontaminate.SPAN for r in found.collect())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "Hello world", "naïve  café\n\n😀 don't 12345", "<|endoftext|> x", "word " * 9000, "same", "same"] + [f"text number {i} " * (i % 50) for i in range(120)]
    docs = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    packed = packing.pack(docs, vocabulary())
    rows = packed.collect()
    coder = Tokenizer.from_file(vocabulary())
    want = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert got.setdefault(r.doc_id, 0) == r.start and r.doc_tokens == len(want[r.doc_id])
        assert bytes(r.ids) == want[r.doc_id][r.start:r.start + r.length].tobytes()
        got[r.doc_id] += r.length
    assert got == {i: len(w) for i, w in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id, r.offset) == divmod(at, 2048) and r.offset + r.length <= 2048
        at += r.length
    whole = packing.sequences(packed).orderBy("sequence_id").collect()
    assert sum(s.n_tokens for s in whole) == at and all(len(s.ids) == 2048 or len(s.ids) & (len(s.ids) - 1) == 0 for s in whole)
    assert packing.pack(docs.where("false"), vocabulary()).count() == 0
    null_id = packing.pack(spark.createDataFrame([(None, "a"), (2**53 + 1, "b")], "doc_id long, text string"), vocabulary()).collect()
    assert {r.doc_id for r in null_id} == {None, 2**53 + 1}


@pytest.mark.parametrize("bits, dims", [(3, 2), (2, 4), (3, 3)])
def test_hilbert_curve_visits_neighbours(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(keys)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            left[name] = {r.doc_id: r.text for r in docs.collect()}
    lines = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    for i, t in left["toxicity"].items():
        for x in t.split("\n"):
            if len(key(x).decode()) >= 20:
                lines.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(lines.get(key(x), ())) >= 3 and max(lines[key(x)]) != i
    assert left["line_dedup"] == {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in left["toxicity"].items()}
    assert left["near_dedup"].keys() == set(near_groups(left["line_dedup"]).values())
    word = lambda t: "".join(c if c.isdigit() and c < "\x80" or c >= "\x80" or "a" <= c <= "z" else " " for c in t.encode().lower().decode()).split(" ")
    split = lambda t: [w for w in word(t) if w]
    tests = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        tests |= {tuple(w[k:k + 13]) for k in range(max(1, len(w) - 12))}
    sizes, clean = {len(t) for t in tests}, set()
    for i, t in left["near_dedup"].items():
        w, hit = split(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in tests:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert left["decontamination"].keys() == clean
    tokens = {}
    for r in docs.collect():
        assert 0 < r.length <= 2048
        tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert tokens.keys() == clean and all(sum(n for _, n, _ in v) == v[0][2] for v in tokens.values())
