"""N-gram join, substring dedup, top-k, near vectors, mixing and the pipeline, by brute force."""

import collections
import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from convolake.llm import mixing, mtree, near_vectors, ngram_join, queries, substring_dedup
from convolake.llm import words as W
from convolake.llm.components import components
from convolake.llm.scratch import Scratch, forget_results

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a


def jaccard_groups(texts, n, percent):
    """{row: (set size, smallest row reached)} of a list of texts."""
    sets = []
    for text in texts:
        ws = WORD.findall(lower(text or ""))
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    groups = Sets(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
    return {i: (len(s), groups.top(i)) for i, s in enumerate(sets)}


def removal(texts, window):
    ws = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def documents(spark, sf=SF):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [r["doc_id"] for r in rows], [r["text"] for r in rows]


@pytest.fixture
def copies(spark):
    """Near copies, copies, odd texts, repeated and missing ids, an extra column."""
    draw = np.random.default_rng(2)
    base = [f"w{x}" for x in draw.integers(0, 500, 300)]
    texts = [" ".join(base)]
    for i in range(40):
        changed = list(base)
        for at in draw.integers(0, 300, i % 8):
            changed[at] = f"new{draw.integers(0, 10**6)}"
        texts.append(" ".join(changed))
    texts += [None, "", " \n", "one", "One", "two words", texts[3], texts[3], "z " * 4000, "common passage " * 30 + "tail", "y" * 40_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, node int")


# -- words ----------------------------------------------------------------------

def test_words_and_their_hashes():
    import pyarrow as pa

    texts = ["a b\tc", None, "", "  lead", "Ab aB \x0b\x0c\r\n x", "é 日本 " * 3, "q" * 100, "a b"]
    seen = {}
    for row, end, data, at in W.chunks(pa.array(texts)):
        starts, ends, first = W.spans(data, at)
        for i in range(row, end):
            own = slice(first[i - row], first[i - row + 1])
            ws = [bytes(data[s:e]).decode() for s, e in zip(starts[own], ends[own])]
            assert ws == WORD.findall(texts[i] or "")
            for w, h in zip(ws, W.hashes(data, starts, ends)[own].tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 5000)]
    with Scratch(spark) as scratch:
        found = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert {found[i] for i in range(101)} == {0} and {found[1000 + i] for i in range(51)} == {1000}


# -- n-gram join ------------------------------------------------------------------

@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_links_as_brute_force(spark, copies, n, percent):
    texts, docs = copies
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(docs, ngram_join.Rule(n, percent)).collect()}
    assert got == jaccard_groups(texts, n, percent)


def test_links_of_all_documents(spark):
    ids, texts = documents(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op5_ngram_jaccard_join"](spark, SF).collect()}
    assert got == {ids[i]: (size, ids[top]) for i, (size, top) in jaccard_groups(texts, 3, 90).items()}


def test_join_odd_tables(spark, copies):
    _, docs = copies
    rule = ngram_join.Rule(3, 90)
    assert ngram_join.jaccard_groups(docs.limit(0), rule).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "e f g h"), (2, "e f g h"), (3, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(odd, rule).collect())
    assert rows == [(-1, 2, None), (2, 2, 2), (3, 0, 3), (5, 2, 2), (5, 2, 5), (5, 2, 5)]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in ngram_join.keep_one_of_each(odd, rule).where("text is not null").collect())
    assert kept == [(2, "e f g h"), (5, "a b c d")]  # a single row of each group
    extra = odd.withColumns({"own_id": F.lit(1), "component": F.lit("x"), "rows": F.lit(None).cast("int")})
    assert ngram_join.keep_one_of_each(extra, rule).columns == extra.columns
    assert ngram_join.keep_one_of_each(extra, rule).count() == 3 and ngram_join.keep_one_of_each(odd.limit(0), rule).count() == 0


def test_sets_of_one_node_stay_apart(spark, monkeypatch):
    real = ngram_join.signatures
    monkeypatch.setattr(ngram_join, "signatures", lambda *given: real(*given).withColumn("node", F.when(F.col("node").isNotNull(), F.lit(7).cast("long"))))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "v w x y z"), (3, "a b c d e"), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_groups(docs, ngram_join.Rule(3, 90)).collect())
    assert got == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_many_leaders_and_the_product_agree(spark, copies):
    texts, docs = copies
    rule = ngram_join.Rule(3, 90)
    with Scratch(spark) as scratch:
        sides = [sorted(map(tuple, ngram_join.link_components(docs, rule, scratch, leader_turns=n)[1].collect())) for n in (0, 1, 3)]
    links = [{n: c for n, c in rows if n != c} for rows in sides]
    assert links[0] == links[1] == links[2] and links[0]


def test_only_shared_columns_and_texts_of_their_rows_move(spark, copies):
    texts, docs = copies
    rule = ngram_join.Rule(3, 90)
    lonely = [(1000 + i, " ".join(f"u{i}x{k}" for k in range(50)), 1) for i in range(200)] + [(None, texts[1], 1), (2000, texts[5], 1)]
    docs = docs.unionByName(spark.createDataFrame(lonely, docs.schema))
    with Scratch(spark) as scratch:
        signed, repeated = ngram_join._apart(scratch.table(ngram_join.signatures(docs, rule, ngram_join.gram_counters(docs, rule))), scratch)
        prefixes, size, reps = {}, {}, {}
        for r in signed.where("node is not null and doc_id is not null").collect():
            prefixes[r["node"]], size[r["node"]] = np.frombuffer(bytes(r["prefix"]), np.uint64).tolist(), r["n_shingles"]
            reps[r["node"]] = min((r["doc_id"], r["text_key"]), reps.get(r["node"], (r["doc_id"], r["text_key"])))
        rows_of = collections.Counter(g for grams in prefixes.values() for g in grams)
        shared = {n: [(g, pos) for pos, g in enumerate(grams) if rows_of[g] > 1] for n, grams in prefixes.items()}
        want = {(g, n, pos, len(grams)) for n, grams in shared.items() if len(grams) >= size[n] * rule.percent // 4000 + 1 for g, pos in grams}
        classes = ngram_join._classes(signed, repeated, scratch)
        met = ngram_join._met_columns(classes, 1 << 20)
        assert met.has(*ngram_join._short_keys(np.array([g for g, n in rows_of.items() if n > 1], np.uint64))).all()
        index = scratch.table(ngram_join._index(classes, rule, met))
        got = [(r["gram"] % 2**64, r["node"], r["pos"], r["columns"]) for r in index.collect()]
        assert want and len(got) == len(want) and set(got) == want
        able = scratch.table(ngram_join._able(classes, index))
        assert {(r["node"], r["rep_id"], r["rep_key"]) for r in able.collect()} == {(n, *reps[n]) for _, n, _, _ in want}
        moved = ngram_join._texts(docs, able).collect()
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert {r["node"]: r["text"] for r in moved} == {n: text[reps[n][0]] for _, n, _, _ in want} and len(moved) == len({n for _, n, _, _ in want})
        # the rows of a column meet once: leaders need no rows by node
        led = ngram_join._led(ngram_join._open_columns(index, None), rule, 0)
        assert "hashpartitioning(node" not in led._jdf.queryExecution().toString()


def test_columns_as_steps():
    draw = np.random.default_rng(3)
    short = draw.integers(0, 1 << ngram_join.SHORT, 5000, dtype=np.uint64)
    short = np.concatenate([short, short[:100], short[:50], np.array([0, 0, 0, (1 << ngram_join.SHORT) - 1], np.uint64)])
    import pyarrow as pa

    got = collections.Counter()
    for row in ngram_join._steps(short).to_pylist():
        steps = np.frombuffer(pa.decompress(row["raw"], 4 * row["n"], codec="zstd"), np.uint8).reshape(4, -1)
        rest = np.cumsum(np.ascontiguousarray(steps.T).view("<u4").reshape(-1), dtype=np.uint64)
        got.update((np.uint64(row["bucket"] << (ngram_join.SHORT - ngram_join.BUCKET_BITS)) | rest).tolist())
    assert got == {k: min(n, 2) for k, n in collections.Counter(short.tolist()).items()}
    assert ngram_join._steps(short[:0]).num_rows == 0


# -- substring dedup ----------------------------------------------------------------

def test_texts_of_one_id_and_one_short_hash(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = spark.range(500_000).select(F.concat(F.lit(passage + " x"), "id").alias("text"))
    short = spark.range(500_000).select(F.concat(F.lit("short y"), "id").alias("other"))
    both = long.join(short, F.hash("text") == F.hash("other")).orderBy("text").head()
    docs = spark.createDataFrame([(7, both["text"]), (7, both["other"]), (8, passage)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.removal_digests(docs, window=35).collect())
    assert got == [(7, 2, 0), (7, 61, 60), (8, 60, 60)]



@pytest.mark.parametrize("window,start", [(35, 18), (50, 10), (7, 7), (8, 2), (1, 1)])
def test_removal_as_brute_force(spark, copies, window, start):
    texts, docs = copies
    rows = substring_dedup.removal_digests(docs, window, start).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert got == dict(enumerate(removal(texts, window)))


def test_removal_of_all_documents(spark):
    ids, texts = documents(spark)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op6_substring_dedup"](spark, SF).collect()}
    assert got == dict(zip(ids, removal(texts, 35)))


def test_windows_of_one_short_hash_stay_apart(spark):
    rows = [(5, 1, 1, 0, 0, 1), (5, 2, 2, 0, 0, 1), (6, 3, 1, 0, 4, 1), (6, 3, 2, 0, 9, 1)]
    level = spark.createDataFrame(rows, "h long, g int, doc long, tag int, pos int, weight int")
    with Scratch(spark) as scratch:
        assert {r["doc"]: r["at"] for r in substring_dedup._repeated(level, scratch).collect()} == {1: [4], 2: [9]}
    again, lead = substring_dedup._within(np.zeros(4, np.int64), np.array([5, 5, 6, 6]), np.array([1, 2, 3, 3]))
    assert again.tolist() == [False, False, True, True] and lead.tolist() == [False, False, True, False]


def test_cut_texts_keep_their_layout(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"Head\n\n{passage}\tmid  end", "s", 0), (2, f"{passage} x", None, 0), (3, None, "s", None), (None, "short", "s", 1), (4, f"a {passage}", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string, n_chars long")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, 50).collect()}
    assert got[1]["text"] == "Head\n\nmid  end" and got[1]["n_chars"] == 14 and got[1]["at"] == "s"
    assert got[2]["text"] == "x" and got[3]["text"] is None and got[None]["text"] == "short" and got[4]["text"] == "a "
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_and_longest_repeats(spark):
    text = " ".join(f"w{i}" for i in range(45))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " a b c"), (3, "none")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.removal_digests(docs, 10, 5).collect()} == {(1, 45), (2, 45), (3, 0)}
    assert {r["doc_id"]: r["longest"] for r in substring_dedup.longest_repeats(docs, 10, 5).collect()} == {1: 40, 2: 40}


# -- vectors --------------------------------------------------------------------

@pytest.fixture
def vectors(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(0, 1, (60, 16))
    rows = [(i, (base[i % 60] + draw.normal(0, 0.02 * (i % 5), 16)).astype(float).tolist(), i % 3) for i in range(600)]
    rows += [(600, rows[0][1], 0), (601, rows[0][1], 0), (650, None, 0), (700, [], 1), (750, [0.0] * 16, 0), (800, [float("nan")] * 16, 0),
             (850, [None] + [1.0] * 15, 0), (900, rows[1][1], None), (None, rows[0][1], 0), (950, [1.0, 2.0], 0), (951, [1.0, 2.0], 0), (3, rows[3][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_top_k_as_brute_force(spark, vectors):
    rows, table = vectors
    fine = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in fine:
        if q % 50 == 0:
            scores = sorted((-int(v @ u), i) for i, u in fine if i != q and len(u) == len(v))[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    got = [tuple(r) for r in mtree.top_k(table, 5, 256, 50).collect()]
    assert sorted(got) == sorted(want)
    assert mtree.top_k(table.limit(0)).count() == 0


def test_tree_leaves_distances_out():
    draw = np.random.default_rng(4)
    v = np.concatenate([c + draw.normal(0, 3, (400, 8)) for c in draw.normal(0, 200, (10, 8))]).round()
    square = float((v**2).sum(1).max())
    root = mtree._lift(v[:1], square)[0]
    pages = mtree.build_pages(np.arange(len(v)), v, root, square)
    assert sum(len(p["ids"]) for p in pages) == len(v)
    done = []
    for q in range(0, 4000, 200):
        best, computed = mtree.search(pages, root, v[q], q, 5, square, float("inf"))
        scores = sorted(((int(s), -i) for i, s in enumerate(v @ v[q]) if i != q), reverse=True)[:5]
        assert sorted(((s, -i) for s, i in best), reverse=True) == scores
        done.append(computed)
    assert np.mean(done) < 0.6 * len(v)


def brute_links(rows, least):
    fine = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows)
            if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    groups, links = Sets(range(len(rows))), collections.Counter()
    for a, (k, _, v, lab) in enumerate(fine):
        for k2, _, u, lab2 in fine[:a]:
            if lab == lab2 and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                links[k] += 1
                links[k2] += 1
                groups.join(k, k2)
    least_id = {}
    for k, i, _, _ in fine:
        least_id[groups.top(k)] = min(i, least_id.get(groups.top(k), i))
    return sorted((-1 if i is None else i, links[k], -1 if i is None else least_id.get(groups.top(k), i)) for k, (i, _, _) in enumerate(rows))


def test_near_vectors_as_brute_force(spark, vectors, monkeypatch):
    rows, table = vectors
    monkeypatch.setattr(near_vectors, "BLOCK", 8)  # buckets in blocks
    got = near_vectors.near_duplicates(table, 0.98).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute_links(rows, 0.98)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert near_vectors.near_duplicates(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(5)
    v = draw.normal(0, 1, (500, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    turned, signs, factors = near_vectors.codes(v)
    truth = v @ v.T
    estimate = turned @ signs.T / (8 * factors[None, :])
    off = ~np.eye(500, dtype=bool)
    assert abs((estimate - truth)[off].mean()) < 0.002
    assert (truth <= near_vectors.upper_bounds(turned, signs, factors) + 1e-9)[off].mean() > 0.9999


def test_recall_of_bands():
    bits, number = near_vectors.bands(0.98, 10**9)
    agree = (1 - np.arccos(0.98) / np.pi) ** bits
    assert (1 - agree) ** number <= near_vectors.MISS


# -- mixing ---------------------------------------------------------------------

def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_of_all_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = queries.QUERIES["op10_mixing"](spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {d: len(WORD.findall(r["text"] or "")) for d, r in docs.items()}
    sources = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size[d] for d, r in docs.items() if r["source"] == s) for s in sources}
    target, free, left = {}, set(sources), 1.5 * sum(size.values())
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * total[s]}
        if not over:
            target |= part
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    taken = collections.Counter()
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    largest = {s: max(size[d] for d, r in docs.items() if r["source"] == s) for s in sources}
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sources)
    again = queries.QUERIES["op10_mixing"](spark.newSession(), sf)
    assert sorted(map(tuple, again.repartition(3).collect())) == sorted(map(tuple, rows))


def test_blocks_fly_on(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    docs = mixed(spark, [(i, "w " * (1 + i * 7 % 50), "ab"[i % 5 == 0]) for i in range(2000)])
    rows = mixing.mix_report(docs, mixing.repeating_weights(5, 2, 1)).collect()
    assert len(rows) == 2000
    for target in {r["target"] for r in rows}:
        assert abs(sum(r["taken"] for r in rows if r["target"] == target) - target) <= 100


def test_flight_keeps_both_totals():
    draw = np.random.default_rng(6)
    sizes, p = draw.integers(1, 1000, 3000), draw.random(3000)
    flown = mixing.fly(p, sizes, 1, land=False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(p.sum()) and flown @ sizes == pytest.approx(p @ sizes)
    landed = mixing.fly(p, sizes, 1, land=True)
    assert set(np.unique(landed)) == {0, 1}
    mean = np.mean([mixing.fly(np.full(9, 0.3), np.arange(9), s, True) for s in range(3000)], 0)
    assert np.allclose(mean, 0.3, atol=0.05)


def test_mix_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (3, "other", None), (None, "p q", "b"), (4, "w " * 5000, "b")]
    docs = mixed(spark, rows)
    report = mixing.mix_report(docs, mixing.repeating_weights(1), share=2.0).collect()
    assert sorted((r["size"], r["taken"]) for r in report) == [(0, 0), (0, 0), (1, 2), (2, 4), (3, 6), (3, 6), (5000, 10000)]
    out = mixing.mix(docs, mixing.repeating_weights(1), share=2.0)
    assert out.columns == docs.columns
    assert out.where("text = 'x y z'").count() == 4 and out.where("doc_id is null").count() == 2
    empty = docs.where("doc_id = 77")
    assert mixing.mix(empty, mixing.repeating_weights(1)).count() == 0 and mixing.mix_report(empty, mixing.repeating_weights(1)).count() == 0


# -- pipeline -------------------------------------------------------------------

def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    with Scratch(spark) as scratch:
        clean = scratch.table(corpus_pipeline.drop_toxic(spark, docs, SF))
        assert clean.columns == docs.columns and 0.8 * len(given) < clean.count() <= len(given)
        single = scratch.table(corpus_pipeline.drop_near_copies(spark, clean, SF))
        rows = clean.orderBy("doc_id").collect()
        groups = jaccard_groups([r["text"] for r in rows], 5, 80)
        assert {r["doc_id"] for r in single.collect()} == {rows[i]["doc_id"] for i, (_, top) in groups.items() if top == i}
        cut = scratch.table(corpus_pipeline.drop_repeated_passages(spark, single, SF))
        rows = single.orderBy("doc_id").collect()
        for r, want in zip(cut.orderBy("doc_id").collect(), removal([r["text"] for r in rows], 50)):
            words = WORD.findall(r["text"])
            assert len(words) == want[0] - want[1] and hashlib.sha256(" ".join(words).encode()).hexdigest() == want[2]
            assert r["n_chars"] == len(r["text"])
        mix = scratch.table(corpus_pipeline.mix_sources(spark, cut, SF))
        assert mix.columns == docs.columns and mix.groupBy("doc_id").count().agg(F.max("count")).head()[0] <= 2
        tokens = corpus_pipeline.encode_tokens(spark, mix, SF)
        assert tokens.count() == mix.count() and tokens.where("n_tokens <> size(ids)").count() == 0


def test_scratch_leaves_only_results(spark):
    from convolake.session import ensure_checkpoint_dir

    root = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders():
        return {str(s.getPath().getName()) for s in files.listStatus(root) if s.getPath().getName().startswith("llm-")}

    forget_results(spark)
    before = folders()
    queries.QUERIES["op6_substring_dedup"](spark, SF).count()
    assert len(folders() - before) == 1
    assert forget_results(spark) == 1 and folders() == before
