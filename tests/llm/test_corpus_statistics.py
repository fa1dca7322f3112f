"""Chunked BPE, source divergence and collocations against the library and plain loops."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from convolake.llm import chunked_bpe, collocations, divergence
from convolake.llm.key_filter import KeyFilter, key_filter
from convolake.llm.scratch import Scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")


def digests(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("It's ", "ÉCOLE ", "naïve, ", "日本語、", "x9. ", "H̱o ", "<|endoftext|>", "tab\t", "\x0b ") for b in ("um", "don't ", "12 ")]
    base = "".join(words[i] for i in draw.integers(0, len(words), 3000))
    return [base, base, base[:7000] + " changed " + base[7000:], "head " + base[4000:], base.replace(" ", "_"), base.replace(" ", "_"),
            "q" * 60_000, "q" * 60_000, "日本" * 9000, "日本" * 9000, " " * 5000, " " * 5000, "é" * 3000, None, "", "one", "One <|endoftext|> more"]


@pytest.mark.parametrize("n_bits", [1 << 25, 1 << 9])
def test_ids_are_the_library_s(spark, texts, monkeypatch, n_bits):
    """Also when the filter is full, so that every chunk travels."""
    monkeypatch.setattr(chunked_bpe, "FILTER_BITS", n_bits)
    monkeypatch.setattr("convolake.llm.key_filter.SLICES", 4)
    docs = spark.createDataFrame([(i, t, i, b"") for i, t in enumerate(texts)] + [(None, "again", 1, b""), (0, "again", 1, b"")],
                                 "doc_id long, text string, row int, ids binary").repartition(3)
    rows = chunked_bpe.round_trip_digests(docs, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    want = collections.Counter((i, *digests(t, library)) for i, t in [*enumerate(texts), (None, "again"), (0, "again")])
    assert collections.Counter(map(tuple, rows)) == want


def test_chunks_follow_content(texts):
    raw = [t.encode() for t in texts if t]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    chunks = []
    for r, ends in zip(raw, chunked_bpe.cuts(data, at)):
        parts = [r[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(parts) == r and all(p.decode() and len(p) <= chunked_bpe.MOST for p in parts)
        chunks.append(parts)
    assert chunks[0] == chunks[1] and len(set(chunks[0]) & set(chunks[2])) > 0.7 * len(chunks[0]) and len(set(chunks[0]) & set(chunks[3])) > 5


def test_shared_chunks_are_encoded_once(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    with Scratch(spark) as scratch:
        shared = spark.sparkContext.broadcast(chunked_bpe.shared_chunks(docs))
        parts = scratch.table(chunked_bpe._parts(docs, WORDS, shared))
        named = parts.where("first is not null").select("first", "second")
        assert chunked_bpe._encoded_chunks(parts, WORDS).count() == named.distinct().count() < named.count()


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, np.array([49407, 7, 60_000], "<u4").tobytes()), (2, b""), (3, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in chunked_bpe.decode(rows, WORDS).collect()}
    library = Tokenizer.from_file(WORDS)
    assert got == {1: library.decode([49407, 7], skip_special_tokens=False), 2: "", 3: ""}


def test_filter_finds_what_was_put_in(spark):
    keys = spark.range(-500, 500).selectExpr("xxhash64(id) as first", "xxhash64(id, 1) as second")
    known = key_filter(keys, 1 << 16)
    first, second = (np.array([r[i] for r in keys.collect()]) for i in (0, 1))
    assert known.has(first, second).all() and all(known.has_one(a, b) for a, b in zip(first[:50].tolist(), second[:50].tolist()))
    assert known.has(first + 12345, second).mean() < 0.1 and KeyFilter.empty(1 << 16).united(known) == known


# -- divergence and collocations ------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark):
    draw = np.random.default_rng(9)
    said = ["new york city hall", "new york", "hall of fame, of course", "Ünder Wasser", "a.b!c\nd", "the the the the the", "état-major", "x" * 40, "x" * 40 + "y"]
    rows = []
    for i in range(400):
        some = [said[j] for j in draw.integers(0, len(said), 6)] + [f"w{draw.integers(0, 400)}q"]
        rows.append((i % 390, " ".join(some), [None, "en", "de", ""][i % 4], [None, "s1", "s2", "é", ""][int(draw.integers(0, 5))], "z"))
    rows += [(1, None, "fr", None, "z"), (2, "", "fr", "s1", "z"), (3, "123 ,.", "it", "s9", "z"), (None, "new york", "en", "s1", "z")]
    rows += [rows[1]] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string")


def as_sql(docs, sql):
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in result.fetchall()), key=repr)


def sorted_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_divergence_as_sql(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 3)  # several blocks
    got = sorted_rows(divergence.divergence(corpus))
    assert got == as_sql(corpus, divergence.SQL) and any("x" * 40 in map(str, r) for r in got)
    assert divergence.divergence(corpus.limit(0)).count() == 0


def test_shares_are_exact():
    counts = [0, 1, 29, 10**9, 4 * 10**12, 8 * 10**15]
    for total, terms in ((8 * 10**15, 10**6), (10**10 + 7, 3), (0, 1)):
        some = [c for c in counts if c <= total]
        assert divergence.shares(np.array(some), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in some]


def phrases(rows, least):
    """All frequent phrases by a plain count."""
    seen, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or ("und" if lang is None else "")] += len(ws)
            for k in range(1, 5):
                seen.update((lang if lang is not None else "und", " ".join(ws[i : i + k])) for i in range(len(ws) - k + 1))
    return {key: a for key, a in seen.items() if a >= least}, n


def test_phrases_as_a_plain_count(spark, corpus, monkeypatch):
    want, n = phrases([(r["text"], r["lang"]) for r in corpus.collect()], 30)
    docs = corpus.selectExpr("doc_id", "coalesce(text, '') as text", "coalesce(lang, 'und') as lang")
    for one_in in (8, 10**9):  # the second sample is empty: everything comes from the border
        monkeypatch.setattr(collocations, "ONE_IN", one_in)
        with Scratch(spark) as scratch:
            counts, words = collocations.phrase_counts(docs, 30, scratch)
            assert {(r["lang"], r["phrase"]): r["a"] for r in counts.collect()} == want
            assert {r["lang"]: r["n"] for r in words.collect()} == dict(n)


def test_phrases_move_as_packed_buckets(spark, corpus, monkeypatch):
    """What a task sends for a phrase: few bytes, as often as it holds it; small bounds change no count."""
    docs = corpus.selectExpr("coalesce(text, '') as text", "coalesce(lang, 'und') as lang")
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << collocations.SHORT, 1 << 20, dtype=np.uint64))
    packed = collocations._packed(np.concatenate([keys, keys[:9]]), False, 30)
    assert packed.num_rows <= 1 << collocations.BUCKET_BITS and packed.nbytes < 4 * len(keys)
    want, n = phrases([(r["text"], r["lang"]) for r in docs.collect()], 30)
    for name in ("HELD", "PHRASES", "PORTION"):
        monkeypatch.setattr(collocations, name, 50)
    with Scratch(spark) as scratch:
        counts, words = collocations.phrase_counts(docs.selectExpr("0L as doc_id", "*"), 30, scratch)
        assert {(r["lang"], r["phrase"]): (r["words"], r["a"]) for r in counts.collect()} == {k: (k[1].count(" ") + 1, a) for k, a in want.items()}
        assert {r["lang"]: r["n"] for r in words.collect()} == dict(n)


def test_order_by_key_when_keys_meet():
    """Keys that agree in all bits but those lent to the text are kept apart."""
    draw = np.random.default_rng(4)
    text, group = np.sort(draw.integers(0, 300, 5000)), draw.integers(0, 3, 5000)
    for first in (draw.integers(0, 700, 5000, dtype=np.uint64), draw.integers(0, 9, 5000, dtype=np.uint64) << np.uint64(50)):
        for groups in (None, group):
            order = divergence._by_key(text, 300, first, groups)
            rows = list(zip(first[order].tolist(), group[order].tolist() if groups is not None else [0] * 5000, text[order].tolist()))
            runs = [k for i, k in enumerate(rows) if not i or rows[i - 1] != k]
            keys = [k[:2] for i, k in enumerate(runs) if not i or runs[i - 1][:2] != k[:2]]
            assert len(runs) == len(set(rows)) and len(keys) == len(set(keys))


def test_collocations_as_sql(spark, corpus):
    got = sorted_rows(collocations.collocations(corpus))
    assert got == as_sql(corpus, collocations.SQL) and len(got) > 20
    assert collocations.collocations(corpus.limit(0)).count() == 0
