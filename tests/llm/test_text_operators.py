"""Toxicity, BPE, language, chat, token counts: brute force, libraries, hand-made cases."""

import base64
import hashlib
import json
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convolake.llm import bpe, chat, language_id, ngram_join, queries, token_counts, toxicity
from convolake.llm.scratch import forget_results

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\t\x0b", "a", "é" * 5, "word " * 3000, "x" * 50_000, "<|endoftext|> tail", "日本 語 text 12 345!!"]


@pytest.fixture
def odd(spark):
    """Odd texts, one row twice, a row without id, and a clashing extra column."""
    rows = [(i, t, f"s{i % 2}", 7) for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "no id here", None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- byte-level BPE -------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(bpe.read_ranks(MULTI))


def test_every_document_as_the_library(spark, library):
    got = by_id(queries.QUERIES["op2_byte_bpe"](spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = library.encode_ordinary(text or "")
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(text or ""))


def test_odd_texts_round_trip(spark, odd, library):
    rows = bpe.round_trip_digests(odd, MULTI, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 2
    by = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(ODD):
        assert by[i]["n_tokens"] == len(library.encode_ordinary(text or ""))
        assert by[i]["decoded_sha256"] == sha(text or "")
    assert bpe.round_trip_digests(odd.limit(0), MULTI, None).count() == 0


def test_pairs_and_prefixes_follow_the_merges(encoder):
    draw = random.Random(3)
    for _ in range(300):
        data = bytes(draw.choice(b"abcdehinorst  \n01\xc3\xa9") for _ in range(draw.randrange(1, 40)))
        assert encoder.encode(data) == encoder.merged(data)
        last = encoder.extend([], data)
        for n in range(1, len(data) + 1):
            assert encoder.read(last[:n]) == encoder.merged(data[:n])


def test_appends_and_edits_are_exact(encoder):
    draw = random.Random(4)
    for _ in range(200):
        data = bytes(draw.choice(b"the and of ing") for _ in range(draw.randrange(1, 200)))
        last = encoder.extend([], data)
        more = data + bytes(draw.choice(b"the and") for _ in range(5))
        assert encoder.extend(list(last), more) == encoder.extend([], more)
        a = draw.randrange(len(data))
        b = draw.randrange(a, len(data) + 1)
        edited, fresh, done = encoder.replace(last, data, a, b, b"xing")
        assert edited == data[:a] + b"xing" + data[b:]
        assert fresh == encoder.extend([], edited)
        assert done <= len(edited)


def test_an_edit_recomputes_only_its_neighbourhood(encoder):
    data = b"some words that go on and on " * 200
    _, _, done = encoder.replace(encoder.extend([], data), data, 100, 104, b"else")
    assert done < 200


def test_appended_texts(spark, library):
    texts = [("a 'l", "l there"), ("two  ", " spaces"), ("", "new"), ("x" * 300, "y"), ("end\n", "\n\nmore 12")]
    docs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "doc_id long, text string, addition string")
    kept = bpe.encode(docs, MULTI, public_tokenizers.PATTERN).join(docs.select("doc_id", "addition"), "doc_id")
    grown = bpe.append(kept, MULTI, public_tokenizers.PATTERN)
    for r in grown.collect():
        assert r["ids"] == library.encode_ordinary("".join(texts[r["doc_id"]]))
    assert {r["doc_id"]: r["text"] for r in bpe.decode(grown, MULTI).collect()} == {i: a + b for i, (a, b) in enumerate(texts)}


# -- token counts ---------------------------------------------------------------

def test_counts_as_the_library(spark):
    tokenizer = Tokenizer.from_file(JSON)
    got = by_id(queries.QUERIES["op7_token_counts"](spark, SF))
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        n = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert (got[doc]["n_bytes"], got[doc]["n_tokens"], got[doc]["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_cache_encodes_only_misses(spark, odd, tmp_path):
    cache = str(tmp_path / "cache")
    first = token_counts.count_tokens(odd, JSON, cache).collect()
    tokenizer = Tokenizer.from_file(JSON)
    assert len(first) == len(ODD) + 2
    for r in first:
        text = "no id here" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        assert r["n_tokens"] == len(tokenizer.encode(text, add_special_tokens=False))
    stored = token_counts.read_cache(spark, cache).count()
    assert stored == len({t or "" for t in ODD}) + 1  # null and empty are one text
    more = odd.unionByName(spark.createDataFrame([(99, "brand new", None, 1)], odd.schema))
    assert token_counts.count_tokens(more, JSON, cache).count() == len(ODD) + 3
    assert token_counts.read_cache(spark, cache).count() == stored + 1
    other = public_tokenizers.path("piece_bpe_32k.model")
    token_counts.count_tokens(odd, other, cache).count()
    assert token_counts.read_cache(spark, cache).select("version").distinct().count() == 2
    assert token_counts.count_tokens(odd.limit(0), JSON, cache).count() == 0


# -- toxicity -------------------------------------------------------------------

def test_thresholds_share_weights_and_stay_in_order(spark):
    rows = [(i, f"nice calm words here {i} " + " ".join(["vile"] * (i % 3)) + (" awful" if i % 3 == 2 else ""), i % 3) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(table, table)
    assert np.all(np.diff(model.thresholds) > 0) and len(model.thresholds) == 2
    scored = toxicity.score(spark.createDataFrame(rows[:3], "doc_id long, text string, grade int"), model).orderBy("doc_id").collect()
    severity = [r["severity"] for r in scored]
    assert severity[0] < 0.3 < 0.7 < severity[1] < severity[2] and severity[2] > 1.5


def test_gradient_is_that_of_the_likelihood():
    draw = np.random.default_rng(0)
    grade, row, index = draw.integers(0, 3, 60), np.repeat(np.arange(60), 2), draw.integers(0, 4, 120)
    value = draw.random(120)
    kept = np.arange(4)
    model = toxicity._maximise(grade, row, index, value, kept, 2, 2000, ridge=1e-2)

    def objective(weights, thresholds):
        score = np.bincount(row, weights[index] * value, 60)
        above = np.hstack([np.ones((60, 1)), 1 / (1 + np.exp(thresholds - score[:, None])), np.zeros((60, 1))])
        return np.log(above[np.arange(60), grade] - above[np.arange(60), grade + 1]).mean() - 0.5e-2 * (weights**2).sum()

    best = objective(model.weights, model.thresholds)
    for _ in range(50):
        assert objective(model.weights + draw.normal(0, 0.05, 4), model.thresholds + draw.normal(0, 0.05, 2)) <= best + 1e-6


def test_toxicity_odd_texts_and_tables(spark, odd):
    labels = spark.createDataFrame([(4, 0, None), (6, 1, 0), (7, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    graded = toxicity.grades(labels, F.col("toxic"), F.col("quality") == 0)
    model = toxicity.fit(odd, graded, least=1)
    scored = toxicity.score(odd, model)
    assert scored.columns == [*odd.columns, "severity", "any_severity"] and scored.count() == len(ODD) + 2
    assert all(0 <= r["severity"] <= 2 for r in scored.collect())
    none = toxicity.fit(odd, graded.limit(0))  # nothing to learn from: the lowest grade for all
    assert max(r["severity"] for r in toxicity.score(odd, none).collect()) < 1e-9
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_all_documents_are_read_once_for_the_model(spark):
    rows = [(i, f"calm words {i} " + "vile " * (i % 3), i % 3) for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(table.mapInArrow(counted, table.schema), table)
    assert len(model.thresholds) == 2 and read.value == len(rows)


def test_features_take_memory_by_the_portion_not_by_the_batch():
    draw = random.Random(5)
    texts = [" ".join(f"word{draw.randrange(10**6)}" for _ in range(200)) for _ in range(1000)]  # 2.2 MB
    alone = [sorted(b.tolist()) for t in texts[:20] for *_, b in toxicity.features(pa.array([t]))]
    together = [row for _, _, row, _ in toxicity.features(pa.array(texts))]
    first = next(toxicity.features(pa.array(texts)))
    assert [sorted(first[3][first[2] == i].tolist()) for i in range(20)] == alone
    assert np.array_equal(np.unique(np.concatenate(together)), np.arange(len(texts)))
    for made in (toxicity.features, lambda column: ngram_join.gram_sets(column, 5)):
        tracemalloc.start()
        for _ in made(pa.array(texts)):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20e6  # 48e6 and 29e6 by the megabyte


def test_toxic_words_are_caught(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = by_id(queries.QUERIES["op1_toxicity"](spark, sf))
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    caught = np.mean([got[d]["toxic"] for d, y in truth.items() if y])
    false = np.mean([got[d]["toxic"] for d, y in truth.items() if not y])
    assert caught > 0.85 and false < 0.01


# -- language -------------------------------------------------------------------

def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(1)
    texts = [draw.normal(0, 2, (n, 3)) for n in (0, 1, 5, 6, 3)]
    for scores, labels in zip(texts, language_id.viterbi(texts, 1.5)):
        assert len(labels) == len(scores)

        def value(path):
            return sum(scores[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

        every = [()]
        for _ in scores:
            every = [(*p, x) for p in every for x in range(3)]
        assert value(labels.tolist()) == pytest.approx(max(map(value, every)))


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = queries.QUERIES["op3_language_id"](spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 100 < len(held) < 300
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_spans_of_mixed_texts(spark, odd):
    english, greek = "the house and the garden were green and old ", "το σπίτι και ο κήπος ήταν πράσινα "
    german = "das haus und der garten waren sehr grün und schön "
    learned = [(i, t * 3, lang) for i, (t, lang) in enumerate([(english, "en"), (greek, "el"), (german, "de")] * 5)]
    model = language_id.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, english + greek + german)], "doc_id long, text string")
    found = [(r["lang"], r["begin"], r["end"]) for r in language_id.spans(mixed, model).orderBy("begin").collect()]
    assert [f[0] for f in found] == ["en", "el", "de"]
    assert (english + greek + german)[found[1][1] : found[1][2]] == greek.strip()
    rows = by_id(language_id.predict(odd, model))
    assert [rows[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and rows[0]["score"] == 0
    assert language_id.predict(odd, model).count() == len(ODD) + 2
    nothing = language_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.spans(odd, nothing).count() == 0


# -- chat -----------------------------------------------------------------------

def test_escapes_are_reversible():
    draw = random.Random(5)
    parts = [*chat.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "x", "\n", "é"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)
        assert chat.read_turns(chat.format_turn("a\nb\\", text)[0]) == [("a\nb\\", text)]


def test_conversations_read_back(spark):
    got = {r["conv_id"]: r for r in queries.QUERIES["op4_chat_format"](spark, SF).collect()}
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        answers = "".join(t for role, t in said if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(said), sha("".join(f"{a}\n{t}\n" for a, t in said)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(answers), sha(answers))


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "system", "content": "be kind"}, {"role": "human", "content": "hi"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]},
        {"instruction": "add", "input": "1 2", "output": "3"},
        {"prompt": "p", "completion": "c", "extra": {"id": 4}},
        {"unknown": 1}, None, [1], {"messages": []},
    ]
    rows = [(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(8, 0, None), (9, None, "{broken"), (10, 5, json.dumps(records[1]))]
    found = {}
    for r in chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect():
        found.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert sorted(found[0]) == [(0, "system", "be kind"), (1, "user", "hi")]
    assert sorted(found[1]) == [(0, "user", "hi"), (1, "assistant", "yes")]
    assert sorted(found[2]) == [(0, "user", "add\n\n1 2"), (1, "assistant", "3")]
    assert sorted(found[3]) == [(0, "user", "p"), (1, "assistant", "c")]
    assert sorted(found[10]) == [(5, "user", "hi"), (6, "assistant", "yes")]
    for i in (4, 5, 6, 7, 8, 9):
        assert [t[1:] for t in found[i]] == [(None, None)]


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "<s>" * 5000), (1, 1, "assistant", "<s>" * 5000), (None, None, "user", "x"), (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 30_000 and got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).count() == 0
    forget_results(spark)
