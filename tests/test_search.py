import math
import random
import re
from collections import Counter

import pytest

from convolake.operators import search as S

WORDS = [f"w{i}" for i in range(40)] + ["the", "and", "Éclair", "x"]


def corpus_rows(rng, n):
    return [("skill" if i % 2 else "message", f"d{i:03d}", " ".join(rng.choices(WORDS, k=rng.randrange(0, 25))),
             f"title {i}", None, rng.choice(["/a/web", "/a/api", None])) for i in range(n)]


def ranked(rows, query, cap, limit=10):
    """Plain TF-IDF cosine: the query is the last document of the fit."""
    def words(text):
        return [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in S.ENGLISH_STOP_WORDS]
    docs = [Counter(words(r[2])) for r in rows] + [Counter(words(query))]
    total, df = Counter(), Counter()
    for d in docs:
        total.update(d)
        df.update(d.keys())
    vocabulary = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:cap]}
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocabulary}
    vectors = [{t: n * idf[t] for t, n in d.items() if t in vocabulary} for d in docs]
    def norm(v):
        return math.sqrt(sum(x * x for x in v.values())) or 1.0
    q = vectors.pop()
    scores = [(sum(w * q.get(t, 0) for t, w in v.items()) / norm(v) / norm(q), r) for v, r in zip(vectors, rows)]
    hits = [(round(s, 9), r) for s, r in scores if s >= 0.05]
    hits.sort(key=lambda h: (-h[0], h[1][0] != "skill", h[1][1]))
    return [(r[0], r[1], round(s, 6)) for s, r in hits[:limit]]


SCHEMA = "type string, id string, text string, title string, description string, project string"


@pytest.mark.parametrize("cap", [5000, 12])
def test_search_equals_plain_reading(spark, cap):
    rng = random.Random(cap)
    rows = corpus_rows(rng, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    for query in ["w1 w2 w2 éclair", "the and", "w5 unknown w6", ""]:
        got = [(r.type, r.id, r.score) for r in S.search(df, query, max_features=cap, digits=6).collect()]
        assert got == ranked(rows, query, cap), query


def test_project_filter_comes_before_statistics(spark):
    rows = corpus_rows(random.Random(3), 60)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.type, r.id, r.score) for r in S.search(df, "w1 w2 w3", project="web", digits=6).collect()]
    assert got == ranked([r for r in rows if r[5] and "web" in r[5]], "w1 w2 w3", 5000)
    assert S.search(df, "w1", project="WEB").count() == 0


@pytest.mark.parametrize("cap", [5000, 40, 12, 3])
def test_batch_equals_single_searches(spark, cap):
    """Small caps make queries move terms into and out of the vocabulary."""
    rows = corpus_rows(random.Random(4), 90)
    df = spark.createDataFrame(rows, SCHEMA)
    asked = {1: "w1 w2 w2 éclair", 2: "the and", 3: "w5 unknown w6", 4: "w1 w9 w30 w31 w31",
             5: "new " * 90 + "w3", 6: " ".join(f"w{i} " * 9 for i in range(20)), 7: "other"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    out = S.search_batch(df, S.build_index(df, cap), queries, limit=7, digits=6).orderBy("query_id", "rank").collect()
    for key, text in asked.items():
        assert [(r.type, r.id, r.score) for r in out if r.query_id == key] == ranked(rows, text, cap, 7), text


def test_corpus(spark):
    from convolake.schemas import MESSAGES, SESSIONS, SKILLS, conform
    skills = conform(spark.createDataFrame([("k", "T", None, ["f"])], "skill_id string, title string, steps string, facts array<string>"), SKILLS)
    messages = conform(spark.createDataFrame([("s", 0, "u" * 120, None), ("s", 1, None, "r"), ("x", 0, "lost", None)],
                                             "session_id string, msg_seq long, user_text string, response_summary string"), MESSAGES)
    sessions = conform(spark.createDataFrame([("s", "/p")], "session_id string, project_path string"), SESSIONS)
    got = {r.id: r for r in S.build_corpus(skills, messages, sessions).collect()}
    assert set(got) == {"k", "s#0"} and got["k"].text == "T f" and got["k"].obs_type == "workflow"
    assert len(got["s#0"].title) == 100 and got["s#0"].description == "" and got["s#0"].project == "/p"
    assert S.build_corpus(skills, messages, sessions, "skills").count() == 1
    with pytest.raises(ValueError):
        S.build_corpus(skills, messages, sessions, "other")


def test_index_has_one_row_per_document(spark):
    """Rows of one id are one document, and documents, not their words, are what is stored and moved."""
    df = corpus_of(spark, [("message", "a", "alpha Beta alpha"), ("message", "a", "beta gamma"), ("message", "b", None), ("skill", "a", "alpha")])
    index = S.build_index(df)
    got = {(r.type, r.id): {t.term: t.tf for t in r.terms} for r in index.postings.collect()}
    assert got == {("message", "a"): {"alpha": 2, "beta": 2, "gamma": 1}, ("skill", "a"): {"alpha": 1}}
    assert {r.term: (r.total, r.df) for r in index.terms.collect()} == {"alpha": (3, 2), "beta": (2, 1), "gamma": (1, 1)}


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "type string, id string, text string")
