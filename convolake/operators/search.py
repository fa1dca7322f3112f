"""TF-IDF cosine search over skills and messages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from ..session import pin, write_down
from .ranking import first_n

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 5000
THRESHOLD = 0.05
BROADCAST_ROWS = 1_000_000  # words of all queries up to which every task gets them

# The English stop words that Spark's StopWordsRemover ships.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()


def build_corpus(skills: DataFrame, messages: DataFrame, sessions: DataFrame,
                 include: str = "all") -> DataFrame:
    """(type, id, text, title, description, project, obs_type) of skills and messages.

    Absent parts of a skill add nothing to its text.
    """
    def text(*names: str) -> Column:
        return F.concat_ws(" ", *names)

    parts = []
    if include in ("all", "skills"):
        parts.append(skills.select(
            F.lit("skill").alias("type"), F.col("skill_id").alias("id"),
            text("title", "description", "steps", "tags", "facts", "concepts").alias("text"),
            "title", "description", F.col("project_path").alias("project"),
            F.coalesce("obs_type", F.lit("workflow")).alias("obs_type")))
    if include in ("all", "messages"):
        owned = sessions.select("session_id", "project_path")
        parts.append(messages.where(F.col("user_text").isNotNull()).join(owned, "session_id").select(
            F.lit("message").alias("type"),
            F.concat_ws("#", "session_id", "msg_seq").alias("id"),
            text("user_text", "response_summary").alias("text"),
            preview(F.col("user_text"), 100).alias("title"),
            preview(F.coalesce("response_summary", F.lit("")), 200).alias("description"),
            F.col("project_path").alias("project")))
    if not parts:
        raise ValueError(f"include must be all, skills or messages, not {include!r}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _words(text: str, stop_words: Sequence[str]) -> Column:
    """The words of a text that are no stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def explode_terms(df: DataFrame, text: str, stop_words: Sequence[str], *keep: str) -> DataFrame:
    """One row per word of ``text`` that is no stop word: the ``keep`` columns and ``term``."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    found = df.select(*keep, F.explode(words).alias("term"))
    return found.where(~F.col("term").isin(list(stop_words))) if stop_words else found


def _totals(documents: DataFrame) -> DataFrame:
    """(term, total, df) of ``documents (words)`` without a row for each document and term."""
    each = F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    once = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    found = documents.select(F.explode(F.concat(each, once)).alias("w"))
    return found.groupBy(F.col("w.term").alias("term")).agg(F.sum("w.n").alias("total"), F.sum("w.d").alias("df"))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def _ranked() -> list[Column]:
    """Best first; equal scores keep corpus order: skills, then messages, by id.

    Scores are compared to nine places: sums of the same weights in another order
    differ in the last bits only.
    """
    return [F.desc(F.round("score", 9)), F.desc("type"), F.asc("id")]


def _term_counts(corpus: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """(type, id, terms): one row per document with its terms and how often each occurs.

    The texts of rows that share an id are one document.  Texts move once; a row per
    document and term never does.
    """
    documents = corpus.groupBy("type", "id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    found = documents.select("type", "id", _words("text", stop_words).alias("words")).where(F.size("words") > 0)

    def count(batches):
        for batch in batches:
            counted = [list(Counter(words).items()) for words in batch.column(2).to_pylist()]
            ends = [0, *accumulate(map(len, counted))]
            pairs = pa.StructArray.from_arrays(
                [pa.array([t for c in counted for t, _ in c], pa.string()), pa.array([n for c in counted for _, n in c], pa.int64())],
                ["term", "tf"])
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], ["type", "id", "terms"])

    return found.mapInArrow(count, "type string, id string, terms array<struct<term:string,tf:long>>")


def _each_term(postings: DataFrame, *keep: str) -> DataFrame:
    """One row per document and term, for use inside the task that reads the document."""
    return postings.select(*keep, F.explode("terms").alias("t")).select(*keep, "t.term", "t.tf")


def _statistics(postings: DataFrame) -> DataFrame:
    """(term, total, df) over all documents."""
    return _each_term(postings).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def _frequent(terms: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` most frequent terms, written down."""
    return pin(terms.orderBy(F.desc("total"), F.asc("term")).limit(max_features))


def _query_words(queries: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    words = explode_terms(queries, "query", stop_words, "query_id")
    return words.groupBy("query_id", "term").agg(F.count("*").alias("n"))


def search(corpus: DataFrame, query: str, project: str | None = None, limit: int = 10,
           threshold: float = THRESHOLD, max_features: int = MAX_FEATURES,
           stop_words: Sequence[str] = ENGLISH_STOP_WORDS, digits: int = 3) -> DataFrame:
    """Rows of ``corpus`` most similar to ``query``: the query is one more document.

    The project filter comes before all statistics.  Two passes over the corpus: the
    first counts terms, combined in each task; the second weighs the vocabulary words of
    the documents that share a word with the query.  Nothing is stored, and no row per
    document and word moves in the first pass.
    """
    if project:
        corpus = corpus.where(F.col("project").contains(project))
    documents = corpus.select("type", "id", _words("text", stop_words).alias("words"))
    asked = corpus.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    words = _query_words(asked, stop_words)
    with_query = _totals(documents).unionByName(
        words.select("term", F.col("n").alias("total"), F.lit(1).alias("df")))
    terms = _frequent(
        with_query.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")), max_features)
    size = corpus.agg((F.count("*") + 1).alias("n")).scalar()
    vocabulary = terms.select("term", "df").join(words, "term", "left").select(
        "term", "n", _idf(size, F.col("df")).alias("idf"))
    own = [row["term"] for row in words.collect()]  # the words of the query text, which the driver holds
    sharing = documents.where(F.arrays_overlap("words", F.array(*map(F.lit, own)).cast("array<string>")))
    counted = (
        sharing.select("type", "id", F.explode("words").alias("term"))
        .join(vocabulary, "term").groupBy("type", "id", "term")
        .agg(F.count("*").alias("tf"), F.first("idf").alias("idf"), F.first("n").alias("n"))
    )
    weighed = counted.select(
        "type", "id", (F.col("tf") * F.col("idf")).alias("w"), (F.col("n") * F.col("idf")).alias("q"))
    query_norm = vocabulary.agg(F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), 2))).alias("q")).scalar()
    scored = (
        weighed.groupBy("type", "id")
        .agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("norm2"))
        .where(F.col("dot") > 0)
        .select("type", "id", (F.col("dot") / (F.sqrt("norm2") * query_norm)).alias("score"))
        .where(F.col("score") >= threshold)
    )
    best = scored.orderBy(*_ranked()).limit(limit)
    return (
        corpus.join(best, ["type", "id"])
        .orderBy(*_ranked())
        .select("type", "id", "title", "description", "project", F.round("score", digits).alias("score"))
    )


@dataclass
class SearchIndex:
    """Postings (type, id, terms) by document, term statistics (term, total, df), the most
    frequent terms of these, and the corpus size."""

    postings: DataFrame
    terms: DataFrame
    vocabulary: DataFrame
    size: Column
    max_features: int
    stop_words: Sequence[str]


def build_index(corpus: DataFrame, max_features: int = MAX_FEATURES,
                stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> SearchIndex:
    """Tokenise a corpus once; the counts are written down for all later searches."""
    documents = corpus.select("type", "id", "text")
    postings = write_down(_term_counts(documents, stop_words))
    terms = write_down(_statistics(postings))
    vocabulary = _frequent(terms, max_features)
    size = corpus.agg(F.count("*").alias("n")).scalar()
    return SearchIndex(postings, terms, vocabulary, size, max_features, stop_words)


def _vocabulary_moves(index: SearchIndex, words: DataFrame) -> DataFrame:
    """(query_id, term, enters): terms a query's own words bring into the vocabulary,
    and those they push out of it.

    ``words`` has (query_id, term, n, total, df, known).  Only words that overtake
    the last vocabulary term can enter, so usually there is nothing to do; the terms
    at risk are as many as the most words that enter for one query.
    """
    filled = index.vocabulary.agg(F.count("*").alias("n")).first()["n"]
    room = index.max_features - filled
    last = index.vocabulary.orderBy("total", F.desc("term")).limit(1).first()
    reached = F.col("total") + F.col("n")
    overtakes = F.lit(room > 0)
    if last is not None:
        overtakes = overtakes | (reached > last["total"]) | (
            (reached == last["total"]) & (F.col("term") < last["term"]))
    knocking = words.where(~F.col("known") & overtakes).select("query_id", "term", reached.alias("total"))
    per_query = knocking.groupBy("query_id").agg(F.count("*").alias("n"))
    most = per_query.agg(F.max("n").alias("n")).first()["n"] or 0
    tail = index.vocabulary.orderBy("total", F.desc("term")).limit(most)
    at_risk = tail.agg(F.collect_list(F.struct("term", "total")).alias("t")).scalar()
    own = words.where("known").select("query_id", "term", F.col("n").alias("_own"))
    staying = per_query.select("query_id", F.explode(at_risk).alias("t")).select(
        "query_id", F.col("t.term").alias("term"), F.col("t.total").alias("total")
    ).join(own, ["query_id", "term"], "left").select(
        "query_id", "term", (F.col("total") + F.coalesce("_own", F.lit(0))).alias("total"),
        F.lit(False).alias("enters"))
    rivals = knocking.withColumn("enters", F.lit(True)).unionByName(staying)
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("total"), F.asc("term"))
    within = F.row_number().over(by_rank) <= min(most, filled) + room
    return rivals.withColumn("_in", within).where(F.col("_in") == F.col("enters")).drop("_in", "total")


def search_batch(corpus: DataFrame, index: SearchIndex, queries: DataFrame, limit: int = 10,
                 threshold: float = THRESHOLD, digits: int = 3) -> DataFrame:
    """Top rows for every query (query_id, query) from one index in one job.

    Each query counts as one more document of its own search: the corpus size grows
    by one, so do the frequencies of its words, and a word used often enough takes
    the place of the last vocabulary term.  Document norms follow from the index; only
    postings of terms a query changes adjust them.
    """
    size = index.size + 1
    b, bq = _idf(size, F.col("df")), _idf(size, F.col("df") + 1)
    # the vocabulary has at most `max_features` rows
    known = F.broadcast(index.vocabulary.select("term", F.lit(True).alias("known")))
    words = pin(
        _query_words(queries, index.stop_words).join(index.terms, "term", "left").join(known, "term", "left")
        .select("query_id", "term", "n", F.coalesce("total", F.lit(0)).alias("total"),
                F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("known", F.lit(False)).alias("known")))
    moves = pin(_vocabulary_moves(index, words))
    asked = words.join(moves, ["query_id", "term"], "left").where(
        F.coalesce("enters", F.col("known"))  # an own word that was pushed out is not asked for
    ).select("query_id", "term", (F.col("n") * bq).alias("q"), bq.alias("bq"),
             F.when(F.col("known"), F.pow(bq, 2) - F.pow(b, 2)).otherwise(F.pow(bq, 2)).alias("shift"))
    query_norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    pushed = moves.where(~F.col("enters")).join(F.broadcast(index.vocabulary), "term").select(
        "query_id", "term", F.lit(0.0).alias("dot"), (-F.pow(b, 2)).alias("shift"))
    changes = pin(
        asked.select("query_id", "term", (F.col("bq") * F.col("q")).alias("dot"), "shift").unionByName(pushed)
        .join(query_norms, "query_id"))
    asked_for = F.broadcast(changes) if changes.count() <= BROADCAST_ROWS else changes

    weights = F.broadcast(index.vocabulary.select("term", b.alias("b")))
    norms = _each_term(index.postings, "type", "id").join(weights, "term").groupBy("type", "id").agg(
        F.sum(F.pow(F.col("tf") * F.col("b"), 2)).alias("norm2"))
    # documents lie by id with their norms, so a query's score of one is complete in one task
    documents = index.postings.join(norms, ["type", "id"], "left")
    tf = F.col("tf")
    # a document may hold nothing but words that entered, so it may have no norm yet
    norm = F.sqrt(F.coalesce("norm2", F.lit(0.0)) + F.col("shift"))
    scored = (
        _each_term(documents, "type", "id", "norm2").join(asked_for, "term")
        .groupBy("type", "id", "query_id")
        .agg(F.sum(tf * F.col("dot")).alias("dot"), F.sum(tf * tf * F.col("shift")).alias("shift"),
             F.max("norm2").alias("norm2"), F.max("q_norm").alias("q_norm"))
        .where(F.col("dot") > 0)
        .select("query_id", "type", "id", (F.col("dot") / (norm * F.col("q_norm"))).alias("score"))
        .where(F.col("score") >= threshold)
    )
    best = first_n(scored, "query_id", limit, *_ranked())
    shown = corpus.select("type", "id", "title", "project")
    return best.join(shown, ["type", "id"]).select(
        "query_id", "rank", "type", "id", "title", "project", F.round("score", digits).alias("score"))
