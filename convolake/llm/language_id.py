"""Language of texts and of the spans of mixed-language texts.

A word's script (found by code-point ranges) narrows its candidates to the languages
that were seen in that script.  Each word then has a score for each candidate, the log
probability of its character trigrams, and Viterbi over the words, with a penalty for each
switch, labels every word with a language.  Runs of equal labels are the spans; the language
with the most letters is the text's.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First code points of the blocks that tell scripts apart.
SCRIPTS = [
    ("latin", 0x0041), ("greek", 0x0370), ("cyrillic", 0x0400), ("armenian", 0x0530), ("hebrew", 0x0590),
    ("arabic", 0x0600), ("indic", 0x0900), ("thai", 0x0E00), ("other", 0x0E80), ("georgian", 0x10A0),
    ("hangul", 0x1100), ("other", 0x1200), ("latin", 0x1E00), ("greek", 0x1F00), ("other", 0x2000),
    ("kana", 0x3040), ("other", 0x3100), ("han", 0x3400), ("other", 0xA000), ("hangul", 0xAC00),
    ("other", 0xD7B0), ("han", 0xF900), ("other", 0xFB00), ("han", 0x20000),
]
NAMES = sorted({name for name, _ in SCRIPTS})
_BEGINS = [at for _, at in SCRIPTS]
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_KNOWN = 200_000  # scored words a worker remembers


@lru_cache(maxsize=1 << 16)
def script(letter: str) -> int:
    """Index in ``NAMES`` of a letter's script."""
    return NAMES.index(SCRIPTS[max(0, bisect_right(_BEGINS, ord(letter)) - 1)][0])


@dataclass
class Model:
    languages: list[str]
    trigrams: dict[str, int]  # row in ``logs``; a trigram that is not here has the last row
    logs: np.ndarray  # log probability in each language
    allowed: np.ndarray  # script x language
    penalty: float = 6.0

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of lower-cased words for every language, forbidden ones far below."""
        if not words:
            return np.zeros((0, len(self.languages)))
        known, unseen = self.trigrams.get, len(self.logs) - 1
        rows = [known(gram, unseen) for word in words for gram in _grams(word)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))  # a word has as many trigrams as letters
        total = np.add.reduceat(self.logs[rows], np.cumsum(lengths) - lengths)
        may = self.allowed[[script(word[0]) for word in words]]
        return np.where(may | ~may.any(1, keepdims=True), total, total - 1e6)


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def learn(labelled: DataFrame, max_rows: int = 10_000, max_trigrams: int = 50_000, penalty: float = 6.0) -> Model:
    """A model from ``labelled (doc_id, text, lang)``; rows without ``lang`` or text are left out.

    At most ``max_rows`` rows are used, those with the smallest hashes of ``doc_id``, and
    the ``max_trigrams`` most frequent trigrams.
    """
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    order = F.xxhash64("doc_id")
    bound = known.select(order.alias("order")).orderBy("order").limit(max_rows).agg(F.max("order")).head()[0]
    sample = known.where(order <= bound) if bound is not None else known.limit(0)

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            if sum(map(len, seen.values())) > 200_000:
                yield _rows(seen)
                seen = {}
        yield _rows(seen)

    def _rows(seen):
        total: Counter = Counter()
        for lang, found in seen.items():
            for word, n in found.items():
                own = script(word[0])
                for gram in _grams(word):
                    total[lang, own, gram] += n
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            + [pa.array([total[k] for k in keys], pa.int64())], ["lang", "script", "gram", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, script int, gram string, n long").groupBy("lang", "script", "gram").agg(F.sum("n").alias("n"))
    top = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(max_trigrams)
    rows = counts.join(top.select("gram"), "gram").collect()  # at most max_trigrams for each language and script
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    scripts = counts.groupBy("lang", "script").agg(F.sum("n").alias("n")).collect()
    languages = sorted(totals)
    place = {lang: i for i, lang in enumerate(languages)}
    grams = {gram: i for i, gram in enumerate(sorted({r["gram"] for r in rows}))}
    table = np.zeros((len(grams) + 1, len(languages)))
    for r in rows:
        table[grams[r["gram"]], place[r["lang"]]] += r["n"]
    whole = np.array([totals[lang] for lang in languages], float) + 0.5 * max_trigrams
    allowed = np.zeros((len(NAMES), len(languages)), bool)
    for r in scripts:  # a script counts for a language from a hundredth of its letters on
        allowed[r["script"], place[r["lang"]]] = r["n"] >= 0.01 * totals[r["lang"]]
    return Model(languages, grams, np.log((table + 0.5) / whole), allowed, penalty)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language of every word of several texts, all texts one step at a time.

    ``scores`` has a (words, languages) array for each text.  A path gains its words' scores
    and loses ``penalty`` with each switch.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order], np.int64)
    if not len(order) or not lengths[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    languages = scores[order[0]].shape[1]
    begins = np.cumsum(lengths) - lengths
    flat = np.concatenate([scores[i] for i in order])
    origin = np.zeros(flat.shape, np.int8 if languages < 128 else np.int16)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")  # texts with more than t words
    best = flat[begins[: alive[0]]].copy()
    stay = np.arange(languages)[None, :]
    last = np.zeros((len(order), languages))
    last[: alive[0]] = best
    for t in range(1, int(lengths[0])):
        n = alive[t]
        best = best[:n]
        top = best.argmax(1)[:, None]
        moved = np.take_along_axis(best, top, 1) - penalty
        switch = moved > best
        at = begins[:n] + t
        origin[at] = np.where(switch, top, stay)
        best = np.where(switch, moved, best) + flat[at]
        last[:n] = best
    label = np.zeros(len(flat), np.int64)
    now = last.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = alive[t]
        at = begins[:n] + t
        label[at] = now[:n]
        now[:n] = origin[at, now[:n]] if t else now[:n]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for k, i in enumerate(order):
        out[i] = label[begins[k] : begins[k] + lengths[k]]
    return out


class _Words:
    """Scores of words; the same words come again and again."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The scores of the words of each text."""
        if len(self.rows) > _KNOWN:
            self.rows, self.table = {}, self.table[:0]
        new = list(set().union(*texts).difference(self.rows))
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.table = np.concatenate([self.table, self.model.scores(new)])
        at = self.rows.__getitem__
        return [self.table[np.fromiter(map(at, ws), np.int64, len(ws))] for ws in texts]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs (doc_id, text, ...)``.

    ``lang_pred`` is the language of the spans with the most letters (the first by name, if
    equal) and ``score`` their share of all letters.  Null texts, texts without a letter,
    and all texts where nothing was learned are ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by learn()'s parameters

    def run(batches):
        known = shared.value
        words = _Words(known)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lang, score = [], []
            if known.languages:
                found = [_WORD.findall(text.lower()) for text in texts]
                letters = [np.fromiter(map(len, ws), np.int64, len(ws)) for ws in found]
                labels = viterbi(words.of(found), known.penalty)
                for n, label in zip(letters, labels):
                    share = np.bincount(label, n, len(known.languages)) if len(n) else np.zeros(1)
                    lang.append(known.languages[int(share.argmax())] if len(n) else UNDETERMINED)
                    score.append(float(share.max() / n.sum()) if len(n) else 0.0)
            else:
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, begin, end, lang``: runs of words of one language, as character offsets.

    Texts without a letter have no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        words = _Words(known)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()] if known.languages else []
            out: list[tuple] = []
            # lower-casing can change lengths: places come from the text as it is
            found = [list(_WORD.finditer(text)) for text in texts]
            scores = words.of([[m[0].lower() for m in ms] for ms in found])
            for doc, ms, label in zip(batch.column(0).to_pylist(), found, viterbi(scores, known.penalty)):
                edges = np.flatnonzero(np.diff(label, prepend=-1)) if len(label) else []
                for a, b in zip(edges, [*edges[1:], len(label)]):
                    out.append((doc, ms[a].start(), ms[b - 1].end(), known.languages[label[a]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["doc_id", "begin", "end", "lang"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, begin long, end long, lang string")
