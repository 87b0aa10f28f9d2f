"""Multilingual mixture inference: which languages a text is in, and in what proportions.

Each language has a letter-trigram model, learnt from the counts over all training documents. A word's likelihood under
a language is the product over its trigrams. Expectation-maximisation finds the proportions of languages
under which a document's words are likeliest, for the likeliest 1, 2, ... K languages in turn; the number of languages
is the one of the largest likelihood less a penalty a language (half the logarithm of the number of words, times
PENALTY). The prediction is the language of the largest share, the score that share.

Letters are what is not ASCII punctuation, digit, space or control; A-Z count as a-z; other alphabets take part through
the bytes of their UTF-8, hashed together with their neighbours. The model is a table of languages by trigram codes, of
a fixed size, so it can be broadcast; the counts it is made of are summed by the executors.

Defined cases: a null text and one without a letter are ``und`` with score 0, as is every text if there is nothing to learn from.
Training documents with a null lang are left out. Of languages of equal share, the first in alphabetical order. Repeated rows each count.
A very long text is inferred whole, alone in its slice: some dozen numbers for each of its words and languages. Columns but those named are not read,
and empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices, utf8

BITS = 16
SMOOTH = 0.5
ROUNDS = 12
PENALTY = 1.0
UNDETERMINED = "und"

LATIN = re.compile(rb"[A-Za-z]")
#: By byte: 0 ends a word (ASCII that is no letter); letters a class each, A-Z as a-z; bytes of other alphabets themselves.
CLASS = np.zeros(256, np.uint32)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)


class Letters:
    """Trigram codes of some texts, by word: code i is of word[i], words of text t are first[t] to first[t + 1]."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        c = CLASS[buf]
        inside = c > 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8)))
        starts, stops = edge[::2] + 1, edge[1::2] + 1
        # a code at each letter (with both neighbours; 0 beyond the word)
        at = np.flatnonzero(inside)
        x = (c[at - 1] * np.uint32(155) + c[at]) * np.uint32(155) + c[at + 1]
        self.codes = (x * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        self.begin = np.searchsorted(at, starts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
        self.sizes = stops - starts


def train_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): trigram counts by language over all (text, lang) rows; a row per task at most for each, then summed."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), utf8(batch.column(0))
            for lang in dict.fromkeys(langs):
                own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                mine = [x for x, y in zip(texts, langs) if y == lang]
                for a, b in slices(mine):
                    own += np.bincount(Letters(mine[a:b]).codes, minlength=1 << BITS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "code", "n"])

    rows = shipped(docs).filter("lang is not null").select("text", "lang").mapInArrow(run, "lang string, code int, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of the trigram codes, [1 << BITS, languages]."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * len(counts))).astype(np.float32)


def fit(docs: DataFrame) -> Model:
    """The driver gets the finished sums: as many rows as languages times trigram codes at most."""
    rows = train_counts(docs).collect()
    langs = sorted({r.lang for r in rows})
    counts = np.zeros((1 << BITS, max(1, len(langs))))
    for r in rows:
        counts[r.code, langs.index(r.lang)] = r.n
    return Model(langs, counts)


def shares(like: np.ndarray, first: np.ndarray, words: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions [documents, K] and log likelihoods.

    like: likelihood of each word by language, scaled so that its largest is 1. allowed: which languages a document may have.
    """
    doc = np.repeat(np.arange(len(words)), words)
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = like * pi[doc]
        r /= r.sum(axis=1, keepdims=True)
        pi = np.add.reduceat(r, first, axis=0) / words[:, None]
    return pi, np.add.reduceat(np.log((like * pi[doc]).sum(axis=1)), first)


def infer(model: Model, texts: list[bytes], rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [texts, K] over the chosen language set (zeros where there is no letter), and the number of languages chosen."""
    k = len(model.langs)
    pi_all, chosen = np.zeros((len(texts), k)), np.zeros(len(texts), np.int32)
    letters = Letters(texts)
    words = np.diff(letters.first)
    for t in np.flatnonzero(words):  # other alphabets' punctuation alone is no letter
        if not LATIN.search(texts[t]) and not any(map(str.isalpha, texts[t].decode())):
            words[t] = 0
    has = np.flatnonzero(words)
    if len(has) < np.count_nonzero(np.diff(letters.first)):
        return _without(model, texts, has, rounds, penalty)
    if not k or not len(has):
        return pi_all, chosen
    logs = np.add.reduceat(model.logp[letters.codes], letters.begin, axis=0).astype(np.float64)
    like = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60.0))
    words, first = words[has], letters.first[:-1][has]
    pi, ll = shares(like, first, words, np.ones((len(has), k)), rounds)
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    best, best_pi, best_n = np.full(len(has), -np.inf), pi, np.full(len(has), k)
    for n in range(1, k + 1):
        own, own_ll = (pi, ll) if n == k else shares(like, first, words, (rank < n).astype(float), rounds if n > 1 else 0)
        value = own_ll - penalty * 0.5 * np.log(words + 1) * (n - 1)
        better = value > best + 1e-9
        best = np.where(better, value, best)
        best_pi = np.where(better[:, None], own, best_pi)
        best_n = np.where(better, n, best_n)
    pi_all[has], chosen[has] = best_pi, best_n
    return pi_all, chosen


def _without(model: Model, texts: list[bytes], has: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    pi, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int32)
    pi[has], n[has] = infer(model, [texts[t] for t in has], rounds, penalty)
    return pi, n


SCHEMA = "doc_id long, lang_pred string, score double, n_langs int, langs array<struct<lang:string,share:double>>"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the language of the largest share, that share, and the whole mixture, of every (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mixture = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                pi, n = infer(m, texts[a:b])
                top = pi.argmax(axis=1) if len(m.langs) else np.zeros(b - a, int)
                langs = [m.langs[i] if k else UNDETERMINED for i, k in zip(top, n)]
                score = [float(min(1.0, row[i])) if k else 0.0 for row, i, k in zip(pi, top, n)]
                every = [[{"lang": m.langs[i], "share": float(row[i])} for i in np.argsort(-row, kind="stable")[:k]] for row, k in zip(pi, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs), pa.array(score), pa.array(n, pa.int32()), pa.array(every, mixture)], ["doc_id", "lang_pred", "score", "n_langs", "langs"])

    return shipped(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
