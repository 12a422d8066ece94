"""Language identification: segmentation-marginalised unigram piece models."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import cut, lean, rows, sliced, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
PLAIN = 32  # letters of a word whose probabilities are multiplied as they are; of longer ones logarithms are added
UNKNOWN = 1e-9  # probability of a letter that no piece covers
SMOOTH = 0.05
ROUNDS = 3
SAMPLE_DOCS = 2000  # documents of each language that are learned from, about
REMEMBERED = 1 << 20  # words whose scores are remembered, and 32 times as many letters


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's ordinary pieces, lower-cased, distinct, in the order of their ids."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, None] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            out[sp.id_to_piece(i).lower()] = None
    return [p for p in out if re.fullmatch(rf"{START}?[^\W\d_]+|{START}", p)]


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Scorer:
    """log p(word | language) for all languages, summed over every segmentation into pieces."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.ids = {x: i for i, x in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.p = np.vstack([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])  # unknown, impossible
        with np.errstate(divide="ignore"):
            self.log_p = np.log(self.p)
        self.known: dict[str, int] = {}
        self.letters = 0
        self.score = np.zeros((0, p.shape[1]))

    def edges(self, words: list[str], n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece of each word): all words have n letters, the first marked as a start."""
        get, bad = self.ids.get, len(self.p) - 1
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if start:
                    got = [get(w[start:end], bad) for w in words]
                else:
                    got = [get(START + w[:end], bad) for w in words]
                ids = np.array(got)
                if end - start == 1:
                    ids[ids == bad] = bad - 1
                if (ids != bad).any():
                    yield start, end, ids

    def forward(self, words: list[str], n: int) -> np.ndarray:
        a = np.zeros((n + 1, len(words), self.p.shape[1]))
        a[0] = 1
        for start, end, ids in self.edges(words, n):
            a[end] += a[start] * self.p[ids]
        return a

    def steps(self, word: str) -> list[np.ndarray]:
        """For each end of a prefix of the word, from 1, the pieces from each of the last ``longest`` starts to there."""
        get, bad, out = self.ids.get, len(self.p) - 1, []
        for end in range(1, len(word) + 1):
            ids = [get(word[start:end] if start else START + word[:end], bad) for start in range(max(0, end - self.longest), end)]
            out.append(np.array(ids if ids[-1] != bad else [*ids[:-1], bad - 1]))
        return out

    def log_forward(self, steps: list[np.ndarray]) -> np.ndarray:
        """Logarithms of what ``forward`` sums, of one word of any length: each letter counts up to ``longest`` terms."""
        a = np.zeros((len(steps) + 1, self.p.shape[1]))
        for end, ids in enumerate(steps, 1):
            x = a[end - len(ids) : end] + self.log_p[ids]
            top = x.max(0)
            a[end] = top + np.log(np.exp(x - top).sum(0))
        return a

    def learn(self, words: list[str]) -> None:
        by_length = defaultdict(list)
        parts = [self.score]
        for w in words:
            self.letters += len(w)
            if len(w) > PLAIN:
                parts.append(self.log_forward(self.steps(w))[-1:])
                self.known[w] = len(self.known)
            else:
                by_length[len(w)].append(w)
        for n, same in by_length.items():
            for i in range(0, len(same), 4096):
                some = same[i : i + 4096]
                parts.append(np.log(self.forward(some, n)[n] + 1e-300))
                for w in some:
                    self.known[w] = len(self.known)
        self.score = np.concatenate(parts)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """Sum of log p of each text's words, for each language."""
        new = {w for t in texts for w in t if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED or self.letters > 32 * REMEMBERED:
            self.known, self.score, self.letters = {}, self.score[:0], 0
            new = {w for t in texts for w in t}
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return np.array(
            [self.score[np.fromiter(map(get, t), np.int64, len(t))].sum(0) for t in texts]
        ).reshape(len(texts), -1)


def expected_counts(scorer: Scorer, words: list[str], lang: int, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one length, by forward and backward sums."""
    n = len(words[0])
    edges = list(scorer.edges(words, n))
    p = scorer.p[:, lang]
    a, b = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
    a[0] = b[n] = 1
    for start, end, ids in edges:
        a[end] += a[start] * p[ids]
    for start, end, ids in reversed(edges):
        b[start] += b[end] * p[ids]
    out, scale = np.zeros(len(p)), times / np.maximum(a[n], 1e-300)
    for start, end, ids in edges:
        out += np.bincount(ids, a[start] * p[ids] * b[end] * scale, len(p))
    return out


def long_expected_counts(scorer: Scorer, word: str, lang: int, times: float) -> np.ndarray:
    """``expected_counts`` of one word of any length, by sums of logarithms."""
    steps = scorer.steps(word)
    p, a = scorer.log_p[:, lang], scorer.log_forward(steps)[:, lang]
    b, out = np.full(len(steps) + 1, -np.inf), np.zeros(len(p))
    b[-1] = 0.0
    for end in range(len(steps), 0, -1):
        ids = steps[end - 1]
        from_ = slice(end - len(ids), end)
        b[from_] = np.logaddexp(b[from_], p[ids] + b[end])
        np.add.at(out, ids, times * np.exp(a[from_] + p[ids] + b[end] - a[-1]))
    return out


def fit_pieces(
    docs: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS
) -> tuple[list[str], np.ndarray]:
    """Languages (in order) and p(piece | language), by expectation-maximisation over word counts.

    ``docs(doc_id, text, lang)`` are labelled; of a language with more than ``sample_docs``
    documents a fraction is learned from, chosen by a hash of doc_id, so that about that many
    take part whatever the size of the table. Word counts and expected piece counts are Spark
    aggregates; only piece counts by language, of the vocabulary's fixed size, reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.where("lang is not null and text is not null")
    n = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    part = spark.createDataFrame(
        [(i, x, min(1.0, sample_docs / n[x])) for i, x in enumerate(langs)], "l int, lang string, fraction double"
    )
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("fraction") * 1_000_000
    some = docs.join(F.broadcast(part), "lang").where(chosen).select("l", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("l", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
        for batch in sliced(batches, "text"):
            got: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got.update((lang, w) for w in words_of(text))
            yield rows({"l": [k[0] for k in got], "word": [k[1] for k in got], "n": list(got.values())}, schema)

    words = some.mapInArrow(lean(count), "l int, word string, n long").groupBy("l", "word").agg(F.sum("n").alias("n"))
    words = cut(words, "words")
    schema = pa.schema([("l", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])

    def expect(p: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, total = Scorer(pieces, p), np.zeros((len(langs), len(pieces) + 2))
            for batch in batches:
                by = defaultdict(list)
                for lang, word, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if len(word) > PLAIN:
                        total[lang] += long_expected_counts(scorer, word, lang, k)
                    else:
                        by[lang, len(word)].append((word, k))
                for (lang, _), got in by.items():
                    times = np.array([k for _, k in got], float)
                    total[lang] += expected_counts(scorer, [w for w, _ in got], lang, times)
            at = np.argwhere(total[:, : len(pieces)] > 0)
            yield rows({"l": at[:, 0], "piece": at[:, 1], "n": total[at[:, 0], at[:, 1]]}, schema)

        return run

    # first guess: shorter pieces are likelier, alike in all languages
    guess = np.array([10.0 ** -len(x.strip(START)) for x in pieces])
    p = np.repeat((guess / guess.sum())[:, None], len(langs), 1)
    for _ in range(rounds):
        counts = np.full((len(pieces), len(langs)), SMOOTH)
        got = words.mapInArrow(lean(expect(p)), "l int, piece int, n double").groupBy("l", "piece").agg(F.sum("n").alias("n"))
        for r in got.collect():
            counts[r["piece"], r["l"]] += round(r["n"], 6)
        p = counts / counts.sum(0)
    return langs, p


def predict_language(docs: DataFrame, langs: list[str], pieces: list[str], p: np.ndarray) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text)``.

    score is the posterior of the predicted language under equal priors; ties go to the first
    language. Text that is null or without a letter, and any text when no language was learned,
    is ``und`` with score 0. Texts and runs of letters of any length are read whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pieces, p))  # the vocabulary's size times the languages
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value) if langs else None
        for batch in sliced(batches, "text"):
            found = [words_of(t or "") for t in batch.column(2).to_pylist()]
            pred, score = ["und"] * len(found), [0.0] * len(found)
            if langs:
                ll = scorer.of(found)
                ll -= ll.max(1, keepdims=True)
                post = np.exp(ll)
                post /= post.sum(1, keepdims=True)
                for i, w in enumerate(found):
                    if any(c.isalpha() for x in w for c in x):  # a word may be of other numerals alone
                        best = int(post[i].argmax())
                        pred[i], score[i] = langs[best], float(post[i, best])
            data = {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pred, "score": score}
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in (data[f.name] for f in schema)], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(
        lean(run), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify_language(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Learn from the labelled documents that aren't held out, then predict every document.

    Null text and text without letters is ``und``; very long texts are scored whole. Rows with null doc_id are never held out. An empty table gives an empty result. Repeated rows
    each get their prediction. Other columns are left behind.
    """
    pieces = read_pieces(vocabulary)
    langs, p = fit_pieces(docs.select("doc_id", "text", "lang").where(~held_out()), pieces)
    return predict_language(docs.select("doc_id", "text"), langs, pieces, p)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(spark, table(spark, sf_dir, "documents"))
