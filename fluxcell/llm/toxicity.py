"""Toxicity: votes of the nearest labelled examples by TF-IDF cosine, found in a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import count_rows, cut, lean, rows, sliced, table, total_counts

WORD = re.compile(r"[^\W_]+")
SAMPLE_DOCS = 20_000  # labelled documents that are learned from, about
MOST_TERMS = 4095  # terms that vectors are made of
LEAST_DOCS = 3  # examples that a term stands in
NEIGHBOURS = 15  # examples that vote
BLOCK = 32  # patterns of a block of the index
SMOOTH = 0.02  # what a distance is raised by before its inverse is a weight
BINS = 20  # of votes, for calibration
REMEMBERED = 1 << 14
SEED = 31

EVIDENCE = "array<struct<example: long, cosine: double, toxic: double>>"
EVIDENCE_TYPE = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def terms_of(text: str | None) -> Counter:
    """How often each lower-cased word stands in the text."""
    return Counter(WORD.findall((text or "").lower()))


def learned_terms(examples: DataFrame, most: int = MOST_TERMS, least_docs: int = LEAST_DOCS) -> list[str]:
    """The terms whose presence in ``examples(text, toxic)`` is associated with the label, in order.

    A term counts if it stands in ``least_docs`` examples and its chi-square is over 2 ln V + ln N, for V terms
    that are looked at and N examples: more than chance reaches, and than a model's further number costs by the
    Bayesian criterion. Of more than ``most`` terms the strongest stay.
    """

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("toxic", pa.int64())])
        for batch in sliced(batches, "text"):
            n, bad = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text).keys()
                n.update(found)
                if label:
                    bad.update(found)
            yield rows({"term": list(n), "n": list(n.values()), "toxic": [bad[t] for t in n]}, schema)

    total, positive = examples.agg(F.count("*"), F.sum("toxic")).first()
    if not total or not positive or positive == total:
        return []
    seen = examples.select("text", "toxic").mapInArrow(lean(presence), "term string, n long, toxic long")
    seen = seen.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("a")).where(F.col("n") >= least_docs)
    seen = cut(seen, "terms")
    n, a, negative = F.col("n").cast("double"), F.col("a"), total - positive
    b = n - a
    chi = F.lit(float(total)) * F.pow(a * (negative - b) - b * (positive - a), 2) / (n * (total - n) * positive * negative)
    passed = seen.where(F.col("n") < total).withColumn("chi", chi)
    passed = passed.where(F.col("chi") > 2 * math.log(max(1, seen.count())) + math.log(total))
    return sorted(r[0] for r in passed.orderBy(F.desc("chi"), "term").select("term").limit(most).collect())


def document_counts(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """In how many of ``docs(text)`` each term stands, and after these the number of documents: all rows count."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = shared.value, np.zeros(len(terms) + 1, np.int64)
        for batch in sliced(batches, "text"):
            for text in batch.column(0).to_pylist():
                for term in terms_of(text).keys() & ids.keys():
                    total[ids[term]] += 1
            total[-1] += batch.num_rows
        yield count_rows(total, TaskContext.get().partitionId())

    counted = docs.select("text").mapInArrow(lean(count), "chunk int, part int, counts binary")
    return total_counts(counted, len(terms) + 1)


def tf_idf(terms: Counter, ids: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers in order, weights (1 + ln tf) idf of length 1); empty if no term occurs."""
    got = {ids[t]: terms[t] for t in terms.keys() & ids.keys()}
    at = np.array(sorted(got), np.int32)
    weight = (1 + np.log([got[i] for i in at.tolist()])) * idf[at]
    norm = np.sqrt((weight * weight).sum())
    # rounded, so that counts in proportion make one vector
    return (at, np.round(weight / norm, 12)) if norm > 0 else (at[:0], weight[:0])


class BlockMaxIndex:
    """Distinct unit vectors, nearest by cosine; exact.

    Vectors are put in order of their heaviest terms, so that those of a block resemble each other. Each term has the
    largest weight it has in each block: a query's products with these bound the cosine of all a block's
    vectors. Blocks are scored from the highest bound down, until that is under the k-th cosine found.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        lead = [tuple(at[np.lexsort((at, -weight))].tolist()) for at, weight in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lead.__getitem__), np.int64)
        self.block, self.blocks = block, -(-len(vectors) // block)
        postings = defaultdict(list)
        for place, i in enumerate(self.order.tolist()):
            for t, w in zip(vectors[i][0].tolist(), vectors[i][1].tolist(), strict=True):
                postings[t].append((place, w))
        self.bounds, self.lists = {}, {}
        for t, found in postings.items():
            place, weight = np.array([p for p, _ in found], np.int64), np.array([w for _, w in found])
            at, first = np.unique(place // block, return_index=True)
            self.bounds[t] = at, np.maximum.reduceat(weight, first)
            ends = [*first[1:].tolist(), len(place)]
            self.lists[t] = {
                b: (place[i:j] % block, weight[i:j]) for b, i, j in zip(at.tolist(), first.tolist(), ends, strict=True)
            }
        self.scored = 0  # blocks, so far

    def search(self, at: np.ndarray, weight: np.ndarray, k: int) -> list[tuple[float, int]]:
        """At least the k nearest vectors with a cosine over 0, as (cosine, number), nearest first, ties by number.

        All that tie with the k-th are there.
        """
        query = [(t, w) for t, w in zip(at.tolist(), weight.tolist(), strict=True) if t in self.lists]
        bound = np.zeros(self.blocks)
        for t, w in query:
            b, most = self.bounds[t]
            bound[b] += w * most
        found: list[tuple[float, int]] = []
        least = 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < least - 1e-9:
                break
            self.scored += 1
            score = np.zeros(self.block)
            for t, w in query:
                got = self.lists[t].get(b)
                if got is not None:
                    score[got[0]] += w * got[1]
            hit = np.flatnonzero(score > 0)
            score = np.round(score[hit], 12)  # equal cosines tie, whatever the order of their sums
            found += zip(score.tolist(), self.order[b * self.block + hit].tolist(), strict=True)
            if len(found) >= k:
                found.sort(key=lambda x: (-x[0], x[1]))
                least = found[k - 1][0]
                while len(found) > k and found[-1][0] < least:
                    found.pop()
        found.sort(key=lambda x: (-x[0], x[1]))
        return found


class Voter:
    """Votes of the nearest examples. A pattern is a distinct vector with its examples' number, toxic ones, and smallest doc_id."""

    def __init__(self, terms: list[str], idf: np.ndarray, patterns: list[tuple[bytes, bytes, int, int, int]], neighbours: int):
        self.ids, self.idf, self.k = {t: i for i, t in enumerate(terms)}, idf, neighbours
        patterns = sorted(patterns, key=lambda p: p[4])  # so that ties go to the smaller doc_id
        vectors = [(np.frombuffer(a, np.int32), np.frombuffer(w, np.float64)) for a, w, _, _, _ in patterns]
        self.n, self.toxic, self.first = ([p[i] for p in patterns] for i in (2, 3, 4))
        self.place = {p[0] + p[1]: i for i, p in enumerate(patterns)}
        self.index = BlockMaxIndex(vectors)
        self.found: dict[bytes, list[tuple[float, int]]] = {}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(terms_of(text), self.ids, self.idf)

    def vote(self, at: np.ndarray, weight: np.ndarray, own: int | None = None) -> tuple[float | None, list]:
        """(share of toxic votes, evidence); None without neighbours. ``own``: the label of the example asking, which has no vote.

        The nearest ``neighbours`` examples vote, by 1 / (distance + SMOOTH), distance being 1 - cosine.
        """
        key = at.tobytes() + weight.tobytes()
        near = self.found.get(key)
        if near is None:
            # one more, as the example itself may be all there is of a pattern
            near = self.index.search(at, weight, self.k + 1)
            if len(self.found) >= REMEMBERED:
                self.found.clear()
            self.found[key] = near
        left, total, bad, evidence = float(self.k), 0.0, 0.0, []
        mine = self.place.get(key) if own is not None else None
        for cosine, i in near:
            n, toxic = self.n[i], self.toxic[i]
            if i == mine:
                n, toxic = n - 1, toxic - own
            if n:
                votes = min(left, n) / (max(0.0, 1 - cosine) + SMOOTH)
                total += votes
                bad += votes * toxic / n
                evidence.append({"example": self.first[i], "cosine": cosine, "toxic": toxic / n})
                left -= min(left, n)
                if left <= 0:
                    break
        return (bad / total if total else None), evidence


def calibration(counts: list[tuple[int, int, int]], bins: int = BINS) -> tuple[float, np.ndarray]:
    """(score without neighbours, scores at the bins' centres) from (bin or -1, n, toxic ones); scores never fall.

    Each bin's share is drawn to its centre by one pseudo-example, then neighbours that fall are
    pooled (isotonic regression).
    """
    n, toxic = np.zeros(bins + 1), np.zeros(bins + 1)
    for b, some, bad in counts:
        n[b], toxic[b] = some, bad
    base = toxic.sum() / max(1.0, n.sum())
    alone = (toxic[-1] + base) / (n[-1] + 1)
    pools: list[list[float]] = []  # weight, mean, bins
    for b in range(bins):
        pools.append([n[b] + 1, (toxic[b] + (b + 0.5) / bins) / (n[b] + 1), 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w, m, c = pools.pop()
            pools[-1] = [pools[-1][0] + w, (pools[-1][0] * pools[-1][1] + w * m) / (pools[-1][0] + w), pools[-1][2] + c]
    return float(alone), np.repeat([m for _, m, _ in pools], [int(c) for _, _, c in pools])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` for every row of ``docs(doc_id, text)``.

    Examples are the documents with a label in ``labels(doc_id, toxic)`` that are not held out; of more than
    ``sample_docs`` about so many, chosen by a hash of doc_id. Terms are the words whose presence goes with the
    label (``learned_terms``); their idf counts every document. A text's vector is (1 + ln tf) idf
    over these terms, of length 1; equal vectors of examples are one pattern of the index, which is exact. The nearest
    examples vote by inverse distance, and the share of toxic votes becomes a probability by isotonic
    calibration on the examples, each voted on by the others. ``evidence`` lists the patterns that
    voted: the smallest doc_id of their examples, the cosine and the toxic share.

    Null and empty text, and any text without a known term, has no neighbours and the share of toxic ones among such
    examples. Very long texts are read whole. Rows without doc_id are never held out and never examples; of several
    labels of one doc_id any 1 counts, and rows that share a doc_id are each an example. Repeated rows get equal scores. Without labels, or with one kind only,
    no term is learned and every score is the share of toxic examples (0 without any). Columns of other names are left
    behind. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marks = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), "toxic")
    marks = marks.where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    n = marks.count()
    part = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_docs / max(1, n))
    chosen = cut(marks.where(part), "labels", small=True)  # about sample_docs rows at most
    examples = cut(docs.join(F.broadcast(chosen), "doc_id"), "examples")
    terms = learned_terms(examples)
    found = document_counts(docs, terms)
    idf = np.log((found[-1] + 1) / (found[:-1] + 1)) + 1.0
    ids = {t: i for i, t in enumerate(terms)}

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.binary()), ("weight", pa.binary()), ("toxic", pa.int64()), ("doc_id", pa.int64())])
        for batch in sliced(batches, "text"):
            made = [tf_idf(terms_of(t), ids, idf) for t in batch.column(0).to_pylist()]
            data = {"at": [a.tobytes() for a, _ in made], "weight": [w.tobytes() for _, w in made]}
            yield rows(data | {"toxic": batch.column(1).to_pylist(), "doc_id": batch.column(2).to_pylist()}, schema)

    kind = "at binary, weight binary, toxic long, doc_id long"
    made = examples.select("text", "toxic", "doc_id").mapInArrow(lean(patterns), kind)
    made = made.groupBy("at", "weight").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("doc_id").alias("first"))
    bounded = [tuple(r) for r in made.where("length(at) > 0").collect()]  # as many as the sample has at most
    shared = spark.sparkContext.broadcast((terms, idf, [(bytes(r[0]), bytes(r[1]), *r[2:]) for r in bounded]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter, got = Voter(*shared.value, neighbours), Counter()
        for batch in sliced(batches, "text"):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                share, _ = voter.vote(*voter.vector(text), own=label)
                got[-1 if share is None else min(BINS - 1, int(share * BINS)), label] += 1
        schema = pa.schema([("bin", pa.int32()), ("toxic", pa.int64()), ("n", pa.int64())])
        yield rows({"bin": [b for b, _ in got], "toxic": [x for _, x in got], "n": list(got.values())}, schema)

    asked = examples.select("text", "toxic").mapInArrow(lean(ask), "bin int, toxic long, n long")
    asked = asked.groupBy("bin").agg(F.sum("n"), F.sum(F.col("toxic") * F.col("n"))).collect()  # BINS + 1 rows
    alone, curve = calibration([tuple(r) for r in asked])
    centres = (np.arange(BINS) + 0.5) / BINS
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("score", pa.float64()),
            ("predicted", pa.int32()),
            ("evidence", EVIDENCE_TYPE),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = Voter(*shared.value, neighbours)
        for batch in sliced(batches, "text"):
            scores, evidence = [], []
            for text in batch.column(2).to_pylist():
                share, seen = voter.vote(*voter.vector(text))
                scores.append(alone if share is None else float(np.interp(share, centres, curve)))
                evidence.append(seen)
            data = [batch.column(0), batch.column(1), pa.array(scores, pa.float64())]
            data += [pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(evidence, EVIDENCE_TYPE)]
            yield pa.RecordBatch.from_arrays(data, schema=schema)

    kind = f"doc_id long, held_out boolean, score double, predicted int, evidence {EVIDENCE}"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(score), kind)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
