"""SentencePiece encoding and decoding: a relational lattice of pieces and a Viterbi fold."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxcell.llm.common import lean, rows, sliced, table, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BLOCK_CHARS = 14_000_000  # text that shares one list of units
ZIPF = 100.0  # how much flatter than 1 / rank the frequencies of the first ranks are
STEP = 1024  # scores are multiples of 1 / STEP, so that their sums are exact, in single precision too
EDGE_FACTOR = 4
LONGEST_UNIT = 256  # a longer unit's lattice is not exploded to rows: its block solves it in one pass
END, START, LOWEST = 44, 32, 1 << 21  # an edge is one number: end, start (12 bits), id + LOWEST
LOT = 1 << 18  # edges that are folded together, about

# Runs of letters and digits, or of other characters, each with the spaces before it.
UNIT = re.compile(r" *(?:[^\W_²]++|(?:[\W_²](?<! ))++)| +")


def unigram_scores(scores: list[float]) -> list[float]:
    """Log probabilities of pieces, from a file's scores.

    Scores that are whole numbers are the ranks of a merge table, from 0 down; a segmentation's sum of
    ranks means nothing. Merges are ranked by frequency, so Zipf's law gives the probability: p ~ 1 / (``ZIPF`` + rank).
    Other scores are log probabilities already.
    """
    if any(s != round(s) for s in scores):
        return scores
    whole = sum(1 / (ZIPF - s) for s in scores)
    return [round(-STEP * math.log((ZIPF - s) * whole)) / STEP for s in scores]


class Vocabulary:
    """A model file's pieces: texts, scores and ids; the byte pieces; what each id decodes to."""

    def __init__(self, path: str = VOCABULARY):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[tuple[str, float, int]] = []
        self.bytes = np.full(256, -1, np.int32)
        self.decoded: list[bytes] = []
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(text[1:-1], 16)] = i
                self.decoded.append(bytes([int(text[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.decoded.append(b"")
            else:
                self.pieces.append((text, sp.get_score(i), i))
                self.decoded.append(text.replace(SPACE, " ").encode())
        scores = unigram_scores([s for _, s, _ in self.pieces])
        self.pieces = [(t, s, i) for (t, _, i), s in zip(self.pieces, scores, strict=True)]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.unknown_score = min(s for _, s, _ in self.pieces) - 10.0
        for text, _, _ in self.pieces:  # units are independent only if no piece spans two of them
            if UNIT.fullmatch(text.replace(SPACE, " ")) is None:
                raise ValueError(f"piece {text!r} spans a unit boundary")


def words_of(text: str | None) -> list[str]:
    """Parts of a text that no unit spans, each without the space before it (the model family puts one
    before the text). A text with spaces in a row is one part, marked by a leading space."""
    if not text:
        return []
    if text[0] == " " or "  " in text:
        return [" " + text]
    return text.split(" ")


def units_of(word: str) -> list[str]:
    return UNIT.findall(word if word[:1] == " " else " " + word)


class Paths:
    """Best paths through long units, without rows for their edges: the same lattice, scores and ties as ``segment``."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes, self.unknown_score = vocabulary.bytes, vocabulary.unknown_score
        self.prefixes: dict[str, tuple[float, int] | None] = {}  # None: goes on, but is no piece itself
        for text, score, id_ in vocabulary.pieces:
            for n in range(1, len(text)):
                self.prefixes.setdefault(text[:n])
            self.prefixes[text] = (score, id_)

    def ids(self, unit: str) -> list[int]:
        unit = unit.replace(" ", SPACE)
        size, prefixes = len(unit), self.prefixes
        best = array("d", [0.0]) + array("d", [float("-inf")]) * size
        back, by = array("q", [0]) * (size + 1), array("q", [0]) * (size + 1)
        for start in range(size):
            here = best[start]
            if prefixes.get(unit[start]) is None and here + self.unknown_score > best[start + 1]:
                best[start + 1], back[start + 1], by[start + 1] = here + self.unknown_score, start, -1 - ord(unit[start])
            for end in range(start + 1, size + 1):
                sub = unit[start:end]
                if sub not in prefixes:
                    break
                piece = prefixes[sub]
                if piece is not None and here + piece[0] > best[end]:
                    best[end], back[end], by[end] = here + piece[0], start, piece[1]
        path, place = [], size
        while place:
            path.append(by[place])
            place = back[place]
        ids: list[int] = []
        for k in reversed(path):
            ids += [k] if k >= 0 else self.bytes[list(chr(-1 - k).encode())].tolist()
        return ids


class BlockWords:
    """The words and units of a block's texts, each numbered in order of first sight: both passes over a block number alike.

    ``word`` has the words of all texts, one text after the other, ``sizes`` how many each text has; ``made`` the units that
    make the distinct words, ``parts`` how many make each; ``units`` the distinct units.
    """

    def __init__(self, texts: pa.Array):
        text = texts.fill_null("")
        whole = pc.or_(pc.starts_with(text, " "), pc.match_substring(text, "  ")).to_numpy(False)  # as in ``words_of``
        each, alone = pc.split_pattern(text.filter(pa.array(~whole)), " "), text.filter(pa.array(whole))
        flat, stops = each.flatten(), each.offsets.to_numpy()
        every = pa.concat_arrays([flat, pc.binary_join_element_wise("", alone, " ")]).dictionary_encode()
        self.word, distinct = every.indices.to_numpy(), every.dictionary
        begin, self.sizes = np.zeros(len(text), np.int64), np.ones(len(text), np.int64)
        begin[~whole], self.sizes[~whole] = stops[:-1], np.diff(stops)
        begin[whole] = len(flat) + np.arange(len(alone))
        self.sizes[pc.equal(pc.binary_length(text), 0).to_numpy(False)] = 0
        if self.sizes.sum() < len(self.word) or len(alone):  # else words stand as they were numbered
            self.word = take(self.word, begin, self.sizes)
            first = np.full(len(distinct), len(self.word))
            first[self.word[::-1]] = np.arange(len(self.word))[::-1]
            order = np.argsort(first, kind="stable")[: int((first < len(self.word)).sum())]
            number = np.zeros(len(distinct), np.int64)
            number[order] = np.arange(len(order))
            self.word, distinct = number[self.word], distinct.take(pa.array(order))
        made, parts = [], [np.zeros(0, np.int64)]
        for odd, some in groupby(distinct.to_pylist(), lambda w: w[:1] in ("", " ")):
            if odd:
                own = list(map(units_of, some))
                made += chain.from_iterable(own)
                parts.append(np.array(list(map(len, own))))
            else:  # words without a space in them, together: each one's first unit, and no other, begins with a space
                own = UNIT.findall(" " + " ".join(some))
                made += own
                parts.append(np.diff(np.flatnonzero([u[0] == " " for u in own]), append=len(own)))
        units = pa.array(made, pa.string()).dictionary_encode()
        self.made, self.units, self.parts = units.indices.to_numpy(), units.dictionary, np.concatenate(parts)


def take(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs ``flat[begin : begin + length]``, one after the other."""
    return flat[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]


def marked(number: np.ndarray, known: int) -> np.ndarray:
    """Numbers given in order of first sight, ``known`` of them before: 0 for each first sight, else 1 + number. Packs better."""
    following = np.maximum.accumulate(np.concatenate([[known - 1], number]))[:-1] + 1
    return np.where(number == following, 0, number + 1).astype(np.int32)


def unmarked(mark: np.ndarray, known: int) -> np.ndarray:
    """The numbers of ``marked``."""
    return np.where(mark == 0, known + np.cumsum(mark == 0) - 1, mark.astype(np.int64) - 1)


def viterbi(edges: np.ndarray, count: np.ndarray, scores: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best paths through the lattices of many units, one after the other, and each path's length.

    ``count`` edges of each unit, with one into every place. The lattices are folded together, place by
    place: the best edge into a place follows the best paths to its start; equal scores go to the smaller start.
    """
    m = len(count)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit, end, start = np.repeat(np.arange(m), count), edges >> END, (edges >> START) & 0xFFF
    id_ = (edges & 0xFFFFFFFF) - LOWEST
    size = np.maximum.reduceat(end, np.cumsum(count) - count)
    order = np.argsort(((end * m + unit) << 12) | start)
    unit, end, start, id_ = unit[order], end[order], start[order], id_[order]
    score = np.where(id_ >= 0, scores[np.maximum(id_, 0)], unknown)
    best = np.zeros((m, size.max() + 1))
    back, by = np.zeros(best.shape, np.int16), np.zeros(best.shape, np.int32)
    cuts = np.searchsorted(end, np.arange(1, size.max() + 2))
    for place, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        u = unit[i:j]
        here = best[u, start[i:j]] + score[i:j]
        head = np.flatnonzero(np.diff(u, prepend=-1))
        top = np.maximum.reduceat(here, head)
        hit = np.flatnonzero(here == np.repeat(top, np.diff(head, append=len(u))))
        hit = hit[np.diff(u[hit], prepend=-1) > 0]
        best[u[hit], place], back[u[hit], place], by[u[hit], place] = here[hit], start[i:j][hit], id_[i:j][hit]
    at, left, owner, path = size.copy(), np.arange(m), [], []
    while len(left):  # from the ends to the starts
        owner.append(left)
        path.append(by[left, at[left]])
        at[left] = back[left, at[left]]
        left = left[at[left] > 0]
    owner, path = np.concatenate(owner[::-1]), np.concatenate(path[::-1])
    return path[np.argsort(owner, kind="stable")].astype(np.int64), np.bincount(owner, minlength=m)


def lattice(listed: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows ``(row)`` of the lattices of the distinct units of ``listed(unit, place)``, one unit after the other.

    Substrings of bounded length are exploded from one row of each unit and equi-joined to the piece
    table (a fixed vocabulary, broadcast), which gives the lattice's edges. A character
    without a piece is an edge with id -1 - code point. The units are dealt out once and sorted, and what follows keeps their order:
    a unit's rows are -1 - its first place, its edges, and -1 - each further place.
    """
    spark = listed.sparkSession
    pieces = spark.createDataFrame([(t, i) for t, _, i in vocabulary.pieces], "piece string, id int")
    # a unit's row becomes dozens of edges, so the units take more partitions than a shuffle of rows would
    listed = listed.repartition(EDGE_FACTOR * int(spark.conf.get("spark.sql.shuffle.partitions")), "unit")
    first = F.row_number().over(Window.partitionBy("unit").orderBy("place")) == 1
    # start -1 stands for the row that carries the place; one row of a unit brings its substrings as well
    starts = F.when(F.col("first"), F.sequence(F.lit(-1), F.length("unit") - 1)).otherwise(F.array(F.lit(-1)))
    some = listed.withColumn("first", first).select("unit", "place", F.explode(starts).alias("start"))
    lengths = F.when(F.col("start") < 0, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.length("unit") - F.col("start")))
    )
    some = some.select("unit", "place", "start", F.explode(lengths).alias("n"))
    some = some.select("unit", "place", "start", "n", F.substring("unit", F.col("start") + 1, F.col("n")).alias("sub"))
    edges = some.join(F.broadcast(pieces), F.col("sub") == F.col("piece"), "left")
    edges = edges.where("start < 0 or id is not null or n = 1")
    start, end = F.col("start").cast("long"), (F.col("start") + F.col("n")).cast("long")
    id_ = F.coalesce("id", -1 - F.ascii("sub")).cast("long") + LOWEST
    edge = F.shiftleft(end, END) + F.shiftleft(start, START) + id_
    return edges.select(F.when(F.col("start") < 0, -1 - F.col("place")).otherwise(edge).alias("row"))


PACK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
PACK_TYPE = "block long, kind int, data binary"


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, by planes of bytes, compressed."""
    head = np.array([len(c) for c in columns], np.int32).tobytes()
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def spread(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns of ``squeezed``."""
    data, out = zstandard.ZstdDecompressor().decompress(data), []
    at = 4 * len(kinds)
    for n, kind in zip(np.frombuffer(data, np.int32, len(kinds)), map(np.dtype, kinds), strict=True):
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def packed(number: np.ndarray, length: np.ndarray, ids: np.ndarray) -> bytes:
    """Ids of a block's units: the units' ascending numbers, how many ids each has, and these."""
    return squeezed(np.diff(number, prepend=0).astype(np.int32), length.astype(np.int32), ids.astype(np.int32))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number, length, ids = spread(data, np.int32, np.int32, np.int32)
    return np.cumsum(number), length, ids


def split(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole units' rows of ``lattice``: the edges, how many each unit has, the places, and the unit of each place."""
    place = row < 0
    unit = np.cumsum(place & ~np.append(place[1:], True)) - 1
    return row[~place], np.bincount(unit[~place]), -1 - row[place], unit[place]


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of ``lattice`` in lots of about ``LOT`` that part no unit: a unit begins with a place that an edge follows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        size += len(held[-1])
        if size >= LOT:
            row = np.concatenate(held)
            at = np.flatnonzero((row[:-1] < 0) & (row[1:] >= 0))[-1]  # where the unit that may go on begins
            if at:
                yield row[:at]
            held, size = [row[at:]], len(row) - at
    if size:
        yield np.concatenate(held)


def pack(edges: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (block, 0, data) with the ids of what each block needs of the lattices ``edges(row)``."""
    scores = np.zeros(len(vocabulary.decoded))
    scores[[i for _, _, i in vocabulary.pieces]] = [s for _, s, _ in vocabulary.pieces]
    unknown = vocabulary.unknown_score
    shared = edges.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            place, length, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            begin = np.cumsum(length) - length
            order = np.argsort(place, kind="stable")
            place, length, begin = place[order], length[order], begin[order]
            block, at = np.unique(place >> 32, return_index=True)
            data = [
                packed(place[i:j] & 0xFFFFFFFF, length[i:j], take(flat, begin[i:j], length[i:j]))
                for i, j in zip(at, [*at[1:], len(place)], strict=True)
            ]
            held.clear()
            return rows({"block": block, "kind": [0] * len(block), "data": data}, PACK)

        for lot in whole_units(batches):
            own, count, places, unit = split(lot)
            flat, length = viterbi(own, count, shared.value, unknown)
            begin, n = (np.cumsum(length) - length)[unit], length[unit]
            held.append((places, n, take(flat, begin, n).astype(np.int32)))
            size += len(n)
            if size > 2_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return edges.mapInArrow(lean(run), PACK_TYPE)


def in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(block, its batches): a task's rows in blocks of about ``most`` bytes."""
    block, held, size = TaskContext.get().partitionId() << 10, [], 0
    for batch in sliced(batches, "text", 2 << 20):
        if size > most:
            yield block, held
            block, held, size = block + 1, [], 0
        held.append(batch)
        size += batch.column(1).nbytes
    if held:
        yield block, held


def list_units(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(unit, place)``: each block's distinct units but long ones, place = block * 2**32 + number in the block."""
    schema = pa.schema([("unit", pa.string()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in in_blocks(batches, block_chars):
            units = BlockWords(pa.concat_arrays([b.column(1) for b in held])).units
            places = pa.array((block << 32) + np.arange(len(units)))
            all_units = pa.RecordBatch.from_arrays([pc.replace_substring(units, " ", SPACE), places], schema=schema)
            yield all_units.filter(pc.less_equal(pc.utf8_length(units), LONGEST_UNIT))

    return docs.mapInArrow(lean(run), "unit string, place long")


PART = (np.int64, np.bool_, np.uint64, np.int32, np.int32, np.int32, np.int32)


def number_words(docs: DataFrame, vocabulary: Vocabulary, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (block, 1 + part, data): each block's documents as numbers of words, with the units of words that are new.

    In a part: doc_id, whether it is null, a hash of the text with the space before it, and the number of words of each
    document; the words; how many units make each new word, and these (words and units ``marked``). Ids of long units come as ``pack`` gives those of others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Paths(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in in_blocks(batches, block_chars):
            words = BlockWords(pa.concat_arrays([b.column(1) for b in held]))
            long = np.flatnonzero(pc.greater(pc.utf8_length(words.units), LONGEST_UNIT).to_numpy(False))
            if len(long):
                ids = [shared.value.ids(words.units[k].as_py()) for k in long.tolist()]
                data = packed(long, np.array(list(map(len, ids))), np.array(list(chain.from_iterable(ids))))
                yield rows({"block": [block], "kind": [0], "data": [data]}, PACK)
            ends, made_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (words.sizes, words.parts))
            known, before, row = 0, 0, 0
            for part, batch in enumerate(held, 1):
                doc, sizes = batch.column(0), words.sizes[row : row + len(batch)]
                word = words.word[ends[row] : ends[row + len(batch)]]
                now = max(known, int(word.max(initial=-1)) + 1)
                parts, made = words.parts[known:now], words.made[made_ends[known] : made_ends[now]]
                hashes = [xxhash.xxh3_64_intdigest(b" " + t if t else b"") for t in texts(batch.column(1))]
                columns = (doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(False), hashes, sizes, marked(word, known), parts, marked(made, before))
                known, before, row = now, max(before, int(made.max(initial=-1)) + 1), row + len(batch)
                yield rows({"block": [block], "kind": [part], "data": [squeezed(*map(np.asarray, columns, PART))]}, PACK)

    return docs.mapInArrow(lean(run), PACK_TYPE)


ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]
)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, n_pieces, ids, round_trip)`` for every row of ``docs(doc_id, text)``.

    The most probable segmentation of the text, a space before it, into the vocabulary's pieces (``unigram_scores``),
    spaces written as U+2581; characters without a piece become byte pieces. Pieces do not span
    units (a run of letters and digits or of other characters, with the spaces before it), so each
    distinct unit's lattice is solved once. A unit of more than ``LONGEST_UNIT`` characters has the
    same lattice, solved in one pass, in time linear in its length, where its block's text is read.
    ``ids`` is whole; ``round_trip`` tells whether its decoding equals the text, which fails only
    for texts that hold U+2581 itself.

    Documents are taken in blocks of about ``block_chars`` bytes: larger ones share more words,
    smaller ones need less memory. A block's distinct units go to the lattice, their ids come
    back packed by block, and the block's documents meet them there as numbers of words, so neither text nor a word table
    is shuffled, and a document's words are never gathered whole. The decoded ids are held against a hash of the text. The blocks are
    read twice and must be the same both times: ``docs`` has to be a table, not the outcome of a
    shuffle. A block that misses a unit stops the job.

    Null text and empty text have no pieces. Repeated rows are encoded each. Other columns are
    left behind. An empty table gives an empty result.
    """
    model = Vocabulary(vocabulary)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.bytes, model.decoded))
    # blocks are named by task number, which in a union counts on from child to child: this child is first
    both = number_words(docs, model, block_chars).unionByName(pack(lattice(list_units(docs, block_chars), model), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_ids, decoded = shared.value
        table_ = np.frombuffer(b"".join(decoded), np.uint8), np.array([len(d) for d in decoded])
        block, got, words = None, [], None
        for batch in batches:
            for b, kind, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                if b.as_py() != block:
                    block, got, words = b.as_py(), [], None
                data = data.as_py()
                if kind.as_py() == 0:
                    got.append(unpack(data))
                    continue
                if words is None:
                    words, got = WordIds(*unit_ids(got, byte_ids), *table_), []
                yield words.encoded(data)

    dealt = both.repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(lean(run), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def unit_ids(got: list, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's ids in order of unit number: flat ids, begin and length of each unit; bytes in place of unknowns."""
    if not got:
        return (np.zeros(0, np.int32),) * 3
    number = np.concatenate([g[0] for g in got])
    n = np.concatenate([g[1] for g in got]).astype(np.int64)
    flat = np.concatenate([g[2] for g in got])
    bad = np.flatnonzero(flat < 0)
    if len(bad):
        own = np.repeat(np.arange(len(n)), n)
        instead = [byte_ids[list(chr(-1 - int(c)).encode())] for c in flat[bad]]
        extra = np.array([len(x) - 1 for x in instead])
        width = np.ones(len(flat), np.int64)
        width[bad] += extra
        wide = np.repeat(flat, width)
        spots = np.repeat((np.cumsum(width) - width)[bad], extra + 1) + np.concatenate([np.arange(k + 1) for k in extra])
        wide[spots] = np.concatenate(instead)
        n = np.bincount(own, width, len(n)).astype(np.int64)
        flat = wide
    begin = np.cumsum(n) - n
    first, length = np.full(number.max() + 1, -1, np.int64), np.zeros(number.max() + 1, np.int64)
    first[number], length[number] = begin, n
    if (first < 0).any():
        raise ValueError("a block's units did not all come back")
    return flat, first, length


class WordIds:
    """A block's words as runs of ids, filled in the order in which ``number_words`` numbers them."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, length: np.ndarray, decoded: np.ndarray, width: np.ndarray):
        self.unit_ids, self.begin, self.length = ids, begin, length
        self.decoded, self.width, self.at = decoded, width, np.cumsum(width) - width
        self.flat, self.ends, self.known = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def add(self, parts: np.ndarray, made: np.ndarray) -> None:
        made, self.known = unmarked(made, self.known), self.known + int((made == 0).sum())
        length = self.length[made]
        ids = take(self.unit_ids, self.begin[made], length)
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(parts)]
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])

    def encoded(self, data: bytes) -> pa.RecordBatch:
        doc, none, hashes, sizes, word, parts, made = spread(data, *PART)
        word = unmarked(word, len(self.ends) - 1)
        self.add(parts, made)
        n = self.ends[word + 1] - self.ends[word]
        flat = take(self.flat, self.ends[word], n)
        stops = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        width = self.width[flat]
        back = take(self.decoded, self.at[flat], width)
        cuts = np.concatenate([[0], np.cumsum(width)])[stops].tolist()
        same = np.array([xxhash.xxh3_64_intdigest(back[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64) == hashes
        lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32()))
        columns = [pa.array(doc, mask=none), pa.array(np.diff(stops), pa.int64()), lists, pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, schema=ENCODED)


def decode(encoded_docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded_docs(ids, ...)`` plus ``decoded``: ids to text, without the added leading space.

    Null ids and empty ids give the empty text; an id outside the vocabulary and a null id add nothing.
    """
    shared = encoded_docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary).decoded)

    @F.pandas_udf("string")
    def text_of(ids):
        table_ = shared.value
        piece = lambda i: table_[int(i)] if i == i and 0 <= i < len(table_) else b""
        return ids.map(lambda x: b"".join(map(piece, x if x is not None else ()))[1:].decode("utf-8", "replace"))

    return encoded_docs.withColumn("decoded", text_of("ids"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
