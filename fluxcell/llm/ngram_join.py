"""Exact n-gram Jaccard join: prefix candidates, a trie of globally ordered sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxcell.llm.common import (
    COUNTS,
    Forest,
    components,
    count_rows,
    cut,
    drop,
    lean,
    mix64,
    rows,
    sliced,
    table,
    texts,
    total_counts,
    word_hashes,
)

WORDS = 5
SKETCH_BITS = 20
BLOCK_TOKENS = 1 << 20  # that one trie holds, about
FILTER_BITS = 24  # size of the fixed-size filters of candidates' doc_ids and of nodes
QUERIES = 128  # sets that traverse a trie together
SALTS = 64
PIVOTS = 8
REMEMBERED = 1 << 19
PEELS = 1
EXTRA = 8  # a prefix is longer by an EXTRA-th of its set than it must be, so that more of it has to be shared
NAME_BITS = 48  # of a token's hash that tell tokens of prefixes apart; two with one name only make more candidates
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles (of all its words where it has fewer)."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone is lowered, ASCII white space alone parts words
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(WORDS, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = x * GOLDEN + h[i : len(h) - k + 1 + i]
    return np.unique(mix64(x))


def linked(both: int, a: int, b: int) -> bool:
    return 7 * both >= 3 * (a + b)  # 100 * intersection >= 75 * union


def set_ids(found: np.ndarray) -> tuple[int, int]:
    """Hashes of a set, of 48 and of 64 bits: the mixed sum and the mixed exclusive or of its members' hashes."""
    if not len(found):
        return 0, 0
    both = np.array([found.sum(dtype=np.uint64), np.bitwise_xor.reduce(found)], np.uint64)
    h, g = mix64(both)
    return int(h >> np.uint64(16)), int(g.view(np.int64))


def levels(counts: np.ndarray) -> np.ndarray:
    """How much more frequent than chance a bucket's shingles are, on a log scale; 0 for ordinary ones."""
    mean = float(np.median(counts))
    excess = np.maximum(counts - mean - 3 * np.sqrt(mean + 1) - 3, 0)
    return np.ceil(np.log2(1 + excess)).astype(np.uint8)


def ordered(found: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set's tokens in the global order: rare before frequent, then by hash; as sortable integers."""
    bucket = (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return np.sort((level[bucket].astype(np.uint64) << np.uint64(57)) | (found & np.uint64((1 << 57) - 1)))


def packed(tokens: np.ndarray) -> bytes:
    """Ascending tokens without loss: differences, by planes of bytes, of which the high ones compress."""
    planes = np.diff(tokens, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def called(tokens: np.ndarray) -> np.ndarray:
    """What tokens are called in prefixes: ``NAME_BITS`` of the hash, and a bit above them for hot ones."""
    hot = (tokens >> np.uint64(57) > 0).astype(np.uint64)
    return (hot << np.uint64(NAME_BITS)) | (tokens & np.uint64((1 << NAME_BITS) - 1))


def prefix_length(n: int) -> int:
    """First tokens of a set of n of which any set it links to must share ``1 + min(n) // EXTRA`` in its own."""
    return min(n, n - -(-3 * n // 4) + 1 + n // EXTRA)


def shared_tokens(found: DataFrame) -> DataFrame:
    """Distinct rows (token, salt, node) whose token another node has too; hot tokens count as shared."""
    w = Window.partitionBy("token", "salt")
    both = found.withColumns(
        {
            "low": F.min("node").over(w),
            "high": F.max("node").over(w),
            "last": F.lag("node").over(w.orderBy("node")),
        }
    )
    other = (F.col("low") < F.col("high")) | (F.col("token") >= 1 << NAME_BITS)
    return both.where(other & (F.col("last").isNull() | (F.col("last") != F.col("node")))).select("token", "salt", "node")


def filter_place(key: str):
    """A key's bit in a filter of fixed size."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)


def filter_words(df: DataFrame, key: str) -> DataFrame:
    """Rows (w, bits) of the filter of a column's values: words of 64 bits, 2 ** (FILTER_BITS - 6) at most."""
    at = df.select(filter_place(key).alias("at"))
    at = at.select(F.expr("cast(at div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    return at.groupBy("w").agg(F.bit_or("b").alias("bits"))


def let_pass(df: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The rows that a filter lets pass, without a shuffle: all whose key it holds, and a share of others."""
    at = df.withColumn("at", filter_place(key)).withColumn("v", F.expr("cast(at div 64 as int)"))
    bit = F.expr("shiftrightunsigned(bits, cast(at % 64 as int)) & 1L")
    return at.join(F.broadcast(words), (F.col("v") == F.col("w")) & (bit == 1)).select(*df.columns)


def crossing(told: DataFrame) -> DataFrame:
    """Rows (token, x, block, label) whose token stands in other classes (labels) and in other blocks too, by one shuffle."""
    w = Window.partitionBy("token")
    ends = {f"{f.__name__}_{c}": f(c).over(w) for c in ("label", "block") for f in (F.min, F.max)}
    both = told.withColumns(ends).where("min_label < max_label and min_block < max_block")
    return both.select("token", "x", "block", "label")


def traverse(sets: list[np.ndarray], sizes: list[int], queries: list[np.ndarray], wanted: list[int], link) -> None:
    """Call ``link(set, query)`` for every pair that reaches the Jaccard bound.

    The sets are stored as a trie, shared tokens first; it is walked once for all queries, whose
    overlap with a path is counted once for all sets below it. A query leaves a subtree when even
    the remaining lengths cannot reach the bound for its shortest set.
    """
    every = np.concatenate(queries) if queries else np.zeros(0, np.uint64)
    token, times = np.unique(np.concatenate([*sets, every]), return_counts=True)
    rank = np.argsort(np.argsort(-times, kind="stable"))
    place = lambda s: rank[np.searchsorted(token, s)]
    once = times < 2  # held by one set alone: counts for its length only
    used = int((~once).sum())
    tries = [np.sort(p[p < used]) for p in map(place, sets)]
    member = np.zeros((used, len(queries)), bool)
    for q, p in enumerate(map(place, queries)):
        member[p[p < used], q] = True
    order = sorted(range(len(tries)), key=lambda i: tries[i].tolist())
    tries, size = [tries[i] for i in order], np.array([sizes[i] for i in order])
    lcp = np.zeros(len(tries), np.int64)
    for i in range(1, len(tries)):
        n = min(len(tries[i]), len(tries[i - 1]))
        differ = np.flatnonzero(tries[i][:n] != tries[i - 1][:n])
        lcp[i] = differ[0] if len(differ) else n
    want = np.array(wanted)
    stack = [(0, len(tries), 0, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
    while stack:
        lo, hi, depth, active, overlap = stack.pop()
        end = len(tries[lo]) if hi - lo == 1 else int(min(lcp[lo + 1 : hi].min(), len(tries[lo])))
        if end > depth:
            overlap = overlap + member[tries[lo][depth:end]][:, active].sum(0)
        longest, shortest = size[lo:hi].max(), size[lo:hi].min()
        rest = np.minimum(longest - end, want[active] - overlap)
        stay = 7 * (overlap + rest) >= 3 * (want[active] + shortest)
        active, overlap = active[stay], overlap[stay]
        if not len(active):
            continue
        i = lo
        while i < hi and len(tries[i]) == end:  # sets that end here
            for q in active[7 * overlap >= 3 * (want[active] + size[i])]:
                link(order[i], int(q))
            i += 1
        while i < hi:
            j = i + 1
            while j < hi and lcp[j] > end:
                j += 1
            stack.append((i, j, end, active, overlap))
            i = j


def trie_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    forest = Forest(len(left) + (0 if right is None else len(right)))
    ids = [x for x, _ in left] + ([] if right is None else [x for x, _ in right])
    sets = [s for _, s in left]
    sizes = [len(s) for s in sets]
    for i in range(0, len(other), QUERIES):
        some = [s for _, s in other[i : i + QUERIES]]
        traverse(sets, sizes, some, [len(s) for s in some], lambda s, q, i=i: forest.join(s, shift + i + q))
    return [(ids[a], ids[b]) for a, b in forest.links]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SET = "comp long, block long, other long, side boolean, node long, tokens binary"


def join_blocks(blocks: DataFrame) -> DataFrame:
    """Links within each group of rows (comp, block, other, side, node, tokens), as a forest.

    Rows of a group have one block's sets (side false) and, where block <> other, the other's
    (side true). The rows come sorted, so a task holds one group at a time.
    """
    keys = ["comp", "block", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right, held = None, [], [], 0

        def finish() -> list[tuple[int, int]]:
            if not left or (at[1] == at[2] and len(left) < 2) or (at[1] != at[2] and not right):
                return []
            return trie_links(left, None if at[1] == at[2] else right)

        for batch in batches:
            out = []
            for comp, block, other, side, node, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, block, other) != at or held > 2 * BLOCK_TOKENS:
                    out += finish()  # the queries of a block may come in several lots
                    left = left if (comp, block, other) == at else []
                    at, right, held = (comp, block, other), [], 0
                some = right if side else left
                if not some or some[-1][0] != node:  # sorted, so that repeats are neighbours
                    some.append((node, unpacked(tokens)))
                    held += side * len(some[-1][1])
            if out:
                yield rows({"a": [x for x, _ in out], "b": [y for _, y in out]}, LINKS)
        if out := finish():
            yield rows({"a": [x for x, _ in out], "b": [y for _, y in out]}, LINKS)

    names = [x.split()[0] for x in SET.split(", ")]
    dealt = blocks.select(*names).repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return dealt.mapInArrow(lean(run), "a long, b long")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, class_h, class_g)`` for every row of ``docs(doc_id, text)``.

    Two documents link when the Jaccard similarity of their sets of five-word shingles is at
    least 0.75; component_id is the smallest doc_id reachable by links. All links count, none
    is sampled or capped. (class_h, class_g) names the component, whatever its doc_ids; text_hash
    is xxhash64 of the text.

    1. Sets become sorted 64-bit hashes; a fixed-size sketch of shingle frequencies gives the
       global order, rare first. Equal sets are one node, known by two hashes (h, g) of 48 and 64 bits. Where
       two sets share h alone, steps 2 to 4 treat their tokens as one set's, which loses nothing.
    2. A set's prefix, its first n - ceil(3n/4) + k tokens with k = 1 + n // 8, must share at
       least 1 + 3n // 32 tokens with that of any set it links to. Nodes whose prefix shares fewer
       with all others together are left out, repeatedly. Nodes that share a prefix token are
       chained, hot tokens by salted parts; links can be within a chain component only.
    3. A component's sets are stored in tries of about ``BLOCK_TOKENS`` tokens at most, with a few pivots
       of the component in each, and joined there. What the pivots have brought together needs no
       further comparison; a set then also meets each block of neighbouring size in which sets of
       other classes hold enough of its prefix's tokens.
    4. Each join returns a spanning forest of its links, never all pairs.

    Null, blank or empty text: empty set, linked with nothing, its own component. Fewer words
    than five: one shingle. Very long texts give their whole set. Rows with one doc_id each have their own set. Null doc_id: the row
    takes part, and is no component's smallest id unless all are null. Other columns are left
    behind. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    named = [(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "h", "g", "least")]
    schema = pa.schema([*named, *COUNTS])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = set(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in sliced(batches, "text"):
            n, hs, gs, least, fresh = [], [], [], [], []
            for text in texts(batch.column(1)):
                found = shingles(text)
                h, g = set_ids(found)
                n.append(len(found))
                hs.append(h)
                gs.append(g)
                least.append(int(found[0].view(np.int64)) if len(found) else 0)
                if (h, g) not in seen:  # a copy adds nothing
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add((h, g))
                    fresh.append(found >> np.uint64(64 - SKETCH_BITS))
            if fresh:
                total += np.bincount(np.concatenate(fresh).astype(np.int64), minlength=len(total))
            ids = dict(zip(("doc_id", "text_hash"), (batch.column(i).to_pylist() for i in (0, 2)), strict=True))
            none = [None] * len(n)
            yield rows(ids | {"n": n, "h": hs, "g": gs, "least": least, "chunk": none, "part": none, "counts": none}, schema)
        counts = count_rows(total, TaskContext.get().partitionId())
        none = pa.nulls(counts.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none] * len(named) + counts.columns, schema=schema)

    kind = "doc_id long, text_hash long, n long, h long, g long, least long, chunk int, part int, counts binary"
    both = cut(docs.mapInArrow(lean(sketch), kind), "sets")
    listed = both.where("n is not null").select(*[c for c, _ in named])
    level = spark.sparkContext.broadcast(levels(total_counts(both.where("n is null").select(*COUNTS.names), 1 << SKETCH_BITS)))

    rows_of = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("node", pa.int64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches, "text"):
            toks, nodes = [], []
            for text in texts(batch.column(0)):
                found = shingles(text)
                if not len(found):
                    continue
                h, g = set_ids(found)
                if (h, g) in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add((h, g))
                first = ordered(found, level.value)[: prefix_length(len(found))]
                toks.append(first)
                nodes.append(np.full(len(first), h, np.int64))
            if toks:
                t, node = called(np.concatenate(toks)), np.concatenate(nodes)
                hot = t >> np.uint64(NAME_BITS) > 0
                salt = np.where(hot, mix64(node.view(np.uint64)) % np.uint64(SALTS), 0).astype(np.int32)
                columns = [pa.array(t.view(np.int64)), pa.array(salt), pa.array(node)]
                yield pa.RecordBatch.from_arrays(columns, schema=rows_of)

    found = docs.select("text").mapInArrow(lean(prefixes), "token long, salt int, node long")
    found = cut(shared_tokens(found), "shared")
    sizes = listed.where("n > 0").groupBy("h").agg(F.min("n").alias("n"))
    sizes = cut(sizes, "sizes", small=True)
    need = 1 + F.floor(F.col("n") * 3 / (4 * EXTRA))
    for _ in range(PEELS):
        has = found.groupBy("node").agg(F.count("*").alias("has"))
        able = has.join(sizes, F.col("node") == F.col("h")).where(F.col("has") >= need).select("node")
        # the filter also lets through some nodes that are not able, which costs rows and no links
        able = cut(filter_words(able, "node"), "able", small=True)
        before, found = found, cut(shared_tokens(let_pass(found, "node", able)), "shared")
        drop(before)
    spot = Window.partitionBy("token", "salt").orderBy("node")
    chained = found.withColumn("last", F.lag("node").over(spot))
    # a row per link of a chain; the head of each part of a hot token, to chain the parts
    chained = chained.where(f"last is not null or token >= 1L << {NAME_BITS}").select(
        "token", F.col("last").alias("a"), F.col("node").alias("b")
    )
    chained = cut(
        chained.select(F.when(F.col("a").isNull(), F.col("token")).alias("token"), "a", "b").distinct(), "chains"
    )
    parts = Window.partitionBy("token").orderBy("b")  # at most SALTS rows for each token
    heads = chained.where("a is null").select(F.lag("b").over(parts).alias("a"), "b").where("a is not null")
    group = components(chained.where("a is not null").select("a", "b").unionByName(heads))

    # one document's text for each set that shares a prefix; from here on a node is a number of its own
    chosen = listed.where("n > 0").groupBy("h", "g").agg(F.min(F.struct("doc_id", "n", "least")).alias("d"))
    chosen = cut(
        chosen.join(group, F.col("h") == F.col("node")).select(
            F.col("d.doc_id").alias("__doc"), F.col("d.n").alias("n"), F.col("d.least").alias("least"),
            F.col("h").alias("node_h"), F.col("g").alias("node_g"), F.col("component").alias("comp"),
            F.monotonically_increasing_id().alias("node"),
        ),
        "candidates",
        small=True,
    )
    # blocks: by size class, whose neighbours alone can link, by the least token, which near copies
    # tend to share, and, where that gathers too much, by hash; a small component is one block
    cls = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    total = chosen.groupBy("comp").agg(F.sum("n").alias("m"))
    classes = chosen.groupBy("comp", cls.alias("cls")).agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts"))
    plan = cut(classes.join(total, "comp"), "plan", small=True).withColumnsRenamed({"comp": "c2", "cls": "l2"})
    dealt = chosen.withColumn("cls", cls).join(plan, (F.col("comp") == F.col("c2")) & (F.col("cls") == F.col("l2")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("least"), "parts")).drop("c2", "l2")
    heavy = dealt.groupBy("comp", "cls", "part").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("subs")).where("subs > 1")
    heavy = cut(heavy, "heavy", small=True).withColumnsRenamed({"comp": "c2", "cls": "l2", "part": "p2"})
    same = (F.col("comp") == F.col("c2")) & (F.col("cls") == F.col("l2")) & (F.col("part") == F.col("p2"))
    sub = F.pmod(F.xxhash64("node"), F.coalesce("subs", F.lit(1)))
    block = F.when(F.col("m") > BLOCK_TOKENS, F.xxhash64("cls", "part", sub)).otherwise(F.lit(0))
    dealt = dealt.join(heavy, same, "left").select("__doc", "n", "node", "node_h", "node_g", "comp", "cls", block.alias("block"))
    dealt = cut(dealt, "blocks", small=True)

    # sets are made where the text is read, of documents that a filter of fixed size lets pass
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for r in filter_words(dealt, "__doc").collect():  # len(bits) rows at most
        bits[r["w"]] = r["bits"]
    maybe = spark.sparkContext.broadcast(bits.view(np.uint8))
    set_schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("tokens", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((maybe.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            found = list(map(shingles, texts(batch.column(2))))
            tokens = [packed(ordered(x, level.value)) for x in found]
            two = list(map(set_ids, found))
            data = {"h": [h for h, _ in two], "g": [g for _, g in two], "tokens": tokens}
            yield rows(data | {"doc_id": batch.column(0).to_pylist()}, set_schema)

    made = docs.select("doc_id", filter_place("doc_id").alias("at"), "text")
    made = made.mapInArrow(lean(whole), "doc_id long, h long, g long, tokens binary")
    # a repeated doc_id may bring another text
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("h") == F.col("node_h")) & (F.col("g") == F.col("node_g"))
    sets = made.join(dealt, same).select("node", "comp", "block", "cls", "tokens")
    sets = cut(sets, "candidate-sets")  # a repeated row gives its set again; join_blocks skips it

    pair = lambda d, other, side: d.select("comp", "block", other.alias("other"), F.lit(side).alias("side"), "node", "tokens")  # noqa: E731, E501
    large = cut(dealt.where("block <> 0").select("comp", "block", "cls").distinct(), "large", small=True)
    pivot = F.struct(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("p"))
    pivots = sets.where("block <> 0").groupBy("comp", "cls", pivot).agg(F.min("node").alias("node"))
    pivots = sets.join(cut(pivots.select("node"), "pivots", small=True), "node", "left_semi")
    pivots = pivots.select("node", "tokens", F.col("comp").alias("c2"), F.col("block").alias("own"), F.col("cls").alias("l2"))
    near = (F.col("c2") == F.col("comp")) & (F.col("own") != F.col("block")) & (F.abs(F.col("l2") - F.col("cls")) <= 1)
    first = pair(sets, F.col("block"), False).unionByName(pair(pivots.join(large, near), F.col("block"), False))
    links = cut(join_blocks(first), "links")
    if not large.isEmpty():
        now = components(links)
        state = dealt.where("block <> 0").join(now.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left")
        state = state.select(F.col("node").alias("x"), "node_h", "comp", "block", "cls", "n", F.coalesce("component", "node").alias("label"))
        state = cut(state, "state", small=True)
        # a set must still meet a block where enough of its prefix's tokens stand in sets of other classes;
        # all sets with a token are in one chain component, so the token alone names the rows that may meet
        told = found.select("token", "node").join(state, F.col("node") == F.col("node_h")).select("token", "x", "block", "label")
        for _ in range(PEELS):  # sets with too few tokens that other classes in other blocks have
            told = crossed = cut(crossing(told), "told")
            able = told.groupBy(F.col("x").alias("x2")).agg(F.count("*").alias("has"))
            able = able.join(state, F.col("x2") == F.col("x")).where(F.col("has") >= need).select("x2", "cls")
            told = told.join(cut(able, "able", small=True), F.col("x") == F.col("x2"))
            told = told.select("token", "x", "block", "cls", "label")
        told = cut(told, "told")
        drop(crossed)
        held = told.groupBy("token", "block", "cls").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        held = cut(held, "held").withColumnsRenamed({"token": "t2", "block": "b2", "cls": "l2"})
        meets = (
            (F.col("token") == F.col("t2"))
            & (F.col("block") != F.col("b2"))
            & (F.abs(F.col("cls") - F.col("l2")) <= 1)
            & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
        )
        todo = told.join(held, meets).groupBy("x", "b2").agg(F.count("*").alias("has"))
        todo = todo.join(state.select(F.col("x").alias("x2"), "n", "comp"), F.col("x") == F.col("x2")).where(F.col("has") >= need)
        todo = cut(todo.select("x", F.col("comp").alias("c2"), "b2"), "todo", small=True)
        # what each set is there for, in small rows; the sets themselves are shuffled once
        asked = cut(todo.select("c2", "b2").distinct(), "asked", small=True)
        meant = dealt.join(asked, (F.col("comp") == F.col("c2")) & (F.col("block") == F.col("b2")), "left_semi")
        meant = meant.join(cut(told.select("x").distinct(), "meetable", small=True), F.col("node") == F.col("x"), "left_semi")
        roles = meant.select(F.col("node").alias("x"), "comp", "block", F.lit(False).alias("side")).unionByName(
            todo.select("x", F.col("c2").alias("comp"), F.col("b2").alias("block"), F.lit(True).alias("side"))
        )
        again = sets.select("node", "tokens").join(cut(roles, "roles", small=True), F.col("node") == F.col("x"))
        links = links.unionByName(cut(join_blocks(again.withColumn("other", F.lit(0).cast("long"))), "more-links"))

    final = components(links).withColumnRenamed("node", "x")
    names = dealt.select("node", "node_h", "node_g")
    roots = names.select(F.col("node").alias("root"), F.col("node_h").alias("root_h"), F.col("node_g").alias("root_g"))
    named = cut(final.join(roots, F.col("component") == F.col("root")).select("x", "root_h", "root_g"), "roots", small=True)
    named = cut(names.join(named, F.col("node") == F.col("x")).drop("node", "x"), "named", small=True)
    own = (F.col("h") == F.col("node_h")) & (F.col("g") == F.col("node_g")) & (F.col("n") > 0)
    known = listed.join(named, own, "left").select(
        "doc_id", "text_hash", "n", F.coalesce("root_h", "h").alias("class_h"), F.coalesce("root_g", "g").alias("class_g")
    )
    known = cut(known, "classes", small=True)
    least = known.where("n > 0").groupBy(F.col("class_h").alias("c"), F.col("class_g").alias("d"))
    least = cut(least.agg(F.min("doc_id").alias("least")), "least", small=True)
    same = (F.col("class_h") == F.col("c")) & (F.col("class_g") == F.col("d")) & (F.col("n") > 0)
    return known.join(least, same, "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "doc_id").alias("component_id"),
        "class_h",
        "class_g",
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
