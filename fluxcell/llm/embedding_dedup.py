"""Embedding near-duplicates: a navigable small-world graph per shard, audited, then components."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcell.llm.common import Forest, components, cut, mix64, rows, table

LEAST = 0.98
SHARD = 16_384  # vectors of a shard, about: a search takes little longer in a larger shard, and there are fewer to search
NEIGHBOURS = 12  # of a node in upper layers; twice as many in the lowest
BUILD_BEAM = 48
FIRST_BEAM = 32
AUDITED = 64  # queries of each search that are held against an exact scan
PROBES = 256  # made-up queries of an audit, each just linked to a node of the shard
RECALL = 0.995
TOGETHER = 256  # queries that walk a graph together
STEP = 4  # nodes that a query expands at once
NONE = np.float32(-np.inf)


def walk(vec, near, queries, start, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first beam search of one layer for many queries at once: (ids, similarities), unsorted, -1 for none."""
    m, n = len(queries), len(vec)
    ids = np.full((m, beam), -1, np.int32)
    sim = np.full((m, beam), NONE, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)  # the last column stands for no neighbour
    seen[:, n] = True
    ids[:, 0], done[:, 0] = start, False
    sim[:, 0] = np.einsum("ij,ij->i", queries, vec[start])
    seen[np.arange(m), start] = True
    live = np.arange(m)
    step = min(STEP, beam)
    while len(live):
        open_ = np.where(done[live], NONE, sim[live])
        pick = np.argpartition(-open_, step - 1, 1)[:, :step]
        good = np.take_along_axis(open_, pick, 1) > NONE
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        at = live[:, None]
        done[at, pick] = True
        nodes = np.where(good, ids[at, pick], -1)
        nb = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(live), -1)
        nb[nb < 0] = n
        nb = np.sort(nb, 1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = n
        nb[seen[at, nb]] = n
        seen[at, nb] = True
        width = int((nb < n).sum(1).max(initial=0))
        if not width:
            continue
        nb = np.sort(nb, 1)[:, :width]
        d = np.einsum("imd,id->im", vec[np.minimum(nb, n - 1)], queries[live])
        d[nb == n] = NONE
        all_sim = np.concatenate([sim[live], d], 1)
        all_ids = np.concatenate([ids[live], nb.astype(np.int32)], 1)
        all_done = np.concatenate([done[live], nb == n], 1)
        top = np.argpartition(-all_sim, beam - 1, 1)[:, :beam]
        sim[live] = np.take_along_axis(all_sim, top, 1)
        ids[live] = np.take_along_axis(all_ids, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)
    ids[sim == NONE] = -1
    return ids, sim


def diverse(vec, ids, sim, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row's vector than to any kept one; then the nearest of the rest."""
    order = np.argsort(-sim, 1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    m, k = ids.shape
    got = vec[np.maximum(ids, 0)]
    between = np.einsum("iad,ibd->iab", got, got)
    kept, closest, count = np.zeros((m, k), bool), np.full((m, k), NONE, np.float32), np.zeros(m, int)
    for c in range(k):
        take = (sim[:, c] > NONE) & (closest[:, c] < sim[:, c]) & (count < most)
        kept[take, c] = True
        count += take
        closest[take] = np.maximum(closest[take], between[take, c])
    rank = np.where(kept, 0, np.where(sim > NONE, 1, 2)) * k + np.arange(k)
    first = np.argsort(rank, 1)[:, :most]
    out = np.take_along_axis(np.where(sim > NONE, ids, -1), first, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def led(inside: np.ndarray, best: np.ndarray, bar: float) -> np.ndarray:
    """For each vector of a batch, the first earlier one without a leader that is as near as ``bar``, or -1;
    ``best`` is how near each is to its nearest of the graph: those over ``bar`` have their leader there."""
    leader = np.full(len(best), -1)
    free = best < bar
    for i in np.flatnonzero(free & (inside >= bar).any(1)):
        of = np.flatnonzero(free[:i] & (inside[i, :i] >= bar))
        if len(of):
            leader[i], free[i] = of[0], False
    return leader


def build(vec: np.ndarray, nodes: np.ndarray, least: float | None = None) -> dict[str, np.ndarray]:
    """A hierarchical navigable small-world graph; ``nodes`` (ids) seed the levels, so reruns agree.

    Vectors are inserted in growing batches. A batch is searched from the top layer down in the
    graph so far and compared within itself; links go both ways and a full node keeps a diverse
    choice of its neighbours.

    With ``least``, a vector that is found linked to one of the graph is not inserted but follows it: ``leader`` names
    each vector's (itself where it stands in the graph). So a large group of near copies is a few nodes, and neither
    fills the beams of its queries nor closes its nodes off from the rest.
    """
    n = len(vec)
    u = (mix64(nodes.astype(np.int64).view(np.uint64)) >> np.uint64(11)) / float(1 << 53)
    level = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(NEIGHBOURS)).astype(int)
    order = np.argsort(-level, kind="stable")  # upper layers first, so that every search has an entry
    vec, level = vec[order], level[order]
    bar = np.inf if least is None else least + 1e-5  # above what single precision may take for a link
    leader = np.arange(n)
    layers = [np.full((n, NEIGHBOURS * (2 if h == 0 else 1)), -1, np.int32) for h in range(level.max(initial=0) + 1)]
    size = 0
    while size < n:
        batch = np.arange(size, min(n, size + max(16, min(size, 512))))
        q = vec[batch]
        inside = q @ q.T
        np.fill_diagonal(inside, NONE)
        start, best = np.zeros(len(batch), np.int64), np.full(len(batch), NONE)
        met = {}
        for h in range(len(layers) - 1, -1, -1):
            if size:
                met[h] = walk(vec[:size], layers[h][:size], q, start, BUILD_BEAM if (level[batch] >= h).any() else 1)
                start, best = met[h][0][np.arange(len(batch)), met[h][1].argmax(1)], met[h][1].max(1)
            else:
                met[h] = np.zeros((len(batch), 0), np.int32), np.zeros((len(batch), 0), np.float32)
        mate = led(inside, best, bar)
        leader[batch] = np.where(best >= bar, start, np.where(mate >= 0, batch[mate], batch))
        stands = leader[batch] == batch
        for h in range(len(layers) - 1, -1, -1):
            near, (ids, sim) = layers[h], met[h]
            here = (level[batch] >= h) & stands
            if not here.any():
                continue
            mates = np.where(here[None, :], inside, NONE)
            k = min(BUILD_BEAM, len(batch))
            best = np.argpartition(-mates, k - 1, 1)[:, :k]
            ids = np.concatenate([ids, batch[best].astype(np.int32)], 1)[here]
            sim = np.concatenate([sim, np.take_along_axis(mates, best, 1)], 1)[here]
            ids[sim == NONE] = -1
            chosen = diverse(vec, ids, sim, near.shape[1])
            mine = batch[here]
            near[mine] = chosen
            # the links back
            to, back = chosen.ravel(), np.repeat(mine, chosen.shape[1])
            to, back = to[to >= 0], back[to >= 0]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            for i in range(0, len(target), 512):
                t, f, c = target[i : i + 512], first[i : i + 512], count[i : i + 512]
                extra = np.full((len(t), c.max()), -1, np.int32)
                col = np.concatenate([np.arange(x) for x in c])
                extra[np.repeat(np.arange(len(t)), c), col] = back[f[0] : f[-1] + c[-1]]
                full = np.sort(np.concatenate([near[t], extra], 1), 1)[:, ::-1]
                full[:, 1:][full[:, 1:] == full[:, :-1]] = -1
                s = np.einsum("imd,id->im", vec[np.maximum(full, 0)], vec[t])
                s[full < 0] = NONE
                near[t] = diverse(vec, full, s, near.shape[1])
        size = batch[-1] + 1
    back = np.argsort(order)
    names = {f"layer{h}": np.where(x >= 0, order[np.maximum(x, 0)], -1)[back].astype(np.int32) for h, x in enumerate(layers)}
    return names | {"entry": np.array([order[0] if n else 0])} | ({} if least is None else {"leader": order[leader][back]})


def search(vec, graph, queries, beam: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.full(len(queries), graph["entry"][0])
    for h in range(sum(k.startswith("layer") for k in graph) - 1, 0, -1):
        ids, sim = walk(vec, graph[f"layer{h}"], queries, start, 1)
        start = ids[np.arange(len(queries)), sim.argmax(1)]
    return walk(vec, graph["layer0"], queries, start, beam)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Groups:
    """The vectors that follow each node of a graph, and how near a query must come to a node to reach a link among them."""

    def __init__(self, graph: dict[str, np.ndarray], n: int, least: float):
        self.leader = graph.get("leader", np.arange(n))
        self.order = np.argsort(self.leader, kind="stable")
        self.first = np.searchsorted(self.leader[self.order], np.arange(n + 1))
        self.size = np.diff(self.first)
        self.standing = int((self.size > 0).sum())  # nodes of the graph
        # a follower's angle to its node is at most that of a link, so the two angles add up
        self.bar = (2 * least * least - 1 if least > 0 else -1.0) if self.standing < n else least

    def of(self, node: int) -> np.ndarray:
        return self.order[self.first[node] : self.first[node + 1]]


def linked(x, vec, graph, y, beam: int, least: float):
    """(query, node) pairs with cosine >= least: found by beams that widen for a query until its
    beam holds something too far for a link; for a beam as wide as the graph, all of it is compared.
    Vectors that follow a node are compared where a beam meets the node."""
    todo = np.arange(len(y))
    single = y.astype(np.float32)
    groups = Groups(graph, len(x), least)
    bar = groups.bar - 1e-4
    while len(todo):
        if beam >= groups.standing:
            for i in range(0, len(todo), TOGETHER):
                some = todo[i : i + TOGETHER]
                q, node = np.nonzero(y[some] @ x.T >= least)
                yield some[q], node
            return
        again = []
        for i in range(0, len(todo), TOGETHER):
            some = todo[i : i + TOGETHER]
            ids, sim = search(vec, graph, single[some], beam)
            full = sim.min(1) >= bar
            again.append(some[full])
            q, at = np.nonzero((sim >= bar) & ~full[:, None])
            q, node = some[q], ids[q, at]
            alone = groups.size[node] == 1
            q1, node1 = q[alone], node[alone]
            true = np.einsum("ij,ij->i", y[q1], x[node1]) >= least
            yield q1[true], node1[true]
            q, node = q[~alone], node[~alone]
            by = np.argsort(node, kind="stable")
            for same in np.split(by, np.flatnonzero(np.diff(node[by])) + 1) if len(by) else ():
                members = groups.of(node[same[0]])
                a, b = np.nonzero(y[q[same]] @ x[members].T >= least)
                yield q[same][a], members[b]
        todo, beam = np.concatenate(again), beam * 2


def probes(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Evenly spaced nodes of a shard, and for each a vector at cosine ``least`` from it, in a random direction."""
    node = np.arange(0, len(x), max(1, len(x) // PROBES))
    u = np.random.default_rng(len(x)).normal(size=(len(node), x.shape[1]))
    u -= (u * x[node]).sum(1, keepdims=True) * x[node]
    u /= np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-12)
    return node, least * x[node] + np.sqrt(1 - least * least) * u


def passing_beam(x, vec, graph, y, least: float) -> int:
    """The first beam that passes two audits: from queries at the least cosine of a link from a node of the shard
    (``probes``, which every shard has, however rare its links are) it finds ``RECALL`` of those nodes, and of
    evenly spaced real queries ``RECALL`` of the links that an exact scan finds. A node that follows another is found with it."""
    node, probe = probes(x, least)
    groups = Groups(graph, len(x), least)
    node = groups.leader[node]
    probe = probe.astype(np.float32)
    audit = y[:: max(1, len(y) // AUDITED)]
    true = int((audit @ x.T >= least).sum())
    beam = FIRST_BEAM
    while beam < groups.standing:
        ids, _ = search(vec, graph, probe, beam)
        if (ids == node[:, None]).any(1).mean() >= RECALL:
            if sum(len(q) for q, _ in linked(x, vec, graph, audit, beam, least)) >= RECALL * true:
                return beam
        beam *= 2
    return max(beam, len(x))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


INDEX = pa.schema([("space", pa.int64()), ("shard", pa.int64()), ("vectors", pa.binary()), ("graph", pa.binary())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def near_duplicate_vectors(vectors: DataFrame, least: float = LEAST, shard_size: int = SHARD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows link when labels are equal and not null and the cosine, in double precision, is at least
    ``least``. A vector that is null, empty, zero or holds null or non-finite components links
    with nothing; so do vectors of different lengths.

    Equal vectors of a label are one node with a count. The nodes of a label (and length) are
    dealt by hash to shards of about ``shard_size``; each shard's graph is built once, and every
    shard of the label is queried with all the label's nodes, a shard at a time. Beams widen until
    audits pass, of made-up queries just linked to known nodes and of real ones against an exact scan, and further for
    queries whose beam is full of links. A vector linked to one that stands in the graph already follows it instead of standing
    there too; walks then go for all nodes within twice a link's angle, and their followers are compared.
    Every link is verified. A search returns counts by query and a spanning forest of its links,
    never all pairs; components come from the forests.

    Rows with one vec_id are vectors of their own; null vec_id takes part and is no smallest id
    unless all are null. component_id is the row's own vec_id where nothing links. An empty table
    gives an empty result. Other columns are left behind.
    """
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"), "label")
    # by a power of two, which is exact, so that no square of a finite component overflows or vanishes
    largest = F.array_max(F.transform("x", F.abs))
    power = F.pow(F.lit(2.0), -F.greatest(F.least(F.floor(F.log2(largest)), F.lit(1023)), F.lit(-1022)))
    sound = (
        F.col("label").isNotNull()
        & F.col("x").isNotNull()
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & (largest > 0)
    )
    vectors = vectors.withColumn("x", F.when(sound, F.transform("x", lambda v: v * power)).otherwise(F.col("x")))
    listed = cut(
        vectors.withColumns(
            {
                "sound": F.coalesce(sound, F.lit(False)),
                "h": F.xxhash64("label", "x"),
                "g": F.xxhash64(F.lit("second"), "label", "x"),
                "space": F.xxhash64("label", F.size("x")),
            }
        ),
        "vectors",
    )
    nodes = listed.where("sound").groupBy("h", "g").agg(
        F.first("x").alias("x"), F.first("space").alias("space"), F.count("*").alias("times")
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    spaces = nodes.groupBy("space").agg(F.ceil(F.count("*") / shard_size).alias("shards"))
    spaces = cut(spaces, "spaces", small=True).withColumnRenamed("space", "s")
    dealt = nodes.join(spaces, F.col("space") == F.col("s")).select(
        "space", F.pmod("h", "shards").alias("shard"), "node", "times", "x"
    )

    def index(t: pa.Table) -> pa.Table:
        node, times = (t.column(c).to_numpy() for c in ("node", "times"))
        x = np.array(t.column("x").combine_chunks().flatten()).reshape(len(node), -1)
        y = unit(x)
        data = {
            "space": [t.column("space")[0].as_py()],
            "shard": [t.column("shard")[0].as_py()],
            "vectors": [packed(node=node, times=times, x=y)],
            "graph": [packed(**build(y.astype(np.float32), node, least))],
        }
        return pa.Table.from_batches([rows(data, INDEX)])

    shards = dealt.groupBy("space", "shard").applyInArrow(index, "space long, shard long, vectors binary, graph binary")
    shards = cut(shards, "shards")
    other = shards.select(F.col("space").alias("s"), F.col("shard").alias("asked"))
    pairs = cut(shards.select("space", "shard").join(other, F.col("space") == F.col("s")).drop("s"), "shard-pairs", small=True)
    have = pairs.join(shards, ["space", "shard"])
    ask = pairs.join(
        shards.select(F.col("space"), F.col("shard").alias("asked"), F.col("vectors")), ["space", "asked"]
    )
    tasks = have.select("space", "shard", "asked", "vectors", "graph").unionByName(
        ask.select("space", "shard", "asked", "vectors", F.lit(None).cast("binary").alias("graph"))
    )

    def find(t: pa.Table) -> pa.Table:
        got = t.to_pylist()
        stored = next(r for r in got if r["graph"] is not None)
        asked = next(r for r in got if r["graph"] is None)
        a, b = (dict(np.load(io.BytesIO(r["vectors"]))) for r in (stored, asked))
        graph = dict(np.load(io.BytesIO(stored["graph"])))
        same = stored["shard"] == stored["asked"]
        x, y = a["x"], b["x"]
        single = x.astype(np.float32)
        beam = passing_beam(x, single, graph, y, least)
        count = np.zeros(len(y), np.int64)
        forest = Forest(len(x) + (0 if same else len(y)))
        shift = 0 if same else len(x)
        if same:
            for i, j in enumerate(graph["leader"].tolist()):
                forest.join(j, i)
        for q, node in linked(x, single, graph, y, beam, least):
            if same:
                other_one = q != node
                q, node = q[other_one], node[other_one]
            np.add.at(count, q, a["times"][node])
            # one link with a leader's followers joins them all: they are linked with it
            new = np.ones(len(q), bool)
            new[1:] = (np.diff(q) != 0) | (np.diff(graph["leader"][node]) != 0)
            for i, j in zip(q[new].tolist(), node[new].tolist(), strict=True):
                forest.join(j, shift + i)
        ids = np.concatenate([a["node"], [] if same else b["node"]]).astype(np.int64)
        link = np.array(forest.links, np.int64).reshape(-1, 2)
        some = np.flatnonzero(count)
        none = [None] * len(some)
        data = {
            "a": [*ids[link[:, 0]].tolist(), *b["node"][some].tolist()],
            "b": [*ids[link[:, 1]].tolist(), *none],
            "n": [*[None] * len(link), *count[some].tolist()],
        }
        return pa.Table.from_batches([rows(data, FOUND)])

    found = cut(tasks.groupBy("space", "shard", "asked").applyInArrow(find, "a long, b long, n long"), "found")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    group = components(found.where("n is null").select("a", "b"))
    nodes = cut(
        nodes.select("h", "g", "node", "times").join(counts, "node", "left").join(group, "node", "left"), "linked", small=True
    ).select(
        F.col("h").alias("h2"),
        F.col("g").alias("g2"),
        (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"),
        F.coalesce("component", "node").alias("class"),
    )
    known = listed.select("vec_id", "h", "g", "sound").join(
        nodes, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")) & F.col("sound"), "left"
    )
    known = cut(known.select("vec_id", "n", "class"), "classes", small=True)
    lowest = cut(known.where("class is not null").groupBy(F.col("class").alias("c")).agg(F.min("vec_id").alias("low")), "least", small=True)
    out = known.join(lowest, F.col("class") == F.col("c"), "left")
    component = F.coalesce("low", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)
"""
