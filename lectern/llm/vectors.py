"""Embedding near-dedup with a robust-pruned flat graph.

Vectors are dealt to the ``overlap`` nearest of a set of centroids, so that shards overlap. In each shard a flat graph is
built: neighbours are taken nearest first, one that is nearer to a kept neighbour than to the node by the factor ``ALPHA`` is
pruned, and some far nodes are kept so that the graph can be crossed. The adjacency lists of a vector are united over its
shards. Then every vector is a query in each of its shards: a greedy search starts at the medoid, and from the nodes it and the
query's own list reach, the range is expanded through all nodes within reach of the threshold. What the search links in a
shard is one group; all pairs of a group are verified in double precision, so that a pair that the search missed inside a
group still counts, and each counts in the first shard that holds both of its vectors.

A search stays within its shard, so a pair that shares no shard is not found. How many there are is measured: recall is audited
on a bounded set of queries drawn from all vectors against a scan of all, and the overlap is raised up to twice while it is
below ``RECALL``; if it still is, all pairs are compared, block by block, which is exact and quadratic.

Centroids are fitted on a bounded sample (``SAMPLE``); every vector is indexed. Tables that need more than ``MAX_CENTROIDS``
shards get a second set of centroids, fitted on what the first leaves of the sample, and a shard for each pair of the two, so
that shards don't grow with the table. Shards larger than a block are cut into blocks and worked on in pairs of blocks, so that
memory is bounded and no pair is lost to the cut.

Vectors of different lengths never link; each length has shards of its own. Centroids are fitted for the ``FITTED`` commonest
lengths, the vectors of any other are one shard. Equal vectors are joined once and counted as often as they occur, whatever
their vec_ids; rows that share a vec_id stay rows of their own, and a component is named by the least vec_id in it. Lengths are
taken after scaling by a power of two, so that neither very large nor very small components overflow. Vectors that are null,
empty, zero or hold null or non-finite components link with nothing and stand for themselves. Rows with a null vec_id count
under the smallest long. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.jaccard import NO_ID, _grouped
from lectern.llm.samples import low
from lectern.llm.words import forest, slices
from lectern.operators.components import components
from lectern.plans.shared import materialize, shuffle_partitions

THRESHOLD = 0.9
#: Cosine down to which the range search goes on.
REACH = 0.8
SAMPLE, SHARD, BLOCK, MAX_CENTROIDS = 20_000, 1_200, 2_000, 4_096
#: Lengths of vectors that centroids are fitted for.
FITTED = 16
NEAR, FAR, POOL, ALPHA = 24, 8, 64, 1.2
OVERLAP, MORE_OVERLAP, RECALL = 4, 3, 0.99
AUDIT = 1_000
#: Queries that are searched, or rows of a group that are verified, at once.
QUERIES = 256


def _doubles(data: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of doubles, each scaled by a power of two; ``kind`` is how their components are stored."""
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(data: list[bytes], kind: str) -> np.ndarray:
    x = _doubles(data, kind)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_length(data: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Lengths in bytes, and the places of the vectors that have them."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    return [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]


def centroids(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means; the start is spread over the sample, whose order is that of a hash."""
    at = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        of = np.concatenate([(sample[i : i + 2048] @ at.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        new = np.zeros_like(at)
        np.add.at(new, of, sample)
        size = np.sqrt((new * new).sum(axis=1))
        at = np.where(size[:, None] > 1e-9, new / np.maximum(size, 1e-9)[:, None], at)
    return at


def books(sample: np.ndarray, count: int, overlap: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Centroids for ``count`` vectors and, if they need more shards than there may be centroids, centroids of what these leave."""
    wanted = max(1, math.ceil(count * overlap / SHARD))
    at = centroids(sample, min(MAX_CENTROIDS, wanted))
    if wanted <= MAX_CENTROIDS:
        return at, None
    rest = sample - at[(sample @ at.T).argmax(axis=1)]
    left = rest[np.linspace(0, len(rest) - 1, min(MAX_CENTROIDS, math.ceil(wanted / MAX_CENTROIDS), len(rest))).astype(int)]
    for _ in range(4):
        of = (rest @ left.T - (left * left).sum(axis=1) / 2).argmax(axis=1)
        total = np.zeros_like(left)
        np.add.at(total, of, rest)
        left = np.where(np.bincount(of, minlength=len(left))[:, None] > 0, total / np.maximum(np.bincount(of, minlength=len(left)), 1)[:, None], left)
    return at, left


def cells(unit: np.ndarray, at: np.ndarray, left: np.ndarray | None, overlap: int) -> np.ndarray:
    """The shards of each vector, in order: its nearest centroids, or pairs of them with the nearest of what they leave."""

    def nearest(sims: np.ndarray, k: int) -> np.ndarray:
        k = min(k, sims.shape[1])
        return np.argpartition(-sims, k - 1, axis=1)[:, :k]

    if left is None:
        return np.sort(nearest(unit @ at.T, overlap), axis=1)
    first = nearest(unit @ at.T, max(1, round(math.sqrt(overlap))))
    second = math.ceil(overlap / first.shape[1])
    found = [first[:, [i]] * len(left) + nearest((unit - at[first[:, i]]) @ left.T - (left * left).sum(axis=1) / 2, second) for i in range(first.shape[1])]
    return np.sort(np.concatenate(found, axis=1), axis=1)


def _assign(known: dict[int, tuple[np.ndarray, np.ndarray | None]], overlap: int, kind: str):
    """Rows: rep, copies, vec -> these and shards: the length of the vector in bytes times 2^32, and its cells."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            data = batch.column(2).to_pylist()
            shards: list = [None] * len(data)
            for size, rows in _by_length(data):
                near = np.zeros((len(rows), 1), np.int64)
                if size in known:
                    near = cells(_unit([data[i] for i in rows], kind), *known[size], overlap)
                for i, x in zip(rows.tolist(), (near + (size << 32)).tolist(), strict=True):
                    shards[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int64()))], names=["rep", "copies", "vec", "shards"])

    return run


def prune(sims: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency (n x degree, -1 where unused) of a graph on vectors with the cosines ``sims``.

    Robust pruning on squared distances 2 - 2 cos, for all nodes at once: each step keeps the nearest candidate left and
    drops those that are nearer to it than to the node by the factor ALPHA.
    """
    n = len(sims)
    random = np.random.Generator(np.random.PCG64(seed))
    rows = np.arange(n)
    out = []
    for degree, pool in ((NEAR, min(POOL, n - 1)), (FAR, min(POOL, n - 1))):
        if pool < 1:
            break
        if degree == NEAR:
            own = sims.copy()
            np.fill_diagonal(own, -9)
            cand = np.argpartition(-own, pool - 1, axis=1)[:, :pool]
        else:
            cand = random.integers(0, n, (n, pool))
        dist = 2 - 2 * np.take_along_axis(sims, cand, axis=1)
        dist[cand == rows[:, None]] = np.inf
        for _ in range(min(degree, pool)):
            best = dist.argmin(axis=1)
            usable = np.isfinite(dist[rows, best])
            if not usable.any():
                break
            kept = cand[rows, best]
            out.append(np.where(usable, kept, -1))
            to_kept = 2 - 2 * sims[kept[:, None], cand]
            dist = np.where(ALPHA * to_kept <= dist, np.inf, dist)
            dist[rows, best] = np.inf
    return np.stack(out, 1) if out else np.full((n, 1), -1)


def _build(kind: str):
    """Adjacency lists of each tile; rows: tile, rep, vec."""

    def run(batches):
        import pyarrow as pa

        for tile, rows in _grouped(batches):
            reps = np.array([r[0] for r in rows], np.int64)
            x = _unit([r[1] for r in rows], kind)
            lists = prune(x @ x.T, tile & 0xFFFFFFFF)
            neighbours = [reps[r[r >= 0]] for r in lists]
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(reps[at : at + 1000]), pa.array(neighbours[at : at + 1000], pa.list_(pa.int64()))], names=["rep", "neighbours"])

    return run


class Graph:
    """Neighbours of ``n`` nodes, both ways along the edges, however many a node has."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        edges = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.to = edges % n
        self.first = np.searchsorted(edges, np.arange(n + 1) * n)

    def neighbours(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ``nodes``, and its neighbours."""
        count = self.first[nodes + 1] - self.first[nodes]
        of = np.repeat(np.arange(len(nodes)), count)
        return of, self.to[np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[nodes], count)]


def _cosines(x: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("pd,pd->p", x[q[i : i + 50_000]], x[v[i : i + 50_000]]) for i in range(0, len(q), 50_000)] or [np.zeros(0)])


def range_search(x: np.ndarray, graph: Graph, queries: np.ndarray, medoid: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within reach that a search of the graph finds, for some nodes as queries."""
    n = len(x)
    rows = np.arange(len(queries))
    seen = np.zeros((len(queries), n), bool)
    seen[rows, queries] = True
    now, best = np.full(len(queries), medoid), x[queries] @ x[medoid]
    found_q, found_v = [rows, rows[best >= REACH]], [queries, now[best >= REACH]]
    seen[:, medoid] = True
    moving = rows
    while len(moving):  # greedy steps, each query to its best neighbour
        of, near = graph.neighbours(now[moving])
        if not len(of):
            break
        q = moving[of]
        sims = _cosines(x, queries[q], near)
        fresh = ~seen[q, near] & (sims >= REACH)
        seen[q, near] = True
        found_q.append(q[fresh])
        found_v.append(near[fresh])
        order = np.lexsort((-sims, of))
        first = order[np.flatnonzero(np.concatenate(([True], np.diff(of[order]) > 0)))]
        first = first[sims[first] > best[q[first]] + 1e-12]
        moving = q[first]
        now[moving], best[moving] = near[first], sims[first]
    frontier_q, frontier_v = np.concatenate(found_q), np.concatenate(found_v)
    out_q, out_v = [frontier_q], [frontier_v]
    while len(frontier_q):
        next_q, next_v = [], []
        for at in range(0, len(frontier_q), 20_000):
            of, near = graph.neighbours(frontier_v[at : at + 20_000])
            q = frontier_q[at : at + 20_000][of]
            pair = np.unique((q * n + near)[~seen[q, near]])
            q, near = pair // n, pair % n
            seen[q, near] = True
            close = _cosines(x, queries[q], near) >= REACH
            next_q.append(q[close])
            next_v.append(near[close])
        frontier_q, frontier_v = np.concatenate(next_q), np.concatenate(next_v)
        out_q.append(frontier_q)
        out_v.append(frontier_v)
    q, v = queries[np.concatenate(out_q)], np.concatenate(out_v)
    return q[q != v], v[q != v]


def _groups(unit: np.ndarray, graph: Graph | None, threshold: float) -> np.ndarray:
    """For each vector of a tile the least row that links lead to: the search's links, or all if there is no graph."""
    n = len(unit)
    label = np.arange(n)
    medoid = int((unit @ unit.mean(axis=0)).argmax())
    for at in range(0, n, QUERIES):
        queries = np.arange(at, min(n, at + QUERIES))
        if graph is None:
            q, v = np.nonzero(unit[queries] @ unit.T >= threshold)
            q = queries[q]
        else:
            q, v = range_search(unit, graph, queries, medoid)
            near = _cosines(unit, q, v) >= threshold
            q, v = q[near], v[near]
        label = forest(n, np.concatenate([np.arange(n), q]), np.concatenate([label, v]))
    return label


def _verified(unit: np.ndarray, label: np.ndarray, threshold: float):
    """The pairs q < v of each group at the threshold or above, a block of rows at a time."""
    order = np.argsort(label, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        for at in range(0, len(rows) if len(rows) > 1 else 0, QUERIES):
            some = rows[at : at + QUERIES]
            q, v = np.nonzero(unit[some] @ unit[rows[at:]].T >= threshold - 1e-9)
            q, v = q[v > q], v[v > q]
            q, v = some[q], rows[at:][v]
            exact = np.concatenate([(unit[q[i : i + 50_000]] * unit[v[i : i + 50_000]]).sum(axis=1) for i in range(0, len(q), 50_000)] or [np.zeros(0)]) >= threshold
            yield q[exact], v[exact]


def _search(threshold: float, kind: str, exact: bool):
    """Links of each vector of a tile; rows: tile, rep, copies, vec, shards, shard, block, other, neighbours."""

    def run(batches):
        import pyarrow as pa

        out: list[tuple[int, int, int]] = []
        for _, rows in _grouped(batches):
            rows.sort(key=lambda r: r[0])
            n = len(rows)
            reps = np.array([r[0] for r in rows], np.int64)
            copies = np.array([r[1] for r in rows], np.int64)
            unit = _unit([r[2] for r in rows], kind)
            shards = np.array([r[3] for r in rows], np.int64)
            shard, block = rows[0][4], np.array([r[5] for r in rows])
            one = rows[0][5] == rows[0][6]
            graph = None
            if not exact:
                lists = [np.asarray(r[7] if r[7] is not None else [], np.int64) for r in rows]
                owner = np.repeat(np.arange(n), [len(x) for x in lists])
                to = np.concatenate(lists) if len(owner) else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(reps, to), n - 1)
                here = reps[at] == to
                graph = Graph(n, owner[here], at[here])
            label = _groups(unit, graph, threshold)
            links = np.zeros(n, np.int64)
            for q, v in _verified(unit, label, threshold):
                # A pair counts in the first shard of both, and there in the tile of its two blocks.
                first = np.full(len(q), np.iinfo(np.int64).max)
                for i in range(shards.shape[1]):
                    for j in range(shards.shape[1]):
                        same = shards[q, i] == shards[v, j]
                        first[same] = np.minimum(first[same], shards[q[same], i])
                counts = (first == shard) & ((block[q] == block[v]) == one)
                q, v = q[counts], v[counts]
                links += np.bincount(q, copies[v], n).astype(np.int64) + np.bincount(v, copies[q], n).astype(np.int64)
            some = (links > 0) | (label != np.arange(n))
            out += list(zip(reps[some].tolist(), links[some].tolist(), reps[label][some].tolist(), strict=True))
            if len(out) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "root"])

    return run


def _links(vectors: DataFrame, overlap: int, threshold: float, kind: str, exact: bool = False) -> DataFrame:
    """rep, links, root: one row per tile that links a vector; ``exact``: of one shard per length, all of whose pairs are compared."""
    n = shuffle_partitions(vectors.sparkSession)
    known = {}
    length = F.octet_length("vec")
    for size, count in [] if exact else vectors.groupBy(length.alias("size")).count().orderBy(F.desc("count"), "size").limit(FITTED).collect():
        sample = vectors.filter(length == size).filter(low(F.xxhash64("rep"), SAMPLE, count)).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").collect()  # bounded: SAMPLE rows
        known[size] = books(_unit([r["vec"] for r in sample], kind), count, overlap)
    dealt = vectors.mapInArrow(_assign(known, overlap, kind), "rep long, copies long, vec binary, shards array<long>")
    dealt = materialize(dealt.withColumn("shard", F.explode("shards")), "vector-shards")
    # Written, so that the join shuffles both sides and a large shard can be split between tasks.
    sizes = materialize(dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "shard-sizes")
    tiles = (
        dealt.join(sizes.hint("merge"), "shard")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("_lo", F.least("block", "other"))
        .withColumn("_hi", F.greatest("block", "other"))
        .withColumn("tile", F.xxhash64("shard", "_lo", "_hi"))
        # Shards, and the tiles of a large shard, are dealt in turn.
        .withColumn("_to", F.pmod(F.col("shard") + F.col("_lo").cast("long") * F.col("blocks") - F.expr("_lo * (_lo - 1) div 2") + F.col("_hi") - F.col("_lo"), F.lit(n)).cast("int"))
    )
    if exact:
        search = tiles.withColumn("neighbours", F.lit(None).cast("array<long>"))
    else:
        lists = tiles.repartitionById(n, F.col("_to")).sortWithinPartitions("tile", "rep").select("tile", "rep", "vec").mapInArrow(_build(kind), "rep long, neighbours array<long>")
        united = materialize(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "adjacency")
        search = tiles.join(united.hint("merge"), "rep")
    search = search.repartitionById(n, F.col("_to")).sortWithinPartitions("tile", "rep")
    search = search.select("tile", "rep", "copies", "vec", "shards", "shard", "block", "other", "neighbours")
    return materialize(search.mapInArrow(_search(threshold, kind, exact), "rep long, links long, root long"), "vector-links")


def _scan(queries: list[bytes], ids: list[int], threshold: float, kind: str):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(len(ids), np.int64)
        asked = {size: (at, _unit([queries[i] for i in at], kind)) for size, at in _by_length(queries)}
        for batch in slices(batches):
            data, copies = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            for size, rows in _by_length(data):
                if size in asked:
                    at, units = asked[size]
                    total[at] += copies[rows] @ (_unit([data[i] for i in rows], kind) @ units.T >= threshold)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], names=["rep", "n"])

    return run


def recall_of(vectors: DataFrame, counts: DataFrame, threshold: float, kind: str, queries: int = AUDIT) -> float:
    """Share of the links of some vectors, drawn whether links were found or not, that a scan of all vectors finds and ``counts`` has."""
    some = vectors.filter(low(F.xxhash64("rep"), queries, vectors.count())).orderBy(F.xxhash64("rep"), "rep").limit(queries)
    asked = F.broadcast(some).join(counts, "rep", "left").select("rep", "copies", "vec", F.coalesce("links", F.lit(0)).alias("links")).collect()  # bounded: AUDIT rows
    if not asked:
        return 1.0
    scan = _scan([bytes(r["vec"]) for r in asked], [r["rep"] for r in asked], threshold, kind)
    true = {r["rep"]: r["n"] for r in vectors.mapInArrow(scan, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    want = sum(true[r["rep"]] - r["copies"] for r in asked)
    return sum(min(r["links"], true[r["rep"]] - r["copies"]) for r in asked) / want if want else 1.0


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall of every row of ``embeddings`` (vec_id, embedding)."""
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("_e"))
    whole = F.col("_e").isNotNull() & F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_e", lambda x: x != 0)
    rows = rows.withColumn("_e", F.when(whole, F.transform("_e", lambda x: x + F.lit(0.0))))
    rows = materialize(rows.mapInArrow(_bytes(kind), "vec_id long, size int, vec binary"), "vectors")
    # A vector goes by a number of one of its rows, since vec_ids may be null or used again.
    usable = rows.filter("size > 0").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    kinds = materialize(usable.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    vectors = kinds.select("rep", "copies", "vec")
    links, recall = None, 1.0
    for more in range(4):  # the last try is exact
        links = _links(vectors, overlap + MORE_OVERLAP * more, threshold, kind, more == 3)
        counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
        recall = recall_of(vectors, counts.filter("links > 0"), threshold, kind)
        if recall >= RECALL:
            break
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    roots = materialize(roots.join(kinds.select("rep", "id").hint("merge"), "rep"), "vector-roots")
    least = materialize(roots.groupBy("root").agg(F.min("id").alias("_root")), "least-ids")
    of = roots.join(least.hint("merge"), "root").select("rep", "_root")
    found = kinds.join(counts.hint("merge"), "rep", "left").join(of.hint("merge"), "rep", "left")
    found = found.select("vec", F.coalesce("_root", "id").alias("_root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_n"))
    no_id = lambda c: F.nullif(c, F.lit(NO_ID))
    out = rows.join(found.hint("merge"), "vec", "left").withColumn("_c", F.coalesce("_root", "vec_id"))
    return out.select(no_id(F.col("vec_id")).alias("vec_id"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), no_id(F.col("_c")).alias("component_id"), (F.col("_c") == F.col("vec_id")).alias("kept"), F.lit(recall).alias("audited_recall"))


def _bytes(kind: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = [None if x is None else np.asarray(x, kind) for x in batch.column(1).to_pylist()]
            sizes = [0 if x is None else len(x) for x in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array([None if x is None else x.tobytes() for x in vectors], pa.binary())], names=["vec_id", "size", "vec"])

    return run


def pairs_sql(threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB's SQL, over all pairs; every vector of the table is compared with every other."""
    return rf"""
WITH RECURSIVE given AS (SELECT vec_id, row_number() OVER () AS r, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT r, vec_id, e FROM given WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.r AS ra, b.r AS rb FROM usable a JOIN usable b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(r, root) AS (SELECT r, vec_id FROM given UNION SELECT rb, root FROM reach JOIN links ON ra = r),
roots AS (SELECT r, min(root) AS component_id FROM reach GROUP BY r),
counts AS (SELECT ra AS r, count(*) AS n FROM links GROUP BY ra)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept, 1.0::DOUBLE AS audited_recall
FROM given JOIN roots USING (r) LEFT JOIN counts USING (r)"""
