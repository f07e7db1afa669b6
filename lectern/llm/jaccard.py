"""Jaccard self-join on word shingles by chosen paths.

Sets of shingles of five words get MinHash signatures. A run takes one coordinate of the signature; sets that agree on it
share a bucket, and a pair at the threshold does so with a probability of the threshold at least. Buckets that are small are
compared by brute force on signatures. In a large bucket every set is compared with a pivot, sets almost equal to it are
settled by that, and the others are split again on further coordinates, chosen from a hash of the path so far, two for each
node.

Runs come in rounds of as many as would lose a pair at the threshold with a probability below ``1 - RECALL`` if runs were
independent. As they are not quite, recall is measured after each round: the links of a bounded set of texts (``AUDIT``) are
counted in all rows while these are sketched, and rounds on fresh coordinates are added until the share of them that the join
found reaches ``AUDITED``. If it still has not when the coordinates are used up, all pairs of sets are compared, block by block.

What brute force passes, far below the threshold, only links sets into candidate classes. Within each class all pairs are
then compared exactly, on whole sets of shingles, in tiles of bounded size; a bucket that no path splits becomes a class as it
is. So a pair is lost only if no chain of buckets connects it, and none is found that is below the threshold.

Sets are compared, not texts: rows with equal sets are copies of each other, are joined once and counted as often as they
occur. A set goes by the number of one of its rows, never by a doc_id, so ids may be null or used again. Texts of one to four
words are one shingle; null texts and texts without words link with nothing. Rows without a doc_id count under the smallest
long. Repeated rows are copies. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.samples import low
from lectern.llm.words import Words, forest, mix, slices
from lectern.operators.components import components
from lectern.plans.shared import materialize, shuffle_partitions, spread

SHINGLE = 5
#: Similarity as a fraction, so that pairs on the threshold are decided exactly.
NUMERATOR, DENOMINATOR = 4, 5
#: Recall expected of a round, and measured recall from which on no more are added.
RECALL, AUDITED = 0.999999, 0.99
#: Most texts whose links are counted, and the longest of them in characters; longer ones are joined like others.
AUDIT, AUDIT_CHARS = 1_000, 100_000
COORDINATES = 64
SMALL, DEPTH, BRANCHES = 128, 4, 2
#: Likenesses of signatures: from which two sets are candidates, and from which a pivot settles a set.
CANDIDATE, SETTLED = 0.5, 0.85
#: Ways in which the members of a large bucket are dealt when they meet its pivot.
SALTS = 32
#: Most sets and shingles of a block; a tile compares two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000
NO_ID = -(2**63)

_random = np.random.Generator(np.random.PCG64(5))
_A = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def runs_for(recall: float, similarity: float = NUMERATOR / DENOMINATOR, depth: int = DEPTH, branches: int = BRANCHES) -> int:
    """Runs until a pair at the threshold is lost with a probability below 1 - recall, if its buckets are split to the full depth."""
    kept = similarity * (1 - (1 - similarity) ** branches) ** (depth - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


RUNS = runs_for(RECALL)
ROUNDS = COORDINATES // RUNS


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    words = Words(text)
    return np.unique(words.grams(min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """Least hash of the set in each coordinate, upper 32 bits."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingle_set), 4096):
        part = shingle_set[at : at + 4096]
        hashes = (part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)
        out = np.minimum(out, hashes.min(axis=1).astype(np.uint32))
    return out


def _paths(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(path + coordinate.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ value.astype(np.uint64)).view(np.int64)


def _identity(shingle_set: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest(), dtype=np.int64)


class Audit:
    """The distinct sets among some texts, indexed by shingle."""

    def __init__(self, texts: list[str]):
        sets = {tuple(_identity(x).tolist()): x for x in (shingles(t.encode()) for t in texts) if len(x)}
        self.keys = sorted(sets)
        found = [sets[k] for k in self.keys]
        self.sizes = np.array([len(x) for x in found], np.int64)
        values = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(found), dtype=np.int32), self.sizes)[order]
        self.values, self.first = np.unique(values[order], return_index=True)
        self.last = np.append(self.first[1:], len(values))

    def linked(self, shingle_set: np.ndarray) -> list[int] | None:
        """Numbers of the indexed sets that a set is at the threshold with; None if there are none."""
        if not len(self.values) or not len(shingle_set):
            return None
        at = np.minimum(np.searchsorted(self.values, shingle_set), len(self.values) - 1)
        at = at[self.values[at] == shingle_set]
        if not len(at):
            return None
        count = self.last[at] - self.first[at]
        places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[at], count)
        common = np.bincount(self.owner[places], minlength=len(self.sizes))
        near = np.flatnonzero((NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (self.sizes + len(shingle_set)))
        return near.tolist() or None


def _sketch(audit: Audit):
    """Rows with s0, s1, n, sig of their texts behind their own columns, and the audited sets that they are linked to."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            ids, sizes, signatures, seen = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(text or b"")
                ids.append(_identity(found))
                sizes.append(len(found))
                signatures.append(signature(found).tobytes())
                seen.append(audit.linked(found))
            ids = np.array(ids).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(seen, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "s0", "s1", "n", "sig", "audited"],
            )

    return run


def _starts(turn: int):
    """The buckets of each set in the runs of one round; rows: rep, sig."""
    run_ids = np.arange(turn * RUNS, (turn + 1) * RUNS)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            paths = _paths(run_ids.astype(np.uint64)[None, :], run_ids[None, :], sigs[:, run_ids])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), RUNS)), pa.array(paths.ravel())], names=["rep", "path"])

    return run


def _grouped(batches):
    """(path, rows) of consecutive rows with equal paths; rows are lists of the other columns."""
    now, rows = None, None
    for batch in batches:
        for path, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != now:
                if rows:
                    yield now, rows
                now, rows = path, []
            rows.append(rest)
    if rows:
        yield now, rows


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a boolean matrix the least row of its component."""
    return forest(len(near), *np.nonzero(near))


def _brute(batches):
    """Edges a, b (a spanning forest) of the candidate pairs in each bucket; rows: path, rep, sig."""
    import pyarrow as pa

    a, b = [], []
    for _, rows in _grouped(batches):
        reps = np.array([r[0] for r in rows], np.int64)
        sigs = np.frombuffer(b"".join(r[1] for r in rows), np.uint32).reshape(-1, COORDINATES)
        if len(rows) == 2:
            near = (sigs[0] == sigs[1]).sum() >= CANDIDATE * COORDINATES
            label = np.array([0, 0 if near else 1])
        else:
            same = np.zeros((len(rows), len(rows)), np.uint8)
            for c in range(COORDINATES):
                same += sigs[:, c][:, None] == sigs[:, c][None, :]
            label = _forest(same >= CANDIDATE * COORDINATES)
        linked = label != np.arange(len(rows))
        a += reps[linked].tolist()
        b += reps[label[linked]].tolist()
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _split(level: int):
    """Rows of large buckets: path, rep, sig, pivot, its sig -> rep, pivot and whether they are candidates, and the paths to follow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy().view(np.uint64)
            sigs, pivots = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 4))
            alike = (sigs == pivots).mean(axis=1)
            children = []
            for branch in range(BRANCHES):
                at = mix(path + np.uint64(branch + 1)) % np.uint64(COORDINATES)
                children.append(_paths(path + np.uint64(level + 1), at, sigs[np.arange(len(at)), at.astype(np.int64)]))
            more = [None if x else c for x, c in zip((alike >= SETTLED).tolist(), np.stack(children, 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(alike >= CANDIDATE), pa.array(more, pa.list_(pa.int64()))], names=["rep", "pivot", "near", "paths"])

    return run


def _candidates(sets: DataFrame, turn: int) -> DataFrame:
    """Edges a, b between sets (rep, sig) that share a bucket in a round and are alike by their signatures, as spanning forests.

    No join here is a broadcast: how many sets share buckets grows with the table, and the plan is the same at every size.
    """
    n = shuffle_partitions(sets.sparkSession)
    level = sets.mapInArrow(_starts(turn), "rep long, path long")
    edges, smalls = None, None
    for depth in range(DEPTH + 1):
        # Written, so that the join that follows shuffles both sides and large buckets can be split between tasks. Buckets are
        # numbered by falling size within each part, and dealt in turn, so that no task gets several of the largest by chance.
        sizes = level.groupBy("path").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).filter("n > 1").sortWithinPartitions(F.desc("n"))
        sizes = materialize(sizes.withColumn("_to", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")), "bucket-sizes")
        # With the signatures, which brute force, splitting and pivots all need; a pivot is a member of its bucket.
        shared = level.join(sizes.hint("merge"), "path").join(sets.hint("merge"), "rep")
        shared = materialize(shared.select("path", "rep", "sig", "n", "pivot", "_to"), "buckets")
        small = shared.filter(F.col("n") <= SMALL).select("path", "rep", "sig", "_to")
        smalls = small if smalls is None else smalls.unionByName(small)
        large = shared.filter(F.col("n") > SMALL)
        if depth == DEPTH or large.isEmpty():
            found = large.select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
            edges = found if edges is None else edges.unionByName(found)
            break
        pivots = large.filter("rep = pivot").select("path", F.col("sig").alias("pivot_sig"))
        pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = large.withColumn("salt", F.pmod(F.xxhash64("rep", "path"), F.lit(SALTS)).cast("int"))
        split = salted.join(pivots.hint("merge"), ["path", "salt"]).select("path", "rep", "sig", "pivot", "pivot_sig")
        split = materialize(split.mapInArrow(_split(depth), "rep long, pivot long, near boolean, paths array<long>"), "splits")
        found = split.filter("near and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        # Both branches of a node may take the same coordinate.
        level = split.filter("rep <> pivot").select("rep", F.explode(F.array_distinct("paths")).alias("path"))
    # Paths of different levels differ, so that the small buckets of all of them are compared in one step.
    smalls = smalls.repartitionById(n, F.col("_to")).sortWithinPartitions("path", "rep").select("path", "rep", "sig")
    return edges.unionByName(smalls.mapInArrow(_brute, "a long, b long"))


def _sets(batches):
    """The whole sets of candidates."""
    import pyarrow as pa

    for batch in slices(batches):
        found = [shingles(x or b"").view(np.int64) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        kept = [batch.column(c) for c in ("rep", "class", "copies", "blocks")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int64()))], names=["rep", "class", "copies", "blocks", "shingles"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``left`` with those numbered ``right``.

    Shingles in few sets are counted pair by pair, those in many by products of 0/1 matrices.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(values)])))
    few, pairs = 8, []
    for n in range(2, few + 1):
        members = owner[first[count == n][:, None] + np.arange(n)]
        pairs += [members[:, i] * len(sets) + members[:, j] for i in range(n) for j in range(i + 1, n)]
    out = np.bincount(np.concatenate(pairs), minlength=len(sets) ** 2)
    out = out.reshape(len(sets), len(sets))
    out = (out + out.T)[np.ix_(left, right)].astype(np.float32)
    many = np.flatnonzero(count > few)
    for at in range(0, len(many), 2048):
        part = many[at : at + 2048]
        rows = np.repeat(np.arange(len(part)), count[part])
        places = np.arange(count[part].sum()) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + np.repeat(first[part], count[part])
        dense = np.zeros((len(sets), len(part)), np.float32)
        dense[owner[places], rows] = 1
        out += dense[left] @ dense[right].T
    return out


def _tile(batches):
    """Links of each set of a tile and the least set it is linked to there; rows: tile, rep, copies, block, other block, shingles."""
    import pyarrow as pa

    out: list[tuple[int, int, int]] = []
    for _, rows in _grouped(batches):
        sets = [np.asarray(r[4], np.int64) for r in rows]
        reps, copies = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        side = np.array([r[2] for r in rows])
        lo = int(min(r[2] for r in rows))
        one = rows[0][2] == rows[0][3]
        left = np.arange(len(rows)) if one else np.flatnonzero(side == lo)
        right = left if one else np.flatnonzero(side != lo)
        if not len(left) or not len(right) or (one and len(rows) < 2):
            continue
        size = np.array([len(x) for x in sets])
        both = size[left][:, None] + size[right][None, :]
        near = (NUMERATOR + DENOMINATOR) * overlaps(sets, left, right) >= NUMERATOR * both
        if one:
            np.fill_diagonal(near, False)
        links = np.zeros(len(rows), np.int64)
        links[left] += (near * copies[right][None, :]).sum(axis=1)
        if not one:
            links[right] += (near * copies[left][:, None]).sum(axis=0)
        whole = np.zeros((len(rows), len(rows)), bool)
        whole[np.ix_(left, right)] = near
        root = reps[_forest(whole | whole.T)]
        out += [(int(r), int(n), int(x)) for r, n, x in zip(reps, links, root, strict=True) if n]
        if len(out) > 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "root"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "links", "root"])


def _links(sketches: DataFrame, members: DataFrame) -> DataFrame:
    """rep, links, root: the exact links within each class of ``members`` (rep, class, copies, n), a row for each tile that has some."""
    size = members.groupBy("class").agg(F.count("*").alias("_k"), F.sum("n").alias("_n"))
    size = materialize(size.select("class", F.greatest(F.ceil(F.col("_k") / BLOCK_SETS), F.ceil(F.col("_n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "class-sizes")
    wanted = members.join(size.hint("merge"), "class").select("rep", "class", "copies", "blocks")
    texts = sketches.select(F.col("row").alias("rep"), "text").join(wanted.hint("merge"), "rep")
    whole = texts.mapInArrow(_sets, "rep long, class long, copies long, blocks int, shingles array<long>")
    n = shuffle_partitions(sketches.sparkSession)
    tiles = (
        whole.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("_lo", F.least("block", "other"))
        .withColumn("_hi", F.greatest("block", "other"))
        .withColumn("tile", F.xxhash64("class", "_lo", "_hi"))
        # Tiles of a large class are dealt in turn, so that they spread over all partitions.
        .withColumn("_to", F.pmod(F.xxhash64("class") % n + F.col("_lo").cast("long") * F.col("blocks") - F.expr("_lo * (_lo - 1) div 2") + F.col("_hi") - F.col("_lo"), F.lit(n)).cast("int"))
    )
    tiles = tiles.repartitionById(n, F.col("_to")).sortWithinPartitions("tile", "block", "rep")
    return materialize(tiles.select("tile", "rep", "copies", "block", "other", "shingles").mapInArrow(_tile, "rep long, links long, root long"), "links")


def _recall(audit: Audit, sketches: DataFrame, found: DataFrame) -> float:
    """Share of the links of the audited sets, as counted in all rows, that ``found`` (s0, s1, n_links) has."""
    if not audit.keys:
        return 1.0
    counted = sketches.filter("audited is not null").select(F.explode("audited").alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    asked = sketches.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(audit.keys)], "at int, s0 long, s1 long")  # at most AUDIT rows
    have = found.join(F.broadcast(asked), ["s0", "s1"]).select("at", "n_links").join(F.broadcast(counted), "at")
    rows = have.select("n_links", (F.col("n") - 1).alias("true")).collect()
    want = sum(r["true"] for r in rows)
    return sum(min(r["n_links"], r["true"]) for r in rows) / want if want else 1.0


def linked(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame, float]:
    """The rows of ``docs``, the sets of their shingles and the recall measured.

    Rows: row (a number of its own), doc_id (never null), text, ``columns``, s0, s1 and n. Sets: s0, s1, the root of their
    component, class_id and n_links; rows without words (n = 0) have none.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)
    some = rows.select("text", F.xxhash64("doc_id", "text").alias("_h")).filter(F.length("text").between(1, AUDIT_CHARS))
    distinct = some.agg(F.approx_count_distinct("_h").alias("n")).first()["n"]
    some = some.filter(low(F.col("_h"), AUDIT, distinct)).groupBy("_h").agg(F.min("text").alias("text")).orderBy("_h").limit(AUDIT)
    audit = Audit([r["text"] for r in some.collect()])  # bounded in rows and in characters
    schema = StructType([*rows.schema, *StructType.fromDDL("s0 long, s1 long, n long, sig binary, audited array<int>")])
    # Numbered as they are written: the numbers are unique, and stay.
    sketches = materialize(spread(rows).mapInArrow(_sketch(audit), schema).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = sketches.filter("n > 0")
    sets = some.groupBy("s0", "s1").agg(F.min("row").alias("rep"), F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"))
    sets = materialize(sets, "sets")
    shown = materialize(some.select(F.col("row").alias("rep"), "sig").join(sets.select("rep").hint("merge"), "rep"), "signatures")

    edges: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            more = _candidates(shown, turn)
            edges = more if edges is None else edges.unionByName(more)
            classes = components(edges).select(F.col("id").alias("rep"), F.col("root").alias("class"))
            members = materialize(sets.join(classes.hint("merge"), "rep"), "members")
        else:
            members = materialize(sets.withColumn("class", F.lit(0).cast("long")), "members")
        links = _links(sketches, members)
        counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
        roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
        # Written before they are joined, since a component may be large.
        roots = materialize(roots.join(sets.select("rep", "id").hint("merge"), "rep"), "roots")
        least = materialize(roots.groupBy("root").agg(F.min("id").alias("class_id")), "least-ids")
        of = roots.join(least.hint("merge"), "root").select("rep", "root", "class_id")
        found = sets.join(counts.hint("merge"), "rep", "left").join(of.hint("merge"), "rep", "left")
        found = found.select("s0", "s1", F.coalesce("root", "rep").alias("root"), F.coalesce("class_id", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        found = materialize(found, "linked-sets")
        recall = _recall(audit, sketches, found)
        if recall >= AUDITED:
            break
    return sketches, found, recall


def join(docs: DataFrame, audited: bool = False) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``docs`` (doc_id, text), and the recall measured if ``audited``.

    ``n_links`` counts the other rows at a similarity of four fifths or more; ``class_id`` is the least doc_id that links lead to.
    """
    rows, sets, recall = linked(docs)
    # Both sides are shuffled by the planner, so that a set that very many rows share can be split between tasks.
    out = rows.select("doc_id", "s0", "s1", "n").join(sets.hint("merge"), ["s0", "s1"], "left")
    no_id = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(no_id(F.col("doc_id")).alias("doc_id"), no_id(F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *([F.lit(recall).alias("audited_recall")] if audited else []))


def join_sql(size: int = SHINGLE, threshold: str = f"{DENOMINATOR} * held >= {NUMERATOR} * (a.n + b.n - held)") -> str:
    """The same result in DuckDB's SQL, by brute force over all pairs of sets that share a shingle."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
sets AS (SELECT doc_id, r, list_sort(list_distinct([array_to_string(w[i : i + {size - 1}], ' ') FOR i IN range(1, greatest(len(w) - {size - 2}, least(len(w) + 1, 2)))])) AS s FROM words),
kinds AS (SELECT s, min(r) AS k, count(*) AS copies, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT k, unnest(s) AS g FROM kinds),
common AS (SELECT x.k AS ka, y.k AS kb, count(*) AS held FROM grams x JOIN grams y ON x.g = y.g AND x.k <> y.k GROUP BY ALL),
links AS (SELECT ka, kb, b.copies FROM common JOIN kinds a ON a.k = ka JOIN kinds b ON b.k = kb WHERE {threshold}),
reach(k, root) AS (SELECT k, k FROM kinds UNION SELECT l.kb, reach.root FROM reach JOIN links l ON l.ka = reach.k),
roots AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
ids AS (SELECT root, min(doc_id) AS class_id FROM roots JOIN kinds USING (k) JOIN sets USING (s) GROUP BY root),
counts AS (SELECT k, any_value(c.copies) - 1 + coalesce(sum(l.copies), 0) AS n_links FROM kinds c LEFT JOIN links l ON l.ka = c.k GROUP BY k)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, 1.0::DOUBLE AS audited_recall
FROM sets LEFT JOIN kinds USING (s) LEFT JOIN roots USING (k) LEFT JOIN ids USING (root) LEFT JOIN counts USING (k)"""
