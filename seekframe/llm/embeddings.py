"""Near-duplicate embeddings of equal label by a pigeonhole join over subspaces.

Unit vectors are rotated by a fixed random rotation and split into blocks of ``DIMENSIONS`` coordinates, ``JOINED`` of which
make a larger one. Two vectors with cosine >= c are at most 2 - 2c apart (squared), so in some large block, and in some block of it,
they are within its share of this budget, in proportion to its dimensions. Each block is range-joined: vectors lie in cells
as wide as the block's radius along every coordinate of it, and only vectors of neighbouring cells are compared. What meets both
budgets is a candidate; of the union of the candidates of all blocks each pair is verified once, by its cosine in double precision.

Vectors of a label are compared in tasks of two chunks of at most about ``CHUNK`` vectors, which do the joins of all blocks: a vector is shipped
once for every chunk of its label, however many blocks there are, and a task holds two chunks however many vectors are
alike. Counts of links, and edges that span a task's links, leave a task, never all pairs.

Equal vectors of a label are one class with a count; classes are compared, copies are not expanded. Vectors that are
null, zero, of null label, or that hold null or non-finite components link with nothing; vectors of
different lengths neither; nor does one without an id. Ties at the threshold link. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged
from .graph import components

DIMENSIONS, JOINED = 5, 4
CHUNK = 4096
PAIRS = 1 << 19  # compared at once
SLACK = 1e-9
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    if d not in _ROTATIONS:
        _ROTATIONS[d] = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    return _ROTATIONS[d]


def blocks(d: int) -> list[tuple[slice, slice]]:
    """The blocks of ``d`` coordinates, each with the large block that it is part of."""
    edges = np.linspace(0, d, -(-d // DIMENSIONS) + 1).round().astype(int)
    small = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    return [(s, slice(small[n - n % JOINED].start, small[min(len(small), n - n % JOINED + JOINED) - 1].stop)) for n, s in enumerate(small)]


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The group (length and label), a digest of it and the vector, and the vector as doubles scaled by a power of two; nulls where nothing can be linked."""
    for batch in batches:
        groups, keys, vectors = [], [], []
        for label, x in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
            raw = x.values
            ok = label is not None and x.is_valid and raw.null_count == 0
            v = np.array(raw.to_numpy(zero_copy_only=False), float) + 0.0 if ok else np.zeros(0)
            top = np.abs(v).max() if len(v) else 0.0
            if not ok or not np.isfinite(v).all() or top == 0:
                groups.append(None)
                keys.append(None)
                vectors.append(None)
                continue
            group = f"{len(v)}/{label}"
            groups.append(group)
            keys.append(hashlib.blake2b(group.encode() + b"/" + v.tobytes(), digest_size=16).digest())
            v = np.ldexp(v, -np.frexp(top)[1])
            narrow = v.astype(np.float32)
            vectors.append(narrow.tobytes() if (narrow == v).all() else v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(groups, pa.string()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "group", "key", "vector"])


def neighbours(x: np.ndarray, y: np.ndarray, radius: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of ``x`` and ``y`` in neighbouring cells, some at a time; each pair once if both are the ``same``."""
    cx, cy = np.floor(x / radius).astype(np.int64), np.floor(y / radius).astype(np.int64)
    low = np.minimum(cx.min(0), cy.min(0)) - 1
    sides = np.maximum(cx.max(0), cy.max(0)) - low + 2
    strides = np.cumprod(np.append(1, sides[:-1]))
    codes_x, codes_y = (cx - low) @ strides, (cy - low) @ strides
    order_x, order_y = np.argsort(codes_x, kind="stable"), np.argsort(codes_y, kind="stable")
    codes_x = codes_x[order_x]
    cells, start, size = np.unique(codes_y[order_y], return_index=True, return_counts=True)
    for step in product((-1, 0, 1), repeat=x.shape[1]):
        move = int(np.dot(step, strides))
        if same and move < 0:
            continue
        at = np.minimum(np.searchsorted(cells, codes_x + move), len(cells) - 1)
        rows = np.flatnonzero(cells[at] == codes_x + move)
        if not len(rows):
            continue
        at = at[rows]
        ends = np.cumsum(size[at])
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], PAIRS))
        for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            n = size[at[lo:hi]]
            i = np.repeat(order_x[rows[lo:hi]], n)
            j = order_y[np.arange(len(i)) + np.repeat(start[at[lo:hi]] - (np.cumsum(n) - n), n)]
            if same and move == 0:
                i, j = i[i < j], j[i < j]
            yield i, j


def block_links(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, list[int]]:
    """Which rows of ``x`` and ``y`` link, as a matrix (of a pair of the same rows, one half), and how many pairs each block compared."""
    d, budget = x.shape[1], 2 - 2 * cosine
    tops = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y)]
    u, w = (v / top[:, None] @ rotation(d) for v, top in zip((x, y), tops, strict=True))
    seen, link, compared = np.zeros((len(x), len(y)), bool), np.zeros((len(x), len(y)), bool), []
    for small, large in blocks(d):
        most = [budget * (b.stop - b.start) / d + SLACK for b in (small, large)]
        ux, wy, n = np.ascontiguousarray(u[:, small]), np.ascontiguousarray(w[:, small]), 0
        columns = list(zip(ux.T.copy(), wy.T.copy(), strict=True))
        for i, j in neighbours(ux, wy, np.sqrt(most[0]) * (1 + SLACK), same):
            n += len(i)
            gap = np.zeros(len(i))
            for a, b in columns:
                step = a[i] - b[j]
                gap += step * step
            near = gap <= most[0]
            i, j = i[near], j[near]
            new = ~(seen[i, j] | seen[j, i]) if same else ~seen[i, j]
            i, j = i[new], j[new]
            step = u[i, large] - w[j, large]
            near = np.einsum("ij,ij->i", step, step) <= most[1]
            i, j = i[near], j[near]
            seen[i, j] = True
            for at in range(0, len(i), 1 << 14):
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                link[p, q] = np.einsum("ij,ij->i", x[p], y[q]) / (tops[0][p] * tops[1][q]) >= cosine
        compared.append(n)
    return link, compared


def spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges between rows and columns (numbered on after the rows) that connect what the matrix connects."""
    n, edges = len(link), []
    left = np.concatenate((link.any(1), link.any(0)))
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        front = np.array([root])
        while len(front):
            reached = np.concatenate((link[:, front[front >= n] - n].any(1), link[front[front < n]].any(0))) & left
            front = np.flatnonzero(reached)
            left[front] = False
            edges += [(root, int(x)) for x in front]
    return edges


def _task(t: pa.Table, cosine: float) -> pa.RecordBatch:
    """(a, null, n): n links more of a; and (a, b, null): edges that span the task's links."""
    ids, copies, side = (t.column(c).to_numpy() for c in ("id", "copies", "side"))
    d = int(t.column("task")[0].as_py().partition("/")[0])
    v = np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * d else np.float64).astype(float) for x in t.column("vector").to_pylist()])
    rows = np.arange(len(v))
    same = not t.column("pair")[0].as_py()
    left, right = (rows, rows) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    edges, n = [], np.zeros(len(v), np.int64)
    if len(left) and len(right):
        link, _ = block_links(v[left], v[right], cosine, same)
        link = link | link.T if same else link
        n[left] += link @ copies[right]
        if not same:
            n[right] += copies[left] @ link
        both = np.concatenate((ids[left], ids[right]))
        edges = [(int(both[a]), int(both[b])) for a, b in spanning(link) if both[a] != both[b]]
    some = np.flatnonzero(n)
    a = pa.array([*ids[some].tolist(), *(e[0] for e in edges)], pa.int64())
    b = pa.array([*[None] * len(some), *(e[1] for e in edges)], pa.int64())
    return pa.RecordBatch.from_arrays([a, b, pa.array([*n[some].tolist(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])


def _linked(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; one is held at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tasks = batch.column("task").to_pylist()
            lo = 0
            for hi in range(1, len(tasks) + 1):
                if hi == len(tasks) or tasks[hi] != tasks[lo]:
                    if held and held[-1].column("task")[0].as_py() != tasks[lo]:
                        yield _task(pa.Table.from_batches(held), cosine)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    lo = hi
        if held:
            yield _task(pa.Table.from_batches(held), cosine)

    return run


def near_vectors(vectors: DataFrame, cosine: float) -> DataFrame:
    """(id, n_links, component) for the vectors (id, embedding, label)."""
    spark = vectors.sparkSession
    rows = staged(vectors.select("id", "embedding", "label").mapInArrow(_prepared, "id long, group string, key binary, vector binary"), "vectors")
    classes = staged(rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("group").alias("group"), F.first("vector").alias("vector")), "vector-classes")
    # only groups of more than a chunk: at most one row for every CHUNK classes
    large = staged(classes.groupBy("group").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1"), "vector-groups")
    placed = classes.join(large, "group", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tasks = tasks.select(F.concat_ws("/", "group", low, high).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), (low < high).alias("pair"), "id", "copies", "vector")
    out = staged(tasks.repartition(partitions(spark), "task").sortWithinPartitions("task", "id").mapInArrow(_linked(cosine), "a long, b long, n long"), "vector-links")
    counts = out.where("n is not null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    found = components(out.where("b is not null").select("a", "b")).withColumnRenamed("id", "class")
    members = rows.select("id", "key").join(classes.select("key", F.col("id").alias("class"), "copies"), "key", "left")
    members = members.withColumn("class", F.coalesce("class", "id")).join(counts, "class", "left").join(found, "class", "left")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    return members.select("id", n.cast("long").alias("n_links"), F.coalesce("component", "class").alias("component"))


def op2(spark, sf_dir):
    from .common import table

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return near_vectors(vectors, 0.93).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
