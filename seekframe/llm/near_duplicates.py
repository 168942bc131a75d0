"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct word shingles; documents with one and the same set are one class, and only the
class goes on. Each of ``TREES`` sorted signature orders is a tree: classes whose first ``LEAST_DEPTH`` values
agree share a region. Counts of the first values, taken before anything is shipped, say where a region has more than ``REGION``
classes; it is then taken deeper, value by value, until its parts are small enough. What stays large at full depth is dealt to
tasks of two blocks: first each block with itself and the first one, then, unless the region is one component, all the others. Within a region the signatures tell the likely pairs, of which only spanning ones are sent on: what they connect
are families, and every link lies within one. A family's texts are shipped once and compared in tasks of at most two chunks of
``CHUNK`` documents, which count the shingles that any two have in common exactly; the links that connect different components are then
confirmed on the words themselves, the most alike first. Chunks are first compared with themselves and the first chunk; the other chunk
pairs follow only in families that are then still in several components.

A link needs intersection / union of at least ``SIMILARITY``. Nulls and texts without words have an empty set, are linked with
nothing and are components of their own. Rows with one doc_id are one document. Extra columns are not read by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import mixed, partitions, short_batches, staged, unused, window_hashes, word_hashes
from .graph import Forest, components

TREES, DEPTH, LEAST_DEPTH = 24, 6, 4
HASHES = TREES * DEPTH
REGION = 1200
CHUNK, FREQUENT = 1000, 8
MARGIN = 0.17  # five standard deviations of an estimate from HASHES values, about
SIMILARITY = (80, 100)

_rng = np.random.default_rng(97)
_SALTS = _rng.integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64)


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # of bytes, only ASCII letters


def shingles(text: bytes, k: int, family: int = 0) -> np.ndarray:
    """Sorted distinct hashes of ``k`` consecutive words of a lowered text; fewer words are one shingle. Families are independent."""
    words = word_hashes(text, family)
    if not len(words):
        return words
    return np.unique(mixed(window_hashes(words, min(k, len(words)))) + np.uint64(len(words) if len(words) < k else 0))


def word_shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The same set, of the words themselves."""
    words = text.split()  # bytes part at exactly the six white-space characters
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def signature(grams: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set, 32 bits each."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        np.minimum(out, (part[:, None] * _SALTS + _SHIFTS).min(axis=0), out=out)
    return (mixed(out) >> np.uint64(32)).astype("<u4")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, more, signs = [], [], [], []
            for x in batch.column("text"):
                text = lowered(x.as_py())
                grams = shingles(text, k)
                n.append(len(grams))
                keys.append(int(mixed(grams, 1).sum(dtype=np.uint64).view(np.int64)))
                more.append(int(mixed(shingles(text, k, 1), 2).sum(dtype=np.uint64).view(np.int64)))
                signs.append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(more, pa.int64()), pa.array(signs, pa.binary())], names=["id", "n", "k1", "k2", "sign"])

    return run


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (class, hash) and for every depth from the least and every tree the hash of its first values (depth, class, tree)."""
    signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), "<u4").reshape(-1, HASHES)
    heads = signs.reshape(-1, TREES, DEPTH).astype(np.uint64)
    key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), heads.shape[:2]).copy()
    keys = []
    for d in range(DEPTH):
        key = mixed(key ^ heads[:, :, d], d + 1)
        keys.append(key)
    return signs, np.stack(keys[LEAST_DEPTH - 1 :])


def _tree_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield _prefixes(batch)[1][0].ravel()


PREFIXES = [f"p{d}" for d in range(LEAST_DEPTH, DEPTH + 1)]
BRANCHES = f"{', '.join(f'{p} long' for p in PREFIXES)}, id long"
REGIONS = f"{BRANCHES}, n long, bits binary"


def _branches(bits, wide: bool):
    """A class's row in every tree where its first values may be shared; the narrow rows leave out size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, keys = _prefixes(batch)
            ids = batch.column("id").to_numpy()
            who, tree = np.nonzero(bits.value.may(keys[0].ravel()).reshape(keys.shape[1:]))
            columns = [*(pa.array(k[who, tree].view(np.int64)) for k in keys), pa.array(ids[who])]
            if wide:
                low = (signs & 255).astype(np.uint8)
                columns += [pa.array(batch.column("n").to_numpy()[who]), pa.array([low[w].tobytes() for w in who], pa.binary())]
            yield from pa.Table.from_arrays(columns, names=[c.split()[0] for c in (REGIONS if wide else BRANCHES).split(", ")]).to_batches(max_chunksize=20_000)

    return run


def _large_prefixes(narrow: DataFrame) -> list[DataFrame]:
    """For every depth the prefixes (value, count) of more than ``REGION`` classes; a deeper one lies within those before it."""
    found, rows = [], narrow
    for p in PREFIXES:
        found.append(staged(rows.groupBy(p).agg(F.count("*").alias(f"n_{p}")).where(F.col(f"n_{p}") > REGION), "minhash-large"))
        if found[-1].isEmpty():
            break
        rows = rows.join(found[-1].select(p), p, "left_semi")
    return found


def _placed(rows: DataFrame, large: list[DataFrame]) -> DataFrame:
    """(region, blocks, own, id, n, bits): every row in the shallowest region of at most ``REGION`` rows. Regions
    above that at full depth have blocks of about ``REGION`` rows, of which a row has its own."""
    region = F.col(PREFIXES[min(len(large), len(PREFIXES)) - 1])
    for p, counts in zip(PREFIXES, large, strict=False):
        rows = rows.join(counts, p, "left")
    for p in reversed(PREFIXES[: len(large)]):
        region = F.when(F.col(f"n_{p}").isNull(), F.col(p)).otherwise(region)
    blocks = F.ceil(F.coalesce(f"n_{PREFIXES[-1]}", F.lit(1)) / REGION).cast("int") if len(large) == len(PREFIXES) else F.lit(1)
    rows = rows.select(region.alias("region"), blocks.alias("blocks"), "id", "n", "bits")
    return rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs whose sizes allow a link and whose signatures (low bytes) make it likely, with the estimates."""
    need = SIMILARITY[0] / SIMILARITY[1]
    found = []
    step = max(1, (1 << 22) // max(1, len(b)))
    for at in range(0, len(a), step):
        fit = np.minimum(na[at : at + step, None], nb) * SIMILARITY[1] >= np.maximum(na[at : at + step, None], nb) * SIMILARITY[0]
        i, j = np.nonzero(fit)
        for part in range(0, len(i), 1 << 16):
            x, y = i[part : part + (1 << 16)] + at, j[part : part + (1 << 16)]
            share = (a[x] == b[y]).mean(axis=1)
            ok = (share - 1 / 256) / (1 - 1 / 256) >= need - MARGIN
            found.append((x[ok], y[ok], share[ok]))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.empty(0) for c in range(3))


def _region_pairs(ids, sizes, bits, side) -> Iterator[tuple[int, int]]:
    """Likely pairs of a task, the most alike first: among its rows, or where it has two blocks, across them."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    across = len(right) > 0
    right = right if across else left
    x, y, share = _alike(bits[left], bits[right], sizes[left], sizes[right])
    a, b = left[x.astype(int)], right[y.astype(int)]
    if not across:
        a, b, share = a[a < b], b[a < b], share[a < b]
    order = np.argsort(-share, kind="stable")
    yield from zip(ids[a[order]].tolist(), ids[b[order]].tolist(), strict=True)


def _groups_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Batches sorted by a column, as one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column)
        lo = 0
        while lo < batch.num_rows:
            value = values[lo]
            if held and held[-1].column(column)[0] != value:
                yield pa.Table.from_batches(held)
                held = []
            same = values.slice(lo).to_numpy(zero_copy_only=False) == value.as_py()
            n = len(same) if same.all() else int(np.argmin(same))
            held.append(batch.slice(lo, n))
            lo += n
    if held:
        yield pa.Table.from_batches(held)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _spanning_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs that span what all likely pairs of the partition's tasks connect; one task is held at a time."""
    forest, out = Forest(), []
    for t in _groups_of(batches, "task"):
        side = t.column("side").to_numpy()
        if t.num_rows > 1 and t.column("pair")[0].as_py() == (len(np.unique(side)) == 2):
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            out += [(i, j) for i, j in _region_pairs(t.column("id").to_numpy(), t.column("n").to_numpy(), bits, side) if forest.join(i, j)]
        if len(out) > 100_000 or len(forest.up) > 2_000_000:
            yield _edge_batch(out)
            out, forest = [], forest if len(forest.up) <= 2_000_000 else Forest()
    yield _edge_batch(out)


def _first_others(parts):
    """The first part meets all, another itself and the first."""
    return F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col(parts) - 1)).otherwise(F.array(F.lit(0), F.col("own")))


def _other_others(parts):
    """What ``_first_others`` leaves."""
    return F.filter(F.sequence(F.lit(1), F.col(parts) - 1), lambda c: (c != F.col("own")) & (F.col("own") > 0))


def _likely(rows: DataFrame, others) -> DataFrame:
    """Likely pairs of the rows (region, own, id, n, bits), block against the blocks in ``others``."""
    tasks = rows.withColumn("other", F.explode(others)).select(
        F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("pair"), "id", "n", "bits",
    )
    return staged(tasks.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task", "id").mapInArrow(_spanning_pairs, "a long, b long"), "minhash-likely")


def _likely_pairs(classes: DataFrame, bits) -> DataFrame:
    """(a, b): pairs that connect what the likely pairs of all regions connect."""
    narrow, rows = (classes.select("id", "n", "sign").mapInArrow(_branches(bits, wide), REGIONS if wide else BRANCHES) for wide in (False, True))
    large = _large_prefixes(narrow)
    placed = _placed(rows, large)
    pairs = _likely(placed, _first_others("blocks"))
    if len(large) == len(PREFIXES) and not large[-1].isEmpty():
        # regions of several blocks that are not yet one component: all other block pairs
        full = staged(placed.where("blocks > 2"), "minhash-blocks")
        comp = components(pairs)
        open_ = full.select("region", "id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = staged(open_.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("region"), "minhash-open")
        if not open_.isEmpty():
            pairs = pairs.unionByName(_likely(full.join(open_, "region", "left_semi"), _other_others("blocks")))
    return pairs


def _id_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Twice each, as the sketch keeps what occurs at least twice."""
    h = mixed(batch.column("id").to_numpy().view(np.uint64))
    yield h
    yield h


def _texts_of(bits):
    """The lowered texts of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bits.value.may(mixed(batch.column("id").to_numpy().view(np.uint64)))))
            texts = pa.array([lowered(x.as_py()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts], names=["id", "text"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values every two sets of sorted distinct values have in common, by (left, right).

    Values that few sets have are counted pair by pair, the others by products of 0/1 matrices, in blocks of bounded size either way.
    """
    out = np.zeros((len(left), len(right)), np.int32)
    pool = np.sort(np.concatenate(left if right is left else [*left, *right]))
    repeated = np.unique(pool[1:][pool[1:] == pool[:-1]])
    del pool
    if not len(repeated):
        return out
    sides = []
    for sets in [left] if right is left else [left, right]:
        codes = [np.searchsorted(repeated, s) for s in sets]
        codes = [c[repeated[np.minimum(c, len(repeated) - 1)] == s].astype(np.int32) for c, s in zip(codes, sets, strict=True)]
        sides.append((np.concatenate(codes), np.repeat(np.arange(len(sets), dtype=np.int32), [len(c) for c in codes])))
    sides = sides * 2 if right is left else sides
    have = [np.bincount(codes, minlength=len(repeated)) for codes, _ in sides]
    both = (have[0] > 0) & (have[1] > 0)
    often = both & (np.minimum(*have) > FREQUENT)
    few = np.flatnonzero(both & ~often)
    if len(few):
        owners = []
        for (codes, who), n in zip(sides, have, strict=True):
            keep = np.flatnonzero((both & ~often)[codes])
            owners.append((who[keep[np.argsort(codes[keep], kind="stable")]], np.cumsum(n[few]) - n[few]))
        sizes = have[0][few] * have[1][few]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), 1 << 20))
        for lo, hi in zip(cuts, [*cuts[1:], len(few)], strict=True):
            each = np.repeat(np.arange(lo, hi), sizes[lo:hi])
            inside = np.arange(len(each)) - np.repeat(np.cumsum(sizes[lo:hi]) - sizes[lo:hi], sizes[lo:hi])
            wide = have[1][few[each]]
            i, j = owners[0][0][owners[0][1][each] + inside // wide], owners[1][0][owners[1][1][each] + inside % wide]
            out += np.bincount(i.astype(np.int64) * len(right) + j, minlength=out.size).reshape(out.shape).astype(np.int32)
    many, place = np.flatnonzero(often), np.empty(len(repeated), np.int32)
    for lo in range(0, len(many), 2048):
        some = many[lo : lo + 2048]
        place[:] = -1
        place[some] = np.arange(len(some))
        dense = []
        for (codes, who), n in zip(sides, out.shape, strict=True):
            block = np.zeros((n, len(some)), np.float32)
            keep = place[codes] >= 0
            block[who[keep], place[codes[keep]]] = 1
            dense.append(block)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int32)
    return out


def _chunk_links(t: pa.Table, k: int) -> list[tuple[int, int]]:
    """Links, confirmed on the words, that connect different components among the task's documents."""
    ids, comp, side = (t.column(c).to_numpy() for c in ("id", "comp", "side"))
    texts = [x.as_py() for x in t.column("text")]
    sets = [shingles(x, k) for x in texts]
    n = np.array([len(s) for s in sets])
    both = t.column("pair")[0].as_py()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if both else (np.arange(len(ids)),) * 2
    shared = shared_counts([sets[i] for i in left], [sets[j] for j in right]) if both else shared_counts(sets, sets)
    shared = shared.astype(np.int64)
    union = n[left][:, None] + n[right] - shared
    ok = (shared * SIMILARITY[1] >= union * SIMILARITY[0]) & (comp[left][:, None] != comp[right])
    i, j = np.nonzero(ok if both else np.triu(ok, 1))
    order = np.argsort(-(shared[i, j] / union[i, j]), kind="stable")
    forest, links, exact = Forest(), [], {}
    for x, y in zip(left[i[order]].tolist(), right[j[order]].tolist(), strict=True):
        if forest.root(int(comp[x])) == forest.root(int(comp[y])):
            continue
        a, b = (exact[z] if z in exact else exact.setdefault(z, word_shingles(texts[z], k)) for z in (x, y))
        common = len(a & b)
        if common * SIMILARITY[1] >= (len(a) + len(b) - common) * SIMILARITY[0]:
            forest.join(int(comp[x]), int(comp[y]))
            links.append((int(ids[x]), int(ids[y])))
    return links


def _confirmed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups_of(batches, "task"):
            if t.num_rows > 1 and t.column("pair")[0].as_py() == (len(np.unique(t.column("side").to_numpy())) == 2):
                yield _edge_batch(_chunk_links(t, k))

    return run


def _links(rows: DataFrame, others, k: int) -> DataFrame:
    """Links among the documents (family, chunks, own, id, comp, text), chunk against the chunks in ``others``."""
    n = partitions(rows.sparkSession)
    tasks = rows.withColumn("other", F.explode(others)).select(
        F.concat_ws("/", "family", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("pair"), "id", "comp", "text",
    )
    return staged(tasks.repartition(n, "task").sortWithinPartitions("task", "id").mapInArrow(_confirmed(k), "a long, b long"), "minhash-links")


def near_duplicates(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, component) for the documents (id, text); the component is the smallest id reachable by links."""
    spark = docs.sparkSession
    sets = staged(docs.select("id", "text").mapInArrow(_sets(k), "id long, n long, k1 long, k2 long, sign binary"), "minhash-sets")
    some = sets.where("n > 0 and id is not null")
    classes = staged(some.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sign").alias("sign")), "minhash-classes")
    bits = spark.sparkContext.broadcast(sketch.repeated(classes.select("sign"), _tree_keys, TREES * classes.count()))
    pairs = _likely_pairs(classes, bits)
    # families: whatever likely pairs connect; every link lies within one
    families = staged(components(pairs).withColumnRenamed("component", "family"), "minhash-families")
    wanted = spark.sparkContext.broadcast(sketch.repeated(families.select("id"), _id_hashes, 16 * families.count()))
    texts = docs.where("id is not null").select("id", "text").mapInArrow(_texts_of(wanted), "id long, text binary").dropDuplicates(["id"])
    chunks = families.groupBy("family").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = families.join(chunks, "family").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    placed = staged(placed.join(texts, "id").withColumn("comp", F.col("id")), "minhash-texts")
    links = _links(placed, _first_others("chunks"), k)
    found = staged(components(links), "minhash-components")
    large = placed.where("chunks > 2").drop("comp").join(found.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_ = large.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family")
    rest = staged(open_, "minhash-open")
    if not rest.isEmpty():
        more = _links(large.join(rest, "family", "left_semi"), _other_others("chunks"), k)
        found = staged(components(links.unionByName(more)), "minhash-components")
    members = sets.join(classes.select("k1", "k2", F.col("id").alias("class")), ["k1", "k2"], "left")
    members = members.withColumn("class", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("id")))
    return members.join(found.withColumnRenamed("id", "class"), "class", "left").select("id", "n", F.coalesce("component", "class").alias("component"))


def op8(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_duplicates(docs, 2).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one(spark, docs: DataFrame, sf_dir: str, k: int = 5) -> DataFrame:
    """Pipeline stage: of every group of near copies (five-word shingles) the row of the smallest doc_id stays.

    Rows are told apart by numbers of their own, as ids may be null, which stand last, or repeated.
    """
    short_batches(spark)
    number = unused("minhash_row", docs.columns)
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "minhash-rows")
    found = staged(near_duplicates(rows.select(F.col(number).alias("id"), "text"), k).select("id", "component"), "minhash-found")
    # only groups of several rows: all members but the component itself have another id
    several = found.where("id <> component").select("component").distinct()
    members = found.join(several, "component", "left_semi").join(rows.select(F.col(number).alias("id"), "doc_id"), "id")
    members = staged(members.select("component", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id").alias("place")), "minhash-members")
    first = members.groupBy("component").agg(F.min("place").alias("first"))
    gone = staged(members.join(first, "component").where("place.id <> first.id").select(F.col("place.id").alias(number)), "minhash-gone")
    return rows.join(gone, number, "left_anti").select(*docs.columns)
