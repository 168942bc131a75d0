"""Operators with exact results against brute force, on texts with nulls, blanks, copies and clashing columns."""

import hashlib
import re
import string
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seekframe.llm import decontam, embeddings, graph, near_duplicates, packing, pii, sketch, substrings, suffixes, url_filter, warc

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_id(df, key="doc_id"):
    rows = df.collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_substrings(docs, none, texts):
    width, seen, want = 6, set(), {}
    for d, t in sorted(texts.items()):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            k = tuple(words[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        want[d] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    got = by_id(substrings.dedup(docs, width))
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == want
    assert substrings.dedup(none).collect() == []
    twice = substrings.dedup(docs.where("doc_id = 0").union(docs.where("doc_id = 0"))).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_suffixes(docs, none, texts):
    seen, want = {}, {}
    for d, t in sorted(texts.items()):
        b, new = (t or "").encode(), set()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            k = b[i : i + 50]
            if k in seen:
                gone[i : i + 50] = True
            new.add(k)
        seen |= dict.fromkeys(new)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        want[d] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = by_id(suffixes.dedup(docs))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert suffixes.dedup(none).collect() == []


def test_suffixes_split_large_buckets(spark, docs, texts, monkeypatch):
    """One line with different text around it in every document: no bucket holds many distinct stretches."""
    line, rng = "the line that very many documents share", np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    made = {100 + d: f"{word(40)}{word(1)}{line}{word(1)}{word(40)}" for d in range(300)}
    made |= {500: made[130][5:100], 501: "y" * 30 + made[222][10:]}
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(made.items()), "doc_id long, text string")).repartition(3)
    plain = {r.doc_id: r for r in suffixes.dedup(df).collect()}
    monkeypatch.setattr(suffixes, "HOT", 20)
    monkeypatch.setattr(suffixes, "SAMPLE", 2)
    tasks = []
    monkeypatch.setattr(suffixes, "hot_minimizers", lambda *a, found=suffixes.hot_minimizers: tasks.append(found(*a)) or tasks[-1])
    assert {r.doc_id: r for r in suffixes.dedup(df).collect()} == plain and len(tasks[0]) and plain[501].n_removed > 50
    text, every = made[130].encode(), sketch.Repeats(1, 20)
    every.set[:] = 255
    _, n, keys = suffixes.stretches(text, every, np.unique(np.concatenate([x for _, x, _ in suffixes.extremes(text)])))
    assert set(n) == {1} and len(set(keys)) == len(keys) == len(text) - suffixes.WIDTH + 1


def test_stretches_stay_arrow():
    """Rows of stretches are made and read as columns: equal ones leave that of the smallest document, and a slice of a batch reads its own lists."""
    line, every = b"a passage of more than fifty bytes that several documents hold", sketch.Repeats(1, 20)
    every.set[:] = 255
    none, texts = np.empty(0, np.uint64), {7: line + b"!" + line, 3: line, -(1 << 63): b"some other text" * 5, 9: line[1:] + b"?"}
    batch = suffixes._stretch_rows([(d, *suffixes.stretches(t, every, none), t) for d, t in texts.items()])
    found, late = {}, set()
    for r in batch.to_pylist():
        if r["text"] is None:
            late |= {(r["id"], s) for s in range(r["starts"][0], r["starts"][0] + r["n"])}
        else:
            assert all(texts[r["id"]][s:].startswith(r["text"]) for s in r["starts"]) and r["text"] not in found
            found[r["text"]] = r["id"]
    whole = len(line) - 49
    assert (7, 0) in late and all(d in (7, 9) for d, _ in late) and set(found.values()) >= {3, -(1 << 63)}
    rows = pa.table(batch).sort_by("minimizer").combine_chunks().to_batches(max_chunksize=2)
    lists = [r for r in rows if r.column("starts").offsets[0].as_py()]
    assert lists  # slices that start inside their child
    gone = {(d, s + k) for b in suffixes._buckets(iter(rows)) for d, s, n in zip(*(b.column(c).to_pylist() for c in ("id", "start", "n")), strict=True) for k in range(n)}
    assert gone == {(7, s) for s in range(whole)} | {(7, len(line) + 1 + s) for s in range(whole)} | {(9, s) for s in range(whole - 1)}


def test_suffixes_of_all_documents(spark):
    """The smallest table whole, against every string in a dictionary."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, got, first = sorted((r.doc_id, (r.text or "").encode()) for r in df.collect()), by_id(suffixes.dedup(df)), {}
    for d, b in rows:
        gone, new = np.zeros(len(b), bool), set()
        for i in range(len(b) - 49):
            if b[i : i + 50] in first:
                gone[i : i + 50] = True
            else:
                new.add(b[i : i + 50])
        first |= dict.fromkeys(new)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(b), int(gone.sum()), spans) and got[d].kept_sha256 == sha(np.frombuffer(b, np.uint8)[~gone].tobytes())


@pytest.mark.parametrize(("seed", "width", "letters"), [(0, 4, 3), (1, 4, 3), (2, 5, 3), (3, 7, 2), (4, 1, 3), (5, 3, 256), (6, 2, 256)])
def test_merged_transforms(seed, width, letters):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(0, letters, rng.integers(3, 40)).astype(np.uint8)) for _ in range(12)]
    if letters == 256:  # more symbols than a byte holds, with the end of a text
        texts += [bytes(range(256)), bytes(range(255, -1, -1)), bytes(range(40, 90))]
    ids = rng.integers(0, 5, len(texts))
    owner, offset = suffixes.repeated_windows(texts, ids, width)
    least = {}
    for t, d in zip(texts, ids, strict=True):
        for i in range(len(t) - width + 1):
            k = t[i : i + width]
            least[k] = min(least.get(k, d), d)
    want = {(n, i) for n, (t, d) in enumerate(zip(texts, ids, strict=True)) for i in range(len(t) - width + 1) if least[t[i : i + width]] < d}
    assert set(zip(owner.tolist(), offset.tolist(), strict=True)) == want


@pytest.mark.parametrize(("keys", "most"), [(5000, 22), (5000, 13), (10**9, 22)])
def test_sketch_loses_nothing(spark, monkeypatch, keys, most):
    """Also when it is as full as it may get; what passes besides is as many as the docstring says."""
    monkeypatch.setattr(sketch, "MOST_BITS", most)
    monkeypatch.setattr(sketch, "LEAST_BITS", 12)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 62, 5000)
    df = spark.createDataFrame([(int(v),) for v in [*values, *values[:700]]], "id long").repartition(5)
    hashes = lambda b: iter([substrings.mixed(b.column("id").to_numpy().view(np.uint64))])
    repeats = sketch.repeated(df, hashes, keys)
    found = repeats.may(substrings.mixed(values.view(np.uint64)))
    rows, bits = sketch.shape(keys)
    assert found[:700].all() and found[700:].mean() == pytest.approx((1 - np.exp(-5000 / 2**bits)) ** rows, abs=0.03)


def test_sketch_grows_with_the_keys():
    sizes = [sketch.shape(n) for n in (10, 10**6, 10**8, 10**9, 10**11)]
    assert [r << b for r, b in sizes] == [1 << 20, 1 << 22, 1 << 29, 1 << 31, 1 << 31] and [r for r, _ in sizes] == [2, 2, 2, 1, 1]
    assert sketch.pass_rate(10**8) < 0.13 and sketch.pass_rate(10**11) <= 1


def thue_morse(a, b):
    """A word and its complement that polynomial hashes modulo powers of two can't tell apart."""
    return ["".join(x[bin(i).count("1") % 2] for i in range(1024)) for x in ((a, b), (b, a))]


def test_unlike_words_with_like_polynomials(spark):
    one, two = thue_morse("a", "b")
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert {d: r.n_removed for d, r in by_id(substrings.dedup(df)).items()} == {1: 0, 2: 0, 3: 20}
    df = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "id long, text string")
    assert {r.id: r.component for r in near_duplicates.near_duplicates(df, 2).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("seed", range(3))
def test_shared_counts(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(near_duplicates, "FREQUENT", 3 * seed)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(0, 30))).astype(np.uint64) for _ in range(n)] for n in (17, 23))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert near_duplicates.shared_counts(left, right).tolist() == want


def test_decontamination(spark, docs, none, texts):
    items = {1: "Alpha, beta; GAMMA delta epsilon zeta eta theta iota kappa lambda mu", 2: "the quick brown", 3: None, 4: "...", 5: "naïve façade, garçon", 6: "never there at all in any of these ten words here", 7: "word"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items.items():
        w = cut(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    want = {}
    for d, t in texts.items():
        w, hit, found = cut(t), set(), set()
        for k, which in windows.items():
            for a in range(len(w) - len(k) + 1):
                if tuple(w[a : a + len(k)]) == k:
                    hit |= set(range(a, a + len(k)))
                    found |= which
        want[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    got = by_id(decontam.report(docs, bench))
    assert {d: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for d, r in got.items()} == want
    assert decontam.report(none, bench).collect() == [] and decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_without_ids(spark):
    """Rows with null or repeated ids are judged by their own texts."""
    leak, other, clean = "one two three four five six seven eight nine ten", "a b c d e f g h i j", "nothing of that kind is in here"
    bench = spark.createDataFrame([(1, leak), (2, other)], "item_id long, text string")
    rows = [(None, leak), (None, leak), (None, clean), (None, f"x {other}"), (None, None), (5, leak), (5, clean), (5, other), (6, clean)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    size = lambda t: len((t or "").split())
    want = [(d, size(t), 10 * (leak in (t or "") or other in (t or "")), int(leak in (t or "") or other in (t or ""))) for d, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items)) for r in decontam.report(df, bench).collect())
    bench.write.parquet(path := f"{tempfile.mkdtemp(prefix='spark-')}/benchmark.parquet")
    left = decontam.decontaminate(spark, df, path.rpartition("/")[0])
    assert sorted(map(str, left.collect())) == sorted(str(Row(doc_id=d, text=t, key="x")) for d, t in rows if t in (clean, None))


def test_keep_one_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (9, text), (4, text + " end"), (7, "a b c d e f"), (7, "g h i j k l"), (None, "m n o p q r"), (None, "m n o p q r"), (None, None), (None, None)]
    left = near_duplicates.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    want = [(4, text + " end"), (7, "a b c d e f"), (7, "g h i j k l"), (None, "m n o p q r"), (None, None), (None, None)]
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(map(str, want))


def components_of(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hub", [50_000, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = components_of(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if k in got} and {k for e in edges if e[0] != e[1] for k in e} == set(got)


def check_near(df, texts, k):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    s = {d: grams(t) for d, t in texts.items()}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    comp = components_of(links, s)
    got = {r.id: (r.n, r.component) for r in near_duplicates.near_duplicates(df.select(F.col("doc_id").alias("id"), "text"), k).collect()}
    assert got == {d: (len(s[d]), comp[d]) for d in s}
    return links


def test_near_duplicates(docs, none, texts):
    check_near(docs, texts, 2)
    assert near_duplicates.near_duplicates(none.select(F.col("doc_id").alias("id"), "text"), 2).collect() == []
    nobody = docs.select(F.when(F.col("doc_id") > 2, F.col("doc_id")).alias("id"), "text")
    assert {(r.id, r.component) for r in near_duplicates.near_duplicates(nobody, 2).collect()} >= {(12, 12), (3, 3)}


def test_near_duplicates_in_chunks(spark, monkeypatch):
    """A family of mutated copies far above the region and chunk limits."""
    monkeypatch.setattr(near_duplicates, "REGION", 6)
    monkeypatch.setattr(near_duplicates, "CHUNK", 7)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(45):
        words = list(base)
        for i in rng.integers(0, 60, d % 9):
            words[i] = f"v{rng.integers(10**6)}"
        texts[d] = " ".join(words)
    texts[45] = texts[7]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert len(check_near(df, texts, 2)) > 50


def test_near_duplicates_far_apart_in_a_region(spark, monkeypatch):
    """One signature order shared by all to the full depth, and no other; the like pairs stand blocks apart."""
    monkeypatch.setattr(near_duplicates, "REGION", 4)
    rng = np.random.default_rng(6)
    low = rng.integers(0, 256, (40, near_duplicates.HASHES)).astype("<u4")
    low[33], low[25] = low[9], low[14]
    signs = low + (np.arange(1, 41, dtype="<u4")[:, None] << np.uint32(8))
    signs[:, : near_duplicates.DEPTH] = 7
    classes = spark.createDataFrame([(i, 10, bytearray(s.tobytes())) for i, s in enumerate(signs)], "id long, n long, sign binary").repartition(3)
    bits = spark.sparkContext.broadcast(sketch.repeated(classes.select("sign"), near_duplicates._tree_keys, 960))
    assert sorted(sorted(p) for p in near_duplicates._likely_pairs(classes, bits).collect()) == [[9, 33], [14, 25]]
    rows = classes.mapInArrow(near_duplicates._branches(bits, True), near_duplicates.REGIONS)
    tasks = near_duplicates._placed(rows, near_duplicates._large_prefixes(rows.select(*near_duplicates.PREFIXES, "id")))
    assert max(r["count"] for r in tasks.groupBy("region", "own").count().collect()) < 12 and tasks.where("blocks = 10").count() == 40


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 12))
    vectors = {i: (base[i % 6] + rng.normal(scale=0.25, size=12)).astype(np.float32).tolist() for i in range(90)}
    vectors |= {90: vectors[3], 91: vectors[3], 92: [0.0] * 12, 93: None, 94: [float("nan")] + [1.0] * 11, 95: [1.0] * 5, 96: [None] + [1.0] * 11, 97: [2 * x for x in vectors[3]]}
    labels = {i: None if i == 50 else i % 3 for i in vectors}
    labels |= {90: labels[3], 91: labels[3], 97: labels[3]}
    df = spark.createDataFrame([(i, v, labels[i], "x") for i, v in vectors.items()], "id long, embedding array<float>, label int, key string").repartition(3)
    good = {i: np.array(v, float) for i, v in vectors.items() if labels[i] is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and labels[a] == labels[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93]
    comp = components_of(links, vectors)
    got = {r.id: (r.n_links, r.component) for r in embeddings.near_vectors(df, 0.93).collect()}
    assert got == {i: (sum(i in p for p in links), comp[i]) for i in vectors} and len(links) > 20
    assert embeddings.near_vectors(df.limit(0), 0.93).collect() == []
    nobody = spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)], "id long, embedding array<float>, label int")
    assert {(r.id, r.component) for r in embeddings.near_vectors(nobody, 0.93).collect()} >= {(5, 5)}


@pytest.mark.parametrize("d", [1, 4, 7, 64])
def test_blocks_lose_no_link(d):
    """Pairs at the very threshold, spread over all blocks or in a single one, alike and in two chunks; and few pairs are compared."""
    rng, cosine = np.random.default_rng(d), 0.93
    x = rng.normal(size=(300, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=(300, d))
    if d > 1:
        turn[100:200, : d - 1] = 0  # all of the difference in one coordinate, before the rotation
        turn -= (turn * x).sum(1, keepdims=True) * x
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    angle = np.arccos(cosine) * np.where(np.arange(300) % 2, 1 - 1e-7, 1 + 1e-7)[:, None]
    y = np.cos(angle) * x + np.sin(angle) * turn if d > 1 else x * 3.0
    want = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= cosine
    assert (embeddings.block_links(x, y, cosine, False)[0] == want).all() and want.diagonal()[1::2].all()
    link, compared = embeddings.block_links(x, x, cosine, True)
    assert ((link | link.T) == ((x @ x.T >= cosine) & ~np.eye(300, dtype=bool))).all()
    assert d < 64 or np.mean(compared) < 0.1 * 300 * 299 / 2


def test_spanning():
    rng = np.random.default_rng(0)
    link = rng.random((40, 30)) < 0.02
    edges = embeddings.spanning(link)
    assert components_of(edges, range(70)) == components_of([(int(i), int(j) + 40) for i, j in zip(*np.nonzero(link), strict=True)], range(70))
    assert embeddings.spanning(np.zeros((3, 3), bool)) == []


def test_packing(docs, none, texts):
    words = packing.WordTokenizer(packing.vocabulary_path())
    ids = {d: [*words.model.encode(t or "", add_special_tokens=False).ids, packing.END] for d, t in texts.items()}
    assert {d: words.ids(t or "").tolist() for d, t in texts.items()} == ids
    for odd in ("it's \x1c# áb İstanbul <|endoftext|> x", "日本 語　全角 x y 한글 ᄒ ᅡ", "'s don't 12.5 … A\u0301", "\u0958 \u0958!! \u0130 \u0130!! a!! a!!! !! x's y' z''s b#c# b#c#!"):
        assert words.ids(odd).tolist() == [*words.model.encode(odd, add_special_tokens=False).ids, packing.END]
    pieces, sequences = {}, {}
    window = 64
    for r in packing.pack(docs, packing.vocabulary_path(), window, 500).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in pieces.items():
        assert sorted(x)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) and sum(n for _, n in x) == len(ids[d])
    assert set(pieces) == set(ids)
    for x in sequences.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end == window or end & (end - 1) == 0
    assert packing.pack(none, packing.vocabulary_path()).collect() == []


def test_outputs_are_whole(docs, texts):
    """Packed sequences hold token ids, the removals the kept text; the digests follow from them."""
    words = packing.WordTokenizer(packing.vocabulary_path())
    for r in packing.pack(docs, packing.vocabulary_path(), 64, 500).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert ids.tolist() == words.ids(texts[r.doc_id] or "")[r.start : r.start + r.length].tolist() and zlib.crc32(r.ids) == r.ids_crc32
    assert all(sha(r.kept) == r.kept_sha256 and len(r.kept.encode().split()) == r.n_words - r.n_removed for r in substrings.dedup(docs, 6).collect())
    assert all(sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in suffixes.dedup(docs).collect())


def test_least_squares():
    h = np.zeros(65, np.int64)
    h[[10, 54, 20, 24]] = [5, 3, 8, 4]
    patterns = packing.combinations(np.flatnonzero(h), h[np.flatnonzero(h)], 64)
    times = packing.repeat_counts(patterns, h)
    used = sum((n * np.bincount(p, minlength=65) for p, n in zip(patterns, times, strict=True)), np.zeros(65, int))
    assert (10, 54) in patterns and (20, 20, 24) in patterns and (used <= h).all() and times[patterns.index((10, 54))] == 3 and times[patterns.index((20, 20, 24))] == 4


def test_warc(spark, tmp_path):
    pages = {1: ("http://a.org/x", "<p>é</p>"), 2: ("http://www.b.org/y z\n", "<p>é</p>"), 3: (None, None), 4: ("x", ""), 5: ("http://a.org/x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), 6: ("http://a.org/x", "<p>é</p>"), 7: ("http://c/" + "p" * 3000, "long " * 20000)}
    df = spark.createDataFrame([(i, u, h, "k") for i, (u, h) in pages.items()], "page_id long, url string, html string, digest string").repartition(3)
    warc.write(df, str(tmp_path / "w"))
    out = warc.index(warc.read(spark, str(tmp_path / "w"))).collect()
    nobody = spark.createDataFrame([(None, "http://n/", "none")], "page_id long, url string, html string")
    warc.write(nobody, str(tmp_path / "n"))
    assert [(r.page_id, r.record_type) for r in warc.index(warc.read(spark, str(tmp_path / "n"))).collect()] == [(None, "response")]
    groups = {}
    for i, (_, h) in pages.items():
        groups.setdefault(h or "", []).append(i)
    for r in out:
        html = pages[r.page_id][1] or ""
        top = max(groups[html])
        assert r.payload_bytes == len(html.encode()) and r.intact
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
    keys = [(r.url_key, r.ts, r.page_id) for r in out]
    assert sorted(r.page_id for r in out) == sorted(pages) and keys == sorted(keys)
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.index(warc.read(spark, str(tmp_path / "e"))).collect() == []


def test_warc_without_ids(spark, tmp_path):
    """Rows with null or repeated ids have one record each."""
    rows = [(None, "http://n/", "a")] * 3 + [(None, "http://n/", "b"), (5, "http://x/", "a"), (5, "http://x/", "c"), (5, "http://y/", "c"), (6, None, "dd"), (5, "http://x/", "dd")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    out = warc.index(warc.read(spark, str(tmp_path / "w"))).collect()
    want = [(None, 1, "revisit", 5)] * 3 + [(None, 1, "response", None), (5, 1, "response", None), (5, 1, "response", None), (5, 1, "response", None), (6, 2, "response", None), (5, 2, "revisit", 6)]
    assert all(r.intact for r in out) and sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in out)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted((f"u{x}", "t", i) for x in rng.integers(0, 9, rng.integers(0, 12))) for i in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize(("held", "fan_in"), [(1000, 64), (7, 64), (7, 2), (1, 3)])
def test_external_merge(held, fan_in):
    """Rows in any order, with nulls and ties, whether they fit into memory or not."""
    rng = np.random.default_rng(held)
    rows = [(f"u{a}", None if b == 3 else f"t{b}", None if c < 2 else int(c), f"run{i}") for i, (a, b, c) in enumerate(rng.integers(0, 9, (200, 3)))]
    schema = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("run", pa.string())])
    out = list(warc.merged(iter(rows), schema, held, fan_in))
    assert sorted(map(str, out)) == sorted(map(str, rows)) and list(map(warc.order_of, out)) == sorted(map(warc.order_of, rows))
    assert list(warc.merged(iter([]), schema)) == [] and [len(r) for r in warc.natural_runs([("b",), ("c",), ("a",), ("a",)])] == [2, 2]


def test_archives_are_bounded(spark, tmp_path):
    """Large pages make archives of fewer records; all are read again."""
    df = spark.createDataFrame([(i, f"http://a.org/{i % 7}", "xyz" * 400_000 + str(i)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    assert warc.records_each(df) < 30
    warc.write(df, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w"))
    assert found.select("run").distinct().count() >= 3 and sorted(r.page_id for r in warc.index(found).where("intact").collect()) == list(range(60))


def test_base_spans(texts):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def slow(text):
        out = []
        for kind, p in enumerate(patterns):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                ok = kind == 0 or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 16 <= len(d) <= 19 and pii.luhn(d)) or (kind == 3 and 8 <= len(d) <= 15)
                out += [(kind, *m.span())] if ok else []
        return sorted(out)

    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("a1.@+- ()9é"), 60)) for _ in range(300)]
    for text in [*made, *(t or "" for t in texts.values())]:
        assert sorted(pii.base_spans(text)) == slow(text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_url_parts(spark):
    urls = ["http://A.Example.org/es/x?q#f", "https://org/en/1", "x", None, "http://example.org/en/12", "http://a.com?x/fr/", "http://b.com/fr/y", "http://nobody.net/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = by_id(url_filter.judge(df), "page_id")
    assert [(r.host, r.path, r.rule) for _, r in sorted(got.items())] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("org", "/en/1", "org/"), ("", "", None), ("", "", None), ("example.org", "/en/12", "example.org/en/1"), ("a.com", "", None), ("b.com", "/fr/y", "com/fr/"), ("nobody.net", "/", None), ("b:", "//c/d", None),
    ]
    assert got[3].verdict == "block" and got[0].verdict == "block" and got[6].verdict == "allow"
    assert url_filter.judge(df.limit(0)).collect() == []
