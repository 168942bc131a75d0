"""Learnt operators: held-out accuracy, gradients, and edge cases; and the pipeline's stages."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seekframe.llm import decontam, language_id, near_duplicates, packing, pii, tagger, url_filter


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_language_accuracy(spark, documents):
    rows = language_id.op1(spark, "/root/testdata/sf0.001").join(documents, "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(docs, none):
    langs, vectors = language_id.prototypes(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, langs, vectors, ["doc_id"]).collect()}
    assert all(got[d] == ("und", 0.0) for d in (3, 4, 5)) and got[0] == got[1] and got[9][0] == "fr"
    langs, vectors = language_id.prototypes(none)
    assert langs == [] and language_id.identify(none, langs, vectors, ["doc_id"]).collect() == []


def test_language_stage(spark, documents, none):
    """Keeps every document of the table that has letters, rejects noise, whatever the columns are called."""
    rng = np.random.default_rng(1)
    noise = [" ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(120)) for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрст", "中国人大来上个") for _ in range(10)]
    base = documents.select("doc_id", "text", "lang")
    made = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(noise)] + [(-1, "12 34 !"), (-2, None), (-3, ""), (-4, "ab"), (-4, "ab")], "doc_id long, text string")
    df = base.unionByName(made, allowMissingColumns=True).withColumns({"score": F.lit("mine"), "lang_pred": F.lit(3), "_trigrams": F.lit(1), "language_id_text": F.lit(2)})
    left = language_id.keep_identified(spark, df, "").collect()
    ids = [r.doc_id for r in left]
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.score == "mine" and r.lang_pred == 3 for r in left) and ids.count(-4) == 2 and not {-1, -2, -3} & set(ids)
    assert sum(i >= 10**6 for i in ids) <= 3 and {i for i, t in texts.items() if t and any(c.isalpha() for c in t)} - set(ids) == set()
    only = language_id.keep_identified(spark, df.where("doc_id < 1000000"), "", wanted=["fr"]).where("lang is not null").collect()
    assert only and np.mean([r.lang == "fr" for r in only]) > 0.95
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language_id.keep_identified(spark, unlabelled, "").collect()} >= set(range(10**6, 10**6 + 30)) | {-4}
    assert language_id.keep_identified(spark, none, "").collect() == []


def test_gradients():
    model = tagger.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    codes, gold = rng.integers(0, tagger.SYMBOLS, (3, 6)), rng.integers(0, tagger.TAGS, (3, 6))
    _, grads = model.step(codes, gold)
    for name in ("embed", "xf", "hb", "out", "move", "start"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        old, e = model.p[name][at], 1e-4
        model.p[name][at] = old + e
        up = model.step(codes, gold)[0]
        model.p[name][at] = old - e
        down = model.step(codes, gold)[0]
        model.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def held_out_sentences(n):
    """(text, span or None): data in other forms than the patterns', or harmless numbers, between words of the tables."""
    rng = np.random.default_rng(99)
    words = "the and with thatin einer pour nicht that des les esos wird over under mente que la ing er".split()
    digits = lambda k, of="0123456789": "".join(rng.choice(list(of), k))
    out = []
    while len(out) < n:
        lead, tail = (" ".join(rng.choice(words, 8)) for _ in range(2))
        lead, tail, kind = lead + " ", " " + tail, int(rng.integers(6))
        if kind == 5:
            out.append((lead + pii.harmless(rng) + tail, None))
            continue
        plain = [f"{rng.choice(words)}.{digits(2)}@{rng.choice(words)}{digits(1)}.example.org", ".".join(str(rng.integers(256)) for _ in range(4)), digits(16), f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", digits(40, "0123456789abcdef")][kind]
        x = pii.varied(kind, plain, rng)
        if kind == 4:
            lead, tail = lead + 'auth_key: "', '"' + tail
        out.append((lead + x + tail, (kind, len(lead), len(lead) + len(x))))
    return out


def test_tagger_on_held_out_forms(model):
    made = [(t, x) for t, x in held_out_sentences(900) if x is None or not pii.base_spans(t)]
    more = pii.added_spans([t for t, _ in made], [[] for _ in made], model)
    right = sum(x in m for (_, x), m in zip(made, more, strict=True))
    assert right / sum(map(len, more)) > 0.95 and right / sum(x is not None for _, x in made) > 0.9
    for kind in range(5):
        own = [(x, m) for (_, x), m in zip(made, more, strict=True) if x and x[0] == kind]
        assert np.mean([x in m for x, m in own]) > 0.8


def test_tagger_adds_to_the_table(spark, model):
    """All assigned secrets of the table, and hardly anything in documents without personal data."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()
    texts = [r.text for r in rows]
    more = pii.added_spans(texts, [pii.base_spans(t) for t in texts], model)
    secrets = [{x for x in pii.labelled_spans(t) if x[0] == 4} for t in texts]
    assert sum(map(len, secrets)) > 10 and all(s <= set(m) for s, m in zip(secrets, more, strict=True))
    assert sum(len(set(m) - s) for s, m in zip(secrets, more, strict=True)) < 30


def test_query_against_brute_force(spark):
    """Counts and digest of the query on the smallest table whole; all base spans are among the spans."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got, added = pii.op7(spark, "/root/testdata/sf0.001").collect(), 0
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = []
        for kind, p in patterns.items():
            for m in re.finditer(p, texts[r.doc_id]):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                    base.append((kind, *m.span()))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in patterns]
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(","))
        added += len(r.spans.split(",")) - max(1, len(listed))
    assert added > 0


def test_tagger_edges(docs, none, model):
    texts = ["and they said (988) 555-2485 was the one to use", "nothing here at all", "the year 1984 and 2024-05-06 at 12:30, version 1.2.3"]
    more = pii.added_spans(texts, [pii.base_spans(t) for t in texts], model)
    assert [(k, texts[0][s:e]) for k, s, e in more[0]] == [(3, "(988) 555-2485")] and more[1:] == [[], []]
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert (got[8].n_email, got[8].n_ip, got[8].n_card, got[8].n_phone) == (1, 1, 1, 1) and got[3].spans == got[4].spans == ""
    clean = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert clean[8].text == "mail me at [EMAIL] or [IP], card [CARD], tel [PHONE] now" and clean[3].text is None and clean[0].key == "x"
    assert pii.train(none) is None and pii.find(none, None).collect() == []


def test_long_stretches_agree_with_their_parts(model):
    """Over many overlapping windows the spans are those of every part by itself."""
    part = "they called (988) 555-2485 again, room 12 of 30, "
    one = pii.added_spans([part + part], [[]], model)[0]
    assert [(k, (part + part)[s:e]) for k, s, e in one] == [(3, "(988) 555-2485")] * 2
    assert pii.added_spans([part * 40], [[]], model)[0] == [(3, i * len(part) + 12, i * len(part) + 26) for i in range(40)]


def test_tagger_reads_whole_texts():
    """Every character is tagged once, by one of overlapping windows, whatever is around it, so that what holds neither digit nor @ may be found."""

    class Echo:
        def decode(self, codes):
            return codes

    texts = ["", "x", "no trigger here " * 3, *("aB 1." * 300)[:1000].rpartition(" ")[::2], "b. " * 40000] + ["a-Z" * 200 for _ in range(20)] + ["y" * n for n in (48, 240, 241, 287, 288, 289, 528, 529)]
    got = pii.tagged(texts, Echo())
    assert all(np.array_equal(g, tagger.symbols(t)) for g, t in zip(got, texts, strict=True))

    class Email(Echo):
        def decode(self, codes):
            return np.full(codes.shape, 2, np.int8)

    text = "maria.lopez (at) mail.example.org"
    assert pii.added_spans([text], [[]], Email()) == [[(0, 0, len(text))]]


def test_decoding_is_the_best_sequence(model):
    """Side by side, without windows that are outside for certain: the same tags as from the emissions of learning, step by step."""
    texts = [t for t, _ in held_out_sentences(60)]
    codes = np.array([np.pad(tagger.symbols(t)[:96], (0, max(0, 96 - len(t)))) for t in texts])
    e, _ = model._emit(codes)
    best, back = model.p["start"] + e[0], []
    for row in e[1:]:
        paths = best[:, :, None] + model.p["move"]
        back.append(paths.argmax(1))
        best = paths.max(1) + row
    tags = [best.argmax(1)]
    for b in reversed(back):
        tags.append(b[np.arange(len(b)), tags[-1]])
    want, got = np.array(tags[::-1]).T, model.decode(codes)
    assert (want > 0).sum() > 500 and np.mean(want == got) > 0.999


def test_url_model_separates(spark):
    good = [f"http://site{i}.org/page/{i}" for i in range(60)]
    bad = [f"http://shop{i}.com/de/buy-now-{i}" for i in range(60)]
    new = ["http://site77.net/page/3", "http://shop99.net/de/buy-now-4"]
    df = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert (got[120], got[121]) == ("allow", "block")


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_url_query_against_brute_force(spark, folder):
    """Host, path, rule, score and verdict of every page, with the models computed one character at a time."""
    order, strength = url_filter.ORDER, url_filter.STRENGTH
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    lower = str.maketrans(url_filter.UPPER, url_filter.LOWER)

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        return host.translate(lower), re.split("[?#]", rest[len(host) :])[0]

    def rule(host, path):
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    ruled = {r.url: rule(*parts(r.url)) for r in pages if r.url}
    held = {u for u in ruled if zlib.crc32(u.encode()) % 4 == 2}
    sizes = [sum(v == side and (u in held) == h for u, (_, v) in ruled.items()) for side in ("allow", "block") for h in (True, False)]
    split = min(sizes) >= url_filter.LEAST_HELD
    assert split == ("0.1" in folder)
    counts = {side: {} for side in ("allow", "block")}
    for url, (_, verdict) in ruled.items():
        if verdict and not (split and url in held):
            padded = " " * order + url.lower()
            for i in range(len(url)):
                for k in range(order + 1):
                    gram = padded[i + order - k : i + order + 1]
                    for key in (gram, gram[:-1] + "\0"):
                        counts[verdict][key] = counts[verdict].get(key, 0) + 1

    def score(url):
        padded, total = " " * order + url.lower(), 0.0
        for i in range(len(url)):
            p = dict.fromkeys(counts, 1 / url_filter.ALPHABET)
            for side, n in counts.items():
                for k in range(order + 1):
                    gram = padded[i + order - k : i + order + 1]
                    p[side] = (n.get(gram, 0) + strength * p[side]) / (n.get(gram[:-1] + "\0", 0) + strength)
            total += np.log(p["allow"]) - np.log(p["block"])
        return total / len(url)

    scores = {u: score(u) for u in ruled}
    known = [(scores[u], ruled[u][1] == "allow") for u in (held if split else ruled) if ruled[u][1]]
    bins = sorted({round(x, 2) for x, _ in known})
    sides = [sum(a for _, a in known), sum(not a for _, a in known)]
    errors = [sum(a for x, a in known if round(x, 2) < b) / sides[0] + sum(not a for x, a in known if round(x, 2) >= b) / sides[1] for b in bins]
    best = int(np.argmin(np.round(errors, 12)))
    cut = bins[best] - 0.005 if best == 0 else (bins[best - 1] + bins[best]) / 2
    got = by_id(url_filter.op3(spark, folder), "page_id")
    assert len(got) == len(pages)
    for r in pages:
        g = got[r.page_id]
        name, verdict = rule(*parts(r.url))
        assert (g.host, g.path, g.rule) == (*parts(r.url), name)
        assert g.verdict == (verdict or ("allow" if r.url and scores[r.url] >= cut else "block"))
        assert not r.url or g.score == pytest.approx(scores[r.url], abs=1e-9)
    assert np.mean([(x >= cut) == a for x, a in known]) > 0.8


def test_url_rows_repeat(spark):
    """Repeated and null rows are judged each by itself; grams that all URLs share are joined apart."""
    urls = ["http://a.org/en/1", "http://a.org/en/1", None, None, "", "http://b.com/de/2", "http://c.net/en/1", "x", "ftp://\u00e9.net/\u0130", "http://d.net/" + "p" * 5000]
    df = spark.createDataFrame([(i // 2, u, "x", 1) for i, u in enumerate(urls * 3)], "page_id long, url string, g string, score int").repartition(3)
    rows = url_filter.judge(df).collect()
    assert len(rows) == 30 and all(r.verdict in ("allow", "block") for r in rows)
    by_url = {}
    for r in rows:
        by_url.setdefault((r.host, r.path), set()).add((r.verdict, r.rule, r.score))
    assert all(len(x) == 1 for (h, _), x in by_url.items() if h)


def test_stages(spark, docs, documents):
    names = docs.columns
    kept = language_id.keep_identified(spark, docs, "")
    assert kept.columns == names and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 8, 9} and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    one = near_duplicates.keep_one(spark, docs, "")
    left = {r.doc_id for r in one.collect()}
    assert one.columns == names and 0 in left and 1 not in left and {3, 4, 5} <= left
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(2).collect()]
    leaked = docs.withColumn("text", F.when(F.col("doc_id") == 2, F.lit(f"before {bench[0]} after")).otherwise(F.col("text")))
    left = {r.doc_id for r in decontam.decontaminate(spark, leaked, "/root/testdata/sf0.001").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {2}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, docs, none, documents, name, stage):
    """Empty tables, nulls in every column, repeated rows, and columns with names that the operators use themselves."""
    sf = "/root/testdata/sf0.001"
    clashing = ("key", "id", "n", "score", "lang_pred", "trigrams", "component", "minhash_row", "decontam_key", "place", "first", "sign", "ids", "spans", "start", "length", "words", "h")
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(f"my {c}") for c in clashing})
    names = odd.columns
    assert stage(spark, none.withColumns({c: F.lit("x") for c in clashing if c not in none.columns}), sf).collect() == []
    hollow = odd.unionByName(odd.where("doc_id = 0")).unionByName(spark.createDataFrame([(None,) * len(names)] * 2, ", ".join(f"{c} {t}" for c, t in odd.dtypes)))
    left = stage(spark, hollow, sf)
    rows = left.collect()
    if name == "packing":
        whole = {}
        for r in rows:
            whole.setdefault(r.doc_id, []).append(r.length)
        assert sum(whole[None]) == 2 and sorted(x for x in whole if x is not None) == sorted(r.doc_id for r in docs.collect())
    else:
        assert left.columns == names and all(r[c] == f"my {c}" for r in rows for c in clashing if r.doc_id is not None)
        assert {r.doc_id for r in rows} <= {r.doc_id for r in hollow.collect()} and 9 in {r.doc_id for r in rows}


def test_pipeline_against_brute_force(spark, documents):
    """What every stage keeps of the smallest table, by comparing all with all; and the tokens that come out."""
    sf, texts = "/root/testdata/sf0.001", {r.doc_id: (r.text, r.lang) for r in documents.collect()}
    docs, left = documents, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.staged(stage(spark, docs, sf), f"test-{at}")
        assert docs.columns == documents.columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    # language: counts of trigrams in a dictionary, vectors one by one
    counts = {}
    for d, (t, lang) in texts.items():
        if lang and t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            for g in language_id.trigrams(t).tolist():
                counts.setdefault(lang, {})[g] = counts.get(lang, {}).get(g, 0) + 1
    unit = lambda c: (lambda v: v / np.linalg.norm(v))(language_id.bundle(np.array(list(c)), np.array(list(c.values()), float)))
    known, scores = [unit(c) for _, c in sorted(counts.items())], {}
    for d, (t, _) in texts.items():
        grams = dict(zip(*map(np.ndarray.tolist, np.unique(language_id.trigrams(t or ""), return_counts=True)), strict=True))
        scores[d] = (sum(grams.values()), max(0.0, *(float(unit(grams) @ v) for v in known)) if grams else 0.0)
    long = sorted(s for d, (n, s) in scores.items() if n >= language_id.ENOUGH and texts[d][1])
    least = min(language_id.NOISE / language_id.DIMENSIONS**0.5, long[int(len(long) * language_id.ATYPICAL)])
    want = {d for d, (n, s) in scores.items() if n and (n < language_id.ENOUGH or s >= least - 1e-9)}
    assert set(left["language_id"]) == want
    # near-duplicates: five words, four fifths, the smallest id stays
    def grams_of(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, up = {d: grams_of(texts[d][0]) for d in want}, {d: d for d in want}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(want):
        for b in sorted(want):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    want = {d for d in want if root(d) == d}
    assert set(left["near_duplicates"]) == want and len(want) < len(sets)
    # decontamination: ten words in a row
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    want = {d for d in want if not any(tuple(w[i : i + n]) in windows for w in (words(texts[d][0]),) for n in sizes for i in range(len(w) - n + 1))}
    assert set(left["decontamination"]) == want and len(want) < len(left["near_duplicates"])
    # personal data: every document stays, no base span does, and what has no digit is as it was
    assert set(left["pii"]) == want and sum(bool(pii.base_spans(texts[d][0])) for d in want) > 0
    for d, t in left["pii"].items():
        assert pii.base_spans(t) == [] and (re.search("[0-9@]", texts[d][0]) or t == texts[d][0])
    # packing: the tokens of every document, each once
    words_of, found = packing.WordTokenizer(packing.vocabulary_path()), {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        found.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {d: [i for _, part in sorted(p) for i in part] for d, p in found.items()} == {d: words_of.ids(t).tolist() for d, t in left["pii"].items()}


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ends = {}
    for r in rows:
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
    assert rows and all(ends[r.doc_id] == r.doc_tokens for r in rows)
