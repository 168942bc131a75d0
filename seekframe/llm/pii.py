"""Personal data: fixed patterns, and a character tagger trained on their spans that adds more.

Base spans are the patterns' leftmost non-overlapping matches, found in linear time, with their checks. The
tagger (bidirectional LSTM with CRF transitions) is trained in numpy on windows around labelled spans, a bounded
sample of those of all documents: base spans, and values that are assigned to a name like ``token`` as ``secret``, each also rewritten
in other usual forms (brackets, blanks, other separators, no plus sign, other names) and replaced by harmless numbers such as dates. What only
fails a check of its digits is no counter-example. To find spans, windows lie over every whole text; they overlap, each
character takes the tag of the window in which it is most central, and spans are read off the reconciled tags of the whole text and
widened to whole words. A span is added if it meets no base span and is made of the characters of its kind.

Null and empty texts have no spans. Offsets are code points of the whole text, end exclusive. Repeated rows get
equal answers. With no document to learn from, base spans are all there is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, staged
from .tagger import KINDS, Tagger, symbols

#: The tagger is fitted to at most so many labelled stretches of text.
SAMPLE = 1500
BASE_KINDS = 4  # the first kinds have patterns, the last is only learnt
WIDTH, MARGIN = 96, 24  # of windows to learn from, and of stretches around digits there
WIDE, OVERLAP, BATCH = 288, 48, 2048  # of windows of whole texts, in characters, and how many are decoded at once

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digit runs end only where they end, so no later start inside one can match
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
SECRET = re.compile(r"(?i)\b(?:token|secret|passwords?|api[_ -]?key|access[_ -]?key)\b[\"']?\s*[=:]\s*[\"']?([a-z0-9+/_=-]{16,128})")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in LOCAL:
            left -= 1
        if left < at and (right := DOMAIN.match(text, at + 1)):
            yield left, right.end()
            end = right.end()
        at = text.find("@", max(at + 1, end))


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    out = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def labelled_spans(text: str) -> list[Span]:
    """What the tagger learns from: base spans, and assigned secrets that meet none."""
    base = base_spans(text)
    secrets = [(4, *m.span(1)) for m in SECRET.finditer(text) if re.search("[0-9]", m[1])]
    return base + [x for x in secrets if not any(s < x[2] and x[1] < e for _, s, e in base)]


def doubtful(text: str) -> bool:
    """Whether a text holds numbers that only fail a check of their digits."""
    return any(13 <= len(_digits(m.group())) <= 19 and not luhn(_digits(m.group())) for m in CARD.finditer(text)) or len(IP.findall(text)) != sum(k == 1 for k, _, _ in base_spans(text))


#: What a span of each kind is made of; what it means is the tagger's to say.
FORMS = (
    re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9][A-Za-z0-9.-]{1,63}"),
    re.compile(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|,)[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[ ./-]?[0-9]){12,18}"),
    re.compile(r"(?:\+|\()?[0-9](?:[ ()./-]{0,2}[0-9]){7,14}"),
    re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=-]{16,128}"),
)


#: A day of a year, which has as many digits as a short phone number.
DATE = re.compile(r"(?:19|20)[0-9]{2}([./-])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([./-])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}")


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """Whether an added span is made of what its kind is made of, and stands alone, not inside a longer word or number."""
    span, before, after = text[start:end], text[start - 1 : start], text[end : end + 1]
    if re.match(r"\w", before) or re.match(r"\w", after) or not FORMS[kind].fullmatch(span):
        return False
    if kind == 3 and (re.fullmatch(r"[0-9]+[.,][0-9]+", span) or DATE.fullmatch(span)):  # a decimal number
        return False
    return kind != 1 or all(int(x) <= 255 for x in re.findall("[0-9]+", span))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within ``MARGIN`` characters of a digit or an @."""
    at = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * MARGIN)
    return [(max(0, int(a) - MARGIN), min(len(text), int(b) + MARGIN)) for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)], strict=True)]


def tagged_spans(tags: np.ndarray) -> Iterator[Span]:
    """(kind, start, end) of every run of one kind that no new begin parts."""
    at = np.flatnonzero(tags)
    kind, start, last = -1, 0, -2
    for i, t in zip(at.tolist(), tags[at].tolist(), strict=True):
        now = (t - 1) // 2
        if kind >= 0 and (now != kind or t % 2 == 1 or i != last + 1):
            yield kind, start, last + 1
            kind = -1
        if kind < 0:
            kind, start = now, i
        last = i
    if kind >= 0:
        yield kind, start, last + 1


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    """Without marks at its ends, and with the letters and digits that go on there."""
    while start < end and not text[start].isalnum() and text[start] not in "+(":
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    while start < end and start > 0 and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while start < end < len(text) and text[end].isalnum():
        end += 1
    return start, end


def windows_of(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, low, high) of windows over a text of ``n`` characters: they overlap by ``OVERLAP``, and of each the characters from low to high, all in all every one once, take its tags."""
    at = 0
    while True:
        end = min(n, at + WIDE)
        yield at, end, at + OVERLAP // 2 if at else 0, end - OVERLAP // 2 if end < n else n
        if end == n:
            return
        at = end - OVERLAP


def tagged(texts: list[str], model: Tagger) -> list[np.ndarray]:
    """The tags of all characters of every whole text."""
    tags = [np.zeros(len(t), np.int8) for t in texts]
    waiting: dict[int, list] = {}

    def flush(width: int) -> None:
        rows = waiting.pop(width, [])
        block = np.zeros((len(rows), width), np.int8)
        for i, (_, part, *_) in enumerate(rows):
            block[i, : len(part)] = part
        for (k, _, at, low, high), row in zip(rows, model.decode(block), strict=True):
            tags[k][low:high] = row[low - at : high - at]

    for k, text in enumerate(texts):
        codes = symbols(text).astype(np.int8)
        for at, end, low, high in windows_of(len(text)):
            width = -(-(end - at) // 48) * 48  # the last window of a text is not padded to the width of the others
            if width:
                waiting.setdefault(width, []).append((k, codes[at:end], at, low, high))
                if len(waiting[width]) >= BATCH:
                    flush(width)
    for width in list(waiting):
        flush(width)
    return tags


def added_spans(texts: list[str], bases: list[list[Span]], model: Tagger) -> list[list[Span]]:
    """What the tagger adds to the base spans of each text; it reads all of every text."""
    found: list[list[Span]] = [[] for _ in texts]
    for text, base, own, tags in zip(texts, bases, found, tagged(texts, model), strict=True):
        taken = np.zeros(len(text), bool)
        for _, s, e in base:
            taken[s:e] = True
        for kind, start, end in tagged_spans(tags):
            start, end = widened(text, start, end)
            if end > start and plausible(kind, text, start, end) and not taken[start:end].any():
                own.append((kind, start, end))
                taken[start:end] = True
    return found


def _cut(digits: str, sizes, mark: str) -> str:
    """Groups of digits of the given sizes, the last as long as needed."""
    out = []
    for n in sizes:
        out.append(digits[:n])
        digits = digits[n:]
    return mark.join(x for x in [*out, digits] if x)


def varied(kind: int, span: str, rng: np.random.Generator) -> str:
    """The same datum in another usual form."""
    pick = lambda *forms: forms[rng.integers(len(forms))]
    if kind == 0:
        local, _, domain = span.partition("@")
        return pick(span, f"{local}@{domain.split('.')[0]}", f"{local.replace('.', '-')}@{domain}", f"{local} (at) {domain}", f"{local}[at]{domain}", f"{local} @ {domain}")
    if kind == 1:
        return pick(span, span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", ","))
    if kind == 4:
        return pick(span, span.upper(), span.lower(), "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), rng.integers(20, 44))))
    d = _digits(span)
    if kind == 2:
        return pick(d, _cut(d, (4, 4, 4), " "), _cut(d, (4, 4, 4), "-"), _cut(d, (4, 4, 4), "."), _cut(d, (4, 6), " "))
    d = d[-int(rng.integers(9, 12)) :]
    return pick(f"({d[:3]}) {_cut(d[3:], (3,), '-')}", f"({d[:4]}) {d[4:]}", _cut(d, (3, 3), "-"), _cut(d, (3, 3), "."), _cut(d, (3, 3), " "), _cut("00" + d, (4, 3), " "), _cut("0" + d, (4,), "/"), f"+{_cut(d, (2, 3, 3), '.')}", f"+{_cut(d, (2, 3), ' ')}")


def harmless(rng: np.random.Generator) -> str:
    """A number that is no personal datum: dates, times, versions, amounts, ranges, short codes."""
    n = lambda low, high: int(rng.integers(low, high))
    day = (n(1950, 2035), n(1, 13), n(1, 29))
    forms = (
        "{0}-{1:02}-{2:02}".format(*day), "{2:02}.{1:02}.{0}".format(*day), "{1}/{2}/{0}".format(*day), f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"{n(1900, 2030)}-{n(1900, 2030)}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 200)}", f"{n(1, 1000):,}{n(1, 1000):,}",
        f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"{n(0, 1000)}.{n(0, 10**6)}", str(n(0, 10 ** n(1, 8))), f"{n(1, 100)} %", f"#{n(1, 100000)}", f"{n(1, 30)}{'abcdef'[n(0, 6)]}{n(1, 99)}", f"{n(1, 99)}x{n(1, 99)}", f"{n(1, 99)} {n(1, 99)} {n(1, 99)}", f"({n(1, 2100)})",
    )
    return forms[rng.integers(len(forms))]


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of whole texts around labelled spans and around other digits, each with a hash of its content."""
    for batch in batches:
        out = []
        for x in batch.column("text"):
            text = x.as_py() or ""
            if not TRIGGER.search(text):
                continue
            spans = labelled_spans(text)
            out += [text[max(0, s - 2 * WIDTH) : e + 2 * WIDTH] for _, s, e in spans]
            out += [text[a : min(b, a + 4 * WIDTH)] for a, b in regions(text) if not any(s < b and a < e for _, s, e in spans) and not doubtful(text[a:b])]
        hashes = [int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:7]) for t in out]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(out, pa.string())], names=["h", "text"])


SECRET_NAMES = ("token", "key", "apikey", "API_KEY", "secret", "password", "auth", "Bearer", "access", "id_token")


def training_windows(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows around labelled spans, each also in other forms and with a harmless number in its place, and of windows around other digits."""
    rng = np.random.default_rng(seed)
    codes, tags = [], []

    def add(text: str, spans: list[Span], center: int) -> None:
        at = max(0, center - WIDTH // 2 + int(rng.integers(-16, 17)))
        row = symbols(text[at : at + WIDTH])
        tag = np.zeros(len(text) + 1, np.int64)
        for kind, s, e in spans:
            tag[s], tag[s + 1 : e] = 1 + 2 * kind, 2 + 2 * kind
        codes.append(np.pad(row, (0, WIDTH - len(row))))
        tags.append(np.pad(tag[at : at + len(row)], (0, WIDTH - len(row))))

    for text in texts:
        spans = labelled_spans(text)
        for kind, s, e in spans:
            # other spans of the stretch are left out, as their labels can't follow
            before, after = (text[max([x for _, _, x in spans if x <= s], default=0) : s], text[e : min([x for _, x, _ in spans if x >= e], default=len(text))])
            if doubtful(before) or doubtful(after):
                continue
            for n in range(5):
                other = text[s:e] if n == 0 else varied(kind, text[s:e], rng) if n < 4 else harmless(rng)
                lead = before if kind != 4 or n == 0 else re.sub(r"\w+([\"']?\s*[=:]\s*[\"']?)$", lambda m: SECRET_NAMES[rng.integers(len(SECRET_NAMES))] + m[1], before)
                add(lead + other + after, [(kind, len(lead), len(lead) + len(other))] if n < 4 else [], len(lead))
        if not spans:
            add(text, [], len(text) // 2)
    return np.array(codes).reshape(-1, WIDTH), np.array(tags).reshape(-1, WIDTH)


def train(docs: DataFrame) -> Tagger | None:
    """The tagger, from the ``SAMPLE`` labelled stretches of all documents with the smallest content hashes; None if there are none."""
    found = staged(docs.select("text").mapInArrow(_snippets, "h long, text string").distinct(), "labelled")
    # hashes are even over 56 bits: this cut leaves about twice the sample, so no task sends more than its share of that
    cut = int(2**56 * min(1.0, 2 * SAMPLE / max(1, found.count())))
    rows = found.where(F.col("h") < cut).orderBy("h", "text").limit(SAMPLE).collect()
    codes, tags = training_windows([r.text for r in rows])
    return Tagger().fit(codes, tags) if len(codes) else None


def _all_spans(texts: list[str], model: Tagger | None) -> tuple[list[list[Span]], list[list[Span]]]:
    bases = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    more = added_spans(texts, bases, model) if model else [[] for _ in texts]
    return bases, more


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts = [], batch.column(0), [x.as_py() or "" for x in batch.column(1)]
            for base, more in zip(*_all_spans(texts, shared.value), strict=True):
                n = np.bincount([k for k, _, _ in base], minlength=BASE_KINDS).tolist()
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            kinds = [pa.int64()] * BASE_KINDS + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[f.split()[0] for f in RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; spans that meet become one, named by the first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; other columns stay."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index("text"))
            texts = [x.as_py() or "" for x in column]
            clean = [redacted(t, b + m) for t, b, m in zip(texts, *_all_spans(texts, shared.value), strict=True)]
            new = pa.array([c if x.is_valid else None for c, x in zip(clean, column, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(i) for i, n in enumerate(names)], names=names)

    return docs.mapInArrow(run, docs.schema)


def op7(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced by its kind, and ``n_chars`` follows."""
    short_batches(spark)
    return redact(docs, train(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)
