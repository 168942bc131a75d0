"""Pieces of the SQL with which the catalogue's queries are checked."""

from __future__ import annotations

from ..functions.text import LOWER, MAX_UNITS, UPPER

_DOCS = """docs AS (SELECT doc_id + 1 AS doc_id, '/' || lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS name,
    1704067200 + doc_id * 3600 AS mtime, 1704067200 + doc_id * 3600 + doc_id % 5 * 60 AS ctime, text, lang, source, n_chars FROM documents)"""

_TOK = f"""tok AS (
    SELECT doc_id, 'content' AS field, left(t.term, {MAX_UNITS}) AS term, t.pos AS pos FROM docs, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+')) WITH ORDINALITY AS t(term, pos)
    UNION ALL SELECT doc_id, 'filename', left(t.term, {MAX_UNITS}), t.pos FROM docs, unnest(regexp_extract_all(translate(name, '{UPPER}', '{LOWER}'), '[a-z0-9]+')) WITH ORDINALITY AS t(term, pos))"""

TREE = """WITH RECURSIVE t AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS parent_id, r_name AS name FROM region
    UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name FROM customer),
    walk AS (SELECT doc_id, '/' || name AS path FROM t WHERE parent_id = 0 UNION ALL SELECT t.doc_id, w.path || '/' || t.name FROM t JOIN walk w ON t.parent_id = w.doc_id)
"""

MIME_TYPES = ("text/plain", "text/html", "image/png", "audio/mpeg", "video/mp4", "application/pdf", "application/zip", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/x-bzip-compressed-tar", "application/octet-stream")
# The kinds of these types, by hand.
_KINDS = ("document,text", "text", "image", "audio", "video", "document", "archive", "document,spreadsheet", "document,presentation", "archive", "")

MIME = f"[{', '.join(repr(m) for m in MIME_TYPES)}][CAST(doc_id % {len(MIME_TYPES)} + 1 AS INTEGER)]"
KINDS = f"[{', '.join(repr(k) for k in _KINDS)}][CAST(doc_id % {len(MIME_TYPES)} + 1 AS INTEGER)]"


def docs(select: str) -> str:
    return f"WITH {_DOCS} {select}"


def tok(select: str) -> str:
    return f"WITH {_DOCS}, {_TOK} {select}"


def phrase(words: list[str], more: str = "true") -> str:
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.field = 'content' AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return tok(f"SELECT DISTINCT t0.doc_id FROM tok t0 {joins} WHERE t0.field = 'content' AND t0.term = '{words[0]}' AND t0.{more if more != 'true' else 'doc_id IS NOT NULL'}")
