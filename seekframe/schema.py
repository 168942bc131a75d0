"""Table layouts of a search index. One row a posting; fields and origins are columns, not key prefixes."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

FILES = T.StructType().add("doc_id", "long", False).add("parent_id", "long").add("name", "string")
POSTINGS = T.StructType().add("field", "string", False).add("term", "string", False).add("doc_id", "long", False).add("origin", "string").add("positions", T.ArrayType(T.IntegerType()))
TIMES = T.StructType().add("doc_id", "long", False).add("mtime", "long").add("ctime", "long")
DATA = T.StructType().add("doc_id", "long", False).add("data", "string")
STATE = T.StructType().add("doc_id", "long", False)
EVENTS = T.StructType().add("path", "string").add("ts", "timestamp_ntz").add("kind", "string").add("cookie", "long").add("is_dir", "boolean")

TABLES = {"postings": POSTINGS, "files": FILES, "times": TIMES, "data": DATA, "queue": STATE, "failed": STATE}

# Names of fields and the length of the key prefix each stands for, which two length rules count.
PREFIX_BYTES = {"content": 0, "filename": 1, "mimetype": 1, "rating": 1, "tag": 4, "tags": 2, "usercomment": 1, "type": 1}
PROPERTY_PREFIX_BYTES = 4

# Types of the fields that do not come from a registry.
FIELD_TYPES = {"content": "string", "filename": "string", "mimetype": "string", "rating": "int", "tag": "string", "tags": "string", "usercomment": "string"}

# First position of each source of text.
FIRST_POSITION = {"filename": 1, "xattr": 1, "metadata": 1000, "text": 10000}
