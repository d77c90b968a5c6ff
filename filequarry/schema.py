"""Declared schemas of the engine's tables, and constraints that writers check."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _B, _TS = T.LongType(), T.StringType(), T.BinaryType(), T.TimestampNTZType()


def _columns(*entries: tuple) -> list[T.StructField]:
    return [T.StructField(name, kind, null) for name, kind, null in entries]


FILE_COLUMNS = _columns(
    ("pool", _S, False), ("path", _S, False), ("fname", _S, False), ("suffix", _S, False), ("sort_date", _TS, False), ("fdate", _TS, False), ("fsize", _L, False),
    ("clength", _L, False), ("ctype", _S, False), ("md_keys", T.ArrayType(_S), True), ("meta_data", _S, True), ("sha256", _B, True),
)
ID = _columns(("id", _L, False))

TABLES: dict[str, T.StructType] = {
    "filemeta": T.StructType(ID + FILE_COLUMNS),
    "dbdoc": T.StructType(ID + FILE_COLUMNS + _columns(("inhalt", _S, False), ("lexemes", T.ArrayType(_S), True))),
    "pictures": T.StructType(ID + FILE_COLUMNS + _columns(("xmp", T.MapType(_S, _S), True), ("truncated", T.BooleanType(), True), ("thumbarray", _B, True), ("phash", _B, True))),
    "dino_v2_vectors": T.StructType(_columns(("pic_id", _L, False), ("vector", T.ArrayType(T.FloatType()), False))),
    "doc_vectors": T.StructType(_columns(("chunk_id", _L, False), ("doc_id", _L, False), ("content", _S, True), ("vector", T.ArrayType(T.FloatType()), False))),
    "photos": T.StructType(_columns(("id", _L, False), ("image", _B, False))),
}
KEYS = {"filemeta": "id", "dbdoc": "id", "pictures": "id", "dino_v2_vectors": "pic_id", "doc_vectors": "chunk_id", "photos": "id"}
UNIQUE = {"filemeta": ["path"], "dbdoc": ["path"], "pictures": ["path"]}
REFERENCES = {"dino_v2_vectors": ("pic_id", "pictures", "id"), "doc_vectors": ("doc_id", "dbdoc", "id")}
VECTOR_SIZE = {"dino_v2_vectors": 1024}
PARTITIONED = {"filemeta": ["pool"], "dbdoc": ["pool"], "pictures": ["pool"]}
# The columns that a table's generated column, lexemes, is worked out from.
GENERATED = {"dbdoc": ("fname", "inhalt")}
