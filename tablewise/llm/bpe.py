"""Byte-level BPE with the tiktoken library and a local rank file.

Texts are cut at safe boundaries before they are encoded, if the pattern treats
white space as the byte-level patterns do (it ends in ``WHITE_RULE``):

- long texts in front of a single space between two characters that aren't white
  space, where one match ends and another starts whatever stands around;
- around long runs of white space, which the library's matcher can't take (its
  stack overflows). Such a run is one match to the end of the text, or else one
  match but for its last character, which starts what follows. The match goes to
  the library's BPE by itself.

Any other match stays whole, whatever its length. With another pattern texts
aren't cut at all. Decoding joins raw bytes.

Null texts are empty: no ids, and an empty byte string. Every row is coded on
its own, so repeated rows, empty tables and extra columns need no rule;
``encode`` replaces a column of the name ``ids``.
"""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, sliced, without

#: Texts are cut into pieces of at least so many characters.
PIECE_CHARS = 20_000
#: Longer runs of white space never reach the library's matcher.
RUN_CHARS = 1_000
#: How patterns must end, and Unicode's White_Space.
WHITE_RULE = r"|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_RUN = re.compile(f"[{WHITE}]{{{RUN_CHARS},}}")
_CODERS: dict[tuple, tiktoken.Encoding] = {}


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, raw.splitlines()))}


def coder(path: str, pattern: str) -> tiktoken.Encoding:
    """One coder for each rank file and worker."""
    key = (path, os.path.getmtime(path), pattern)
    if key not in _CODERS:
        with open(path, "rb") as f:
            ranks = ranks_of(f.read())
        _CODERS[key] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[key]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe boundaries, each piece ``size`` characters at least
    where there are boundaries."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def _plain(own: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text without long runs of white space."""
    if len(text) <= PIECE_CHARS:
        return own.encode_ordinary(text)
    return [i for p in pieces(text) for i in own.encode_ordinary(p)]


def encode_text(own: tiktoken.Encoding, text: str | None) -> list[int]:
    text = text or ""
    if not own._pat_str.endswith(WHITE_RULE):
        return own.encode_ordinary(text)
    if len(text) < RUN_CHARS:
        return own.encode_ordinary(text)
    out, start = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += _plain(own, text[start : run.start()])
        out += own._encode_single_piece(text[run.start() : end])
        start = end
    return out + _plain(own, text[start:]) if start else _plain(own, text)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, an array of ints. ``rank_file`` must be a local path
    on every executor."""
    ship(docs.sparkSession)
    docs = without(docs, "ids")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        own = coder(rank_file, pattern)
        for b in sliced(batches):
            ids = [encode_text(own, t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``raw``, the bytes that the ids stand for (null ids: null)."""
    ship(coded.sparkSession)
    coded = without(coded, "raw")
    at = coded.columns.index(ids_col)
    schema = T.StructType([*coded.schema.fields, T.StructField("raw", T.BinaryType())])

    def run(batches):
        own = coder(rank_file, pattern)
        for b in sliced(batches):
            raw = [None if i is None else own.decode_bytes(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=schema.names)

    return coded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids as text, raw bytes) of every row, coded and decoded in
    one pass so that the ids don't travel between workers."""
    ship(docs.sparkSession)
    names = [id_col, "n_tokens", "ids_text", "raw"]

    def run(batches):
        own = coder(rank_file, pattern)
        text_of = [str(i) for i in range(own.max_token_value + 1)]
        for b in sliced(batches):
            n, joined, raw = [], [], []
            for t in b.column(1).to_pylist():
                ids = encode_text(own, t)
                n.append(len(ids))
                joined.append(" ".join([text_of[i] for i in ids]))
                raw.append(own.decode_bytes(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(joined, pa.string()), pa.array(raw, pa.binary())], names=names)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("t"))
    return picked.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_text string, raw binary")
