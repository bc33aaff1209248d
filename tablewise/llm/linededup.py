"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Every row of the table is one document. All distinct keys of at least
``min_chars`` code points are indexed: 128-bit hashes split over shards, each shard a
minimal perfect hash whose slots point into a fingerprint array (the other 64 bits), a
count array (documents that hold the key) and an array with the largest id that holds
it. Documents probe these arrays; no line is joined. A probe hits if slot and
fingerprint agree, which a foreign line does with a chance of about 2**-64 for each
probe, and its line goes if the count is ``min_docs`` or more.

A shard holds about ``SHARD_KEYS`` keys (24 bytes each and the hash's bits). Shards
are built by executors, one task each, and are probed there: documents send narrow rows
of (id, hash of the text, line hashes) to the shards, and the hits meet the documents in
one join. The counts tell how many probes a shard gets before any is sent, so that a
shard with more than ``PROBES`` is copied and its probes are dealt out over the copies,
however hot its lines are. There is one way for all sizes, and neither the driver nor
a broadcast holds any part of the index.

Null or empty texts are one empty line, and a null text stays null. A row with a
null id never is the keeper while another row has an id; if none has, no row
keeps the line. Rows that repeat the largest id all keep it; rows of equal id and text
share their hits. Empty tables give empty results; columns named ``n_lines`` and
``n_dropped`` are replaced.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship, signed, sliced, without

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of one shard, roughly.
SHARD_KEYS = 1 << 17
#: Probes that one copy of a shard gets, roughly: 32 MB.
PROBES = 1 << 20
_NO_ID = -(1 << 63)
#: Distinct keys that a task holds before it hands on its counts.
_HELD = 200_000


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\r\x0b\x0c").lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _hashes(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class PerfectHash:
    """Levels of bit arrays: a key owns its bit on the first level where no other
    remaining key shares it; its slot is the rank of that bit."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0):
        self.levels, left, base = [], np.unique(keys.astype(np.uint64)), 0
        while len(left):
            size = -(-max(64, int(len(left) * spread)) // 64) * 64
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = np.cumsum(alone, dtype=np.int64) - alone + base
            self.levels.append((size, np.packbits(alone).reshape(-1, 8), ranks[::64].copy()))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.size = base

    @staticmethod
    def _place(keys, level, size):
        with np.errstate(over="ignore"):
            x = keys ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that hit no level."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(keys[open_], level, size)
            hit = (bits[at >> 6, (at >> 3) & 7] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            pos = at[hit]
            before = (np.unpackbits(bits[pos >> 6], axis=1) * (np.arange(64) < (pos & 63)[:, None])).sum(1)
            out[open_[hit]] = ranks[pos >> 6] + before
            open_ = open_[~hit]
        return out


class Shard:
    """One shard's perfect hash with its fingerprint, count and keeper arrays."""

    def __init__(self, h1, h2, count, keeper):
        self.hash = PerfectHash(h1)
        if self.hash.size != len(h1):
            raise ValueError("two keys share 64 bits within a shard")
        slot = self.hash.slots(h1)
        self.prints, self.counts, self.keepers = (np.empty(len(h1), t) for t in (np.uint64, np.uint32, np.int64))
        self.prints[slot], self.counts[slot], self.keepers[slot] = h2, np.minimum(count, (1 << 32) - 1), keeper

    def probe(self, h1, h2):
        """(count, keeper) of each key, 0 where it isn't indexed."""
        slot = self.hash.slots(h1)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == h2[found]
        count, keeper = np.zeros(len(h1), np.int64), np.full(len(h1), _NO_ID, np.int64)
        count[found], keeper[found] = self.counts[slot[found]], self.keepers[slot[found]]
        return count, keeper

    def dump(self) -> bytes:
        out, levels = io.BytesIO(), self.hash.levels
        arrays = {f"{kind}{i}": level[at] for i, level in enumerate(levels) for kind, at in (("bits", 1), ("ranks", 2))}
        np.savez(out, prints=self.prints, counts=self.counts, keepers=self.keepers, sizes=np.array([x[0] for x in levels], np.int64), **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        held = np.load(io.BytesIO(raw), allow_pickle=False)
        own, own.hash = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        own.hash.levels = [(int(n), held[f"bits{i}"], held[f"ranks{i}"]) for i, n in enumerate(held["sizes"])]
        own.prints, own.counts, own.keepers = held["prints"], held["counts"], held["keepers"]
        own.hash.size = len(own.prints)
        return own


def count_keys(docs: DataFrame, min_chars: int, text_col: str, id_col: str) -> DataFrame:
    """(h1, h2, n, keeper): the documents that hold a key, and their largest id."""
    ship(docs.sparkSession)

    def flush(held):
        pairs = [struct.unpack(">QQ", k) for k in held]
        cols = [[signed(p[0]) for p in pairs], [signed(p[1]) for p in pairs], [v[0] for v in held.values()], [v[1] for v in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h1", "h2", "n", "keeper"])

    def run(batches):
        held: dict[bytes, list[int]] = {}
        for b in sliced(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = _NO_ID if doc is None else doc
                lines = map(line_key, (text or "").encode().split(b"\n"))
                for k in {_hashes(x) for x in lines if _long_enough(x, min_chars)}:
                    if k in held:
                        got = held[k]
                        got[0] += 1
                        got[1] = max(got[1], doc)
                    else:
                        held[k] = [1, doc]
                if len(held) >= _HELD:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    counted = picked.mapInArrow(run, "h1 long, h2 long, n long, keeper long")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def _shards(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, probes, index): each shard built by one task. A key's shard is its
    first hash modulo their number."""

    def build(table: pa.Table) -> pa.Table:
        cols = table.combine_chunks()
        h1, h2 = (np.asarray(cols.column(c)).view(np.uint64) for c in ("h1", "h2"))
        n, keeper = np.asarray(cols.column("n")), np.asarray(cols.column("keeper"))
        index = Shard(h1, h2, n, keeper).dump()
        made = [pa.array([cols.column("shard")[0].as_py()], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([index], pa.binary())]
        return pa.Table.from_arrays(made, names=["shard", "probes", "index"])

    dealt = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, probes long, index binary")


def _split(texts: list[str | None], min_chars: int):
    """The lines of each text, and the hashes of the long enough ones with their
    (text, line) places."""
    split = [t.encode().split(b"\n") if t else [] for t in texts]
    where, digests = [], []
    for i, lines in enumerate(split):
        for j, line in enumerate(lines):
            if len(line) >= min_chars and _long_enough(k := line_key(line), min_chars):
                where.append((i, j))
                digests.append(_hashes(k))
    return split, where, digests


def _probes(docs: DataFrame, own_id, own_text, text_col: str, min_chars: int, shards: int, copies: dict[int, int]) -> DataFrame:
    """(id, own, h1, h2, shard, copy) of each document's different keys."""

    def run(batches):
        for b in sliced(batches):
            _, where, digests = _split(b.column(2).to_pylist(), min_chars)
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            different = list(dict.fromkeys((*rows[i], d) for (i, _), d in zip(where, digests)))  # repeated rows ask once
            pairs = np.frombuffer(b"".join(x[2] for x in different), ">u8").astype(np.uint64).reshape(-1, 2)
            ids, texts = (pa.array([x[c] for x in different], pa.int64()) for c in (0, 1))
            # as Spark's pmod of the signed hash
            shard = np.mod(pairs[:, 0].view(np.int64), shards)
            spread = np.ones(len(shard), np.int64)
            for hot in np.intersect1d(shard, list(copies)):
                spread[shard == hot] = copies[int(hot)]
            mixed = (np.asarray(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.asarray(texts).view(np.uint64)
            copy = (mixed >> np.uint64(17)) % spread.astype(np.uint64)
            cols = [ids, texts, *(pa.array(pairs[:, x].view(np.int64)) for x in (0, 1)), pa.array(shard.astype(np.int32)), pa.array(copy.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "own", "h1", "h2", "shard", "copy"])

    rows = docs.select(own_id.alias("id"), own_text.alias("own"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, "id long, own long, h1 long, h2 long, shard int, copy int")


def _probed(probes: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """(id, own, h1, h2) of the lines that go."""
    names = ["id", "own", "h1", "h2"]

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        asked = asked.select(names).combine_chunks()
        if not asked.num_rows or not shard.num_rows:
            return asked.slice(0, 0)
        ids, h1, h2 = (np.asarray(asked.column(c)) for c in ("id", "h1", "h2"))
        count, keeper = Shard.load(shard.column("index")[0].as_py()).probe(h1.view(np.uint64), h2.view(np.uint64))
        return asked.filter(pa.array((count >= min_docs) & ((keeper == _NO_ID) | (keeper != ids))))

    return probes.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInArrow(run, "id long, own long, h1 long, h2 long")


def _rewrite(docs: DataFrame, min_chars: int, text_col: str) -> DataFrame:
    """One pass over the documents and the hashes ``__tw_hits`` of their lines that
    go; ``__tw_gone`` counts these lines."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__tw_gone", T.LongType())])
    at_text, at_hits = docs.columns.index(text_col), docs.columns.index("__tw_hits")

    def run(batches):
        for b in sliced(batches):
            texts = b.column(at_text).to_pylist()
            gone = [0] * len(texts)
            for i, hits in enumerate(b.column(at_hits).to_pylist()):
                if not hits:
                    continue
                go = {struct.pack(">qq", h["h1"], h["h2"]) for h in hits}
                (lines,), where, digests = _split([texts[i]], min_chars)
                for (_, j), d in zip(where, digests):
                    if d in go:
                        lines[j] = None
                        gone[i] += 1
                texts[i] = b"\n".join(x for x in lines if x is not None).decode()
            arrays = list(b.columns)
            arrays[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text_col: str = "text", id_col: str = "doc_id",
    shard_keys: int = SHARD_KEYS, probes: int = PROBES,
) -> DataFrame:
    """``docs`` without the lines that enough documents hold, except in the
    document with the largest id, plus ``n_lines`` (before) and ``n_dropped``."""
    docs = without(docs, "n_lines", "n_dropped", "__tw_gone", "__tw_all", "__tw_hits", "__tw_id", "__tw_own")
    keys = materialise(count_keys(docs, min_chars, text_col, id_col), "line-keys")
    shards = max(1, -(-keys.count() // shard_keys))
    index = materialise(_shards(keys, shards), "line-shards")
    # shards that get more than one copy: at most one for each ``probes`` lines of all
    copies = {r.shard: -(-r.probes // probes) for r in index.filter(F.col("probes") > probes).select("shard", "probes").collect()}
    text = F.col(f"`{text_col}`")
    out = docs.withColumn(text_col, text.cast("string")).withColumn(id_col, F.col(f"`{id_col}`").cast("long"))
    own_id, own_text = F.coalesce(F.col(f"`{id_col}`"), F.lit(_NO_ID)), F.xxhash64(text)
    n_copies = F.ceil(F.col("probes") / probes).cast("int")
    index = index.select("shard", F.explode(F.sequence(F.lit(0), n_copies - 1)).alias("copy"), "index")
    found = _probed(_probes(out, own_id, own_text, text_col, min_chars, shards, copies), index, min_docs)
    hits = found.groupBy(F.col("id").alias("__tw_id"), F.col("own").alias("__tw_own")).agg(F.collect_set(F.struct("h1", "h2")).alias("__tw_hits"))
    met = out.join(hits.hint("shuffle_hash"), (own_id == F.col("__tw_id")) & (own_text == F.col("__tw_own")), "left").drop("__tw_id", "__tw_own")
    all_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    met = met.withColumn("__tw_all", F.coalesce(all_lines, F.lit(1)).cast("long"))
    out = _rewrite(met, min_chars, text_col).drop("__tw_hits")
    return out.withColumnsRenamed({"__tw_all": "n_lines", "__tw_gone": "n_dropped"})
