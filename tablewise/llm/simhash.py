"""SimHash near-duplicates by a binary-trie self-join.

A text's words (ASCII white space separates, A-Z lower-cased) make shingles,
each hashed by XXH64; a fingerprint bit is set if more than half of the hashes
set it. Equal fingerprints fold into one class first. Two classes within
``max_bits`` differing bits agree on at least one of ``max_bits + 1`` bit
blocks, so classes are dealt out by (block, value); within such a group a
binary trie (a sorted array, nodes are ranges) joins itself: pairs of nodes go
down together, differing bits add up, and a pair whose sum is over the budget is
pruned. A group returns a spanning forest of its links, never all pairs; pairs
of nodes whose leaves are already connected are pruned too. Groups with over
``max_group`` classes are dealt again by a further block of the other bits, and so
on until none is left. The forests meet in alternating star rounds, each cut by a
checkpoint.

Texts may be of any length: hashes are counted in steps. Nulls: a null text has no
words and so fingerprint zero, as has an empty one.
Rows with a null id get a fingerprint and take part in linking; a component's id
is its smallest non-null id. ``cluster`` returns repeated rows as often as they
come. Extra columns are kept by ``dedup`` and not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, signed, sliced

SEED = 42
BITS = 64
#: Node pairs that are expanded at once.
FRONTIER = 250_000
#: Leaves that one traversal handles at once, whole groups together.
CHUNK = 100_000
_STEP = 1 << 15


def shingles(text: str | None, size: int) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str | None, size: int = 3) -> int:
    grams = shingles(text, size)
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].astype("<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(grams), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint as a signed long) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in sliced(batches):
            out = [signed(fingerprint(t, size)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return picked.mapInArrow(run, "id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _settle(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of each a[i] and b[i]; label[i] is the smallest index."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        label = _settle(label)


def trie_forest(group: np.ndarray, codes: np.ndarray, max_bits: int) -> np.ndarray:
    """For distinct unsigned codes, sorted by (group, code): for each leaf, the
    index of its component's first leaf within the group."""
    n = len(codes)
    label = np.arange(n)
    if n < 2:
        return label
    near = np.flatnonzero((group[1:] == group[:-1]) & (_popcount(codes[1:] ^ codes[:-1]) <= max_bits))
    label = _union(label, near, near + 1)
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
    ones = {}

    def prefix(bit):
        if bit not in ones:
            if len(ones) > 8:
                ones.clear()
            ones[bit] = np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        return ones[bit]

    lo, hi = edges[:-1], edges[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    # a frontier of node pairs: ranges a and b, differing bits so far
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    while stack:
        bit, alo, ahi, blo, bhi, d = stack.pop()
        if len(alo) > FRONTIER:
            for at in range(0, len(alo), FRONTIER // 2):
                cut = slice(at, at + FRONTIER // 2)
                stack.append((bit, alo[cut], ahi[cut], blo[cut], bhi[cut], d[cut]))
            continue
        # leaves on both sides: their whole distance at once
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            close = _popcount(codes[a] ^ codes[b]) <= max_bits
            before = label
            label = _union(label, a[close], b[close])
            if label is not before:
                changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        # pairs that can't add a link: one component already
        same = (label[alo] == label[blo]) & (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo])
        go = ~leaf & ~same
        if bit < 0 or not go.any():
            continue
        alo, ahi, blo, bhi, d = alo[go], ahi[go], blo[go], bhi[go], d[go]
        p = prefix(bit)
        amid, bmid = ahi - (p[ahi] - p[alo]), bhi - (p[bhi] - p[blo])
        own = (alo == blo) & (ahi == bhi)
        other = ~own
        parts = [
            (alo, amid, blo, bmid, d),
            (amid, ahi, bmid, bhi, d),
            (alo, amid, bmid, bhi, d + 1),
            (amid[other], ahi[other], blo[other], bmid[other], d[other] + 1),
        ]
        alo, ahi, blo, bhi, d = (np.concatenate(x) for x in zip(*parts))
        keep = (ahi > alo) & (bhi > blo) & (d <= max_bits) & ~((alo == blo) & (ahi == bhi) & (ahi - alo == 1))
        if keep.any():
            stack.append((bit - 1, alo[keep], ahi[keep], blo[keep], bhi[keep], d[keep]))
    return label


def _blocks(count: int, bits: list[int]) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), count)]


def _value(code, bits: list[int]):
    """The bits (a run or not) of a long column, side by side."""
    out, at, i = F.lit(0).cast("long"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        run = F.shiftrightunsigned(code, bits[i]).bitwiseAND(F.lit((1 << (j - i + 1)) - 1).cast("long"))
        out, at, i = out.bitwiseOR(F.shiftleft(run, at)), at + j - i + 1, j + 1
    return out


def links(classes: DataFrame, max_bits: int = 3, max_group: int = 1_000_000) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp``: a spanning forest of
    each block's group, which together connect all pairs within ``max_bits``."""
    spark = classes.sparkSession
    key = F.xxhash64("key", "block", "value")

    def deal(rows, bits):
        """``rows`` (fp, key, path) with a key for each block of ``bits``."""
        cut = _blocks(max_bits + 1, bits)
        picks = F.array(*[F.struct(F.lit(i).alias("block"), _value(F.col("fp"), b).alias("value")) for i, b in enumerate(cut)])
        return rows.select("fp", "key", "path", F.inline(picks)).select("fp", key.alias("key"), F.concat("path", F.col("block").cast("string"), F.lit(".")).alias("path"))

    def left_over(path):
        """The bits that the blocks on a path haven't fixed."""
        bits = list(range(BITS))
        for i in filter(None, path.split(".")):
            fixed = _blocks(max_bits + 1, bits)[int(i)]
            bits = [b for b in bits if b not in fixed]
        return bits

    start = F.lit(0).cast("long")
    dealt, ready = deal(classes.select("fp", start.alias("key"), F.lit("").alias("path")), list(range(BITS))), []
    while True:
        hot = dealt.groupBy("key", "path").agg(F.count("*").alias("n")).filter(F.col("n") > max_group).select("key", "path")
        hot = materialise(hot, "simhash-hot")
        # paths are few: the blocks' numbers, one more with each round. A path that
        # has fixed all bits can't be dealt again, and holds one code
        paths = [p for p in (r.path for r in hot.select("path").distinct().collect()) if len(left_over(p)) > max_bits]
        if not paths:
            ready.append(dealt)
            break
        hot = hot.filter(F.col("path").isin(paths))
        ready.append(dealt.join(hot, ["key", "path"], "left_anti"))
        # a pair in such a group also agrees on a block of the other bits
        again = materialise(dealt.join(hot, ["key", "path"], "left_semi").select("fp", "key", "path"), "simhash-again")
        dealt = reduce(DataFrame.unionAll, [deal(again.filter(F.col("path") == p), left_over(p)) for p in paths])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = reduce(DataFrame.unionAll, [d.select("fp", "key") for d in ready]).repartition(n, "key").sortWithinPartitions("key", "fp")

    def forest(keys, codes):
        order = np.lexsort((codes.view(np.uint64), keys))
        keys, codes = keys[order], codes[order]
        label = trie_forest(keys, codes.view(np.uint64), max_bits)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(codes[linked]), pa.array(codes[label[linked]])], names=["a", "b"])

    def run(batches):
        held_k, held_c, size = [], [], 0
        for b in batches:
            k, c = b.column(1).to_numpy(), b.column(0).to_numpy()
            held_k.append(k)
            held_c.append(c)
            size += len(k)
            if size >= CHUNK:
                k, c = np.concatenate(held_k), np.concatenate(held_c)
                cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
                if cut:
                    yield forest(k[:cut], c[:cut])
                held_k, held_c, size = [k[cut:]], [c[cut:]], len(k) - cut
        if size:
            yield forest(np.concatenate(held_k), np.concatenate(held_c))

    return grouped.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, by alternating star rounds:
    each round links a node's neighbours to its smallest one. Every round is
    checkpointed; nothing but two sums reaches the driver."""

    def star(e, small):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not small:
            both = both.union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if small:  # a > b holds: all neighbours are smaller ones
            joined = both.join(least, "u")
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        else:
            out = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    def digest(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = digest(now)
    while seen[0]:
        now = star(star(now, False), True).checkpoint()
        last, seen = seen, digest(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _clustered(docs: DataFrame, size: int, max_bits: int, text_col: str, id_col: str, max_group: int = 1_000_000) -> DataFrame:
    """(id, fp, component_id, root) of every row; ``root`` tells components apart
    that repeated ids give the same component_id."""
    prints = materialise(fingerprints(docs, size, text_col, id_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(classes.select("fp"), max_bits, max_group))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    per_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(per_root, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("id", "fp", "component_id", "root")


def cluster(docs: DataFrame, size: int = 3, max_bits: int = 3, text_col: str = "text", id_col: str = "doc_id", max_group: int = 1_000_000) -> DataFrame:
    """(id, fp, component_id) of every row of ``docs``."""
    return _clustered(docs, size, max_bits, text_col, id_col, max_group).drop("root")


def dedup(docs: DataFrame, size: int = 3, max_bits: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component stays: that with the smallest id; of rows that
    repeat this id, one with the smallest fingerprint, then the smallest hash of its
    text. Rows with a null id can't be named and all stay."""
    own = _clustered(docs, size, max_bits, text_col, id_col)
    named = own.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("__tw_keep")).agg(F.count("*").alias("n"), F.min("component_id").alias("least"))
    keep = materialise(named.filter((F.col("n") > 1) | (F.col("least") == F.col("__tw_keep"))), "simhash-kept")

    def held(ids):  # texts are shuffled once and never sorted; only ids are hashed
        return docs.join(ids.hint("shuffle_hash"), docs[id_col] == F.col("__tw_keep"), "left_semi")

    kept = held(keep.filter("n = 1"))
    if not keep.filter("n > 1").isEmpty():
        # a repeated id doesn't name a row, so its texts are told by their hashes
        rows = held(keep.filter("n > 1")).withColumn("__tw_hash", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
        prints = fingerprints(rows, size, text_col, "__tw_hash").groupBy(F.col("id").alias("__tw_hash")).agg(F.min("fp").alias("fp"))
        pairs = own.filter(F.col("id") == F.col("component_id")).join(keep.filter("n > 1"), F.col("id") == F.col("__tw_keep"), "left_semi")
        pairs = pairs.groupBy("id", "root").agg(F.min("fp").alias("fp")).select("id", "fp")
        chosen = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), "__tw_hash").join(prints, "__tw_hash").join(pairs, ["id", "fp"])
        chosen = materialise(chosen.groupBy("id", "fp").agg(F.min("__tw_hash").alias("__tw_least")).select(F.col("id").alias("__tw_keep"), "__tw_least"), "simhash-chosen")
        one = rows.join(chosen, (rows[id_col] == F.col("__tw_keep")) & (rows["__tw_hash"] == F.col("__tw_least")), "left_semi")
        kept = kept.unionByName(one.dropDuplicates([id_col, "__tw_hash"]).drop("__tw_hash"))
    return kept.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
