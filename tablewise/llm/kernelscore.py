"""A quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a document (lengths, shares of kinds of characters, repetition) are
standardised and mapped by random cosine features, whose products approximate a
Gaussian kernel. Each partition sums its part of the normal equations; the sums
meet in a bounded number of groups, and the driver solves the ridge system (its
size is that of the features, whatever the data). Labelled rows set apart by a
hash calibrate the scores: counts by score bin, pooled until they never fall.

Null texts are empty; empty texts get a score as any other. Labelled ids that
repeat with both labels count by the larger share, ties as label 1; null ids have
no label. Without labels every score is ``prior``; with one class only, that
class's share. Statistics never depend on other rows, so repeated rows get equal
scores. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, sliced

FEATURES = 256
WIDTH = 2.5
RIDGE = 1e-3
BINS = 512
#: Groups in which the partitions' sums meet.
_SLOTS = 8
#: Raw scores below and above these share the outer bins.
_LOW, _HIGH = -0.5, 1.5

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGIT = b"0123456789"
_SIGNS = b"#*$%&|<>!=_~^@{}[]\\/+"
_STOPS = b".,;:?"
_SPACE = b" \t\n\r\x0b\x0c"
STATS = (
    "log_words", "log_chars", "word_length", "upper", "digit", "sign", "stop", "foreign", "distinct", "twins",
    "line_repeat", "log_line", "entropy", "shouted", "white", "long_words",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of STATS, each from the whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    body = max(1, size - sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r")))
    share = lambda chars: (size - len(raw.translate(None, chars))) / body
    per = lambda x: x / n if n else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    foreign = len(raw.decode().encode("ascii", "ignore")) if not raw.isascii() else size
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=1)
    rates = counts[counts > 0] / max(1, size)
    return [
        np.log1p(n), np.log1p(size), per(body), share(_UPPER), share(_DIGIT), share(_SIGNS), share(_STOPS),
        (size - foreign) / body, per(len(set(words))), per(sum(map(bytes.__eq__, words, words[1:]))),
        1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(size / max(1, len(lines))),
        -float((rates * np.log2(rates)).sum()), per(sum(map(bytes.isupper, words))), 1 - body / max(1, size), per(sum(len(w) > 20 for w in words)),
    ]


def describe(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, stats) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in sliced(batches):
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["id", "stats"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return picked.mapInArrow(run, "id long, stats array<float>")


class Model:
    """Standardisation, random features, weights, and the calibration's steps."""

    def __init__(self, mean, scale, features: int = FEATURES, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean, float), np.asarray(scale, float)
        self.turn = rng.normal(0, 1 / width, (len(self.mean), features))
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats):
        return self.features(stats) @ self.weights

    def score(self, stats):
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0.0, 1.0)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS)).astype(float)


def _normal_sums(train: DataFrame, shared, features: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the number of rows, summed by partition, then by slot."""
    size = features + 1

    def add(batches, own):
        zz, zy, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            more = own(b)
            if more is not None:
                zz, zy, n = zz + more[0], zy + more[1], n + more[2]
        return zz, zy, n

    def pack(slot, sums):
        zz, zy, n = sums
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["slot", "zz", "zy", "n"])

    def rows(b):
        if not b.num_rows:
            return None
        z, y = shared.value.features(_matrix(b.column(0))), b.column(1).to_numpy().astype(float)
        return z.T @ z, z.T @ y, len(y)

    def by_partition(batches):
        sums = add(batches, rows)
        if sums[2]:
            yield pack(TaskContext.get().partitionId() % _SLOTS, sums)

    def read(b, i):
        zz = np.frombuffer(b.column("zz")[i].as_py()).reshape(size, size)
        return zz, np.frombuffer(b.column("zy")[i].as_py()), b.column("n")[i].as_py()

    def by_slot(batches):
        def own(b):
            parts = [read(b, i) for i in range(b.num_rows)]
            return tuple(sum(x) for x in zip(*parts)) if parts else None

        sums = add(batches, own)
        if sums[2]:
            yield pack(0, sums)

    schema = "slot int, zz binary, zy binary, n long"
    parts = train.select("stats", "label").mapInArrow(by_partition, schema)
    zz, zy, n = np.zeros((size, size)), np.zeros(size), 0
    for r in parts.repartition(_SLOTS, "slot").mapInArrow(by_slot, schema).collect():  # at most _SLOTS rows
        zz, zy, n = zz + np.frombuffer(r.zz).reshape(size, size), zy + np.frombuffer(r.zy), n + r.n
    return zz, zy, n


def pool(x, total, good):
    """Pooled means that never fall (isotonic regression of bins in order)."""
    blocks: list[list[float]] = []
    for at, n, g in zip(x, total, good):
        blocks.append([at * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([a / n for a, n, _ in blocks]), np.array([g / n for _, n, g in blocks])


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", features: int = FEATURES, prior: float = 0.5) -> Model:
    """A model of ``stats`` (id, stats) and the 0/1 labels of ``labels``; all
    labelled rows count. A fifth of them, by hash, calibrates."""
    spark = stats.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("label"))
    train = materialise(stats.join(known, "id").select("id", "stats", "label", (F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 0).alias("apart")), "quality-train")
    moments = train.agg(
        F.count("*").alias("n"), F.avg("label").alias("share"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(STATS))],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(STATS))],
    ).first()
    if not moments.n:
        model = Model(np.zeros(len(STATS)), np.ones(len(STATS)), features)
        model.value = np.array([prior])
        return model
    model = Model([moments[f"m{i}"] for i in range(len(STATS))], [moments[f"s{i}"] or 1.0 for i in range(len(STATS))], features)
    if moments.share in (0.0, 1.0):
        model.value = np.array([moments.share])
        return model
    zz, zy, n = _normal_sums(train.filter("not apart"), spark.sparkContext.broadcast(model), features)
    if n:
        model.weights = np.linalg.solve(zz + RIDGE * n * np.eye(features + 1), zy)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        for b in batches:
            raw = shared.value.raw(_matrix(b.column(0)))
            at = np.clip(((raw - _LOW) / (_HIGH - _LOW) * BINS).astype(int), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw, pa.float64()), b.column(1)], names=["bin", "raw", "label"])

    held = train.filter("apart").select("stats", "label").mapInArrow(scored, "bin int, raw double, label int")
    bins = sorted(held.groupBy("bin").agg(F.avg("raw").alias("x"), F.count("*").alias("n"), F.sum("label").alias("good")).collect())
    if bins:
        model.at, model.value = pool([r.x for r in bins], [r.n for r in bins], [r.good for r in bins])
    else:  # too few rows to set any apart
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_matrix(b.column(1))), pa.float64())], names=["id", "score"])

    return stats.select("id", "stats").mapInArrow(run, "id long, score double")


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: statistics and score in one pass over the rows."""
    from pyspark.sql import types as T

    from .common import without

    ship(docs.sparkSession)
    docs = without(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in sliced(batches):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], float).reshape(b.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x), pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
