"""Sum-of-squares online packing of documents into token windows.

A document's ids (with an end id) are cut into full windows and a rest. Full
windows are sequences of their own. Rests are placed online: into the fill level
that makes the sum of squared counts of partially filled windows smallest, a new
window being level 0; a level array holds the counts, so a placement costs one
pass over it. Each input partition packs its own rows in their order, so no
document is shuffled.

Windows still open at the end of a partition are not closed by cutting. Their
pieces go on, whole, to a second pass: rows of (piece, ids) that fewer tasks take,
one for about ``ROUND_TOKENS`` ids, and place by the same method. What is still open
then (a few hundred windows a task) stays as it was filled: a window that lacks
at most ``NEARLY`` of it is padded, another one is cut, by itself, into sequences whose
lengths are powers of two, which take no padding. A task holds at most
``max_open`` open windows; beyond that the fullest one goes on to the second pass (in
the second pass: is finished as at the end).

A null or empty text is a document of the end id alone. Rows with a null id are
packed like others. Repeated rows are packed each by itself. An empty table gives
no piece. Only the id and text columns are read, so other names don't clash.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import materialise, ship, sliced

WINDOW = 2048
#: Open windows of a task at most: 128 MB of ids.
MAX_OPEN = 16_384
#: Ids that a task of the second pass takes, about.
ROUND_TOKENS = 1 << 26
#: A window left open that lacks at most this part of it is padded.
NEARLY = 1 / 64
#: Words, and runs of letters, whose ids a worker remembers.
REMEMBERED = 800_000
#: Rows of one Arrow batch of pieces.
_ROWS = 500


class WordCoder:
    """Ids of whole texts by a tokenizer that drops white space, as bytes of
    little-endian unsigned 32-bit ids. Texts of plain Latin letters, ASCII signs and
    white space are cut by the tokenizer's own split pattern at once; the runs of
    letters that a batch brings anew go to its BPE model together, a sign that
    letters can't yield between them, and are remembered. Other texts are cut at
    white space first, and only their words that aren't plain go through the whole
    tokenizer, as do texts with the control signs that only Python takes for white
    space. All of this holds for files with the ``PARTS`` below; with any other file
    every text goes through the whole tokenizer."""

    #: The parts of a tokenizer file that the short cuts rest on.
    PARTS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }
    #: The split pattern of the tokenizer file, for lower-cased plain
    #: signs. Plain letters are those that Python lower-cases to one plain letter.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[!-/:-@\[-`{-~×÷]+"
    PLAIN = "[\t-\r -~À-įı-ž]*"
    #: Characters that are cut into runs at once.
    AT_ONCE = 2_000_000
    #: Runs of letters that one call codes.
    TOGETHER = 200
    #: Longer words and runs aren't remembered.
    LONG = 64

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        added = {t["content"] for t in own.get("added_tokens") or ()}
        self.known = all(own.get(k) == v for k, v in self.PARTS.items()) and all(a.startswith("<|") for a in added)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.between = self.bare.encode("!", add_special_tokens=False).ids[0]
        self.split = re.compile(self.SPLIT).findall
        self.plain = re.compile(self.PLAIN).fullmatch
        self.odd = re.compile("[\x1c-\x1f]").search
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.bytes_as = dict(enumerate(self._byte_signs()))

    @staticmethod
    def _byte_signs() -> list[str]:
        """The sign that stands for each byte in byte-level vocabularies: itself
        if it can be printed, else the next free code point from 256 on."""
        shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        out, free = [""] * 256, 256
        for b in range(256):
            if b in shown:
                out[b] = chr(b)
            else:
                out[b], free = chr(free), free + 1
        return out

    @staticmethod
    def _raw(ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _signs(self, part: str) -> str:
        return part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes_as)

    def _parts_of(self, text: str) -> list[str] | None:
        """A text's runs as the split pattern cuts them; None for odd texts."""
        return self.split(text.lower()) if self.plain(text) and "<|" not in text else None

    def _by_whole(self, text: str) -> bytes:
        return self._raw(self.whole.encode(text, add_special_tokens=False).ids)

    def _learn_parts(self, parts: list[str]) -> None:
        letters = [p for p in parts if p.isalpha()]
        groups = [letters[at : at + self.TOGETHER] for at in range(0, len(letters), self.TOGETHER)]
        texts = [" ! ".join(map(self._signs, g)) for g in groups]
        for group, got in zip(groups, self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.between)).tolist()
            for part, start, end in zip(group, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)]):
                self.parts[part] = raw[start:end]
        for part in parts:
            if not part.isalpha():
                self.parts[part] = self._raw(self.bare.encode(self._signs(part), add_special_tokens=False).ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; long ones are cut at spaces, where every run ends."""
        if not self.known:
            return [self._by_whole(t) for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def flush():
            for (i, _), raw in zip(held, self._encode([t for _, t in held])):
                out[i].append(raw)
            held.clear()

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = text.find(" ", at + self.AT_ONCE) if len(text) - at > self.AT_ONCE else -1
                end = end if end >= 0 else len(text)
                held.append((i, text[at:end]))
                size, at = size + end - at, end
                if size >= self.AT_ONCE:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def _encode(self, texts: list[str]) -> list[bytes]:
        for known in (self.words, self.parts):
            if len(known) > REMEMBERED:
                known.clear()
        cut = [self._parts_of(t) for t in texts]
        split = [None if ps is not None or self.odd(t) else t.split() for t, ps in zip(texts, cut)]
        new = {w: self._parts_of(w) for w in {w for ws in split if ws for w in ws}.difference(self.words)}
        some = {p for ps in (*cut, *new.values()) if ps for p in ps}.difference(self.parts)
        self._learn_parts(list(some))
        for w, ps in new.items():
            self.words[w] = self._by_whole(w) if ps is None else b"".join(map(self.parts.__getitem__, ps))
        out = []
        for t, ps, ws in zip(texts, cut, split):
            known, keys = (self.parts, ps) if ps is not None else (self.words, ws)
            out.append(self._by_whole(t) if keys is None else b"".join(map(known.__getitem__, keys)))
        for known, keys in ((self.parts, some), (self.words, new)):
            for k in keys:
                if len(k) > self.LONG:
                    del known[k]
        return out


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


class Packer:
    """Places pieces (document, start, raw ids, document's tokens) and returns
    closed sequences, lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.count = window, max_open, 0
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by fill

    def add(self, doc, raw: bytes) -> list[list[tuple]]:
        """Sequences that the document closes."""
        total, w, done, at = len(raw) // 4, self.window, [], 0
        while total - at >= w:
            done.append([(doc, at, raw[4 * at : 4 * (at + w)], total)])
            at += w
        return done + self.place((doc, at, raw[4 * at :], total)) if total > at else done

    def place(self, piece) -> list[list[tuple]]:
        """The sequence that a piece shorter than a window closes, if it does."""
        size, w = len(piece[2]) // 4, self.window
        # half the change of the sum of squares, for fill h = 1 .. w - size
        fill = self.levels[1 : w - size + 1]
        change = np.where(fill > 0, self.levels[1 + size : w + 1] - fill + 1, 1 << 60)
        if len(change):  # a window that gets full leaves the sum: half of one less
            change = change * 2
            if fill[-1] > 0:
                change[-1] -= 1
            best = int(np.argmin(change[::-1]))  # ties: the fullest
            best = len(change) - 1 - best
        if len(change) and fill[best] > 0 and change[best] <= 2 * self.levels[size] + 1:
            bin_ = self.open[best + 1].pop()
            self.levels[best + 1] -= 1
            h = best + 1
        else:
            bin_, h = [], 0
            self.count += 1
        bin_.append(piece)
        if h + size == w:
            self.count -= 1
            return [bin_]
        self.open[h + size].append(bin_)
        self.levels[h + size] += 1
        return []

    def spill(self, all_: bool = False) -> list[list[tuple]]:
        """Open windows that go, the fullest first: those over ``max_open``, or all."""
        out, h = [], self.window - 1
        while self.count > (0 if all_ else self.max_open):
            while not self.open[h]:
                h -= 1
            out.append(self.open[h].pop())
            self.levels[h] -= 1
            self.count -= 1
        return out


def finish(bin_: list[tuple], window: int) -> list[list[tuple]]:
    """The sequences of a window that stays open: itself, if it is nearly full, else
    its ids in lengths that are powers of two."""
    fill, out = sum(len(p[2]) // 4 for p in bin_), []
    if window - fill <= NEARLY * window:
        return [bin_]
    left = list(reversed(bin_))
    while fill:
        size = 1 << (fill.bit_length() - 1)
        part, got = [], 0
        while got < size:
            doc, start, raw, total = left.pop()
            take = min(size - got, len(raw) // 4)
            part.append((doc, start, raw[: 4 * take], total))
            got += take
            if len(raw) > 4 * take:
                left.append((doc, start + take, raw[4 * take :], total))
        out.append(part)
        fill -= size
    return out


_NAMES = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Rows:
    """Rows of pieces, handed on in batches; sequences are numbered by task."""

    def __init__(self, number: int):
        self.number, self.rows = number, []

    def note(self, sequences, closed: bool = True) -> None:
        for seq in sequences:
            at = 0
            for doc, start, raw, total in seq:
                self.rows.append((doc, start, len(raw) // 4, raw, total, self.number if closed else None, at if closed else None))
                at += len(raw) // 4
            self.number += closed

    def batches(self, least: int = _ROWS):
        while len(self.rows) >= max(least, 1):
            some, self.rows = self.rows[:_ROWS], self.rows[_ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _TYPES)], names=_NAMES)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", max_open: int = MAX_OPEN, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """One row for each piece: the document's id, ``start`` (its ids before the
    piece), ``length``, ``ids`` (little-endian unsigned 32-bit, binary),
    ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.
    ``tokenizer_file`` must be a local path on every executor."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def first(batches):
        own, packer, out = coder(tokenizer_file), Packer(window, max_open), _Rows(TaskContext.get().partitionId() << 32)
        for b in sliced(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, raw in zip(b.column(0).to_pylist(), own.encode_batch(texts)):
                out.note(packer.add(doc, raw + end))
                out.note(packer.spill(), closed=False)
                yield from out.batches()
        out.note(packer.spill(all_=True), closed=False)
        yield from out.batches(1)

    def second(batches):
        packer, out = Packer(window, max_open), _Rows((1 << 62) + (TaskContext.get().partitionId() << 32))
        for b in sliced(batches):
            for doc, start, raw, total in zip(*(b.column(i).to_pylist() for i in range(4))):
                out.note(packer.place((doc, start, raw, total)))
                for bin_ in packer.spill():
                    out.note(finish(bin_, window))
                yield from out.batches()
        for bin_ in packer.spill(all_=True):
            out.note(finish(bin_, window))
            yield from out.batches()
        yield from out.batches(1)

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    placed = materialise(picked.mapInArrow(first, _SCHEMA), "packed")
    left = placed.filter(F.col("sequence_id").isNull()).select("id", "start", "ids", "doc_tokens", "length")
    tasks = math.ceil((left.agg(F.sum("length")).first()[0] or 0) / round_tokens)
    out = placed.filter(F.col("sequence_id").isNotNull())
    if tasks:
        again = left.drop("length").coalesce(tasks).mapInArrow(second, _SCHEMA)
        out = out.unionAll(again)
    return out.withColumnRenamed("id", id_col)
