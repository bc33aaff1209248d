"""Quality rules: text statistics and learned decision lists, in Spark's own
functions.

``statistics`` counts words, signs, repeated lines and repeated 5-word windows of
every whole text. ``learn`` grows ordered rules on labelled statistics by
sequential covering: a rule is a conjunction of thresholds grown for the largest
gain on two thirds of the rows, then pruned on the other third, and the rows that
it covers leave before the next one is grown. ``verdict`` turns the list into one
conditional expression. Learning works on at most ``max_rows`` labelled rows,
picked by a hash of their id.

A null or empty text has no words. Counting looks at one row only, so ties,
repeated rows and empty tables need no rule; input columns that share a name with
a statistic are replaced. Without labelled rows of both kinds the list is empty
and keeps everything. Repeated labels of an id: the larger share counts, ties keep.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_twins")
MAX_ROWS = 20_000
_SPACES = " \t\n\x0b\f\r"
_WINDOW = 5


def statistics(docs: DataFrame, text_col: str = "text", window: int = _WINDOW) -> DataFrame:
    """``docs`` with the COUNTS, longs. Every step names its arrays once, so that
    none is computed again for each element."""
    docs = without(docs, *COUNTS, *[f"__tw_{x}" for x in ("text", "words", "hash", "grams", "sorted")])
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    step = docs.select(*own, text.alias("__tw_text"))
    t = F.col("__tw_text")
    trimmed = F.btrim(t, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    gone = lambda signs: F.char_length(t) - F.char_length(F.regexp_replace(t, signs, ""))
    step = step.select(
        *own,
        F.transform(words, lambda w: F.xxhash64(w)).alias("__tw_hash"),
        gone(r"[\x20\x09-\x0D]").alias("__tw_spaces"), F.char_length(t).alias("__tw_chars"),
        gone(r"[#*$%&|<>]").cast("long").alias("n_symbols"), gone("[!?]").cast("long").alias("n_marks"), gone("[A-Z]").cast("long").alias("n_upper"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    h, n = F.col("__tw_hash"), F.size("__tw_hash")
    counted = [F.col(c) for c in ("n_symbols", "n_marks", "n_upper", "n_dup_lines")]
    grams = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(window)]))
    twins = F.size(F.filter(h, lambda x, i: (i > 0) & (x == F.element_at(h, F.greatest(i, F.lit(1))))))
    step = step.select(
        *own, *counted, n.cast("long").alias("n_words"), (F.col("__tw_chars") - F.col("__tw_spaces")).cast("long").alias("word_chars"),
        F.when(n > 1, twins).otherwise(0).cast("long").alias("n_twins"),
        F.when(n >= window, grams).otherwise(F.array().cast("array<bigint>")).alias("__tw_grams"),
    )
    counted += [F.col(c) for c in ("n_words", "word_chars", "n_twins")]
    g = F.col("__tw_grams")
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.select(*own, *counted, F.when(repeats, placed).alias("__tw_sorted"))
    s = F.col("__tw_sorted")
    last = F.size(s)
    double = F.filter(
        s,
        lambda x, k: ((k > 0) & (F.element_at(s, F.greatest(k, F.lit(1)))["h"] == x["h"]))
        | ((k < last - 1) & (F.element_at(s, F.least(k + 2, last))["h"] == x["h"])),
    )
    step = step.select(*own, *counted, F.sort_array(F.transform(double, lambda x: x["i"])).alias("__tw_at"))
    # each window brings the words that the window before it doesn't cover
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        "__tw_at", start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(window), p - a["last"])).alias("total")), lambda a: a["total"]
    )
    done = step.select(*own, *counted, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return done.select(*own, *COUNTS)


def base_failed() -> Column:
    """The fixed base rules over the COUNTS."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _per(name: str, by: str = "n_words") -> Column:
    return F.when(F.col(by) > 0, F.col(name) / F.col(by)).otherwise(0.0)


def features() -> dict[str, Column]:
    """What rules put thresholds on."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _per("word_chars"),
        "symbols_a_word": _per("n_symbols"),
        "marks_a_word": _per("n_marks"),
        "upper_share": _per("n_upper", "word_chars"),
        "dup_lines_a_word": _per("n_dup_lines"),
        "repeated": _per("n_repeat_words"),
        "twins": _per("n_twins"),
    }


def _covers(rule, row) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)


def _grow(good, bad, cuts, most: int):
    """Add the condition with the largest gain until no kept row is covered."""
    rule, p, n = [], bad, good
    while n and len(rule) < most:
        base, best = math.log2(len(p) / (len(p) + len(n))), (1e-9, None)
        for f, at in cuts.items():
            ps, ns = sorted(r[f] for r in p), sorted(r[f] for r in n)
            i = j = 0
            for t in at:
                while i < len(ps) and ps[i] <= t:
                    i += 1
                while j < len(ns) and ns[j] <= t:
                    j += 1
                for op, pp, nn in (("<=", i, j), (">", len(ps) - i, len(ns) - j)):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + nn)) - base)
                        if gain > best[0]:
                            best = (gain, (f, op, t))
        if best[1] is None:
            break
        rule.append(best[1])
        p, n = [r for r in p if _covers(rule[-1:], r)], [r for r in n if _covers(rule[-1:], r)]
    return rule


def _prune(rule, good, bad):
    """The prefix of the rule with the best (p - n) / (p + n) on unseen rows."""

    def worth(part):
        p, n = sum(_covers(part, r) for r in bad), sum(_covers(part, r) for r in good)
        return ((p - n) / (p + n), p) if p + n else (-1.0, 0)

    scored = [(worth(rule[: i + 1]), -i, rule[: i + 1]) for i in range(len(rule))]
    return max(scored)[2], max(scored)[0][0]


def cover(rows: list[dict], cuts_each: int = 48, most_rules: int = 24, most_conditions: int = 4, least_worth: float = 0.5):
    """Ordered rules that reject: rows are dicts of features with ``keep`` (bool)
    and ``part`` (0 or 1 to grow, 2 to prune)."""
    names = [k for k in rows[0] if k not in ("keep", "part")] if rows else []
    cuts = {}
    for f in names:
        values = sorted({r[f] for r in rows})
        mids = [(a + b) / 2 for a, b in zip(values, values[1:])]
        step = max(1, len(mids) // cuts_each)
        cuts[f] = mids[::step]
    out, left = [], rows
    while len(out) < most_rules:
        seen, unseen = [r for r in left if r["part"] < 2], [r for r in left if r["part"] == 2]
        bad, good = [r for r in seen if not r["keep"]], [r for r in seen if r["keep"]]
        if not bad or not good:
            break
        rule = _grow(good, bad, cuts, most_conditions)
        if not rule:
            break
        rule, worth = _prune(rule, [r for r in unseen if r["keep"]], [r for r in unseen if not r["keep"]])
        if worth < least_worth:
            break
        out.append(rule)
        left = [r for r in left if not _covers(rule, r)]
    return out


def learn(counted: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = MAX_ROWS):
    """Rules from rows with COUNTS and their 0/1 labels (0: reject)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__tw_id")).agg((F.avg(label_col) >= 0.5).alias("keep"))
    rows = counted.select(F.col(id_col).alias("__tw_id"), *[c.alias(n) for n, c in features().items()]).join(known, "__tw_id")
    rows = rows.select("*", F.xxhash64("__tw_id", F.lit("rules")).alias("h"))
    count = known.count()
    if count > max_rows:  # only about as many as are wanted go to the driver, whatever the input
        rows = rows.filter(F.pmod("h", F.lit(1_000_003)) <= 1_200_000 * max_rows // count)
    rows = rows.orderBy("h", "__tw_id").limit(max_rows)
    rows = rows.select(*features(), "keep", F.pmod("h", F.lit(3)).cast("int").alias("part"))
    return cover([r.asDict() for r in rows.collect()])  # at most max_rows


def verdict(rules) -> Column:
    """true (keep) unless a rule covers the row; the rules in their order."""
    made = features()
    out = F.lit(True)
    for rule in reversed(rules):
        holds = reduce(and_, [made[f] <= t if op == "<=" else made[f] > t for f, op, t in rule])
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def told(rules) -> list[str]:
    """The rules as text."""
    return [" and ".join(f"{f} {op} {t:.6g}" for f, op, t in rule) + " -> reject" for rule in rules]
