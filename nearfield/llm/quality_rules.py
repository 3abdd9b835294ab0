"""Quality rules: base limits, then a decision list learned from labelled statistics.

``statistics`` counts what rules speak of in tasks, over whole texts. ``learn`` takes the statistics of a bounded sample of
labelled rows and covers what is to be dropped by rules, one after another. Two thirds of the rows grow a rule: conditions
``feature <= t`` or ``feature >= t`` are added, each with the largest gain in information of all features and thresholds, until it
covers no row that is to be kept. The other third prunes it: last conditions go as long as the rule separates those rows better
without them. A rule that holds up on the pruning rows is put on the list, and the rows that it covers leave; the first rule that
doesn't ends the list. ``verdict`` writes the list as conditional expressions of Spark; nothing else is needed to apply it.

A null or empty text has no words, lines or symbols, and fails the base. Repeated rows each have a result. Labels that contradict each
other count as the lower one; labels without a document, and null ones, aren't used. Without rows of both labels the list is empty and all
that pass the base are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty, written

WORD_BYTE = r"[^\x20\x09-\x0D]"
#: Characters that are counted by pattern, whatever word they stand in.
COUNTS = {"n_symbols": r"[#*$%&|<>]", "n_upper": r"\p{Lu}", "n_digits": r"[0-9]", "n_marks": r"[!?.,;:]", "n_cries": r"[!?]"}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_long_words", "n_upper", "n_digits", "n_marks", "n_cries"]
#: Code points of a long word.
LONG = 20


def per_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over rows that end there."""
    at = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return at[ends] - at[np.concatenate([[0], ends[:-1]])]


def repeated_words(word: np.ndarray, row: np.ndarray, ends: np.ndarray, width: int = 3) -> np.ndarray:
    """By row, the words that lie in windows which the row holds more than once."""
    n = len(word)
    at = np.flatnonzero(np.arange(n) + width <= ends[row]) if n else np.zeros(0, np.int64)
    key = row[at]
    for k in range(width):  # windows that agree in the row and in the words so far
        key = np.unique(key * (int(word.max(initial=0)) + 1) + word[at + k], return_inverse=True)[1]
        many = np.bincount(key) > 1 if len(key) else np.zeros(0, bool)
        some = many[key]
        at, key = at[some], key[some]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return per_row(np.cumsum(covered[:n]) > 0, ends)


def text_statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text."""
    text = text.take(pa.array(np.arange(len(text)))).cast(pa.large_string())  # the kernels below misread slices
    parts = pc.ascii_split_whitespace(text)
    flat, rows = parts.flatten(), len(text)
    row = np.repeat(np.arange(rows), np.diff(parts.offsets.to_numpy()))
    some = pc.not_equal(pc.binary_length(flat), 0)
    flat, row = flat.filter(some), row[some.to_numpy(zero_copy_only=False)]
    ends = np.searchsorted(row, np.arange(rows), "right")
    words = flat.dictionary_encode()
    word, chars = words.indices.to_numpy().astype(np.int64), pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(row * max(1, len(chars)) + word)
    lines = pc.split_pattern(text, "\n")
    cut = lines.flatten().dictionary_encode()
    in_row = np.repeat(np.arange(rows), np.diff(lines.offsets.to_numpy()))
    full = pc.match_substring_regex(cut.dictionary, WORD_BYTE).to_numpy(zero_copy_only=False).astype(bool)
    line = cut.indices.to_numpy().astype(np.int64)
    in_row, line = in_row[full[line]], line[full[line]]
    n_lines = np.bincount(in_row, minlength=rows)
    different = np.bincount(np.unique(in_row * max(1, len(full)) + line) // max(1, len(full)), minlength=rows)
    counted = {k: pc.count_substring_regex(text, p).to_numpy(zero_copy_only=False).astype(np.int64) for k, p in COUNTS.items()}
    return counted | {
        "n_words": np.bincount(row, minlength=rows), "word_chars": per_row(chars[word], ends), "n_dup_lines": n_lines - different, "n_lines": n_lines,
        "n_repeat_words": repeated_words(word, row, ends), "n_distinct_words": np.bincount(distinct // max(1, len(chars)), minlength=rows), "n_long_words": per_row(chars[word] >= LONG, ends),
    }


def statistics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and STATS of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = text_statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c], pa.int64()) for c in STATS)], names=[id_col, *STATS])
        give_back()

    return docs.select(id_col, text_or_empty(text_col).alias("__text")).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in STATS)]))


#: What conditions speak of: a count over another (0 if that is 0), or a count by itself.
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols_a_word": ("n_symbols", "n_words"), "upper_a_char": ("n_upper", "word_chars"), "digits_a_char": ("n_digits", "word_chars"),
    "marks_a_word": ("n_marks", "n_words"), "cries_a_word": ("n_cries", "n_words"), "repeats_a_word": ("n_repeat_words", "n_words"), "distinct_a_word": ("n_distinct_words", "n_words"),
    "long_words_a_word": ("n_long_words", "n_words"), "duplicates_a_line": ("n_dup_lines", "n_lines"), "words_a_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    top = F.col(over).cast("double")
    return top if under is None else F.when(F.col(under) > 0, top / F.col(under).cast("double")).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.at_least else x[self.name] <= self.threshold

    def column(self) -> Column:
        return feature(self.name) >= F.lit(self.threshold) if self.at_least else feature(self.name) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest gain: rows to drop that it keeps covered, times what they gain in log2 of their share."""
    pos, n = int(y.sum()), len(y)
    best: tuple[float, Condition | None] = (0.0, None)
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, hit = v[order], np.concatenate([[0], np.cumsum(y[order])])
        cut = np.flatnonzero(s[1:] > s[:-1]) + 1  # the first k rows against the others
        for at_least in (False, True):
            p, m = (pos - hit[cut], n - cut) if at_least else (hit[cut], cut)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / m) - np.log2(pos / n)), 0.0)
            if len(gain) and gain.max() > best[0] + 1e-12:
                k = cut[int(np.argmax(gain))]
                best = float(gain.max()), Condition(name, at_least, float((s[k - 1] + s[k]) / 2))
    return best


def grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < most and y[inside].any() and not y[inside].all():
        _, c = best_condition({k: v[inside] for k, v in x.items()}, y[inside])
        if c is None:
            break
        rule.append(c)
        inside &= c.holds(x)
    return tuple(rule)


def worth(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> float:
    """(dropped rightly - wrongly) / covered."""
    inside = covered(rule, x, len(y))
    return float((2 * y[inside].sum() - inside.sum()) / inside.sum()) if inside.any() else -1.0


def prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The shortest of the rule's beginnings with the largest worth."""
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r, x, y), -len(r)))


def cover(x: dict[str, np.ndarray], drop: np.ndarray, pruning: np.ndarray, min_share: float = 0.9, min_rows: int = 5, most_rules: int = 32, most_conditions: int = 6) -> list[Rule]:
    """The list. pruning: which rows prune. A rule goes on the list if at least min_share of the pruning rows it covers are to be
    dropped and it covers at least min_rows rows that are."""
    rules: list[Rule] = []
    left = np.ones(len(drop), bool)
    of = lambda rows: ({k: v[rows] for k, v in x.items()}, drop[rows])
    while len(rules) < most_rules and drop[left].any():
        g, p = of(left & ~pruning), of(left & pruning)
        rule = grow(*g, most_conditions)
        if not rule:
            break
        rule = prune(rule, *p)
        inside = covered(rule, x, len(drop)) & left
        if worth(rule, *p) < 2 * min_share - 1 or drop[inside].sum() < min_rows:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def base_failed(min_words: int = 50, most_repeats: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = 20_000, base: Column | None = None, **limits) -> list[Rule]:
    """stats: a written table of ``statistics``. labels: id_col and label_col (0: to be dropped). Learns from at most max_rows
    labelled documents that pass the base, those with the least hash of the id."""
    fails = base_failed() if base is None else base
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__label"))
    rows = stats.where(~fails).join(told, id_col).groupBy(id_col).agg(F.min(F.struct("__label", *STATS)).alias("s"))
    some = rows.orderBy(F.xxhash64(id_col), id_col).limit(max_rows).select((F.col("s.__label") == 0).alias("drop"), F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(3)).alias("part"), *[F.col(f"s.{c}").alias(c) for c in STATS])
    got = some.select("drop", "part", *[feature(name).alias(name) for name in FEATURES]).toArrow()
    x = {name: got[name].to_numpy() for name in FEATURES}
    return cover(x, got["drop"].to_numpy(zero_copy_only=False).astype(bool), got["part"].to_numpy() == 0, **limits)


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that covers a row, or 0: ordered conditional expressions over STATS."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = F.when(every, k) if out is None else out.when(every, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """doc_id, STATS, base_failed, rule (0: none) and kept of every document."""
    stats = written(statistics(docs), "statistics")
    rules = learn(stats, labels, **learning)
    done = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(verdict(rules)).cast("int"))
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
