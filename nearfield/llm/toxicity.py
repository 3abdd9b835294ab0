"""Toxicity with noisy-channel deobfuscation.

Noisy stretches (a letter and a sign at least, letters set apart, repeated letters; of any length) become character
lattices: a symbol may stand for several letters, a separator for nothing or a word end, a repeated letter for none. Viterbi
decoding under a character language model, over all states, picks the likeliest reading; the restored text and the text as it
is are scored.

The model is fitted on all labelled rows (``max_toxic`` and ``max_clean`` can bound them to those with the least hash of the
id; the queries don't). Its features are words and word beginnings, by how often they occur. A feature is taken into account if it
is in more toxic rows than chance explains, by one rule for samples of any size: if a feature that no clean row has were half
as frequent as the rarest one that some has, at most ``chance`` features would be in as many toxic rows (Poisson). It must
also be four times as frequent in toxic rows as in clean ones. Each is a Poisson model: its rate a word in clean texts against its mean count in toxic ones. A greedy cover keeps those that explain toxic rows not
yet explained, so words that only go along with them (or belong to copies of one text) are not taken. A text is toxic by one
of the features or none, so the odds of the mixture are the sum of the features' odds.
All n-grams of these rows make the character model, and all features that chance doesn't explain are looked at; ``max_grams`` and
``max_features`` can bound them. Texts are restored once and written; counts are sums over tasks, and of the cover each
turn is a count by feature over the rows that are left. What comes to the driver are n-grams and features, never rows.

Null texts count as empty; rows are kept one for one; ids are joined to labels, and of several labels of an id (or of equal
texts) the highest counts; labels that are null take no part; without labels every score is 0; extra columns are ignored, and
a kept column that has the score's name gives way to it.
"""

from __future__ import annotations

import functools
import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty, written

#: What a symbol may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "*": "aeiou",
}
SYMBOL = r"0-9@$!|+€(¡*"
#: Three letters or more, each alone, whatever parts them.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){2,}")
#: Letters, digits and signs in a row, a sign among them.
SIGNED = re.compile(rf"(?<![\w{SYMBOL}])[^\W0-9]*+[{SYMBOL}][\w{SYMBOL}]*+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
LETTERS = re.compile(r"[^\W\d_]+")
#: Characters without width.
UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
ORDER = 4
#: Different words that a task holds before it adds them up by n-grams or features.
MOST_WORDS = 400_000


@dataclass
class CharLM:
    """Witten-Bell smoothed character model of lower-case words; a space ends a word."""

    counts: dict[str, int] = field(default_factory=dict)
    letters: int = 60

    def __post_init__(self):
        self.total, self.kinds = Counter(), Counter()
        for g, n in self.counts.items():
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.seen: dict[str, dict[str, float]] = {}

    def p(self, context: str, c: str) -> float:
        n, k = self.total.get(context, 0), self.kinds.get(context, 0)
        low = 1 / self.letters if not context else self.p(context[1:], c)
        return low if not n else (self.counts.get(context + c, 0) + k * low) / (n + k)

    def log(self, context: str, c: str) -> float:
        after = self.seen.get(context)
        if after is None:
            if len(self.seen) >= 20_000:  # some MB
                self.seen.clear()
            after = self.seen[context] = {}
        got = after.get(c)
        if got is None:
            got = after[c] = math.log(self.p(context, c))
        return got


def longest_grams(word: str) -> list[str]:
    s = " " * (ORDER - 1) + word + " "
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


def grams(word: str) -> Iterator[str]:
    for g in longest_grams(word):
        for n in range(1, ORDER + 1):
            yield g[-n:]


def restore(lm: CharLM, noisy: str) -> str:
    """The likeliest reading of a noisy stretch. All states are kept. The last input only matters to an equal one right behind
    it, so states that differ in it alone are one elsewhere."""
    log = lm.log
    states: dict[tuple[str, str], tuple[float, tuple]] = {(" " * (ORDER - 1), ""): (0.0, ())}  # (context, last input) -> score, reversed output

    for at, c in enumerate(noisy):
        after, letter, stands = noisy[at + 1 : at + 2], c.isalpha(), STANDS_FOR.get(c, "")
        skips, parts, stays = not c.isdigit(), -4.0 if stands else -3.0, not stands or c.isdigit()
        nxt: dict = {}

        def put(key, score, out, to=nxt):
            if key not in to or to[key][0] < score:
                to[key] = (score, out)

        for (ctx, last), (score, out) in states.items():
            if letter:
                put((ctx[1:] + c, c if c == after else ""), score + log(ctx, c), (c, out))
                if c == last:
                    put((ctx, c if c == after else ""), score - 1.2, out)
                continue
            for x in stands:
                put((ctx[1:] + x, x if x == after else ""), score - 1.0 + log(ctx, x), (x, out))
            if skips:
                put((ctx, ""), score - 0.4, out)
            if ctx[-1] != " ":
                put((ctx[1:] + " ", ""), score + parts + log(ctx, " "), (" ", out))
            elif stays:
                put((ctx, ""), score - 4.0, out)
        states = nxt
    best, cell = max(((score + (0 if ctx[-1] == " " else log(ctx, " ")), out) for (ctx, _), (score, out) in states.items()), key=lambda x: x[0], default=(0, ()))
    back = []
    while cell:
        back.append(cell[0])
        cell = cell[1]
    return "".join(reversed(back)).strip()


#: Stretches above this length are read block by block. The reading is the same; what is kept for the ways back is not.
LONG = 1000
#: Arrays of states are made for at most so many letters (a table of their fourth power).
MOST_LETTERS = 40


def readings_of(noisy: str) -> set[str]:
    """The letters that may be put out."""
    return {x for c in set(noisy) for x in (c if c.isalpha() else STANDS_FOR.get(c, ""))}


def log_table(lm: CharLM, letters: list[str]) -> np.ndarray:
    """log[c, x, y, z]: of letter c behind the letters x, y, z; the values of lm.log."""
    at, n = {c: i for i, c in enumerate(letters)}, len(letters)
    counts = [np.zeros((n,) * (k + 1)) for k in range(ORDER)]
    for g, many in lm.counts.items():
        if all(c in at for c in g):
            counts[len(g) - 1][tuple(at[c] for c in g)] = many
    total, kinds = ([np.zeros((n,) * k) for k in range(ORDER)] for _ in range(2))
    for of, to in ((lm.total, total), (lm.kinds, kinds)):
        for g, many in of.items():
            if all(c in at for c in g):
                to[len(g)][tuple(at[c] for c in g)] = many
    p = np.full(n, 1 / lm.letters)
    for seen, t, k in zip(counts, total, kinds, strict=True):
        t, k = t[..., None], k[..., None]
        p = np.where(t > 0, (seen + k * p) / np.where(t > 0, t + k, 1), np.broadcast_to(p, seen.shape))
    return np.ascontiguousarray(np.moveaxis(np.log(p), -1, 0))


Live = dict[tuple[str, str], float]  # (context, last input) -> score


def sparse_step(lm: CharLM, live: Live, noisy: str, k: int) -> tuple[Live, dict]:
    """The states behind input k, and of each the state before it and the letter put out."""
    log, c, after = lm.log, noisy[k], noisy[k + 1 : k + 2]
    letter, stands = c.isalpha(), STANDS_FOR.get(c, "")
    skips, parts, stays = not c.isdigit(), -4.0 if stands else -3.0, not stands or c.isdigit()
    new: Live = {}
    came: dict = {}

    def put(key, score, before, out):
        if key not in new or new[key] < score:
            new[key], came[key] = score, (before, out)

    for before, score in live.items():
        ctx, last = before
        if letter:
            put((ctx[1:] + c, c if c == after else ""), score + log(ctx, c), before, c)
            if c == last:
                put((ctx, c if c == after else ""), score - 1.2, before, "")
            continue
        for x in stands:
            put((ctx[1:] + x, x if x == after else ""), score - 1.0 + log(ctx, x), before, x)
        if skips:
            put((ctx, ""), score - 0.4, before, "")
        if ctx[-1] != " ":
            put((ctx[1:] + " ", ""), score + parts + log(ctx, " "), before, " ")
        elif stays:
            put((ctx, ""), score - 4.0, before, "")
    return new, came


class Arrays:
    """Steps over all states at once, [repeats the next input, x, y, z] by the last three letters."""

    STAY = 1 << 12  # in ways back: no letter is put out

    def __init__(self, lm: CharLM, letters: list[str]):
        self.letters, self.at, self.logs = letters, {c: i for i, c in enumerate(letters)}, log_table(lm, letters)

    def of(self, live: Live) -> np.ndarray:
        s = np.full((2, *[len(self.letters)] * 3), -np.inf)
        for (ctx, last), score in live.items():
            s[(int(last != ""), *(self.at[c] for c in ctx))] = score
        return s

    def live(self, s: np.ndarray, after: str) -> Live:
        """after: the next input, which flagged states repeat."""
        some = np.nonzero(np.isfinite(s))
        return {("".join(self.letters[i] for i in (x, y, z)), after if flag else ""): score for flag, x, y, z, score in zip(*(v.tolist() for v in some), s[some].tolist(), strict=True)}

    def step(self, s: np.ndarray, noisy: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        c, after, logs = noisy[k], noisy[k + 1 : k + 2], self.logs
        stands, best, which = STANDS_FOR.get(c, ""), s.max(0), s.argmax(0).astype(np.int16)
        new, way = np.full_like(s, -np.inf), np.zeros(s.shape, np.int16)

        def put(to: int, letter: int, cost: float, ends_in: slice = slice(None)):
            scores = best[..., ends_in] + logs[letter][..., ends_in] + cost
            x = scores.argmax(0)
            got = np.take_along_axis(scores, x[None], 0)[0]
            flag = np.take_along_axis(which[..., ends_in], x[None], 0)[0]
            better = got > new[to][:, ends_in, letter]
            new[to][:, ends_in, letter] = np.where(better, got, new[to][:, ends_in, letter])
            way[to][:, ends_in, letter] = np.where(better, 2 * x + flag, way[to][:, ends_in, letter])

        def hold(to: int, scores: np.ndarray, flag, ends_in: slice = slice(None)):
            better = scores > new[to][..., ends_in]
            new[to][..., ends_in] = np.where(better, scores, new[to][..., ends_in])
            way[to][..., ends_in] = np.where(better, self.STAY + flag, way[to][..., ends_in])

        if c.isalpha():
            put(int(c == after), self.at[c], 0.0)
            hold(int(c == after), s[1] - 1.2, 1)
            return new, way
        for x in stands:
            put(int(x == after), self.at[x], -1.0)
        if not c.isdigit():
            hold(0, best - 0.4, which)
        put(0, 0, -4.0 if stands else -3.0, slice(1, None))
        if not stands or c.isdigit():
            hold(0, best[..., :1] - 4.0, which[..., :1], slice(0, 1))
        return new, way

    def back(self, way: np.ndarray, key: tuple[str, str], noisy: str, k: int) -> tuple[tuple[str, str], str]:
        """The state before input k and the letter put out, of a state behind it."""
        ctx, last = key
        code = int(way[(int(last != ""), *(self.at[c] for c in ctx))])
        repeats = lambda flag: noisy[k] if flag else ""
        if code >= self.STAY:
            return (ctx, repeats(code - self.STAY)), ""
        return (self.letters[code >> 1] + ctx[:2], repeats(code & 1)), ctx[2]


def crowded(letters: int) -> float:
    """From so many live states on, arrays over all states are faster than going through the live ones (as measured)."""
    return 20 + letters**3 / 300 if letters <= MOST_LETTERS else math.inf


def restore_long(lm: CharLM, noisy: str, block: int | None = None) -> str:
    """What restore gives, in memory that grows with the square root of the length: states are kept where each of about sqrt(n) blocks
    begins, and ways back are made again block by block, from the last. Live states are gone through one by one until they are
    many; from there to the end of a block, all states are in arrays."""
    n, block, every = len(noisy), block or max(64, math.isqrt(len(noisy))), readings_of(noisy) | {" "}
    live: Live = {(" " * (ORDER - 1), ""): 0.0}
    made: dict[tuple[str, ...], Arrays] = {}
    spans: list[tuple[int, int, Arrays | None, Live]] = []

    def arrays(letters: set[str]) -> Arrays:
        key = (" ", *sorted(letters - {" "}))
        if key not in made:
            made.clear()
            made[key] = Arrays(lm, list(key))
        return made[key]

    k = 0
    while k < n:
        start, end, begin = k, min(n, k + block), live
        letters = every if len(every) <= MOST_LETTERS else readings_of(noisy[k:end]) | {" "} | {c for ctx, _ in live for c in ctx}
        most, dense = crowded(len(letters)), None
        if len(live) > most:
            dense = arrays(letters)
            s = dense.of(live)
            for k in range(start, end):
                s, _ = dense.step(s, noisy, k)
            live, k = dense.live(s, noisy[end : end + 1]), end
        else:
            while k < end and len(live) <= most:
                live, _ = sparse_step(lm, live, noisy, k)
                k += 1
        spans.append((start, k, dense, begin))
    here = max(live, key=lambda s: live[s] + (0 if s[0][-1] == " " else lm.log(s[0], " ")))
    out: list[str] = []
    for start, end, dense, begin in reversed(spans):
        ways = []
        now = dense.of(begin) if dense else begin
        for k in range(start, end):
            now, way = dense.step(now, noisy, k) if dense else sparse_step(lm, now, noisy, k)
            ways.append(way)
        for k in range(end - 1, start - 1, -1):
            here, letter = dense.back(ways.pop(), here, noisy, k) if dense else ways.pop()[here]
            out.append(letter)
    return "".join(reversed(out)).strip()


@functools.cache
def alnum() -> np.ndarray:
    """Of each code point, whether it is a letter or a number."""
    return np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)])


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def may_be_spaced(low: str) -> bool:
    """Whether SPACED is found: three letters or numbers in a row that each stand alone."""
    inside = np.concatenate([[False], alnum()[code_points(low)], [False]])
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    alone = ~inside[starts + 2]
    return bool((alone[2:] & alone[1:-1] & alone[:-2]).any())


def may_repeat(low: str) -> bool:
    """Whether TRIPLE is found."""
    c = code_points(low)
    same = c[1:] == c[:-1]
    return any(LETTERS.match(chr(x)) for x in np.unique(c[2:][same[1:] & same[:-1]]))


def may_hold(marks: Iterable[str]):
    """Whether some reading of a stretch could hold one of the marks: its letters, or signs that stand for them, are there in order.
    No input puts out more than a letter, so where they aren't, no reading holds it (nor a reading of a reading)."""
    signs: dict[str, str] = {}
    for sign, letters in STANDS_FOR.items():
        for x in letters:
            signs[x] = signs.get(x, "") + sign
    kinds = lambda m: (re.escape(c + signs.get(c, "")) for c in m)
    return re.compile("|".join("".join(f"[^{k}]*+[{k}]" for k in kinds(m)) for m in sorted({f.rstrip("*") for f in marks}))).match


class Restorer:
    """Restores texts; readings of short stretches are kept for the next time. wanted: stretches of which it doesn't hold stay as
    they are (those of letters set apart are always read, as they may become part of another)."""

    def __init__(self, lm: CharLM, wanted=None):
        self.lm, self.known, self.wanted = lm, {}, wanted

    def reading(self, s: str) -> str:
        got = self.known.get(s)
        if got is None:
            got = (restore_long if len(s) > LONG else restore)(self.lm, s)
            if len(s) <= 40:
                if len(self.known) >= 50_000:  # some MB
                    self.known.clear()
                self.known[s] = got
        return got

    def wanted_reading(self, s: str) -> str:
        return s if self.wanted and not self.wanted(s) else self.reading(s)

    def text(self, low: str) -> str:
        """Of a lower-case text; the text itself if nothing in it is noisy. Signs are found first, stretches around them after.
        Characters that aren't seen go before."""
        low = UNSEEN.sub("", low)
        if may_be_spaced(low):
            low = SPACED.sub(lambda m: self.reading(m.group()), low)
        low = SIGNED.sub(lambda m: self.wanted_reading(m.group()) if LETTERS.search(m.group()) else m.group(), low)
        return self.around(low, TRIPLE, str.isalpha, str.isalpha) if may_repeat(low) else low

    def around(self, low: str, sign: re.Pattern, inside, noisy) -> str:
        out, done = [], 0
        for m in sign.finditer(low):
            if m.start() < done:
                continue
            a, b = m.start(), m.end()
            while a > done and inside(low[a - 1]):
                a -= 1
            while b < len(low) and inside(low[b]):
                b += 1
            if noisy(low[a:b]):
                out += [low[done:a], self.wanted_reading(low[a:b])]
                done = b
            elif b > done:
                out.append(low[done:b])
                done = b
        return "".join([*out, low[done:]]) if out else low


def features_of(w: str) -> list[str]:
    """A word and its beginnings of 3 to 8 letters."""
    return [w, *(f"{w[:k]}*" for k in range(3, min(8, len(w)) + 1))]


def features(words: list[str]) -> Counter:
    """How often each word and each word beginning of 3 to 8 letters occurs."""
    out = Counter(words)
    for w, n in list(out.items()):
        for f in features_of(w)[1:]:
            out[f] += n
    return out


class Among:
    """Those of some features that a word counts for."""

    def __init__(self, of: Iterable[str]):
        self.of = frozenset(of)
        self.heads = frozenset(f.rstrip("*")[:3] for f in self.of)

    def sums(self, words: Counter) -> Counter:
        out, of, heads = Counter(), self.of, self.heads
        for w, n in words.items():
            if w[:3] in heads:
                for f in features_of(w):
                    if f in of:
                        out[f] += n
        return out


def more_features(low: str, clear: str) -> Counter:
    """By how much what ``features`` counts of clear is above what it counts of low. Both are sums over words."""
    off, out = Counter(LETTERS.findall(clear)), Counter()
    off.subtract(LETTERS.findall(low))
    for w, n in off.items():
        if n:
            for f in features_of(w):
                out[f] += n
    return +out


def least_rows(mean: float, level: float) -> int:
    """The least n of which a Poisson count with this mean reaches n with a probability of at most the level."""
    n, term, tail = 0, math.exp(-mean), 1.0
    while tail > level:
        tail -= term
        n += 1
        term *= mean / n
        if tail < 1e-12:  # differences are lost: sum up the tail itself
            tail = sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(n, n + 60))
    return n


def size(low: str) -> int:
    return low.count(" ") + low.count("\n") + 1


@dataclass
class Mark:
    """Of a feature: its rate a word in clean texts, its mean count in toxic texts, the odds that a text is toxic by it."""

    rate: float
    mean: float
    odds: float

    def evidence(self, k: int, n_words: int) -> float:
        """Odds that a text with k occurrences is toxic by this feature: Poisson counts against Poisson counts."""
        by_chance = self.rate * n_words
        return math.log(self.odds) + k * math.log((by_chance + self.mean) / by_chance) - self.mean


@dataclass
class ToxicModel:
    lm: CharLM
    marks: dict[str, Mark]
    base: float

    def combined(self, counts: dict[str, int], n_words: int) -> float:
        odds = self.base + sum(math.exp(min(50.0, self.marks[f].evidence(k, n_words))) for f, k in counts.items())
        return odds / (1 + odds)

    def scorer(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for f in self.marks:
            s = f.rstrip("*")
            automaton.add_word(s, [*(automaton.get(s, None) or []), (f, len(s), f.endswith("*"))])
        restorer = Restorer(self.lm, may_hold(self.marks))
        if self.marks:
            automaton.make_automaton()

        def found(low: str) -> Counter:
            out: Counter = Counter()
            for end, entries in automaton.iter(low):
                for f, n, beginning in entries:
                    if (end - n < 0 or not low[end - n].isalpha()) and (beginning or end + 1 == len(low) or not low[end + 1].isalpha()):
                        out[f] += 1
            return out

        def score(text: str) -> float:
            low, got = text.lower(), Counter()
            if self.marks:
                got = found(low)
                clear = restorer.text(low)
                if clear != low:
                    got |= found(clear)
            return self.combined(got, size(low))

        return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int | None = None, max_clean: int | None = None, max_features: int | None = None, max_grams: int | None = None, chance: float = 3.0) -> ToxicModel:
    """labels: the rows to learn from (id, label)."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    seen = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda y, n: marks.where(F.col("y") == y) if n is None else marks.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = of(1, max_toxic).unionByName(of(0, max_clean))
    # a table of labels is not sent to every task, however small: it grows with the documents
    sample = docs.select(id_col, text_or_empty(text_col).alias("text")).join(chosen.hint("shuffle_hash"), id_col).groupBy("text").agg(F.max("y").alias("y")).select("y", "text")
    sample = written(sample, "labelled")

    def lm_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, longest, out = Counter(), Counter(), Counter()

        def add():
            for w, n in words.items():
                for g in longest_grams(w):
                    longest[g] += n
            words.clear()

        for b in batches:
            for t in b.column(1):
                words.update(LETTERS.findall(t.as_py().lower()))
                if len(words) > MOST_WORDS:
                    add()
        add()
        for g, n in longest.items():  # the shorter ones are their ends
            for k in range(ORDER):
                out[g[k:]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["g", "n"])

    rows = sample.mapInArrow(lm_grams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    rows = (rows if max_grams is None else rows.orderBy(F.desc("n"), "g").limit(max_grams)).collect()  # of few letters each, so their number levels off
    lm = CharLM({r.g: r.n for r in rows})

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(lm)
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                low = [t.as_py().lower() for t in part.column(1)]
                clear = [restorer.text(t) for t in low]
                other = [c if c != t else None for c, t in zip(clear, low, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(low, pa.string()), pa.array(other, pa.string())], names=["y", "low", "clear"])
        give_back()

    def counted(low: str, clear: str | None) -> Counter:
        out = features(LETTERS.findall(low))
        return out if clear is None else out | features(LETTERS.findall(clear))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """f, rows, k: in how many texts each feature is, and how often."""
        sums: dict[str, list[int]] = {}

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(2))], names=["f", "rows", "k"])

        for b in batches:
            for low, clear in zip(*b.columns, strict=True):
                for f, k in counted(low.as_py(), clear.as_py()).items():
                    v = sums.setdefault(f, [0, 0])
                    v[0] += 1
                    v[1] += k
                if len(sums) > 400_000:
                    yield emit()
                    sums = {}
        yield emit()
        sums = {}
        give_back()

    def occurrences(only: Among):
        """f, k: how often each of these features is in the texts. Words are added up first, and features are theirs; of a text that
        was restored, what it has more of then is added."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, sums = Counter(), Counter()
            for b in batches:
                for low, clear in zip(*b.columns, strict=True):
                    low, clear = low.as_py(), clear.as_py()
                    words.update(LETTERS.findall(low))
                    if clear is not None:
                        sums.update({f: k for f, k in more_features(low, clear).items() if f in only.of})
                    if len(words) > MOST_WORDS:
                        sums.update(only.sums(words))
                        words.clear()
            sums.update(only.sums(words))
            words.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["f", "k"])
            sums.clear()
            give_back()

        return run

    total = {r.y: (r.n, r.w) for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.regexp_replace("text", "[^ \n]", "")) + 1).alias("w")).collect()}
    (toxic, toxic_words), (clean, clean_words) = total.get(1, (0, 0)), total.get(0, (0, 1))
    if not toxic:
        return ToxicModel(lm, {}, 0.0)
    texts = written(sample.mapInArrow(restored, "y long, low string, clear string").withColumn("row", F.monotonically_increasing_id()), "restored")
    of_kind = lambda y: texts.where(F.col("y") == y).select("low", "clear")
    toxic_ones = written(of_kind(1).mapInArrow(tally, "f string, rows long, k long").groupBy("f").agg(F.sum("rows").alias("rows"), F.sum("k").alias("k")), "tallied")
    kinds = toxic_ones.count()
    # the least of n1 rows that chance doesn't explain, for the rate of a feature that no clean row has
    bare = least_rows(0.5 * toxic_words / max(clean_words, 1), chance / max(kinds, 1))
    # only what is in bare toxic rows at least is counted in clean ones
    many = toxic_ones.where(F.col("rows") >= bare).select("f", F.col("rows").alias("n1"), F.col("k").alias("k1"))
    in_clean = of_kind(0).mapInArrow(occurrences(Among(r.f for r in many.select("f").collect())), "f string, k long").groupBy("f").agg(F.sum("k").alias("k0"))
    lift = F.col("k1") / toxic_words - 4 * (F.col("k0") + 1) / max(clean_words, 1)
    kept = many.join(in_clean, "f", "left").fillna(0, ["k0"]).where(lift > 0)
    kept = (kept if max_features is None else kept.orderBy(F.desc(lift), "f").limit(max_features)).collect()
    stats = {r.f: (r.n1, r.k1, r.k0) for r in kept}
    kept_ones = Among(stats)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for y, low, clear, row in zip(*b.columns, strict=True):
                t, c = low.as_py(), clear.as_py()
                got = kept_ones.sums(Counter(LETTERS.findall(t)))
                if c is not None:
                    got |= kept_ones.sums(Counter(LETTERS.findall(c)))
                out += [(row.as_py(), y.as_py(), size(t), f, k) for f, k in got.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["row", "y", "n", "f", "k"])
        give_back()

    hits = written(texts.select("y", "low", "clear", "row").mapInArrow(met, "row long, y long, n long, f string, k long"), "met")
    scale = seen.get(0, 0) / max(clean, 1) * toxic / max(seen.get(1, 0), 1)  # clean rows for each in the sample
    models = {}
    in_toxic = {r.f: (r.rows, r.words) for r in hits.where("y = 1").groupBy("f").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words")).collect()}
    for f, (_, k1, k0) in stats.items():
        rate = (k0 + 0.5) / max(clean_words, 1)
        many, words = in_toxic.get(f, (0, 0))
        models[f] = Mark(rate, max(0.5, (k1 - rate * words) / max(1, many)), max(many, 1) / max(clean * scale, 1))
    table = docs.sparkSession.createDataFrame([(f, m.rate, m.mean, math.log(m.odds)) for f, m in models.items()], "f string, rate double, mean double, log_odds double")
    chance_ = F.col("rate") * F.col("n")
    evidence = F.col("log_odds") + F.col("k") * F.log((chance_ + F.col("mean")) / chance_) - F.col("mean")  # as Mark has it
    own = written(hits.join(F.broadcast(table), "f").where(evidence > 0).select("f", "row", "y"), "explained")
    wrong = {r.f: r.n for r in own.where("y = 0").groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    open_, taken, at = own.where("y = 1").select("f", "row"), {}, 0  # of the rows that nothing taken explains
    left: dict[str, int] = {r.f: r.n for r in open_.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    explains = {f: (m, left.get(f, 0), wrong.get(f, 0)) for f, m in models.items()}
    unexplained = toxic
    while True:
        gain = {f: left.get(f, 0) - 4 * bad * scale for f, (_, _, bad) in explains.items()}
        # few new rows are enough for a feature that marks many
        ok = [f for f, g in gain.items() if g >= bare or (g >= 1 and explains[f][1] >= 0.04 * toxic)]
        if not ok:
            break
        best = max(ok, key=lambda f: (gain[f], len(f), f))
        mark, many, _ = explains.pop(best)
        taken[best] = Mark(mark.rate, mark.mean, max(left.get(best, 0), 0.3 * many) / max(clean * scale, 1))
        unexplained, at = unexplained - left.get(best, 0), at + 1
        open_ = written(open_.join(open_.where(F.col("f") == best).select("row"), "row", "left_anti").select("f", "row"), f"left-{at}")
        left = {r.f: r.n for r in open_.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    stem = lambda f: f.rstrip("*")
    for f in sorted(explains, key=lambda f: (-explains[f][1], -len(f), f)):  # whatever else marks many and no clean one
        mark, many, bad = explains[f]
        if not bad and many >= 0.04 * toxic and not any(stem(f).startswith(stem(t)) or stem(t).startswith(stem(f)) for t in taken):
            taken[f] = Mark(mark.rate, mark.mean, 0.3 * many / max(clean * scale, 1))
    return ToxicModel(lm, taken, min(0.25, unexplained / max(clean * scale + unexplained, 1)))


def score(docs: DataFrame, model: ToxicModel, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """keep (columns; default doc_id) and score. No shuffle; the model is of bounded size."""
    keep = [c for c in keep or ["doc_id"] if c != "score"]
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = kinds.get(text_col) == "string" and text_col in keep  # a kept text is sent once
    sent = docs.select(*keep) if own else docs.select(*keep, text_or_empty(text_col).alias("__scored_text"))
    at = keep.index(text_col) if own else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                got = [of(t.as_py() or "") for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(got, pa.float64())], names=[*keep, "score"])
        give_back()

    return sent.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))
