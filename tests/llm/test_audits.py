"""Operators 11 to 13 against brute force, and their handling of odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import centroids, quality_rules, queries, source_audit
from nearfield.llm.common import written

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, p double, n long, v long, id long, __text string, n_words long"
MORE = (5, "clash", 0.5, 7, 8, 9, "clash", 3)


def docs(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], DOCS)


def audit_by_hand(rows, min_docs, top):
    """rows: doc_id, text, lang, source."""
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    held, counts, groups, out = Counter(), defaultdict(Counter), defaultdict(set), []
    for lang, source, terms in texts:
        held.update((lang, t) for t in set(terms))
        groups[lang].add(source)
    kept = {lang: sorted(t for (x, t), n in held.items() if x == lang and n >= min_docs) for lang in groups}
    for lang, source, terms in texts:
        known = set(kept[lang])
        counts[lang, source].update(t for t in terms if t in known)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        v = len(kept[lang])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * v) for t in kept[lang]}  # noqa: E731, B023
        every = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept[lang])) for o in sources - {s}]
            terms = [(t, f(p[s][t], every[t])) for t in kept[lang] if counts[lang, s][t] > 0 and p[s][t] > every[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def audited(df, **more):
    return sorted(tuple(r) for r in source_audit.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_source_audit(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert audited(spark.read.parquet(f"{SF}/documents.parquet")) == audit_by_hand(rows, 10, 10)


ODD = [
    (1, "The the THE Élan élan Éİ x\x00y z1z _ab`c", "en", "a"), (1, "The the THE Élan élan Éİ x\x00y z1z _ab`c", "en", "a"), (2, None, "en", "b"), (3, "", "en", None), (4, "the y y y", None, "a"),
    (5, "the y", None, None), (None, "the 你好 a b", "en", "c"), (6, "!!! 123 \n\t", "fr", "a"), (7, None, "fr", "b"), (8, "solo", "xx", "only"), (9, "the " * 40_000 + "y" * 100_000, "en", "b"), (10, "y z ab c the", "en", "Z"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_source_audit_of_odd_rows(spark, min_docs):
    assert audited(docs(spark, ODD), min_docs=min_docs, top_terms=3) == audit_by_hand(ODD, min_docs, 3)


def test_source_audit_of_an_empty_table(spark):
    assert audited(docs(spark, [])) == []


def test_postings_are_cut_and_sums_drained_anywhere():
    rng = np.random.default_rng(5)
    rows = sorted({(f"l{a}", f"t{b:03}", f"s{c:02}") for a, b, c in zip(*rng.integers(0, (2, 400, 30), (12_000, 3)).T, strict=True)})
    p, p0 = rng.integers(1, 10**9, len(rows)), {f"s{c:02}": int(v) for c, v in enumerate(rng.integers(1, 10**6, 30))}
    t = pa.table({"lang": [r[0] for r in rows], "term": [r[1] for r in rows], "source": [r[2] for r in rows], "p": p, "p0": [p0[r[2]] for r in rows]})
    want: dict = defaultdict(int)
    for at, (lang, term, source) in enumerate(rows):
        for to in range(at + 1, len(rows)):
            if rows[to][:2] != (lang, term):
                break
            x, y, x0, y0 = int(p[at]), int(p[to]), p0[source], p0[rows[to][2]]
            f = lambda u, w: (u - w) ** 2 // (u + w)
            want[lang, source, rows[to][2]] += f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0)
    for most in (1_000_000, 700):
        got: dict = defaultdict(int)
        for b in source_audit.corrections(iter(t.to_batches(max_chunksize=97)), most):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["item"]] += r["c"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def kmeans_by_hand(rows, k=8, rounds=10, dims=64, scale=1024):
    """rows: id, list of floats or None."""
    kept = [(i, [(Fraction(v) * scale).__floor__() for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x)]
    c = [x for _, _, x in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x, x) for i, x in kept)[:k]]
    if not c:
        return []
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    place = lambda x: min((far(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [place(x)[1] for _, x in kept]
        c = [[sum(v) // at.count(j) for v in zip(*[x for (_, x), a in zip(kept, at, strict=True) if a == j], strict=True)] if j in at else c[j] for j in range(len(c))]
    got = [(i, *place(x)) for i, x in kept]
    inertia = Counter()
    for _, d, j in got:
        inertia[j] += d
    top = 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, j, min(d, top), min(inertia[j], top), min(inertia.total(), top), digest[j]) for i, d, j in got), key=repr)


VECS = "vec_id long, embedding array<double>, label int, vec array<double>, id long, cluster int"


def vecs(spark, rows):
    return spark.createDataFrame([(i, x, 0, [1.0], 4, 5) for i, x in rows], VECS)


def placed(df, **more):
    return sorted((tuple(r) for r in centroids.clustered(df, **more).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def odd_vectors(dims, wide=1.0):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.integers(-6, 6, dims) / 4 * wide).tolist()) for i in range(60)]  # many ties
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * (dims - 1), [1.0] * (dims + 1), [nan] + [0.0] * (dims - 1), [0.0] * (dims - 1) + [inf], [None] + [0.0] * (dims - 1)]
    return rows + rows[:9] + [(3, [0.0] * dims), (None, [0.25] * dims), (None, [0.5] * dims)] + [(100 + k, x) for k, x in enumerate(bad)]


@pytest.mark.parametrize(("dims", "k", "wide"), [(3, 8, 1.0), (2, 5, 1.0), (3, 4, 1e5), (2, 3, 1e200)])
def test_centroids_by_hand(spark, dims, k, wide):
    rows = odd_vectors(dims, wide)
    df = vecs(spark, rows).repartition(5)
    assert placed(df, k=k, dims=dims) == kmeans_by_hand(rows, k, 10, dims)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 2.0])]
    assert placed(vecs(spark, rows), dims=2) == kmeans_by_hand(rows, 8, 10, 2)
    for none in ([], [(1, None)], [(1, [1.0])]):
        assert placed(vecs(spark, none), dims=2) == []
    assert centroids.clustered(vecs(spark, []), dims=2).schema == centroids.clustered(vecs(spark, rows), dims=2).schema


def test_annuli_leave_centroids_out_and_keep_ties():
    rng = np.random.default_rng(0)
    c = rng.integers(-1000, 1000, (40, 8)) * rng.integers(1, 60, (40, 1))
    c = np.concatenate([c, c[:3], -c[:3]])  # equal norms, and equal centroids
    for x, share in ((c[rng.integers(0, 46, 4000)] + rng.integers(-900, 900, (4000, 8)), 0.25), (rng.integers(-60_000, 60_000, (4000, 8)), 1.0), (c, 0.25)):
        number, d, looked = centroids.nearest(x, c)
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == every.argmin(1)).all() and (d == every.min(1)).all()
        assert looked < share * every.size


STAT_DOCS = [
    (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t\x0b\x0c\r ", "en", "a"), (3, "a b c a b c", None, None), (4, "a b c\nx\n\na b c\n \n \nA b c\n" * 3, "en", "a"), (4, "# * $ % & | < > ~ ^", "en", "a"),
    (5, "word " * 30_000, "en", "a"), (6, "\n".join(f"l{k} m{k} n{k} #" for k in range(60)), "en", "a"), (7, "Straße ünï 你好 🙂 é \x1c x\x85y", "en", "a"), (None, "x" * 200_000, "en", "a"), (8, "a a a a", "en", "a"),
]


def statistics_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines), len(set(w)), sum(len(x) >= 20 for x in w)


def test_statistics_by_hand(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_long_words"]
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df, rows in ((docs(spark, STAT_DOCS), STAT_DOCS), (small, [tuple(r) for r in small.collect()])):
        got = sorted((tuple(r) for r in quality_rules.statistics(df).select("doc_id", *names).collect()), key=repr)
        assert got == sorted(((r[0], *statistics_by_hand(r[1])) for r in rows), key=repr)
    assert quality_rules.statistics(docs(spark, [])).collect() == []


def test_a_planted_list_is_found_pruned_and_written_out(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = {"symbols_a_word": rng.random(n), "upper_a_char": rng.random(n), "words": rng.integers(50, 900, n).astype(float)}
    junk = ((x["symbols_a_word"] > 0.6) & (x["upper_a_char"] < 0.4)) | (x["words"] > 850)
    drop = junk ^ (rng.random(n) < 0.02)  # some labels are wrong
    pruning = np.arange(n) % 3 == 0
    rules = quality_rules.cover(x, drop, pruning)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= quality_rules.covered(r, x, n)
    assert rules and (hit == junk).mean() > 0.97
    assert all(len(r) <= 6 for r in rules)
    # a condition that only fits noise goes
    exact = (quality_rules.Condition("symbols_a_word", True, 0.6), quality_rules.Condition("upper_a_char", False, 0.4))
    noisy = (*exact, quality_rules.Condition("words", True, 600.0))
    assert quality_rules.prune(noisy, x, ((x["symbols_a_word"] >= 0.6) & (x["upper_a_char"] <= 0.4))) == exact
    # the column says what the arrays say
    stats = spark.createDataFrame([(100, 400, 70, 10), (100, 400, 70, 300), (880, 400, 0, 0), (60, 400, 0, 0)], "n_words long, word_chars long, n_symbols long, n_upper long")
    said = [r[0] for r in stats.select(quality_rules.verdict([(quality_rules.Condition("words", True, 850.0),), exact])).collect()]
    assert said == [2, 0, 1, 0]


def best_by_hand(x, y):
    found = (0.0, None)
    for name, v in x.items():
        s = sorted(set(v.tolist()))
        for a, b in zip(s, s[1:], strict=False):
            for at_least in (False, True):
                c = quality_rules.Condition(name, at_least, (a + b) / 2)
                inside = c.holds(x)
                p, m = y[inside].sum(), inside.sum()
                gain = p * (np.log2(p / m) - np.log2(y.sum() / len(y))) if p else 0.0
                if gain > found[0] + 1e-9:
                    found = (gain, c)
    return found


def test_the_best_condition_by_hand():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = {k: rng.integers(0, 7, 40).astype(float) for k in ("words", "word_length")}
        y = rng.random(40) < 0.3
        got, want = quality_rules.best_condition(x, y), best_by_hand(x, y)
        assert got[0] == pytest.approx(want[0])
        assert (got[1] is None) == (want[1] is None)


def test_judged_like_by_hand(spark):
    """The whole query: base by hand; the verdict by walking down the learned list in Python."""
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learn(written(quality_rules.statistics(df), "statistics"), labels)
    texts = {r.doc_id: r.text for r in df.collect()}
    got = queries.op13_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    full = {r.doc_id: r.asDict() for r in quality_rules.statistics(df).collect()}
    for r in got:
        want = statistics_by_hand(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        s = full[r.doc_id]
        value = lambda c: s[quality_rules.FEATURES[c.name][0]] / (1 if quality_rules.FEATURES[c.name][1] is None else s[quality_rules.FEATURES[c.name][1]])  # noqa: E731, B023
        first = next((k for k, rule in enumerate(rules, 1) if all(value(c) >= c.threshold if c.at_least else value(c) <= c.threshold for c in rule)), 0) if not failed else 0
        assert (r.base_failed, r.rule, r.kept) == (failed, first, not failed and not first)


def test_held_out_labels_of_quality(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = quality_rules.judge(df, labels.where(~out)).join(labels.where(out), "doc_id").where("not base_failed").collect()
    right = [r.kept == (r.quality == 1) for r in got]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.97


def test_labels_missing_contradicting_or_of_one_kind(spark):
    df = docs(spark, [(k, " ".join(f"w{j}{'#' if k % 2 else ''}" for j in range(60)), "en", "a") for k in range(60)] + STAT_DOCS)
    spec = "doc_id long, quality int, n_words long"
    for labels in ([], [(1, None, 1), (None, 0, 1), (999, 0, 1)], [(k, 1, 1) for k in range(60)]):
        got = quality_rules.judge(df, spark.createDataFrame(labels, spec)).collect()
        assert len(got) == 60 + len(STAT_DOCS) and all(r.kept == (not r.base_failed) for r in got)
    both = [(k, int(k % 2 == 0), 1) for k in range(20, 60)] + [(21, 1, 1)]  # the lower one counts
    got = {(r.doc_id, r.kept) for r in quality_rules.judge(docs(spark, [(k, " ".join(f"w{j}{'#' if k % 2 else ''}" for j in range(60)), "en", "a") for k in range(60)]), spark.createDataFrame(both, spec)).collect()}
    assert got == {(k, k % 2 == 0) for k in range(60)}
