"""Toxicity, source divergence and importance resampling against brute force, held-out labels and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import divergence as dv, resampling as rs, toxicity as tx
from ledgerlens.llm.common import Scratch
from ledgerlens.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, "Red FISH red fish é 7x", "en", "a"), (1, "Red FISH red fish é 7x", "en", "a"), (2, None, None, "b"), (None, "red Ä blue", "en", None), (3, "", "en", "c"),
    (4, "blue\x00blue\tÄä " * 40, "en", "b"), (5, "!!! ... 123", "de", "b"), (None, None, "de", "a"), ((1 << 63) - 1, "fish", "en", "b"), (-(1 << 63), "fish " * 30, "de", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, extreme ids, and columns named like those that the operators make."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").repartition(3)
    return df.select("*", *[F.lit(7).alias(c) for c in ("score", "rank", "value", "term", "id", "row", "weight", "label", "bucket", "held_out")])


def divergence_by_hand(rows, least, top):
    groups, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        groups[lang or "", source or ""].update(found), docs[lang or ""].update(found.keys()), sources[lang or ""].add(source or "")
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        price = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        total = {s: sum(groups[lang, s][t] for t in kept) for s in names}
        whole = {t: sum(groups[lang, s][t] for s in names) for t in kept}
        prices = {s: [price(groups[lang, s][t], total[s]) for t in kept] for s in names}
        key = lambda x: (-x[0], x[1].encode())
        for s in names:
            pairs = sorted(((sum(abs(a - b) for a, b in zip(prices[s], prices[o])), o) for o in names - {s}), key=key)
            terms = sorted(((price(groups[lang, s][t], total[s]) - price(whole[t], sum(whole.values())), t) for t in kept if groups[lang, s][t]), key=key)
            out += [(lang, s, part, item, v, k + 1) for part, found in (("pair", pairs), ("term", [x for x in terms if x[0] > 0][:top])) for k, (v, item) in enumerate(found)]
    return sorted(out)


def resampling_by_hand(rows, target, percent=10, least=20, size=10_000, seed=2024):
    buckets = lambda t: [zlib.crc32(w.encode()) % size for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]
    made = [(d, buckets(t)) for d, t in rows]
    s, t = Counter(b for _, x in made for b in x), Counter(b for x in target for b in buckets(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + size) / ((s[b] + 1) * (t.total() + size)))) for b in range(size)]
    out = []
    for d, x in made:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(x), sum(gain[b] for b in x), sum(gain[b] for b in x) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def listed(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


DIVERGED = ("lang", "source", "part", "item", "value", "rank")
SAMPLED = ("doc_id", "n_features", "weight", "score", "rank")


def test_divergence_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(map(tuple, QUERIES["op12_source_divergence"](spark, DIR).select(*DIVERGED).collect())) == divergence_by_hand(rows, 30, 50)


@pytest.mark.parametrize(("least", "block"), [(1, 2), (2, 1 << 14), (99, 2)])
def test_divergence_of_awkward_rows(spark, odd, least, block):
    """Also in blocks of two terms, and where no term is kept."""
    got = dv.divergence(odd, least=least, top=3, block=block)
    assert sorted(map(tuple, got.select(*DIVERGED).collect())) == divergence_by_hand([r[1:] for r in ODD], least, 3)
    assert dict(got.dtypes)["rank"] == "int" and not dv.divergence(odd.limit(0)).collect()


def test_gallop_and_merge_against_sets():
    r = np.random.default_rng(3)
    for n, m, span in ((0, 5, 9), (5, 0, 9), (3, 4000, 5000), (900, 1000, 1200), (70, 70, 70)):
        few, many = (np.sort(r.choice(span, min(k, span), replace=False)) for k in (n, m))
        i, j = dv.gallop(few, many, stride=8)
        assert few[i].tolist() == many[j].tolist() == sorted(set(few.tolist()) & set(many.tolist()))
        counts = [r.integers(1, 10**6, len(x)) for x in (few, many)]
        terms, totals = span + 7, [int(c.sum()) for c in counts]
        price = lambda c, k: 1 + 10**9 * (int(c) + 5) // (totals[k] + 5 * terms)  # noqa: B023, E731
        have = [dict(zip(x.tolist(), c.tolist())) for x, c in zip((few, many), counts)]
        either = set(have[0]) | set(have[1])
        want = sum(abs(price(have[0].get(t, 0), 0) - price(have[1].get(t, 0), 1)) for t in either)
        assert dv.merged((few, counts[0], totals[0]), (many, counts[1], totals[1]), terms) == (want, len(either))


def test_prices_are_exact_far_from_floats():
    counts = np.array([0, 1, 123_456_789_012, 999_999_999_999], np.int64)
    total, terms = int(counts.sum()), 10_000_019
    assert dv.prices(counts, total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts.tolist()]


def test_terms_of_a_long_text_in_parts(monkeypatch):
    text = ("Ab cÉ 7x" * 50 + " zz ").encode() * 3
    whole = dv.term_counts(text)
    monkeypatch.setattr(dv, "SPAN", 7)
    assert dv.term_counts(text) == whole and rs.n_words(text) == len(rs.buckets_of(text))


def test_resampling_of_the_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("text").collect()]
    assert listed(QUERIES["op13_resampling"](spark, DIR), *SAMPLED) == resampling_by_hand(rows, target)


def test_resampling_of_awkward_rows(spark, odd):
    target = spark.createDataFrame([("red red",), (None,), ("",)], "text string")
    for least, percent in ((0, 50), (1, 100), (20, 60), (10**6, 50)):
        got = rs.resample(odd, target, percent=percent, least=least)
        assert listed(got, *SAMPLED) == resampling_by_hand([r[:2] for r in ODD], ["red red"], percent, least)
        assert {k for n, k in got.dtypes if n in SAMPLED} == {"bigint"}
    assert not rs.resample(odd.limit(0), target).collect()
    assert listed(rs.resample(odd, target.limit(0)), *SAMPLED) == resampling_by_hand([r[:2] for r in ODD], [])


def test_quickselect_against_sorting(spark):
    r = np.random.default_rng(4)
    keys = [(int(s), int(i % 7 == 0), int(i // 3), k) for k, (s, i) in enumerate(zip(r.integers(0, 5, 300), r.integers(0, 40, 300)))]
    df = Scratch(spark, "keys").save(spark.createDataFrame(keys, "score long, none int, id long, row long").repartition(4))
    order = sorted(keys, key=lambda x: (-x[0], *x[1:]))
    for k in (1, 2, 150, 299, 300):
        assert tuple(rs.kth_key(df, k, pivots=5)) == order[k - 1]
    assert rs.kth_key(df, 0) is None and rs.kth_key(df, 301) is None


def test_runs_of_words_cross_parts(monkeypatch):
    text = b"a b c d e f"
    want = [zlib.crc32(x) % 97 for x in (b"a b", b"b c", b"c d", b"d e", b"e f", b"a", b"b", b"c", b"d", b"e", b"f")]
    monkeypatch.setattr(rs, "SPAN", 1)
    assert sorted(rs.buckets_of(text, 2, 97).tolist()) == sorted(want)


def test_ftrl_against_the_scalar_rule():
    r = np.random.default_rng(5)
    rows = [(np.unique(r.integers(0, 16, 5)).astype(np.uint32), int(r.random() < 0.4)) for _ in range(60)]
    model = tx.Ftrl(alpha=0.2, beta=1.0, l1=0.3, l2=0.5, bits=4)
    z, n = [0.0] * 17, [0.0] * 17
    for at, y in rows:
        model.learn(at, y)
        ids = [*at.tolist(), 16]
        w = {}
        for i in ids:
            l1 = 0 if i == 16 else 0.3
            w[i] = 0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.2 + 0.5)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in ids:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.2
            z[i], n[i] = z[i] + g - sigma * w[i], n[i] + g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    at, weight, bias = model.sparse()
    assert set(at.tolist()) == {i for i in range(16) if abs(z[i]) > 0.3} and (weight != 0).all() and bias == model.weights(np.array([16]))[0]


def test_grams_of_parts_are_those_of_the_whole(monkeypatch):
    text = "One two, THREE four_five six seven! eight nine. ten éleven"
    words = [zlib.crc32(w.encode()) for w in re.findall(r"[^\W_]+", text.lower())]
    whole = Counter(np.concatenate(list(tx.grams(text))).tolist())
    pairs = sum(len(words) - gap for gap in (1, 2, 3))
    stems = sum(len(w) > k for w in re.findall(r"[^\W_]+", text.lower()) for k in tx.STEMS)
    assert whole.total() == len(words) + pairs + stems
    monkeypatch.setattr(tx, "SPAN", 3)
    assert Counter(np.concatenate(list(tx.grams(text))).tolist()) == whole and list(tx.grams("")) == []


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").collect())
    got = QUERIES["op11_toxicity"](spark, d).collect()
    assert len(got) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    seen = Counter(held)
    assert seen[1, 1] / (seen[1, 1] + seen[1, 0]) > 0.85 and seen[0, 1] / (seen[0, 1] + seen[0, 0]) < 0.01, seen
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_of_awkward_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (5, 0), (None, 1), (99, 1), (3, None)], "doc_id long, label int")
    got = tx.score_toxicity(odd, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by = defaultdict(set)
    for r, in ((x,) for x in got):
        by[r["doc_id"]].add(r["score"])
    assert len(by[1]) == 1 and by[2] == by[3] and len(by[None]) <= 2  # null and empty texts have the bias alone
    assert {r["score"] for r in tx.score_toxicity(odd, labels.limit(0)).collect()} == {0.5}
    assert not tx.score_toxicity(odd.limit(0), labels).collect()
