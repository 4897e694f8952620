"""Each operator against a brute-force version on a small table with the awkward cases."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import block_dedup, fingerprint, html_text, langid, mixing, queries, sentencepieces, simhash, simhash_wide, substring_dedup, token_files, weak_quality

BLANK = " \t\n\x0b\x0c\r"
WORDS = "river stone market winter garden letter silver bridge morning forest window paper candle harbour island music table yellow".split()


def texts():
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))
    base = [prose(rng.randint(1, 90)) for _ in range(40)]
    shared = prose(60)
    near = prose(300)
    out = [None, "", "   ", "Same Text", "SameText", "same  text", *base, *base[:5], base[0] + " \n", prose(6000)]
    out += [prose(10) + " " + shared + " " + prose(5), shared, shared + " " + shared, near, near.replace("river", "lake", 1), near.upper(), "Ａé é ▁ tab\tend \U0001f600\x1cz"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 7 % 1009, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i, t, "x", 0, "en", 1, "k") for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, fp string, component_id long, lang string, h long, key string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words(t, lower=False):
    t = t or ""
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if lower else t
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def roots(ids, edges):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def naive_simhash(t):
    w = words(t, True)
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cap", [64, 1])
def test_simhash(docs, rows, cap):
    """cap 1 sends every bucket with two fingerprints the exact way for hot buckets."""
    fp = {i: naive_simhash(t) for i, t in rows}
    edges = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = {i: (fp[i], r) for i, r in roots(fp, edges).items()}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_groups(docs, cap=cap).collect()}
    assert got == want


def test_exact_dedup(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        want |= {i: (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members}
    for block in (4096, 16):
        got = {r[0]: tuple(r[1:]) for r in block_dedup.exact_groups(docs, block).collect()}
        assert got == want


def test_fingerprints(docs, rows):
    canon = lambda t: " ".join(unicodedata.normalize("NFC", t).lower().split())
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    want, edits = {}, {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
        edits[i] = canon(edited)
    out = fingerprint.fingerprints_with_edit(docs).collect()
    odd = {i for i, t in rows if "\x1c" in (t or "")}
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in out if r["doc_id"] not in odd} == {i: w for i, w in want.items() if i not in odd}
    prints = {r["doc_id"]: r["fingerprint"] for r in out}
    edited = {r["doc_id"]: r["edited_fingerprint"] for r in out}
    names = {canon(t or ""): prints[i] for i, t in rows if i not in odd}
    near = {order[k - 1][0] for k, (i, _) in enumerate(order) if i in odd} | odd  # whose edited text may hold an odd one's
    assert all(edited[i] == names[c] if c in names else edited[i] not in names.values() for i, c in edits.items() if i not in near)
    assert len({edited[i] for i in edits if i not in near}) == len({c for i, c in edits.items() if i not in near})
    for i, t in rows:
        for j, u in rows:
            if {i, j}.isdisjoint(odd):
                assert (prints[i] == prints[j]) == (canon(t or "") == canon(u or ""))


def test_substring_dedup(docs, rows):
    seen, want = {}, {}
    ordered = sorted(rows)
    for i, t in ordered:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.setdefault(key, (i, s))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want
    assert any(w[1] for w in want.values())


def test_substring_dedup_of_repeated_ids(spark):
    """Two different rows of one doc_id, null ids, a copied row and a clashing column."""
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    s = prose(25)
    rows = [(7, prose(3) + " " + s), (7, prose(900)), (9, prose(5) + " " + s + " " + prose(4)), ((1 << 63) - 1, prose(30)), (None, s), (None, prose(40)), (11, prose(22))]
    rows += [rows[-1], (12, None), (12, None), (13, prose(19) + " " + s[: s.rindex(" ")] + " zz")]
    got = substring_dedup.remove_repeats(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(3)).collect()
    removed = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"]) for r in got)
    assert removed == sorted([(7, 28, 0), (7, 900, 0), (9, 34, 25), ((1 << 63) - 1, 30, 0), (-1, 25, 25), (-1, 40, 0), (11, 22, 0), (11, 22, 22), (12, 0, 0), (12, 0, 0), (13, 44, 24)])


def test_substring_dedup_where_contexts_differ(spark):
    """A phrase shorter than a window, passages that overlap in part, and repeats within one document, by brute force."""
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrase, long = prose(15), prose(150)
    made = []
    for i in range(120):
        w = prose(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(110)
            w += rng.choice([phrase, long[a : a + rng.randint(10, 40)], made[-1][-25:] if made else [], w[-30:], ["x"] * rng.randint(5, 50)]) + prose(rng.randint(0, 4))
        made.append(w)
    seen, want = {}, {}
    for i, w in enumerate(made):
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen[key] = True
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    df = spark.createDataFrame([(i, "\n".join([" ".join(w[:7]), " ".join(w[7:])])) for i, w in enumerate(made)], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()} == want
    assert sum(w[1] > 0 for w in want.values()) > 40


def test_substring_dedup_of_windows_over_two_matches(spark):
    """Passages shorter than a window are chained: a window that two matches cover together still starts first where it stands."""
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(500)]
    pool = [[rng.choice(vocab) for _ in range(rng.randint(6, 14))] for _ in range(6)]
    made = [sum((rng.choice(pool) for _ in range(rng.randint(1, 6))), [])[rng.randint(0, 8) :] for _ in range(300)]
    seen, want = set(), {}
    for i, w in enumerate(made):
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()} == want


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    token_files.write_ids(docs, str(tmp_path / "ids"), path)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_ids(spark, str(tmp_path / "ids")).collect()}
    want, at = {}, 0
    for i, t in sorted(rows, key=lambda x: x[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    for shard in (r.asDict() for r in spark.read.parquet(str(tmp_path / "ids")).collect()):
        for k, name in enumerate(np.frombuffer(shard["doc_ids"], "<i8").tolist()):
            assert zlib.crc32(token_files.read_document(shard, k).astype("<u4").tobytes()) == want[name][2]


def test_token_files_random_access_in_one_shard(spark, tmp_path):
    """Short texts, so that rules which end in the end id abound; null and repeated ids, ties, clashing columns."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(9)
    made = [(rng.choice([None, *range(2000)]), rng.choice([None, "", *(" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(20))])) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in made], "doc_id long, text string, part int, shard int, seq string")
    token_files.write_ids(df.coalesce(1), str(tmp_path / "ids"), path)
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in made), key=lambda x: (x[0], x[1].encode()))
    want = [tok.encode(t, add_special_tokens=False).ids + [1] for _, t in order]
    got, at = [], 0
    for r in spark.read.parquet(str(tmp_path / "ids")).orderBy("part", "shard").collect():
        got += [token_files.read_document(r.asDict(), k).tolist() for k in range(len(r["doc_ids"]) // 8)]
    assert got == want
    rows = sorted(tuple(r) for r in token_files.read_ids(spark, str(tmp_path / "ids")).fillna(-(1 << 63), ["doc_id"]).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    for (i, _), ids, row in zip(order, want, rows, strict=True):
        assert row == (at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_units_encode_as_whole_texts():
    encoder = token_files.UnitEncoder(queries.tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(3)
    odd = ["<|endoftext|>x <|StartOfText|>", "J\u030cx \u0130stanbul \u03a3\u0391\u03a3", "a\x1cb\x85d\xa0e", "\ufb01 \u2167 \u00b2", "A'LL don't, stop'n", "\u226e <\u0338"]
    odd += ["".join(rng.choices([*"aAbZ019 ,.'!<|>\t\n", "\xe9", "\xc9", "\u0301", "\u0338", "\u65e5", "\xd7", "\u2003", "'s", "<|endoftext|>"], k=rng.randint(0, 40))) for _ in range(5000)]
    ids, sizes = encoder.encode(token_files.pa.array(odd))
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_repair_round_trip():
    """Exact, and no pair is left that occurs LEAST times but for those that follow an end id."""
    rng = np.random.default_rng(3)
    words = [rng.integers(5, 90, rng.integers(2, 6)) for _ in range(300)]
    prose = np.concatenate([np.append(words[k], 1) if k % 7 == 0 else words[k] for k in np.minimum(rng.zipf(1.3, 20000), 300) - 1])
    for ids in (np.zeros(0, np.uint32), np.full(1000, 5, np.uint32), rng.integers(2, 6, 5000).astype(np.uint32), prose.astype(np.uint32)):
        seq, rules, lens = token_files.repair(ids, 49152, 1)
        assert (token_files.expand(seq, rules, lens, 49152) == ids).all()
        assert len(ids) == 0 or len(seq) < len(ids) // 2
        pairs = Counter((a, b) for a, b in zip(seq.tolist(), seq[1:].tolist(), strict=False) if token_files.expand(np.array([a]), rules, lens, 49152)[-1] != 1)
        assert max(pairs.values(), default=0) < token_files.LEAST
        assert all(1 not in token_files.expand(np.array([49152 + k]), rules, lens, 49152)[:-1] for k in range(len(rules)))


def test_pieces(docs, rows):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = sentencepieces.Pieces(model, 0.0, 42)
    for _, t in rows:
        if t and "▁" not in t and unicodedata.is_normalized("NFKC", t) and t == " ".join(t.split()):
            assert plain.encode(t).tolist() == sp.encode(t)
    out = sentencepieces.encode_pieces(docs, model, columns=("lang",)).collect()
    assert {(r["doc_id"], r["decoded"]) for r in out} == {(i, t or "") for i, t in rows}
    again = sentencepieces.encode_pieces(docs.repartition(5), model).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == {r["doc_id"]: r["ids"] for r in again}
    longest = max(out, key=lambda r: len(r["text"]))
    assert longest["ids"] != sp.encode(longest["text"])
    assert all(r["lossless"] for r in sentencepieces.piece_digests(docs, model).collect())


def test_dropout_is_drawn_for_each_occurrence(spark):
    """One word many times has far more than four segmentations, at the rate of independent draws."""
    model = queries.tokenizer_file("piece_bpe_32k.model")
    pieces = sentencepieces.Pieces(model, 0.1, 42)
    plain = sentencepieces.Pieces(model, 0.0, 42).encode("harbour").tobytes()
    seen = [pieces.encode(" ".join(["harbour"] * 50), doc) for doc in range(40)]
    words = [w for ids in seen for w in pieces.decode(ids).split()]
    units = [pieces._unit(u, v) for doc in range(40) for u, v in zip(*pieces._cut(" ".join(["harbour"] * 50), doc), strict=True)]
    assert words == ["harbour"] * 2000 and len(set(units)) > 8
    rng = random.Random(1)
    free = [pieces._unit("\u2581harbour", sum((rng.random() < 0.1) << k for k in range(24))) for _ in range(2000)]
    assert abs(np.mean([u == plain for u in units]) - np.mean([u == plain for u in free])) < 0.05
    df = spark.createDataFrame([(7, " ".join(["harbour garden"] * 40))] * 3, "doc_id long, text string")
    copies = [tuple(r["ids"]) for r in sentencepieces.encode_pieces(df, model, turns=True).collect()]
    again = [tuple(r["ids"]) for r in sentencepieces.encode_pieces(df.repartition(2), model, turns=True).collect()]
    assert len(set(copies)) == 3 and sorted(copies) == sorted(again)


def test_langid_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in queries.op2_language_id(spark, d).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.97


def test_langid_against_a_dictionary_model():
    """Code lengths of variable-order contexts, order 3 to 0, escape method C, counted in plain dictionaries."""
    train = {"a": ["abracadabra, abra cadabra", "the cat sat"], "b": ["\xe9t\xe9 \xe0 la mer", "un deux trois"], "c": ["zzz zzz", ""]}
    model = langid.Model(train)

    def bits(lang, text):
        counts = {}
        for t in train[lang]:
            data = bytes(langid.ORDER) + t.encode()
            for i in range(langid.ORDER, len(data)):
                for k in range(langid.ORDER + 1):
                    counts.setdefault((k, data[i - k : i]), Counter())[data[i]] += 1
        total, data = 0.0, bytes(langid.ORDER) + text.encode()
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER, -2, -1):
                if k < 0:
                    total += 8
                    break
                seen = counts.get((k, data[i - k : i]))
                if seen:
                    n, d = sum(seen.values()), len(seen)
                    total -= np.log2((seen[data[i]] or d) / (n + d))
                    if seen[data[i]]:
                        break
        return total

    for text in ("abra", "the mer", "zz", "quick \xdf", "un chat", "\x00\xff"):
        want = [bits(lang, text) for lang in sorted(train)]
        assert np.allclose(model.bits(text), want, rtol=1e-4)
        assert model.predict(text, True)[0] == sorted(train)[int(np.argmin(want))]


def test_langid_ties_and_clashing_columns(spark):
    """Two languages with the same texts tie, and the first in order is predicted; repeats and extra columns do no harm."""
    made = [(i, "the same words in both", lang, "x", 0.5) for i in range(40) for lang in ("bb", "aa")] + [(None, "the same words", None, "x", 0.5), (7, "12 34", "aa", "x", 0.5)]
    out = langid.identify(spark.createDataFrame(made, "doc_id long, text string, lang string, lang_pred string, score double")).collect()
    assert len(out) == len(made) and {r["lang_pred"] for r in out} == {"aa", "und"} and all(0 <= r["score"] <= 1 for r in out)


def test_langid_code_length():
    model = langid.Model({"a": ["abab"], "b": ["bbbb"]})
    assert model.predict("ababab", True)[0] == "a"
    assert model.predict("bbbbbb", True)[0] == "b"
    assert model.predict(None, False) == ("und", 0.0)


def test_mixing_meets_targets(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op3_mixing(spark, d).collect()
    p = np.array([[r[f"p_{k}"] for k in queries.TARGETS] for r in out])
    n, rate = np.array([r["n_tokens"] for r in out]), np.array([r["rate"] for r in out])
    assert (rate >= 0).all()
    tokens = (rate * n) @ p
    assert np.allclose(tokens / n.sum(), list(queries.TARGETS.values()), atol=2e-3)
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").select("doc_id").distinct().count()


def test_mixing_against_numpy(spark, docs, rows):
    """Memberships of the word classifier and rates of the projected gradient, computed without Spark."""
    rng = random.Random(2)
    marks = [(t, rng.choice(["en", "de"])) for _, t in rows if t]
    targets, found = {"en": 0.7, "de": 0.3}, {}
    out = mixing.mix(docs, spark.createDataFrame(marks, "text string, domain string"), targets).collect()
    vocabulary = sorted({w for _, t in rows for w in words((t or "").lower())})
    known = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()
    bucket = {r["w"]: r["b"] for r in known}
    counts = {d: Counter(bucket[w] for t, m in marks if m == d for w in words(t.lower())) for d in targets}
    for i, t in rows:
        w = [bucket[x] for x in words((t or "").lower())]
        total = {d: sum(c.values()) for d, c in counts.items()}
        z = np.array([mixing.SHARPNESS * np.mean([np.log((counts[d][b] + 1) / (total[d] + mixing.BUCKETS)) for b in w]) if w else np.log(total[d]) for d in targets])
        found[i] = (len(w), np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {i: n for i, (n, _) in found.items()}
    assert all(np.allclose(r["membership"], found[r["doc_id"]][1], atol=1e-6) for r in out)
    n, p = np.array([found[r["doc_id"]][0] for r in out], float), np.array([found[r["doc_id"]][1] for r in out])
    rate, goal, ones = np.ones(len(n)), n.sum() * np.array([0.7, 0.3]), n @ p
    for _ in range(60):
        miss = (rate * n) @ p - goal
        if (np.abs(miss) <= 1e-4 * goal).all():
            break
        rate = np.maximum(0, rate - p @ (miss / ones))
    assert np.allclose([r["rate"] for r in out], rate, atol=1e-6)


def test_copies_keep_the_mean(spark):
    row = spark.range(20000).select(F.avg(mixing.copies(F.lit(1.3), F.col("id"))).alias("m")).first()
    assert abs(row["m"] - 1.3) < 0.02


def test_wide_simhash_finds_near_copies(docs, rows):
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_groups(docs).collect()}
    sets = {i: {tuple(words(t, True)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} for i, t in rows}
    for a in sets:
        for b in sets:
            if a < b and words(dict(rows)[a]) and words(dict(rows)[b]):
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.95:
                    assert got[a] == got[b]
                elif j < 0.5:
                    assert a not in got or b not in got or got[a] != got[b]


def band_pairs(lengths, count, seed=11):
    """Pairs of texts of which the second has some words replaced, at similarities from 0.7 to 1."""
    rng, made = random.Random(seed), []
    while len(made) < count:
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice(lengths))]
        v = list(w)
        for k in rng.sample(range(len(w)), rng.randint(1, max(1, round(0.035 * len(w))))):
            v[k] = f"x{rng.randrange(10**9)}"
        x, y = ({tuple(u[k : k + 5]) for k in range(max(1, len(u) - 4))} for u in (w, v))
        made.append((len(x & y) / len(x | y), " ".join(w), " ".join(v)))
    return made


@pytest.mark.parametrize("lengths", [[120, 300, 600], [24, 40, 70, 90]])
def test_wide_simhash_recall_by_band(spark, lengths):
    """Pairs from 0.8 up are found, also near 0.8, and none below is."""
    pairs = band_pairs(lengths, 900)
    made = [(2 * k + j, p[1 + j]) for k, p in enumerate(pairs) for j in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_groups(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    found = [2 * k in got and got[2 * k] == got.get(2 * k + 1) for k in range(len(pairs))]
    assert not any(f for f, p in zip(found, pairs, strict=True) if p[0] < 0.8)
    for low, high, least in ((0.8, 0.83, 0.9), (0.83, 0.87, 0.95), (0.87, 0.91, 0.98), (0.91, 1.01, 0.99)):
        band = [f for f, p in zip(found, pairs, strict=True) if low <= p[0] < high]
        print(lengths, low, high, len(band), np.mean(band))
        assert band and np.mean(band) >= least


def test_quality_keeps_the_labelled_good(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = {r["doc_id"]: r["keep"] for r in queries.op6_quality(spark, d).collect()}
    good = [out[i] for i, q in labels.items() if q == 1 and i in out]
    bad = [out[i] for i, q in labels.items() if q == 0 and i in out]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.1


def test_quality_finds_planted_accuracies():
    """Seven labellers of known rates, one of them no better than chance and one that errs often."""
    rng = np.random.default_rng(4)
    planted = [(0.8, 0.02), (0.6, 0.1), (0.7, 0.05), (0.5, 0.01), (0.3, 0.3), (0.65, 0.25), (0.75, 0.03)]  # votes bad on bad, on good
    n = 40000
    good = rng.random(n) < 0.8
    votes = np.stack([np.where(rng.random(n) < np.where(good, g, b), "-", np.where(rng.random(n) < 0.5, "0", "+")) for b, g in planted], 1)
    posterior, rates = weak_quality.estimate(Counter(map("".join, votes)))
    assert np.abs(rates[:, 0, 0] - [b for b, _ in planted]).max() < 0.03 and np.abs(rates[:, 1, 0] - [g for _, g in planted]).max() < 0.03
    got = np.array([posterior["".join(v)] for v in votes])
    assert np.mean((got >= 0.5) == good) > 0.97 and abs(got.mean() - 0.8) < 0.01
    assert weak_quality.estimate({})[0] == {}


def test_html_text(spark):
    body = "The council of the harbour town decided on Monday to repair the old bridge over the river before winter. "
    page = f"<html><head><title>x</title><script>var a = 1;</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav><article><h1>Bridge</h1><p>{body * 2}</p><p>{body} It costs 3 &amp; 4 &euro;.</p></article><footer>Copyright 2020 All rights reserved</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert "repair the old bridge" in got[1]["text"] and "3 & 4 €." in got[1]["text"]
    assert not re.search("Copyright|Home|var a", got[1]["text"])
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == ""


def test_html_blocks():
    """Open heads, apostrophes in bare values, custom elements, silent elements and comments never closed."""
    texts = lambda h: [b[1] for b in html_text.blocks(h)]
    assert texts("<html><head><title>t</title><p>story") == ["story"]
    assert texts("<article><h1>Tall</h1><p title=it's>first</p><p>second it's so</p>") == ["Tall", "first", "second it's so"]
    assert texts("<article><h1>A</h1><object-viewer>x</object-viewer><p>article") == ["A", "x", "article"]
    assert texts("<p>a<svg/>b<svg><text>no</text><p>c</p></p>d") == ["a", "b", "d"]
    assert texts("<article><math>x+1</math><select><option>no</article><p>yes") == ["x+1", "yes"]
    assert texts("<!-->x<!-- y") == ["x"] and texts("<script>if (a < b) '</p>'") == [] and texts("<title>x <p>y") == ["x", "y"]
    assert html_text.blocks("<a><b><i><u><em><strong>deep</strong></em></u></i></b></a>")[0][2] == 4
    assert len(html_text.blocks("<div>" * 20000 + "x" + "</p>" * 20000)) == 1 and texts("<a " + "b= " * 50000) == []


def test_html_text_of_awkward_rows(spark):
    """Repeats, no page_id, a very long page, clashing columns, an empty table; text is the main blocks of made pages."""
    r = np.random.default_rng(77)
    made = [html_text.made_page(r) for _ in range(60)]
    long = "<article><h1>Top</h1>" + "".join(f"<p>The town had a long story, part {k}, and it was told by many people over the years.</p>" for k in range(3000)) + "</article>"
    rows = [(k, "u", h, 0, "t") for k, (h, _) in enumerate(made)] + [(None, "u", made[0][0], 0, "t")] * 2 + [(99, None, long, 0, "t"), (100, "u", "", 0, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_blocks long, text string")
    out = html_text.extract(df).collect()
    assert html_text.extract(df.filter("false")).count() == 0
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and sum(r["page_id"] is None for r in out) == 2 and got[None] == got[0] and got[100] == ""
    assert got[99].count("\n") == 3000
    want = {k: "\n".join(html_text.SPACE.sub(" ", m).strip() for m in main) for k, (_, main) in enumerate(made)}
    assert np.mean([got[k] == w for k, w in want.items()]) > 0.9


def test_empty_tables(spark, empty, tmp_path):
    model, tok = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("word_bpe_49k.json")
    assert simhash.near_groups(empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert mixing.mix(empty, empty.select("text", F.col("lang").alias("domain")), {"en": 1.0}).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert weak_quality.score_quality(empty, tuple(empty.columns)).count() == 0
    token_files.write_ids(empty, str(tmp_path / "none"), tok)
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0
    assert fingerprint.fingerprints_with_edit(empty).count() == 0
    assert block_dedup.exact_groups(empty).count() == 0
    assert sentencepieces.piece_digests(empty, model).count() == 0
    assert simhash_wide.similar_groups(empty).count() == 0


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    model = queries.tokenizer_file("piece_bpe_32k.model")
    for out in (simhash.near_groups(df), langid.identify(df), block_dedup.exact_groups(df), substring_dedup.remove_repeats(df), weak_quality.score_quality(df), sentencepieces.piece_digests(df, model)):
        assert out.count() == 5
    assert fingerprint.fingerprints_with_edit(df).count() == 5
    assert mixing.mix(df, df.select("text", F.lit("en").alias("domain")), {"en": 1.0}).count() == 3


def test_near_dedup_confirms_every_pair_that_keys_bring_together(spark):
    """Of 500 texts with the same 256 words and a tail each, all pairs are near 0.8; 60 pairs of them pass it, which a limit
    on the pairs that a text may try loses among the others."""
    rng = random.Random(8)
    core = [f"c{rng.randrange(10**9)}" for _ in range(256)]
    tails = [[f"t{k}_{j}" for j in range(35)] for k in range(500)]
    for k in range(0, 120, 2):
        tails[k + 1][:5] = tails[k][:5]
    order = rng.sample(range(500), 500)
    made = [(order[k], " ".join(core + tail)) for k, tail in enumerate(tails)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_groups(docs).collect()}
    pairs = [(order[k], order[k + 1]) for k in range(0, 120, 2)]
    assert got == {x: min(p) for p in pairs for x in p}


def test_pieces_decoded_together_are_those_decoded_alone():
    """Texts of one batch, with units that repeat, a literal mark and none at all, against the agenda of each unit alone."""
    p = sentencepieces.Pieces(queries.tokenizer_file("piece_bpe_32k.model"), 0.3, 5)
    texts = ["", "one two one two " * 40, "marks ▁ here", "ÄÖ  x" + "y" * 60, "日本 one"]
    ids = p.encode_batch(texts, list(range(5)))
    assert p.decode_batch(ids) == texts == [p.decode(x) if len(x) else "" for x in ids]
    assert p.decode_batch([]) == []
    for k in (1, 3, 4):
        units, skips = p._cut(texts[k], k)
        assert ids[k].tobytes() == b"".join(p._unit(u, v) for u, v in zip(units, skips, strict=True))


def test_repair_leaves_no_pair_that_occurs_often():
    rng = np.random.default_rng(4)
    ids = np.append(np.minimum(rng.zipf(1.4, 60_000), 400), 1).astype(np.uint32)
    seq, rules, lens = token_files.repair(ids, 500, 1)
    assert np.array_equal(token_files.expand(seq, rules, lens, 500), ids)
    ends = seq == 1
    ends |= np.isin(seq, 500 + np.flatnonzero([token_files.expand(np.array([500 + k], np.uint32), rules, lens, 500)[-1] == 1 for k in range(len(rules))]))
    pair = (seq[:-1].astype(np.int64) << 32 | seq[1:])[~ends[:-1]]
    assert np.unique(pair, return_counts=True)[1].max() < token_files.LEAST


def test_scratch_tables_are_packed_tightly(spark):
    from pathlib import Path

    from ledgerlens.llm.common import Scratch

    saved = Scratch(spark, "packed").save(spark.range(5).select(F.col("id").alias("doc_id")))
    files = [p.name for p in Path(saved._scratch_path.removeprefix("file://").removeprefix("file:")).glob("part-*")]
    assert files and all(".zstd." in f for f in files)


def test_pieces_remember_a_bounded_number_of_units():
    pieces = sentencepieces.Pieces(queries.tokenizer_file("piece_bpe_32k.model"), 0.1, 42)
    units = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(150_000)]
    have = pieces._plain(units)
    assert len(have) == len(units) and len(pieces.plain.young) + len(pieces.plain.old) <= 100_000
    assert pieces._plain(units[:9]) == have[:9]


def test_keys_of_near_dedup_are_made_in_bounded_tasks(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 90), k -> concat('w', id * 7 % 501, '_', k))) AS text")
    prints = docs.mapInArrow(simhash_wide._prints(5, 0.8), "doc_id long, fp binary, weak binary, prefix binary, parity binary, n long").cache()
    keys = simhash_wide.probed(prints, 100)
    assert keys.rdd.getNumPartitions() >= 30
    assert keys.count() == prints.select("doc_id", "fp", "weak", "prefix").mapInArrow(simhash_wide._keys, "doc_id long, key long").count() > 3000 * 32
