"""SimHash near-duplicates at a Jaccard similarity, for thresholds well below equality.

1024-bit fingerprints over word shingles estimate the cosine, and so the Jaccard similarity, of
shingle sets. They are cut into 32 segments of 32 bits. In each, a small ball is enumerated on
both sides: the value itself and the flips of its FLIPS least certain bits (where the vote is
nearest to a tie, which is where edits flip bits). Votes of few shingles are too coarse for that:
sets of up to SMALL / similarity shingles also give the prefix of their sorted hashes that two
similar sets must share. Documents that share a key are compared by all bits, with a limit loose
enough for chance; each edge that is left is confirmed by the true Jaccard similarity. First each
document is confirmed against those that come first in its keys, so that most of a group is one part
already; what follows only seeks edges between parts that are not linked yet. Keys of a few members
give their pairs, others are compared in bounded blocks, and every pair in reach is confirmed: one by
one, or within the block, which then brings its sets of shingles, where a block has very many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, partitions
from .components import components, contract
from .simhash import LOWER

BITS, SEGMENTS, FLIPS, BLOCK, SMALL = 1024, 32, 7, 512, 64
TINY = 6  # members up to which a key gives its pairs
ORDERS = 4  # in which keys name their first member
FEW = 6  # pairs for each member of a block, up to which they are confirmed one by one
WORDS = BITS // 64
with np.errstate(over="ignore"):
    MIX = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def limit(similarity: float) -> int:
    """Differing bits beyond which sets surely are not that similar, by 3.3 deviations. Sets of few
    shingles differ in up to a quarter more bits."""
    wide = 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(BITS * wide + 3.3 * math.sqrt(BITS * wide * (1 - wide)))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than that are one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def wide_fingerprint(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16 uint64 words, certainty of the 1024 bits) of distinct shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 255):  # so that counts fit a byte
            x = h[at : at + 255, None] + MIX[None, :]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8).reshape(len(x), BITS // 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64), np.abs(2 * ones - len(h))


def _prints(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, weak, prefix, parity, size = [], [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), shingle)
                n = len(h)
                fp, sure = wide_fingerprint(h)
                fps.append(fp.tobytes())
                weak.append(np.argsort(sure.reshape(SEGMENTS, 32), axis=1, kind="stable")[:, :FLIPS].astype(np.uint8).tobytes() if n >= SMALL else b"")
                first = n - math.ceil(similarity * n - 1e-9) + 1
                prefix.append(h[:first].tobytes() if 0 < n <= SMALL / similarity + 1 else b"")
                parity.append(np.packbits(np.bincount((h % np.uint64(BITS)).view(np.int64), minlength=BITS) & 1, bitorder="little").tobytes())
                size.append(n)
            made = [pa.array(x, pa.binary()) for x in (fps, weak, prefix, parity)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, pa.array(size, pa.int64())], ["doc_id", "fp", "weak", "prefix", "parity", "n"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, weak, prefix) -> (doc_id, key): segments' balls, and prefix hashes with the sign set."""
    flips = np.uint64(1) << np.arange(32, dtype=np.uint64)
    segment = np.arange(SEGMENTS, dtype=np.uint64)[None, :, None] << np.uint64(32)
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            ids, fps, weak, prefix = whole.slice(at, 2048).to_pydict().values()
            ball = [k for k, w in enumerate(weak) if w]
            ids = np.array(ids, np.int64)
            v = np.frombuffer(b"".join([fps[k] for k in ball]), np.uint32).reshape(-1, SEGMENTS, 1).astype(np.uint64)
            w = np.frombuffer(b"".join([weak[k] for k in ball]), np.uint8).reshape(-1, SEGMENTS, FLIPS)
            keys = (np.concatenate([v, v ^ flips[w]], axis=2) | segment).ravel()
            small = np.frombuffer(b"".join(prefix), np.uint64) | np.uint64(1 << 63)
            owner = np.concatenate([np.repeat(ids[np.array(ball, np.int64)], SEGMENTS * (FLIPS + 1)), np.repeat(ids, [len(x) // 8 for x in prefix])])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([keys, small]).view(np.int64))], ["doc_id", "key"])


def probed(ones: DataFrame, each: int = 8192) -> DataFrame:
    """(doc_id, key) of ones(doc_id, fp, weak, prefix, ...). A document has up to SEGMENTS * (FLIPS + 1) keys, which a task sorts
    for their shuffle; so documents are dealt out, and a task makes the keys of about ``each``, however few files hold them."""
    dealt = ones.select("doc_id", "fp", "weak", "prefix").repartition(partitions(ones, each), "doc_id")
    return dealt.mapInArrow(_keys, "doc_id long, key long")


def _can(parity: np.ndarray, total: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes in all can be that similar by the parities that differ. A shingle that only one of two sets
    holds changes one parity, so the sets share at most half of what is left of their sizes; this loses nothing."""
    both = (total - np.bitwise_count(parity).sum(1, dtype=np.int64)) // 2
    return both >= similarity * (total - both) - 1e-9


def _pairs(loose: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(j).to_numpy() for j in (2, 3))
            fa, fb, x, y = (np.frombuffer(b"".join(b.column(j).to_pylist()), np.uint64).reshape(-1, WORDS) for j in range(4, 8))
            can = (np.bitwise_count(fa ^ fb).sum(1, dtype=np.int64) <= loose) & _can(x ^ y, na + nb, similarity)
            yield b.select([0, 1]).filter(pa.array(can))

    return run


def _near(f: np.ndarray, parity: np.ndarray, n: np.ndarray, label: np.ndarray, loose: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a block's members with different labels that can be that similar: few bits differ, and so do few parities."""
    found = []
    for at in range(0, len(f), 64):
        d = np.bitwise_count(f[at : at + 64, None, :] ^ f[None, :, :]).sum(2, dtype=np.int64)
        i, j = np.nonzero((d <= loose) & (label[at : at + 64, None] != label[None, :]))
        i += at
        i, j = i[i < j], j[i < j]
        can = _can(parity[i] ^ parity[j], n[i] + n[j], similarity)
        found.append((i[can], j[can]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Rows sorted by their first three columns as batches of whole groups, with the places where groups begin and the end."""
    keep = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if keep is None else pa.Table.from_batches([keep, b]).combine_chunks().to_batches()[0]
        keys = [b.column(j).to_numpy() for j in range(3)]
        turn = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        last = int(turn[-1]) if len(turn) else 0
        if last:
            yield b.slice(0, last), [0, *turn.tolist()]
        keep = b.slice(last)
    if keep is not None:
        yield keep, [0, keep.num_rows]


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    """doc_id, label, n, fingerprints and parities of a batch of blocks."""
    words = [np.frombuffer(b"".join(b.column(j).to_pylist()), np.uint64).reshape(-1, WORDS) for j in (6, 7)]
    return [b.column(j).to_numpy() for j in (3, 4, 5)] + words


def _blocks(loose: int, similarity: float):
    """Pairs (a, b) to confirm, all of a block's; a block that has more than FEW for each member is named by its key instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in _groups(batches):
            ids, label, n, f, parity = _columns(b)
            pairs, dense = [], []
            for s, e in zip(bounds, bounds[1:], strict=False):
                i, j = _near(f[s:e], parity[s:e], n[s:e], label[s:e], loose, similarity)
                if len(i) > FEW * (e - s):
                    dense.append(s)
                else:
                    pairs.append(np.stack([ids[s:e][i], ids[s:e][j]], 1))
            pairs = np.unique(np.concatenate([*pairs, np.zeros((0, 2), np.int64)]), axis=0)
            k, none = len(dense), pa.nulls(len(pairs), pa.int64())
            ends = [pa.concat_arrays([pa.array(x), pa.nulls(k, pa.int64())]) for x in (pairs.min(1, initial=1 << 62), pairs.max(1, initial=-1))]
            named = [pa.concat_arrays([none.cast(b.column(c).type), b.column(c).take(pa.array(dense, pa.int64()))]) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*ends, *named], ["a", "b", "key", "one", "two"])

    return run


def _dense(loose: int, similarity: float):
    """Edges of blocks with many pairs, whose rows bring their sets of shingles: each pair is confirmed here by the true
    similarity, unless edges link the two already. So no more edges than members come out, and none that links is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in _groups(batches):
            ids, label, n, f, parity = _columns(b)
            sets, edges = b.column(8), []
            for s, e in zip(bounds, bounds[1:], strict=False):
                own = [sets[k].values.to_numpy() for k in range(s, e)]
                up: dict[int, int] = {}

                def top(x: int, up=up) -> int:
                    while up.setdefault(x, x) != x:
                        up[x] = x = up[up[x]]
                    return x

                i, j = _near(f[s:e], parity[s:e], n[s:e], label[s:e], loose, similarity)
                order = np.argsort(np.bitwise_count(f[s:e][i] ^ f[s:e][j]).sum(1, dtype=np.int64), kind="stable")
                parts = label[s:e].tolist()
                for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    left, right = top(parts[x]), top(parts[y])
                    if left != right:
                        both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                        if both >= similarity * (len(own[x]) + len(own[y]) - both) - 1e-9:
                            up[left] = right
                            edges.append((int(ids[s + x]), int(ids[s + y])))
            pairs = np.array(sorted(set(edges)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1, initial=1 << 62)), pa.array(pairs.max(1, initial=-1))], ["a", "b"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["doc_id", "hashes"])

    return run


def confirmed(links: DataFrame, rows: DataFrame, similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """Those of links(a, b) whose documents have that true Jaccard similarity; two without a word have it."""
    ends = links.select(F.col("a").alias("doc_id")).union(links.select(F.col("b").alias("doc_id"))).distinct()
    texts = rows.join(ends.hint("merge"), "doc_id", "left_semi")
    sets = scratch.save(texts.mapInArrow(_sets(shingle), "doc_id long, hashes array<long>"), "sets")
    pairs = links.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")
    both = pairs.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return both.filter(F.col("i") >= F.lit(similarity) * (F.col("n") - F.col("i")) - 1e-9).select("a", "b").distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) for each doc_id with a link; component_id is the smallest reachable.

    Documents without a word have fingerprint zero and link with each other. Rows that repeat a
    doc_id are one document; rows without doc_id are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simwide")
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = scratch.save(rows.mapInArrow(_prints(shingle, similarity), "doc_id long, fp binary, weak binary, prefix binary, parity binary, n long"), "prints")
    same = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("c")), "same")
    alike = prints.join(same.filter("c > 1").hint("merge"), "fp").select("a", F.col("doc_id").alias("b")).filter("a <> b")
    ones = scratch.save(prints.join(same.select(F.col("a").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "ones")
    probes = probed(ones)
    shared = scratch.save(probes.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("least")).filter("count > 1"), "shared")
    hits = scratch.save(probes.join(shared.hint("merge"), "key"), "hits")
    # Whom a document meets most often, as the member that comes first in its keys by one order or another, is close to it.
    first = lambda k: F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))).alias(f"first{k}")
    firsts = hits.groupBy("key").agg(*map(first, range(ORDERS)))
    met = hits.join(firsts.hint("merge"), "key").groupBy("doc_id").agg(F.array(F.mode("least", True), F.min("least"), F.max("least"), *[F.mode(f"first{k}", True) for k in range(ORDERS)]).alias("x"))
    stars = met.select(F.explode("x").alias("a"), F.col("doc_id").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    sure = confirmed(scratch.save(stars.filter("a <> b").union(alike).distinct(), "stars"), rows, similarity, shingle, scratch)
    sure = contract(sure, scratch)
    roots = spark.createDataFrame([], "doc_id long, root long")
    if not sure.isEmpty():
        roots = components(sure, scratch).select(F.col("node").alias("doc_id"), "root")
    label = F.coalesce("root", "doc_id").alias("label")
    known = scratch.save(ones.join(roots.hint("merge"), "doc_id", "left").select("doc_id", "fp", "parity", "n", label), "known")
    dealt = scratch.save(hits.join(roots.hint("merge"), "doc_id", "left").select("key", "count", "doc_id", label), "dealt")
    scratch.free(hits)
    mark = lambda k: F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"mark{k}")
    tiny = F.sort_array(F.collect_list(F.when(F.col("count") <= TINY, F.struct("doc_id", "label")))).alias("tiny")
    parts = dealt.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.mode("label", True).alias("main"), F.count(F.lit(1)).alias("c"), mark(0), mark(1), tiny)
    # Keys whose members are one part already have no edge to give, and of keys with the same members one is enough.
    # Keys of a few members give their pairs, each once. In others the largest part is not compared with itself.
    parts = scratch.save(parts.filter("low < high").groupBy("c", "mark0", "mark1", "main").agg(F.min("key").alias("key"), F.first("tiny").alias("tiny")), "parts")
    after = lambda x, i: F.transform(F.filter(F.slice("tiny", i + 2, TINY), lambda y: y["label"] != x["label"]), lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))
    pairs = parts.filter(F.size("tiny") > 0).select(F.inline(F.flatten(F.transform("tiny", after)))).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "fp", "parity")]).hint("merge"), end)
    loose = limit(similarity)
    alone = pairs.select("a", "b", "n_a", "n_b", "fp_a", "fp_b", "parity_a", "parity_b").mapInArrow(_pairs(loose, similarity), "a long, b long")
    open_ = dealt.join(parts.filter(F.size("tiny") == 0).select("key", "main").hint("merge"), "key").withColumn("odd", F.col("label") != F.col("main"))
    open_ = scratch.save(open_.select("key", "count", "doc_id", "label", "odd"), "open")
    scratch.free(dealt)
    small = open_.filter(F.col("count") <= BLOCK).select("key", F.lit(0).alias("one"), F.lit(0).alias("two"), "doc_id", "label")
    chunks = F.pow(F.lit(2), F.ceil(F.log2(F.col("count") / (BLOCK // 2)))).cast("int")
    large = open_.filter(F.col("count") > BLOCK).withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    homes = scratch.save(large.filter("odd").groupBy("key").agg(F.collect_set("mine").alias("odd_chunks")), "odd")
    others = F.when(F.array_contains("odd_chunks", F.col("mine")), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.col("odd_chunks"))
    pair = F.transform(others, lambda o: F.struct(F.least("mine", o).alias("one"), F.greatest("mine", o).alias("two")))
    large = large.join(homes.hint("merge"), "key").select("key", F.explode(pair).alias("x"), "doc_id", "label").select("key", "x.one", "x.two", "doc_id", "label")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = small.union(large).join(known.select("doc_id", "n", "fp", "parity").hint("merge"), "doc_id")
    whole = scratch.save(whole.select("key", "one", "two", "doc_id", "label", "n", "fp", "parity"), "blocks")
    block = ["key", "one", "two"]
    sort = lambda df: df.repartition(n, *block).sortWithinPartitions(*block, "doc_id")
    found = scratch.save(sort(whole).mapInArrow(_blocks(loose, similarity), "a long, b long, key long, one int, two int"), "found")
    links = scratch.save(found.filter("a is not null").select("a", "b").union(alone).distinct(), "links")
    dense = found.filter("a is null").select(*block)
    if not dense.isEmpty():
        many = scratch.save(whole.join(dense.hint("merge"), block), "dense")
        texts = rows.join(many.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        sets = scratch.save(texts.mapInArrow(_sets(shingle), "doc_id long, hashes array<long>"), "sets")
        held = many.join(sets.hint("merge"), "doc_id").select(*block, "doc_id", "label", "n", "fp", "parity", "hashes")
        sure = sure.union(scratch.save(sort(held).mapInArrow(_dense(loose, similarity), "a long, b long"), "dense_edges"))
    edges = contract(confirmed(links, rows, similarity, shingle, scratch).union(sure), scratch)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
    return components(edges, scratch).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
