"""Removal of repeated word passages by seed and extend.

Seeds: the 8-word grams of a document are winnowed, so that every window of LENGTH words picks
one of them (its anchor) by content alone; equal windows pick equal anchors. Documents are joined
on anchors: each occurrence of an anchor is linked to its first one anywhere, so links grow with
the text and not with the pairs of a group.
Extension: a link's surroundings in the earlier document are fetched in blocks of BLOCK words and
the match is extended both ways word by word; maximal matches of LENGTH words or more are repeats.
Windows whose anchor's first occurrence has other words around it are left over; among these,
equal windows are found by a 128-bit key, and all but the first are repeats too. Overlapping
repeats merge, and their words are removed.

Nothing is gathered by group: blocks of a document are sent to those that link to them, and what
comes back to a document is a list no longer than the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, partitions

LENGTH, GRAM, BLOCK = 20, 8, 64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True
CHUNK = 1 << 22  # bytes of text that are hashed at once, or one document


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rolling(items: np.ndarray, size: int, base: int) -> np.ndarray:
    """A mixed polynomial hash of every run of `size` items."""
    out = np.zeros(max(0, len(items) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= np.uint64(base)
            out += items[k : k + len(out)]
        return _mixed(out)


class Words:
    """The words of some texts, one after the other, with hashes of words and grams."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = np.append(BLANK[self.data], True)
        before = np.append(True, blank[:-1])
        before[offsets] = True  # a document starts a word
        after = np.append(blank[1:], True)
        after[np.maximum(offsets - 1, 0)[offsets > 0]] = True
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # the first word of each text, and the end
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words: sums of mixed bytes, each times a power of the base for its place in the word."""
        size = self.ends - self.starts
        out = np.zeros(len(size), np.uint64)
        todo, k = np.arange(len(size)), 0
        with np.errstate(over="ignore"):
            while len(todo):
                out[todo] = (out[todo] ^ TABLE[self.data[self.starts[todo] + k]]) * np.uint64(BASES[0])
                k += 1
                todo = todo[size[todo] > k]
            return _mixed(out)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b joined by one space."""
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split()) if b > a else b""

    def list(self, i: int) -> list[bytes]:
        a, b = self.first[i], self.first[i + 1]
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes().split() if b > a else []


TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


class Anchors:
    """For each text its anchors: places and gram hashes, and for each window the anchor it picks."""

    def __init__(self, words: Words):
        self.words, self.hash = words, words.hashes()
        self.grams = _rolling(self.hash, GRAM, BASES[0])
        width = LENGTH - GRAM + 1
        count = max(0, len(self.hash) - LENGTH + 1)
        best, self.pick = self.grams[:count].copy(), np.arange(count)
        for k in range(1, width):
            less = self.grams[k : k + count] < best  # of equal grams the first
            best[less] = self.grams[k : k + count][less]
            self.pick[less] = np.flatnonzero(less) + k
        self.owner = np.repeat(np.arange(len(words.n)), words.n)
        self.valid = self.owner[:count] == self.owner[LENGTH - 1 : LENGTH - 1 + count]

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor that each window of text i picks, the anchors), as places in the text."""
        a, b = self.words.first[i], self.words.first[i + 1]
        pick = self.pick[a : max(a, b - LENGTH + 1)] - a
        return pick, np.unique(pick)

    def keys(self, i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit keys of the windows of text i that start at those places."""
        a, b = self.words.first[i], self.words.first[i + 1]
        return tuple(_rolling(self.hash[a:b], LENGTH, base).view(np.int64)[at] for base in BASES)


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    at = 0
    texts = b.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    while at < b.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        some = b.slice(at, stop - at)
        yield some, Words(some.column(column))
        at = stop


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, rid, pos): each anchor once for a document, at its first place."""
    for whole in batches:
        for b, words in _chunks(whole, 1):
            found = Anchors(words)
            at = np.unique(found.pick[found.valid])
            h, owner = found.grams[at], found.owner[at]
            order = np.lexsort((at, h, owner))
            fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(order)]
            keep = np.sort(order[fresh])
            rid = b.column(0).to_numpy()[owner[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(rid), pa.array((at - words.first[owner])[keep].astype(np.int32))], ["h", "rid", "pos"])


def _wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, e, block): blocks of earlier documents that hold what surrounds a link."""
    for b in batches:
        rid, e, epos = (b.column(j).to_numpy() for j in range(3))
        lo, hi = np.maximum(0, epos - (LENGTH - GRAM)) // BLOCK, (epos + LENGTH - 1) // BLOCK
        rid, e, block = np.tile(rid, 2), np.tile(e, 2), np.concatenate([lo, hi])
        keep = np.append(np.ones(len(lo), bool), lo != hi)
        yield pa.RecordBatch.from_arrays([pa.array(rid[keep]), pa.array(e[keep]), pa.array(block[keep].astype(np.int32))], ["rid", "e", "block"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, blocks) -> (e, block, words)."""
    for whole in batches:
        for b, words in _chunks(whole, 1):
            e, block, out = [], [], []
            for i, (rid, wanted) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for k in wanted:
                    a = words.first[i] + k * BLOCK
                    e.append(rid), block.append(k), out.append(words.text(a, min(a + BLOCK, words.first[i + 1])))
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(block, pa.int32()), pa.array(out, pa.binary())], ["e", "block", "words"])


def _runs(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    turn = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return ((int(s), int(t)) for s, t in zip(turn[::2], turn[1::2], strict=True) if t - s >= least)


def _matched(ids: np.ndarray, pos: np.ndarray, e: np.ndarray, epos: np.ndarray, earlier: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of a document in a maximal match with an earlier place, and which windows lie whole in one such match.
    Anchors at pos are linked to epos in document e, whose words are earlier[e], -1 where not fetched. Links on one
    diagonal are extended at once."""
    gone, inside = np.zeros(len(ids), bool), np.zeros(len(ids) - LENGTH + 1, bool)
    shift = pos - epos
    order = np.lexsort((pos, shift, e))
    pos, e, shift = pos[order], e[order], shift[order]
    turn = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (shift[1:] != shift[:-1]), [True]]))
    for j, k in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True):
        other, by = earlier[int(e[j])], int(shift[j])
        lo, hi = max(0, by, int(pos[j]) - BLOCK), min(len(ids), len(other) + by, int(pos[k - 1]) + GRAM + BLOCK)
        for s, t in _runs(ids[lo:hi] == other[lo - by : hi - by], LENGTH):
            gone[lo + s : lo + t] = True
            inside[lo + s : lo + t - LENGTH + 1] = True
    return gone, inside


SPANS = "array<struct<start: long, end: long>>"


def _spans(gone: np.ndarray) -> list[dict]:
    return [{"start": s, "end": t} for s, t in _runs(gone, 1)]


def _sha(words: list[bytes], gone: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)).hexdigest()


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list]:
    """Where the list of each row begins and ends, and the fields of all elements."""
    inner = column.flatten()
    return np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]), [inner.field(j) for j in range(inner.type.num_fields)]


def _pairs(found: Anchors, i: int, here: int, lpos: np.ndarray, le: np.ndarray, lepos: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
    """For text i: the anchor of each window, links (pos, e, epos) of anchors to earlier places, and
    which windows are new, as their anchor occurs there for the first time of all."""
    pick, anchors = found.of(i)
    first, back = np.unique(found.grams[found.words.first[i] + anchors], return_index=True, return_inverse=True)[1:]
    head = anchors[first][back]  # an anchor that repeats in the text has links at its first place only
    order = np.argsort(lpos)
    lpos, le, lepos = lpos[order], le[order], lepos[order]
    if len(lpos):
        at = np.minimum(np.searchsorted(lpos, head), len(lpos) - 1)
        linked = lpos[at] == head
        e, epos = np.where(linked, le[at], here), np.where(linked, lepos[at], head)
    else:
        linked, e, epos = np.zeros(len(head), bool), np.full(len(head), here), head
    new = ~linked & (head == anchors)
    return pick, (anchors[~new], e[~new], epos[~new]), np.isin(pick, anchors[new])


def _repeated(ids: np.ndarray, at: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of one document, at these places with these keys, stand first and which repeat the words of an
    earlier one. Keys only propose: word numbers decide, and what differs in a word stands first too."""
    order = np.lexsort((at, k2, k1))
    head = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    words = np.arange(LENGTH)
    same = (ids[at[order][:, None] + words] == ids[at[first][:, None] + words]).all(1) & ~head
    again = np.zeros(len(at), bool)
    again[order[same]] = True
    return np.flatnonzero(~again), again


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text, links, blocks) -> rid, doc_id, n_words, n_removed, kept_sha256, spans, and
    where windows are left over, these (starts and keys), and the text if any word of these is kept so far."""
    for whole in batches:
        for b, words in _chunks(whole, 2):
            found = Anchors(words)
            rids = b.column(0).to_pylist()
            own_links, (pos, e, epos) = _lists(b.column(3))
            own_blocks, (be, bk, bw) = _lists(b.column(4))
            pos, e, epos = pos.to_numpy().astype(np.int64), e.to_numpy(), epos.to_numpy().astype(np.int64)
            be, bk = be.to_pylist(), bk.to_pylist()
            out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "spans", "at", "k1", "k2", "rest")}
            for i, here in enumerate(rids):
                own, (la, lz) = words.list(i), own_links[i : i + 2]
                gone, at, k1, k2, open_ = np.zeros(len(own), bool), [], [], [], False
                if len(own) >= LENGTH:
                    pick, links, new = _pairs(found, i, here, pos[la:lz], e[la:lz], epos[la:lz])
                    if len(links[0]):
                        number: dict[bytes, int] = {}
                        ids = np.array([number.setdefault(w, len(number)) for w in own], np.int32)
                        got = range(own_blocks[i], own_blocks[i + 1])
                        sizes: dict[int, int] = {}
                        for j in got:
                            sizes[be[j]] = max(sizes.get(be[j], 0), (bk[j] + 1) * BLOCK)
                        earlier = {here: ids} | {x: np.full(size, -1, np.int32) for x, size in sizes.items()}
                        for j in got:
                            part = [number.get(w, -1) for w in bw[j].as_py().split()]
                            earlier[be[j]][bk[j] * BLOCK : bk[j] * BLOCK + len(part)] = part
                        gone, inside = _matched(ids, *links, earlier)
                        rest = np.flatnonzero(~inside & ~new)  # a window over two matches is gone, but its words may start here first
                        if len(rest):
                            a, c = found.keys(i, rest)
                            once, again = _repeated(ids, rest, a, c)
                            for s in rest[again].tolist():
                                gone[s : s + LENGTH] = True
                            at, k1, k2 = rest[once].tolist(), a[once].tolist(), c[once].tolist()
                            before = np.cumsum(np.append(0, gone))
                            open_ = bool((before[rest[once] + LENGTH] - before[rest[once]] < LENGTH).any())
                out["n_words"].append(len(own)), out["n_removed"].append(int(gone.sum())), out["spans"].append(_spans(gone))
                out["kept_sha256"].append(None if open_ else _sha(own, gone)), out["rest"].append(b.column(2)[i].as_py() if open_ else None)
                out["at"].append(at), out["k1"].append(k1), out["k2"].append(k2)
            kinds = [pa.int64(), pa.int64(), pa.string(), PA_SPANS, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], ["rid", "doc_id", *out])


PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans, later) -> the result, with the windows that start at `later` removed too."""
    for b in batches:
        n_words, n_removed, sha, spans = [], [], [], []
        for text, had, later in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            own = text.as_buffer().to_pybytes().split()
            gone = np.zeros(len(own), bool)
            for x in had:
                gone[x["start"] : x["end"]] = True
            for s in later or []:
                gone[s : s + LENGTH] = True
            n_words.append(len(own)), n_removed.append(int(gone.sum())), sha.append(_sha(own, gone)), spans.append(_spans(gone))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, PA_SPANS)], RESULT)


RESULT = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, spans (maximal repeats, in word places).

    A window of 20 words is a repeat if the same words also start earlier: in a smaller doc_id,
    or in the same document at an earlier start. Null text has no words; texts under 20 words
    keep all. Rows that repeat a doc_id follow one another in text order; rows
    without doc_id come after all others, likewise. Windows whose anchor first occurs with other words around it are
    compared by exact words within a document and by 128-bit keys between documents. Other columns are ignored; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(partitions(docs), F.asc_nulls_last("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions(F.asc_nulls_last("doc_id"), "text")
    base = scratch.save(ranged.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "texts")  # rid follows the order of doc_id

    seeds = base.select("rid", "text").mapInArrow(_seeds, "h long, rid long, pos int")
    first = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("e"), F.min_by("pos", "rid").alias("epos"))
    first = scratch.save(first.filter("c > 1").drop("c"), "first")
    links = scratch.save(seeds.join(first.hint("merge"), "h").filter("rid <> e").select("rid", "pos", "e", "epos"), "links")
    scratch.free(first)
    wants = scratch.save(links.select("rid", "e", "epos").mapInArrow(_wants, "rid long, e long, block int").distinct(), "wants")
    asked = wants.groupBy("e").agg(F.collect_set("block").alias("blocks"))
    sources = base.select("rid", "text").join(asked.withColumnRenamed("e", "rid").hint("merge"), "rid")
    blocks = scratch.save(sources.select("rid", "text", "blocks").mapInArrow(_blocks, "e long, block int, words binary"), "blocks")
    near = scratch.save(wants.join(blocks.hint("merge"), ["e", "block"]).select("rid", "e", "block", "words"), "near")
    scratch.free(wants), scratch.free(blocks)

    listed = links.groupBy("rid").agg(F.collect_list(F.struct("pos", "e", "epos")).alias("links"))
    fetched = near.groupBy("rid").agg(F.collect_list(F.struct("e", "block", "words")).alias("blocks"))
    sides = base.join(listed.hint("merge"), "rid", "left").join(fetched.hint("merge"), "rid", "left").select("rid", "doc_id", "text", "links", "blocks")
    made = f"rid long, doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPANS}, at array<int>, k1 array<long>, k2 array<long>, rest string"
    done = scratch.save(sides.mapInArrow(_extend, made), "extended")
    for used in (base, links, near):
        scratch.free(used)

    left = done.select("rid", F.explode(F.arrays_zip("at", "k1", "k2")).alias("x")).select("rid", "x.at", "x.k1", "x.k2")
    again = scratch.save(left.groupBy("k1", "k2").agg(F.min("rid").alias("e"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "again")
    later = left.join(again.hint("merge"), ["k1", "k2"]).filter("rid <> e").groupBy("rid").agg(F.collect_list("at").alias("later"))
    cut = done.filter("rest is not null").join(later.hint("merge"), "rid", "left").select("doc_id", F.col("rest").alias("text"), "spans", "later")
    cut = cut.mapInArrow(_finish, f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {SPANS}")
    return done.filter("rest is null").select(*RESULT).union(cut)
