"""Token ids in grammar-compressed shards.

File format: Parquet rows, one for each shard of about SHARD ids: part and shard (their order is
the order of the ids), doc_ids and doc_lens (little-endian int64), rules (pairs of uint32: rule k
expands symbol first+k), lens (uint32 expansion length of each rule), seq (the compressed
symbols, uint16 where they fit, else uint32) and n_ids. Re-Pair builds the rules within a shard:
frequent adjacent pairs become nonterminals, round after round, until no pair occurs LEAST times.
A round replaces many pairs at once: where occurrences touch, the more frequent pair wins, and
equal ones take turns from the left. A symbol that ends in the end id never starts a pair, so no
symbol reaches over a document's end, and the lengths give any document's place without
expanding what lies before it.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Recent, joined, partitions, slices

SHARD = 1 << 20
LEAST = 8
SPREAD = np.uint64(0x9E3779B97F4A7C15)
CACHE = 300_000
SHARD_SCHEMA = "part int, shard int, n_ids long, first long, doc_ids binary, doc_lens binary, rules binary, lens binary, wide boolean, seq binary"


def repair(ids: np.ndarray, first: int, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules[k] = the two symbols that first + k stands for, expansion length of each rule)."""
    seq = ids.astype(np.uint32)
    rules, lens, closed = np.zeros((0, 2), np.uint32), np.zeros(0, np.int64), np.arange(first) == end_id
    hot = np.flatnonzero(~closed[seq[:-1]])  # where a pair can be frequent: counts only fall, but for pairs with a new symbol
    while len(hot):
        cell_of = lambda pairs, bits: ((pairs * SPREAD) >> np.uint64(64 - bits)).view(np.int64)
        pair = seq[hot].astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= seq[hot + 1]
        cell = cell_of(pair, len(hot).bit_length())
        busy = (np.bincount(cell) >= LEAST)[cell]  # only in these can a pair be frequent
        at, some = hot[busy], pair[busy]
        mark = np.zeros(len(seq), bool)
        mark[at] = True
        kinds, times = np.unique(some, return_counts=True)
        kinds, times = kinds[times >= LEAST], times[times >= LEAST].astype(np.int32)
        if not len(kinds):
            break
        bits = len(seq).bit_length()
        kind_of = np.zeros(1 << bits, np.int32)
        rise = np.argsort(times, kind="stable")
        kind_of[cell_of(kinds[rise], bits)] = rise  # of kinds that share a cell, the most frequent goes first
        which = kind_of[cell_of(some, bits)]
        hit = kinds[which] == some
        at, which = at[hit], which[hit]
        weight = np.zeros(len(seq) + 1, np.int32)
        weight[at + 1] = own = times[which]
        best = (own >= weight[at]) & (own >= weight[np.minimum(at + 2, len(seq))])
        at, which = at[best], which[best]
        fresh = np.concatenate([[True], np.diff(at) > 1])  # of places that touch, every other one from the left
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        take = (np.arange(len(at)) - run) % 2 == 0
        at, which = at[take], which[take]
        used = np.bincount(which, minlength=len(kinds)) >= LEAST // 2  # the most frequent pair always is
        name = np.cumsum(used) - 1 + first + len(rules)
        take = used[which]
        at, which = at[take], which[take]
        kinds = kinds[used]
        new = np.stack([kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        known = np.concatenate([np.ones(first, np.int64), lens])
        lens = np.concatenate([lens, known[new].sum(1)])
        closed = np.concatenate([closed, closed[new[:, 1]]])
        rules = np.concatenate([rules, new])
        seq[at] = name[which]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        mark[at] = mark[np.maximum(at - 1, 0)] = True
        seq, mark = seq[keep], mark[keep]
        hot = np.flatnonzero(mark[:-1] & ~closed[seq[:-1]])
    return seq, rules, lens


def expand(symbols: np.ndarray, rules: np.ndarray, lens: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for: each nonterminal puts its two parts where it stood."""
    width = np.concatenate([np.ones(first, np.int64), lens.astype(np.int64)])
    now = symbols.astype(np.int64)
    size = width[now]
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    while len(now):
        leaf = now < first
        out[place[leaf]] = now[leaf]
        now, place = now[~leaf], place[~leaf]
        left, right = rules[now - first].T.astype(np.int64)
        now, place = np.concatenate([left, right]), np.concatenate([place, place + width[left]])
    return out


# Kinds of bytes: a text may be cut between two of LETTER, DIGIT and MARK, and between digits.
BLANK, LETTER, DIGIT, MARK, LEAD, OTHER = range(6)
BYTE = np.full(256, OTHER, np.uint8)
BYTE[33:127] = MARK
BYTE[list(b" \t\n\x0b\x0c\r")] = BLANK
BYTE[[c for c in range(128) if chr(c).isalpha()]] = LETTER
BYTE[[c for c in range(128) if chr(c).isdigit()]] = DIGIT
BYTE[ord("'")] = OTHER
BYTE[0xC3] = LEAD
PLAIN = re.compile(rb"(?:[!-&(-~]|\xc3(?![\x97\xb7])[\x80-\xbf])+")


class UnitEncoder:
    """Ids of whole texts by a tokenizer that drops white space, lowers case and keeps runs of
    letters, single digits and runs of marks apart.

    Texts are cut where the tokenizer cuts in any case: at ASCII white space and between ASCII or
    Latin-1 letters, digits and ASCII marks; never next to an apostrophe or another character.
    Distinct units are encoded once and remembered. A text with one of the tokenizer's added
    tokens in it is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.ends = ends
        self.known = Recent(CACHE)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Units of letters, digits or marks alone are one word each, so many are encoded in one
        text and parted at the ends of words; others are encoded one by one."""
        plain = list(filter(PLAIN.fullmatch, units))
        rest = sorted(set(units).difference(plain))
        out = {u: ids.tobytes() for u, ids in zip(rest, self._raw([u.decode("utf-8", "replace") for u in rest]), strict=True)}
        for at in range(0, len(plain), 250):
            some = plain[at : at + 250]
            ids = self._raw([b" ".join(some).decode()])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            raw, begin = ids.tobytes(), 0
            assert len(stops) == len(some)
            for u, stop in zip(some, (4 * stops).tolist(), strict=True):
                out[u], begin = raw[begin:stop], stop
        return out

    def units(self, texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
        """All units of the texts in order, and how many each text has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        kind = BYTE[data]
        nxt = np.append(data[1:], 0)
        accent = (kind == LEAD) & (nxt >= 0x80) & (nxt != 0x97) & (nxt != 0xB7)  # C3 80 to C3 BF are letters but for two
        kind[accent] = LETTER
        kind[np.flatnonzero(accent) + 1] = LETTER
        kind[kind == LEAD] = OTHER
        after = np.append(kind[1:], BLANK)
        lower = data.copy()
        calm = after != OTHER  # a combining mark could follow
        lower[(data >= 65) & (data <= 90) & calm] += 32
        second = np.append(False, accent[:-1]) & (data < 0x9F) & (data != 0x97) & calm
        lower[second] += 32
        before = np.append(np.uint8(BLANK), kind[:-1])
        cut = (kind != BLANK) & ((before == BLANK) | ((kind != before) & (kind != OTHER) & (before != OTHER)) | ((kind == DIGIT) & (before == DIGIT)))
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[starts] = kind[starts] != BLANK
        solid = kind != BLANK
        bounds = np.append(np.cumsum(solid, dtype=np.int32)[cut] - 1, np.int32(solid.sum()))
        made = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(lower[solid])])
        return made, np.diff(np.append(np.int32(0), np.cumsum(cut, dtype=np.int32))[offsets])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); texts without nulls."""
        hints = [pc.match_substring(texts, t) for t in self.added]
        special = {i: texts[i].as_py() for i in np.flatnonzero(np.any([h.to_numpy(zero_copy_only=False) for h in hints], axis=0)).tolist()} if hints else {}
        if special:
            texts = pa.array(["" if i in special else t for i, t in enumerate(texts.to_pylist())], pa.string())
        units, count = self.units(texts)
        coded = units.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = self.known.many(words)
        fresh = self._learn([w for w, g in zip(words, got, strict=True) if g is None])
        for w, ids in fresh.items():
            self.known.put(w, ids)
        got = [fresh[w] if g is None else g for w, g in zip(words, got, strict=True)]
        ids, ends = joined(np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4, coded.indices.to_numpy())
        sizes = np.diff(np.append(0, ends)[np.append(0, np.cumsum(count))])
        if special:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, t in special.items():
                parts[i] = self._raw([t])[0]
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, sizes


@functools.cache
def encoder_of(path: str) -> UnitEncoder:
    """One for each Python worker, so that what it remembers outlives a task."""
    return UnitEncoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes whole texts and writes the shards in ascending doc_id order, null doc_id first.

    Null text counts as empty and gives the end id alone. A shard is closed once it holds SHARD ids, which is
    looked at after every two million bytes of text, so only a single longer text makes a larger one. Rows that repeat a doc_id stay next to
    each other, in text order. Other columns are ignored; an empty table writes no shard.
    """
    first = vocabulary_size(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard
            ids, lens = (np.concatenate([h[j] for h in held]) for j in (1, 2))
            names = np.concatenate([h[0].fill_null(-(1 << 63)).to_numpy() for h in held])
            held.clear()
            seq, rules, sizes = repair(ids, first, end_id)
            wide = first + len(rules) > 1 << 16
            row = {
                "part": part, "shard": shard, "n_ids": len(ids), "first": first, "doc_ids": names.astype("<i8").tobytes(), "doc_lens": lens.astype("<i8").tobytes(),
                "rules": rules.astype("<u4").tobytes(), "lens": sizes.astype("<u4").tobytes(), "wide": wide, "seq": seq.astype("<u4" if wide else "<u2").tobytes(),
            }
            shard += 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for b in batches:
            for some in slices(b, 1, 2 * SHARD):  # of about half a shard's ids
                ids, sizes = encoder.encode(some.column(1))
                held.append((some.column(0), np.insert(ids, np.cumsum(sizes), end_id), sizes + 1))
                if sum(len(h[1]) for h in held) >= SHARD:
                    yield flush()
        if held:
            yield flush()

    rows.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


def _shard(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    seq = np.frombuffer(row["seq"], "<u4" if row["wide"] else "<u2")
    return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_lens"], "<i8"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lens"], "<u4"), seq


def read_document(row: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of one shard; expands that document only."""
    _, lens, rules, sizes, seq = _shard(row)
    ends = np.cumsum(np.concatenate([np.ones(row["first"], np.int64), sizes.astype(np.int64)])[seq])
    begin = int(lens[:k].sum())
    return expand(seq[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, begin + int(lens[k]), "left") + 1], rules, sizes, row["first"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                names, lens, rules, sizes, seq = _shard(row)
                raw = expand(seq, rules, sizes, row["first"]).astype("<u4")
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends, lens, strict=True)]
                doc = pa.array(names, pa.int64(), mask=names == -(1 << 63))
                k = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, row["part"], np.int32)), pa.array(np.full(k, row["shard"], np.int32)), doc, pa.array(ends - lens), pa.array(lens), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(run, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))  # a row for each partition
    places = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("at")).join(parts, "part").select("part", "shard", (F.col("base") + F.col("at")).alias("base"))
    return docs.join(places.hint("merge"), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
