"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Pieces and scores come from a BPE model with byte fallback. A text is cut into units, over which no
piece reaches: runs of spaces with the letters after them, and runs of other characters (runs of
spaces with all that follows them if the model has pieces that mix letters and others). In each unit candidate merges wait
in an agenda ordered by score, then place; a candidate that comes up is skipped, for good, by a draw
of its own at the dropout rate. The draws of a unit are the bits of one number, a bit for each
candidate in the order in which they come up; the numbers are hashes keyed by seed, document and
the copy's turn, and the unit's place in the text. So every occurrence is varied by itself and stays
reproducible. What is remembered is free of seeds: the ids of a unit without skips. With dropout 0 the
ids are those of the library.

Short units that are new in a batch go through their agendas side by side, one candidate of each
unit a step, in arrays with a row for each unit; long or unusual ones take the agenda alone.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import Recent, joined, slices

SPACE = "▁"
CACHE = 50_000  # a worker outlives its tasks and holds twice as many units, with those of the batch
LETTER, OTHER = "[^\\W\\d_²³¹]", f"(?:[\\W\\d_²³¹](?<!{SPACE}))"
#: Runs of letters and of others apart, and whole words for models whose pieces mix them.
APART = re.compile(f"{SPACE}*{LETTER}+|{SPACE}*{OTHER}+|{SPACE}+")
WHOLE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MIXED = re.compile(f"{LETTER}{OTHER}|{OTHER}{LETTER}")
SHORT = 22  # an agenda of n characters draws at most 3 (n - 1) bits, so 64 do
MASK = (1 << 64) - 1
LOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)  # by how many of the lowest bits are set
DRAW_BITS = 12  # the dropout rate is rounded to 1/4096


GOLDEN = 0x9E3779B97F4A7C15
STEP = np.uint64(0xD1B54A32D192ED03)
BLANK = 0


@functools.cache
def char_kinds() -> np.ndarray:
    """By code point: the mark for spaces, other characters, letters."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.ones(0x110000, np.uint8)
    for m in re.finditer(f"{LETTER}+", every):
        kinds[m.start() : m.end()] = 2
    kinds[ord(SPACE)] = BLANK
    return kinds


def _hash(x: np.ndarray) -> np.ndarray:
    """A mix of 64 bits in which each bit of x changes half of the result's."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _places(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A number for each unit: its document's key and its place in the document."""
    ends = np.cumsum(count)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + 1
    with np.errstate(over="ignore"):
        return np.repeat(keys, count) + place.astype(np.uint64) * np.uint64(GOLDEN)


def _skips(numbers: np.ndarray, limit: int) -> np.ndarray:
    """For each number 64 independent draws as bits, each set at the rate limit / 2^DRAW_BITS: random
    words are joined by and, or by or, as the digits of the rate say from the last one set."""
    out = np.zeros(len(numbers), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(DRAW_BITS):
            digit = limit >> k & 1
            if digit or limit & ((1 << k) - 1):
                word = _hash(numbers + np.uint64(k) * STEP)
                out = out | word if digit else out & word
    return out


class Pieces:
    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.text = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        by_id = [self.text.get(i, b"") for i in range(n)]
        self.raw, self.raw_sizes = np.frombuffer(b"".join(by_id), np.uint8), np.fromiter(map(len, by_id), np.int64, n)
        self.units = WHOLE if any(map(MIXED.search, self.ids)) else APART
        self.limit, self.seed = min(round(dropout * (1 << DRAW_BITS)), (1 << DRAW_BITS) - 1), seed
        self.pairs, self.pair_scores, self.pair_ids = self._pairs()
        self.chars = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        self.plain = Recent(CACHE)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted codes of all pairs of pieces that merge, with the score and id of what they give."""
        ids = self.ids
        found = [(ids[p[:k]] << 32 | ids[p[k:]], self.scores[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        found.sort()
        codes, scores, made = zip(*found, strict=True) if found else ((-1,), (np.inf,), (0,))
        return np.array(codes, np.int64), np.array(scores, np.float64), np.array(made, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.pair_scores[at], np.inf), self.pair_ids[at]

    def _side_by_side(self, sym: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sym: ids of single characters, a row for each unit, skips: its draws. (final ids, how many in each row, draws used)."""
        count, n = sym.shape
        ends, before = np.tile(np.arange(1, n + 1), (count, 1)), np.tile(np.arange(-1, n - 1), (count, 1))
        score, made = np.full((count, n), np.inf), np.zeros((count, n), np.int64)
        score[:, :-1], made[:, :-1] = self._look(sym[:, :-1], sym[:, 1:])
        rows, drawn = np.arange(count), np.zeros(count, np.int64)
        while len(rows):
            a = score[rows].argmin(1)
            live = score[rows, a] < np.inf
            rows, a = rows[live], a[live]
            r, b = rows, ends[rows, a]
            skip = (skips[r] & np.uint64(1)).astype(bool)
            skips[r] >>= np.uint64(1)
            drawn[r] += 1
            if skip.any():
                score[r[skip], a[skip]] = np.inf
                r, a, b = r[~skip], a[~skip], b[~skip]
            c = ends[r, b]
            sym[r, a], ends[r, a], ends[r, b] = made[r, a], c, 0
            score[r, a] = score[r, b] = np.inf
            more = c < n
            x, y, z = r[more], a[more], c[more]
            before[x, z] = y
            score[x, y], made[x, y] = self._look(sym[x, y], sym[x, z])
            left = before[r, a]
            more = left >= 0
            x, y, z = r[more], left[more], a[more]
            score[x, y], made[x, y] = self._look(sym[x, y], sym[x, z])
        kept = ends > 0
        return sym[kept].astype("<u4"), kept.sum(1), drawn

    def _new(self, units: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids in order, how many each unit has, how many draws it used) of units with their draws."""
        length = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(length, kind="stable")
        where, flat, sizes, drawn = [], [], [], []
        for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            n, alone = int(length[same[0]]) if len(same) else 0, same
            if n <= SHORT and len(same) >= 8:
                sym = self.chars[np.frombuffer("".join([units[k] for k in same.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)]
                plain = (sym >= 0).all(1)
                made = self._side_by_side(sym[plain], skips[same[plain]])
                for kept, x in zip((where, flat, sizes, drawn), (same[plain], *made), strict=True):
                    kept.append(x)
                alone = same[~plain]
            made = [self._alone(units[k], int(skips[k])) for k in alone.tolist()]
            where.append(alone), flat.append(np.frombuffer(b"".join([ids for ids, _ in made]), "<u4"))
            sizes.append(np.array([len(ids) // 4 for ids, _ in made], np.int64)), drawn.append(np.array([d for _, d in made], np.int64))
        back = np.argsort(np.concatenate(where))
        sizes = np.concatenate(sizes)
        return joined(np.concatenate(flat), sizes, back)[0], sizes[back], np.concatenate(drawn)[back]

    def segment(self, unit: str, skips: int) -> tuple[list[str], int]:
        """Symbols of one unit after the agenda is empty, and how many draws were used."""
        n, scores = len(unit), self.scores
        ends = list(range(1, n + 1))  # by the start of a symbol: where it ends; 0 once merged into its left
        before = list(range(-1, n - 1))
        agenda = [(scores[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in scores]
        heapq.heapify(agenda)
        drawn = 0
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            if ends[a] != b or ends[b] != c:
                continue
            skip, skips, drawn = skips & 1, skips >> 1, drawn + 1
            if skip:
                continue
            ends[a], ends[b] = c, 0
            if c < n:
                before[c] = a
                piece = unit[a : ends[c]]
                if piece in scores:
                    heapq.heappush(agenda, (scores[piece], a, c, ends[c]))
            left = before[a]
            if left >= 0:
                piece = unit[left:c]
                if piece in scores:
                    heapq.heappush(agenda, (scores[piece], left, a, c))
        out, i = [], 0
        while i < n:
            out.append(unit[i : ends[i]])
            i = ends[i]
        return out, drawn

    def _alone(self, unit: str, skips: int, literal: str | None = None) -> tuple[bytes, int]:
        ids: list[int] = []
        symbols, drawn = self.segment(unit, skips)
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                ids += [self.bytes[b] for b in (SPACE if s == literal else s).encode("utf-8", "surrogatepass")]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes(), drawn

    def _unit(self, unit: str, skips: int, literal: str | None = None) -> bytes:
        return self._alone(unit, skips, literal)[0]

    def _draws(self, key: int, place: int, count: int) -> np.ndarray:
        """count draws at the dropout rate for one long unit."""
        base = np.array([(key + (place + 1) * GOLDEN) & MASK], np.uint64)
        return np.unpackbits(_skips(np.repeat(base, -(-count // 64)) + np.arange(-(-count // 64), dtype=np.uint64) * STEP, self.limit).view(np.uint8), bitorder="little")[:count].astype(bool)

    def _keys(self, docs: list[int], turns: list[int]) -> np.ndarray:
        signed = lambda x: np.array(x, np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return _hash((signed(docs) ^ np.uint64(self.seed * GOLDEN & MASK)) + _hash(signed(turns)))

    def _cut(self, text: str, doc: int, turn: int = 0) -> tuple[list[str], list[int]]:
        """Units with the draws of each."""
        units = self.units.findall(SPACE + text.replace(" ", SPACE))
        if not self.limit:
            return units, [0] * len(units)
        keys = self._keys([doc], [turn])
        skips = _skips(_places(keys, np.array([len(units)])), self.limit).tolist()
        for k, unit in enumerate(units):
            if len(unit) > SHORT:
                skips[k] = self._long(unit, int(keys[0]), k)
        return units, skips

    def _long(self, unit: str, key: int, k: int) -> int:
        return int.from_bytes(np.packbits(self._draws(key, k, 3 * len(unit)), bitorder="little").tobytes(), "little")

    def _marked(self, text: str, doc: int, turn: int) -> bytes:
        """A literal mark is kept apart from spaces, as bytes."""
        literal = next(c for c in map(chr, itertools.chain(range(0xE000, 0xF8FF), range(0xF0000, 0x10FFFE), range(0x4E00, 0xD800))) if c not in text and c not in self.ids)
        return b"".join([self._unit(u, v, literal) for u, v in zip(*self._cut(text.replace(SPACE, literal), doc, turn), strict=True)])

    def _plain(self, units: list[str]) -> list[tuple[bytes, int]]:
        """By unit: ids without skips, and how many draws these need to be 0."""
        have = self.plain.many(units)
        new = [u for u, got in zip(units, have, strict=True) if got is None]
        flat, sizes, drawn = self._new(new, np.zeros(len(new), np.uint64))
        raw, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
        made = {}
        for u, s, e, d in zip(new, [0, *ends[:-1]], ends, drawn.tolist(), strict=False):
            made[u] = got = (raw[s:e], d)
            self.plain.put(u, got)
        return [made[u] if got is None else got for u, got in zip(units, have, strict=True)]

    def _parted(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units, which of these the texts are made of in order, how many of them each text has)."""
        if self.units is not APART:
            found = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
            coded = pa.array([u for f in found for u in f], pa.string()).dictionary_encode()
            return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.array(list(map(len, found)), np.int64)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        chars = np.frombuffer("".join([SPACE + t.replace(" ", SPACE) for t in texts if t]).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(chars):
            return [], np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = char_kinds()[chars]
        before = np.append(np.uint8(9), kind[:-1])
        cut = (kind != before) & (before != BLANK)
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[sizes > 0]
        cut[begins] = True
        width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
        at = np.flatnonzero(cut)
        stops = np.append(0, np.cumsum(width, dtype=np.int64))[np.append(at, len(chars))]
        raw = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        units = [u.decode("utf-8", "surrogatepass") for u in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        return units, coded.indices.to_numpy(), np.diff(np.searchsorted(at, np.append(0, ends)))

    def encode_batch(self, texts: list[str], docs: list[int], turns: list[int] | None = None) -> list[np.ndarray]:
        """Ids of each text; turns tell copies of a document apart.

        A unit whose draws spare all that its agenda without skips uses has the ids without skips. The
        ids of others are made once for each distinct unit and draws in the batch.
        """
        turns = turns or [0] * len(texts)
        units, which, count = self._parted(["" if SPACE in t else t for t in texts])
        have = self._plain(units)
        parts, use = [h[0] for h in have], which.astype(np.int64)  # ids of distinct units, and which of them stand where
        flat, sizes = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ends = np.cumsum(count)
        if self.limit and len(which):
            keys = self._keys(docs, turns)
            skips = _skips(_places(keys, count), self.limit)
            size = np.array([len(u) for u in units])
            needed = LOW[np.minimum(np.array([h[1] for h in have]), 64)]
            able = LOW[np.minimum(3 * (size - 1), 64)]  # all that a unit's agenda can use
            short = size[which] <= SHORT
            at = np.flatnonzero(short & ((skips & needed[which]) != 0))
            owner, draws = which[at], (skips & able[which])[at]
            order = np.lexsort((draws, owner))
            fresh = np.append(True, (owner[order][1:] != owner[order][:-1]) | (draws[order][1:] != draws[order][:-1]))[: len(order)]
            kind = np.empty(len(at), np.int64)
            kind[order] = np.cumsum(fresh) - 1
            head = order[fresh]
            varied, long, _ = self._new([units[k] for k in owner[head].tolist()], draws[head])
            use[at] = len(sizes) + kind
            flat, sizes, alone = np.concatenate([flat, varied]), np.concatenate([sizes, long]), []
            text_of = np.repeat(np.arange(len(texts)), count)
            for k in np.flatnonzero(~short).tolist():
                i = int(text_of[k])
                unit = units[which[k]]
                use[k] = len(sizes) + len(alone)
                alone.append(np.frombuffer(self._unit(unit, self._long(unit, int(keys[i]), k - int(ends[i] - count[i]))), "<u4"))
            flat, sizes = np.concatenate([flat, *alone]), np.append(sizes, list(map(len, alone))).astype(np.int64)
        flat, stops = joined(flat, sizes, use)
        bounds = np.append(0, stops)[np.append(0, ends)].tolist()
        return [np.frombuffer(self._marked(t, d, n), "<u4") if SPACE in t else flat[a:z] for t, d, n, a, z in zip(texts, docs, turns, bounds, bounds[1:], strict=False)]

    def encode(self, text: str, doc: int = 0) -> np.ndarray:
        return self.encode_batch([text], [doc])[0]

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids that decode() gives, of many documents at once."""
        flat, ends = joined(self.raw, self.raw_sizes, np.concatenate([*ids, np.zeros(0, np.uint32)]))
        bounds, data = np.append(0, ends)[np.append(0, np.cumsum(list(map(len, ids)), dtype=np.int64))].tolist(), flat.tobytes()
        return [data[a + 1 : z].decode("utf-8", "surrogatepass") if z > a else "" for a, z in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids) -> str:
        text = self.text
        return b"".join(map(text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:].decode("utf-8", "surrogatepass")


#: Bytes of text whose units are held at once; lists of them take many times as much.
HELD = 1 << 20


@functools.cache
def pieces_of(path: str, dropout: float, seed: int) -> Pieces:
    """One for each Python worker, so that what it remembers outlives a task."""
    return Pieces(path, dropout, seed)


def encode_pieces(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 42, columns: tuple[str, ...] = (), turns: bool = False) -> DataFrame:
    """Per row: the given columns of docs, doc_id, text, ids (array<int>), decoded.

    Null text counts as empty and gives no ids; texts are taken by bytes, a very long one alone. With turns, rows equal in doc_id and text are numbered
    and each is segmented by draws of its own; else they are segmented alike. A null doc_id is keyed as 0. Columns named text, ids or decoded of docs are not passed on.
    """
    extra = [c for c in columns if c not in ("doc_id", "text", "ids", "decoded")]
    rows = docs.select(*extra, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    width = len(rows.columns)
    schema = StructType(list(rows.schema.fields)).add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    at, names = len(extra), [f.name for f in schema]
    number = "turn"
    while number in {n.lower() for n in names}:
        number += "_"
    if turns:
        copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
        rows = rows.select("*", (F.row_number().over(copies) - 1).alias(number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, dropout, seed)
        for whole in batches:
            for b in slices(whole, at + 1, HELD):
                ids = pieces.encode_batch(b.column(at + 1).to_pylist(), [d or 0 for d in b.column(at).to_pylist()], b.column(width).to_pylist() if turns else None)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(pieces.decode_batch(ids), pa.string())], names)

    return rows.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 42) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (ids as little-endian uint32), decoded_sha256, lossless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, dropout, seed)
        for b in (some for whole in batches for some in slices(whole, 1, HELD)):
            n, crc, sha, same = [], [], [], []
            texts = b.column(1).to_pylist()
            coded = pieces.encode_batch(texts, [d or 0 for d in b.column(0).to_pylist()])
            for text, ids, back in zip(texts, coded, pieces.decode_batch(coded), strict=True):
                n.append(len(ids)), crc.append(zlib.crc32(ids.tobytes())), sha.append(hashlib.sha256(back.encode()).hexdigest()), same.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
