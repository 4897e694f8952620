"""Greedy alignment of two ordered lists as a rank alignment.

The k-th answer with a key pairs with the k-th result with that key; what is left pairs by
position. Both lists are arrays of one row, so nothing is shuffled: a task aligns the lists of a batch of rows in one
sort of all their keys, and contents stay where they are until a pair takes them by index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

ALIGNED = pa.struct([("alone", pa.bool_()), ("a_pos", pa.int64()), ("r_pos", pa.int64()), ("a_at", pa.int32()), ("r_at", pa.int32())])
ALIGNED_SQL = "array<struct<alone: boolean, a_pos: bigint, r_pos: bigint, a_at: int, r_at: int>>"


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and index in the row of each element of a list array, and the elements; null lists have none."""
    size = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), lists.flatten()


def _rank(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by all columns, and for each place of that order the rank within equal values of all but the last column."""
    order = np.lexsort(by[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in by[:-1]:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    start = np.flatnonzero(new)
    return order, np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))


def _meet(groups: list[np.ndarray], pos: np.ndarray, is_r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-th answer of a group with its k-th result: indexes of both, and what stays alone."""
    order, k = _rank(*groups, is_r, pos)
    rank = np.empty(len(pos), dtype=np.int64)
    rank[order] = k
    order = np.lexsort((is_r, rank, *groups[::-1]))
    one, two = order[:-1], order[1:]
    same = is_r[one] < is_r[two]
    for c in (*groups, rank):
        same &= c[one] == c[two]
    alone = np.ones(len(pos), dtype=bool)
    alone[one[same]] = alone[two[same]] = False
    return one[same], two[same], np.flatnonzero(alone)


def align_batch(a_keys: pa.Array, a_pos: pa.Array, r_keys: pa.Array, r_pos: pa.Array) -> pa.Array:
    """The alignment of a batch of rows, each with the keys and places of both lists."""
    (a_row, a_at, a_key), (r_row, r_at, r_key) = _flat(a_keys), _flat(r_keys)
    n = len(a_row)
    key = pa.concat_arrays([a_key.cast(pa.string()), r_key.cast(pa.string())]).fill_null("")
    coded = key.dictionary_encode()
    code, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    row, at = np.concatenate([a_row, r_row]), np.concatenate([a_at, r_at])
    pos = np.concatenate([np.asarray(x.flatten(), dtype=np.int64) for x in (a_pos, r_pos)])
    is_r = np.arange(len(row)) >= n
    blank = words.index("").as_py()
    keyed = np.flatnonzero(code != blank)
    one, two, alone = _meet([row[keyed], code[keyed]], pos[keyed], is_r[keyed])
    a, r = keyed[one], keyed[two]
    rest = np.concatenate([keyed[alone], np.flatnonzero(code == blank)])
    one, two, alone = _meet([row[rest]], pos[rest], is_r[rest])
    single = rest[alone]
    a, r = np.concatenate([a, rest[one], np.where(is_r[single], -1, single)]), np.concatenate([r, rest[two], np.where(is_r[single], single, -1)])
    of = np.where(a >= 0, row[a], row[r]) if len(row) else np.zeros(0, dtype=np.int64)
    side = (lambda x: (pos[x], at[x])) if len(row) else (lambda x: (x, x))
    (ap, aa), (rp, ra) = side(a), side(r)
    order = np.lexsort((np.where(r >= 0, rp, 0), np.where(a >= 0, ap, 0), a < 0, of))
    no_a, no_r = (a < 0)[order], (r < 0)[order]
    fields = [pa.array(no_a), pa.array(ap[order], mask=no_a), pa.array(rp[order], mask=no_r), pa.array(aa[order].astype(np.int32), mask=no_a), pa.array(ra[order].astype(np.int32), mask=no_r)]
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(a_keys)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(ALIGNED)))


def align(a_keys: Column, a_pos: Column, r_keys: Column, r_pos: Column) -> Column:
    """Keys (strings) and places (longs) of two lists -> array<struct<alone, a_pos, r_pos, a_at, r_at>>, answers first in their
    order, then results without an answer in theirs. a_at and r_at are indexes into the lists, null where there is no partner.

    An empty or null key never matches by key; places are never null."""
    return F.arrow_udf(align_batch, ALIGNED_SQL)(a_keys, a_pos, r_keys, r_pos)
