"""Contracted edges keep the components; batched segmentation equals the agenda alone."""

import random

from ledgerlens.llm.common import Scratch
from ledgerlens.llm.components import contract
from ledgerlens.llm.queries import tokenizer_file
from ledgerlens.llm.sentencepieces import Pieces


def roots(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in list(up)}


def test_contract_keeps_components(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(g * 100, g * 100 + 60), 2))) for g in range(5) for _ in range(30 + 60 * g)})
    got = contract(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t"))
    kept = [(r.a, r.b) for r in got.collect()]
    assert all(a < b for a, b in kept) and len(kept) < len(pairs)
    assert roots(kept) == roots(pairs)
    assert contract(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_batch_equals_agenda_alone():
    pieces = Pieces(tokenizer_file("piece_bpe_32k.model"), 0.3, 7)
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioutnrsléß") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) + rng.choice(["", ".", "\n12²,", "日本 🙂", "x" * 50]) for _ in range(20)] + ["", "   ", "a▁b  c"]
    ids = list(range(len(texts)))
    for text, doc, got in zip(texts, ids, pieces.encode_batch(texts, ids), strict=True):
        if text and "▁" not in text:
            assert got.tobytes() == b"".join(pieces._unit(u, v) for u, v in zip(*pieces._cut(text, doc), strict=False))
        assert pieces.decode(got) == text
