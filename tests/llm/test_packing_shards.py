"""Documents that share most of their tokens meet in a shard, however many shards their first route token fills."""

import random

import public_tokenizers

from quire.llm import packing


def test_like_documents_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 4000)
    r = random.Random(3)
    rare = [a + b for a in ("crystal", "harbour", "velvet", "thunder", "lantern", "meadow") for b in ("smith", "wright", "stone", "field", "wood", "bridge", "port", "gate")]
    words = rare + ["moreover", "hydrogen", "museum", "telescope", "bishop", "carpet", "quantum", "violin", "pepper", "glacier", "sermon", "ribbon"]
    rows = []
    for i in range(250):  # each text twice, in another order of words; one word is in nearly all
        own = r.choices(words, k=40) + ["telescope"]
        rows.append((2 * i, " ".join(own)))
        rows.append((2 * i + 1, " ".join(reversed(own))))
    rows += [(1000 + i, "the very same text of a large group") for i in range(2000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 256).collect()
    shard = {p.doc_id: p.sequence_id >> 32 for p in out}
    assert len(shard) == len(rows)
    assert sum(shard[2 * i] == shard[2 * i + 1] for i in range(250)) >= 245
    tokens = {}
    for p in out:
        tokens[p.sequence_id >> 32] = tokens.get(p.sequence_id >> 32, 0) + p.length
    assert len(tokens) > 8 and max(tokens.values()) <= 2 * 4000
