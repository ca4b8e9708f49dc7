"""Each stage of the pipeline beside a plain statement of what it keeps, on its own input."""

import struct
import zlib

import numpy as np
import xxhash

import corpus_pipeline
from meridia.llm import mixing, packing, quality
from tests.llm.test_edges import plain_mixture
from tests.llm.test_ngrams import brute
from tests.llm.test_others import labelled


def plain_draw(doc, text):
    """A number in [0, 1) from id, text and 9: one hash seeded by the one before it."""
    h = 42
    for part in (struct.pack("<q", doc), text.encode(), struct.pack("<i", 9)):
        h = xxhash.xxh64(part, seed=h).intdigest()
    return (h >> 11) * 2.0**-53


def test_stages_follow_each_other(spark, tmp_path):
    docs, labels, rows = labelled(spark, 300)
    rows = [r if i % 10 else (r[0], rows[1][1], r[2], r[3]) for i, r in enumerate(rows)]
    rows[7] = (7, rows[7][1] + " token = q8Yt3LmZ7pXc1VbN5kRd9GhJ2wQe4SfA", "en", "a")
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "secret_scan", "source_mixing", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)).cache())
        if name != "packing":
            assert seen[-1].columns == docs.columns
    good, heads, masked, mixed = ({r.doc_id: r for r in d.collect()} for d in seen[1:5])
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    assert set(good) == {d for d, kept in scores.items() if kept} and all(good[d].text == rows[d][1] for d in good)
    assert all("$$$" not in r.text for r in good.values()) and sum("$$$" not in t for _, t, *_ in rows) - len(good) <= 15
    groups = brute([(r.doc_id, r.text) for r in good.values()])
    assert set(heads) == {d for d, (_, c) in groups.items() if c == d}
    secret = "q8Yt3LmZ7pXc1VbN5kRd9GhJ2wQe4SfA"
    assert {d: r.text for d, r in masked.items()} == {d: r.text.replace(secret, "[SECRET]") for d, r in heads.items()} and "[SECRET]" in masked[7].text
    assert all(r.n_chars == len(r.text) for r in masked.values())
    described, weight, _ = plain_mixture([(r.doc_id, r.text, r.lang, r.source) for r in masked.values()])
    wanted = {d: plain_draw(d, masked[d].text) - weight[key] * mixing.KEEP for d, key, _ in described}
    assert set(mixed) == {d for d, gap in wanted.items() if gap < 0} and min(map(abs, wanted.values())) > 1e-6
    assert all(mixed[d] == masked[d] for d in mixed)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    packed = seen[5].toPandas()
    want = {(d, zlib.crc32(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for d, r in mixed.items()}
    assert set(zip(packed.doc_id, packed.ids_crc32, strict=True)) == want and (packed.start == 0).all() and len(packed) == len(mixed)  # short texts are one piece each
    for _, q in packed.groupby("sequence_id"):
        q = q.sort_values("offset")
        assert (q.offset.to_numpy() == np.append(0, q.length.cumsum().to_numpy()[:-1])).all() and q.length.sum() <= packing.WINDOW
