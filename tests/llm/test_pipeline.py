"""The pipeline's stages, end to end over the smallest tables."""

import os
import zlib

import numpy as np
import pytest
from test_pairs import components, jaccard
from test_texts import plain_line_dedup, squeezed

import corpus_pipeline as p
from tamis.llm import quality
from tamis.llm.registry import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    made = {}
    for name, stage in p.STAGES[:-1]:
        docs = p.save(stage(spark, docs, SF))
        assert docs.columns == columns
        made[name] = {r.doc_id: r.text for r in docs.collect()}
    first, second, third, fourth = made.values()
    assert set(first) > set() and set(second) == set(first) and set(third) <= set(second) and set(fourth) <= set(third) and len(first) < before
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = [i for i, q in labels.items() if q == 1 and i not in first]
    assert len(lost) <= 0.03 * sum(labels.values())
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i, t in fourth.items() if any(x in " ".join(t.lower().split()) for x in items)]
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == set(fourth)
    assert p.run(spark, SF).count() == pieces.count()


def least_edits(item, text):
    """The fewest edits of the whole item against any part of the text: all cells, a row at a time."""
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    step = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(map(ord, item), 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (t != c)]))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_every_stage_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    made = []
    for _, stage in p.STAGES[:-1]:
        docs = p.save(stage(spark, docs, SF))
        made.append({r.doc_id: r.text for r in docs.collect()})
    # 1: the model's own score of each text, one at a time
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert made[0] == {i: t for i, t in rows.items() if model.score(np.array([quality.features(t)]))[0] >= 0.7}
    # 2: windows in a dictionary
    want = plain_line_dedup(list(made[0].items()))
    assert made[1] == {i: want[i, t] for i, t in made[0].items()}
    # 3: all pairs
    ids = sorted(made[1])
    root = components(ids, lambda a, b: jaccard(made[1][a], made[1][b]) >= 0.8)
    assert made[2] == {i: made[1][i] for i in ids if root[i] == i}
    # 4: every item against every text whole
    items = [squeezed(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, t in made[2].items() if not any(least_edits(x, squeezed(t)) <= len(x) // 10 for x in items)}
    assert made[3] == {i: made[2][i] for i in clean} and len(clean) < len(made[2])
    # 5: the library's ids
    library, pieces = Tokenizer.from_file(vocabulary()), {}
    for i, t in made[3].items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            pieces[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    packed = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == pieces and len(packed) == len(pieces)
    held = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096 and len(held) == -(-sum(held.values()) // 4096)
