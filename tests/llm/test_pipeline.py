"""The stages against a plain restatement, each on its own input."""

import numpy as np
from test_dedup import plain_fingerprint, plain_removal, union
from test_texts import plain_rules

import corpus_pipeline
from quire.llm import packing, pii, suffix


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, *middle, last = [f for _, f in corpus_pipeline.STAGES]
    rows = {r.doc_id: r for r in docs.collect()}

    kept = first(spark, docs, sf).collect()
    assert {r.doc_id for r in kept} == {d for d, r in rows.items() if plain_rules(r.text)[-1]}

    told = spark.createDataFrame(kept, docs.schema)
    ids = sorted(r.doc_id for r in kept)
    fps = [plain_fingerprint(rows[d].text) for d in ids]
    root = union(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    single = middle[0](spark, told, sf).collect()
    assert {r.doc_id for r in single} == {ids[i] for i in root}

    told = spark.createDataFrame(single, docs.schema)
    pairs = sorted((r.doc_id, r.text) for r in single)
    want = {d: suffix.whole_characters(np.frombuffer(t.encode(), np.uint8), m).decode() if len(t) else t for (d, t), m in zip(pairs, plain_removal(pairs))}
    cut = middle[1](spark, told, sf).collect()
    assert {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in cut} == {d: (t, len(t), rows[d].lang, rows[d].source) for d, t in want.items()}

    told = spark.createDataFrame(cut, docs.schema)
    clean = middle[2](spark, told, sf).collect()
    anchors = pii.Anchors()
    assert {r.doc_id: (r.text, r.n_chars) for r in clean} == {d: (x := pii.redact_text(t, anchors), len(x)) for d, t in want.items()}

    pieces = last(spark, spark.createDataFrame(clean, docs.schema), sf).toPandas()
    bpe = packing.ByteBpe(__import__("public_tokenizers").path(packing.VOCABULARY))
    texts = {r.doc_id: r.text for r in clean}
    for d, p in pieces.sort_values("start").groupby("doc_id"):
        assert [x for own in p.ids for x in own] == [*bpe.encode(texts[d]), 0]
    assert set(pieces.doc_id) == set(texts)

    whole = corpus_pipeline.run(spark, sf).toPandas()
    key = lambda d: sorted(zip(d.doc_id, d.start, d.length, d.ids_crc32))
    assert key(whole) == key(pieces) and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_nothing(spark, edge_docs):
    for df in (edge_docs, edge_docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
