"""The pipeline against the stages' SQL, applied in turn to what the stage before has kept."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from evidra.llm import oracles

DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM {0}"


def _mixed(con) -> Counter:
    """(doc_id, text) as often as the mix takes them; every document of the stage has words."""
    taken = con.sql(f"SELECT o.doc_id, d.text, o.size, o.taken FROM ({oracles.OP4}) o JOIN documents d USING (doc_id)").fetchall()
    assert all(size for _, _, size, _ in taken)
    return Counter({(i, text): n // size for i, text, size, n in taken if n})


def test_stages_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS {DOCUMENTS.format(repr(f'{sf}/documents.parquet'))}")
    near = oracles.OP3.replace("85 * (a.n", "80 * (a.n")
    assert near != oracles.OP3
    steps = {
        "quality rules": f"SELECT d.* FROM documents d JOIN ({oracles.OP10}) v USING (doc_id) WHERE v.kept",
        "line dedup": f"SELECT d.doc_id, r.text, d.lang, d.source, CASE WHEN r.n_removed > 0 THEN length(r.text) ELSE d.n_chars END AS n_chars FROM documents d JOIN ({oracles.OP7}) r USING (doc_id)",
        "near dedup": f"SELECT d.* FROM documents d JOIN ({near}) k USING (doc_id) WHERE k.kept",
    }
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        con.execute(f"CREATE OR REPLACE TABLE documents AS {steps[name]}")
        want = Counter(con.sql(DOCUMENTS.format("documents")).fetchall())
        assert Counter(tuple(r) for r in out.collect()) == want, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert dict(corpus_pipeline.STAGES[3:]).keys() == {"mixing", "packing"}
    mixed = corpus_pipeline.mixing(spark, docs, sf).collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == _mixed(con)


def test_run_packs_what_the_stages_keep(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    want: Counter = Counter()
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want.update((r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
