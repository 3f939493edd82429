"""The pipeline's stages and the queries' digest columns over small tables, against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from groundlake.llm import queries

from .fixtures import DOCS, clash, documents, frame, shingles
from .test_pair_operators import brute_join, brute_lines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clash(frame(spark), "component_id", "size", "_row", "n").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    """Each stage on what its predecessor kept: columns stay, decisions take effect."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    plain = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states[-1].write.mode("overwrite").parquet(f"{folder}/{name}")
        states.append(stage(spark, spark.read.parquet(f"{folder}/{name}"), folder))
        if name != "bpe":
            assert states[-1].columns == columns and states[-1].schema == docs.schema
    before, told, lines, single, mixed, encoded = states
    assert Counter(plain(told)) == Counter(x for x in plain(before) if any(c.isalpha() for c in x[1] or ""))
    assert all(r.lang for r in told.collect())
    rows = plain(told)
    assert Counter((i, t or "") for i, t in plain(lines)) == Counter((i, t) for (i, t, _, _), k in brute_lines(rows).items() for _ in range(k))
    given = {r[4] for r in documents()}
    assert all(r.n_chars == len(r.text or "") or r.n_chars in given for r in lines.collect())
    rows = plain(lines)
    groups = {c for _, n, c in brute_join(rows) if n and c is not None}
    assert {i for i, t in plain(single) if shingles(t) and i is not None} == groups
    assert sum(not shingles(t) for _, t in plain(single)) == sum(not shingles(t) for _, t in rows)
    assert set(plain(mixed)) <= set(plain(single)) and max(Counter(plain(mixed)).values()) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in plain(mixed))
    run = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.ids_sha256) for r in run.collect()) == Counter((r.doc_id, r.ids_sha256) for r in encoded.collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_media_digests(spark, folder):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in queries.op2_gif_media(spark, folder).collect())
    want = Counter()
    for i, t, *_ in documents():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert got == want
    features = {r.doc_id: r.feature for r in queries.op2_gif_media(spark, folder).collect()}
    raw = documents()[0][1].encode()
    bins = ",".join(str(sum(b >> 4 == k for b in raw.ljust(-(-len(raw) // 64) * 64, bytes(1)))) for k in range(16))
    assert features[0] == ";".join(["0", bins, bins, bins])
