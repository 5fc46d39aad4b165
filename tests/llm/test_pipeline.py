"""Every registered query of the subpackage, and the pipeline stage by stage."""

import zlib
from collections import defaultdict

import check
import numpy as np
import public_tokenizers
import pytest
from test_near_duplicates import brute
from tokenizers import Tokenizer

import corpus_pipeline
from marketloom.llm import quality, queries, substring


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, data_path, name):
    out = queries.QUERIES[name](spark, data_path)
    columns = sorted(out.columns)
    rows = [tuple(r) for r in out.select(*columns).collect()]
    assert rows
    if name in queries.ORACLES:
        sql = duck.execute("SELECT " + ", ".join(columns) + f" FROM ({queries.ORACLES[name]})").fetchall()
        assert not check.compare(rows, [tuple(r) for r in sql], columns)


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


def test_stages_against_brute_force(spark, data_path):
    docs = spark.read.parquet(f"{data_path}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{data_path}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, data_path)
    kept = {i: t for i, t in rows.items() if model.scores([(t or "").encode()])[0] >= corpus_pipeline.THRESHOLD}
    assert good.columns == columns and {r.doc_id: r.text for r in good.collect()} == kept

    one = stages["near_duplicates"](spark, good, data_path)
    label, _ = brute(list(kept.values()))
    kept = {i: t for k, (i, t) in enumerate(kept.items()) if label[k] == k}
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == kept

    clean = stages["repeated_passages"](spark, one, data_path)
    first, gone = {}, defaultdict(set)
    words = {i: (t or "").encode().split() for i, t in kept.items()}
    for i in sorted(words):
        for s in range(len(words[i]) - substring.WINDOW + 1):
            key = tuple(words[i][s:s + substring.WINDOW])
            if first.setdefault(key, (i, s)) != (i, s):
                gone[i] |= set(range(s, s + substring.WINDOW))
    kept = {i: b" ".join(w for k, w in enumerate(words[i]) if k not in gone[i]).decode() if i in gone else t for i, t in kept.items()}
    assert gone and clean.columns == columns and {r.doc_id: r.text for r in clean.collect()} == kept

    packed = stages["packing"](spark, clean, data_path).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in kept.items()}
    reached, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == reached[r.doc_id] and 0 < r.length <= 1024
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        reached[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(reached) == {i: len(v) for i, v in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole = corpus_pipeline.run(spark, data_path).collect()
    assert sorted(tuple(r)[:5] for r in whole) == sorted(tuple(r)[:5] for r in packed)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    good = " ".join(f"Word {i} follows." for i in range(40))
    rows = [(1, None), (2, ""), (None, good), (None, good + " More."), (3, good), (3, "short"), (3, "short"), (4, "x" * 300_000), (5, "y z " * 60_000), (6, " \t\n")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 1, "v") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int, _id int, `a.b` string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 7)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, frame in (("rows", docs), ("none", docs.limit(0))):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
        assert len({str(r.doc_id) for r in pieces}) == len({str(r.doc_id) for r in out.collect()})
        assert bool(pieces) == (name == "rows")
