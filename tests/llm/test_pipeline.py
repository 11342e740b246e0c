"""run() of the pipeline against a plain version of each stage, odd rows included."""

import collections
import re

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import sql
from lexmill.llm.op6_quality_classifier import trained
from lexmill.llm.op10_sentencepiece import MARK, Model

from .test_op4 import brute
from .test_op5_op8 import filled
from .test_op6 import plain_features, walk
from .test_op9_op10 import best_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 6000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    good = [r.doc_id for r in labels.where("quality = 1").orderBy("doc_id").limit(400).collect()]
    some = docs.where(F.col("doc_id").isin(good)).orderBy("doc_id").limit(6).collect()
    odd = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (None, some[0].text), (some[1].doc_id, some[2].text + " and more"), (900_004, some[4].text.upper()), (900_005, "x" * 40_000)]
    rows = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "src01", len(t or "")) for k, (i, t) in enumerate(odd)] + [tuple(some[3])], docs.schema)
    docs.unionByName(rows).withColumn("ids", F.lit("mine")).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_equals_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = [r.asDict() for r in docs.collect()]
    trees = trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    now = [r for r in now if walk(trees, plain_features(r["text"])) >= 0.7]
    assert 20 < len(now) < docs.count()

    duckdb.register("documents", pd.DataFrame({**{k: [r[k] for r in now] for k in ("text", "lang", "source")}, "doc_id": range(len(now))}))
    kept = {r[0] for r in duckdb.sql(f"select doc_id, kept from ({sql.quality_rules()})").fetchall() if r[1]}
    duckdb.unregister("documents")
    now = [r for k, r in enumerate(now) if k in kept]

    loose = [r for r in now if r["doc_id"] is None]
    apart = {(r["doc_id"], r["text"]): r for r in now if r["doc_id"] is not None}
    group = collections.defaultdict(list)
    for k, (_, root) in brute([(k, t) for k, (_, t) in enumerate(apart)], 80, 100, 5).items():
        group[root].append(list(apart)[k])
    ids = collections.Counter(i for i, _ in apart)

    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and set(rows[0].asDict()) == {*docs.columns, "ids_2"} - {"text"} and {r.ids for r in rows} == {"mine"}
    m, sp = Model(public_tokenizers.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = collections.Counter((r.doc_id, sp.decode(list(r.ids_2))) for r in rows)
    for members in group.values():
        left = [x for x in members if x in out]
        assert len(left) <= 1
        if left and all(ids[i] == 1 for i, _ in members):
            assert left == [min(members)]
    known = {(i, t) for members in group.values() for i, t in members} | {(None, r["text"]) for r in loose}
    assert set(out) <= known

    # the mix: which of a group stayed is read from the result where ids repeat
    stayed = [next((x for x in members if x in out), min(members)) for members in group.values()] + [(None, r["text"]) for r in loose]
    source = {**{k: r["source"] for k, r in apart.items()}, **{(None, r["text"]): r["source"] for r in loose}}
    size = {x: len(WORD.findall(x[1])) for x in stayed}
    names = sorted({source[x] for x in stayed}, key=lambda s: (s is None, s))
    want = filled([sum(size[x] for x in stayed if source[x] == s) for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    for s, target in zip(names, want):
        copies = [out[x] for x in stayed if source[x] == s]
        taken = sum(out[x] * size[x] for x in stayed if source[x] == s)
        assert max(copies) - min(copies) <= 1 and max(copies) <= 2
        assert abs(taken - target) <= max(size[x] for x in stayed if source[x] == s)

    pieces = {sp.id_to_piece(int(i)): (float(s), int(i)) for s, i in zip(m.viterbi.score, m.viterbi.id)}
    pieces = {p.decode(): v for p, v in zip([k.encode() for k in pieces], pieces.values())}
    for r in rows[:25]:
        text = sp.decode(list(r.ids_2))
        if len(text) < 3000:
            assert list(r.ids_2) == best_path(MARK + text.replace(" ", MARK), pieces, m.byte_ids, m.viterbi.unknown)


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
