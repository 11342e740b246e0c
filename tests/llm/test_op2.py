import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmill.llm.op2_token_store import OBJECT_DDL, WordEncoder, digests, documents_of, merkle, write_store

PATH = public_tokenizers.path("word_bpe_49k.json")
SHARED = "The quick brown fox, jumps over it's 12 lazy dogs!! "
TEXTS = {
    7: SHARED * 40 + "one end", 3: SHARED * 40 + "another", 5: None, 4: "", 9: " \n\t ", 1: "Été ÊTRE naïvé é İstanbul Σίσυφος don't y'all've #*$%&|<> <|endoftext|>x<|startoftext|>",
    2: "日本語 テキスト 한국어　x y \x1c z åÅ J̌ 1234567", 12: "ab" * 3000, 11: "A," * 4000 + SHARED * 300,
}


def expected(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def test_store_round_trip(spark, tmp_path):
    rows = list(TEXTS.items())
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(3)
    write_store(df, str(tmp_path / "s"), PATH, 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in digests(spark, str(tmp_path / "s")).collect()}
    want = expected(rows)
    assert got == want
    for r in documents_of(spark, str(tmp_path / "s")).collect():
        assert (r.start, len(r.ids), zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))) == want[r.doc_id]
    chunks = spark.read.schema(OBJECT_DDL).parquet(str(tmp_path / "s/objects")).where("kind = 1")
    assert chunks.count() == chunks.select("key").distinct().count()
    parts = spark.read.parquet(str(tmp_path / "s/manifest")).collect()
    assert sum(p.n_tokens for p in parts) == sum(n for _, n, _ in want.values())
    one = spark.read.parquet(str(tmp_path / "s/recipes")).orderBy("start").collect()
    for p in parts:
        assert bytes(p.root) == merkle([bytes(r.root) for r in one if r.part == p.part])


def test_whole_table_matches_the_library(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(None, "null id")], "doc_id long, text string"), allowMissingColumns=True)
    write_store(df, str(tmp_path / "s"), PATH, 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in digests(spark, str(tmp_path / "s")).collect()}
    assert got == expected([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_repeats_empty_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (1, "others")], "doc_id long, text string")
    write_store(df, str(tmp_path / "s"), PATH, 2)
    rows = digests(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert len(rows) == 3 and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(3)]
    write_store(df.limit(0), str(tmp_path / "e"), PATH, 2)
    assert digests(spark, str(tmp_path / "e")).count() == 0
    write_store(spark.createDataFrame([(1, "aa bb")], "doc_id long, text string"), str(tmp_path / "d"), PATH, 2)
    import shutil

    shutil.rmtree(tmp_path / "d/objects")
    shutil.copytree(tmp_path / "e/objects", tmp_path / "d/objects")
    with pytest.raises(Exception, match="missing"):
        digests(spark, str(tmp_path / "d")).collect()


def test_any_text_is_encoded_as_by_the_library():
    """Words of odd letters, combining marks and punctuation, side by side."""
    import pyarrow as pa

    r = random.Random(7)
    signs = "aAbZéÉİıŁßſKÅσςΣДд日ﬁ" + "\u0301\u0307\u0327\u200d\u00ad" + ".,'!?-_;:()\"`~1२½#" + "  \u00a0\u2003\n\x1c"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(30_000)] + ["TARİHİ, son", "İ.", "abİ!'s", "it's, don'T'"]
    t, own = Tokenizer.from_file(PATH), WordEncoder(PATH)
    ids, offsets = own.encode(pa.array(texts))
    for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids, repr(texts[k])


def test_lost_files_raise(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(50)], "doc_id long, text string").repartition(4)
    write_store(df, str(tmp_path / "s"), PATH, 2)
    assert digests(spark, str(tmp_path / "s")).count() == 50
    for table in ("recipes", "manifest"):
        shutil.copytree(tmp_path / "s", tmp_path / table)
        next(p for p in sorted((tmp_path / table / table).glob("part-*.parquet"), key=lambda p: -p.stat().st_size)).unlink()
        with pytest.raises(ValueError, match="root"):
            digests(spark, str(tmp_path / table))


def test_wide_vocabularies_are_read_back(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    wide = Tokenizer(models.WordLevel({"a": 0, "b": 70_000, "[UNK]": 1}, unk_token="[UNK]"))
    wide.pre_tokenizer = pre_tokenizers.Whitespace()
    wide.save(str(tmp_path / "wide.json"))
    write_store(spark.createDataFrame([(1, "a b c b")], "doc_id long, text string"), str(tmp_path / "s"), str(tmp_path / "wide.json"), 2)
    assert spark.read.parquet(str(tmp_path / "s/store")).first().width == 4
    assert documents_of(spark, str(tmp_path / "s")).first().ids == [0, 70_000, 1, 70_000, 2]
