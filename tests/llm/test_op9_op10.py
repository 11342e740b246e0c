import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from lexmill.llm import op10_sentencepiece, queries
from lexmill.llm.op10_sentencepiece import MARK, Model, Viterbi, decoded, decoder, encoded, encoder, round_trip
from lexmill.llm.op9_token_counts import LongestMatch, read_ranks, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, vocab, most):
    n, at = 0, 0
    while at < len(word):
        size = next((k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in vocab), 0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


def flat(words):
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


def test_longest_match_equals_greedy():
    r = random.Random(5)
    for _ in range(30):
        vocab = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(2, 12))}
        words = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 14))) for _ in range(200)]
        got = LongestMatch(sorted(vocab)).counts(*flat(words))
        assert got.tolist() == [greedy(w, vocab, 5) for w in words]


def test_token_counts(spark):
    vocab = set(read_ranks(RANKS))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "The quick  été 日本 naïve"), (5, "a" * 50_000), (6, "dup dup"), (6, "dup dup")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    got = sorted((r.doc_id, r.n_words, r.n_pieces) for r in token_counts(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int"), RANKS).collect())
    assert got == sorted((i, len((t or "").split()), sum(greedy(b" " + w.encode(), vocab, 64) for w in (t or "").split())) for i, t in rows)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def best_path(text, pieces, byte_ids, unknown):
    """Brute-force dynamic program over characters, the longest piece first, strictly better wins."""
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 40), e):  # no piece is longer
            p = text[s:e]
            if p in pieces and best[s] + pieces[p][0] > best[e]:
                best[e], back[e] = best[s] + pieces[p][0], (s, [pieces[p][1]])
        if text[e - 1] not in pieces and best[e - 1] + unknown > best[e]:
            best[e], back[e] = best[e - 1] + unknown, (e - 1, [byte_ids[b] for b in text[e - 1].encode()])
    out, e = [], len(text)
    while e:
        e, ids = back[e][0], back[e][1]
        out = ids + out
    return out


def test_viterbi_equals_brute_force():
    r = random.Random(2)
    for _ in range(30):
        names = {"".join(r.choice("abé日") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 10))}
        pieces = {p: (-r.randint(1, 9), 300 + k) for k, p in enumerate(sorted(names))}
        v = Viterbi([(p.encode(), float(s), i) for p, (s, i) in pieces.items()], list(range(256)), -30.0)
        texts = ["".join(r.choice("abé日x") for _ in range(r.randint(0, 12))) for _ in range(60)]
        counts, ids = v.encode(*flat([t.encode() for t in texts]))
        upto = np.concatenate(([0], np.cumsum(counts)))
        for k, t in enumerate(texts):
            assert ids[upto[k] : upto[k + 1]].tolist() == best_path(t, pieces, list(range(256)), -30.0)


def test_encode_whole_texts_and_back(spark):
    import sentencepiece

    m = Model(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {p.decode(): (float(s), int(i)) for p, s, i in zip([sp.id_to_piece(int(i)).encode() for i in m.viterbi.id], m.viterbi.score, m.viterbi.id)}
    rows = [(1, None), (2, ""), (3, "  two  spaces   end "), (4, "tab\tline\nnul\x00 ▁ 𝄞 日本"), (5, "x" * 3000), (6, " "), (7, "same"), (7, "same")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string")
    enc = encoded(df, PIECES)
    assert enc.columns == ["doc_id", "lang", "ids"]
    got = {r.doc_id: r.ids for r in enc.collect()}
    for doc, t in rows:
        want = None if t is None else best_path(MARK + t.replace(" ", MARK), pieces, m.byte_ids, m.viterbi.unknown) if t else []
        assert got[doc] == want, (doc, t)
        if t and doc != 4:
            assert sp.decode(got[doc]) == t
    back = {r.doc_id: r.text for r in decoded(enc, PIECES).collect()}
    assert back == {d: t.replace(MARK, " ") if t else t for d, t in rows}
    assert encoded(df.limit(0), PIECES).count() == 0


def test_long_words_take_linear_time_and_give_the_same():
    import time

    from lexmill.llm import op9_token_counts, op10_sentencepiece

    r = random.Random(3)
    words = [bytes(r.choice(b"abcdefgh") for _ in range(r.randint(200, 900))) for _ in range(20)]
    match, viterbi = LongestMatch(read_ranks(RANKS)), Model(PIECES).viterbi
    size = np.array([len(w) for w in words])
    at = np.cumsum(size) - size
    data = np.frombuffer(b"".join(words), np.uint8)
    assert match.counts(data, at, size).tolist() == match._together(data, at, size).tolist()
    counts, ids = viterbi.encode(data, at, size)
    each = [viterbi._grid(data, at[i : i + 1], size[i : i + 1])[1].tolist() for i in range(len(words))]
    assert counts.tolist() == [len(x) for x in each] and ids.tolist() == [i for x in each for i in x]
    began = time.time()
    assert len(viterbi.walked(b"abcd" * 100_000)) > 0 and match.walked(b"abcd" * 100_000) > 0
    assert time.time() - began < 30 and max(op9_token_counts.LONG, op10_sentencepiece.LONG) < 1000


def test_a_column_named_ids_stays(spark):
    df = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, IDS string")
    row = encoded(df, PIECES).first().asDict()
    assert row["IDS"] == "mine" and len(row["ids_2"]) == 2


def test_query_encodes_each_text_once(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " two  spaces "), (4, "tab\tnul\x00 𝄞 日本"), (5, "a ▁ mark"), (6, "same"), (6, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op10_sentencepiece"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(text#") == 1, plan
    assert out.dtypes == [("doc_id", "bigint"), ("n_ids", "bigint"), ("ids", "array<int>"), ("restored", "boolean")]
    want = {r.doc_id: r.ids for r in encoded(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    got = sorted((r.doc_id, r.n_ids, r.ids, r.restored) for r in out.collect())
    assert got == [(i, None if t is None else len(want[i]), want[i], i != 5) for i, t in rows]


def test_round_trip_is_encoder_and_decoder():
    text = pa.array(["the one", None, "", "  é\x00 "])
    both, ids = round_trip(PIECES).func(text), encoder(PIECES).func(text)
    assert both.field("ids").equals(ids) and both.field("text").equals(text) and both.null_count == 0
    assert round_trip(PIECES).func(text.slice(0, 0)).to_pylist() == []


def test_decoding_equals_joined_pieces(monkeypatch):
    m, r = Model(PIECES), random.Random(4)

    def plain(ids):
        raw = b"".join(m.data[i] if i is not None and 0 <= i < len(m.data) else b"" for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    space = m.byte_ids[32]
    mixed = [[r.choice([None, -5, 0, 1, 2, space, 10**6, r.choice(m.byte_ids), r.randrange(len(m.data))]) for _ in range(r.randint(0, 9))] for _ in range(3000)]
    good = [[0, space, space, 400], [], None, [2, -1], [None, int(m.viterbi.id[5])], [space], m.viterbi.id[:70].tolist()]
    split = [m.byte_ids[x] for x in "é".encode()]
    for lists in (good, mixed, good + mixed, [split[:1], split[1:]], [], [None], [[]]):
        for run in (1, 7, 1 << 18):
            monkeypatch.setattr(op10_sentencepiece, "RUN", run)
            got = decoder(PIECES).func(pa.array(lists, pa.list_(pa.int32())))
            assert got.type == pa.string() and got.to_pylist() == [None if x is None else plain(x) for x in lists]
