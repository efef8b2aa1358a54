import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from wattline.llm.packing import Encoder, Packer, Params, pack
from wattline.llm.queries import QUERIES

TEXTS = [None, "", "a", "One two  three\n\n four   five <|endoftext|> six's", "trailing ", "  lead", "tab\t x   y", "word " * 9000, "日本語 テキスト", "x" * 3000] + [f"short {i}" for i in range(700)]


def test_pieces_restore_the_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert got.doc_id.isna().sum() == 1
    padding = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and len(g) <= 256
        n = int(g.length.sum())
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0


def test_limits_in_every_dimension():
    p = Params(tokens=64, segments=5, loss_tokens=40, pool=16)
    packer, rng, total = Packer(p, 0), np.random.default_rng(0), 0
    for d in range(300):
        n = int(rng.integers(1, 150))
        flags = bytes(rng.integers(0, 2, n).astype(np.uint8)) if d % 3 else None
        packer.add(d, np.arange(n, dtype="<u4").tobytes(), flags)
        total += n
    packer.finish()
    o = {k: np.array(v) for k, v in packer.out.items()}
    assert o["length"].sum() == total
    for s in np.unique(o["sequence_id"]):
        m = o["sequence_id"] == s
        assert o["length"][m].sum() <= 64 and m.sum() <= 5 and o["loss_tokens"][m].sum() <= 40


def test_loss_column_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two three", True), (2, "four five", False), (3, "six", None)], "doc_id long, text string, loss boolean")
    got = {r.doc_id: (r.length, r.loss_tokens) for r in pack(df, loss="loss").groupBy("doc_id").sum("length", "loss_tokens").toDF("doc_id", "length", "loss_tokens").collect()}
    assert got[1][0] == got[1][1] and got[2][1] == 0 and got[3][0] == got[3][1]
    assert pack(df.limit(0)).count() == 0


def test_ranks_give_the_tokenizers_ids():
    rng, parts = np.random.default_rng(1), ["a", "Zé", " ", "  ", "\n", "\t", " ", " ", "　", "\x85", "'s", "'LL", "9", "½", "日本", "👍🏽", "<|endoftext|>", "--", "​", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)]
    assert Encoder(Params()).encode(texts) == Encoder(Params(ranks=None)).encode(texts)


def test_special_tokens_get_the_ids_of_the_unmodified_tokenizer(spark, tmp_path):
    rng, parts = np.random.default_rng(2), ["a", "Zé", " ", "  ", "\n", "'s", "9", "日本", "<|endoftext|>", "<|endoftext|", "|>", "<"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x" * 9000 + "<|endoftext|>"] + ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    assert Encoder(Params(special=True)).encode(texts) == want == Encoder(Params(special=True, ranks=None)).encode(texts)
    few = [*texts[:60], "plain"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(few)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (QUERIES["op7_vector_packing"](spark, str(tmp_path)), cp.pack_sequences(spark, docs, str(tmp_path))):
        rows = got.collect()
        for i, ids in enumerate(want[:60]):
            mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            assert sum(r.length for r in mine) == len(ids) // 4
            assert all(r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in mine)
