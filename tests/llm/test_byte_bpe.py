import hashlib
import random
import struct

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import winsyn.llm.byte_bpe as m

PATH = P.path("byte_bpe_50k.tiktoken")


def test_against_the_library(spark):
    rnd = random.Random(8)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={p: r for r, p in enumerate(m.load_ranks(PATH))}, special_tokens={})
    texts = [None, "", " ", "a", "é", "I'll we've  can't\n\n  x ", "a b\x85c\xa0d\x1ce", "漢字かな交じり文 😀👍🏽", "x" * 500, " " * 300, "१२३ ½²", "<|endoftext|>", "\x00\x01", "\U0001e6c0 new"]
    texts += ["".join(rnd.choice("abc étß01  .,'!\n") for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    texts += [" ".join(rnd.choice(["the", "nation", "onthat", "Überraschung", "naïveté"]) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    native, lit = m.encode_native(df, PATH, P.PATTERN, cached=50)
    arrow = m.decode(m.encode(df, PATH, P.PATTERN), PATH)
    for out in (native.select("doc_id", "ids", lit.blob(F.col("ids")).alias("blob"), lit.decode(F.col("ids")).alias("back")), arrow.select("doc_id", F.lit(None).alias("ids"), F.col("ids").alias("blob"), F.col("decoded").alias("back"))):
        got = {r.doc_id: r for r in out.collect()}
        for i, t in enumerate(texts):
            want = enc.encode_ordinary(t or "")
            assert got[i].ids in (None, want), t
            assert bytes(got[i].blob) == struct.pack(f"<{len(want)}I", *want)
            assert bytes(got[i].back) == (t or "").encode()


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in m.op9_byte_bpe(spark, str(tmp_path)).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest() == got[2].decoded_sha256
    assert got[1].decoded_sha256 == hashlib.sha256(b"ab").hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert m.op9_byte_bpe(spark, str(tmp_path)).count() == 0
