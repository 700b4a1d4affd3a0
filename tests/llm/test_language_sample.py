import public_tokenizers as P
from pyspark.sql import functions as F

from winsyn.llm import language_id as m


def test_hot_copies_leave_the_other_texts_in_the_sample(spark):
    texts = [chr(0x0561 + k) * 30 for k in range(20)]
    hot = spark.range(5000).select(F.lit("\u0580" * 9).alias("text"), F.lit("zz").alias("lang"))
    df = hot.union(spark.createDataFrame([(t, "zz") for t in texts] + [("plain words %d" % k, "aa") for k in range(20)], "text string, lang string"))
    model = m.train(df, m.vocabulary(P.path("piece_bpe_32k.model")))
    assert [lang for lang, _ in model.score(texts)] == ["zz"] * 20
