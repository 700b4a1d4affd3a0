import os
import random

import public_tokenizers
from pyspark.sql import functions as F
from test_line_dedup import levenshtein

import winsyn.llm.line_dedup as lines
import winsyn.llm.packing as packing
from winsyn.llm.common import Scratch, give_back


def left(scratch):
    """The tables that are still there, by name."""
    return {d.partition("-")[2] for d in os.listdir(scratch.root.removeprefix("file:"))}


def test_counts_of_letters_leave_out_no_similar_pair(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdeé жfz1 ") for _ in range(n)) for n in (9, 12, 30, 80, 250)]
    texts = base + ["".join(rnd.choice(["", *[c] * 24, "x", "ж" + c]) for c in x) for x in base for _ in range(4)] + ["e" * 300, "e" * 330, "g" * 30, "k" * 30]
    counted = lines._counted(spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(texts)], "hash long, line string, size int")).localCheckpoint()
    both = lines._of(counted, "a").crossJoin(lines._of(counted, "b")).where("a < b")
    alike = {(r.a, r.b) for r in both.where(lines._alike()).select("a", "b").collect()}
    similar = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and levenshtein(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)}
    assert len(similar) > 10 and similar <= alike
    assert (len(texts) - 2, len(texts) - 1) not in alike


def test_line_dedup_keeps_no_table_that_its_result_does_not_read(spark):
    df = spark.createDataFrame([(k, f"the same line of these texts\nline {k} of its own and some words more {k * 7919}") for k in range(40)], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    assert lines.drop_lines(df, scratch=scratch).agg(F.sum("n_lines")).first()[0] == 80
    assert left(scratch) == {"gone"}


def test_packing_keeps_ids_once(spark):
    df = spark.createDataFrame([(k, "some words " * k) for k in range(1, 40)], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    out = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, scratch=scratch)
    assert out.agg(F.countDistinct("doc_id")).first()[0] == 39
    assert left(scratch) == {"placed"}


def test_a_worker_that_turns_to_another_operator_keeps_no_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing._words(path)
    give_back(but=packing._words.cache_clear)
    assert packing._words(path) is words
    give_back()
    assert packing._words.cache_info().currsize == 0
