"""Texts that agree in 32 bits of a hash, but in no string of 100 bytes, lose nothing."""

import random

from pyspark.sql import functions as F

LINE = "Share page 002629 with your friends today."
#: Around the line, whose gram is the anchor of both: contexts of one span and place, with the same upper 32 bits.
ONE = ("rtgllsehaoyesqvonomdhlsfjjefcxcfrwztxabozypyjmsnrhjyyugrzikwijliayxtepoqcsyueoqhcqebxpuhth", "rfikqfrrfokydptxbcjivscunjaiamzcklmhnwsgdtluquiwmlbsqztvtyzvatdfbyxxkunkvqiprqyumclanacwiu")
TWO = ("rsrnuszpxkbnkmqzjlqphnmsddestpysymyxdhdvabdvnvtqbqqsjjwzsnmllpzdgixximfrurlzmbxrkmxfqtgjys", "phjhqzuvzhliszrmqcebqrurpntbdtifkpkhahtapharoqshpccxehhpkyiihcavvylrcyfujcgsexxmmnapwgkhzz")


def test_contexts_that_share_32_bits(spark):
    from quire.llm import repeats

    docs = spark.createDataFrame([(1, LINE.join(ONE)), (2, LINE.join(TWO))], "doc_id bigint, text string").coalesce(1)
    assert [r["n_removed"] for r in repeats.report(repeats.dedupe(docs)).collect()] == [0, 0]


def test_texts_of_one_id_that_share_32_bits(spark):
    from quire.llm import repeats

    a, b = ("".join(random.Random(i).choices("abcdefghij", k=n)) for i, n in ((1, 130), (2, 160)))
    rows = [(None, f"{a} 4636"), (None, f"{b} 193617"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    low = [r[0] for r in docs.select(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))).collect()]
    assert low[0] == low[1]
    kept = {bytes(r["kept"]).decode() for r in repeats.dedupe(docs).collect()}
    assert rows[1][1] in kept and len(kept & {rows[0][1], a}) == 1
