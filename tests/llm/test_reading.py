from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from garimpo.llm import reading


def text(r, level):
    words = [f"palavra{'abcdefghij'[r.randrange(10)]}" if r.random() > 0.08 * level else "raro" + "".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(90)]
    out, n = [], 4 * level
    for k in range(0, len(words), n):
        out.append("o " + " ".join(words[k : k + n]) + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def graded(spark):
    r = random.Random(1)
    data = [(i, text(r, 1 + i % 5)) for i in range(250)]
    labels = [(i, 900, 1 + i % 5) for i in range(150)] + [(0, 901, 2), (1, 902, None), (99999, 900, 3)]
    return spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, annotatorid int, readinglevel int")


def test_held_out_accuracy(graded):
    documents, labels = graded
    measured = reading.measures(documents)
    got = {x.doc_id: x.readinglevel for x in reading.levels(measured, reading.fit(measured, labels)).collect()}
    held = [i for i in range(150, 250)]
    assert sum(abs(got[i] - (1 + i % 5)) <= 1 for i in held) >= 95 and sum(got[i] == 1 + i % 5 for i in held) >= 60


def test_prose(spark):
    x = "Antes [guia](http://x.example/a) fim.\n```py\nfor x in y: pass\n```\n    codigo()\n<p>Um&nbsp;texto</p><pre>z = 1</pre>\n> citado https://a.example/b\nexport A=1"
    got = spark.createDataFrame([(x,)], "t string").select(reading.word_array(reading.prose(F.col("t"))).alias("w")).first().w
    assert got == ["antes", "guia", "fim", "um", "texto", "citado"]


def test_nulls_empty_and_code_only(spark, graded):
    _, labels = graded
    df = spark.createDataFrame([(1, None), (2, ""), (3, "```\nx\n```"), (4, "Uma frase curta."), (4, "Uma frase curta.")], "doc_id bigint, text string").withColumns({"row": F.lit(1), "w": F.lit(2), "words": F.lit(3)})
    measured = reading.measures(df)
    got = reading.levels(measured, reading.fit(measured, labels.limit(0))).collect()
    assert len(got) == 5 and sum(r.readinglevel is None for r in got) == 3 and {r.words for r in got if r.doc_id < 4} == {0}
    assert reading.measures(df.limit(0)).count() == 0
