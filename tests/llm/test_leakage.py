from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from garimpo.llm import leakage

ITEM = "Which of the 5289 seals kept under the Virrubor arch was broken first, given that Casvirgil held 6462?"


def brute(docs, items):
    grams: dict = {}
    for i, p, a in items:
        for f, t in (("prompt", p), ("answer", a)):
            w = leakage.words(t)
            for k in range(len(w) - leakage.RUN + 1):
                grams.setdefault(tuple(w[k : k + leakage.RUN]), set()).add((i, f))
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for k in range(len(w) - leakage.RUN + 1):
            out |= {(d, i, f) for i, f in grams.get(tuple(w[k : k + leakage.RUN]), ())}
    return sorted(out, key=repr)


def test_words():
    assert leakage.words("<b>Válvula</b>&nbsp;n&atilde;o **foi** > aberta_já\n# 12") == ["valvula", "nao", "foi", "aberta", "ja", "12"]
    assert leakage.words(None) == [] and leakage.words("a < b") == ["a", "b"] and leakage.words("ca­sa") == ["casa"]


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_brute_force(spark, rows, seed):
    """Small vocabularies make postings long, scores close to the threshold and blocks many."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12 + 40 * seed)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(5, 40)), text(r.randrange(0, 60)) or None) for i in range(60)]
    docs = []
    for d in range(150):
        body = text(r.randrange(0, 60)).split()
        for _ in range(r.randrange(3)):
            src = (r.choice(items)[1] or "").split()
            at, n = r.randrange(len(src)), r.randrange(9, 16)
            body[r.randrange(len(body) + 1) : 0] = src[at : at + n]
        docs.append((d, " ".join(body)))
    docs += [(1000, None), (1001, ""), docs[0]]
    got = leakage.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, prompt string, answer string"))
    assert rows(got.drop("run").distinct()) == brute(docs, items)


def test_forms_and_lengths(spark, rows):
    w = ITEM.split()
    docs = [(1, "> <i>" + "</i>\n> ".join(w).upper()), (2, " ".join(w[:11])), (3, " ".join(w[:12])), (4, " ".join([*w[:8], "quase", *w[9:17]])), (5, "palavra " * 200_000 + ITEM)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(0), "field": F.lit("x"), "run": F.lit(0)})
    items = spark.createDataFrame([(7, ITEM, "curta"), (8, None, ITEM)], "item_id bigint, prompt string, answer string")
    n = len(leakage.words(ITEM))
    assert rows(leakage.leaked(df, items)) == sorted([(d, i, f, k) for d, k in ((1, n), (3, 12), (5, n)) for i, f in ((7, "prompt"), (8, "answer"))], key=repr)
    assert leakage.leaked(df.limit(0), items).count() == 0 and leakage.leaked(df, items.limit(0)).count() == 0


def test_shards_hold_every_entry(monkeypatch):
    entries = [(i, {"prompt": ITEM + f" n{i}", "answer": None}) for i in range(9)]
    got = list(leakage.shards(entries, limit=40))
    assert len(got) > 1 and [e[0] for s in got for e in s] == list(range(9))
