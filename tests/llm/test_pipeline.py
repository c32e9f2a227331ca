import random

import corpus_pipeline as P
from fieldledger.llm import string_kernel
from fieldledger.llm.common import fold
from pyspark.sql import functions as F
from test_minhash_join import plain as plain_groups
from test_models import SYLLABLES, text
from test_packing import check
from test_quality_rules import plain as plain_measures

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(6)
    rows = [(i, text(draw, lang, draw.randrange(25, 90)), lang) for i, lang in enumerate(draw.choices(sorted(SYLLABLES), k=250))]
    near = rows[3][1].split()
    rows += [(300 + i, " ".join([*near, "aa"][i % 2:]), "aa") for i in range(12)]
    rows += [(400 + i, rows[7][1], rows[7][2]) for i in range(5)] + [rows[9]]
    rows += [(500, None, "aa"), (501, "", None), (502, "123 456 " * 30, "aa"), (503, "ka lo mi", "aa"), (504, "ka lo mi ru ten sha ka mi ru " * 30, "aa"),
             (505, " | ".join(text(draw, "aa", 60).split()), "aa")]
    return [(*r, "s", len(r[1] or "")) for r in rows]


def good(t):
    m = plain_measures(t)
    n = m["n_words"]
    return not (n < 20 or 100 * m["n_repeat_words"] > 30 * n or 100 * m["n_dup_lines"] > 60 * m["n_lines"] or 100 * m["n_symbols"] > 25 * n
                or 100 * (t or "").count("!") > 25 * n or m["word_chars"] < 2 * n or m["word_chars"] > 14 * n)


def test_every_stage(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = string_kernel.train(docs, fold(F.col("doc_id"), 4) != 2)
    scored = string_kernel.predict(docs, model).where("lang_pred <> 'und' and score >= 0.25")
    want = sorted(map(tuple, scored.select(*docs.columns).collect()))
    got = P.language(spark, docs, str(tmp_path))
    assert got.schema == docs.schema and sorted(map(tuple, got.collect())) == want
    assert {500, 501, 502}.isdisjoint(r[0] for r in want) and len(want) >= len(rows) - 6

    got = P.quality(spark, got, str(tmp_path))
    want = [r for r in want if good(r[1])]
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == want
    assert {503, 504, 505}.isdisjoint(r[0] for r in want) and len(want) > 240

    got = P.near_duplicates(spark, got, str(tmp_path))
    keep = {k for k, _, _, kept in plain_groups([(r[0], r[1]) for r in want]) if kept}
    want = sorted({r for r in want if r[0] in keep})
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == want
    assert 9 in keep and not {300, 311, 400, 404} & keep

    pieces = [r.asDict() for r in P.run(spark, str(tmp_path)).collect()]
    check([(r[0], r[1]) for r in want], pieces, 1024)


def test_near_duplicates_by_row(spark):
    words = text(random.Random(9), "aa", 60)
    other, third = text(random.Random(10), "bb", 60), text(random.Random(11), "cc", 60)
    rows = [(1, words), (2, words + " x"), (None, words + " y"), (7, other), (7, third), (7, third), (None, other + " z"), (9, third)]
    docs = spark.createDataFrame([(k, t, "aa", "s", len(t)) for k, t in rows], COLUMNS)
    got = P.near_duplicates(spark, docs, "")
    order = lambda r: (r[0] is not None, r)
    assert got.schema == docs.schema
    assert sorted(((r[0], r[1]) for r in got.collect()), key=order) == sorted(
        [(1, words), (None, words + " y"), (7, other), (7, third), (None, other + " z")], key=order)
