import re

import pytest

from fieldledger.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {j for starts in seen.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


TEXTS = [
    None, "", "  \t\n ", "one", "a b c d e f g h " * 5, "x " * 400, "same line\nsame line\n\nother\nsame line\r\n",
    "#1 $2 <b> a|b & 100% é ü 😀 wörter", "  nbsp is a word", "long " * 20000,
    " ".join(str(i) for i in range(300)) + " " + " ".join(str(i) for i in range(40, 90)),
    "a b c d e f g h i j k l m n a b c d e f g h i q r s t u v w x y z b c d e f g h i j",
]


def test_measures_against_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in Q.ledger(docs).collect():
        want = plain(TEXTS[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]


def test_clashing_columns_repeated_rows_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 9)] * 2, "doc_id long, text string, n_words string, fail_bits int")
    out = Q.ledger(docs)
    assert [r["n_words"] for r in out.collect()] == [2, 2] and out.columns.count("n_words") == 1
    assert Q.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (3,), (8,), (12,)], "fail_bits long")
    assert [r["kept"] for r in Q.apply_policy(rows, "base").orderBy("fail_bits").collect()] == [True, False, False, False, True, True]
    got = {r["rule"]: tuple(r)[1:] for r in Q.ablation(rows, "2").collect()}
    assert got["too_few_words"] == (2, 1, 1, 2) and got["symbols"] == (2, 1, 1, 2) and got["duplicate_lines"] == (1, 0, 1, 1)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = Q.apply_policy(Q.ledger(docs), "2")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Exchange" not in plan


def test_a_filter_copies_no_rule(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string").repartition(2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = Q.ledger(docs)
    for frame in (rows, rows.where(~Q.fails("2")).select("doc_id", "text", "lang"), Q.apply_policy(rows, "2").where("kept")):
        assert plan(frame).count("xxhash64") == plan(rows).count("xxhash64") == 4


@pytest.mark.parametrize("policy", list(Q.POLICIES))
def test_masks(policy):
    assert bin(Q.mask_of(policy)).count("1") == len(Q.POLICIES[policy])
