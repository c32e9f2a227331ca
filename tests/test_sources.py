import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.functions import hyperparameters as H, scalars as S
from fieldledger.operators import inject as J, relational as R, reports
from fieldledger.operators.prior import TransactionColumns
from fieldledger.sources import files

TX = TransactionColumns("acc", "name", "iban", "swift", "method", "channel", "d", "amount", ("k",))


def test_npz_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(25, 4)), rng.integers(0, 2, 25)
    np.savez(tmp_path / "a.npz", X=x, y=y)
    np.savez(tmp_path / "b.npz", X=x[:3].astype("float32"), y=y[:3].astype(float))
    out = files.ingest_npz(spark, str(tmp_path)).collect()
    assert len(out) == 28
    a = sorted((r for r in out if r["source"].endswith("a.npz")), key=lambda r: r["row_id"])
    assert np.allclose([r["features"] for r in a], x) and [r["label"] for r in a] == list(y)


def test_first_path_that_exists(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",".join(files.TRANSACTION_COLUMNS) + "\na,b,20240105,1.5,USD,r,i,s,US,n,DEBIT,ACH,API,\n")
    df = files.read_transactions(spark, str(tmp_path / "none.csv"), str(tmp_path / "t.csv"))
    r = df.first()
    assert (r["date_post"], r["amount"], r["anomaly_description"]) == (dt.date(2024, 1, 5), 1.5, None)
    with pytest.raises(FileNotFoundError):
        files.read_transactions(spark, str(tmp_path / "none.csv"))


def test_merge_lets_the_later_file_win(spark, tmp_path):
    a = spark.createDataFrame([("d", "m", "s", 1.0), ("d", "m2", "s", 2.0)], "dataset string, model string, score string, v double")
    b = spark.createDataFrame([("d", "m", "s", 9.0, 1)], "dataset string, model string, score string, v double, extra int")
    files.write_results(a, str(tmp_path / "a"))
    parts = files.read_results(spark, [str(tmp_path / "missing"), str(tmp_path / "a")])
    out = R.merge_results([*parts, b], ["dataset", "model", "score"])
    assert sorted((r["model"], r["v"]) for r in out.collect()) == [("m", 9.0), ("m2", 2.0)]


def test_hyperparameter_order(spark):
    names = ["5_Cardiotocography.npz", "cardio", "annthyroid", "thyroid", "x"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["epochs"] for r in H.lookup_hyperparameters(df, "name").collect()}
    assert got == {"5_Cardiotocography.npz": 1, "cardio": 2000, "annthyroid": 2000, "thyroid": 10, "x": None}
    assert H.settings_for("my_campaign")["batch_size"] == 1024
    with pytest.raises(KeyError):
        H.settings_for("x")


def test_display_name_is_title_case(spark):
    df = spark.createDataFrame([("35_SpeeCH.npz",), ("my-set2b_x",), ("a_CAMPAIGN",)], "n string")
    got = [r[0] for r in df.select(S.dataset_display_name("n")).collect()]
    assert got == ["35_SpeeCH.npz".replace(".npz", "").replace("_", " ").title(), "my-set2b x".title(), "Campaign Dataset"]


def test_series_key_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(S.series_key("x", "y")).collect()] == ["a_b", None]


def test_half_even_labels(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.50001,)], "p double")
    assert [r[0] for r in df.select(S.binary_label(F.col("p"))).collect()] == [0, 2, 2, 1]


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(i, "a" if i % 2 else "b", ["Blue Cloud", "Red Solutions", "Green Goods"][i % 3], f"iban{i:012d}", "s", "ACH", "API",
             dt.date(2024, 1 + i % 5, 1 + i % 28), 100.0 + i, "note", "US", None) for i in range(60)]
    return spark.createDataFrame(rows, "k long, acc string, name string, iban string, swift string, method string, channel string, "
                                 "d date, amount double, paym_note string, ref_bank string, anomaly_description string")


@pytest.mark.parametrize("kind", J.KINDS)
def test_one_injection_per_series(ledger, kind):
    out = J.inject(ledger, kind, TX, "k")
    hit = out.where("anomaly_description IS NOT NULL").collect()
    assert len(hit) == 6 and out.count() == 60 + (6 if kind == "frequency" else 0)
    if kind == "subtle_payee":
        assert {r["name"] for r in hit} == {"Blue Core", "Red Systems", "Green Ventures"}
    if kind in ("payee", "iban_mismatch", "subtle_payee"):
        assert all(r["iban"].startswith("GB") for r in hit)
    if kind in ("timing", "frequency"):
        assert all(1 <= r["d"].day <= 28 for r in hit)


def test_similar_names_need_one_edit(spark):
    rows = [("a", n, i) for i, n in enumerate(["Acme Ltd"] * 3 + ["Acne Ltd", "Acme Lt", "Acme Ltds", "Bcme Ltx", "Other"])]
    df = spark.createDataFrame(rows, "acc string, name string, k int")
    got = {r["one_off"] for r in reports.new_recipient_similar_name(df, TX).collect()}
    assert got == {"Acne Ltd", "Acme Lt", "Acme Ltds"}


def test_similar_names_meet_once_for_all_accounts(spark):
    names = ["Acme Ltd", "Acne Ltd", "Acme Lt", "Other", "", "A", None]
    rows = [(None if i == 20 else f"a{i}", n) for i in range(21) for k, n in enumerate(names) for _ in range(1 + (i + k * k) % 3)]
    df = spark.createDataFrame(rows, "acc string, name string")
    n = {}
    for r in rows:
        n[r] = n.get(r, 0) + 1
    near = {("Acme Ltd", "Acne Ltd"), ("Acme Ltd", "Acme Lt"), ("", "A")}
    near |= {(b, a) for a, b in near}
    want = sorted((acc, a, b) for acc, a in n for b in names if acc and (a, b) in near and n[acc, a] == 1 and n.get((acc, b), 0) > 1)
    assert sorted(map(tuple, reports.new_recipient_similar_name(df, TX).collect())) == want and want
    counted = df.groupBy("acc", "name").count().selectExpr("name", "count = 1 AS _once")
    pairs = reports._similar_pairs(counted, "name", 1)
    assert sorted(map(tuple, pairs.collect())) == sorted(near)


def test_previous_row_crosses_days(ledger):
    out = reports.previous_in_series(ledger, TX, "iban", "before").select("acc", "name", "d", "k", "iban", "before").collect()
    last = {}
    for r in sorted(out, key=lambda r: (r["d"], r["k"])):
        assert r["before"] == last.get((r["acc"], r["name"]))
        last[r["acc"], r["name"]] = r["iban"]


def test_previous_row_with_missing_keys(spark):
    rows = [(k, "a", name, f"i{k}", "s", "ACH", "API", day, 1.0) for k, (name, day) in enumerate([
        (None, dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 2)), ("n", None), ("n", None), ("n", dt.date(2024, 1, 3)), (None, None), ("n", dt.date(2024, 1, 3))])]
    df = spark.createDataFrame(rows, "k long, acc string, name string, iban string, swift string, method string, channel string, d date, amount double")
    got = {r["k"]: r["before"] for r in reports.previous_in_series(df, TX, "iban", "before").collect()}
    assert got == {5: None, 0: "i5", 1: "i0", 2: None, 3: "i2", 4: "i3", 6: "i4"}


def test_names_two_edits_apart(spark):
    rows = [("a", n, i) for i, n in enumerate(["Acme Ltd"] * 2 + ["Acne Lt", "Acme", "Bcme Ltds", "A"])]
    df = spark.createDataFrame(rows, "acc string, name string, k int")
    assert {r["one_off"] for r in reports.new_recipient_similar_name(df, TX, 2).collect()} == {"Acne Lt", "Bcme Ltds"}


def test_transactions_by_header(spark, tmp_path):
    names = files.TRANSACTION_COLUMNS[::-1]
    values = {c: c for c in names} | {"date_post": "20240305", "amount": "12.5"}
    (tmp_path / "x.csv").write_text(",".join(names) + "\n" + ",".join(values[c] for c in names) + "\n")
    row = files.read_transactions(spark, str(tmp_path / "x.csv")).first()
    assert (row["amount"], row["date_post"], row["channel"]) == (12.5, dt.date(2024, 3, 5), "channel")


def test_target_is_a_number(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,c,y\n1,u,2\n")
    df = files.read_csv_roles(spark, {"train": str(tmp_path / "a.csv")}, ["c"], "y")
    assert dict(df.dtypes) == {"x": "double", "c": "string", "y": "double", "split": "string"}


def test_unreadable_results_are_an_error(spark, tmp_path):
    from pyspark.errors import AnalysisException

    (tmp_path / "empty").mkdir()
    assert files.read_results(spark, [str(tmp_path / "none")]) == []
    with pytest.raises(AnalysisException):
        files.read_results(spark, [str(tmp_path / "empty")])


def test_scratch_is_removed_and_needs_a_shared_folder(spark, monkeypatch):
    import os

    from fieldledger import session

    before = set(map(id, session._WRITTEN))
    df = session.cut_lineage(spark.range(3), "gone")
    [path] = [p for x, p in ((id(w), w[1]) for w in session._WRITTEN) if x not in before]
    assert os.path.isdir(path) and df.count() == 3
    monkeypatch.setattr(session, "_WRITTEN", [(spark, path)])
    assert session.clear_scratch(spark) == 1 and not os.path.exists(path)

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster)
