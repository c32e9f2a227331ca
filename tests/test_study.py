import inspect
import random

from pyspark.sql import functions as F

from fieldledger import plans
from fieldledger.operators import learners as L
from fieldledger.plans import registry, study


def test_flow_sweep_has_all_levels_seeds_and_scores(spark, sf):
    plans.load()
    rows = registry.QUERIES["contamination_sweep_flow"](spark, sf).collect()
    assert {(r["score_kind"], r["level_idx"]) for r in rows} == {
        (k, i) for k in ("deviation", "reconstruction", "decision") for i in range(10)}
    assert len(rows) == 30 and {r["n_seeds"] for r in rows} == {5}


def test_network_query_trains_at_the_learners_defaults(spark, sf, monkeypatch):
    seen, fit = {}, L.fit_contraction_network

    def spy(*args, **options):
        seen.update(inspect.signature(fit).bind(*args, **options).arguments)
        return fit(*args, **{**options, "epochs": 1})

    monkeypatch.setattr(L, "fit_contraction_network", spy)
    study.fit_contraction_network(spark, sf)
    assert set(seen) == {"df", "key", "features", "dims"}


def test_saved_model_is_found_though_means_differ_in_their_last_bits(spark, sf, monkeypatch):
    from fieldledger.operators import prep
    from fieldledger.plans import study

    scale = prep.standard_scale_vector
    shake = F.udf(lambda v: [x * (1.0 + 1e-13 * random.random()) for x in v], "array<double>").asNondeterministic()
    monkeypatch.setattr(prep, "standard_scale_vector", lambda train, df, features, out: scale(train, df, features, out).withColumn(out, shake(out)))
    assert study.model_cache(spark, sf).count() > 0


def test_network_rows_lie_in_files_for_all_cores(spark, sf, monkeypatch):
    """A step reads all rows of its batch; in one file they were the work of one task."""
    from fieldledger.operators import learners as L
    from fieldledger.sources import tables as T

    files, step = [], L._sum_gradients

    def spy(rows, *args):
        files.append(len(rows.inputFiles()))
        return step(rows, *args)

    monkeypatch.setattr(L, "_sum_gradients", spy)
    L.fit_contraction_network(T.vectors(spark, sf), "row_id", "features", 64, epochs=1, hidden=8, embed=4)
    assert files[0] >= spark.sparkContext.defaultParallelism
