"""Training settings by data set name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: (name part, epochs, batch size, learning rate), tried in this order
RULES = (
    ("business_dataset", 100, 64, 0.001),
    ("census", 5, 1024, 0.005),
    ("backdoor", 200, 1024, 0.005),
    ("campaign", 50, 1024, 0.005),
    ("mnist", 500, 512, 0.005),
    ("speech", 500, 512, 0.005),
    ("optdigits", 2000, 512, 0.005),
    ("spambase", 5000, 512, 0.005),
    ("musk", 5, 512, 0.005),
    ("internetads", 50, 512, 0.005),
    ("donors", 30, 1024, 0.005),
    ("http", 100, 1024, 0.005),
    ("cover", 10, 1024, 0.005),
    ("fraud", 75, 1024, 0.005),
    ("skin", 110, 1024, 0.005),
    ("celeba", 2, 1024, 0.005),
    ("smtp", 2, 1024, 0.005),
    ("aloi", 100, 1024, 0.005),
    ("shuttle", 200, 1024, 0.005),
    ("magic.gamma", 10, 1024, 0.005),
    ("mammography", 20, 1024, 0.005),
    ("annthyroid", 2000, 512, 0.005),
    ("pendigits", 1000, 512, 0.005),
    ("satellite", 10, 512, 0.005),
    ("landsat", 6, 512, 0.005),
    ("satimage-2", 5, 512, 0.005),
    ("pageblocks", 1800, 512, 0.005),
    ("wilt", 20, 512, 0.005),
    ("thyroid", 10, 512, 0.005),
    ("waveform", 580, 512, 0.005),
    ("cardiotocography", 1, 512, 0.005),
    ("fault", 5000, 512, 0.005),
    ("cardio", 2000, 512, 0.005),
    ("letter", 50, 512, 0.005),
    ("yeast", 130, 512, 0.005),
    ("vowels", 20, 512, 0.005),
    ("pima", 5, 512, 0.005),
    ("breastw", 1, 512, 0.005),
    ("wdbc", 2, 512, 0.005),
    ("ionosphere", 10, 512, 0.005),
    ("stamps", 200, 512, 0.005),
    ("vertebral", 25, 512, 0.005),
    ("wbc", 1, 512, 0.005),
    ("glass", 200, 512, 0.005),
    ("wpbc", 6, 512, 0.005),
    ("lymphography", 3, 512, 0.005),
    ("wine", 20, 512, 0.005),
    ("hepatitis", 1, 512, 0.005),
)


def rules_array(rules=RULES) -> Column:
    return F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.lit(e).alias("epochs"), F.lit(b).alias("batch_size"),
                 F.lit(lr).alias("learning_rate"))
        for p, e, b, lr in rules
    ])


def lookup_hyperparameters(df: DataFrame, name: str, rules=RULES) -> DataFrame:
    """pattern, epochs, batch_size, learning_rate of the first rule whose pattern the name contains;
    null for an unknown name. The rules are a literal array searched per row: no join."""
    hit = F.get(F.filter(rules_array(rules), lambda r: F.lower(F.col(name)).contains(r["pattern"])), F.lit(0))
    return df.withColumn("_rule", hit).select("*", "_rule.*").drop("_rule")


def settings_for(name: str) -> dict:
    """The same rule for a name known when planning."""
    for pattern, epochs, batch, rate in RULES:
        if pattern in name.lower():
            return {"epochs": epochs, "batch_size": batch, "learning_rate": rate}
    raise KeyError(name)
