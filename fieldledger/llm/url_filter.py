"""URL filters: rules by host and path, and for the rest a naive Bayes verdict on the words of host and path.

Names (runs of a-z in hosts and paths) are split into words by a unigram Viterbi: the dictionary counts all words of the
pages' own text, a string that is not in it costs ten times more for each letter. No dictionary is sent around:
all substrings of the distinct names are looked up in it by a join. Multinomial naive Bayes then scores a url by its host
words and path words (runs of digits are one word `0`). It learns from all urls: those whose host holds one of the `seeds` as
a word are to be blocked, the others are not, so words that go with seeds in hosts and paths count too.

Work is done on distinct hosts, path shapes (digits as `0`) and names. What these results meet again are rows, of which one
host may hold any part: `lookup` sends the results for keys that hold at least a HEAVY-th of the rows to the rows, which are
at most HEAVY keys, and joins the others.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end. Null and other urls
have both empty, no words, and the verdict of the class that is more frequent. Names above LONGEST_NAME letters are one word. Of
the rules that fit, the longest (host and path together) wins, then the one with the longer host, then the smaller action.
Repeated rows count each time, null keys are rows like any other, other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Letters of the longest name that is split (the longest label of a host), and of the longest word.
LONGEST_NAME, LONGEST_WORD = 63, 24
#: A key is heavy if it holds one of so many parts of the rows.
HEAVY = 1 << 14
#: Words that make a host one to be blocked: what the model learns from. Fixed values.
SEEDS = ("ad", "ads", "adult", "bet", "bets", "casino", "malware", "phishing", "pills", "porn", "sex", "spam", "viagra", "xxx")
#: Log-odds are added up as whole numbers of this size, so that their order does not matter.
UNIT = 1e-9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    start = F.instr(url, "://")
    behind = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    return lower(F.regexp_extract(behind, r"^[^/?#]*", 0)), F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1)


def lookup(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows (a written table, key not null) with the columns of values, one row per key, nulls where it has none."""
    total = rows.count()
    heavy = rows.groupBy(key).count().where(F.col("count") * HEAVY >= total).select(key)
    heavy = written(heavy.join(values, key, "left").withColumn("_heavy", F.lit(True)), "heavy")
    marked = rows.join(F.broadcast(heavy), key, "left")
    rest = marked.where("_heavy is null").select(*rows.columns).join(values, key, "left")
    return marked.where("_heavy").drop("_heavy").unionByName(rest)


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, n: words of a-z that stand alone between white space in the text of the pages, a mark at their end aside."""
    text = F.regexp_replace(F.col(html), r"<[^>]*>", " ")
    words = F.regexp_extract_all(lower(text), F.lit(rf"(?<!\S)([a-z]{{1,{LONGEST_WORD}}})(?=[.,;:!?]?(?!\S))"), 1)
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def split_name(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The words with the highest product of unigram probabilities; known: (start, length) -> count of the word there.
    Of equal splits, the one whose last word is longest, and so on to the front."""
    best, cut = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            n, length = known.get((start, end - start), 0), end - start
            here = best[start] + (math.log(n / total) if n else math.log(10 / total) - length * math.log(10))
            if here > best[end]:
                best[end], cut[end] = here, start
    words, end = [], len(name)
    while end:
        words.append(name[cut[end]:end])
        end = cut[end]
    return words[::-1]


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words of a written table of distinct names; counts: word, n (written)."""
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    short = names.where(F.length("name") <= LONGEST_NAME)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - s + 1)),
        lambda n: F.struct((s - 1).alias("start"), n.alias("length"), F.substr("name", s, n).alias("word")))))
    found = lookup(written(short.select("name", F.inline(pieces)), "substrings"), counts, "word").where("n is not null")
    found = found.groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist()):
                known = {(k["start"], k["length"]): k["n"] for k in known or []}
                words.append(split_name(name, known, total) if len(name) <= LONGEST_NAME else [name])
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    return names.join(found, "name", "left").mapInArrow(run, "name string, words array<string>")


def _names(text: Column) -> Column:
    """Runs of letters and digits, in order; runs of digits as 0."""
    return F.regexp_extract_all(F.regexp_replace(text, "[0-9]+", "0"), F.lit("[a-z]+|0"), 0)


def tokens(keys: DataFrame, key: str, split: DataFrame, mark: str) -> DataFrame:
    """key, words of every key of a written table that has any: its names' words in order."""
    rows = written(keys.select(key, F.posexplode(_names(lower(F.col(key)))).alias("at", "name")), "names")
    rows = lookup(rows, split, "name").withColumn("words", F.coalesce("words", F.array("name")))
    found = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("x"))
    return found.select(key, F.transform(F.flatten("x.words"), lambda w: F.concat(F.lit(mark), w)).alias("words"))


def weights(counts: DataFrame) -> DataFrame:
    """token, weight: log-odds of the classes, in UNITs, from counts (token, n1, n0) with add-one smoothing."""
    sums = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count("*").alias("v")).first()
    t1, t0 = ((sums[k] or 0) + sums["v"] for k in ("t1", "t0"))
    odds = F.log((F.col("n1") + 1) / F.lit(float(max(t1, 1)))) - F.log((F.col("n0") + 1) / F.lit(float(max(t0, 1))))
    return counts.select("token", F.round(odds / UNIT).cast("long").alias("weight"))


def _scores(found: DataFrame, key: str, weight: DataFrame) -> DataFrame:
    rows = written(found.select(key, F.explode("words").alias("token")), "tokens")
    return lookup(rows, weight, "token").groupBy(key).agg(F.sum("weight").alias("weight"))


def rules_of(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """host, fits: per host with any, the rules (host, path, action) for it and the domains above it, the winning order first."""
    spark = hosts.sparkSession
    table = spark.createDataFrame(list(rules), "above string, path string, verdict string").select(
        "above", F.struct((-F.length(F.concat("above", "path"))).alias("order"), (-F.length("above")).alias("host_order"), "verdict",
                          F.concat("above", "path").alias("rule"), "path").alias("fit"))
    table = table.groupBy("above").agg(F.collect_set("fit").alias("fit"))
    pieces = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "."))
    rows = written(hosts.select("host", F.explode(above).alias("above")), "domains")
    found = lookup(rows, table, "above").where("fit is not null")
    return found.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("fit"))).alias("fits"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], seeds: Sequence[str] = SEEDS, key: str = "page_id",
           url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (the model's probability of block), host_words."""
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = written(rows.withColumn("shape", F.regexp_replace(lower(F.col("path")), "[0-9]+", "0")), "urls")
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    shapes = written(rows.select("shape").distinct(), "shapes")
    names = hosts.select(F.explode(_names("host")).alias("name")).union(shapes.select(F.explode(_names("shape")).alias("name")))
    counts = written(word_counts(pages, html), "dictionary")
    split = written(split_names(written(names.where("name <> '0'").distinct(), "distinct"), counts), "split")

    host_words = written(tokens(hosts, "host", split, "h:"), "host-words")
    shape_words = written(tokens(shapes, "shape", split, "p:"), "path-words")
    bad = F.arrays_overlap("words", F.array(*(F.lit(f"h:{s}") for s in seeds))).cast("long") if seeds else F.lit(0).cast("long")
    labels = written(hosts.join(host_words, "host", "left").select("host", "n", "words", F.coalesce(bad, F.lit(0)).alias("bad")), "labels")
    by_class = [F.sum(F.col("n") * F.col("bad")).alias("n1"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("n0")]
    by_shape = lookup(rows.select("host", "shape"), labels.select("host", "bad"), "host").groupBy("shape", "bad").agg(F.count("*").alias("n"))
    seen = labels.select(F.explode("words").alias("token"), "n", "bad").union(
        by_shape.join(shape_words, "shape").select(F.explode("words"), "n", "bad"))
    weight = written(weights(written(seen.groupBy("token").agg(*by_class), "tokens")), "weights")
    n1, n0 = labels.agg(*by_class).first() or (0, 0)
    prior = round((math.log((n1 or 0) + 1) - math.log((n0 or 0) + 1)) / UNIT)

    info = labels.select("host", "words").join(_scores(host_words, "host", weight), "host", "left").join(
        rules_of(hosts, rules), "host", "left").withColumnRenamed("weight", "host_weight")
    out = lookup(rows, written(info, "host-scores"), "host")
    out = lookup(written(out, "urls"), written(_scores(shape_words, "shape", weight), "path-scores"), "shape")
    fit = F.try_element_at(F.filter("fits", lambda x: F.startswith("path", x["path"])), F.lit(1))
    odds = (F.lit(prior).cast("long") + F.coalesce("host_weight", F.lit(0)) + F.coalesce("weight", F.lit(0))) * UNIT
    out = out.select("page_id", "host", "path", fit.alias("fit"), (1 / (1 + F.exp(-odds))).alias("score"),
                     F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.substr(w, F.lit(3))).alias("host_words"))
    model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", model).alias("verdict"),
                      "score", F.array_join("host_words", " ").alias("host_words"))
