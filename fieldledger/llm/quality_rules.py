"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed
rule. A policy is a named mask over those bits: applying it, or asking what a rule contributes, never
reads a text again.

Null and empty texts have no words: all counts are 0 and `too_few_words` fails. Columns of the input
that clash with ledger columns are replaced by the ledger's; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: White space between words, and the characters that count as symbols: fixed values.
SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules in the order of their bits, each over the measurements of the ledger.
RULES: dict[str, Column | str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "symbols": "100 * n_symbols > 25 * n_words",
    "exclamations": "100 * n_exclamations > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
}

#: Versioned policies: the rules a document must pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "2": ("too_few_words", "repeated_windows", "duplicate_lines", "symbols", "exclamations", "short_words",
          "long_words"),
}


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _without(text: Column, characters) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _pairs(values: Column, step: int) -> Column:
    """Hash of each element with the one `step` later; the last `step` elements have no partner."""
    rest = F.slice(values, F.lit(step + 1), F.greatest(F.size(values) - step, F.lit(0)))
    return F.zip_with(values, rest, lambda a, b: F.xxhash64(a, b))


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words inside windows that occur more than once: repeated starts, sorted, each covering up to the next."""

    def next_of(x: Column) -> Column:
        return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))

    def starts_of(ranked: Column) -> Column:
        both = F.zip_with(ranked, next_of(ranked), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    def total(starts: Column) -> Column:
        widths = F.zip_with(starts, next_of(starts), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0), lambda acc, x: acc + x)

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bind(_bind(ranked, starts_of), total)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_exclamations, n_lines, n_dup_lines, n_repeat_words (long)
    and fail_bits (long, bit i set where rule i of RULES fails).

    The measurements leave through a generator of one row, past which the optimizer moves no filter: a filter on the bits
    is not rewritten into copies of all expressions behind them, so every rule is evaluated once."""
    made = ["n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_repeat_words",
            "fail_bits"]
    keep = [c for c in docs.columns if c not in made]
    whole = F.coalesce(F.col(text), F.lit(""))
    flat = whole
    for c in SPACES:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    q = docs.select(*keep, whole.alias("_whole"), flat.alias("_flat"))
    lines = F.filter(F.split("_whole", "\n"), lambda x: F.length(_without(x, (" ", *SPACES))) > 0)
    q = q.select(
        *keep,
        F.array_remove(F.split("_flat", " "), "").alias("_words"),
        F.length(F.replace("_flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("_whole") - F.length(_without(F.col("_whole"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_whole") - F.length(_without(F.col("_whole"), "!"))).cast("long").alias("n_exclamations"),
        lines.alias("_lines"))
    counts = ["n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines"]
    q = q.select(
        *keep, "word_chars", "n_symbols", "n_exclamations",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"))
    for step in (1, 2, 4):
        q = q.select(*keep, *counts, _pairs(F.col(f"_h{step}"), step).alias(f"_h{2 * step}"))
    q = q.select(*keep, *counts, F.slice("_h8", F.lit(1), F.greatest(F.size("_h8") - (WINDOW - 1), F.lit(0))).alias("_w"))
    repeated = F.size(F.array_distinct("_w")) < F.size("_w")
    q = q.select(*keep, *counts,
                 F.when(repeated, _covered(F.col("_w"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return q.select(*keep, F.inline(F.array(F.struct(*made[:-1], bits.alias("fail_bits")))))


def fails(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Ledger rows with `kept`: true where the document passes every rule of the policy."""
    return rows.withColumn("kept", ~fails(policy))


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """rule, failing, only_rule, kept, kept_without: one row per rule of the policy, from one aggregation over
    the bits. `only_rule` counts documents that no other rule of the policy rejects."""
    mask, names = mask_of(policy), list(RULES)
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count(F.when(hit == 0, 1)).alias("kept")]
    for rule in POLICIES[policy]:
        bit = 1 << names.index(rule)
        sums += [F.count(F.when(hit.bitwiseAND(F.lit(bit).cast("long")) != 0, 1)).alias(f"f_{rule}"),
                 F.count(F.when(hit == bit, 1)).alias(f"o_{rule}")]
    per_rule = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failing"),
                                  F.col(f"o_{r}").alias("only_rule"), F.col("kept"),
                                  (F.col("kept") + F.col(f"o_{r}")).alias("kept_without")) for r in POLICIES[policy]))
    return rows.agg(*sums).select(F.inline(per_rule))
