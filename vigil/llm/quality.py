"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source, then a joined filter.

Everything is a DataFrame expression. Words are runs of [^\\x20\\x09-\\x0D]; a null text has none. Each document's
signals are computed inside its own row (no row per word is made), so the only shuffle carries one small quantile
summary per language, source and task; no group is gathered anywhere, however many documents a source holds.

Every signal is a number of events (symbols, repeated lines, lines' worth of repeated words) on an exposure (words, lines). A
group's usual rate is an upper quantile of its documents' rates: the highest of LADDER that is reached from the median by
steps no larger than chance explains, so that junk, which stands apart from the rest, does not raise it unless it is half of a
group. The fence of a document is the usual rate plus what chance adds to it at Z standard deviations on the document's own
exposure (at most that of a long document of the group): few events say little of a short text, so a line said twice in five
is let pass and forty in a hundred are not. Usual rates are drawn towards those of the language, and these towards those of
the corpus, by PRIOR documents' weight. No signal has a cut-off of its own: what is rejected follows from the quantiles
of the documents around it. Documents that the base rule fails take no part in the summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Documents of fewer words fail, as do those of which more than half the words stand in repeated three-word windows.
MIN_WORDS = 50
#: Standard deviations of chance that a rate may exceed the usual one by.
Z = 3.0
#: Quantiles of a group's rates from which the usual one is taken, and the quantile that tells its long documents.
LADDER, LONG = (0.5, 0.75, 0.9, 0.95, 0.99), 0.95
#: Documents' weight of the next wider group in a group's usual rate.
PRIOR = 100
#: GK summary: rank error of at most 1 / ACCURACY of a group's rows.
ACCURACY = 2000


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def ordered_windows(w: Column) -> Column:
    """(hash, position) of each three-word window of an array of words, sorted."""
    n = F.size(w)
    keyed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n >= 4, F.sort_array(keyed))


def repeated_words(ordered: Column) -> Column:
    """Words that stand in a three-word window which occurs twice or more, from ordered_windows.

    Windows with an equal neighbour are repeated. Their positions, sorted again, cover min(3, gap to the next) words each.
    ordered must be a column of its own: an expression would be evaluated anew for each element.
    """
    same = lambda j, h: F.coalesce(F.get(ordered, j)["h"] == h, F.lit(False))
    twice = F.filter(ordered, lambda x, j: same(j - 1, x["h"]) | same(j + 1, x["h"]))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return F.coalesce(covered, F.lit(0).cast("long"))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null and empty texts have zeros and fail the base rule; equal lines count from the second on; equal rows get equal values.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    w = docs.withColumn("_w", words(F.col(text))).withColumn("_lines", lines).withColumn("_ordered", ordered_windows(F.col("_w")))
    return (
        w.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, SPACE, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_ordered")))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")))
        .drop("_w", "_lines", "_ordered")
    )


def rates() -> dict[str, tuple[Column, str]]:
    """Of each signal its rate and the column of its exposure; repeated words count as the lines that they would fill."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": (F.col("n_symbols") / n, "n_words"),
        "dup_line_rate": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"), "n_lines"),
        "repeat_rate": (F.col("n_repeat_words") / n, "n_lines"),
    }


def chance(rate: Column, exposure: Column) -> Column:
    """The rate that events of a usual rate stay below on an exposure, at Z standard deviations."""
    return rate + F.lit(Z) * F.sqrt(rate / exposure) + F.lit(Z * Z) / exposure


def usual(quantiles: Column, exposure: Column) -> Column:
    """The highest quantile that is reached by steps which chance explains on the group's median document."""
    rate, reached = F.get(quantiles, F.lit(0)), F.lit(True)
    for i in range(1, len(LADDER)):
        step = F.get(quantiles, F.lit(i))
        reached = reached & (step <= chance(rate, exposure))
        rate = F.when(reached, step).otherwise(rate)
    return rate


def thresholds(scored: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per group: usual_ of each rate and long_ of each exposure, drawn towards those of the wider groups.

    by goes from wide to narrow; the summaries of all prefixes of by are merged from the tasks' in one pass.
    """
    signal, exposures = rates(), ("n_words", "n_lines")
    q = scored.where("not base_failed").rollup(*by).agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).cast("double").alias("_rows"), *(F.percentile_approx(c, list(LADDER), ACCURACY).alias(k) for k, (c, _) in signal.items()),
        *(F.percentile_approx(c, [0.5, LONG], ACCURACY).alias(f"_{c}") for c in exposures),
    )
    at = lambda c, i: F.greatest(F.get(f"_{c}", F.lit(i)), F.lit(1)).cast("double")
    names = [*(f"usual_{k}" for k in signal), *(f"long_{c}" for c in exposures)]
    found = [*(usual(F.col(k), at(m, 0)).alias(f"usual_{k}") for k, (_, m) in signal.items()), *(at(c, 1).alias(f"long_{c}") for c in exposures)]
    levels = written(q.select(*by, "_level", "_rows", *found), "levels")
    out = levels.where("_level = 0").select(*by, F.struct("_rows", *names).alias("_0"))
    for i in range(1, len(by) + 1):
        level, keys = (1 << i) - 1, by[: len(by) - i]
        wider = levels.where(F.col("_level") == level).select(*(F.col(k).alias(f"_w_{k}") for k in keys), F.struct("_rows", *names).alias(f"_{i}"), F.lit(0).alias("_same"))
        on = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]
        out = out.withColumn("_zero", F.lit(0)).join(wider, [F.col("_zero") == F.col("_same"), *on], "left").drop("_zero", "_same", *(f"_w_{k}" for k in keys))

    def drawn(name: str) -> Column:
        value = F.col(f"_{len(by)}.{name}")
        for i in reversed(range(len(by))):
            rows = F.col(f"_{i}._rows")
            value = (rows * F.col(f"_{i}.{name}") + F.lit(float(PRIOR)) * value) / (rows + F.lit(float(PRIOR)))
        return value.alias(name)

    return out.select(*by, *(drawn(n) for n in names))


def fences() -> dict[str, Column]:
    """Of each rate the document's fence, from usual_ and long_ of its group and its own exposure."""
    exposure = lambda m: F.least(F.greatest(F.col(m), F.lit(1)).cast("double"), F.col(f"long_{m}"))
    return {f"max_{k}": chance(F.col(f"usual_{k}"), exposure(m)) for k, (_, m) in rates().items()}


#: Groups whose fences are sent to every task at most; with more, Spark joins them by shuffling.
BROADCAST_GROUPS = 20_000


def judge(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry + by columns, signals, the document's fences (max_ of each rate), base_failed and kept, one row per row of docs.

    kept is false where the base rule fails, else whether every rate is within its fence. Groups with a null
    language or source are groups like others (joins are null-safe, the wider groups are told apart by their level). An
    empty table gives an empty table.
    The signals are written once, so the texts are read once for thresholds and verdicts alike.
    """
    keys = [k for k in dict.fromkeys([*carry, *by])]
    scored = written(signals(docs.select(*dict.fromkeys([*keys, text])), text).select(*keys, *SIGNALS), "quality")
    groups = written(thresholds(scored, by).withColumnsRenamed({k: f"_g_{k}" for k in by}), "fences")
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    on = [scored[k].eqNullSafe(groups[f"_g_{k}"]) for k in by]
    joined = scored.join(F.broadcast(groups) if small else groups, on, "left").withColumns(fences()).drop(*(c for c in groups.columns))
    within = F.lit(True)
    for k, (c, _) in rates().items():
        within = within & (c <= F.col(f"max_{k}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed")
