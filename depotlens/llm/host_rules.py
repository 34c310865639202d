"""Quality rules with verdicts on hosts: failures by host, rates shrunk by a beta prior fitted to all hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import fresh

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
POSITION_BITS = 24

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SOFT_RULES = {  # SQL conditions on the figures
    "symbols": "n_symbols * 10 > n_words",
    "duplicate_lines": "n_dup_lines * 2 > n_lines",
    "repetition": "n_repeat_words * 10 > n_words * 3",
    "shouting": "n_upper * 2 > word_chars",
}
MAX_HOST_RATE = 0.5
LEAST_PRIOR, MOST_PRIOR = 0.5, 1000.0


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column, size: int) -> Column:
    """Words that lie in windows of ``size`` words which the list holds twice or more.

    Hashes with positions in their low bits are sorted as plain integers; neighbours that agree in the
    high bits are the suspects, and only those are compared as text. Lists too long for the position
    bits skip the hash and compare every window.
    """
    n = F.size(words)

    def text_of(i: Column) -> Column:
        return F.array_join(F.slice(words, i + 1, F.lit(size)), " ")

    def suspects(packed: Column) -> Column:
        def agrees(x: Column, i: Column) -> Column:
            mine = F.shiftright(x, POSITION_BITS)
            left = F.when(i > 0, F.shiftright(packed[i - 1], POSITION_BITS) == mine).otherwise(F.lit(False))
            right = F.when(i + 1 < F.size(packed), F.shiftright(packed[i + 1], POSITION_BITS) == mine).otherwise(
                F.lit(False))
            return left | right

        return F.transform(F.filter(packed, agrees), lambda x: x.bitwiseAND((1 << POSITION_BITS) - 1).cast("int"))

    def pack(hashes: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.shiftleft(
            F.xxhash64(*[hashes[i + k] for k in range(size)]), POSITION_BITS).bitwiseOR(i.cast("bigint"))))

    hashed = _bound(_bound(F.transform(words, lambda w: F.xxhash64(w)), pack), suspects)
    places = F.when(n <= 1 << POSITION_BITS, hashed).otherwise(F.sequence(F.lit(0), n - size))

    def covered(sorted_: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            left = F.when(i > 0, sorted_[i - 1].w == x.w).otherwise(F.lit(False))
            right = F.when(i + 1 < F.size(sorted_), sorted_[i + 1].w == x.w).otherwise(F.lit(False))
            return left | right

        starts = F.transform(F.filter(sorted_, twice), lambda x: x.i)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(
            *[i + k for k in range(size)])))))

    texts = F.array_sort(F.transform(places, lambda i: F.struct(text_of(i).alias("w"), i.alias("i"))))
    return F.when(n >= size + 1, _bound(texts, covered)).otherwise(F.lit(0)).cast("bigint")


def word_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the figures that the rules use; own columns of these names are replaced. A NULL text counts as empty and has zeros."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    joined = F.regexp_replace(whole, SPACE, "")
    words = F.filter(F.split(whole, SPACE, -1), lambda w: w != "")
    return docs.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(joined).cast("bigint"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint"),
        "n_upper": (F.length(joined) - F.length(F.regexp_replace(joined, "[A-Z]", ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": _bound(words, lambda w: _repeated(w, WINDOW)),
    })


def failures(figures: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``failed``: the base rule, and the base or any soft rule."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    soft = F.lit(False)
    for rule in SOFT_RULES.values():
        soft = soft | F.expr(rule)
    return figures.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | soft)


def host_verdicts(failed: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, and ``host_ok``.

    The beta prior has the mean of all documents and a strength fitted by moments to the rates of the
    hosts, between ``LEAST_PRIOR`` and ``MOST_PRIOR`` documents; with fewer than two hosts it has the
    largest strength. A host is rejected when its shrunk rate exceeds ``max_rate``. NULL is a host.
    """
    hosts = failed.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"),
                                     F.sum(F.col("failed").cast("bigint")).alias("host_failures"))
    n, rate = F.col("host_docs"), F.col("host_failures") / F.col("host_docs")
    moments = hosts.agg(
        (F.sum("host_failures") / F.sum(n)).alias("mean"),
        F.var_samp(rate).alias("spread"), F.avg(1 / n).alias("noise"))
    mean = F.col("mean")
    between = F.col("spread") - mean * (1 - mean) * F.col("noise")
    strength = F.when(between > 0, mean * (1 - mean) / between - 1).otherwise(F.lit(MOST_PRIOR))
    strength = F.least(F.greatest(F.coalesce(strength, F.lit(MOST_PRIOR)), F.lit(LEAST_PRIOR)), F.lit(MOST_PRIOR))
    prior = moments.select(F.struct((mean * strength).alias("bad"), ((1 - mean) * strength).alias("good"))).scalar()
    shrunk = (F.col("host_failures") + F.col("_prior.bad")) / (n + F.col("_prior.bad") + F.col("_prior.good"))
    return hosts.withColumn("_prior", prior).withColumn("host_rate", shrunk).drop("_prior").withColumn(
        "host_ok", F.coalesce(F.col("host_rate") <= max_rate, F.lit(True)))


def judged(failed: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """Join the verdicts of the hosts back. A document is kept if it passed all rules and its host is not rejected."""
    name = fresh(failed, "_host")
    v = verdicts.select(F.col(host).alias(name), "host_rate", "host_ok")
    rows = failed.drop("host_rate", "host_ok")
    return rows.join(v, F.col(host).eqNullSafe(F.col(name)), "left").drop(name).withColumn(
        "kept", ~F.col("failed") & F.col("host_ok"))
