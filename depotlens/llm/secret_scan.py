"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

All of it is DataFrame expressions. A text is read row by row and nothing is shuffled by the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import fresh

# fixed values: the base patterns, by kind in report order, with the least length of the checked group
KEYWORD = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = {
    "assign": (KEYWORD, 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),  # at least 18 characters of the greedy AKIA[A-Z0-9]+
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
MARKOV = "markov"
ORDER = [*BASE_KINDS, MARKOV]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = 128
SYMBOLS = 65  # what a candidate is made of, for smoothing
SMOOTHING = 0.5
CONTEXT_WEIGHT = 8.0  # how many characters' worth the model without context counts for
MIN_TOTAL = 15.0
MIN_MEAN = 0.5
SAMPLE_ROWS = 20_000
SAMPLE_CHARS = 256
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(values: Column, least: int) -> Column:
    """The strings of a list that have at least so many characters."""
    return F.filter(values, lambda s: F.length(s) >= least)


def _spans(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Spans of the leftmost non-overlapping matches whose group is long enough.

    The pieces between the matches give their places: the text is cut at the matches and the lengths
    of pieces and matches are added up.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), matches.alias("matches"), groups.alias("groups"))

    def walk(parts: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found"))

        def step(acc: Column, i: Column) -> Column:
            start = acc.at + F.length(F.element_at(parts.pieces, i))
            end = start + F.length(F.element_at(parts.matches, i))
            span = F.struct(start.cast("bigint").alias("start"), F.lit(ORDER.index(kind)).alias("rank"),
                            end.cast("bigint").alias("end"), F.lit(kind).alias("kind"))
            long_enough = F.length(F.element_at(parts.groups, i)) >= least
            found = F.when(long_enough, F.concat(acc.found, F.array(span).cast(SPAN))).otherwise(acc.found)
            return F.struct(end.cast("bigint").alias("at"), found.alias("found"))

        numbers = F.sequence(F.lit(1), F.size(parts.matches))
        return F.when(F.size(parts.matches) > 0, F.aggregate(numbers, begin, step, lambda acc: acc.found)).otherwise(
            F.array().cast(SPAN))

    return F.when(text.rlike(pattern), _bound(cut, walk)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by start and then by kind as listed."""
    found = [_spans(text, *rule, kind) for kind, rule in BASE_KINDS.items()]
    return F.array_sort(F.concat(*found))


def labelled_samples(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
                     sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Strings for training, as (sample, label): values of base matches are random (1), the other
    words of identifier characters are ordinary (0).

    Taken from at most ``sample_rows`` rows, those with the smallest key hashes; only keys pass the
    one task that picks them. Strings beyond ``sample_chars`` characters are left out.
    """
    chosen = docs.select(F.xxhash64(key).alias("_h")).orderBy("_h").limit(sample_rows).distinct()
    chosen = F.broadcast(chosen)  # as bounded as the sample
    rows = docs.select(F.col(text).alias("_text"), F.xxhash64(key).alias("_h")).join(chosen, "_h", "left_semi")
    values = [F.regexp_extract_all("_text", F.lit(p), F.lit(g)) for p, g, _ in BASE_KINDS.values()]
    least = [n for *_, n in BASE_KINDS.values()]
    random = F.concat(*[_long(v, n) for v, n in zip(values, least)])
    rest = F.col("_text")
    for pattern, *_ in BASE_KINDS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0))
    parts = [rows.select(F.explode(values).alias("sample"), F.lit(label).alias("label"))
             for values, label in ((random, 1), (ordinary, 0))]
    return parts[0].unionByName(parts[1]).where(F.length("sample") <= sample_chars)


def train(samples: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Log-likelihood ratio, random against ordinary, of each character given the one before it.

    Rows (cell, llr) for all pairs of ASCII characters, cell = 128 * previous + next. Rare contexts lean
    on the frequency of the next character alone; a label without samples has a uniform model. NULL samples and other characters count for nothing.
    """
    characters = F.split("sample", "")
    pairs = F.transform(
        F.sequence(F.lit(2), F.length("sample")),
        lambda i: F.ascii(F.element_at("_c", i - 1)) * ALPHABET + F.ascii(F.element_at("_c", i)))
    counts = (
        samples.where(F.length("sample") >= 2).withColumn("_c", characters)
        .select("label", F.explode(pairs).alias("cell"))
        .where(F.col("cell").between(0, ALPHABET * ALPHABET - 1))
        .groupBy("cell").agg(*[F.sum((F.col("label") == k).cast("bigint")).alias(f"n{k}") for k in (0, 1)])
    )
    grid = samples.sparkSession.range(ALPHABET * ALPHABET).select(F.col("id").alias("cell"))
    full = grid.join(counts, "cell", "left").na.fill(0).withColumns({
        "_from": F.expr(f"cell div {ALPHABET}"), "_to": F.col("cell") % ALPHABET})

    def totals(column: str, name: str) -> DataFrame:
        return full.groupBy(column).agg(*[F.sum(f"n{k}").alias(f"{name}{k}") for k in (0, 1)])

    def log_p(k: int) -> Column:
        everything = full.agg(F.sum(f"n{k}")).scalar()
        alone = (F.col(f"to{k}") + smoothing) / (everything + smoothing * SYMBOLS)
        return F.log((F.col(f"n{k}") + CONTEXT_WEIGHT * alone) / (F.col(f"from{k}") + CONTEXT_WEIGHT))

    return full.join(totals("_from", "from"), "_from").join(totals("_to", "to"), "_to").select(
        "cell", (log_p(1) - log_p(0)).alias("llr"))


def scan(docs: DataFrame, model: DataFrame, text: str = "text", spans: str = "secret_spans",
         min_total: float = MIN_TOTAL, min_mean: float = MIN_MEAN) -> DataFrame:
    """Add column ``spans``: start, rank, end and kind of every secret, in order of start and kind.

    Base spans always stay. A candidate string outside them is a secret if its log-likelihood ratio
    reaches ``min_total`` and ``min_mean`` per character pair. A NULL or empty text has no spans.
    The model is a fixed 128 x 128 table, so it travels as one literal. An own column ``spans`` is replaced.
    """
    llr = [row.llr for row in model.orderBy("cell").collect()]
    cells = F.split(F.lit(",".join(map(repr, llr))), ",").cast("array<double>")
    whole = F.coalesce(F.col(text), F.lit(""))

    def keep(candidates: Column, base: Column) -> Column:
        def ratio(token: Column) -> Column:
            def total(c: Column) -> Column:
                return F.aggregate(F.sequence(F.lit(2), F.size(c)), F.lit(0.0), lambda acc, i: acc + F.element_at(
                    cells, F.ascii(F.element_at(c, i - 1)) * ALPHABET + F.ascii(F.element_at(c, i)) + 1))
            return _bound(F.split(token, ""), total)

        def is_secret(s: Column) -> Column:
            free = ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end))
            length = s.end - s.start
            value = F.substring(whole, s.start.cast("int") + 1, length.cast("int"))
            least = F.greatest(F.lit(min_total), F.lit(min_mean) * (length - 1))
            return free & (F.when(free, ratio(value)).otherwise(F.lit(-math.inf)) >= least)

        return F.filter(candidates, is_secret)

    base, more = fresh(docs, "_base"), fresh(docs, "_candidates")
    found = docs.withColumns({base: base_spans(whole), more: _spans(whole, CANDIDATE, 0, 20, MARKOV)})
    return found.withColumn(spans, F.array_sort(F.concat(base, keep(F.col(more), F.col(base))))).drop(base, more)


def digest(docs: DataFrame, spans: str = "secret_spans") -> DataFrame:
    """Counts per base kind, the hash of the base spans and the text of all spans."""
    column = F.col(spans)

    def listed(chosen: Column) -> Column:
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(column, lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    base = F.filter(column, lambda s: s.kind != MARKOV)
    return docs.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                       listed(column).alias("spans"))


def redact(docs: DataFrame, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """Replace every secret by ``<secret>``; overlapping spans are replaced as one. NULL texts stay NULL."""
    def step(acc: Column, s: Column) -> Column:
        new = s.start >= acc.at
        gap = F.substring(F.col(text), acc.at.cast("int") + 1, (s.start - acc.at).cast("int"))
        out = F.when(new, F.concat(acc.out, gap, F.lit("<secret>"))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    replaced = F.aggregate(spans, begin, step, lambda acc: F.concat(
        acc.out, F.substring(
            F.col(text), acc.at.cast("int") + 1, F.length(text))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, replaced).otherwise(F.col(text)))
