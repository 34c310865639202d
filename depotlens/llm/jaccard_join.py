"""Exact Jaccard self-join on word n-grams with adaptive multi-match prefixes.

Shingle hashes give every document the same global order of tokens. Of two documents that link, the
first ``n - ceil(tn) + l`` tokens share at least ``l``. Tokens that many documents have in their prefixes
are hot and never paired. A document with ``k`` hot tokens gets a prefix longer by ``k``, and longer by
another ``m - 1`` the more candidates its other tokens promise; a pair must then share ``m`` tokens that
are not hot before it is verified. A document whose hot tokens exceed its stored prefix is open: pairs
of two open documents are sought around the purest document of each hot token, its centre, and what these stars
leave in different components is compared by its differences from the centre. Those of near copies are few and
differ from each other where the copies themselves share almost all tokens.

Equal sets are one node. Only pairs that are still in different components are verified, so a group of
copies costs about as many verifications as it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import checkpointed, fresh, numbered, release, sized_broadcast
from depotlens.llm.components import components
from depotlens.llm.words import give_back, windows, words_of
from depotlens.session import small_batches

SHINGLE_WORDS = 4
PERCENT = 85
HOT = 24
SPARE = 8
SAMPLE_NODES = 8000
COSTS = (64, 512)  # estimated candidates from which a second and a third shared token is asked for


def shingle_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of every row. A text of fewer words is one shingle, one without words none."""
    for batch in batches:
        for words in words_of(batch.column("text")):
            row, value = windows(words, size)
            at = words.bounds()
            counts = np.diff(at)
            for short in range(1, size):
                few, part = windows(words, short)
                whole = counts[few] == short
                row, value = np.concatenate([row, few[whole]]), np.concatenate([value, part[whole]])
            order = np.argsort(row, kind="stable")
            row, value = row[order], value[order]
            cuts = np.searchsorted(row, np.arange(words.rows + 1))
            yield (batch.slice(words.first, words.rows),
                   [np.unique(value[cuts[i]:cuts[i + 1]]) for i in range(words.rows)])
    give_back()


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _key(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` of which a linked set must share one."""
    return n - -(-percent * n // 100) + 1


def stored_length(n: int, percent: int) -> int:
    """Tokens kept of a set: half as many again as the shortest prefix, and ``SPARE``."""
    p = prefix_length(n, percent)
    return min(n, p + p // 2 + SPARE)


def prefixes(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_key, tokens): set size, a 128-bit key of the whole set, its stored tokens."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in shingle_sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_key(s) for s in sets], pa.binary()),
                 _lists([s[:stored_length(len(s), percent)] if len(s) else s for s in sets])],
                ["doc_id", "n_shingles", "set_key", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        read, "doc_id bigint, n_shingles bigint, set_key binary, tokens array<bigint>")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, tokens) of the documents in ``wanted`` (doc_id, set_key), all tokens; one set per doc_id."""
    chosen = docs.select(F.col("doc_id").cast("bigint"), "text").join(sized_broadcast(wanted), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in shingle_sets(batches, size):
            own = pa.array([_key(s) == k for s, k in zip(sets, rows.column("set_key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _lists(sets)], ["doc_id", "tokens"]).filter(own)

    return chosen.mapInArrow(read, "doc_id bigint, tokens array<bigint>").dropDuplicates(["doc_id"])


def _most_extra(n: str, percent: int) -> str:
    """SQL: the largest l for which the prefix of a set of ``n`` tokens is stored."""
    p = f"({n} - ({percent} * {n} + 99) div 100 + 1)"
    return f"(least({n}, {p} + {p} div 2 + {SPARE}) - {p} + 1)"


def _profiles(nodes: DataFrame, percent: int, hot: int) -> DataFrame:
    """Per node that may have a link: its shared tokens, l, m, and whether it is open.

    A token is hot if more than ``hot`` nodes of a bounded sample have it in their prefixes, or more than ``hot``
    of all nodes. Any choice of hot tokens gives the same links; the sample, whose frequent tokens are as bounded
    as itself, keeps tokens that a large share of all nodes have out of the count.
    """
    sample = nodes.select("doc").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_NODES)
    frequent = nodes.join(F.broadcast(sample), "doc", "left_semi").select(F.explode("tokens").alias("token")).groupBy(
        "token").agg(F.count(F.lit(1)).alias("in_sample")).where(F.col("in_sample") > hot)
    tokens = nodes.select("doc", F.posexplode("tokens").alias("pos", "token")).join(F.broadcast(frequent), "token", "left")
    df = F.count(F.lit(1)).over(W.partitionBy("token"))
    counted = tokens.where("in_sample is null").select("doc", "pos", "token").withColumn("df", df).where("df > 1").select(
        "doc", F.struct("pos", "token", (F.col("df") > hot).alias("hot"), "df").alias("e"))
    known = tokens.where("in_sample is not null").select("doc", F.struct(
        "pos", "token", F.lit(True).alias("hot"), F.col("in_sample").alias("df")).alias("e"))
    entries = counted.unionByName(known).groupBy("doc").agg(F.collect_list("e").alias("e")).join(
        nodes.select("doc", "n"), "doc")
    base = F.expr(f"n - ({percent} * n + 99) div 100")  # the prefix for l is base + l
    partner = _most_extra(f"(({percent} * n + 99) div 100)", percent)  # what the smallest partner has stored
    with_cost = entries.withColumns({
        "base": base, "most": F.expr(_most_extra("n", percent)), "least_most": F.expr(partner),
        "hot_pos": F.expr("array_sort(transform(filter(e, x -> x.hot), x -> x.pos))"),
        "cost": F.expr(f"aggregate(filter(e, x -> not x.hot and x.pos <= n - ({percent} * n + 99) div 100), 0L, "
                       "(a, x) -> a + x.df - 1)"),
    }).withColumn("m", 1 + sum((F.col("cost") >= c).cast("int") for c in COSTS))
    # k hot tokens lie in the prefix for l = k + m: the smallest k with hot_pos[k] >= base + k + m
    def k_for(m: str):
        return F.expr("coalesce(array_min(filter(transform(hot_pos, (p, i) -> if(p >= base + i + "
                      f"{m}, i, null)), x -> x is not null)), size(hot_pos))")

    with_k = with_cost.withColumns({"k1": k_for("1"), "km": k_for("m")})
    fits = F.col("km") + F.col("m") <= F.col("least_most")
    # every token that a linked document shares is shared, so with too few of them there is no link
    done = with_k.where("size(e) >= least_most").withColumns({
        "open": F.col("k1") + 1 > F.col("least_most"),
        "m": F.when(fits, F.col("m")).otherwise(F.lit(1)),
        "k": F.when(fits, F.col("km")).otherwise(F.col("k1")),
    }).withColumn("l", F.when(F.col("open"), F.col("most")).otherwise(F.col("k") + F.col("m")))
    return done.select(
        "doc", "n", "open", "l", "m", "base", "most",
        F.expr("transform(filter(e, x -> not x.hot and x.pos < base + l), x -> x.token)").alias("cold"),
        F.expr("transform(filter(e, x -> open and x.hot and x.pos <= base), x -> x.token)").alias("hot"),
        F.expr("transform(e, x -> x.token)").alias("shared"),
        (1 - F.size("hot_pos") / (F.col("base") + F.col("most"))).alias("purity"))


def _sized(percent: int) -> str:
    """Two sets of so different sizes cannot link."""
    return f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)"


def _cold_pairs(profiles: DataFrame, percent: int) -> DataFrame:
    """(x, y, matches): pairs that share as many tokens outside the hot ones as their prefixes ask for."""
    def side(s: str) -> DataFrame:
        return profiles.select(F.explode("cold").alias("token"), *[
            F.col(c).alias(f"{s}_{c}") for c in ("doc", "n", "open", "l", "m")])

    pairs = side("x").join(side("y"), "token").where("x_doc < y_doc").where(_sized(percent))
    need = F.expr("case when x_open and y_open then 1 when x_l <= y_l then x_m else y_m end")
    return pairs.withColumn("need", need).groupBy(F.col("x_doc").alias("x"), F.col("y_doc").alias("y")).agg(
        F.count(F.lit(1)).alias("matches"), F.first("need").alias("need")).where("matches >= need").drop("need")


def _hot_members(profiles: DataFrame) -> DataFrame:
    """(token, doc, n, purity) of the open nodes; the purest node has the least share of tokens that are not hot."""
    return profiles.where("open").select(F.explode("hot").alias("token"), "doc", "n", "purity")


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Every open node with the purest node of each of its hot tokens."""
    centres = members.groupBy("token").agg(F.min(F.struct("purity", "doc", "n")).alias("c"))
    pairs = members.join(centres, "token").where("doc <> c.doc").select(
        F.least("doc", "c.doc").alias("x"), F.greatest("doc", "c.doc").alias("y"),
        F.col("n").alias("x_n"), F.col("c.n").alias("y_n"))
    return pairs.where(_sized(percent)).select("x", "y").distinct()


def _bounds(sets: DataFrame, percent: int) -> DataFrame:
    """(doc, n, most_n) of the candidates that may still have a link, judged by their whole sets.

    The common tokens of a pair are among those that each of the two shares with any candidate. With s of these,
    a document of n tokens can only link with documents of at most s * (100 + percent) / percent - n tokens.
    """
    tokens = sets.select(F.col("doc_id").alias("doc"), F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    counts = tokens.join(shared, "token").groupBy("doc", "n").agg(F.count(F.lit(1)).alias("s"))
    return counts.selectExpr("doc", "n", f"s * {100 + percent} div {percent} - n as most_n").where(
        f"100 * most_n >= {percent} * n")


def _allowed(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """The pairs whose sizes suit the bounds of both."""
    x = bounds.select(F.col("doc").alias("x"), F.col("n").alias("x_n"), F.col("most_n").alias("x_most"))
    y = bounds.select(F.col("doc").alias("y"), F.col("n").alias("y_n"), F.col("most_n").alias("y_most"))
    return pairs.join(x, "x").join(y, "y").where("y_n <= x_most and x_n <= y_most").select(*pairs.columns)


def _differences(members: DataFrame, bounds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(centre, c_component, c_slack, doc, n, most_n, component, difference, slack) of open nodes that may have a partner.

    Every node comes once with each of the centres, the purest nodes, of its hot tokens. ``difference`` holds the tokens
    that one of the two sets has and the other has not. A node whose bound is below all sizes under a token, or that has
    only nodes of its own component there, has no partner under it.
    """
    rows = members.drop("n").join(bounds, "doc")
    sizes = rows.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"),
                                      F.min("n").alias("least_n"), F.max("most_n").alias("most"))
    left = rows.join(sizes, "token").where("a <> b and most_n >= least_n and n <= most")
    centres = left.groupBy("token").agg(F.min(F.struct("purity", "doc", "component")).alias("c"))
    grouped = left.join(centres, "token").select(
        F.col("c.doc").alias("centre"), F.col("c.component").alias("c_component"), "doc", "n", "most_n", "component").distinct()
    x = sets.select(F.col("doc_id").alias("doc"), F.col("tokens").alias("x_set"))
    c = sets.select(F.col("doc_id").alias("centre"), F.col("tokens").alias("c_set"))
    return grouped.where("doc <> centre").join(x, "doc").join(c, "centre").select(
        "centre", "c_component", (F.size("c_set") * (percent - 100)).alias("c_slack"), "doc", "n", "most_n", "component",
        F.concat(F.array_except("x_set", "c_set"), F.array_except("c_set", "x_set")).alias("difference")).withColumn(
        "slack", F.size("difference") * (100 + percent) - F.col("n") * (100 - percent))


def _rest_pairs(members: DataFrame, bounds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of open nodes in different components that may link, as far as their components need them.

    Let d(x) be the difference of x from a centre. As x and y differ in |d(x)| + |d(y)| - 2 |d(x) & d(y)| tokens, they link if
    2 (100 + percent) |d(x) & d(y)| >= slack(x) + slack(y), with slack = (100 + percent) |d| - (100 - percent) n. Where
    the right side is not positive, both link with the centre. Elsewhere they share a token of their differences. With
    these in one order, rare ones first, the first common token has enough others behind it in both.
    """
    per_token = 2 * (100 + percent)
    near = checkpointed(_differences(members, bounds, sets, percent))
    stars = near.where("slack + c_slack <= 0 and component <> c_component").select(
        F.least("doc", "centre").alias("x"), F.greatest("doc", "centre").alias("y"))

    # the least slack under a centre, and the least one outside of that component
    each = near.groupBy("centre", "component").agg(F.min("slack").alias("slack"))
    first = each.groupBy("centre").agg(F.min(F.struct("slack", "component")).alias("first"))
    others = each.join(first, "centre").where("component <> first.component").groupBy("centre", "first").agg(
        F.min("slack").alias("other"))
    tokens = near.join(others, "centre").withColumn(
        "need", F.expr("slack + if(component = first.component, other, first.slack)")).where(
        F.size("difference") * per_token >= F.col("need")).select(
        "centre", "doc", "n", "most_n", "component", "slack", "need", F.explode("difference").alias("token"))
    shared = tokens.groupBy("centre", "token").agg(
        F.count(F.lit(1)).alias("df"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    nodes = ["centre", "doc", "n", "most_n", "component", "slack", "need"]
    prefix = tokens.join(shared.select("centre", "token", "df"), ["centre", "token"]).groupBy(*nodes).agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("e")).select(
        *nodes, F.size("e").alias("size"), F.posexplode("e").alias("pos", "entry")).withColumn(
        "behind", (F.col("size") - F.col("pos")) * per_token).where("behind >= need")

    def side(s: str) -> DataFrame:
        return prefix.select("centre", F.col("entry.token").alias("token"), *[
            F.col(c).alias(f"{s}_{c}") for c in ("doc", "n", "most_n", "component", "slack", "behind")])

    pairs = side("x").join(side("y"), ["centre", "token"]).where(
        "x_component < y_component and y_n <= x_most_n and x_n <= y_most_n and x_slack + y_slack > 0"
        " and least(x_behind, y_behind) >= x_slack + y_slack").where(_sized(percent)).select(
        F.least("x_doc", "y_doc").alias("x"), F.greatest("x_doc", "y_doc").alias("y"))
    return pairs.unionByName(stars).distinct()


def _promising(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs that share as many stored tokens as two linked sets must: the longest prefixes that both have stored."""
    stored = profiles.select("doc", "most", "shared")
    x = stored.select(F.col("doc").alias("x"), F.col("most").alias("x_most"), F.col("shared").alias("x_shared"))
    y = stored.select(F.col("doc").alias("y"), F.col("most").alias("y_most"), F.col("shared").alias("y_shared"))
    enough = F.size(F.array_intersect("x_shared", "y_shared")) >= F.least("x_most", "y_most")
    return pairs.join(x, "x").join(y, "y").where(enough).select(*pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: 100 * intersection >= percent * union, on the whole sets."""
    x = sets.select(F.col("doc_id").alias("x"), F.col("tokens").alias("x_set"))
    y = sets.select(F.col("doc_id").alias("y"), F.col("tokens").alias("y_set"))
    both = pairs.select("x", "y").join(x, "x").join(y, "y")
    common = F.size(F.array_intersect("x_set", "y_set"))
    return both.where(100 * common >= percent * (F.size("x_set") + F.size("y_set") - common)).select("x", "y")


def _with_component(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    found = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def _further_sets(keyed: DataFrame, firsts: DataFrame, groups: DataFrame) -> DataFrame | None:
    """(set_key, doc, node) of sets whose first document already stands for another set; None if there are none.

    That takes different texts under one doc_id. Such a set is a node of its own, numbered beyond all doc_ids.
    """
    several = groups.where("sets > 1").select("doc", F.col("set_key").alias("_own"))
    if several.isEmpty():
        return None
    top = keyed.agg(F.max("doc_id")).first()[0]
    others = firsts.join(several, "doc").where("set_key <> _own").select("set_key", "doc")
    return checkpointed(numbered(others, [], ["set_key"], "_number").select(
        "set_key", "doc", (F.col("_number") + F.lit(top) + 1).alias("node")))


def _more_whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, tokens) of the further sets in ``wanted`` (set_key, doc, node), under the numbers of their nodes."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in shingle_sets(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), _lists(sets)],
                                             ["set_key", "tokens"])

    ids = sized_broadcast(wanted.select(F.col("doc").alias("doc_id")).distinct())
    chosen = docs.select(F.col("doc_id").cast("bigint"), "text").join(ids, "doc_id", "left_semi").select("text")
    return chosen.mapInArrow(read, "set_key binary, tokens array<bigint>").join(wanted, "set_key").select(
        F.col("node").alias("doc_id"), "tokens").dropDuplicates(["doc_id"])


def _nodes(keyed: DataFrame, groups: DataFrame, several: DataFrame, further: DataFrame | None) -> DataFrame:
    """(doc, n, tokens): the first document of each group of equal sets.

    The others, a minority as a rule, are taken out by their ids; ids with several rows are looked at apart.
    """
    rows = keyed.select("doc_id", "set_key")
    leading = groups.select(F.col("doc").alias("doc_id"), F.col("set_key").alias("own"))
    follow = rows.join(leading, "doc_id", "left").where("own is null or own <> set_key").select("doc_id")
    apart = sized_broadcast(follow.unionByName(several).distinct())
    once = keyed.join(apart, "doc_id", "left_anti")
    repeated = keyed.join(several, "doc_id", "left_semi").join(
        leading, "doc_id").where("own = set_key").drop("own").dropDuplicates(["doc_id"])
    nodes = once.unionByName(repeated).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "tokens")
    if further is None:
        return nodes
    return nodes.unionByName(keyed.join(further.select("set_key", "node"), "set_key").select(
        F.col("node").alias("doc"), F.col("n_shingles").alias("n"), "tokens").dropDuplicates(["doc"]))


def _labelled(docs: DataFrame, size: int, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key, component_id, leads) of every row, and the ids of several rows.

    ``leads`` marks rows without words and those of one set in each component, under that set's smallest id.
    """
    with small_batches(docs.sparkSession):
        read = checkpointed(prefixes(docs, size, percent))
    several = sized_broadcast(read.where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    keyed = read.where("set_key is not null and doc_id is not null")
    firsts = keyed.groupBy("set_key").agg(F.min("doc_id").alias("doc"))
    groups = checkpointed(firsts.groupBy("doc").agg(F.min("set_key").alias("set_key"), F.count(F.lit(1)).alias("sets")))
    further = _further_sets(keyed, firsts, groups)
    nodes = _nodes(keyed, groups, several, further)
    profiles = checkpointed(_profiles(nodes, percent, hot))
    cold = checkpointed(_promising(_cold_pairs(profiles, percent), profiles))
    release(docs.sparkSession)
    members = _hot_members(profiles)

    # the partner with the most common tokens for every node, and the centres of the hot tokens
    ends = cold.select(F.col("x").alias("a"), F.col("y").alias("b"), "matches").unionByName(
        cold.select(F.col("y").alias("a"), F.col("x").alias("b"), "matches"))
    best = ends.groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b")).select(
        F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    first = checkpointed(best.unionByName(_promising(_star_pairs(members, percent), profiles)).distinct())

    open_ids = profiles.where("open").select("doc")
    ids = cold.select(F.explode(F.array("x", "y")).alias("doc")).unionByName(open_ids).distinct()
    wanted = ids.join(groups, "doc").select(F.col("doc").alias("doc_id"), "set_key")
    found = whole_sets(docs, wanted, size)
    if further is not None:
        found = found.unionByName(_more_whole_sets(
            docs, further.join(ids, further["node"] == ids["doc"], "left_semi"), size))
    with small_batches(docs.sparkSession):
        sets = checkpointed(found)
    bounds = checkpointed(_bounds(sets, percent))
    release(docs.sparkSession)
    labels = components(_verified(_allowed(first, bounds), sets, percent), "x", "y")

    release(docs.sparkSession)
    apart = _with_component(_with_component(cold, "x", labels, "cx"), "y", labels, "cy").where("cx <> cy")
    rest = _allowed(apart.select("x", "y"), bounds).unionByName(_promising(_rest_pairs(
        _with_component(members, "doc", labels, "component"), bounds, sets, percent), profiles)).join(
        first, ["x", "y"], "left_anti").distinct()
    more = checkpointed(_verified(rest, sets, percent))
    release(docs.sparkSession)
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more),
                            "x", "y")

    node_of = firsts.withColumn("node", F.col("doc"))
    if further is not None:
        numbers = further.select("set_key", F.col("node").alias("_node"))
        node_of = node_of.join(numbers, "set_key", "left").withColumn("node", F.coalesce("_node", "node")).drop("_node")
    node_of = _with_component(node_of, "node", labels, "component_id").withColumn(
        "leads", F.col("node") == F.col("component_id"))
    if further is not None:  # the smallest id of any text of the component
        least = _with_component(further.select("node", "doc"), "node", labels, "component_id").groupBy(
            "component_id").agg(F.min("doc").alias("_least"))
        node_of = node_of.join(least, "component_id", "left").withColumn(
            "component_id", F.least("component_id", "_least"))
    rows = read.select("doc_id", "n_shingles", "set_key")
    return rows.join(node_of.select("set_key", "doc", "leads", "component_id"), "set_key", "left").select(
        "doc_id", "n_shingles", "set_key",
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id")).alias("component_id"),
        (F.col("set_key").isNull() | (F.col("leads") & (F.col("doc_id") == F.col("doc")))).alias("leads")), several


def linked(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest doc_id reachable over links, the document included; documents
    without words link with nothing. Rows that repeat a doc_id and its text have equal results; different texts
    under one doc_id are documents of their own, each with its own links. A NULL doc_id keeps a NULL component. Other
    columns are not read.
    """
    rows, _ = _labelled(docs, size, percent, hot)
    return rows.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One document of each component, with its own columns: rows that repeat a doc_id and its words are kept once.

    Of documents without words each id is kept once; rows without an id all stay.
    """
    rows, several = _labelled(docs, size, percent, hot)
    leading = rows.where("leads and doc_id is not null").select("doc_id", "set_key").distinct()
    no_id = docs.where(F.col("doc_id").isNull())
    if several.isEmpty():
        return docs.join(sized_broadcast(leading.select("doc_id")), "doc_id", "left_semi").unionByName(no_id)
    leading, key = checkpointed(leading), fresh(docs, "_set_key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in shingle_sets(batches, size):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_key(s) for s in sets], pa.binary())],
                                             [*part.schema.names, key])

    once = docs.join(several, "doc_id", "left_anti").join(
        sized_broadcast(leading.select("doc_id").distinct()), "doc_id", "left_semi")
    repeated = docs.join(several, "doc_id", "left_semi").mapInArrow(
        read, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    chosen = leading.select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_key"))
    repeated = repeated.join(chosen, (repeated["doc_id"] == chosen["_id"]) & repeated[key].eqNullSafe(chosen["_key"]),
                             "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns)).unionByName(no_id)
