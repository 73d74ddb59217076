"""Mixing sources to target weights over a domain-language-source tree.

The leaves are (domain, language, source); a leaf can give its tokens once per
epoch, `max_epochs` times at most. The budget runs down the tree: at each node it
is split among the children in proportion to their weights, no child above what
its leaves can give. What a child cannot take goes to its siblings in proportion
to their weights, and only what no child of a node can take is left to the node's
own siblings, since a node's capacity is the sum of its leaves.

Such a capped split has a closed form. With the children ordered by capacity over
weight, a child is filled if its capacity is below its share of what the children
after it leave over; the others divide the rest by weight. It is two running sums
over the children of a node.

A leaf takes whole epochs and then a prefix of one more epoch, in the order of a
seeded hash of the document. The prefix is found in two steps, so no leaf is
ordered as a whole: tokens are summed by slices of the hash range, and only the
slice in which the budget ends is ordered by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dockline.llm.common import settled, stored
from dockline.plans.ranking import small_or_stored

SLICE_DOCUMENTS = 4_096
LEVELS = ("domain", "lang", "source")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weight(column: str, weights: dict[str, float]) -> Column:
    """The weight of each value, 1 where none is given; `weights` is a short parameter."""
    out = F.lit(1.0)
    for value, number in weights.items():
        out = F.when(F.col(column) == value, F.lit(float(number))).otherwise(out)
    return out


def split_budget(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add `budget` to children (parent..., child, capacity, weight, parent_budget)."""
    order = W.partitionBy(*parent).orderBy("_ratio", child)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # a child of weight 0 takes only what the others cannot
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    ranked = nodes.withColumn("_ratio", F.coalesce(ratio, F.lit(float("inf"))))
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = ranked.withColumn("_filled", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn(
        "_open", F.sum("weight").over(onward))
    left = F.greatest(F.col("parent_budget") - F.col("_filled"), F.lit(0))
    share = F.when(F.col("weight") > 0, left * F.col("weight") / F.col("_open")).otherwise(left)
    fits = F.col("capacity") <= share
    # the first child that does not fit fixes the level for all after it
    ranked = ranked.withColumn("_fits", fits).withColumn("_left", left)
    after = order.rowsBetween(W.unboundedPreceding, 0)
    stuck = F.min(F.when(~F.col("_fits") & (F.col("weight") > 0), F.struct("_ratio", child, F.col("_left").alias("rest"), F.col("_open").alias("open")))).over(after)
    ranked = ranked.withColumn("_stuck", stuck)
    level = F.when(
        F.col("_stuck").isNotNull(), F.least(F.col("capacity").cast("double"), F.col("_stuck.rest") * F.col("weight") / F.col("_stuck.open"))
    ).otherwise(F.least(F.col("capacity").cast("double"), F.col("_left").cast("double")))
    return ranked.withColumn("budget", F.floor(level + F.lit(1e-6)).cast("long")).drop("_ratio", "_filled", "_open", "_fits", "_left", "_stuck")


def leaf_budgets(leaves: DataFrame, budget: Column | int, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens), one row for each leaf."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    given = None
    for depth, level in enumerate(LEVELS):
        own, above = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", weight(level, weights.get(level, {})))
        if given is None:
            nodes = nodes.withColumn("_top", F.lit(1)).withColumn("parent_budget", F.lit(budget).cast("long"))
            above = ["_top"]
        else:
            nodes = nodes.join(given, above)
        nodes = split_budget(nodes, above, level)
        given = nodes.select(*own, F.col("budget").alias("parent_budget"))
    return nodes.select(*LEVELS, "tokens", "budget")


def mixed(docs: DataFrame, *, weights: dict[str, dict[str, float]], domain: Column, budget_share: float = 0.8,
          max_epochs: int = 2, seed: int = 17, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, domain, lang, source, n_tokens, copies (0 if not taken).

    The budget is `budget_share` of all tokens (words). In its last epoch a leaf takes
    documents in the order of md5(seed:epoch:doc_id) while the tokens before them are
    below what is left of its budget, so the last one may pass it; ties of the hash
    (repeated or null ids) are ordered by the text's hash, and repeated rows share
    their fate. Null language or source is the name ''. A text without words adds
    nothing and is taken as often as its place says. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        domain.alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        word_count(F.col(text)).alias("n_tokens"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"),
    )
    rows = stored(rows, "mixing-rows")  # the texts are read once
    leaves = settled(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, int(total * budget_share), weights, max_epochs)
    plan = plan.join(leaves.select(*LEVELS, "documents"), list(LEVELS)).select(
        *LEVELS,
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
        # the number of slices follows the number of documents, so a slice stays small
        F.greatest(F.lit(1), F.least(F.ceil(F.col("documents") / SLICE_DOCUMENTS), F.lit(1 << 30))).cast("long").alias("slices"),
    )
    plan = small_or_stored(plan)  # one row for each leaf
    placed = rows.join(plan, list(LEVELS))
    spelled = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.conv(F.substring(spelled, 1, 8), 16, 10).cast("long")  # 32 bits of the hash, in its order
    placed = placed.withColumn("_order", spelled).withColumn("_slice", F.floor(place * F.col("slices") / F.lit(1 << 32)).cast("long"))
    placed = stored(placed, "mixing-placed")
    sums = placed.groupBy(*LEVELS, "_slice").agg(F.sum("n_tokens").alias("held"))
    before = W.partitionBy(*LEVELS).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    edges = sums.withColumn("_before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    edges = edges.join(plan.select(*LEVELS, "rest"), list(LEVELS))
    # the slice in which the budget ends: tokens before it are below the rest, those with it are not
    last = edges.filter("_before < rest AND rest <= _before + held").groupBy(*LEVELS).agg(
        F.min(F.struct("_slice", "_before")).alias("e")).select(*LEVELS, F.col("e._slice").alias("_last"), F.col("e._before").alias("_before"))
    marked = placed.join(small_or_stored(last), list(LEVELS), "left")
    inside = marked.filter("_slice = _last")
    by_order = W.partitionBy(*LEVELS, "_slice").orderBy("_order", "_th")
    inside = inside.withColumn("_start", F.col("_before") + F.coalesce(
        F.sum("n_tokens").over(by_order.rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)) - F.sum("n_tokens").over(
        W.partitionBy(*LEVELS, "_slice", "_order", "_th")))
    taken = inside.withColumn("_taken", (F.col("_start") < F.col("rest")).cast("int"))
    others = marked.filter("_last IS NULL OR _slice <> _last").withColumn("_taken", F.coalesce(F.col("_slice") < F.col("_last"), F.lit(False)).cast("int"))
    columns = ["doc_id", *LEVELS, "n_tokens", (F.col("whole") + F.col("_taken")).cast("int").alias("copies"), "_th"]
    return taken.select(*columns).unionAll(others.select(*columns))


def domain_of(source: str = "source") -> Column:
    """Test domains: sources are dealt to four by their last digit (parameter of the caller)."""
    digit = F.coalesce(F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9])$", 1), F.lit(""))
    return (
        F.when(digit.isin("0", "1", "2"), "web").when(digit.isin("3", "4", "5"), "books")
        .when(digit.isin("6", "7"), "news").otherwise("other")
    )
