"""Mixing sources to target weights by hierarchical budgets.

Leaves hang in a tree (domain, language, source). A token budget is split from the root down by weights; a node that cannot
spend its share, even when its documents repeat for the allowed number of epochs, leaves the rest to its siblings, and only
what all siblings together cannot spend stays unspent one level up, where it goes to the parent's siblings. Each leaf then takes a
token prefix of its endless sequence of epochs; every epoch has its own seeded order.

All amounts are whole tokens. A split is exact: shares are cut at cumulative weights, so that they add up to the budget.

Defined results. Null levels are a node named ''. Texts without words are never taken. Repeated rows are documents of their
own; equal places in the order are settled by the hash of the text. Weights default to 1 for nodes that the weight table does not name; a weight of
0 takes a node out. The document at the budget's edge is cut to the tokens that fit. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words

#: documents of a leaf are cut into this many ranges of their seeded hash, and the range at the budget's edge once more
RANGES = 1024
_BIG = "decimal(38,0)"


def split_budget(nodes: DataFrame, parent: str, cap: str, weight: str, budget: str, name: str) -> DataFrame:
    """Add ``share``: each parent's budget split among its children by weight, no child above its capacity.

    Children are visited by capacity per weight. While the visited child's capacity is at most its share of what is left it is
    filled; from the first that is not, all others split the rest by weight.
    """
    order = Window.partitionBy(parent).orderBy("_ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(parent)
    n = nodes.where(F.col(weight) > 0).withColumn("_ratio", F.col(cap) / F.col(weight))
    n = n.withColumn("_left", F.least(F.col(budget), F.sum(cap).over(whole)) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    n = n.withColumn("_w", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    n = n.withColumn("_full", F.col(cap).cast(_BIG) * F.col("_w") <= F.col("_left").cast(_BIG) * F.col(weight))
    n = n.withColumn("_open", F.max((~F.col("_full")).cast("int")).over(order))
    # the first open child knows the rest and the weight of all that share it
    first = F.when(F.col("_open") == 1, F.struct("_left", "_w"))
    n = n.withColumn("_rest", F.first(first, ignorenulls=True).over(whole.orderBy("_ratio", name).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    shared = F.when(F.col("_open") == 1, F.col(weight)).otherwise(0)
    upto = F.sum(shared).over(order).cast(_BIG)

    def cut(w: Column) -> Column:
        return F.floor((F.col("_rest._left").cast(_BIG) * w) / F.col("_rest._w")).cast("bigint")

    share = F.when(F.col("_open") == 0, F.col(cap)).otherwise(cut(upto) - cut(upto - F.col(weight)))
    return n.withColumn("share", share.cast("bigint")).drop("_ratio", "_left", "_w", "_full", "_open", "_rest")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, int], budget: int, epochs: int) -> DataFrame:
    """(levels, tokens, share) for leaves with their ``tokens``; ``weights`` are by path, levels joined by '/'."""
    depth = len(levels)
    path = {d: F.concat_ws("/", *levels[:d]) for d in range(1, depth + 1)}
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    weight = lambda p: (F.coalesce(table[p], F.lit(1)) if table is not None else F.lit(1)).cast("bigint")
    parents = None
    # what hangs below a weight of 0 can never be spent, so no capacity above counts it
    for d in range(1, depth + 1):
        leaves = leaves.where(weight(path[d]) > 0)
    for d in range(1, depth + 1):
        nodes = leaves.groupBy(*levels[:d]).agg((F.sum("tokens") * epochs).alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.select("*", path[d].alias("_name"), (path[d - 1] if d > 1 else F.lit("")).alias("_parent"),
                             weight(path[d]).alias("_weight"))
        if parents is None:
            nodes = nodes.withColumn("_budget", F.lit(budget).cast("bigint"))
        else:
            nodes = nodes.join(parents, list(levels[:d - 1]))
        done = split_budget(nodes, "_parent", "cap", "_weight", "_budget", "_name")
        if d < depth:
            # a parent's share counts what its own children can spend, so all capacities are sums over leaves that can be taken
            parents = done.select(*levels[:d], F.col("share").alias("_budget"))
    return done.select(*levels, "tokens", "share")


def _order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"))


def _range(key: Column, first: int) -> Column:
    """Ten bits of a hex key, from hex digit ``first`` on."""
    return (F.conv(F.substring(key, first, 3), 16, 10).cast("int") / 4).cast("int")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, int], budget: int | float, epochs: int = 4,
        seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, levels, epoch, n_tokens, take, text): ``take`` tokens of a document in one epoch of its leaf.

    ``budget`` is a number of tokens, or with a float that part of all tokens the corpus has.
    """
    names = list(levels)
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), *[F.coalesce(c, F.lit("")).alias(k) for k, c in levels.items()],
        F.size(words(F.col(text))).cast("bigint").alias("n_tokens"), F.xxhash64(text).alias("th"))
    slim = stored(slim.where("n_tokens > 0"), "mix-documents")
    leaves = stored(slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    if isinstance(budget, float):
        budget = int((leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0) * budget)
    shares = leaf_budgets(leaves, names, weights, budget, epochs).select(
        *names, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("part"))
    shares = stored(shares, "mix-shares")

    # whole epochs: all documents of the leaf; the last epoch: those before the token at the budget's edge
    keyed = slim.join(shares, names).withColumn("key", _order_key(seed, F.col("whole"), F.col("doc_id")))
    keyed = keyed.withColumn("r1", _range(F.col("key"), 1)).withColumn("r2", _range(F.col("key"), 4))

    def edges(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
        """Tokens before each range of the hash."""
        sums = rows.groupBy(*keys, by).agg(F.sum("n_tokens").alias("_n"))
        run = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*keys, by, F.coalesce(F.sum("_n").over(run), F.lit(0)).alias(f"_before_{by}"), F.col("_n").alias(f"_in_{by}"))

    last = keyed.where("part > 0").select("doc_id", "th", *names, "n_tokens", "whole", "part", "key", "r1", "r2")
    last = last.join(edges(last, names, "r1"), [*names, "r1"]).where("_before_r1 < part")
    clear = last.where("_before_r1 + _in_r1 <= part").withColumn("take", F.col("n_tokens"))
    at_edge = last.where("_before_r1 + _in_r1 > part")
    at_edge = at_edge.join(edges(at_edge, names, "r2"), [*names, "r2"])
    run = Window.partitionBy(*names, "r2").orderBy("key", "th").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("part") - F.col("_before_r1") - F.col("_before_r2") - F.coalesce(F.sum("n_tokens").over(run), F.lit(0))
    at_edge = at_edge.where("_before_r1 + _before_r2 < part").withColumn("take", F.least("n_tokens", room)).where("take > 0")
    columns = ["doc_id", "th", *names, "n_tokens", "take"]
    final = clear.select(*columns, F.col("whole").alias("epoch")).unionByName(at_edge.select(*columns, F.col("whole").alias("epoch")))
    full = keyed.where("whole > 0").select(
        "doc_id", "th", *names, "n_tokens", F.col("n_tokens").alias("take"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("epoch"))
    return full.unionByName(final)


def with_texts(mixed: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the taken text: whole, or the first ``take`` words where the budget ends inside the document.

    Documents that share an id and a text are one text here.
    """
    texts = docs.select(F.col(doc_id).alias("_i"), F.xxhash64(text).alias("_t"), F.col(text).alias("text")).dropDuplicates(["_i", "_t"])
    cut = F.when(F.col("take") < F.col("n_tokens"), F.array_join(F.slice(
        words(F.col("text")), F.lit(1), F.col("take").cast("int")), " ")).otherwise(F.col("text"))
    return mixed.join(texts, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))).select(*mixed.columns, cut.alias("text"))
