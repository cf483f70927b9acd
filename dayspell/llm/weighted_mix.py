"""Mixing sources to target weights through a domain, language, source tree.

A token budget is handed down the tree by weights. A node cannot take more than its documents yield in the allowed
epochs; what it cannot take goes to its siblings by their weights, and to the ancestors' siblings only if all its own
are full. Every leaf then takes a token prefix of its seeded epochs. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspell.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: A table of leaves up to this many rows may be sent to every executor (some 200 bytes a row).
MOST_SENT = 50_000


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers per name; names without one get `default`. A weight of 0 takes nothing."""

    domain: Column
    domain_weights: dict[str, int] = field(default_factory=dict)
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    default: int = 1
    #: budget = share x tokens of the table, unless `budget` names the tokens
    share: float = 1.0
    budget: int | None = None
    epochs: int = 1
    seed: str = "mix"

    def weight(self, level: str) -> Column:
        known = getattr(self, f"{level}_weights")
        out = F.lit(self.default)
        for name, weight in known.items():
            out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
        return out.cast("decimal(18,0)")


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `got` to `nodes` (parents, name, cap, weight, given): the parent's `given` tokens dealt by weight, none above
    its cap. In the order of cap / weight, a node is full if all up to its level can be served; the others share the
    rest, rounded down, and the tokens left by rounding go one each to the first names."""
    order = [F.col("cap").cast("double") / F.col("weight").cast("double"), F.col(name)]
    group = Window.partitionBy(*(parents or [F.lit(0)]))
    ahead = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    behind = group.orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    d = nodes.withColumn("caps", F.sum("cap").over(ahead).cast("decimal(20,0)"))
    d = d.withColumn("rest_weight", F.coalesce(F.sum("weight").over(behind), F.lit(0)).cast("decimal(18,0)"))
    d = d.withColumn("full", F.col("caps") * F.col("weight") + F.col("cap") * F.col("rest_weight") <= F.col("given") * F.col("weight"))
    open_cap = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))
    open_weight = F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))
    d = d.withColumn("left", (F.col("given") - F.sum(open_cap).over(group)).cast("decimal(20,0)"))
    d = d.withColumn("weights", F.sum(open_weight).over(group).cast("decimal(18,0)"))
    exact = F.col("left") * F.col("weight")
    d = d.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(
        ((exact - exact % F.col("weights")) / F.col("weights")).cast("decimal(20,0)")))
    shared = F.when(F.col("full"), F.lit(0)).otherwise(F.col("got"))
    d = d.withColumn("over", F.col("left") - F.sum(shared).over(group))
    d = d.withColumn("turn", F.row_number().over(group.orderBy("full", name)))
    return d.withColumn("got", (F.col("got") + F.when(~F.col("full") & (F.col("turn") <= F.col("over")), 1).otherwise(0)).cast("decimal(20,0)"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, tokens, budget for every leaf (domain, lang, source, tokens) of the tree."""
    weighed = leaves
    for level in LEVELS:
        weighed = weighed.withColumn(f"w_{level}", mix.weight(level))
    alive = F.least(*[F.col(f"w_{level}") for level in LEVELS]) > 0
    weighed = weighed.withColumn(
        "cap", F.when(alive, F.col("tokens") * mix.epochs).otherwise(0).cast("decimal(20,0)")).where("cap > 0")
    tokens = leaves.agg(F.sum("tokens").cast("decimal(20,0)")).first()[0] or Decimal(0)
    most = weighed.agg(F.sum("cap").cast("decimal(20,0)")).first()[0] or Decimal(0)
    wanted = mix.budget if mix.budget is not None else int(tokens * Decimal(str(mix.share)))
    top = F.lit(Decimal(min(wanted, int(most)))).cast("decimal(20,0)")

    def level_nodes(depth: int) -> DataFrame:
        names = LEVELS[: depth + 1]
        return weighed.groupBy(*names).agg(F.sum("cap").cast("decimal(20,0)").alias("cap"), F.max(f"w_{names[-1]}").alias("weight"))

    got = _fill(level_nodes(0).withColumn("given", top), [], "domain").select("domain", F.col("got").alias("given"))
    got = _fill(level_nodes(1).join(got, "domain"), ["domain"], "lang").select("domain", "lang", F.col("got").alias("given"))
    got = _fill(level_nodes(2).join(got, ["domain", "lang"]), ["domain", "lang"], "source")
    got = got.select(*LEVELS, F.col("got").alias("budget"))
    return (leaves.join(got, list(LEVELS), "left")
            .select(*LEVELS, "tokens", F.coalesce(F.col("budget"), F.lit(0)).cast("long").alias("budget")))


def _named(documents: DataFrame, mix: Mix) -> DataFrame:
    """The documents with columns m_doc (all of theirs), domain, lang, source (null: empty) and their tokens."""
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    return documents.select(
        whole.alias("m_doc"), mix.domain.alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def _key(epoch: Column, seed: str) -> Column:
    """The seeded order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.col("m_doc.doc_id").cast("string")).cast("binary"))


def select_mix(documents: DataFrame, mix: Mix) -> DataFrame:
    """m_doc (the row), domain, lang, source, tokens, epoch, taken for every document and epoch that the mix takes.

    `documents` needs doc_id, text, lang, source. Null languages and sources are the leaf with the empty name; texts
    without a word hold no token and are never taken. Epochs run in the order of md5(seed:epoch:doc_id), equal keys by
    tokens; the document at the prefix's end is taken with the tokens that fit. Repeated rows are taken one by one. An
    empty table gives no rows.
    """
    # counts first: tokens per leaf, and per leaf and key bucket of each epoch (4096 buckets)
    counted = staged(_named(documents.select("doc_id", "text", "lang", "source"), mix)
                     .select(F.struct("m_doc.doc_id").alias("m_doc"), *LEVELS, "tokens").where("tokens > 0"))
    leaves = staged(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    budgets = staged(leaf_budgets(leaves, mix))
    budgets = budgets.where("budget > 0").select(
        *LEVELS, F.expr("budget div tokens").cast("int").alias("full_epochs"), F.expr("budget % tokens").alias("rest"))
    few = budgets.count() <= MOST_SENT

    def near(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if few else side

    bucket = F.substring("key", 1, 3)
    keyed = (counted.join(near(budgets.where("rest > 0")), list(LEVELS))
             .withColumn("key", _key(F.col("full_epochs"), mix.seed)).withColumn("bucket", bucket))
    running = Window.partitionBy(*LEVELS).orderBy("bucket")
    edge = (keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("n"))
            .withColumn("upto", F.sum("n").over(running))
            .where("upto >= rest and upto - n < rest")
            .select(*LEVELS, F.col("bucket").alias("edge"), (F.col("rest") - F.col("upto") + F.col("n")).alias("edge_rest")))
    plan = staged(budgets.join(edge, list(LEVELS), "left"))

    rows = _named(documents, mix).where("tokens > 0").join(near(plan), list(LEVELS))
    whole_epochs = rows.where("full_epochs > 0").select(
        "m_doc", *LEVELS, "tokens", F.explode(F.sequence(F.lit(0), F.col("full_epochs") - 1)).alias("epoch"),
        F.col("tokens").alias("taken"))
    last = (rows.where("edge is not null").withColumn("key", _key(F.col("full_epochs"), mix.seed))
            .withColumn("bucket", bucket).where("bucket <= edge"))
    inside = last.where("bucket < edge").select(
        "m_doc", *LEVELS, "tokens", F.col("full_epochs").alias("epoch"), F.col("tokens").alias("taken"))
    prefix = (Window.partitionBy(*LEVELS).orderBy("key", "m_doc.doc_id", "tokens")
              .rowsBetween(Window.unboundedPreceding, -1))
    at_edge = (last.where("bucket = edge")
               .withColumn("room", F.col("edge_rest") - F.coalesce(F.sum("tokens").over(prefix), F.lit(0)))
               .where("room > 0").select("m_doc", *LEVELS, "tokens", F.col("full_epochs").alias("epoch"),
                                         F.least("tokens", "room").alias("taken")))
    return whole_epochs.union(inside).union(at_edge)


def mixed(documents: DataFrame, mix: Mix) -> DataFrame:
    """The rows of `documents` that the mix takes, whole and as often as it takes them, with their own columns. Texts without
    a word cost no budget and all stay; null and empty texts are such. An empty table gives an empty one."""
    taken = select_mix(documents, mix).select("m_doc")
    free = _named(documents, mix).where("tokens = 0").select("m_doc")
    return taken.union(free).select(*[F.col("m_doc")[c].alias(c) for c in documents.columns])
