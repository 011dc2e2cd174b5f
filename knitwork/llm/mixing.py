"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source with the share p of all tokens gets the weight p**alpha / sum of p**alpha. The exponent is
found by bisection: alpha = 1 keeps the natural shares, smaller values lift small sources, at
the price of repeating them. Nothing is dropped unless a budget asks for it: without one, the budget
is the least at which every document comes at least once.

Weights become documents through block permutations. In each epoch a source's documents are ordered
by a hash of seed, epoch and id; its first digits are the block. A source whose quota is 1.7 times
its tokens comes once whole, and once more up to the document at which the quota is reached. That
document is found from the token sums of blocks, and within one block of each source, so no source is
ever sorted as a whole: what goes back to the documents is one cut for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.llm.common import cut_lineage, fresh, own_columns, whole_text

STEPS = 50
#: Hexadecimal digits of a block's number: 4,096 blocks for each source and epoch.
BLOCK_DIGITS = 3
#: The broadcast cuts hold one row a source; with more sources the join is left to the planner.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def permutation_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_weights(tokens: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> DataFrame:
    """source, tokens, alpha, weight, quota from (source, n_tokens) rows. One aggregated row holds
    the distinct shares with the number of sources that have each, so it stays short where there
    are very many small sources; a step of the bisection is one pass over it.

    max_repeats: the smallest exponent at which no source comes more often than that (without a
    budget: relative to the least repeated one). target_entropy: the largest exponent whose weights
    have that entropy in nats. With both, the larger exponent holds, so the limit is kept."""
    sources = tokens.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("t"))
    sizes = sources.groupBy("t").agg(F.count("*").cast("double").alias("n"))
    row = sizes.agg(F.collect_list(F.struct("t", "n")).alias("sizes"), F.sum(F.col("t") * F.col("n")).alias("total"))
    shares = F.transform(F.filter("sizes", lambda s: s["t"] > 0), lambda s: F.struct((s["t"] / F.col("total")).alias("p"), s["n"].alias("n")))
    row = row.select("total", shares.alias("shares"))
    row = row.withColumn("least", F.array_min(F.transform("shares", lambda s: s["p"]))).withColumn("most", F.array_max(F.transform("shares", lambda s: s["p"])))

    def whole(alpha: Column) -> Column:
        """Sum of all p**alpha."""
        return F.aggregate("shares", F.lit(0.0), lambda a, s: a + s["n"] * F.pow(s["p"], alpha))

    def repeats(alpha: Column) -> Column:
        """weight / share is largest for the smallest share, and smallest for the largest."""
        if budget is None:
            return F.pow(F.col("least"), alpha - 1) / F.pow(F.col("most"), alpha - 1)
        return F.pow(F.col("least"), alpha - 1) / whole(alpha) * F.lit(float(budget)) / F.col("total")

    def entropy(alpha: Column) -> Column:
        """ln Z - alpha * sum of p**alpha ln p / Z, with Z the sum of all p**alpha; both in one pass."""
        start = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("l"))

        def add(acc: Column, s: Column) -> Column:
            x = s["n"] * F.pow(s["p"], alpha)
            return F.struct((acc["z"] + x).alias("z"), (acc["l"] + x * F.ln(s["p"])).alias("l"))

        return F.aggregate("shares", start, add, lambda acc: F.ln(acc["z"]) - alpha * acc["l"] / acc["z"])

    def bisect(low_side) -> Column:
        """Largest alpha in [0, 1] up to which ``low_side`` holds, where it holds from 0 on."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            below = low_side(mid)
            return F.when(below, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: F.round(s["hi"], 9))

    found = [F.lit(0.0)]
    if max_repeats is not None:
        found.append(F.when(repeats(F.lit(0.0)) <= max_repeats, 0.0).otherwise(bisect(lambda a: repeats(a) > max_repeats)))
    if target_entropy is not None:
        found.append(F.when(entropy(F.lit(1.0)) >= target_entropy, 1.0).otherwise(bisect(lambda a: entropy(a) >= target_entropy)))
    alpha = F.lit(1.0) if len(found) == 1 else F.greatest(*found)
    # written, as the planner would copy the bisection into every use of its result
    solved = cut_lineage(row.withColumn("alpha", F.coalesce(alpha, F.lit(1.0))))
    spent = F.lit(float(budget)) if budget is not None else F.pow(F.col("most"), F.lit(1.0) - F.col("alpha")) * F.col("total") * F.col("whole")
    solved = solved.withColumn("whole", whole(F.col("alpha"))).select("total", "alpha", "whole", spent.alias("budget"))
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.col("total"), F.col("alpha")) / F.col("whole")).otherwise(0.0)
    # one row on the right: a lookup of scalars, not a product of tables
    joined = sources.join(F.broadcast(solved), F.lit(True))
    # half a token of slack, as quotas that are whole in theory come out a hair under it
    return joined.withColumn("weight", weight).select("source", F.col("t").cast("long").alias("tokens"), "alpha", "weight", F.floor(F.col("weight") * F.col("budget") + 0.5).alias("quota"))


def plan_mixture(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per source: weight, alpha, quota, whole (epochs in full) and cut (the largest key that still
    comes in the epoch after those; empty: none)."""
    narrow = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).alias("id"), word_count(whole_text(text_col)).alias("n_tokens"))
    narrow = cut_lineage(narrow)
    sources = source_weights(narrow, max_repeats, target_entropy, budget)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1)
    sources = cut_lineage(sources.withColumn("whole", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("whole") * F.col("tokens")).otherwise(0)))
    known = F.broadcast(sources) if sources.count() <= MAX_BROADCAST_SOURCES else sources
    keyed = narrow.join(known.select("source", "whole", "rest").filter("rest > 0"), "source").withColumn("key", permutation_key(F.col("whole"), F.col("id"), seed)).withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
    blocks = keyed.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut_block = blocks.withColumn("before", before).filter("before < rest").groupBy("source").agg(F.max_by(F.struct("block", "before"), "block").alias("at")).select("source", F.col("at.block").alias("block"), F.col("at.before").alias("before"))
    last = keyed.join(F.broadcast(cut_block) if sources.count() <= MAX_BROADCAST_SOURCES else cut_block, ["source", "block"])
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = last.withColumn("start", start).filter("start < rest").groupBy("source").agg(F.max("key").alias("cut"))
    return sources.join(cuts, "source", "left").withColumn("cut", F.coalesce("cut", F.lit("")))


def _copies(docs: DataFrame, plan: DataFrame, seed: int, id_col: str, source_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``docs`` once for each epoch they come in, and the names of the columns added:
    epoch, key, weight, alpha."""
    own = {n: fresh(docs, f"mix_{n}") for n in ("source", "whole", "cut", "weight", "alpha", "epochs", "epoch", "key")}
    plan = cut_lineage(plan.select(*[F.col(n).alias(own[n]) for n in ("source", "whole", "cut", "weight", "alpha")]))
    small = F.broadcast(plan) if plan.count() <= MAX_BROADCAST_SOURCES else plan
    doc = F.col(f"`{id_col}`")
    joined = docs.join(small, F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")) == F.col(own["source"]))
    again = permutation_key(F.col(own["whole"]), doc, seed) <= F.col(own["cut"])
    epochs = F.col(own["whole"]).cast("int") + again.cast("int")
    counted = joined.withColumn(own["epochs"], epochs).filter(F.col(own["epochs"]) > 0)
    exploded = counted.withColumn(own["epoch"], F.explode(F.sequence(F.lit(0), F.col(own["epochs"]) - 1)))
    return exploded.withColumn(own["key"], permutation_key(F.col(own["epoch"]), doc, seed)), own


def mixture(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **targets) -> DataFrame:
    """One row per document and epoch it comes in: doc_id, source, n_tokens (words), epoch, block,
    order_key (ascending within source and epoch), alpha, weight.

    A null source counts as the empty name; a null text has no words and comes in every whole epoch,
    as do all documents of a source without words; null ids share one key; repeated rows each
    come; an empty table gives no rows; other columns are ignored."""
    plan = plan_mixture(docs, seed=seed, id_col=id_col, source_col=source_col, text_col=text_col, **targets)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), word_count(whole_text(text_col)).alias("n_tokens"))
    out, own = _copies(rows, plan, seed, "doc_id", "source")
    return out.select("doc_id", "source", "n_tokens", F.col(own["epoch"]).alias("epoch"), F.substring(own["key"], 1, BLOCK_DIGITS).alias("block"), F.col(own["key"]).alias("order_key"), F.round(own["alpha"], 9).alias("alpha"), F.round(own["weight"], 9).alias("weight"))


def mixed_documents(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **targets) -> DataFrame:
    """The mixture as rows of ``docs``, all columns, whatever their names: a document is there once
    for each epoch. Nulls, empty texts and tables and repeated rows as in ``mixture``."""
    plan = plan_mixture(docs, seed=seed, id_col=id_col, source_col=source_col, text_col=text_col, **targets)
    return _copies(docs, plan, seed, id_col, source_col)[0].select(*own_columns(docs))


ORACLE = r"""
with recursive d as (
  select doc_id, coalesce(source, '') as source,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from documents),
s as (select source, cast(sum(n_tokens) as double) as t, sum(n_tokens)::double / (select sum(n_tokens) from d) as p from d group by source),
b(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1,
    case when (select max(pow(p, (lo + hi) / 2) / p) / min(pow(p, (lo + hi) / 2) / p) from s) > 2.0 then (lo + hi) / 2 else lo end,
    case when (select max(pow(p, (lo + hi) / 2) / p) / min(pow(p, (lo + hi) / 2) / p) from s) > 2.0 then hi else (lo + hi) / 2 end
  from b where i < 50),
a as (select case when (select max(1 / p) / min(1 / p) from s) <= 2.0 then 0.0 else (select round(hi, 9) from b where i = 50) end as alpha),
w as (select source, t, alpha, pow(p, alpha) / (select sum(pow(p, alpha)) from s) as weight,
             (select max(pow(p, 1 - alpha)) * sum(pow(p, alpha)) * sum(t) from s) as budget from s, a),
q as (select *, floor(floor(weight * budget + 0.5) / t) as whole, floor(weight * budget + 0.5) - floor(floor(weight * budget + 0.5) / t) * t as rest from w),
k as (select d.*, q.whole, q.rest, md5('17:' || cast(q.whole as bigint) || ':' || d.doc_id) as cut_key, q.alpha, q.weight from d join q using (source)),
c as (select *, coalesce(sum(n_tokens) over (partition by source order by cut_key rows between unbounded preceding and 1 preceding), 0) as start from k),
e as (select *, unnest(range(cast(whole as bigint) + case when start < rest then 1 else 0 end)) as epoch from c)
select doc_id, source, n_tokens, cast(epoch as integer) as epoch, substr(md5('17:' || epoch || ':' || doc_id), 1, 3) as block,
       md5('17:' || epoch || ':' || doc_id) as order_key, round(alpha, 9) as alpha, round(weight, 9) as weight
from e
"""
