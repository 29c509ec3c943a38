"""Temperature mixing of sources, with column functions and SQL operations only.

A source with t tokens of all gets a weight proportional to t ** exponent: 1 keeps the
natural shares, 0 makes all sources equal. The exponent is bisected, on a grid of
millionths and 64 points at a time, until the mixture meets a target entropy or a limit
on how often a source is repeated. Weights then become token quotas, realised as block
permutations: documents are dealt to blocks of bounded size, every epoch of a source
passes its blocks in a new order, full epochs take all blocks, and the last one takes
blocks, then documents of one block, while the quota lasts. The running sums over a
source's blocks go over lots of neighbouring blocks first, then inside each lot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stash

#: The most often that a source may be repeated, unless a target entropy is asked for.
MAX_REPEATS = 2.0
#: Documents to a block on average.
BLOCK_DOCUMENTS = 1_000
#: Bytes that count as one token.
TOKEN_BYTES = 4
GRID, POINTS = 1_000_000, 64
#: Hexadecimal digits of a block's place that name its lot: 4,096 lots of a source and epoch at most.
LOT_DIGITS = 3
SEED = "mix"


def token_count(text: Column) -> Column:
    """Tokens of a text, estimated from its bytes; none for null and empty texts."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / TOKEN_BYTES).cast("long")


def find_exponent(totals: DataFrame, holds, lowest: int, highest: int) -> float:
    """The least exponent of the grid for which holds, a column over totals' aggregates, is true; the highest if none is.

    holds gets the column of exponents and returns a condition on aggregates of the column
    share; it must stay true once it is.
    """
    low, high = lowest, highest
    while low < high:
        step = max(1, (high - low) // POINTS)
        tries = F.explode(F.sequence(F.lit(low), F.lit(max(low, high - 1)), F.lit(step))).alias("try")
        met = totals.select("share", tries).groupBy("try").agg(holds(F.col("try") / GRID).alias("met"))
        state = met.agg(F.min(F.when(F.col("met"), F.col("try"))).alias("yes"), F.max(F.when(~F.col("met"), F.col("try"))).alias("no")).first()
        low = low if state["no"] is None else max(low, state["no"] + 1)
        high = high if state["yes"] is None else min(high, state["yes"])
    return low / GRID


def mixture(totals: DataFrame, *, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None) -> DataFrame:
    """Adds weight, quota (tokens to take) and exponent to a table of (key, tokens), one row per source with tokens.

    All three are null where the table has no tokens; keys and tokens aren't null.

    Without a budget, the source with the highest share is taken exactly once and every
    other at least once. With one, quotas share it out. target_entropy (in nats) sets the
    exponent so that the weights' entropy is at most that, as close as the grid allows;
    otherwise the exponent is the least, up to 1, that repeats no source more than max_repeats.
    """
    whole = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    if not whole["all"]:
        return totals.select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("weight", "double"), ("quota", "long"), ("exponent", "double"))))
    shares = totals.withColumn("share", F.col("tokens") / F.lit(whole["most"]))
    share = F.col("share")
    if target_entropy is not None:
        def holds(a: Column) -> Column:
            mass = F.sum(F.pow(share, a))
            return F.log(mass) - F.max(a) * F.sum(F.pow(share, a) * F.log(share)) / mass <= target_entropy

        exponent = find_exponent(shares, holds, 0, 8 * GRID)
    elif budget_tokens is None:
        exponent = find_exponent(shares, lambda a: F.max(F.pow(share, a - 1)) <= max_repeats, 0, GRID)
    else:
        scale = budget_tokens / whole["most"]
        exponent = find_exponent(shares, lambda a: F.max(F.pow(share, a - 1)) * scale / F.sum(F.pow(share, a)) <= max_repeats, 0, GRID)
    mass = shares.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    weight = F.pow(share, F.lit(exponent)) / F.lit(mass)
    quota = F.floor(F.lit(whole["most"]) * F.pow(share, F.lit(exponent))) if budget_tokens is None else F.floor(weight * budget_tokens)
    return shares.select("*", weight.alias("weight"), quota.cast("long").alias("quota"), F.lit(exponent).alias("exponent")).drop("share")


def _order(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(SEED), *parts))


def mix(docs: DataFrame, *, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None, block_documents: int = BLOCK_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out_col: str = "mix") -> DataFrame:
    """Takes documents from all sources by the mixture's quotas.

    Returns the input's columns and, in a column out_col of structs, which replaces one of that name, tokens, epoch, block,
    before (tokens of the source's epochs and blocks that come first) and quota. A row comes
    once for every epoch that takes it. A null source is the source without a name, as is an
    empty one. Sources without tokens have no weight and give no rows; empty documents of
    other sources go with their blocks. Rows of one source that repeat an id are taken or left
    together. An empty table gives no rows. Other columns of the input may have any names.
    """
    id_col, text_col, source_col = (f"`{c}`" for c in (id_col, text_col, source_col))
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    narrow = stash(docs.select(F.col(id_col).cast("string").alias("id"), key.alias("key"), token_count(F.col(text_col)).alias("tokens")), "mix-sizes")
    totals = stash(narrow.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.ceil(F.count("*") / block_documents).cast("long").alias("blocks")).filter("tokens > 0"), "mix-totals")
    plan = stash(mixture(totals, target_entropy=target_entropy, max_repeats=max_repeats, budget_tokens=budget_tokens), "mix-plan")
    plan = plan.select("key", "blocks", "quota", F.col("tokens").alias("total"), F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("epochs"))

    def block_of(row_id: Column) -> Column:
        return F.pmod(F.conv(F.substring(_order("key", row_id), 1, 12), 16, 10).cast("long"), F.col("blocks"))

    placed = narrow.join(plan, "key").withColumn("block", block_of(F.coalesce("id", F.lit(""))))
    sized = stash(placed.groupBy("key", "block").agg(F.sum("tokens").alias("size")), "mix-blocks")
    epochs = sized.join(plan, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    placed_blocks = epochs.withColumn("place", _order("key", "epoch", "block")).withColumn("lot", F.substring("place", 1, LOT_DIGITS))
    lots = placed_blocks.groupBy("key", "epoch", "lot").agg(F.sum("size").alias("lot_size"))
    lots = lots.withColumn("lot_ahead", F.sum("lot_size").over(Window.partitionBy("key", "epoch").orderBy("lot")) - F.col("lot_size")).drop("lot_size")
    passing = Window.partitionBy("key", "epoch", "lot").orderBy("place", "block")
    in_lot = placed_blocks.join(lots, ["key", "epoch", "lot"]).withColumn("ahead", F.col("lot_ahead") + F.sum("size").over(passing) - F.col("size"))
    ahead = in_lot.withColumn("left", F.when(F.col("epoch") < F.col("epochs"), F.col("total")).otherwise(F.col("quota") - F.col("epochs") * F.col("total")) - F.col("ahead"))
    taken = stash(ahead.filter("left > 0").select("key", "block", "epoch", (F.col("epoch") * F.col("total") + F.col("ahead")).alias("before"), "quota", "left", (F.col("left") < F.col("size")).alias("cut")), "mix-taken")

    # One block of each source at most is cut; the documents of it that still fit, in the epoch's order.
    inside = Window.partitionBy("key", "block", "epoch").orderBy(_order("key", "epoch", "id"), "id")
    of_cut = placed.groupBy("key", "block", "id").agg(F.sum("tokens").alias("tokens")).join(taken.filter("cut").select("key", "block", "epoch", "left"), ["key", "block"])
    fitting = of_cut.withColumn("until", F.sum("tokens").over(inside)).filter("until <= left").select("key", F.coalesce("id", F.lit("")).alias("id"), "epoch", F.lit(True).alias("fits"))
    # Written, so that its size is known: with few sources it is small enough to go to every task, and whole rows needn't be shuffled.
    fitting = stash(fitting, "mix-fitting")

    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != out_col)).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), key.alias("key"), token_count(F.col(text_col)).alias("tokens"))
    dealt = row.join(plan.select("key", "blocks"), "key").withColumn("block", block_of(F.col("id")))
    held = dealt.join(taken, ["key", "block"]).join(fitting, ["key", "id", "epoch"], "left").filter("not cut or fits")
    return held.select("row.*", F.struct("tokens", "epoch", "block", "before", "quota").alias(out_col))
