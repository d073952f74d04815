"""Temperature mixing of sources: weights, and block permutations that realise them within a token budget.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasieve.llm.scratch import written

HALVINGS, ROUNDS = 6, 5


def _key(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def _block(seed: int, doc_id: Column, tie: Column, n_blocks: Column) -> Column:
    """By id; rows without one are dealt by their texts."""
    key = F.when(doc_id.isNull(), _key(seed, "", tie)).otherwise(_key(seed, doc_id))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n_blocks


def _token_columns() -> list[Column]:
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("text").alias("tie"),
    ]


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, tie): words of each whole text and a hash of it; null source counts as ''."""
    return docs.select(*_token_columns())


def _last(shares: DataFrame, holds: Column) -> float | None:
    """The last exponent in [0, 1] at which a condition holds that holds from 0 on; None if not even there."""
    low, wide = 0.0, 1.0
    for _ in range(ROUNDS):
        wide /= 1 << HALVINGS
        points = [low + wide * j for j in range((1 << HALVINGS) + 1)]
        power = F.pow("share", F.col("x"))
        at = (
            shares.select("share", F.posexplode(F.array(*map(F.lit, points))).alias("j", "x"))
            .groupBy("j")
            .agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("e"), F.max(power / F.col("share")).alias("r"), F.max(F.col("share") / power).alias("s"), F.count("share").alias("n"))
        )
        j = at.where(holds).agg(F.max("j")).first()[0]
        if j is None or low + wide * j >= 1.0:
            return None if j is None else 1.0
        low += wide * j
    return low


def bisect_exponent(shares: DataFrame, target_entropy: float | None, max_repeat: float | None, budget_ratio: float | None) -> float:
    """The exponent in [0, 1] for ``shares(share)``; weights are share ** exponent, normalised.

    It is the largest whose weights have an entropy of ``target_entropy`` times
    the greatest possible, but large enough that no source is repeated more
    than ``max_repeat`` times (1 if none is). Each job evaluates the inner
    points of 64 equal parts of the bracket, which is six bisections at once;
    five jobs give thirty. Work is by source and point, 65 rows are reduced.
    """
    exponent = 1.0 if target_entropy is None else 0.0
    if target_entropy is not None:
        entropy = F.log("z") - F.col("e") / F.col("z")
        exponent = _last(shares, entropy >= target_entropy * F.log("n") - 1e-12) or 0.0
    if max_repeat is not None:
        repeats = F.col("r") * F.col("s") if budget_ratio is None else F.col("r") / F.col("z") * budget_ratio
        low = _last(shares, repeats > max_repeat + 1e-12)
        exponent = max(exponent, 0.0 if low is None else min(1.0, low + 2.0 ** -(HALVINGS * ROUNDS)))
    return exponent


def weights(tokens: DataFrame, target_entropy: float | None, max_repeat: float | None, budget_ratio: float | None, block_tokens: int) -> DataFrame:
    """(source, total, weight, quota, n_blocks, n_epochs) of every source with tokens, from a token table."""
    sums = written(tokens.groupBy("source").agg(F.sum("n_tokens").alias("total")).where("total > 0"), "mixing-sources")
    everything = sums.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shares = sums.withColumn("share", F.col("total") / F.lit(float(max(everything, 1))))
    exponent = bisect_exponent(shares, target_entropy, max_repeat, budget_ratio)
    power = F.pow("share", F.lit(exponent))
    norm, most = shares.agg(F.sum(power), F.max(F.col("share") / power)).first()
    norm = norm or 1.0
    ratio = budget_ratio if budget_ratio is not None else norm * (most or 0.0)
    quota = F.floor(F.col("weight") * F.lit(float(everything) * ratio))
    return (
        shares.withColumn("weight", F.round(power / F.lit(norm), 12))
        .withColumn("quota", quota if budget_ratio is not None else F.greatest(quota, F.col("total")))
        .withColumn("n_blocks", F.ceil(F.col("total") / F.lit(block_tokens)))
        .withColumn("n_epochs", F.greatest(F.ceil(F.col("quota") / F.col("total")), F.lit(1)))
        .select("source", "total", "weight", "quota", "n_blocks", "n_epochs")
    )


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = 0.92,
    max_repeat: float | None = 4.0,
    budget_ratio: float | None = 1.0,
    block_tokens: int = 1 << 20,
    seed: int = 17,
) -> DataFrame:
    """The mixed order of ``docs(doc_id, text, source)``: a row for each time that a document is drawn.

    Columns: source, epoch, block, doc_id, n_tokens, start (tokens of its source
    drawn before it), weight, quota, n_blocks, tie. The budget is ``budget_ratio`` times all
    tokens (None: the smallest that draws every document at least once); a source's quota is its weight's part of it. Every epoch permutes
    the source's blocks by hash, and the documents inside each block; draws end
    with the document that reaches the quota. Prefix sums are taken over shelves
    of blocks, the blocks of a shelf and then inside one block of about
    ``block_tokens`` tokens, so no task holds the documents of a large source.

    Null or wordless texts cost nothing and are drawn with their neighbours; a
    source without any token has no weight and is not drawn. Null sources count
    as one source ''. Repeated rows are drawn each for itself. Empty tables
    give no draws. Further columns are ignored.
    """
    tokens = written(token_table(docs), "mixing-tokens")
    plan = written(weights(tokens, target_entropy, max_repeat, budget_ratio, block_tokens), "mixing-weights")
    dealt = tokens.join(plan, "source").withColumn("block", _block(seed, F.col("doc_id"), F.col("tie"), F.col("n_blocks")))
    blocks = (
        dealt.groupBy("source", "block")
        .agg(F.sum("n_tokens").alias("tokens"), F.first("n_epochs").alias("n_epochs"))
        .select("source", "block", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_epochs") - 1)).alias("epoch"))
        .withColumn("block_key", _key(seed, F.col("epoch"), F.col("source"), F.col("block")))
        .withColumn("shelf", F.substring("block_key", 1, 3))
    )
    # Prefix sums over the 4096 shelves of an epoch, and then over the blocks of a shelf.
    sum_before = lambda column, *by: F.coalesce(F.sum(column).over(by[0].rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shelves = blocks.groupBy("source", "epoch", "shelf").agg(F.sum("tokens").alias("tokens"))
    shelves = shelves.select("source", "epoch", "shelf", sum_before("tokens", W.partitionBy("source", "epoch").orderBy("shelf")).alias("shelf_before"))
    on_shelf = W.partitionBy("source", "epoch", "shelf").orderBy("block_key", "block")
    blocks = blocks.join(shelves, ["source", "epoch", "shelf"]).select("source", "epoch", "block", (F.col("shelf_before") + sum_before("tokens", on_shelf)).alias("before"))
    inside = W.partitionBy("source", "epoch", "block").orderBy("doc_key", "doc_id", "n_tokens", "tie").rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.select("source", "block", "doc_id", "n_tokens", "tie", "total", "weight", "quota", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_epochs") - 1)).alias("epoch"))
        .join(blocks, ["source", "epoch", "block"])
        .withColumn("doc_key", _key(seed, F.col("epoch"), F.col("doc_id")))
        .withColumn("start", F.col("epoch") * F.col("total") + F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where("start < quota")
        .select("source", "epoch", "block", "doc_id", "n_tokens", "start", "weight", "quota", "n_blocks", "tie")
    )


def realise(docs: DataFrame, draws: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` draws it (with the same seed).

    Texts stay where they are: for each source only the last drawn place of its
    last epoch is looked up, and every row compares its own hash keys with it.
    Repeated rows share a place; if only some of those at the last place are
    drawn, they alone are numbered, in up to 64 groups a source.
    """
    no_id = F.lit(-(2**63))
    place = lambda source, epoch, block, doc_id, n_tokens, tie: F.struct(
        epoch.alias("epoch"),
        _key(seed, epoch, source, block).alias("block_key"),
        block.alias("block"),
        _key(seed, epoch, doc_id).alias("doc_key"),
        F.coalesce(doc_id, no_id).alias("doc_id"),
        n_tokens.alias("n_tokens"),
        tie.alias("tie"),
    )
    places = written(draws.select("source", "n_blocks", place(*map(F.col, ("source", "epoch", "block", "doc_id", "n_tokens", "tie"))).alias("place")), "mixing-places")
    last = written(places.groupBy("source").agg(F.max("place").alias("last"), F.max("n_blocks").alias("n_blocks")), "mixing-last")
    there = places.join(last.select("source", "last"), "source").where(F.col("place") == F.col("last")).groupBy("source").agg(F.count("*").alias("quota"))
    ends = written(last.join(there, "source"), "mixing-ends")

    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(whole, *_token_columns()).join(ends, "source")
    epoch = F.col("last.epoch")
    mine = place(F.col("source"), epoch, _block(seed, F.col("doc_id"), F.col("tie"), F.col("n_blocks")), F.col("doc_id"), F.col("n_tokens"), F.col("tie"))
    order = F.when(mine < F.col("last"), -1).when(mine == F.col("last"), 0).otherwise(1)
    judged = rows.select("row", "source", "quota", epoch.alias("epoch"), order.alias("order"))
    sure = judged.where("order <> 0").select("row", (F.col("epoch") + F.when(F.col("order") < 0, 1).otherwise(0)).alias("copies"))
    # The rows at the last place, dealt into groups and numbered: within a group, and by the groups before it.
    tied = written(judged.where("order = 0").select("row", "source", "quota", "epoch", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("part")), "mixing-tied")
    before = tied.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = before.select("source", "part", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("source", "part").orderBy(F.lit(0))) + F.col("before")
    some = tied.join(before, ["source", "part"]).withColumn("number", number).select("row", (F.col("epoch") + F.when(F.col("number") <= F.col("quota"), 1).otherwise(0)).alias("copies"))
    drawn = sure.unionAll(some).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
