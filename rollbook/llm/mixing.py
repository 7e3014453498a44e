"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import ranked, settle, word_count

WEIGHTS = (3, 1, 2)
BLOCK = 2048  # words of a block; a source's last slot is cut so that its words meet the target


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes`` (src, source, source_size) with ``weight`` and ``target`` (double).

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all words by
    weight. A target stops at ``most`` times its source; the excess is shared by the others. With sources
    in the order of what a unit of weight may take at most, the stopped ones come first.
    """
    numbered = ranked(sizes, [], ["source", "src"])
    numbered = numbered.select(
        "src",
        "source_size",
        F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights)).cast("int")).alias(
            "weight"
        ),
        (F.col("source_size") * most).alias("cap"),
    ).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    filled = settle(ranked(numbered, [], ["ratio", "src"], ("cap", "weight")), "filled")
    all_ = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words = share * (all_["words"] or 0)
    level = (F.lit(words) - F.col("before_cap")) / (F.lit(all_["weight"] or 0) - F.col("before_weight"))
    stopped = F.col("ratio") <= level
    free = filled.where(~stopped).agg(F.sum("weight").alias("w")).first()["w"]
    taken = filled.where(stopped).agg(F.sum("cap").alias("c")).first()["c"] or 0
    target = F.col("cap").cast("double")
    if free:
        target = F.when(stopped, target).otherwise(F.col("weight") * ((words - taken) / free))
    return filled.select("src", "source_size", "weight", target.alias("target"))


def slots(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The schedule: (position, src, block, upto), ``position`` the slot's place in the mix.

    A source with n slots owns n neighbouring points of a grid of 2**m points, in the order of cumulative
    weights. The van der Corput sequence visits the grid's points in bit-reversed order, so each source
    has its slots evenly over the whole mix, and exactly n of them. Its slots, ranked by position, take its
    blocks in order: whole passes first, then the rest, the last block up to word ``upto`` of the source.
    """
    words = F.floor(F.col("target") + 0.5).cast("long")
    size = F.col("source_size")
    plan = plan.where(size > 0).select(
        "src",
        F.ceil(size / block).cast("long").alias("blocks"),
        F.floor(words / size).cast("long").alias("passes"),
        (words % size).alias("rest"),
    )
    plan = plan.withColumn("n", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    plan = settle(ranked(plan.where("n > 0"), [], ["src"], ("n",)), "shares")
    total = plan.agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = max(1, (total - 1).bit_length())
    part = plan.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1024))))
    part = part.repartition("src", "part")
    point = part.withColumn(
        "r", F.explode(F.sequence(F.col("part") * 1024, F.least(F.col("part") * 1024 + 1023, F.col("n") - 1)))
    )
    reverse = F.reverse(F.lpad(F.bin(F.col("before_n") + F.col("r")), bits, "0"))
    point = point.select("src", "blocks", "passes", "rest", F.conv(reverse, 2, 10).cast("long").alias("position"))
    k, whole = F.col("rank"), F.col("passes") * F.col("blocks")
    return ranked(point, ["src"], ["position"]).select(
        "position",
        "src",
        F.when(k < whole, k % F.col("blocks")).otherwise(k - whole).alias("block"),
        F.when(k < whole, F.col("blocks") * block).otherwise(F.col("rest")).alias("upto"),
    )


def takes(docs: DataFrame, plan: DataFrame, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """What each slot takes: (position, uid, begin, end), words ``begin`` to ``end`` of a document.

    The documents of a source, shuffled by a hash of their key, make one line of words, which is cut into
    equal blocks. Slots and blocks meet by source and block number; a hot source has many blocks.
    """
    line = docs.where("size > 0").select(
        "uid", "key", "src", "size", F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))).alias("hash")
    )
    line = ranked(line, ["src"], ["hash", "key", "uid"], ("size",))
    at, end = F.col("before_size"), F.col("before_size") + F.col("size")
    pieces = line.select(
        "uid",
        "src",
        at.alias("at"),
        end.alias("to"),
        F.explode(F.sequence(F.floor(at / block), F.floor((end - 1) / block))).alias("block"),
    )
    begin = F.greatest("at", F.col("block") * block)
    stop = F.least("to", (F.col("block") + 1) * block, "upto")
    return (
        pieces.join(slots(plan, block), ["src", "block"])
        .where(stop > begin)
        .select("position", "uid", (begin - F.col("at")).alias("begin"), (stop - F.col("at")).alias("end"))
    )


def _sized(df: DataFrame, key: str, text: str, source: str, *more) -> DataFrame:
    source = F.col(source).cast("string")
    return df.select(
        F.col(key).alias("key"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"),
        word_count(F.col(text)).alias("size"),
        F.monotonically_increasing_id().alias("uid"),
        *more,
    )


def _mixed(docs: DataFrame, weights, share, most, block) -> DataFrame:
    sizes = settle(docs.groupBy("src", "source").agg(F.sum("size").alias("source_size")), "sources")
    plan = settle(targets(sizes, weights, share, most), "targets")
    taken = takes(docs, plan, block).groupBy("uid").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    taken = settle(taken, "taken")
    return (
        docs.join(taken, "uid", "left")
        .join(plan.select("src", "source_size", "target"), "src")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
    )


def mix(
    df: DataFrame, key: str, text: str, source: str,
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: key, size, source_size, target, taken.

    ``size`` is the number of words of the text, ``taken`` how many of them the mix takes, repeats counted:
    at most ``most`` times ``size``, and per source its target to the nearest word. Null and empty texts
    have size 0 and are never taken; null is a source of its own, the last one; rows without a key and
    repeated rows are documents like any other. The same rows in the same files give the same mix.
    """
    docs = settle(_sized(df, key, text, source), "documents")
    return _mixed(docs, weights, share, most, block).select(
        F.col("key").alias(key), "size", "source_size", "target", "taken"
    )


def apply_mix(
    df: DataFrame, key: str, text: str, source: str,
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK,
) -> DataFrame:
    """``df`` with each row as often as the mix takes it, to the nearest whole number of times (half up)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    docs = settle(_sized(df, key, text, source, whole), "documents")
    taken = _mixed(docs.drop("row"), weights, share, most, block)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    times = settle(taken.where("size > 0").select("uid", times.alias("times")).where("times > 0"), "times")
    # whole rows go through one shuffle at any size and are never sorted
    out = docs.select("uid", "row").join(times.hint("shuffle_hash"), "uid")
    return out.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
