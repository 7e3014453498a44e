"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.components import components, local_forest
from rollbook.llm.shared import partitions, settle, small_batches, split_hot, starts_of, whole_groups
from rollbook.llm.vectors import matrix, same_key, sample_vectors, unit, usable

SAMPLE = 8192  # vectors from which pivots are chosen; bounds what the driver holds
MOST_PIVOTS = 4096  # bounds the broadcast: 4096 pivots of 1,000 doubles are 33 MB
BLOCK = 4096


def choose_pivots(sample, pivots: int, seed: int = 7):
    """Reference points: each the sample vector farthest from those before; random ones fill up.

    Vectors of one dense group are never two pivots while others are farther away.
    """
    import numpy as np

    dim = sample.shape[1]
    chosen = []
    if len(sample):
        nearest = sample @ sample[0]
        chosen.append(sample[0])
        while len(chosen) < pivots and nearest.min() < 0.9:
            chosen.append(sample[int(nearest.argmin())])
            nearest = np.maximum(nearest, sample @ chosen[-1])
    if len(chosen) < pivots:
        chosen.extend(unit(np.random.default_rng(seed).normal(size=(pivots - len(chosen), dim))))
    return np.array(chosen)


def permutation(x, pivots, prefix: int):
    """The ``prefix`` nearest pivots of each row, nearest first; ties to the smaller pivot."""
    import numpy as np

    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def _described(frames, pivots, prefix):
    for frame in frames:
        if len(frame):
            frame = frame.copy()
            order = permutation(unit(matrix(frame["vector"])), pivots.value, prefix)
            frame["order"] = list(order)
            yield frame


def _verified(frames, cosine, shared, n_pivots, probes):
    import numpy as np
    import pandas as pd

    keys = ["_label", "_pivot", "_i", "_j"]
    for frame in whole_groups(frames, keys, 16384):
        begin = starts_of(frame, keys)
        own, i, j = (frame[c].to_numpy() for c in ("_own", "_i", "_j"))
        node, copies, rank = (frame[c].to_numpy() for c in ("node", "copies", "rank"))
        order = np.stack(frame["order"].to_numpy())
        x = unit(matrix(frame["vector"]))
        member = np.zeros((len(frame), n_pivots), bool)
        member[np.arange(len(frame))[:, None], order] = True
        packed = np.packbits(member, axis=1)
        out = []
        for a, b in zip(begin, np.r_[begin[1:], len(frame)]):
            rows = np.arange(a, b)
            asks = rows[rank[a:b] < probes]
            # a pair of blocks compares the members of one with the queries of the other, in both ways
            if i[a] == j[a]:
                turns = [(asks, rows)]
            else:
                turns = [(asks[own[asks] == u], rows[own[rows] == v]) for u, v in ((i[a], j[a]), (j[a], i[a]))]
            for q, m in turns:
                for s in range(0, len(q), 256):
                    part = q[s : s + 256]
                    common = np.zeros((len(part), len(m)), np.int16)
                    for byte in range(packed.shape[1]):
                        common += np.bitwise_count(packed[part, byte][:, None] & packed[m, byte][None, :])
                    hit_q, hit_m = np.nonzero(common >= shared)
                    hit_q, hit_m = part[hit_q], m[hit_m]
                    other = node[hit_q] != node[hit_m]
                    for e in range(probes - 1):  # met already in the list of an earlier pivot
                        other &= (rank[hit_q] <= e) | ~member[hit_m, order[hit_q, min(e, order.shape[1] - 1)]]
                    hit_q, hit_m = hit_q[other], hit_m[other]
                    close = np.empty(len(hit_q), bool)
                    for c in range(0, len(hit_q), 1 << 17):
                        d = slice(c, c + (1 << 17))
                        close[d] = np.einsum("ij,ij->i", x[hit_q[d]], x[hit_m[d]]) >= cosine
                    hit_q, hit_m = hit_q[close], hit_m[close]
                    if len(hit_q):
                        who, at = np.unique(hit_q, return_inverse=True)
                        n = np.bincount(at, weights=copies[hit_m]).astype(np.int64)
                        out.append(pd.DataFrame({"a": node[who], "b": node[who], "n": n}))
                        child, root = local_forest(node[hit_q], node[hit_m])
                        out.append(pd.DataFrame({"a": child, "b": root, "n": 0}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _linked(
    fit: DataFrame, n_classes: int, cosine: float, pivots: int | None, prefix: int, shared: int, probes: int
) -> DataFrame:
    """Links among classes of vectors of one length: (a, b, n), see ``_verified``."""
    spark = fit.sparkSession
    pivots = pivots or min(MOST_PIVOTS, max(48, math.isqrt(n_classes)))
    points = choose_pivots(sample_vectors(fit, "vector", max(SAMPLE, pivots)), pivots)
    held = spark.sparkContext.broadcast(points)
    prefix = min(prefix, pivots)
    plain = fit.select("_label", "node", "copies", "vector")
    schema = _schema(plain, "order array<int>")
    described = plain.mapInPandas(lambda f: _described(f, held, prefix), schema)
    posted = described.select("*", F.posexplode("order").alias("_pos", "_pivot"))
    posted = posted.withColumnRenamed("_pos", "rank")
    keys = ["_label", "_pivot", "_i", "_j"]
    posted = split_hot(settle(posted, "postings"), ["_label", "_pivot"], F.col("node"), BLOCK)
    dealt = posted.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return settle(
        dealt.mapInPandas(lambda f: _verified(f, cosine, shared, pivots, probes), "a long, b long, n long"), "links"
    )


def near_vectors(
    df: DataFrame,
    key: str,
    vector: str,
    label: str,
    cosine: float = 0.98,
    pivots: int | None = None,
    prefix: int = 8,
    shared: int = 3,
    probes: int = 3,
) -> DataFrame:
    """One row per row of ``df``: key, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels are equal and their cosine, in double precision, is at least ``cosine``.
    Equal vectors are one class, compared once. Each class is described by its ``prefix`` nearest pivots
    in order and posted to their inverted lists; it asks the lists of its ``probes`` nearest pivots, keeps the
    members that share at least ``shared`` pivots with it, and verifies the cosine. ``n_links`` counts linked rows,
    copies included; ``component_id`` is the smallest key reachable, ``kept`` whether it is the row's own
    and, for repeated rows, may hold for each of them.

    Rows whose key or label is null, or whose vector is null, empty, zero, or holds null or non-finite components,
    link with nothing: 0 links, their own key as component. Vectors of another length have pivots and lists of their
    own, one length after the other. A pair is met if one of its vectors' ``probes`` nearest pivots is among the other's
    ``prefix`` and ``shared`` are common: with ``shared=1, probes=1`` and ``prefix`` at the number of pivots every pair of a label
    and length is compared, which is the exact setting.
    Pivots: by default the root of the number of classes, at least 48; more pivots make lists shorter.
    """
    spark = df.sparkSession
    small_batches(spark, 4000)
    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), F.col(label).alias("_label")
    )
    rows = rows.withColumn(
        "_valid", usable(F.col("vector")) & F.col("key").isNotNull() & F.col("_label").isNotNull()
    ).select("*", F.size("vector").alias("_dim"), *same_key(F.col("vector")))
    group = ["_label", "_k1", "_k2"]
    classes = rows.where("_valid").groupBy(*group).agg(
        F.min("key").alias("node"),
        F.count(F.lit(1)).alias("copies"),
        F.first("vector").alias("vector"),
        F.first("_dim").alias("_dim"),
    )
    classes = settle(classes, "classes")
    lengths = classes.groupBy("_dim").count().where("count > 1").orderBy("_dim").collect()
    links = [
        _linked(classes.where(F.col("_dim") == r["_dim"]), r["count"], cosine, pivots, prefix, shared, probes)
        for r in lengths
    ]
    found = spark.createDataFrame([], "a long, b long, n long")
    for some in links:
        found = found.unionByName(some)
    direct = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_links"))
    component = components(found.where("a <> b").select("a", "b"))
    named = (
        classes.select(*group, "node", "copies")
        .join(direct, "node", "left")
        .join(component, "node", "left")
        .select(
            *group,
            (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    narrow = settle(rows.select("key", "_valid", *group), "vectors")
    joined = narrow.join(settle(named.withColumn("_valid", F.lit(True)), "named"), [*group, "_valid"], "left")
    component_id = F.coalesce("component_id", "key")
    return joined.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("key") == component_id, F.lit(True)).alias("kept"),
    )


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {more}"
