"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import partitions, settle, small_batches, starts_of, whole_groups
from rollbook.llm.vectors import matrix, same_key, sample_vectors, unit, usable

SAMPLE = 20_000  # vectors the centroids are fitted on; bounds what the driver holds
ENTRIES = 16  # centroids at which a walk of the graph begins
WIDTH = 64  # centroids a query's walk keeps, so the most lists it searches
MOST_LISTS = 8192  # bounds the broadcast of centroids and their graph
BLOCK = 4096


def balanced_centroids(sample, lists: int, rounds: int = 8, seed: int = 11):
    """Unit centroids by spherical k-means in which full clusters cost more, so that lists come out even."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), lists, replace=False)]
    penalty = np.zeros(lists)
    even = len(sample) / lists
    for _ in range(rounds):
        of = np.concatenate([(sample[s : s + 4096] @ centre.T - penalty).argmax(1) for s in range(0, len(sample), 4096)])
        size = np.bincount(of, minlength=lists)
        penalty = np.maximum(0, penalty + 0.02 * (size / even - 1))
        total = np.zeros_like(centre)
        np.add.at(total, of, sample)
        norm = np.sqrt((total**2).sum(1))
        filled = norm > 1e-9
        centre = np.where(filled[:, None], total / np.where(filled, norm, 1)[:, None], centre)
    return centre


def neighbour_graph(centre, degree: int = 24):
    """Each centroid's nearest others, and random ones that tie distant parts together."""
    import numpy as np

    n = len(centre)
    near = min(degree, n - 1)
    out = []
    for s in range(0, n, 1024):
        sim = centre[s : s + 1024] @ centre.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -np.inf
        out.append(np.argsort(-sim, axis=1, kind="stable")[:, :near])
    far = np.random.default_rng(3).integers(0, n, (n, 4))
    return np.concatenate([np.concatenate(out), far], axis=1).astype(np.int64)


def search_graph(x, centre, graph, width: int):
    """The ``width`` best centroids that a best-first walk of the graph finds: ids and cosines, best first.

    All rows of ``x`` walk at once; each round expands every row's best centroid not yet expanded.
    """
    import numpy as np

    n, width = len(x), min(width, len(centre))
    entry = np.linspace(0, len(centre) - 1, min(len(centre), ENTRIES)).astype(np.int64)
    entry = np.unique(entry)
    ids = np.tile(entry, (n, 1))
    sims = x @ centre[entry].T
    done = np.zeros(ids.shape, bool)
    row = np.arange(n)[:, None]
    while True:
        # order by id to find repeats, then keep the best
        by_id = np.lexsort((~done, ids), axis=1)
        ids, sims, done = ids[row, by_id], sims[row, by_id], done[row, by_id]
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = ids[:, 1:] == ids[:, :-1]
        sims = np.where(again, -np.inf, sims)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims, done = ids[row, best], sims[row, best], done[row, best]
        open_ = ~done & np.isfinite(sims)
        active = open_.any(1)
        if not active.any():
            return ids, sims
        first = open_.argmax(1)
        done[np.arange(n)[active], first[active]] = True
        more = graph[ids[np.arange(n), first]]
        more_sims = np.einsum("ij,ikj->ik", x, centre[more])
        more_sims[~active] = -np.inf
        ids = np.concatenate([ids, more], axis=1)
        sims = np.concatenate([sims, more_sims], axis=1)
        done = np.concatenate([done, np.zeros(more.shape, bool)], axis=1)


def distance(sims):
    import numpy as np

    return np.sqrt(np.maximum(0, 2 - 2 * sims))


def _lists(frames, index, width, ratio, most, name):
    """Rows with the lists within ``ratio`` times the distance of the nearest, at most ``most``."""
    import numpy as np

    centre, graph = index.value
    for frame in frames:
        for s in range(0, len(frame), 1024):
            part = frame.iloc[s : s + 1024].copy()
            ids, sims = search_graph(unit(matrix(part["vector"])), centre, graph, width)
            d = distance(sims)
            near = np.isfinite(sims) & (d <= ratio * d[:, :1] + 1e-12)
            near[:, most:] = False
            part[name] = [i[k].astype(np.int32) for i, k in zip(ids, near)]
            yield part


def _best(frames, k):
    """Per list block: each query's ``k`` best members."""
    import numpy as np
    import pandas as pd

    keys = ["_list", "_block"]
    for frame in whole_groups(frames, keys, 8192):
        begin = starts_of(frame, keys)
        asks = frame["_asks"].to_numpy()
        node, small = frame["node"].to_numpy(), frame["small"].to_numpy()
        x = unit(matrix(frame["vector"]))
        out = []
        for a, b in zip(begin, np.r_[begin[1:], len(frame)]):
            rows = np.arange(a, b)
            q, m = rows[asks[a:b]], rows[~asks[a:b]]
            if not len(m):
                continue
            for s in range(0, len(q), 512):
                part = q[s : s + 512]
                sims = x[part] @ x[m].T
                top = min(k, len(m))
                least = -np.partition(-sims, top - 1, axis=1)[:, top - 1 : top]
                hit_q, hit_m = np.nonzero(sims >= least - 1e-12)  # all ties, whatever their order
                hit_q, hit_m = part[hit_q], m[hit_m]
                exact = np.einsum("ij,ij->i", x[hit_q], x[hit_m])
                out.append(
                    pd.DataFrame({"query": node[hit_q], "node": node[hit_m], "small": small[hit_m], "score": exact})
                )
        if out:
            best = pd.concat(out, ignore_index=True).sort_values(["query", "score", "small"], ascending=[True, False, True])
            yield best.drop_duplicates(["query", "node"]).groupby("query").head(k)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {more}"


def nearest(
    df: DataFrame,
    key: str,
    vector: str,
    is_query: Column,
    k: int = 5,
    lists: int | None = None,
    replicas: int = 4,
    replica_ratio: float = 1.15,
    search_ratio: float = 1.25,
    width: int | None = None,
) -> DataFrame:
    """The ``k`` nearest rows of each query row: query_id, rank (from 1), the key, score (cosine).

    Equal vectors are one class, indexed once; each class keeps its ``k + 1`` smallest keys, which are all
    that a result can name. Centroids are fitted on a bounded sample by balanced k-means. A class goes to
    its nearest list and to those within ``replica_ratio`` times that distance (at most ``replicas``), a
    query to the lists within ``search_ratio`` times the distance of its nearest, at most ``width`` (WIDTH) of them; both walk
    a neighbour graph of the centroids from a few fixed ones. More width finds more and compares more. Lists longer than a block are searched block by block by different tasks.
    Queries with fewer than ``k`` finds search all lists, so a small table yields all its rows.

    Ties go to the smaller key. A query never finds its own row; repeated rows find each other. Rows whose
    key is null, or whose vector is null, empty, zero, or holds null or non-finite components, take no part.
    Vectors of another length have an index of their own, one length after the other.
    """
    spark = df.sparkSession
    small_batches(spark, 4000)
    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), is_query.alias("_asks")
    ).where(usable(F.col("vector")) & F.col("key").isNotNull())
    lengths = [r["d"] for r in rows.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()]
    out = spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    for d in lengths:
        own = rows.where(F.size("vector") == d).select("*", *same_key(F.col("vector")))
        found = _nearest(own, k, lists, replicas, replica_ratio, search_ratio, width or WIDTH)
        out = out.unionByName(found.withColumnRenamed("key", key))
    return out


def _nearest(
    rows: DataFrame, k: int, lists: int | None, replicas: int, replica_ratio: float, search_ratio: float, width: int
) -> DataFrame:
    """``nearest`` among vectors of one length: rows have key, vector, _asks, _k1 and _k2."""
    spark = rows.sparkSession
    group = ["_k1", "_k2"]
    classes = settle(
        rows.groupBy(*group).agg(
            F.min("key").alias("small"),
            F.first("vector").alias("vector"),
            F.max(F.coalesce("_asks", F.lit(False))).alias("_asks"),
        ),
        "classes",
    )
    # keys may repeat, so a class gets a number; its smallest key breaks ties
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    order = Window.partitionBy(*group).orderBy("key")
    first = rows.select(*group, "key").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k + 1)
    first = settle(first.join(classes.select(*group, "node"), group).select("node", "key", "_nth"), "smallest-keys")
    asked = rows.where("_asks").select(*group, F.col("key").alias("query_id"))
    asked = asked.join(classes.select(*group, F.col("node").alias("query")), group).select("query", "query_id")
    asked = settle(asked.withColumn("_row", F.monotonically_increasing_id()), "queries")

    total = classes.count()
    lists = min(MOST_LISTS, lists or max(1, total // 128))
    sample = sample_vectors(classes, "vector", max(SAMPLE, lists))
    lists = min(lists, max(1, len(sample)))
    if len(sample):
        centre = balanced_centroids(sample, lists)
        graph = neighbour_graph(centre)
    else:
        centre = graph = sample
    index = spark.sparkContext.broadcast((centre, graph))
    plain = classes.select("node", "small", "vector")
    schema = _schema(plain, "lists array<int>")
    posted = settle(
        plain.mapInPandas(lambda f: _lists(f, index, 2 * replicas + 16, replica_ratio, replicas, "lists"), schema),
        "postings",
    )
    member = posted.select("node", "small", "vector", F.explode("lists").alias("_list"))
    sizes = settle(
        member.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")), "list-sizes"
    )  # one row a list, at most MOST_LISTS
    ask = classes.where("_asks").select("node", "small", "vector")
    width = min(lists, width)
    found = _search(ask.mapInPandas(
        lambda f: _lists(f, index, width, search_ratio, lists, "lists"), schema
    ), member, sizes, k)
    top = _top(found, first, asked, k)
    short = asked.join(top.groupBy("_row").count().where(F.col("count") >= k), "_row", "left_anti")
    short = settle(short, "short")
    if not short.isEmpty():
        every = F.lit(list(range(lists))).cast("array<int>")
        wide = ask.join(short.select(F.col("query").alias("node")).distinct(), "node", "left_semi")
        more = _search(wide.withColumn("lists", every), member, sizes, k)
        top = top.join(short.select("_row"), "_row", "left_anti").unionByName(_top(more, first, short, k))
    return top.select("query_id", "rank", "key", "score")


def _search(ask: DataFrame, member: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    ask = ask.select("node", "small", "vector", F.explode("lists").alias("_list")).join(F.broadcast(sizes), "_list")
    ask = ask.select(
        "node", "small", "vector", "_list", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"),
        F.lit(True).alias("_asks"),
    )
    held = member.join(F.broadcast(sizes), "_list").select(
        "node", "small", "vector", "_list", F.pmod(F.hash("node"), "_blocks").alias("_block"), F.lit(False).alias("_asks")
    )
    keys = ["_list", "_block"]
    dealt = ask.unionByName(held).repartition(partitions(ask.sparkSession), *keys).sortWithinPartitions(*keys)
    best = dealt.mapInPandas(lambda f: _best(f, k + 1), "query long, node long, small long, score double")
    best = best.groupBy("query", "node").agg(F.max("score").alias("score"), F.min("small").alias("small"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "small")
    best = best.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k + 1)
    return settle(best.drop("_nth", "small"), "found")


def _top(found: DataFrame, first: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Classes expanded to their smallest keys, without the query's own row."""
    named = found.join(first, "node").join(asked, "query")
    # one row of the query's own class with its key is the query itself
    own = (F.col("key") == F.col("query_id")) & (F.col("node") == F.col("query"))
    own_nth = F.min(F.when(own, F.col("_nth"))).over(Window.partitionBy("_row"))
    named = named.withColumn("_own", own_nth).where(~own | (F.col("_nth") != F.col("_own")))
    order = Window.partitionBy("_row").orderBy(F.desc("score"), "key")
    named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return settle(named.select("_row", "query_id", F.col("rank").cast("int"), "key", "score"), "nearest")
