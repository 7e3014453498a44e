"""SimHash near-duplicates: fingerprints of word shingles, compared in vertical bit planes."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.components import components, local_forest
from rollbook.llm.shared import partitions, settle, small_batches, split_hot, starts_of, whole_groups

BITS = 64
BLOCK = 8192
STEP = 8  # planes between two looks at which blocks can be abandoned


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text, as a signed long; 0 without words.

    A-Z count as a-z. Words are what lies between ASCII white space. A shingle's hash is XXH64 (seed 42)
    of its words joined by blanks; a text with fewer words is one shingle. A bit is set if it is set in
    over half the hashes, repeats included.
    """
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())]
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = set_in * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint column (long). Null and empty texts have 0, which links like any other."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(x.encode(), shingle) for x in texts], dtype="int64")

    return of(F.coalesce(text, F.lit("")))


def near(group, own, left, right, prints, radius: int):
    """Index pairs (q, m) of one frame whose prints differ in at most ``radius`` bits.

    ``group`` numbers the groups of the sorted frame; rows of block ``left`` are compared with those of
    block ``right`` of their group. Members are stored in words of 64 lanes, one word for each bit plane.
    A query's differences from 64 members are counted at once by carry-save adders; a block of 64 is
    abandoned when all its lanes exceed the radius.
    """
    import numpy as np

    member = np.flatnonzero(own == right)
    query = np.flatnonzero(own == left)
    if not len(member) or not len(query):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = group[member]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[first, len(of)])
    lane = np.arange(len(of)) - np.repeat(first, size)
    words = (size + 63) // 64
    word_from = np.r_[0, np.cumsum(words)]
    starts = np.flatnonzero(lane % 64 == 0)
    shift = (lane % 64).astype(np.uint64)
    one = np.uint64(1)
    bits = prints[member].view(np.uint64)
    plane = [
        np.bitwise_or.reduceat(((bits >> np.uint64(b)) & one) << shift, starts) for b in range(BITS)
    ]
    filled = np.bitwise_or.reduceat(one << shift, starts)
    at = np.searchsorted(of[first], group[query])
    known = (at < len(first)) & (of[first][np.minimum(at, len(first) - 1)] == group[query])
    query, at = query[known], at[known]
    q_bits = prints[query].view(np.uint64)
    word_of = np.repeat(word_from[:-1], size) + lane // 64
    self_at = np.minimum(np.searchsorted(member, query), len(member) - 1)
    self_word = np.where(member[self_at] == query, word_of[self_at], -1)
    found_q, found_m = [], []
    todo = np.r_[0, np.cumsum(words[at])]
    begin = 0
    while begin < len(query):
        end = max(begin + 1, int(np.searchsorted(todo, todo[begin] + (1 << 20), "right")) - 1)
        n = words[at[begin:end]]
        q = np.repeat(np.arange(begin, end), n)
        w = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + word_from[at[q]]
        begin = end
        over = ~filled[w] | np.where(self_word[q] == w, one << shift[self_at[q]], np.uint64(0))
        alive = ~over != 0
        q, w, over = q[alive], w[alive], over[alive]
        count = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
        for b in range(BITS):
            carry = plane[b][w] ^ (np.uint64(0) - ((q_bits[q] >> np.uint64(b)) & one))
            for c in range(len(count)):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
            if b % STEP == STEP - 1:
                alive = ~over != 0
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    count = [c[alive] for c in count]
            if not len(q):
                break
        lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(lanes)
        m = member[starts[w[hit]] + bit]
        q = query[q[hit]]
        close = (np.bitwise_count(prints[q].view(np.uint64) ^ prints[m].view(np.uint64)) <= radius) & (q != m)
        found_q.append(q[close])
        found_m.append(m[close])
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_m)


def _links(frames, radius):
    import numpy as np

    keys = ["_table", "_key", "_i", "_j"]
    for frame in whole_groups(frames, keys):
        begin = starts_of(frame, keys)
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(frame)]))
        i, j, own = (frame[c].to_numpy() for c in ("_i", "_j", "_own"))
        prints = frame["fingerprint"].to_numpy(np.int64)
        # both roles of a pair of blocks, relative to the row's own pair
        q, m = near(group, np.where(own == i, 0, 1) | np.where(i == j, 2, 0), 0, 1, prints, radius)
        q2, m2 = near(group, np.where(i == j, 1, 0), 1, 1, prints, radius)
        q, m = np.r_[q, q2], np.r_[m, m2]
        if len(q):
            a, b = local_forest(prints[q], prints[m])
            yield pd.DataFrame({"a": a, "b": b})


def links(prints: DataFrame, radius: int = 3, bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints at ``radius`` or fewer differing bits.

    ``prints`` has distinct fingerprints. Two prints that differ in at most ``radius`` bits agree on at
    least ``bands - radius`` of ``bands`` bands, so they meet in the table of those bands. The links of a
    block are returned as a spanning forest.
    """
    bands = bands or radius + 2
    edge = [round(BITS * k / bands) for k in range(bands + 1)]
    mask = [sum(1 << b for b in range(edge[k], edge[k + 1])) for k in range(bands)]
    tables = []
    for some in combinations(mask, bands - radius):
        value = sum(some)
        tables.append(value - (1 << 64) if value >> 63 else value)
    rows = prints.select("fingerprint", F.posexplode(F.array(*[F.lit(t).cast("long") for t in tables])))
    rows = rows.select(
        "fingerprint",
        F.col("pos").alias("_table"),
        F.col("fingerprint").bitwiseAND(F.col("col")).alias("_key"),
    )
    rows = split_hot(rows, ["_table", "_key"], F.col("fingerprint"), block)
    keys = ["_table", "_key", "_i", "_j"]
    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(lambda frames: _links(frames, radius), "a long, b long")


def simhash_groups(
    df: DataFrame, key: str, text: str, shingle: int = 3, radius: int = 3, bands: int | None = None
) -> DataFrame:
    """One row per row of ``df``: its key, ``fingerprint`` (long) and ``component_id``.

    ``component_id`` is the smallest key among all rows whose fingerprints are reachable by steps of at
    most ``radius`` bits; null if none of them has a key. Repeated rows and rows without a key are kept.
    Null and empty texts have fingerprint 0. Other columns of ``df`` are not read.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("fingerprint"))
    return _grouped(settle(rows, "prints"), radius, bands).withColumnRenamed("key", key)


def _grouped(rows: DataFrame, radius: int, bands: int | None) -> DataFrame:
    prints = settle(rows.groupBy("fingerprint").agg(F.min("key").alias("first")), "distinct-prints")
    found = components(links(prints.select("fingerprint"), radius, bands))
    member = prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    member = settle(
        member.select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")),
        "members",
    )
    smallest = settle(member.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    named = settle(member.join(smallest, "component").select("fingerprint", "component_id"), "named")
    return rows.join(named, "fingerprint").select(*rows.columns, "component_id")


def keep_one(df: DataFrame, key: str, text: str, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``df`` without near-copies: of each group, the row with the smallest key (nulls last).

    Of repeated rows one stays. All columns are kept as they are.
    """
    small_batches(df.sparkSession)
    held = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.monotonically_increasing_id().alias("uid"),
        F.col(key).alias("order"),
        fingerprint(F.col(text), shingle).alias("fingerprint"),
    )
    held = settle(held, "held")
    first = F.min(F.struct(F.col("order").isNull(), "order", "uid"))
    # the smallest of each print, then of each component: both combine before the shuffle
    prints = settle(held.groupBy("fingerprint").agg(first.alias("first")), "distinct-prints")
    found = components(links(prints.select("fingerprint"), radius))
    member = prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    best = member.groupBy(F.coalesce("component", "fingerprint").alias("component")).agg(F.min("first").alias("first"))
    kept = settle(best.select(F.col("first.uid").alias("uid")), "kept")
    # whole texts go through one shuffle at any size and are never sorted
    return held.join(kept.hint("shuffle_hash"), "uid", "left_semi").select("row.*")
