"""Repeated long byte strings, found by sorting the suffixes of shards that hold every place of a string together.

The windows of a text (all its strings of WINDOW bytes) are grouped by their anchor, the 64-byte gram of least hash: equal
windows have equal anchors. Consecutive windows of one anchor form a piece. Pieces of an anchor that no other piece
has, and equal pieces, are settled by counting; what is left is sorted in shards by external induced sorting, where
neighbours in suffix order that share a whole window are repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.induced import Spill, suffix_order
from rollbook.llm.shared import partitions, settle
from rollbook.sources.workspace import new_path

GRAM = 64  # a power of two
SEGMENT = 1 << 20  # bytes of texts looked at together; longer texts are cut, with a window's overlap
SHARD = 2 << 20  # bytes of pieces sorted together; one anchor may hold more
CUTS = 3  # times the windows of a piece are halved before sorting
MOST = 2000  # different pieces of an anchor that may be sorted as one group
MEMORY = 256 << 20  # bytes of waiting tuples held by a task before they go to files


def gram_hashes(data, gram: int = GRAM):
    """A 64-bit hash of the ``gram`` bytes from each place."""
    import numpy as np

    h = data.astype(np.uint64) + np.uint64(1)
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * 0xD1342543DE82EF95 % 2**64 | 1
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_minima(values, width: int):
    """Minimum of values[i : i + width] for each i, by minima to both ends of blocks."""
    import numpy as np

    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces_of(data, starts, window: int):
    """Pieces of concatenated texts that begin at ``starts``: first place, length, place of the anchor, its hash."""
    import numpy as np

    n = len(data)
    if n < window:
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)]
    hashes = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = _window_minima((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), window - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    inside = np.ones(n - window + 1, dtype=bool)
    for s in starts[1:]:  # no window crosses into the next text
        inside[max(0, s - window + 1) : s] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)]
    anchor = anchor[at]
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(at) != 1)]))
    closes = np.append(opens[1:], len(at)) - 1
    return at[opens], at[closes] - at[opens] + window, anchor[opens], hashes[anchor[opens]]


_PIECE = "key long, d1 long, d2 long, row long, off long, size long, a int, low int, high int, n long, known boolean"

_PART = f"{_PIECE}, data binary"


def _find_pieces(window: int, segment: int):
    """From (row, data): pieces, one for all equal ones of a batch, and the places of those (key null)."""

    def find(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        def work(parts):
            """parts: (row, offset of the part in its text, bytes)"""
            data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
            starts = np.cumsum([0] + [len(p[2]) for p in parts])[:-1]
            first, size, anchor, key = pieces_of(data, starts, window)
            part = np.searchsorted(starts, first, side="right") - 1
            raw = data.tobytes()
            digest = np.frombuffer(
                b"".join(xxhash.xxh3_128_digest(raw[f : f + z]) for f, z in zip(first.tolist(), size.tolist())), dtype="<i8"
            ).reshape(-1, 2)
            order = np.lexsort((digest[:, 1], digest[:, 0]))
            ordered = digest[order]
            opens = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]) if len(order) else np.zeros(0, bool)
            head = np.flatnonzero(opens)
            count = np.diff(np.append(head, len(order)))
            base = np.array([p[1] for p in parts], dtype=np.int64) - starts
            rows = np.array([p[0] for p in parts], dtype=np.int64)
            chosen = order[head]
            again = order[np.repeat(count, count) > 1]
            low = np.full(len(chosen), GRAM - window, dtype=np.int32)
            yield _batch(
                key[chosen].view(np.int64), digest[chosen, 0], digest[chosen, 1], rows[part[chosen]],
                first[chosen] + base[part[chosen]], size[chosen], (first - anchor)[chosen], low, np.zeros_like(low), count,
                count > 1,
            )
            if len(again):
                # pieces that touch become one run of repeated bytes
                again = np.sort(again)
                r, lo, hi = rows[part[again]], first[again] + base[part[again]], (first + size)[again] + base[part[again]]
                new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (lo[1:] > hi[:-1])]))
                end = np.append(new[1:], len(r)) - 1
                zero = np.zeros(len(new), dtype=np.int64)
                small = zero.astype(np.int32)
                yield _batch(None, zero, zero, r[new], lo[new], hi[end] - lo[new], small, small, small, zero, zero == 0)

        def _batch(*columns):
            names = [c.split()[0] for c in _PIECE.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.int32()] * 3 + [pa.int64(), pa.bool_()]
            n = len(columns[1])
            arrays = [pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        held, size = [], 0
        for batch in batches:
            for row, value in zip(batch.column("row").to_pylist(), batch.column("data")):
                data = value.as_buffer().to_pybytes()
                for off in range(0, max(1, len(data) - window + 1), segment):
                    part = data[off : off + segment + window - 1]
                    if len(part) < window:
                        continue
                    if held and size + len(part) > segment + window:
                        yield from work(held)
                        held, size = [], 0
                    held.append((row, off, part))
                    size += len(part)
        if held:
            yield from work(held)

    return find


def _with_bytes(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Add the bytes of each piece: ``data``. The pieces of a text are cut from it in one go."""
    columns = [c for c in pieces.columns if c != "row"]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("data")[i].as_buffer()
                own = batch.column("own").slice(i, 1).flatten()
                fields = {c: own.field(c) for c in columns}
                data = [text[o : o + z].to_pybytes() for o, z in zip(fields["off"].to_pylist(), fields["size"].to_pylist())]
                row = pa.array([batch.column("row")[i].as_py()] * len(data), pa.int64())
                yield pa.RecordBatch.from_pydict({"row": row} | fields | {"data": pa.array(data, pa.binary())})

    own = pieces.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("own"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select("row", *columns).schema.fields)
    return docs.select("row", "data").join(own, "row").mapInArrow(cut, f"{schema}, data binary")


def _halves(window: int, times: int):
    """Halve the window starts of a piece ``times`` times, at places fixed to the anchor.

    A part's key is the bytes all its windows share, so parts whose surroundings differ come apart.
    """

    def halve(batches):
        import pyarrow as pa
        import xxhash

        names = [c.split()[0] for c in _PART.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.int32()] * 3 + [pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                data, first, last = p["data"], p["a"], p["a"] + p["size"] - window  # window starts, from the anchor
                ranges = [(p["low"], p["high"])]
                for _ in range(times):
                    ranges = [
                        r for low, high in ranges for r in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)) if r[0] <= r[1]
                    ]
                for low, high in ranges:
                    a, b = max(first, low), min(last, high)
                    if a > b:
                        continue
                    own = data[a - first : b - first + window]
                    common = data[high - first : low - first + window] if low < high else own
                    key = xxhash.xxh3_64_intdigest(common, seed=(high - low) * 1024 - low) - (1 << 63)
                    digest = xxhash.xxh3_128_digest(own)
                    d1, d2 = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                    out.append((key, d1, d2, p["row"], p["off"] + a - first, len(own), a, low, high, 1, p["known"], own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return halve


def _sort_shards(window: int, shard: int, memory: int, folder: str):
    """From pieces sorted by key: the bytes of pieces not yet known to be repeated that a repeated window covers."""

    def work(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        def repeated(pieces):
            sizes = np.array([len(p[3]) for p in pieces], dtype=np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            text = np.frombuffer(b"".join(p[3] + b"\x00" for p in pieces), dtype=np.uint8).astype(np.int64) + 2
            text[starts + sizes] = 1
            text = np.append(text, 0)
            spill = Spill(f"{folder}-{uuid.uuid4().hex}", memory)
            try:
                places, shared = suffix_order(text, window, spill)
            finally:
                spill.close()
            with_next = np.append(shared[1:], 0)
            hit = places[(shared >= window) | (with_next >= window)]
            piece = np.searchsorted(starts, hit, side="right") - 1
            # a separator ends every piece, so a window that runs over it equals no other unless both do
            good = (hit + window <= starts[piece] + sizes[piece]) & ~np.array([p[2] for p in pieces])[piece]
            hit, piece = hit[good], piece[good]
            order = np.argsort(hit)
            hit, piece = hit[order], piece[order]
            if not len(hit):
                return None
            new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (hit[1:] > hit[:-1] + window)])
            opens = np.flatnonzero(new)
            closes = np.append(opens[1:], len(hit)) - 1
            off = np.array([p[1] for p in pieces], dtype=np.int64) - starts
            row = np.array([p[0] for p in pieces], dtype=np.int64)
            lo = hit[opens] + off[piece[opens]]
            hi = hit[closes] + window + off[piece[closes]]
            return pa.RecordBatch.from_arrays(
                [pa.array(row[piece[opens]]), pa.array(lo), pa.array(hi)], names=["row", "low", "high"]
            )

        held, size, group, last = [], 0, [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "row", "off", "known")]
            for key, row, off, known, data in zip(*columns, batch.column("data")):
                if key != last:
                    if not all(p[2] for p in group):  # else nothing is left to find
                        held += group
                        size += sum(len(p[3]) for p in group)
                    if size > shard:
                        found = repeated(held)
                        if found is not None:
                            yield found
                        held, size = [], 0
                    group, last = [], key
                group.append((row, off, known, data.as_buffer().to_pybytes()))
        if not all(p[2] for p in group):
            held += group
        if held:
            found = repeated(held)
            if found is not None:
                yield found

    return work


def _classes(pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of pieces: repeated ones not known before, and one of each class that shares its key with other classes.

    The second also says how many classes its key has; a piece that is not the only one of its class is repeated as a
    whole. No join meets a frequent key or class: what is unique is taken away by its id.
    """
    classes = settle(
        pieces.groupBy("key", "d1", "d2").agg(F.sum("n").alias("n"), F.min("id").alias("id")), "classes"
    )
    repeated = pieces.where("not known").join(classes.where("n = 1").select("id"), "id", "left_anti")
    keys = settle(classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("id").alias("id")), "keys")
    left = classes.join(keys.where("classes = 1").select("id"), "id", "left_anti")
    left = left.select("id", (F.col("n") > 1).alias("several"))
    chosen = pieces.drop("d1", "d2", "n").join(left, "id")
    chosen = chosen.withColumn("known", F.col("known") | F.col("several")).drop("several", "id")
    return repeated, chosen, keys.where(F.col("classes") > MOST).select("key", F.lit(True).alias("hot"))


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """Bytes covered by repeated windows, as (row, low, high), overlaps among them; ``docs`` has row and data (binary)."""
    spark = docs.sparkSession
    found = docs.where(F.octet_length("data") >= window).select("row", "data")
    found = found.mapInArrow(_find_pieces(window, SEGMENT), _PIECE).withColumn("id", F.monotonically_increasing_id())
    found = settle(found, "pieces")
    span = ["row", F.col("off").alias("low"), (F.col("off") + F.col("size")).alias("high")]
    repeated, chosen, _ = _classes(found.where("key is not null"))
    spans, to_sort = [found.where("key is null").select(*span), repeated.select(*span)], []
    chosen, times = _with_bytes(docs, chosen.drop("key")), CUTS
    while True:
        parts = chosen.mapInArrow(_halves(window, times), _PART).withColumn("id", F.monotonically_increasing_id())
        repeated, chosen, hot = _classes(settle(parts, "parts"))
        spans.append(repeated.select(*span))
        chosen = settle(chosen.join(hot, "key", "left"), "chosen")
        to_sort.append(chosen.where("hot is null").select("key", "row", "off", "known", "data"))
        chosen, times = chosen.where("hot").drop("hot", "key"), 1
        if chosen.isEmpty():
            break
    rest, every = to_sort[0], spans[0]
    for more in to_sort[1:]:
        rest = rest.union(more)
    for more in spans[1:]:
        every = every.union(more)
    shards = rest.repartition(partitions(spark), "key").sortWithinPartitions("key")
    sort = _sort_shards(window, SHARD, MEMORY, new_path(spark, "suffixes"))
    return every.union(shards.mapInArrow(sort, "row long, low long, high long"))


def remove_repeats(df: DataFrame, key: str, text: str, window: int = 400) -> DataFrame:
    """Each row with the bytes removed that a repeated string of ``window`` bytes covers: key, kept, n_bytes, n_removed, n_spans.

    A string is repeated if it also starts at another place of any row, the same one included; it never crosses rows. All
    strings are judged on the input. ``kept`` is binary, as a cut may part the bytes of a character. A null text is
    empty; a null or repeated key names a row like any other, so that repeated rows repeat each other's strings. Other columns
    are ignored; an empty table gives no row. ``window`` is more than twice GRAM.

    Long texts are looked at in segments. Equal pieces are told by 128-bit digests. Pieces are halved CUTS times, and those
    of a key with more than MOST different ones again and again, until only equal windows would remain, so no
    task gets a frequent passage with all its surroundings. A task holds the letters and ranks of one shard; tuples beyond MEMORY wait in
    files of the shared folder.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), data.alias("data"))
    docs = settle(docs, "texts")
    spans = settle(repeated_spans(docs, window), "spans")
    own = spans.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    kind = df.schema[key].dataType.simpleString()

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept, removed, runs = [], [], []
            for value, spans in zip(batch.column("data"), batch.column("spans")):
                data = value.as_buffer()
                if not spans.is_valid:
                    kept.append(data.to_pybytes())
                    removed.append(0)
                    runs.append(0)
                    continue
                at = spans.values
                low, high = (at.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
                order = np.argsort(low, kind="stable")
                low, far = low[order], np.maximum.accumulate(high[order])
                opens = np.concatenate([[True], low[1:] > far[:-1]])
                low, high = low[opens], far[np.append(np.flatnonzero(opens)[1:], len(far)) - 1]
                edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(data)]
                kept.append(b"".join(data[a:b].to_pybytes() for a, b in zip(edges[::2], edges[1::2])))
                removed.append(int((high - low).sum()))
                runs.append(len(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                names=["key", "kept", "n_removed", "n_spans"],
            )

    out = docs.join(own, "row", "left").select("key", "data", "spans")
    out = out.mapInArrow(cut, f"key {kind}, kept binary, n_removed long, n_spans long")
    n_bytes = (F.octet_length("kept") + F.col("n_removed")).cast("long")
    return out.select("key", "kept", n_bytes.alias("n_bytes"), "n_removed", "n_spans")
