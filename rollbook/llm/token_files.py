"""Token-id files: static range asymmetric numeral coding in independent, checksummed blocks."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import open_store, partitions, read_bytes, settle, small_batches, write_file
from rollbook.sources.workspace import new_path

MAGIC = b"RBTOK001"
BITS = 20  # frequencies sum to 2**BITS
LOW = 1 << 31  # states are kept in [LOW, LOW << 32)
BLOCK = 1 << 20  # ids in a block
LANES = 4096  # states that take turns in a block
WORDS_HELD = 1_000_000  # distinct words a worker remembers


def even_out(counts):
    """Counts scaled to frequencies of sum 2**BITS; every id that occurs keeps at least 1."""
    import numpy as np

    counts = np.asarray(counts, dtype=np.float64)
    seen = counts > 0
    if seen.sum() > 1 << BITS:
        raise ValueError("more ids than the coder's range")
    freq = np.where(seen, np.maximum(1, np.floor(counts / max(1, counts.sum()) * (1 << BITS))), 0).astype(np.int64)
    rest = (1 << BITS) - int(freq.sum()) if seen.any() else 0
    order = np.argsort(-freq, kind="stable")
    at = 0
    while rest:  # the frequent ids take what rounding left, or give what the rare ones got
        i = order[at % len(order)]
        step = rest if rest > 0 else max(rest, -(int(freq[i]) // 2))
        freq[i] += step
        rest -= step
        at += 1
    return freq


def tables_of(freq):
    """Frequencies, cumulative frequencies, and the id of every slot."""
    import numpy as np

    freq = np.asarray(freq, dtype=np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    return freq, cum, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def encode_block(ids, tables) -> bytes:
    """Lane count, lane states, then the words in the order in which the decoder takes them."""
    import numpy as np

    freq, cum, _ = tables
    lanes = max(1, min(LANES, len(ids) // 64))
    state = np.full(lanes, LOW, np.uint64)
    words = []
    for s in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        some = ids[s : s + lanes]
        x, f = state[: len(some)], freq[some]
        full = x >= f << np.uint64(63 - BITS)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        state[: len(some)] = (q << np.uint64(BITS)) + r + cum[some]
    return struct.pack("<I", lanes) + state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, tables):
    import numpy as np

    freq, cum, slots = tables
    (lanes,) = struct.unpack_from("<I", data)
    state = np.frombuffer(data, "<u8", lanes, 4).copy()
    words = np.frombuffer(data, "<u4", offset=4 + 8 * lanes).astype(np.uint64)
    out = np.empty(n, np.uint32)
    mask, at = np.uint64((1 << BITS) - 1), 0
    for s in range(0, n, lanes):
        x = state[: min(lanes, n - s)]
        slot = x & mask
        some = slots[slot]
        out[s : s + len(x)] = some
        x = freq[some] * (x >> np.uint64(BITS)) + slot - cum[some]
        short = np.flatnonzero(x < np.uint64(LOW))
        x[short] = (x[short] << np.uint64(32)) | words[at : at + len(short)]
        at += len(short)
        state[: len(x)] = x
    return out


_tokenizers: dict = {}
TAIL = b".,;:!?*#$%&|"  # marks that end words; the apostrophe is none of them
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


def _tokenizer(definition: bytes):
    """The worker's tokenizer of this definition and the words it has met."""
    import os

    if definition not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition.decode())
        tokenizer.encode_special_tokens = True  # a word is never a special token, only a whole text holds them
        _tokenizers.clear()
        _tokenizers[definition] = (tokenizer, {})
    return _tokenizers[definition]


def _meet(words, tokenizer, held, kind):
    """Encode words the worker has not met: marks at their end apart from the letters before."""
    import numpy as np

    alone, parted = {}, []
    for w in words:
        core = w.rstrip(TAIL)
        if core and len(core) < len(w) and core[-1] in LETTERS:
            tail = w[len(core) :]
            parted.append((w, core, tail))
            alone[core] = alone[tail] = None
        else:
            alone[w] = None
    new = [w for w in alone if w not in held]
    wide = np.dtype(kind).itemsize
    for s in range(0, len(new), 256):
        some = new[s : s + 256]
        code = tokenizer.encode([w.decode() for w in some], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(code.ids, kind).tobytes()
        edge = (wide * np.searchsorted(np.array(code.word_ids), np.arange(len(some) + 1))).tolist()
        held.update(zip(some, [ids[a:b] for a, b in zip(edge, edge[1:])]))
    for w, core, tail in parted:
        held[w] = held[core] + held[tail]


def _encode(texts, tokenizer, held, kind, end):
    """Ids of an array of texts, each with the end id, as bytes: Arrow cuts and numbers the words, and puts their ids together."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lines = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    numbered = lines.flatten().dictionary_encode()
    words = numbered.dictionary.cast(pa.large_binary()).to_pylist()
    held[b""] = b""
    new = [w for w in words if w not in held]
    if new:
        _meet(new, tokenizer, held, kind)
    tail = np.array([end], kind).tobytes()
    parts = pa.array([*map(held.__getitem__, words), tail], pa.large_binary())
    starts = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    code = np.insert(numbered.indices.to_numpy(), starts[1:], len(words))
    _, until, data = parts.take(pa.array(code)).buffers()
    edges = np.frombuffer(until, np.int64)[starts + np.arange(len(starts))]
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(edges), data]).cast(pa.binary())
    named = np.zeros(len(texts), bool)
    for t in tokenizer.get_added_tokens_decoder().values():
        if t.content:
            named |= np.asarray(pc.match_substring(texts, t.content))
    if named.any():
        listed = out.to_pylist()
        for i in np.flatnonzero(named).tolist():
            listed[i] = np.array(_whole(texts[i].as_py(), tokenizer), kind).tobytes() + tail
        out = pa.array(listed, pa.binary())
    return out


def _whole(text, tokenizer):
    """A text's ids by the library, which alone knows how names of special tokens are cut out of it."""
    tokenizer.encode_special_tokens = False
    try:
        return tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        tokenizer.encode_special_tokens = True


PROBE = ("It's 9.5% of THE,\tEnd?!\n New\u00a0line  co-op", "a", " ", "'S's x'LL ... \u00c9t\u00c9\u0301 \u0130")


def _refuse_unfit(definition: bytes, kind: str) -> None:
    """Fail for a tokenizer whose ids of a text are not those of its lower-cased words."""
    import numpy as np
    import pyarrow as pa

    tokenizer, held = _tokenizer(definition)
    for text, ids in zip(PROBE, _encode(pa.array(PROBE), tokenizer, held, kind, 0).to_pylist()):
        if np.frombuffer(ids, kind)[:-1].tolist() != _whole(text, tokenizer):
            raise ValueError("the tokenizer does not encode a text word by word")


def _ids(batches, definition, end, kind):
    import pyarrow as pa

    tokenizer, held = _tokenizer(definition.value)
    for batch in batches:
        if not batch.num_rows:
            continue
        if len(held) > WORDS_HELD:
            held.clear()
        ids = _encode(batch.column("text"), tokenizer, held, kind, end)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("uid"), ids], ["key", "uid", "ids"])


def _counts(batches, kind, size):
    import numpy as np
    import pyarrow as pa

    total = np.zeros(size, np.int64)
    for batch in batches:
        ids = batch.column("ids").cast(pa.large_binary())
        edges = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][: len(ids) + 1] if len(ids) else [0]
        if edges[-1] > edges[0]:
            total += np.bincount(np.frombuffer(ids.buffers()[2], "u1")[edges[0] : edges[-1]].view(kind), minlength=size)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _files(frames, folder, freq, kind):
    """Write the rows of a task, in their order, to one file; yield a row for each of its blocks."""
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    tables = tables_of(freq.value)
    part = TaskContext.get().partitionId()
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
    blocks, keys, known, starts, at = [], [], [], [], [len(MAGIC) + 4]

    def block(ids):
        data = encode_block(ids, tables)
        blocks.append((at[0], len(data), len(ids), zlib.crc32(data)))
        at[0] += len(data)
        return data

    def chunks():
        yield MAGIC + struct.pack("<I", zlib.crc32(np.asarray(freq.value, "<i8").tobytes()))
        held, n, total = [], 0, 0
        for frame in frames:
            for key, ids in zip(frame["key"], frame["ids"]):
                keys.append(0 if key is None else int(key))
                known.append(key is not None)
                starts.append(total)
                ids = np.frombuffer(ids, kind)
                held.append(ids)
                n += len(ids)
                total += len(ids)
                if n >= BLOCK:
                    whole = np.concatenate(held)
                    for s in range(0, n - BLOCK + 1, BLOCK):
                        yield block(whole[s : s + BLOCK])
                    held, n = [whole[n - n % BLOCK :]], n % BLOCK
        if n:
            yield block(np.concatenate(held))
        index = zlib.compress(
            np.array(blocks, "<i8").tobytes()
            + np.array(keys, "<i8").tobytes()
            + np.array(known, "u1").tobytes()
            + np.array([*starts, total], "<i8").tobytes()
        )
        yield index + struct.pack("<QQQ", len(index), len(blocks), len(keys)) + MAGIC

    import itertools

    batches = (f for f in frames if len(f))
    head = next(batches, None)
    if head is None:
        return
    frames = itertools.chain([head], batches)
    write_file(path, chunks())
    yield pd.DataFrame(
        {"path": path, "part": part, "block": range(len(blocks)), "n": [b[2] for b in blocks]}
    )


def read_index(store, path: str, table_crc: int):
    """Blocks (offset, bytes, ids, crc32), keys, which of them are not null, and starts of a file."""
    import numpy as np

    size = store.get_file_info(path).size
    with store.open_input_file(path) as f:
        if f.read_at(len(MAGIC) + 4, 0) != MAGIC + struct.pack("<I", table_crc):
            raise ValueError(f"{path} was written with another frequency table")
        tail = f.read_at(24 + len(MAGIC), size - 24 - len(MAGIC))
        if tail[24:] != MAGIC:
            raise ValueError(f"{path} is cut off")
        packed, n_blocks, n_keys = struct.unpack("<QQQ", tail[:24])
        index = zlib.decompress(f.read_at(packed, size - 24 - len(MAGIC) - packed))
    blocks = np.frombuffer(index, "<i8", 4 * n_blocks).reshape(-1, 4)
    keys = np.frombuffer(index, "<i8", n_keys, 32 * n_blocks)
    known = np.frombuffer(index, "u1", n_keys, 32 * n_blocks + 8 * n_keys)
    starts = np.frombuffer(index, "<i8", n_keys + 1, 32 * n_blocks + 9 * n_keys)
    return blocks, keys, known, starts


def _read(frames, table):
    """Documents that start in the named blocks, from the blocks that hold them."""
    import numpy as np
    import pandas as pd

    store, local = open_store(table)
    with store.open_input_file(local) as f:
        raw = f.read()
    tables, table_crc = tables_of(np.frombuffer(raw, "<i8")), zlib.crc32(raw)
    now = path_now = index = None
    for frame in frames:
        for path, part, number in zip(frame["path"], frame["part"], frame["block"]):
            store, local = open_store(path)
            if path != path_now:
                index, path_now, now = read_index(store, local, table_crc), path, {}
            blocks, keys, known, starts = index
            edge = np.concatenate([[0], np.cumsum(blocks[:, 2])])
            a, b = np.searchsorted(starts[:-1], [edge[number], edge[number + 1]])
            if a == b:
                continue
            last = int(np.searchsorted(edge, starts[b], "left")) - 1
            with store.open_input_file(local) as f:
                for k in range(number, last + 1):
                    if k not in now:
                        at, size, n, crc = (int(v) for v in blocks[k])
                        data = f.read_at(size, at)
                        if zlib.crc32(data) != crc:
                            raise ValueError(f"block {k} of {path} is damaged")
                        now[k] = decode_block(data, n, tables)
            ids = np.concatenate([now[k] for k in range(number, last + 1)]).astype("<u4")
            now = {last: now[last]}
            begin = starts[a : b + 1] - edge[number]
            for s in range(0, b - a, 500):
                e = min(b - a, s + 500)
                yield pd.DataFrame({
                    "key": pd.array([int(v) if ok else None for v, ok in zip(keys[a + s : a + e], known[a + s : a + e])], "Int64"),
                    "part": part,
                    "local_start": starts[a + s : a + e],
                    "ids": [ids[x:y].tobytes() for x, y in zip(begin[s:e], begin[s + 1 : e + 1])],
                })


def write_tokens(df: DataFrame, key: str, text: str, tokenizer: str, end: int) -> tuple[DataFrame, str]:
    """Encode whole texts and write their ids in ascending key order (nulls last); return blocks and table.

    The tokenizer must lower-case, drop white space and part letters from marks, else it is refused: then the ids of a
    text are those of its words, the marks at their end apart. Each is encoded once per worker. A text that holds the name
    of a special token is encoded by the library as a whole. Texts of any length are taken whole, a batch at a time;
    repeated keys keep the order of the input's rows. ``end`` follows. Null texts count as empty. Ids are staged,
    counted over all texts, dealt by ranges of the key, and coded with the one table of frequencies. A
    file holds blocks of ids, each decodable on its own and checked by crc32, and an index of blocks and
    documents. Rows of ``blocks`` (path, part, block, n) name what a reader can decode in parallel.
    """
    spark = df.sparkSession
    small_batches(spark, 2000)
    held = spark.sparkContext.broadcast(read_bytes(tokenizer))
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(held.value.decode()).get_vocab_size(), end + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    _refuse_unfit(held.value, kind)
    rows = df.select(
        F.col(key).cast("long").cast("string").alias("key"),
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ids = settle(rows.mapInArrow(lambda b: _ids(b, held, end, kind), "key string, uid long, ids binary"), "ids")
    counts = ids.select("ids").mapInArrow(lambda b: _counts(b, kind, size), "id long, n long")
    total = [0] * size
    for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id of the vocabulary
        total[r["id"]] = r["n"]
    freq = even_out(total)
    table = spark.sparkContext.broadcast(freq)
    folder = new_path(spark, "llm-tokens")
    write_file(f"{folder}/frequencies.bin", [freq.astype("<i8").tobytes()])
    order = [F.col("key").cast("long").asc_nulls_last(), F.col("uid")]
    dealt = ids.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    blocks = dealt.select("key", "ids").mapInPandas(
        lambda f: _files(f, folder, table, kind), "path string, part int, block int, n long"
    )
    return settle(blocks, "token-blocks"), f"{folder}/frequencies.bin"


def read_tokens(blocks: DataFrame, table: str) -> DataFrame:
    """Documents read from token files: key, start (ids of all documents before), ids (unsigned 32-bit, little-endian)."""
    files = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = settle(files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "files")
    dealt = blocks.repartition(partitions(blocks.sparkSession), "path", F.floor(F.col("block") / 8)).sortWithinPartitions("path", "block")
    docs = dealt.mapInPandas(
        lambda f: _read(f, table), "key long, part int, local_start long, ids binary"
    )
    return docs.join(F.broadcast(files), "part").select(
        "key", (F.col("local_start") + F.col("offset")).alias("start"), "ids"
    )
