"""Conversation structure repair: cheapest edits that make the roles of a conversation alternate.

Rows are put in order once, by ranges over all conversations, and cut into chunks of bounded rows and bytes.
A chunk holds many conversations or a part of one; a conversation of any length is a chain of such parts.
Its parts exchange four numbers each: what it costs to reach the end from each state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import partitions, settle

ROWS = 4096  # of a chunk
BYTES = 4 << 20  # of a chunk's texts, and one row more
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
FAR = 1 << 40

# States: nothing kept yet, and the last role: system, user, assistant. Roles: other, system, user, assistant.
STATES = ("", "s", "u", "a")
FOLLOWS = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))  # state after keeping a role
DUE = (2, 2, 3, 2)  # the one role a new or changed row may have
NAMES = ("", "system", "user", "assistant")
LETTERS = "-DIKR"
CLOSED = ((0,), (2 * INSERT,), (INSERT,), (0,))  # cost of ending a conversation in each state


def damage(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with the faults their CRC-32 of ``conv:turn`` asks for; columns conv, turn, role, text.

    Modulo 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    A null is one space in role, text and the checksum; a null conv or turn stays null as a key.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20).alias("fate"),
    ).where("fate <> 0")
    fate = F.col("fate")
    return rows.select(
        "conv",
        "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _digest(*columns: Column) -> Column:
    """256 bits that tell rows of texts apart."""
    parts = [p for c in columns for p in (F.octet_length(c).cast("string"), F.lit(":"), c)]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _cutter(most_rows: int, most_bytes: int):
    """Number the ordered rows of a task and cut them into chunks."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        base, rows, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = rows + np.arange(n)
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            before = size + np.cumsum(sizes) - sizes
            chunk = base + at // most_rows + before // most_bytes
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base + at), pa.array(chunk)], names=[*batch.schema.names, "at", "chunk"]
            )
            rows, size = rows + n, int(before[-1] + sizes[-1])

    return cut


def _ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    body = F.rtrim("text", F.lit(SPACE))
    rows = rows.select(
        "*",
        F.substring("role", 1, 1).alias("initial"),
        (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("unended"),
        _digest(F.col("role"), F.col("text")).alias("said"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    order += [F.col("said"), F.col("row")]
    dealt = rows.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).drop("row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return settle(dealt.mapInArrow(_cutter(ROWS, BYTES), f"{schema}, at long, chunk long"), "turns")


class _Chunk:
    """The rows of a chunk in order, as arrays, with the parts of conversations they form."""

    def __init__(self, rows, repeats):
        import numpy as np

        rows = rows.sort_by("at")
        self.rows, self.n = rows, rows.num_rows
        self.at = rows.column("at").to_numpy()
        code = {"s": 1, "u": 2, "a": 3}
        self.role = np.array([code.get(i, 0) for i in rows.column("initial").to_pylist()], dtype=np.int64)
        self.blank = rows.column("blank").to_numpy(zero_copy_only=False).astype(bool)
        self.repeat = np.isin(self.at, np.array(repeats, dtype=np.int64)) & ~self.blank
        self.unended = rows.column("unended").to_numpy(zero_copy_only=False).astype(bool) & ~self.blank & ~self.repeat
        conv = rows.column("conv").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.concatenate([[True], conv[1:] != conv[:-1]])
        self.starts = np.flatnonzero(first)
        self.lengths = np.diff(np.append(self.starts, self.n))
        self.part = np.cumsum(first) - 1

    def costs(self, parts, ends):
        """Least cost from each state before each row of some parts to their ends.

        ``ends``: cost at the end of each part by state, once for each of several readings. Returns an array
        (row + part) x state x reading; a part has one place more than rows.
        """
        import numpy as np

        value = np.full((self.n + len(self.starts), 4, ends.shape[2]), FAR, dtype=np.int64)
        last = self.starts[parts] + self.lengths[parts]
        value[last + parts] = ends
        for back in range(1, int(self.lengths[parts].max(initial=0)) + 1):
            live = self.lengths[parts] >= back
            row = last[live] - back
            after = value[row + parts[live] + 1]
            now = after + DELETE
            changeable = ~(self.blank | self.repeat)[row]
            extra = UNFINISHED * self.unended[row]
            for state in range(4):
                to = np.array(FOLLOWS[state])[self.role[row]]
                kept = np.where(((to >= 0) & changeable)[:, None], after[np.arange(len(row)), to] + (KEEP + extra)[:, None], FAR)
                changed = np.where(changeable[:, None], after[:, DUE[state]] + (REROLE + extra)[:, None], FAR)
                now[:, state] = np.minimum(now[:, state], np.minimum(kept, changed))
            user, assistant = now[:, 2].copy(), now[:, 3].copy()
            now[:, 2] = np.minimum(user, assistant + INSERT)
            now[:, 3] = np.minimum(assistant, user + INSERT)
            now[:, 0] = np.minimum(now[:, 0], now[:, 2] + INSERT)
            now[:, 1] = np.minimum(now[:, 1], now[:, 2] + INSERT)
            value[row + parts[live]] = np.minimum(now, FAR)
        return value

    def arcs(self, value, final):
        """Optimal arcs of every node (place x state): its least letter, where that leads, and the row taken."""
        import numpy as np

        value = value[:, :, 0]
        places = len(value)
        place_of_row = np.arange(self.n) + self.part
        row = np.full(places, -1)
        row[place_of_row] = np.arange(self.n)
        ends = np.flatnonzero(row < 0)
        letter = np.zeros((places, 4), dtype=np.int64)
        target = np.arange(places)[:, None] * 4 + np.arange(4)[None, :]
        live = row >= 0
        drop, extra, role = (self.blank | self.repeat)[row], UNFINISHED * self.unended[row], self.role[row]
        for state in range(4):
            due = DUE[state]
            to = np.array(FOLLOWS[state])[role]
            after = np.vstack([value[1:], value[-1:]])
            options = (
                (4, live & ~drop & (after[:, due] + REROLE + extra == value[:, state]), (np.arange(places) + 1) * 4 + due),
                (3, live & ~drop & (to >= 0) & (after[np.arange(places), to] + KEEP + extra == value[:, state]), (np.arange(places) + 1) * 4 + to),
                (2, value[:, due] + INSERT == value[:, state], np.arange(places) * 4 + due),
                (1, live & (after[:, state] + DELETE == value[:, state]), (np.arange(places) + 1) * 4 + state),
            )
            for code, holds, to_node in options:  # the least letter is set last
                if code == 2:  # the end of an unfinished part is its next part's start
                    holds = holds.copy()
                    holds[ends[~final]] = False
                letter[:, state] = np.where(holds, code, letter[:, state])
                target[:, state] = np.where(holds, to_node, target[:, state])
        return letter.ravel(), target.ravel(), row


def doubled(letter, target):
    """Pointers over 1, 2, 4, ... edits, letters passed on the way, and the rank of each node's audit.

    After round k nodes are ranked by the first 2^k letters of their least audits: the pair of a node's rank and that of the
    node 2^k letters on is the rank by twice as many. No letter leaves a node by two optimal arcs, since after any
    role only one of user and assistant may follow; so an arc is least by its letter, then by the rank it leads to.
    """
    import numpy as np

    rank, pointers, passed = letter.copy(), [target], [(letter > 0).astype(np.int64)]
    while (letter[pointers[-1]] > 0).any():
        to, count = pointers[-1], passed[-1]
        rank = np.unique(rank * (len(rank) + 5) + rank[to], return_inverse=True)[1]
        pointers.append(to[to])
        passed.append(count + count[to])
    return pointers, passed, rank


def least_paths(letter, pointers, passed, starts):
    """Nodes of the least path from each start, in order, and which start each belongs to; and where the paths end."""
    import numpy as np

    length = passed[-1][starts]
    of = np.repeat(np.arange(len(starts)), length)
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    node = starts[of]
    for k, to in enumerate(pointers):
        node = np.where((step >> k) & 1 == 1, to[node], node)
    return node, of, pointers[-1][starts]


def _repeats(turns: DataFrame) -> DataFrame:
    """Places of rows whose role and text an earlier row of the conversation has."""
    first = turns.groupBy("conv", "said").agg(F.min("at").alias("at"))
    return turns.where(~F.col("blank")).select("chunk", "at").join(first.select("at"), "at", "left_anti")


_NOTE = "chunk long, kind int, at long, costs array<long>, state int, before int"


def _note(df: DataFrame, kind: int) -> DataFrame:
    """What is told to a chunk: a repeated row (0), costs at the end of a part (1), a part's entry (2)."""
    null = {"costs": "array<long>", "state": "int", "before": "int"}
    columns = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in null.items()]
    return df.select("chunk", F.lit(kind).alias("kind"), "at", *columns)


def _open(rows, notes):
    """A chunk, and what it is told of its parts by the place of their first row."""
    kinds, ats = notes.column("kind").to_pylist(), notes.column("at").to_pylist()
    told: dict[int, dict] = {1: {}, 2: {}}
    for kind, at, costs, state, before in zip(kinds, ats, *(notes.column(c).to_pylist() for c in ("costs", "state", "before"))):
        if kind:
            told[kind][at] = (costs, state, before)
    return _Chunk(rows, [at for kind, at in zip(kinds, ats) if kind == 0]), told


_EDGE = "chunk long, at long, matrix array<long>, last int"


def _edges(rows, notes):
    """Of the first and last part of a chunk, which may go on elsewhere: costs from each state to each state."""
    import numpy as np
    import pyarrow as pa

    chunk, _ = _open(rows, notes)
    parts = np.unique([0, len(chunk.starts) - 1])
    ends = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(parts), axis=0)
    value = chunk.costs(parts, ends)[chunk.starts[parts] + parts]
    first = chunk.starts[parts]
    return pa.table(
        {
            "conv": rows.sort_by("at").column("conv").take(pa.array(first)),
            "chunk": rows.column("chunk").take(pa.array([0] * len(parts))),
            "at": pa.array(chunk.at[first], pa.int64()),
            "matrix": pa.array([v.ravel().tolist() for v in value], pa.list_(pa.int64())),
            "last": pa.array(chunk.role[first + chunk.lengths[parts] - 1], pa.int32()),
        }
    )


def _chained(df: DataFrame, order: Column, schema: str, step) -> DataFrame:
    """Run ``step(row, state)`` down the parts of each conversation in order; it returns an output and the next state.

    A part stands for a chunk, so there is one small row for thousands of turns or megabytes of text.
    """

    def walk(batches):
        import pyarrow as pa

        names, kinds = None, None
        conv, state, fresh = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if fresh or row["conv"] != conv:
                    conv, state, fresh = row["conv"], None, False
                made, state = step(row, state)
                out.append(made)
            if out:
                names = names or list(out[0])
                kinds = kinds or {"chunk": pa.int64(), "at": pa.int64(), "costs": pa.list_(pa.int64()), "state": pa.int32(), "before": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kinds[c]) for c in names], names=names)

    dealt = df.repartition(partitions(df.sparkSession), "conv")
    return dealt.sortWithinPartitions(F.col("conv").asc_nulls_first(), order).mapInArrow(walk, schema)


def _cost_after(row, state):
    """From the last part to the first: costs at a part's end, then at its start for the part before."""
    costs = state or [c[0] for c in CLOSED]
    m = row["matrix"]
    start = [min(min(m[4 * x + y] + costs[y] for y in range(4)), FAR) for x in range(4)]
    start[2], start[3] = min(start[2], start[3] + INSERT), min(start[3], start[2] + INSERT)
    start[0], start[1] = min(start[0], start[2] + INSERT), min(start[1], start[2] + INSERT)
    return {"chunk": row["chunk"], "at": row["at"], "costs": costs if state else None}, start


def _entry(row, state):
    """From the first part to the last: the state a part is entered in and the role before it."""
    here, before = state or (0, None)
    made = {"chunk": row["chunk"], "at": row["at"], "state": here, "before": before}
    return made, (row["exits"][here], row["last"])


def _exits(rows, notes):
    """Where the least path leaves an open part, for each state it may be entered in."""
    import numpy as np
    import pyarrow as pa

    chunk, told = _open(rows, notes)
    letter, pointers, passed, _, _, _ = _solved(chunk, told)
    parts = [p for p, s in enumerate(chunk.starts) if int(chunk.at[s]) in told[1]]
    starts = np.array([4 * (chunk.starts[p] + p) + x for p in parts for x in range(4)], dtype=np.int64)
    out = (pointers[-1][starts] % 4).reshape(-1, 4) if parts else np.zeros((0, 4), int)
    return pa.table(
        {
            "chunk": pa.array([rows.column("chunk")[0].as_py()] * len(parts), pa.int64()),
            "at": pa.array([int(chunk.at[chunk.starts[p]]) for p in parts], pa.int64()),
            "exits": pa.array(out.tolist(), pa.list_(pa.int32())),
        }
    )


def _solved(chunk, told):
    """Costs of all parts, optimal arcs, doubled pointers."""
    import numpy as np

    parts = np.arange(len(chunk.starts))
    ends = np.array(CLOSED, dtype=np.int64)[None].repeat(len(parts), axis=0)
    final = np.ones(len(parts), bool)
    for p, s in enumerate(chunk.starts):
        costs = told[1].get(int(chunk.at[s]), (None,))[0]
        if costs is not None:
            ends[p, :, 0], final[p] = costs, False
    letter, target, row = chunk.arcs(chunk.costs(parts, ends), final)
    pointers, passed, rank = doubled(letter, target)
    return letter, pointers, passed, row, rank, final


def _edits(chunk, told):
    """Of each part in order its edits: letters, rows (or -1) and roles given."""
    import numpy as np

    letter, pointers, passed, row, _, _ = _solved(chunk, told)
    entry = np.array([(told[2].get(int(chunk.at[s])) or (0, 0))[1] for s in chunk.starts], dtype=np.int64)
    starts = 4 * (chunk.starts + np.arange(len(chunk.starts))) + entry
    node, part, _ = least_paths(letter, pointers, passed, starts)
    code = letter[node]
    taken = np.where(code == 2, -1, row[node // 4])
    due = np.array(DUE)[node % 4]
    return code, taken, np.where((code == 2) | (code == 4), due, 0), part


def _repaired(rows, notes):
    """A row for each part: counts, cost, audit, and the hash or, of an open part, the repaired bytes."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    chunk, told = _open(rows, notes)
    rows = chunk.rows
    code, taken, due, part = _edits(chunk, told)
    edge = np.searchsorted(part, np.arange(len(chunk.starts) + 1))
    role, text, turn = rows.column("role").to_pylist(), rows.column("text").to_pylist(), rows.column("turn").to_pylist()
    extra = np.where(taken >= 0, UNFINISHED * chunk.unended[taken], 0)
    cost = np.array([0, DELETE, INSERT, KEEP, REROLE])[code] + np.where(code >= 3, extra, 0)
    known = {(1, 2), (2, 3), (3, 2)}
    out: dict[str, list] = {c: [] for c in _PART if c != "conv"}
    for p, s in enumerate(chunk.starts.tolist()):
        n = int(chunk.lengths[p])
        at = int(chunk.at[s])
        whole = at not in told[2]
        span = slice(s, s + n)
        before = None if whole else told[2][at][2]
        roles = ([] if before is None else [before]) + chunk.role[span].tolist()
        turns = [t for t in turn[span] if t is not None]
        lines = []
        for i in range(edge[p], edge[p + 1]):
            if code[i] != 1:
                named = role[taken[i]] if code[i] == 3 else NAMES[due[i]]
                lines.append(f"{named}:{text[taken[i]] if taken[i] >= 0 else ''}")
        data = "\n".join(lines).encode("utf-8")
        values = {
            "chunk": rows.column("chunk")[0].as_py(),
            "low": turns[0] if turns else None,
            "high": turns[-1] if turns else None,
            "distinct": len(set(turns)),
            "blank": int(chunk.blank[span].sum()),
            "duplicate": int(chunk.repeat[span].sum()),
            "truncated": int(chunk.unended[span].sum()),
            "illegal": sum(pair not in known for pair in zip(roles, roles[1:])),
            "cost": int(cost[edge[p] : edge[p + 1]].sum()),
            "audit": "".join(LETTERS[c] for c in code[edge[p] : edge[p + 1]]),
            "lines": len(lines),
            "sha256": hashlib.sha256(data).hexdigest() if whole else None,
            "data": None if whole else data,
        }
        for c, v in values.items():
            out[c].append(v)
    conv = rows.column("conv").take(pa.array(chunk.starts))
    kinds = {"audit": pa.string(), "sha256": pa.string(), "data": pa.binary()}
    return pa.table({"conv": conv} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def _edit_rows(rows, notes):
    """A row for each edit, in order."""
    import numpy as np
    import pyarrow as pa

    chunk, told = _open(rows, notes)
    code, taken, due, part = _edits(chunk, told)
    pick = pa.array(np.where(taken < 0, 0, taken), mask=taken < 0)
    given = [NAMES[d] if d else None for d in due.tolist()]
    return pa.table(
        {
            "conv": chunk.rows.column("conv").take(pa.array(chunk.starts[part])),
            "chunk": pa.array([rows.column("chunk")[0].as_py()] * len(part), pa.int64()),
            "position": pa.array(np.arange(len(part)), pa.int64()),
            "edit": pa.array([LETTERS[c] for c in code.tolist()], pa.string()),
            "turn": chunk.rows.column("turn").take(pick),
            "role_before": chunk.rows.column("role").take(pick),
            "role_given": pa.array(given, pa.string()),
            "text": chunk.rows.column("text").take(pick),
        }
    )


_PART = {
    "conv": None, "chunk": "long", "low": "long", "high": "long", "distinct": "long", "blank": "long",
    "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string",
    "lines": "long", "sha256": "string", "data": "binary",
}


def _joined(batches):
    """Put the parts of each open conversation together; the bytes stream through the hash part by part."""
    import hashlib

    import pyarrow as pa

    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    now = None

    def close():
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["distinct"]
        row = {"gaps": gaps} | {c: now[c] for c in sums} | {"audit": "".join(now["audit"]), "sha256": now["hash"].hexdigest()}
        return pa.RecordBatch.from_arrays(
            [now["conv"], *[pa.array([v]) for v in row.values()]], names=["conv", *row]
        )

    for batch in batches:
        for i, row in enumerate(batch.drop_columns(["conv"]).to_pylist()):
            conv = batch.column("conv").slice(i, 1)
            if now is None or not now["conv"].equals(conv):
                if now:
                    yield close()
                now = {c: 0 for c in sums} | {"conv": conv, "low": None, "high": None, "distinct": 0, "audit": []}
                now |= {"hash": hashlib.sha256(), "lines": 0}
            for c in sums:
                now[c] += row[c]
            if row["low"] is not None:
                now["distinct"] += row["distinct"] - (now["high"] == row["low"])
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = row["high"]
            if row["lines"]:
                now["hash"].update(b"\n" * bool(now["lines"]) + row["data"])
                now["lines"] += row["lines"]
            now["audit"].append(row["audit"])
    if now:
        yield close()


def _planned(df: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame, str]:
    """Ordered rows, and what their chunks must be told to repair their parts by themselves."""
    turns = _ordered(df, conv, turn, role, text)
    kind = turns.schema["conv"].dataType.simpleString()
    thin = turns.select("chunk", "at", "conv", "initial", "blank", "unended")
    told = settle(_note(_repeats(turns), 0), "repeats")

    def over_chunks(rows, notes, work, schema):
        return rows.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(work, schema)

    edges = settle(over_chunks(thin, told, _edges, f"conv {kind}, {_EDGE}"), "edges")
    same = F.col("conv").eqNullSafe(F.col("conv_"))
    several = edges.groupBy(F.col("conv").alias("conv_")).count().where("count > 1").select("conv_")
    edges = edges.join(several, same).drop("conv_")
    after = _chained(edges, F.col("chunk").desc(), "chunk long, at long, costs array<long>", _cost_after)
    after = settle(after, "costs").where("costs is not null")
    told = told.union(_note(after, 1))
    opened = after.select("chunk").distinct()
    exits = over_chunks(
        thin.join(opened, "chunk", "left_semi"),
        told.join(opened, "chunk", "left_semi"),
        _exits,
        "chunk long, at long, exits array<int>",
    )
    linked = edges.join(exits, ["chunk", "at"], "left").withColumn("exits", F.coalesce("exits", F.array([F.lit(0)] * 4)))
    entry = _chained(linked, F.col("chunk"), "chunk long, at long, state int, before int", _entry)
    return turns, settle(told.union(_note(entry, 2)), "notes"), kind


def repaired_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The edits of every conversation with what they give: conv, position, edit, turn, role, text.

    ``position`` rises along a conversation. Deleted rows (D) keep their role and text; inserted ones (I) have no turn
    and empty text.
    """
    turns, notes, kind = _planned(df, conv, turn, role, text)
    schema = f"conv {kind}, chunk long, position long, edit string, turn long, role_before string, role_given string, text string"
    rows = turns.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(_edit_rows, schema)
    return rows.select(
        "conv",
        F.struct("chunk", "position").alias("position"),
        "edit",
        "turn",
        F.coalesce("role_given", "role_before").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256.

    Rows are taken by turn, nulls first, then by role, the first 64 characters and a digest of the text. A null role or
    text is one space, a null conv a conversation like any other. An empty or other role has no legal place: such a
    row is changed or deleted. Repeated rows are duplicates of the first. Other columns are ignored, an empty table
    gives no row. Texts are held a chunk at a time (BYTES and one text more). A conversation of any number of rows is spread over many
    tasks; only its hash, which is serial by nature, and its audit, one string, pass through one task, a chunk at a time.
    """
    turns, notes, kind = _planned(df, conv, turn, role, text)
    schema = ", ".join(f"{c} {t or kind}" for c, t in _PART.items())
    parts = settle(turns.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(_repaired, schema), "parts")
    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    whole = parts.where("data is null").withColumn("gaps", gaps).select(*columns)
    cut = parts.where("data is not null").repartition(partitions(df.sparkSession), "conv")
    cut = cut.sortWithinPartitions(F.col("conv").asc_nulls_first(), "chunk")
    kinds = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string"
    return whole.union(cut.mapInArrow(_joined, kinds))


def damaged_and_repaired(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Damage the rows, repair them, and return every conversation, also those that lost all rows."""
    rows = damage(df, conv, turn, role, text)
    found = repair(rows, "conv", "turn", "role", "text")
    there = rows.select(F.col("conv").alias("conv_")).distinct()
    lost = df.select(F.col(conv).alias("conv")).distinct()
    lost = lost.join(there, F.col("conv").eqNullSafe(F.col("conv_")), "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.union(lost.select("conv", *zero, F.lit("").alias("audit"), nothing.alias("sha256")))
