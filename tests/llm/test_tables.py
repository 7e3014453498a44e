"""Operators on vectors, pages and conversations against brute force, the SQL, and the pipeline."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from rollbook.llm import ann, embedding_dedup, quotations, warc
from rollbook.llm.queries import OP9_SQL, ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")
ODD_VECTORS = [
    (None, [1.0, 2.0, 3.0], 1), (900, None, 1), (901, [0.0, 0.0, 0.0], 1), (902, [1.0, None, 0.0], 1),
    (903, [1.0, float("nan"), 0.0], 1), (904, [float("inf"), 1.0, 0.0], 1), (905, [], 1), (906, [1.0, 2.0], 1),
    (907, [1.0, 2.0, 3.0], None),
]


def vectors(spark, seed=0, n=120, dim=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).round(3).tolist(), int(rng.integers(0, 2))) for i in range(n)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]  # copies
    rows += [(300 + i, [2 * x for x in rows[i][1]], rows[i][2]) for i in range(20)]  # scaled
    rows += rows[:3]  # repeated rows
    rows += [r if dim == 3 else (r[0], r[1] and r[1] + [0.0] * (dim - 3), r[2]) for r in ODD_VECTORS]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = {c: F.lit("clash") for c in ("key", "vector", "node", "copies", "_label", "order", "rank", "small")}
    return rows, df.withColumns(clash)


def usable(v, dim=3):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


def unit(v):
    x = np.array(v, np.float32).astype(float)
    return x / np.sqrt(x @ x)


def test_near_vectors_equal_brute_force(spark):
    rows, df = vectors(spark)
    got = embedding_dedup.near_vectors(df, "vec_id", "embedding", "label", pivots=12, prefix=6, shared=1, probes=6)
    got = sorted(got.collect(), key=lambda r: repr((r.vec_id, r.n_links, r.component_id)))
    ok = [i for i, (k, v, lab) in enumerate(rows) if usable(v) and k is not None and lab is not None]
    x = {i: unit(rows[i][1]) for i in ok}
    links = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.98] for i in ok}
    component = {i: rows[i][0] for i in ok}
    changed = True
    while changed:
        changed = False
        for i in ok:
            low = min([component[i], *(component[j] for j in links[i])])
            changed |= low != component[i]
            component[i] = low
    want = [
        (k, len(links.get(i, [])), component.get(i, k), component.get(i, k) == k or k is None)
        for i, (k, _, _) in enumerate(rows)
    ]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: repr(r[:3]))


def test_vectors_of_every_length_take_part(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 4.001], 1), (4, [5.0], 1)]
    rows += [(10 + i, np.eye(3)[i % 3].tolist(), 1) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, "vec_id", "embedding", "label").collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [2, 2, 2, 0] and got[10] == 3 and got[11] == 2
    found = ann.nearest(df, "vec_id", "embedding", F.col("vec_id") <= 4, k=5).collect()
    want = {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in want} == want
    assert not [r for r in found if r.query_id == 4]


def test_walks_over_many_lists_find_the_nearest(spark, monkeypatch):
    """60 lists, walks that keep 12 of them: recall at 5 of 0.9, and few of the vectors in the lists searched."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 16)) * 0.35).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = []
    search = ann._search

    def counted(ask, member, sizes, k):
        lists = member.groupBy("_list").count()
        pairs = ask.select(F.explode("lists").alias("_list")).join(lists, "_list").agg(F.sum("count")).first()[0]
        asked.append(pairs / max(1, ask.count()))
        return search(ask, member, sizes, k)

    monkeypatch.setattr(ann, "_search", counted)
    got = ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, lists=60, width=12).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 20):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s, kind="stable")[:5]) & {r.vec_id for r in got if r.query_id == q})
    assert hits / (5 * 150) >= 0.9
    assert asked[0] < 3000 / 3


def test_the_exact_setting_compares_every_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    rows = [(i, (base[i % 40] + rng.normal(size=6) * 0.12).tolist(), 1) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_vectors(df, "vec_id", "embedding", "label", pivots=8, prefix=8, shared=1, probes=1)
    x = np.array([v / np.sqrt(v @ v) for v in (np.array(r[1]) for r in rows)])
    links = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert links.sum() and [r.n_links for r in sorted(got.collect(), key=lambda r: r.vec_id)] == links.tolist()


def test_a_hot_group_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist(), 1) for i in range(200)]
    rows += [(1000 + i, rng.normal(size=16).tolist(), 1) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, "vec_id", "embedding", "label").collect()}
    x = np.array([unit(v) for _, v, _ in rows])
    n = (x @ x.T >= 0.98).sum(1) - 1
    assert [got[k].n_links for k, _, _ in rows] == n.tolist()
    assert {got[i].component_id for i in range(200)} == {0}


def test_nearest_equals_brute_force(spark):
    rows, df = vectors(spark)
    got = ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, k=5).collect()
    ok = [i for i, (k, v, _) in enumerate(rows) if usable(v) and k is not None]
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i in ok if rows[i][0] % 10 == 0]
    assert len(got) == 5 * len(queries) and set(found) == {rows[i][0] for i in queries}
    hits = total = 0
    for i in queries:
        scores = sorted(((-(unit(rows[i][1]) @ unit(rows[j][1])), rows[j][0]) for j in ok if j != i))
        best = scores[4][0]
        mine = [m for m in found[rows[i][0]]]
        total += 5
        hits += sum(-s <= best + 1e-9 for _, _, s in mine[:5])
        ordered = sorted(mine)
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(ordered, ordered[1:])) or len(mine) > 5
    assert hits / total >= 0.95


def test_nearest_of_few_rows_returns_all(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (50, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect())
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert [r[3] for r in got] == pytest.approx([1, 1, 0, 1, 1, 0])
    assert ann.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0
    assert ann.nearest(df.limit(1), "vec_id", "embedding", F.lit(True)).count() == 0
    assert embedding_dedup.near_vectors(df.limit(0), "vec_id", "embedding", "label").count() == 0


# ---- WARC


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 4}</p>") for i in range(20)]
    rows += [rows[7], rows[7], (30, "a b\r\nWARC-Type: x é", "long " * 80_000), (31, None, None), (None, "u", ""), (2**60, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumns({c: F.lit("clash") for c in ("key", "uid", "payload", "refers_to", "first", "n")})
    index, folder = warc.write_archives(df, "page_id", "url", "html", frame_bytes=2000)
    assert index.groupBy("path", "frame").count().count() > 1
    got = warc.read_archives(index).collect()
    first = {}
    for k, _, h in rows:
        h = h or ""
        if k is not None:
            first[h] = min(k, first.get(h, k))
    assert len(got) == len(rows)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    by_digest = {digest(h): h for _, _, h in [(0, 0, h or "") for _, _, h in rows]}
    responses = [r for r in got if r.record_type == "response"]
    assert sorted(by_digest[r.payload_digest] for r in responses) == sorted(first)
    for r in got:
        h = by_digest[r.payload_digest]
        assert r.payload_bytes == len(h.encode())
        if r.record_type == "response":
            assert r.key == first[h] and r.refers_to is None and bytes(r.payload) == h.encode()
        else:
            assert r.refers_to == first[h] and r.payload is None
    assert sorted(r.key for r in got if r.key is not None) == sorted(k for k, _, _ in rows if k is not None)
    assert {r.uri for r in got if r.key == 30} == {"a%20b%0D%0AWARC-Type:%20x%20%C3%A9"}
    large, _ = warc.write_archives(df, "page_id", "url", "html", least=10**6)
    assert warc.read_archives(large).where("record_type = 'revisit'").count() == 0
    none, _ = warc.write_archives(df.limit(0), "page_id", "url", "html")
    assert warc.read_archives(none).count() == 0


# ---- quotations


def conversation_rows():
    return [
        (1, 0, "user", "How are you?\nI have a long question about rivers."),
        (1, 1, "assistant", "> how are  YOU?\nFine.\nRivers flow downhill."),
        (1, 2, "user", "> Rivers flow downhill.\n>> I have a long question about rivers.\nWhy?"),
        (1, 3, "user", ">I have a long question about rivers.\nTell me more on that first."),
        (1, 4, "assistant", "> Why?\nGravity."),
        (1, 5, "user", "> Tell me more on that first.\nPlease."),
        (1, 6, "user", "> Nobody said this.\nAh."),
        (1, 7, "user", "> Gravity.\nThanks."),
        (2, 3, None, None),
        (2, 1, "user", ""),
        (2, 2, "user", "> Gravity.\nOther conversation."),
        (3, 0, "user", "same"), (3, 1, "user", "same"), (3, 2, "user", "> same\nreply"),
    ]


def test_quotations(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("c", "uid", "position", "rank", "conversation")})
    got = {(r.conv_id, r.turn): r for r in quotations.link_quotations(df, "conv_id", "turn", "role", "text").collect()}
    replies = {k: (r.reply_to, r.by_quote) for k, r in got.items()}
    assert replies == {
        (1, 0): (None, False), (1, 1): (0, True), (1, 2): (1, True), (1, 3): (0, True), (1, 4): (2, True),
        (1, 5): (3, True), (1, 6): (5, False), (1, 7): (4, True),
        (2, 1): (None, False), (2, 2): (1, False), (2, 3): (2, False),
        (3, 0): (None, False), (3, 1): (0, False), (3, 2): (0, True),
    }
    order = [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k].reply_order)]
    assert order == [0, 1, 2, 4, 7, 3, 5, 6]
    assert got[(1, 2)].body == "Why?" and got[(1, 2)].chat == "<|user|>\nWhy?\n"
    assert got[(2, 3)].body == "" and got[(2, 3)].chat == "<|user|>\n\n"


def test_quotations_equal_the_sql(spark):
    rng = random.Random(6)
    rows, said = [], {}
    for c in range(30):
        said[c] = []
        for t in range(rng.randint(1, 14)):
            own = [f"line {rng.randint(0, 12)} of  Text" for _ in range(rng.randint(1, 3))]
            quoted = []
            if said[c] and rng.random() < 0.6:
                other = rng.choice(said[c]).split("\n")
                quoted = ["> " + x.upper() for x in rng.sample(other, rng.randint(1, len(other)))]
            rows.append((c, t, rng.choice(["user", None]), "\n".join(quoted + own)))
            said[c].append(rows[-1][3])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotations.link_quotations(df, "conv_id", "turn", "role", "text")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    result = con.execute(OP9_SQL)
    columns = [d[0] for d in result.description]
    want = sorted(repr(tuple(r)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
    assert sum(r.by_quote for r in got.collect()) > 20


def test_rows_without_conversation_and_repeated_turns(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "> a\nb"), (4, 0, "x", "a"), (4, 0, "x", "a"), (4, None, "x", "> a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotations.link_quotations(df, "conv_id", "turn", "role", "text").collect()
    assert len(got) == 5 and sum(r.by_quote for r in got) == 1
    assert [r.reply_order for r in got if r.conv_id is None] == [0, 0]
    assert quotations.link_quotations(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


# ---- queries and pipeline


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck):
    got = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr(tuple(r)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ["op5_source_mix", "op9_quotation_threads"])
def test_native_operators_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "InPandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("uid", F.lit(1)).withColumn("row", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, SF_DIR)
        assert docs_after.columns == docs.columns
        assert 0 < docs_after.count()
        docs = docs_after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == docs.count()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
