"""Induced sorting against plain sorting, and removed repeats against a count of every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import induced, suffix_dedup
from rollbook.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_order(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("direct", [0, 12, 1 << 20])
@pytest.mark.parametrize("small", [False, True])
def test_suffix_order_equals_sorting(monkeypatch, tmp_path, small, direct):
    monkeypatch.setattr(induced, "DIRECT", direct)
    if small:
        monkeypatch.setattr(induced, "RANGE", 4)
        monkeypatch.setattr(induced, "SWEEP", 5)
    rng, files = np.random.default_rng(3), 0
    for trial in range(150):
        n, letters = int(rng.integers(0, 130)), int(rng.integers(1, 7))
        text = rng.integers(1, letters + 1, n).tolist()
        if trial % 3 == 0:
            text = (text[:9] * 15)[:n]
        spill = induced.Spill(str(tmp_path / str(trial)), 64) if trial % 4 == 0 else None
        cap = int(rng.integers(1, 60))
        places, shared = induced.suffix_order(np.array([*text, 0], dtype=np.int64), cap, spill)
        if spill:
            files += spill.files
            spill.close()
        assert (places.tolist(), shared.tolist()) == plain_order([*text, 0], cap)
    assert bool(files) == small and not list(tmp_path.iterdir())


def test_sorting_in_memory_equals_sorting():
    rng = np.random.default_rng(8)
    for _ in range(150):
        text = [*rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 90))).tolist(), 0]
        cap = int(rng.integers(1, 60))
        places, shared = induced.sort_in_memory(np.array(text), cap)
        assert (places.tolist(), shared.tolist()) == plain_order(text, cap)


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, kept))
    return out


def words(rng, n, letters="abcdeé "):
    return "".join(rng.choice(letters) for _ in range(n))


def texts(seed):
    rng = random.Random(seed)
    passage, line = words(rng, 520), words(rng, 300)
    out = [words(rng, rng.randrange(0, 900)) for _ in range(30)]
    out += [words(rng, 60) + passage + words(rng, 80) for _ in range(12)]
    out += [words(rng, 300) + line + words(rng, 300) for _ in range(25)]  # shared, but shorter than a window
    out += [passage[100:], passage[:150], passage[:399], passage[:400], passage + passage]
    out += out[:6] + [None, "", "a" * 1500, "ab" * 700, words(rng, 37) * 30, "x" * 399, "\U0001f600" * 120]
    near = list(out[3] + passage + out[4])
    for i in range(0, len(near), 450):
        near[i] = "#"
    return [*out, "".join(near)]


def check(spark, given, window=400, partitions=3):
    df = spark.createDataFrame(list(enumerate(given)), "doc long, text string").repartition(partitions)
    clash = {c: F.lit("clash") for c in ("row", "key", "data", "spans", "low", "n", "known", "id", "off")}
    got = suffix_dedup.remove_repeats(df.withColumns(clash), "doc", "text", window).collect()
    assert len(got) == len(given)
    for r in got:
        want = brute_of(given, window)[r.key]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, r.key


_KNOWN: dict = {}


def brute_of(given, window):
    key = (id(given), window)
    if key not in _KNOWN:
        _KNOWN[key] = brute(given, window)
    return _KNOWN[key]


def test_repeats_equal_counting(spark):
    check(spark, texts(1))


def test_hot_anchors_are_halved(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 3)
    check(spark, texts(2))


def test_small_segments_shards_and_files(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    monkeypatch.setattr(suffix_dedup, "MEMORY", 500)
    check(spark, texts(3), partitions=2)


def test_no_rows_and_only_short_ones(spark):
    none = spark.createDataFrame([], "doc long, text string")
    assert suffix_dedup.remove_repeats(none, "doc", "text").count() == 0
    check(spark, ["short", None, "", "short"])


def test_query_equals_counting(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute([t for _, t in rows], 400)
    want = {k: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (k, _), w in zip(rows, want)}
    got = QUERIES["op13_suffix_dedup"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
