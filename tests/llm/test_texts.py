"""Operators on texts against brute force, and their edge cases."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollbook.llm import byte_bpe, mixing, quality, simhash, token_counts, token_files
from rollbook.llm.components import components
from rollbook.llm.queries import END, PIECES, RANKS, WORDS
from rollbook.llm.shared import ranked

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "A  B   c \n d\n\n e \t f", "don't STOP'll x é́ ß",
    "漢字テスト語 　 x  y z \u0085 w", "\U0001F600\U0001F601 <|endoftext|> <|startoftext|>",
    "word " * 3000, "z" * 3000 + " " * 40 + "ab" * 900, "x \x1c y \x1f \x00 end", "tail,.;!? #### *a* 'tis",
]


def texts_frame(spark, extra=True):
    """Odd texts, some rows twice, a row without key, columns whose names operators use inside."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[6], rows[6], (None, "no key", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = "key uid ids rank size src target taken fingerprint component order row score _label k0 _range".split()
    return df.withColumns({c: F.lit("clash") for c in clash}) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- token counts


def brute_count(word, pieces, byte_score):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        ways = [
            (best[j][0] + pieces[word[j:i]], -(best[j][1] + 1)) for j in range(i) if word[j:i] in pieces
        ]
        if word[i - 1] not in pieces:
            raw = len(word[i - 1].encode())
            ways.append((best[i - 1][0] + raw * byte_score, -(best[i - 1][1] + raw)))
        top = max(ways)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark):
    df = texts_frame(spark)
    pieces, byte_score = token_counts.zipf_pieces(open(PIECES, "rb").read())
    want = []
    for key, text in pairs(df):
        words = [w.decode() for w in (text or "").encode().split()]
        memo = {w: brute_count(token_counts.MARK + w, pieces, byte_score) for w in set(words) if len(w) < 500}
        if all(w in memo for w in words):
            want.append((key, len(words), sum(memo[w] for w in words)))
    got = [tuple(r) for r in token_counts.token_counts(df, "text", ["doc_id"], PIECES).collect()]
    assert len(got) == df.count()
    counter = collections.Counter(got)
    assert all(counter[w] == n for w, n in collections.Counter(want).items())
    assert token_counts.token_counts(empty(spark), "text", ["doc_id"], PIECES).count() == 0


def test_shared_prefixes_and_ties():
    root = token_counts.piece_trie({"a": -1.0, "b": -1.0, "ab": -2.0, "abc": -9.0, "c": -1.0})
    got = token_counts.count_words(["ab", "abc", "abcc", "b", ""], root, -3.0)
    assert got == {"ab": 1, "abc": 2, "abcc": 3, "b": 1, "": 0}
    assert token_counts.count_words(["é", "aé"], root, -3.0) == {"é": 2, "aé": 3}


# ---- token files


def want_tokens(df):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(k, tokenizer.encode(t or "", add_special_tokens=False).ids + [END]) for k, t in pairs(df)]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_token_files_round_trip(spark):
    df = texts_frame(spark)
    blocks, table = token_files.write_tokens(df, "doc_id", "text", WORDS, END)
    got = sorted(token_files.read_tokens(blocks, table).collect(), key=lambda r: r.start)
    want, at = want_tokens(df), 0
    assert len(got) == len(want)
    for row, (key, ids) in zip(got, want):
        assert (row.key, row.start) == (key, at)
        assert zlib.crc32(row.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_a_batch_is_encoded_as_arrow(spark):
    """Ids of all texts of an array, also of a slice of one, and their counts, without a Python object a text."""
    import pyarrow as pa

    library = Tokenizer.from_file(WORDS)
    definition = open(WORDS, "rb").read()
    texts = pa.array([t or "" for t in ODD_TEXTS]).slice(2)
    tokenizer, held = token_files._tokenizer(definition)
    got = token_files._encode(texts, tokenizer, held, "<u2", END)
    want = [library.encode(t, add_special_tokens=False).ids + [END] for t in texts.to_pylist()]
    assert [np.frombuffer(ids, "<u2").tolist() for ids in got.to_pylist()] == want
    batch = pa.RecordBatch.from_arrays([got.slice(1)], ["ids"])
    (counts,) = token_files._counts([batch, batch.slice(0, 0)], "<u2", library.get_vocab_size())
    counted = collections.Counter(i for ids in want[1:] for i in ids)
    assert dict(zip(counts["id"].to_pylist(), counts["n"].to_pylist())) == counted


def test_special_names_are_encoded_as_the_library_does(spark):
    texts = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>x", "<|ENDOFTEXT|>", "a<|endoftext|", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks, table = token_files.write_tokens(df, "doc_id", "text", WORDS, END)
    got = [np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_tokens(blocks, table).orderBy("key").collect()]
    assert got == [ids for _, ids in want_tokens(df)] and 49407 in got[0]


def test_a_tokenizer_of_another_kind_is_refused(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    whole = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "A": 3}, []))
    whole.pre_tokenizer = pre_tokenizers.Split("b", "isolated")
    whole.save(str(tmp_path / "t.json"))
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="word by word"):
        token_files.write_tokens(df, "doc_id", "text", str(tmp_path / "t.json"), END)


def test_files_of_several_blocks(spark, monkeypatch):
    """Blocks of 50 ids, written and read through the files themselves."""
    import pandas as pd

    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 300, int(n)).astype("<u2") for n in rng.integers(0, 90, 13)]
    freq = token_files.even_out(np.bincount(np.concatenate(docs), minlength=300) + 1)
    monkeypatch.setattr(token_files, "BLOCK", 50)
    folder = token_files.new_path(spark, "blocks")
    token_files.write_file(f"{folder}/frequencies.bin", [freq.astype("<i8").tobytes()])

    class Held:
        value = freq

    class Task:
        partitionId = taskAttemptId = attemptNumber = staticmethod(lambda: 0)

    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: Task))
    frame = pd.DataFrame({"key": [str(i) for i in range(13)], "ids": [d.tobytes() for d in docs]})
    blocks = pd.concat(token_files._files(iter([frame]), folder, Held, "<u2"))
    assert len(blocks) > 5
    read = pd.concat(token_files._read(iter([blocks]), f"{folder}/frequencies.bin")).sort_values("local_start", kind="stable")
    assert [np.frombuffer(i, "<u4").tolist() for _, i in sorted(zip(read["key"].astype(int), read["ids"]))] == [d.tolist() for d in docs]


def test_token_files_of_nothing(spark):
    blocks, table = token_files.write_tokens(empty(spark), "doc_id", "text", WORDS, END)
    assert token_files.read_tokens(blocks, table).count() == 0


def test_documents_over_several_blocks(spark, monkeypatch):
    """Small blocks, so that documents begin and end inside blocks of others."""
    rng = np.random.default_rng(0)
    freq = token_files.even_out(np.bincount(rng.zipf(1.5, 5000) % 300, minlength=300) + 1)
    tables = token_files.tables_of(freq)
    for n in (1, 63, 64, 65, 1000, 70_000):
        ids = rng.integers(0, 300, n)
        data = token_files.encode_block(ids, tables)
        assert (token_files.decode_block(data, n, tables) == ids).all()


def test_rare_and_single_ids_keep_a_frequency():
    freq = token_files.even_out([10**9, 1, 0, 1])
    assert freq.sum() == 1 << token_files.BITS and freq[1] >= 1 and freq[2] == 0
    assert token_files.even_out([0, 5]).tolist() == [0, 1 << token_files.BITS]
    many = token_files.even_out([10**12] + [1] * 60_000)
    assert many.sum() == 1 << token_files.BITS and many.min() >= 1


# ---- source mix


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 900), rng.choice(["a", "b", "b", "b", None, "ä"])) for i in range(300)]
    rows += [(i, None, "a") for i in range(300, 305)] + [(900, "", "only empty"), (None, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit(1) for c in ("size", "target", "src", "rank", "before_size")})
    got = mixing.mix(df, "doc_id", "text", "source", block=64).collect()
    again = mixing.mix(df, "doc_id", "text", "source", block=64).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    taken, targets, sizes = collections.Counter(), {}, collections.Counter()
    for r in got:
        s = source[(r.doc_id, r.size)]
        taken[s] += r.taken
        sizes[s] += r.size
        targets[s] = (r.target, r.source_size)
        assert 0 <= r.taken <= 2 * r.size
    names = sorted(k for k in targets if k is not None) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        unit = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * unit >= 2 * sizes[n]}
        if not over:
            break
        for n in over:
            want[n] = 2 * sizes[n]
            left -= want[n]
        free -= over
    want |= {n: weight[n] * unit for n in free}
    for n in names:
        assert targets[n] == (pytest.approx(want[n]), sizes[n])
        assert abs(taken[n] - want[n]) <= 0.5


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(empty(spark), "doc_id", "text", "source").count() == 0
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(df, "doc_id", "text", "source").collect()) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0),
    ]


def test_schedule_spreads_each_source(spark):
    plan = spark.createDataFrame(
        [("a", 6400, 1, 6400.0), ("b", 3200, 1, 1600.0), ("c", 6400, 1, 12800.0)],
        "src string, source_size long, weight int, target double",
    )
    got = sorted(mixing.slots(plan, 64).collect(), key=lambda r: r.position)
    assert collections.Counter(r.src for r in got) == {"a": 100, "b": 25, "c": 200}
    assert len({r.position for r in got}) == 325
    for share, name in ((100, "a"), (25, "b"), (200, "c")):
        for cut in (65, 130, 260):
            n = sum(r.src == name for r in got[:cut])
            assert abs(n - cut * share / 325) <= 9
    assert {r.block for r in got if r.src == "b"} == set(range(25))


def test_applied_mix_repeats_rows(spark):
    df = texts_frame(spark)
    got = mixing.apply_mix(df, "doc_id", "text", "source")
    assert got.columns == df.columns
    assert got.where("text is null or trim(text) = ''").count() == 0
    assert mixing.apply_mix(empty(spark), "doc_id", "text", "source").count() == 0


# ---- byte-level BPE


def test_byte_bpe_equals_the_library(spark):
    df = texts_frame(spark)
    ranks = byte_bpe.read_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    encoded = byte_bpe.encode(df, "text", ["doc_id", "text", "uid"], RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode(encoded, "ids", RANKS).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    none = byte_bpe.encode(empty(spark), "text", ["doc_id"], RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.decode(none, "ids", RANKS).count() == 0


def test_merge_order_of_an_odd_vocabulary(spark, tmp_path):
    """A merged pair may have a lower rank than its parts; ties go to the left."""
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"cab", b"aa", b"aaa", b"aaaa", b"caba"]
    order = pieces[:256] + [b"abc", b"bc", b"caba", b"ab", b"aaa", b"aa", b"cab", b"aaaa"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(order)))
    ranks = byte_bpe.read_ranks(path.read_bytes())
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))),) for _ in range(200)]
    got = byte_bpe.encode(spark.createDataFrame(rows, "t string"), "t", ["t"], str(path), r"\S+|\s+")
    for r in got.collect():
        assert r.ids == library.encode_ordinary(r.t), r.t


def test_long_words_are_folded_as_the_library_does():
    """Words of every length in one call, also beside the length from which a word is folded on its own."""
    ranks = byte_bpe.read_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = byte_bpe.Ranks(ranks)
    arrays = [np.array(x, np.int64) for x in (table.byte, table.offset, table.slots)]
    rng = random.Random(4)
    sizes = [1, 2, 3, 50, byte_bpe.LONG - 1, byte_bpe.LONG, byte_bpe.LONG + 1, 5000, 300_000]
    words = [bytes(rng.choice(b"abest") for _ in range(n)) for n in sizes]
    ids, n = byte_bpe.fold(words, ranks, *arrays)
    ends = np.cumsum(n)
    for word, a, b in zip(words, ends - n, ends):
        assert ids[a:b].tolist() == library._core_bpe.encode_single_piece(word)
    assert [len(x) for x in byte_bpe.fold([], ranks, *arrays)] == [0, 0]


# ---- SimHash


def test_whole_rows_are_joined_alike_at_any_size(spark):
    """Small tables too: what is broadcast at one size and sorted at the next can't be projected."""
    df = texts_frame(spark)
    for out in (simhash.keep_one(df, "doc_id", "text"), mixing.apply_mix(df, "doc_id", "text", "source")):
        plan = out._jdf.queryExecution().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def brute_print(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, radius):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_simhash_groups(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        for k in range(4):
            copy = t.split()
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 + 10 * i + k, " ".join(copy).upper()))
    odd = texts_frame(spark)
    rows += [(1000 + k if k is not None else None, t) for k, t in pairs(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    prints = [brute_print(t) for _, t in rows]
    group = groups_of(prints, 3)
    smallest = {}
    for g, (key, _) in zip(group, rows):
        smallest[g] = min((k for k in (key, smallest.get(g)) if k is not None), default=None)
    want = sorted(repr((k, p, smallest[g])) for (k, _), p, g in zip(rows, prints, group))
    got = simhash.simhash_groups(df, "doc_id", "text").collect()
    assert sorted(repr((r.doc_id, r.fingerprint % (1 << 64), r.component_id)) for r in got) == want
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns and kept.count() == len(set(group))
    assert simhash.simhash_groups(empty(spark), "doc_id", "text").count() == 0
    assert simhash.keep_one(empty(spark), "doc_id", "text").count() == 0


@pytest.mark.parametrize("radius, block", [(3, 8192), (3, 16), (0, 16), (2, 8192), (5, 16)])
def test_links_join_all_close_prints(spark, radius, block):
    """Also when buckets are split into pairs of blocks."""
    rng = random.Random(radius)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, radius + 1)):
                x ^= 1 << rng.randrange(64)
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    found = {r.node: r.component for r in components(simhash.links(df, radius, block=block)).collect()}
    group = groups_of([p % (1 << 64) for p in prints], radius)
    for i, p in enumerate(prints):
        want = min(q for q, g in zip(prints, group) if g == group[i])
        assert found.get(p, p) == want


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 300)]
    shuffled = list(range(1000, 1200))
    random.Random(2).shuffle(shuffled)
    loop = list(zip(shuffled, shuffled[1:] + shuffled[:1]))
    star = [(5000, 5000 + i) for i in range(1, 400)] + [(9000, 9000)]
    df = spark.createDataFrame(path + loop + star + star, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert set(got.values()) == {1, 1000, 5000}
    assert len(got) == 300 + 200 + 400
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- quality


def labelled(spark):
    rng = random.Random(9)
    good = lambda: "\n".join(
        " ".join(rng.choice(["the", "river", "of", "stone", "went", "by", "slowly"]) for _ in range(9)) + "."
        for _ in range(rng.randint(1, 6))
    )
    bad = lambda: "\n".join(
        rng.choice(["BUY!! NOW!! ", "x*** y### z$$$ ", "a | b | c | "]) * 6 for _ in range(rng.randint(1, 6))
    )
    rows = [(i, good() if i % 4 else bad(), int(bool(i % 4))) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_separates_held_out_rows(spark):
    df = labelled(spark)
    odd = spark.createDataFrame([(None, 1), (3, None), (10**6, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    model = quality.train(df.drop("quality"), df.select("doc_id", "quality").union(odd), "doc_id", "text", "quality")
    rows = df.select("doc_id", "quality", quality.held_out(F.col("doc_id")).alias("out"), quality.score(model, F.col("text")).alias("s"))
    rows = rows.collect()
    assert {r.out for r in rows} == {True, False}
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all((r.s >= 0.3) == bool(r.quality) for r in rows if r.out)
    texts = texts_frame(spark)
    scores = [r.s for r in texts.select(quality.score(model, F.col("text")).alias("s")).collect()]
    assert len(scores) == texts.count() and all(0 <= s <= 1 for s in scores)
    assert empty(spark).select(quality.score(model, F.col("text"))).count() == 0


def test_quality_without_labels_scores_alike(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(texts_frame(spark), none, "doc_id", "text", "quality")
    assert set(np.round(model.scores(["a\nb", "!!!", ""]), 9)) == {0.5}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    n_lines = np.array([1, 4, 2])
    score, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    good, at, pair = quality.marginals(score, n_lines, trans)
    start = 0
    for n in n_lines:
        total, one = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(score[start + i] for i in range(n) if y[i]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            one += w * np.array(y)
        assert np.allclose(good[start : start + n], one / total)
        start += n
    assert at.tolist() == [1, 2, 3, 5] and np.allclose(pair.sum((1, 2)), 1)


# ---- helpers


def test_ranked_in_groups_of_any_size(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, i int, n long")
    got = {r.i: (r["rank"], r.before_n) for r in ranked(df, ["g"], ["o", "i"], ("n",)).collect()}
    for g in ("hot", "a", None):
        at = 0
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))):
            assert got[r[2]] == (k, at)
            at += r[3]
    assert len(got) == 500
    all_ = {r.i: r["rank"] for r in ranked(df, [], ["i"]).collect()}
    assert all_ == {i: i for i in range(500)}


def test_digest_of_the_query_columns(spark):
    from rollbook.llm.queries import digests

    df = spark.createDataFrame([(1, "hello  world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in digests(byte_bpe.encode(df, "text", ["doc_id"], RANKS, public_tokenizers.PATTERN)).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"hello  world").hexdigest()
