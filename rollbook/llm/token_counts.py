"""Token counts of whole texts under a unigram model, by dynamic programming over a trie of words."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import read_bytes, small_batches

MARK = "▁"  # begins every word in the vocabulary
WORDS_HELD = 500_000  # distinct words a task remembers


def zipf_pieces(model: bytes) -> tuple[dict[str, float], float]:
    """Pieces of a public vocabulary with log-probabilities by rank (Zipf's law), and that of one raw byte.

    Nothing is trained: the rank is the place among the ordinary pieces, and a byte that no piece covers
    is as likely as the last rank.
    """
    import sentencepiece

    v = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [
        v.id_to_piece(i)
        for i in range(v.get_piece_size())
        if not (v.is_control(i) or v.is_unknown(i) or v.is_byte(i) or v.is_unused(i))
    ]
    norm = math.log(sum(1 / r for r in range(1, len(names) + 2)))
    return {n: -math.log(r) - norm for r, n in enumerate(names, 1)}, -math.log(len(names) + 1) - norm


def piece_trie(pieces: dict[str, float]) -> dict:
    """Nested dicts by character; the key "" holds the score of the piece that ends there."""
    root: dict = {}
    for piece, score in pieces.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score
    return root


def count_words(words: list[str], root: dict, byte_score: float) -> dict[str, int]:
    """Number of tokens in the best segmentation of each word; of equal ones, the shortest.

    The words form a trie. It is walked depth first, which is the order of the sorted words: the stacks
    hold the branch from the root to the present node, so a prefix that words share is scored once, and a
    word's count is read where it ends. At each node: the best score and count of its prefix, and the
    pieces that are still open there as (place in the piece trie, score and count before the piece).
    """
    counts: dict[str, int] = {}
    score, tokens, opened = [0.0], [0], [[]]
    before = ""
    for word in sorted(words):
        same, most = 0, min(len(before), len(word))
        while same < most and before[same] == word[same]:
            same += 1
        del score[same + 1 :], tokens[same + 1 :], opened[same + 1 :]
        for c in word[same:]:
            best, n = -math.inf, 0
            still = []
            base, count = score[-1], tokens[-1]
            single = False
            for node, s, k in (*opened[-1], (root, base, count)):
                node = node.get(c)
                if node is None:
                    continue
                still.append((node, s, k))
                if "" in node:
                    single = single or (s is base and node is root.get(c))
                    s, k = s + node[""], k + 1
                    if s > best or (s == best and k < n):
                        best, n = s, k
            if not single:
                raw = len(c.encode())
                s, k = base + raw * byte_score, count + raw
                if s > best or (s == best and k < n):
                    best, n = s, k
            score.append(best)
            tokens.append(n)
            opened.append(still)
        counts[word] = tokens[-1]
        before = word
    return counts


def _counted(frames, model, keep):
    import pandas as pd

    root, byte_score = model.value
    held: dict[bytes, int] = {}
    for frame in frames:
        lines = [t.encode().split() for t in frame["text"]]
        if len(held) > WORDS_HELD:
            held.clear()
        new = list(set().union(*lines).difference(held))
        if new:
            found = count_words([MARK + w.decode() for w in new], root, byte_score)
            for w in new:
                held[w] = found[MARK + w.decode()]
        get = held.__getitem__
        out = frame[keep].copy()
        out["n_words"] = pd.Series([len(line) for line in lines], index=out.index, dtype="int64")
        out["n_tokens"] = pd.Series([sum(map(get, line)) for line in lines], index=out.index, dtype="int64")
        yield out


def token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str) -> DataFrame:
    """Columns ``keep`` with ``n_words`` and ``n_tokens`` of each whole text; nothing is shuffled.

    Words are what lies between ASCII white space; each counts as its best segmentation with a word mark
    before it, by the pieces and scores of ``zipf_pieces(vocabulary)``. Null and empty texts have 0 of
    both; repeated rows are kept. Columns not in ``keep`` are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    pieces, byte_score = zipf_pieces(read_bytes(vocabulary))
    model = spark.sparkContext.broadcast((piece_trie(pieces), byte_score))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(
        *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(keep, names)],
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    schema = "".join(f"{n} string, " for n in names) + "n_words long, n_tokens long"
    out = rows.mapInPandas(lambda f: _counted(f, model, names), schema)
    back = [F.col(n).cast(kinds[c]).alias(c) for c, n in zip(keep, names)]
    return out.select(*back, "n_words", "n_tokens")
