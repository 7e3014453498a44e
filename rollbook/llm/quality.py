"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import small_batches

SAMPLE_DOCS = 4000  # labelled documents the model is fitted on, at most
SAMPLE_LINES = 200_000  # and their lines, at most; bounds what the driver holds
RULES = 12
CLASSES = ("upper", "letter", "digit", "mark", "stop", "bar", "bang", "bracket")


def _byte_classes():
    import numpy as np

    table = np.zeros((len(CLASSES), 256), bool)
    table[0, 65:91] = True
    table[1, 65:91] = table[1, 97:123] = table[1, 128:] = True
    table[2, 48:58] = True
    for b in b"#*$%&@^~_=+\\/":
        table[3, b] = True
    for b in b".,;:?":
        table[4, b] = True
    table[5, ord("|")] = True
    table[6, ord("!")] = True
    for b in b"<>{}[]()":
        table[7, b] = True
    return table


def line_features(texts: list[str]):
    """Features of every line of the texts: (matrix, length of each line, number of lines of each text).

    Computed for all bytes of a batch at once. A text without line feeds is one line, also an empty one.
    """
    import numpy as np

    data = [t.encode() for t in texts]
    flat = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    n_lines = np.array([d.count(b"\n") + 1 for d in data])
    size = np.maximum(1, length)

    table = _byte_classes()
    sums = np.array([np.add.reduceat(row[flat], starts, dtype=np.int64) for row in table])
    upper, letter, digit, mark, stop, bar, bang, bracket = sums

    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    last = np.flatnonzero(~blank & np.r_[blank[1:], True])
    of = np.searchsorted(ends, first)
    words = np.bincount(of, minlength=len(ends))
    n = np.maximum(1, words)

    def per_line(flag):
        return np.bincount(of, weights=flag, minlength=len(ends)) / n

    if len(first):
        width = last - first + 1
        # a word's number depends on its letters and their places
        place = np.arange(len(flat), dtype=np.uint64)
        mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        inner = place - np.repeat(place[first], np.diff(np.r_[first, len(flat)])) if first[0] == 0 else None
        if inner is None:
            inner = place - np.r_[np.zeros(first[0], np.uint64), np.repeat(place[first], np.diff(np.r_[first, len(flat)]))]
        mixed *= (inner + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) | np.uint64(1)
        mixed[blank] = 0
        code = np.add.reduceat(mixed, first)
        again = np.r_[False, (code[1:] == code[:-1]) & (of[1:] == of[:-1])]
        in_line = code ^ (of.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        order = np.argsort(in_line, kind="stable")
        repeated = np.zeros(len(first), bool)
        repeated[order[1:]] = in_line[order[1:]] == in_line[order[:-1]]
        total_upper = np.r_[0, np.cumsum(table[0][flat])]
        total_letter = np.r_[0, np.cumsum(table[1][flat])]
        caps = total_upper[last + 1] - total_upper[first]
        letters = total_letter[last + 1] - total_letter[first]
        shouted = (caps == letters) & (letters > 1)
        symbol_end = (table[3] | table[6] | table[5])[flat[last]]
        long_word = width > 20
        line_code = np.bincount(of, weights=(code >> np.uint64(12)).astype(np.float64), minlength=len(ends))
        average = np.bincount(of, weights=width, minlength=len(ends)) / n
        again, repeated, shouted, symbol_end, long_word = map(
            per_line, (again, repeated, shouted, symbol_end, long_word)
        )
    else:
        line_code = average = again = repeated = shouted = symbol_end = long_word = np.zeros(len(ends))
    doc = np.repeat(np.arange(len(data)), n_lines)
    order = np.lexsort((line_code, doc))
    same = np.zeros(len(ends), bool)
    same[order[1:]] = (line_code[order[1:]] == line_code[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    same &= words > 0
    end_stop = np.where(length > 0, table[4][flat[np.maximum(0, ends - 1)]], False)
    parts = [
        np.log1p(length) / 8,
        np.log1p(words) / 6,
        upper / np.maximum(1, letter),
        letter / size,
        digit / size,
        mark / size,
        stop / n,
        bar / n,
        bang / n,
        bracket / size,
        average / 10,
        again,
        repeated,
        shouted,
        symbol_end,
        long_word,
        same,
        end_stop,
        words == 0,
        words < 4,
        again > 0.3,
        repeated > 0.5,
        shouted > 0.4,
        symbol_end > 0.3,
        bar / n > 0.25,
        bang / n > 0.3,
        digit / size > 0.2,
        mark / size > 0.05,
    ]
    return np.column_stack(parts).astype(np.float32), length, n_lines


def with_neighbours(x, n_lines):
    """Each line's features, those of the lines before and after in its text (0 outside), and a constant."""
    import numpy as np

    last = np.cumsum(n_lines)
    first = last - n_lines
    before = np.vstack([np.zeros((1, x.shape[1]), x.dtype), x[:-1]])
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]), x.dtype)])
    before[first] = 0
    after[last - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


def marginals(score, n_lines, trans):
    """Forward-backward over all texts at once, longest first: P(good) of each line, and of each pair.

    ``score`` is the weight of label 1 of each line, ``trans[a, b]`` that of a step from a to b. Pairs are
    (lines - 1 of each text) x 2 x 2, with the position of each pair's first line.
    """
    import numpy as np

    order = np.argsort(-n_lines, kind="stable")
    start = (np.cumsum(n_lines) - n_lines)[order]
    count = n_lines[order]
    node = np.column_stack([np.zeros(len(score)), score])
    forward = np.empty_like(node)
    backward = np.zeros_like(node)
    forward[start] = node[start]
    live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1), "right")
    for t in range(1, int(count[0])):
        at = start[: live[t]] + t
        before = forward[at - 1]
        for b in (0, 1):
            forward[at, b] = np.logaddexp(before[:, 0] + trans[0, b], before[:, 1] + trans[1, b]) + node[at, b]
    for t in range(int(count[0]) - 1, 0, -1):
        at = start[: live[t]] + t
        after = backward[at] + node[at]
        for a in (0, 1):
            backward[at - 1, a] = np.logaddexp(after[:, 0] + trans[a, 0], after[:, 1] + trans[a, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(score), bool)
    inner[np.cumsum(n_lines) - 1] = False
    at = np.flatnonzero(inner)
    after = backward[at + 1] + node[at + 1]
    pair = np.exp(forward[at][:, :, None] + trans[None] + after[:, None, :] - total[at][:, None, None])
    return good, at, pair


@dataclass(frozen=True)
class Model:
    mean: object
    spread: object
    weights: object
    trans: object

    def scores(self, texts: list[str]):
        """Length-weighted mean of the lines' P(good); of an empty text, its empty lines' plain mean."""
        import numpy as np

        if not texts:
            return np.zeros(0)
        x, length, n_lines = line_features(texts)
        x = with_neighbours((x - self.mean) / self.spread, n_lines)
        good, _, _ = marginals(x @ self.weights, n_lines, self.trans)
        first = np.cumsum(n_lines) - n_lines
        weight = length + np.repeat(np.add.reduceat(length, first) == 0, n_lines)
        return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)


def fit(features, n_lines, labels, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by Adam; a text's label is that of its lines, and each text counts alike."""
    import numpy as np

    x = np.asarray(features, dtype=np.float64)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = with_neighbours((x - mean) / spread, n_lines)
    y = np.repeat(np.asarray(labels, float), n_lines)
    weight = np.repeat(1 / n_lines, n_lines) / len(n_lines)
    yi = y.astype(int)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        trans = theta[-4:].reshape(2, 2)
        good, at, pair = marginals(x @ theta[:-4], n_lines, trans)
        grad = np.r_[x.T @ (weight * (good - y)), np.zeros(4)]
        expected = (pair * weight[at][:, None, None]).sum(0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (yi[at], yi[at + 1]), weight[at])
        grad[-4:] = (expected - seen).ravel()
        grad += ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, spread, theta[:-4], theta[-4:].reshape(2, 2))


def held_out(key: Column) -> Column:
    """Rows kept from training: crc32 of the key as text divisible by 5. Without a key: false."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
    most_docs: int = SAMPLE_DOCS, most_lines: int = SAMPLE_LINES,
) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out, chosen by a hash of the key.

    Features are computed where the texts are; the driver gets at most ``most_docs`` documents of together
    at most ``most_lines`` lines. Without labels of both kinds the model scores all texts alike.
    """
    import numpy as np

    small_batches(docs.sparkSession)
    known = labels.select(F.col(key).alias("_of"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_of").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_of")))
    known = known.groupBy("_of").agg(F.max("_label").alias("_label"))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    here = texts.select("_key").distinct().join(known, F.col("_key") == F.col("_of"))
    some = here.select("_of", "_label").orderBy(F.xxhash64(F.lit("fit"), "_of"), "_of").limit(most_docs)
    rows = texts.join(F.broadcast(some), F.col("_key") == F.col("_of"))  # at most most_docs keys

    def described(frames):
        for frame in frames:
            out = []
            for i, t, y in zip(frame["_of"], frame["_text"], frame["_label"]):
                x, _, n = line_features([t])
                if n[0] <= most_lines // 20:  # one text is not most of the sample
                    out.append((i, x.tobytes(), int(n[0]), y))
            yield pd.DataFrame(out, columns=["key", "x", "n", "y"])

    found = rows.select("_of", "_text", "_label").mapInPandas(described, "key long, x binary, n int, y int")
    order = F.xxhash64(F.lit("fit"), "key")
    from pyspark.sql import Window

    so_far = F.sum("n").over(Window.orderBy(order, "key", "x").rowsBetween(Window.unboundedPreceding, 0))
    found = found.dropDuplicates(["key"]).withColumn("_lines", so_far).where(F.col("_lines") <= most_lines)
    held = found.orderBy(order, "key").collect()  # bounded by the two limits
    width = line_features([""])[0].shape[1]
    if len({r["y"] for r in held}) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(3 * width + 1), np.zeros((2, 2)))
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in held])
    return fit(x, np.array([r["n"] for r in held]), [r["y"] for r in held])


def score(model: Model, text: Column) -> Column:
    """Quality column (0 to 1) of whole texts; null counts as empty."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    return of(F.coalesce(text, F.lit("")))
