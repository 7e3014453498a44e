"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import ann, byte_bpe, embedding_dedup, mixing, quality, quotations, repair, simhash
from rollbook.llm import suffix_dedup, token_counts, token_files, warc, whitening

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END = 2
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"], PIECES)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, frequencies = token_files.write_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS, END)
    return token_files.read_tokens(blocks, frequencies).select(
        F.col("key").alias("doc_id"),
        "start",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of encoded documents, from their ids and what these decode to."""
    decoded = byte_bpe.decode(encoded, "ids", RANKS)
    return decoded.select(
        *[c for c in encoded.columns if c != "ids"],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(byte_bpe.id_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(byte_bpe.encode(docs, "text", ["doc_id"], RANKS, public_tokenizers.PATTERN))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read_archives(index).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, radius=3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    scored = docs.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.damaged_and_repaired(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=4)
    return whitened.withColumnRenamed("key", "vec_id")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", window=400)
    return found.select(
        F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_embedding_near_dedup,
        op3_nearest_neighbours,
        op4_token_files,
        op5_source_mix,
        op6_byte_bpe,
        op7_warc,
        op8_simhash_near_dedup,
        op9_quotation_threads,
        op10_quality,
        op11_conversation_repair,
        op12_embedding_whitening,
        op13_suffix_dedup,
    )
}

OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
    SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v
    WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
      AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
), reach AS (
    SELECT a AS node, b AS other FROM links
    UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), out AS (
    SELECT vec_id,
        (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
        least(vec_id, coalesce((SELECT min(other) FROM reach WHERE node = vec_id), vec_id)) AS component_id
    FROM embeddings
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM out
"""

OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight,
        source_size * 2 AS cap
    FROM s
), f AS (
    SELECT *, cap::DOUBLE / weight AS ratio,
        1.5 * (SELECT sum(source_size) FROM w)::DOUBLE AS words, (SELECT sum(weight) FROM w) AS all_weight
    FROM w
), l AS (
    SELECT *, ratio <= (words - coalesce(sum(cap) OVER o, 0)::DOUBLE)
            / (all_weight - coalesce(sum(weight) OVER o, 0))::DOUBLE AS stopped
    FROM f
    WINDOW o AS (ORDER BY ratio, coalesce('s' || source, 'n') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size,
        CASE WHEN stopped THEN cap::DOUBLE ELSE weight * (
            (words - coalesce((SELECT sum(cap) FROM l WHERE stopped), 0)::DOUBLE)
            / (SELECT sum(weight) FROM l WHERE NOT stopped)::DOUBLE) END AS target
    FROM l
), line AS (
    SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS due,
        CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || doc_id) NULLS LAST, doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
    CASE WHEN size = 0 THEN 0 ELSE CAST((due // source_size) * size
        + greatest(0, least(size, due % source_size - begins)) AS BIGINT) END AS taken
FROM line
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT >> {35 - 5 * j}) & 31 AS BIGINT) + 1, 1)"
    for i in range(4)
    for j in range(8)
)
OP7_SQL = f"""
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
        sha1(coalesce(html, '')) AS h
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP9_SQL = r"""
WITH RECURSIVE m AS (
    SELECT conv_id AS c, turn AS t, role AS r, coalesce(text, '') AS text, row_number() OVER () AS uid
    FROM conversations
), p AS (
    SELECT *, coalesce('c' || c, 'u' || uid) AS k,
        row_number() OVER (PARTITION BY coalesce('c' || c, 'u' || uid) ORDER BY t NULLS LAST, uid) - 1 AS position
    FROM m
), raw AS (
    SELECT k, position, uid, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS n
    FROM p
), lines AS (
    SELECT k, position, uid, n, regexp_replace(line, '^((?:[ \t]*>)+)', '') AS line,
        length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[ \t]', '', 'g')) AS level
    FROM raw
), marked AS (
    SELECT *, CAST(coalesce(level <> lag(level) OVER (PARTITION BY uid ORDER BY n), true) AS INT) AS changed FROM lines
), runs AS (
    SELECT *, sum(changed) OVER (PARTITION BY uid ORDER BY n) AS run FROM marked
), both_kinds AS (
    SELECT k, position, uid, level, line FROM runs
    UNION ALL
    SELECT k, position, uid, level, string_agg(line, ' ' ORDER BY n) FROM runs GROUP BY k, position, uid, run, level
), passages AS (
    SELECT * FROM (
        SELECT k, position, uid, level, trim(regexp_replace(lower(line), '[ \t\r\n]+', ' ', 'g')) AS passage
        FROM both_kinds
    ) WHERE passage <> ''
), said AS (
    SELECT k, passage, min(position) AS dest FROM passages WHERE level = 0 GROUP BY k, passage
), linked AS (
    SELECT q.uid, max({'a': -q.level, 'b': length(q.passage), 'c': s.dest}).c AS dest
    FROM passages q JOIN said s ON q.k = s.k AND q.passage = s.passage
    WHERE q.level > 0 AND s.dest < q.position GROUP BY q.uid
), answers AS (
    SELECT p.*, l.dest IS NOT NULL AS by_quote,
        coalesce(l.dest, CASE WHEN p.position > 0 THEN p.position - 1 END) AS dest
    FROM p LEFT JOIN linked l USING (uid)
), opened AS (
    SELECT *, CAST(coalesce(dest <> position - 1, true) AS INT) AS opens FROM answers
), numbered AS (
    SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY position) AS run FROM opened
), heads AS (
    SELECT h.k, h.run, a.run AS above,
        lpad(hex((1::BIGINT << 60) - coalesce(h.dest, 0)), 16, '0') || lpad(hex(h.position), 16, '0') AS step
    FROM numbered h LEFT JOIN numbered a ON h.k = a.k AND h.dest = a.position
    WHERE h.opens = 1
), paths AS (
    SELECT k, run, step AS path FROM heads WHERE above IS NULL
    UNION ALL
    SELECT h.k, h.run, p.path || h.step FROM heads h JOIN paths p ON h.k = p.k AND h.above = p.run
), ordered AS (
    SELECT n.*, row_number() OVER (PARTITION BY n.k ORDER BY path, n.position) - 1 AS reply_order,
        array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)) AS body
    FROM numbered n JOIN paths USING (k, run)
)
SELECT o.c AS conv_id, o.t AS turn, o.r AS role, s.t AS reply_to, o.by_quote, o.reply_order, o.body,
    '<|' || coalesce(o.r, 'user') || '|>' || chr(10) || o.body || chr(10) AS chat
FROM ordered o LEFT JOIN p s ON o.k = s.k AND o.dest = s.position
"""

OP11_SQL = r"""
WITH RECURSIVE bits AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), said AS (
    SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id
    FROM conversations
), fated AS (
    SELECT said.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
    FROM said, bits
), damaged AS (
    SELECT c, t, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
    FROM fated WHERE fate <> 0
), seen AS (
    SELECT *, coalesce('c' || c, 'n') AS k, row_number() OVER o AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged WINDOW o AS (PARTITION BY c ORDER BY t NULLS FIRST, role, text, copy)
), r AS (
    SELECT k, c, t, role, text, i, body = '' AS blank,
        body <> '' AND row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
        right(body, 1) NOT IN ('.', '!', '?') AS unended, count(*) OVER (PARTITION BY k) AS n,
        CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS x,
        lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) AS pair
    FROM seen
), f AS (
    SELECT *, blank OR again AS drops, CASE WHEN unended AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra FROM r
), best AS (
    SELECT k, n + 1 AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM (SELECT DISTINCT k, n FROM f)
    UNION ALL
    SELECT k, i, least(w0, w2 + 3, w3 + 6), least(w1, w2 + 3, w3 + 6), least(w2, w3 + 3), least(w3, w2 + 3) FROM (
        SELECT f.k, f.i,
            least(v0 + 4, CASE WHEN drops THEN 1000000 ELSE extra + least(v2 + 3, CASE x WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE 1000000 END) END) AS w0,
            least(v1 + 4, CASE WHEN drops THEN 1000000 ELSE extra + least(v2 + 3, CASE x WHEN 2 THEN v2 ELSE 1000000 END) END) AS w1,
            least(v2 + 4, CASE WHEN drops THEN 1000000 ELSE extra + least(v3 + 3, CASE x WHEN 3 THEN v3 ELSE 1000000 END) END) AS w2,
            least(v3 + 4, CASE WHEN drops THEN 1000000 ELSE extra + least(v2 + 3, CASE x WHEN 2 THEN v2 ELSE 1000000 END) END) AS w3
        FROM best JOIN f ON f.k = best.k AND f.i = best.i - 1)
), costs AS (
    SELECT k, i, [v0, v1, v2, v3] AS v FROM best
), walk AS (
    SELECT k, 1::BIGINT AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM costs WHERE i = 1
    UNION ALL
    SELECT k, i + CAST(e <> 'I' AS BIGINT), CASE e WHEN 'D' THEN s WHEN 'K' THEN x ELSE due END, audit || e,
        CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, named || ':')
            WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, named || ':' || text) END
    FROM (
        SELECT w.*, f.role, f.text, f.x, due, CASE due WHEN 2 THEN 'user' ELSE 'assistant' END AS named,
            CASE WHEN f.k IS NOT NULL AND a.v[s + 1] + 4 = h.v[s + 1] THEN 'D'
                WHEN h.v[due + 1] + 3 = h.v[s + 1] THEN 'I'
                WHEN f.k IS NOT NULL AND NOT drops AND ((s = 0 AND x IN (1, 2)) OR (s IN (1, 3) AND x = 2) OR (s = 2 AND x = 3))
                    AND a.v[x + 1] + extra = h.v[s + 1] THEN 'K'
                WHEN f.k IS NOT NULL AND NOT drops AND a.v[due + 1] + 3 + extra = h.v[s + 1] THEN 'R' END AS e
        FROM (SELECT *, CASE s WHEN 2 THEN 3 ELSE 2 END AS due FROM walk) w
        JOIN costs h ON h.k = w.k AND h.i = w.i
        LEFT JOIN f ON f.k = w.k AND f.i = w.i
        LEFT JOIN costs a ON a.k = w.k AND a.i = w.i + 1
    ) WHERE e IS NOT NULL
), ends AS (
    SELECT k, max_by(audit, length(audit)) AS audit, max_by(lines, length(audit)) AS lines FROM walk GROUP BY k
), counts AS (
    SELECT k, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
        count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE extra > 0) AS truncated,
        count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY k
), ids AS (
    SELECT DISTINCT conv_id, coalesce('c' || conv_id, 'n') AS k FROM conversations
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(costs.v[1], 0) AS BIGINT) AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (k) LEFT JOIN costs ON costs.k = ids.k AND costs.i = 1 LEFT JOIN ends ON ends.k = ids.k
"""

OP13_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
    SELECT *, length(h) // 2 AS n_bytes FROM d
), w AS (
    SELECT r, p, hash(substr(h, CAST(2 * p + 1 AS BIGINT), 800)) AS k
    FROM (SELECT r, h, unnest(range(n_bytes - 399)) AS p FROM b WHERE n_bytes >= 400)
), again AS (
    SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), runs AS (
    SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY p) AS run
    FROM (SELECT *, CAST(coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS INT) AS opens FROM again)
), spans AS (
    SELECT r, run, min(p) AS lo, max(p) + 400 AS hi FROM runs GROUP BY r, run
), edges AS (
    SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM spans
), cut AS (
    SELECT e.r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
        string_agg(substr(b.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) AS kept
    FROM edges e JOIN b ON e.r = b.r GROUP BY e.r
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN cut.r IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM b LEFT JOIN cut ON b.r = cut.r
"""

ORACLE_SQL = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op5_source_mix": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op9_quotation_threads": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
