"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lloyd, minhash, mixing, packing, prefixtrie, quality, secrets, sharding, sigtree, suffixes, warc
from .common import new_folder, table

#: Weights that the sources get in turn, and the share of all words that the mix has.
WEIGHTS, MIX, MAX_EPOCHS = [3, 1, 2], 1.5, 2.0


#: Names of the shards that op9 deals documents to.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"))
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(table(spark, sf_dir, "documents"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


#: The tokenizer's file, its end token and the window's tokens.
TOKENIZER, END_ID, WINDOW = public_tokenizers.path("word_bpe_49k.json"), 2, 4096


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, END_ID, WINDOW)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.shared_passages(table(spark, sf_dir, "documents"), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select("doc_id", F.col("start").alias("first_word"), F.col("stop").alias("end_word"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    out = warc.read_archives(spark, path)
    return out.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.similar_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, MIX, MAX_EPOCHS)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    out = langid.identify(docs.select("doc_id", "text"), docs.where(fold != 0))
    return out.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.default_forest(spark))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id"), SHARDS).select("doc_id", "slot", "shard")


#: Components, their scale, clusters, rounds and the seed of op11.
SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = lloyd.whole_vectors(table(spark, sf_dir, "embeddings"), SIZE, SCALE)
    return lloyd.report(*lloyd.cluster(vectors, SIZE, CLUSTERS, ROUNDS, SEED))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, TOKENIZER, bpe.build(docs, TOKENIZER), decode_too=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.turn_rows(table(spark, sf_dir, "conversations"))
    convs = turns.select("conv_id").distinct()
    return prefixtrie.prefix_trie(prefixtrie.shared_starts(turns, convs), convs)


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM g) WHERE k > 1),
m AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY rid),
l AS (SELECT rid, doc_id, source, trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
             len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT rid, doc_id, source, unnest(ls) AS x FROM w)),
b AS (SELECT source, line FROM l GROUP BY source, line HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN rid END) > 20),
k AS (SELECT rid, sum(n) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.line = l.line AND b.source IS NOT DISTINCT FROM l.source) GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(m.n, 0)::BIGINT AS n_repeat_words, coalesce(k.n, 0)::BIGINT AS words_left
      FROM w LEFT JOIN m USING (rid) LEFT JOIN k USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 25 AND words_left >= 0.5 * n_words AS kept FROM f
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
      2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM s),
l AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT lev FROM l WHERE lev <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.lev * weight < cap THEN f.lev * weight ELSE cap END AS target FROM l LEFT JOIN f ON true),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM c
"""


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
w1 AS (SELECT rid, doc_id, unnest(range(1, len(ws) + 1)) AS p, hash(unnest(ws)) AS h1 FROM d),
w2 AS (SELECT *, hash(h1, lead(h1) OVER w) AS h2 FROM w1 WINDOW w AS (PARTITION BY rid ORDER BY p)),
w4 AS (SELECT *, hash(h2, lead(h2, 2) OVER w) AS h4 FROM w2 WINDOW w AS (PARTITION BY rid ORDER BY p)),
w8 AS (SELECT *, hash(h4, lead(h4, 4) OVER w) AS h8 FROM w4 WINDOW w AS (PARTITION BY rid ORDER BY p)),
w16 AS (SELECT *, hash(h8, lead(h8, 8) OVER w) AS h16 FROM w8 WINDOW w AS (PARTITION BY rid ORDER BY p)),
w32 AS (SELECT *, hash(h16, lead(h16, 16) OVER w) AS h32 FROM w16 WINDOW w AS (PARTITION BY rid ORDER BY p)),
g AS (SELECT doc_id, p, hash(h32, lead(h16, 32) OVER w, lead(h2, 48) OVER w) AS h, lead(p, 49) OVER w AS e FROM w32 WINDOW w AS (PARTITION BY rid ORDER BY p)),
s AS (SELECT h FROM g WHERE e IS NOT NULL GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT DISTINCT doc_id, p FROM g SEMI JOIN s USING (h) WHERE e IS NOT NULL),
r AS (SELECT *, coalesce(p > 50 + lag(p) OVER w, true)::INT AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS passage FROM r)
SELECT doc_id, min(p)::BIGINT - 1 AS first_word, max(p)::BIGINT + 49 AS end_word FROM k GROUP BY doc_id, passage
"""

OP5_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
q AS (SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS last FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4)))::INT & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last OR last IS NULL THEN NULL ELSE last END AS refers_to FROM q
"""


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM d),
g AS (SELECT rid, n, p, hash(x, lead(x) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v) AS x FROM w WINDOW v AS (PARTITION BY rid ORDER BY p)),
t AS (SELECT DISTINCT rid, x FROM g WHERE p <= n - 3 OR n < 4 AND p = 1),
s AS (SELECT rid, count(*) AS n, hash(list(x ORDER BY x)) AS id FROM t GROUP BY rid),
c AS (SELECT id, min(rid) AS rid, min(n) AS n, min(doc_id) AS rep FROM s JOIN d USING (rid) GROUP BY id),
u AS (SELECT c.id, c.n, t.x FROM c JOIN t USING (rid)),
o AS (SELECT a.id AS u, b.id AS v FROM u a JOIN u b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM o UNION SELECT v, u FROM o),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT r.u, min(c.rep) AS rep FROM r JOIN c ON c.id = r.v GROUP BY r.u)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least(c.rep, m.rep), d.doc_id) AS component_id
FROM d LEFT JOIN s USING (rid) LEFT JOIN c ON c.id = s.id LEFT JOIN m ON m.u = s.id
"""


def op9_sql() -> str:
    """The table comes as a list, the way a broadcast brings it; test_lookup_table_equals_a_plain_fill says how it is filled."""
    table = sharding.lookup_table(SHARDS)
    return f"""
WITH t AS (SELECT [{",".join(map(str, table))}] AS owner),
d AS (SELECT doc_id, ((('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT) % {sharding.SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 3, '0') AS shard FROM d, t
"""


#: crc32 of a conversation's number, bit by bit, over the bytes of its decimal digits.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP13_SQL = rf"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {CRC32} % 4 AS h, conv_id - conv_id % 20 AS src FROM (SELECT DISTINCT conv_id FROM t)),
l AS (SELECT c.conv_id, t.p, 0 AS own, t.role, t.text FROM c JOIN t ON t.conv_id = c.src WHERE t.p <= c.h
      UNION ALL SELECT c.conv_id, t.p, 1, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.p > c.h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM l),
q AS (SELECT conv_id, d, words, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT d, prefix, min(conv_id) AS node, count(*) AS n_convs, min(words) AS words FROM q GROUP BY d, prefix),
m AS (SELECT q.conv_id, d, node FROM q JOIN n USING (d, prefix)),
k AS (SELECT n.node, n.d, n_convs, (n_convs - 1) * words AS own, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
w AS (SELECT k.*, (SELECT count(*) FROM k AS j WHERE j.parent = k.node AND j.d = k.d + 1) AS n_children FROM k),
u AS (SELECT m.node, m.d, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM w JOIN m ON m.conv_id = w.node AND m.d <= w.d GROUP BY m.node, m.d),
e AS (SELECT m.node, m.d, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids
      FROM m JOIN (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id) USING (conv_id, d) GROUP BY m.node, m.d)
SELECT w.node AS conv_id, w.d::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN u USING (node, d) LEFT JOIN e USING (node, d)
"""


def op11_sql() -> str:
    """Every round compares every vector with every centroid."""
    parts = [rf"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v FROM (SELECT v, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h LIMIT {CLUSTERS}))"""]
    for r in range(ROUNDS + 1):
        parts.append(rf"""
a{r} AS (SELECT rid, min_by(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.rid, c{r}.c, list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (v.v[i] - c{r}.v[i]) * (v.v[i] - c{r}.v[i])))::BIGINT AS d FROM v, c{r}) GROUP BY rid)""")
        if r < ROUNDS:
            parts.append(rf"""
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(range({SIZE})) AS i, unnest(v.v) AS x FROM a{r} AS a JOIN v USING (rid)) GROUP BY c, i) GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",".join(parts) + rf"""
SELECT vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (rid) JOIN c{ROUNDS} AS k ON k.c = a.c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_fingerprints": op2_fingerprints,
        "op3_packing": op3_packing,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_warc": op5_warc,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_mixing": op7_mixing,
        "op8_language_id": op8_language_id,
        "op9_sharding": op9_sharding,
        "op10_secret_scan": op10_secret_scan,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_bpe_codec": op12_bpe_codec,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op4_suffix_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_mixing": OP7_SQL, "op9_sharding": op9_sql(), "op11_centroid_clusters": op11_sql(), "op13_prefix_trie": OP13_SQL}
