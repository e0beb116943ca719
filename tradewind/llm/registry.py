"""The queries of this package over the given tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.conversations import repair_conversations
from tradewind.llm.decontaminate import decontaminate
from tradewind.llm.exact_dedup import exact_dedup
from tradewind.llm.licenses import license_scan
from tradewind.llm.line_dedup import line_dedup
from tradewind.llm.mixing import mix_sources
from tradewind.llm.negatives import hard_negatives
from tradewind.llm.quality import quality_scores
from tradewind.llm.quality_rules import quality_rules
from tradewind.llm.sharding import shard_evenly
from tradewind.llm.simhash import simhash_dedup
from tradewind.llm.substring_dedup import substring_dedup
from tradewind.llm.suffix_dedup import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"), window=200)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_simhash(spark, sf_dir):
    out = simhash_dedup(table(spark, sf_dir, "documents"), shingle=3)
    return out.select("doc_id", "fingerprint", "component_id")


def op3_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_line_dedup(spark, sf_dir):
    """Lines on 8 or more of the sources go."""
    out = line_dedup(table(spark, sf_dir, "documents"), threshold=8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_sharding(spark, sf_dir):
    out = shard_evenly(table(spark, sf_dir, "documents"), shards=40)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_exact_dedup(spark, sf_dir):
    out = exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return out.withColumnRenamed("content_hash", "text_sha256")


def op8_mixing(spark, sf_dir):
    out = mix_sources(table(spark, sf_dir, "documents")).taken()
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_decontaminate(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def damaged(rows):
    """The conversations as the contract damages them; ``lives`` is false for the rows that are dropped."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", "role", text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("damage"))
    damage = F.col("damage")
    return rows.select(
        "conv_id",
        "turn",
        F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (damage != 0).alias("lives"),
        F.explode(F.when(damage == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def op11_conversation_repair(spark, sf_dir):
    rows = damaged(table(spark, sf_dir, "conversations"))
    out = repair_conversations(rows.where("lives")).report()
    out = out.select(F.col("conversation").alias("conv_id"), *out.columns[1:-1], F.sha2("repaired", 256).alias("repaired_sha256"))
    gone = rows.groupBy("conv_id").agg(F.max("lives").alias("lives")).where("not lives").select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in out.columns[1:7]], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")
    )
    return out.unionByName(gone)


def op12_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, anchors=F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_simhash, op3_substring_dedup, op4_license_scan, op5_line_dedup, op6_sharding, op7_exact_dedup,
        op8_mixing, op9_decontaminate, op10_quality, op11_conversation_repair, op12_quality_rules, op13_hard_negatives,
    )
}

ORACLE = {
    "op1_suffix_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
place AS (
  SELECT doc_id, i, substr(x, 2 * i - 1, 2) AS byte, CASE WHEN 2 * (i + 199) <= length(x) THEN md5(substr(x, 2 * i - 1, 400)) END AS h
  FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 + 1)) AS i FROM b)),
twice AS (SELECT h FROM place WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT doc_id, i, byte,
         count(t.h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM place LEFT JOIN twice t ON place.h = t.h),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM covered)
SELECT b.doc_id, CAST(length(any_value(x)) // 2 AS BIGINT) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed,
       count(*) FILTER (WHERE begins) AS n_spans,
       sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM b LEFT JOIN edge e ON b.doc_id = e.doc_id
GROUP BY b.doc_id
""",
    "op3_substring_dedup": r"""
WITH n AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
place AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i + 34], ' ')) END AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM n)),
twice AS (SELECT h FROM place WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT doc_id, i, word,
         count(t.h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM place LEFT JOIN twice t ON place.h = t.h)
SELECT n.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM n LEFT JOIN covered c ON n.doc_id = c.doc_id
GROUP BY n.doc_id
""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
common AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= 8)
SELECT doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY place) FILTER (WHERE c.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common c ON l.line = c.line
GROUP BY doc_id
""",
    "op9_decontaminate": r"""
WITH norm AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM norm, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, win.k FROM place JOIN win ON place.words = win.words AND place.k = win.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM norm LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
""",
    "op11_conversation_repair": r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ord(key[i]) AS BIGINT))),
         lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
         lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS damage
  FROM said),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM crc WHERE damage <> 0),
placed AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS c, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy) AS i
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS own,
         lag(role) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY c),
one(own, s, letter, t, price, becomes) AS (
  VALUES ('s', 0, 'K', 1, 0, NULL), ('u', 0, 'K', 2, 0, NULL), ('u', 1, 'K', 2, 0, NULL), ('u', 3, 'K', 2, 0, NULL), ('a', 2, 'K', 3, 0, NULL),
         ('*', 0, 'R', 2, 1, 'user'), ('*', 1, 'R', 2, 1, 'user'), ('*', 3, 'R', 2, 1, 'user'), ('*', 2, 'R', 3, 1, 'assistant'),
         ('*', 0, 'D', 0, 2, NULL), ('*', 1, 'D', 1, 2, NULL), ('*', 2, 'D', 2, 2, NULL), ('*', 3, 'D', 3, 2, NULL)),
ins(s, t, said) AS (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (3, 2, 'user:'), (2, 3, 'assistant:')),
edge AS (
  SELECT own, s, letter, letter AS letters, t, price, becomes, CAST(NULL AS VARCHAR) AS inserted FROM one
  UNION ALL
  SELECT own, ins.s, letter, 'I' || letter, one.t, price + 5, becomes, said FROM one JOIN ins ON ins.t = one.s),
best AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counts
  UNION ALL
  SELECT c, i, state, cost, audit, lines FROM (
    SELECT b.c, b.i + 1 AS i, e.t AS state,
           b.cost + e.price + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END AS cost, b.audit || e.letters AS audit,
           list_concat(b.lines, list_concat(CASE WHEN e.inserted IS NULL THEN [] ELSE [e.inserted] END,
             CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.becomes, f.role) || ':' || f.text] END)) AS lines
    FROM best b JOIN faults f ON f.c = b.c AND f.i = b.i + 1
    JOIN edge e ON e.s = b.state AND (e.own = '*' OR e.own = f.own) AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1),
ending(s, letters, price, said) AS (
  VALUES (0, '', 0, CAST([] AS VARCHAR[])), (3, '', 0, []), (2, 'I', 5, ['assistant:']), (1, 'II', 10, ['user:', 'assistant:'])),
done AS (
  SELECT b.c, b.cost + e.price AS cost, b.audit || e.letters AS audit, list_concat(b.lines, e.said) AS lines
  FROM best b JOIN counts n ON n.c = b.c AND n.n = b.i JOIN ending e ON e.s = b.state
  QUALIFY row_number() OVER (PARTITION BY b.c ORDER BY b.cost + e.price, b.audit || e.letters) = 1)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS c FROM conversations) k LEFT JOIN counts n ON n.c = k.c LEFT JOIN done d ON d.c = k.c
""",
    "op13_hard_negatives": r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN pair n ON p.anchor_id = n.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
}
