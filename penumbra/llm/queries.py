"""The training-data queries: each applies an operator to its whole table, with production parameters; and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm import chat, decontam, lattice_lm, line_dedup, merkle, mixing, multi_index, near_dedup, prefix_trie, quality, token_output, toxicity, winnow
from penumbra.llm.common import shared_folder


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_output.read_token_digests(spark, path)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "block", "slot", "position", "in_mix")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    made = chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = merkle.manifest(table(spark, sf_dir, "documents"), F.when(odd, F.translate("text", "\n", "")).otherwise(F.col("text")))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base=c - c % 5, head=F.crc32(c.cast("string").cast("binary")) % 9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_token_output, op3_mixing, op4_line_dedup, op5_chat_format, op6_quality, op7_lattice_lm, op8_winnowing, op9_decontamination, op10_toxicity,
        op11_multi_index, op12_merkle, op13_prefix_trie,
    )
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned CRC-32 of an integer's decimal digits, bit by bit.
CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda acc, b:
    list_reduce([CAST(0 AS BIGINT) FOR i IN range(8)], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b)), CAST(4294967295 AS BIGINT)))"""
FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(least.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
""",
    "op3_mixing": f"""
WITH RECURSIVE ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS lane,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), doc_id) - 1 AS r FROM documents
), sized AS (SELECT lane, count(*) AS n FROM ranked GROUP BY lane
), lanes AS (
  SELECT lane, n, CAST(greatest(1, round({mixing.STEPS} * power(n / max(n) OVER (), {mixing.POWER}))) AS BIGINT) AS weight FROM sized
), listed AS (
  SELECT list(lane ORDER BY lane) AS names, list(weight ORDER BY lane) AS weights, CAST(sum(weight) AS BIGINT) AS total FROM lanes
), slots(slot, done, i, k) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(weights, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM listed
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(done) + 1), lambda j: done[j] + CASE WHEN j = best THEN 1 ELSE 0 END), best, done[best] FROM (
    SELECT slot, done, list_sort(list_transform(list_filter(range(1, len(names) + 1), lambda j: done[j] * total // weights[j] <= slot + 1),
                                                lambda j: [((done[j] + 1) * total + weights[j] - 1) // weights[j], j]))[1][2] AS best
    FROM slots, listed WHERE slot + 1 < total)
), period AS (
  SELECT names[i] AS lane, slot, k, l.weight, total, l.n FROM slots, listed JOIN lanes l ON l.lane = names[i] WHERE slot >= 0
), blocks AS (SELECT *, (n + 15) // 16 AS blocks FROM period
), ends AS (SELECT min(blocks // weight * total + slot) AS stop FROM blocks WHERE k = blocks % weight)
SELECT doc_id, source, r // 16 AS block, r // 16 // weight * total + slot AS slot,
       (r // 16 // weight * total + slot) * 16 + r % 16 AS position, r // 16 // weight * total + slot < stop AS in_mix
FROM ranked JOIN period p ON p.lane = ranked.lane AND p.k = r // 16 % p.weight, ends
""",
    "op4_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS body,
         length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + CASE WHEN before IS NOT NULL AND before = role THEN 3 ELSE head + 6 + 8 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
    "op12_merkle": f"""
WITH RECURSIVE doc AS (
  SELECT *, CASE WHEN {CRC.format("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS lane FROM documents
), hashed AS (
  SELECT doc_id, lane, sha256({" || ".join(FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars"))} || {FIELD.format("text")}) AS leaf,
         sha256({" || ".join(FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars"))} || {FIELD.format("altered")}) AS folded FROM doc
), leaf AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM hashed
), up AS (
  SELECT lane, 0 AS level, r AS i, leaf AS hash, count(*) OVER (PARTITION BY lane) AS n FROM leaf
  UNION ALL SELECT lane, level + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY lane, level, i // 3
), tops AS (SELECT lane, hash AS subroot, level AS height, row_number() OVER (ORDER BY lane) - 1 AS r FROM up WHERE n = 1
), over AS (
  SELECT 0 AS level, r AS i, subroot AS hash, count(*) OVER () AS n FROM tops
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), any_value((n + 2) // 3) FROM over WHERE n > 1 GROUP BY level, i // 3
), below AS (
  SELECT l.lane, l.r, u.level AS step, u.hash, u.i, l.r // CAST(round(power(3, u.level)) AS BIGINT) AS own
  FROM leaf l JOIN up u ON u.lane = l.lane AND u.n > 1 AND u.i // 3 = l.r // CAST(round(power(3, u.level + 1)) AS BIGINT)
), above AS (
  SELECT l.lane, l.r, t.height + o.level AS step, o.hash, o.i, t.r // CAST(round(power(3, o.level)) AS BIGINT) AS own
  FROM leaf l JOIN tops t ON t.lane = l.lane JOIN over o ON o.n > 1 AND o.i // 3 = t.r // CAST(round(power(3, o.level + 1)) AS BIGINT)
), way AS (
  SELECT lane, r, step, coalesce(string_agg(hash, '' ORDER BY i) FILTER (i < own), '') AS before, coalesce(string_agg(hash, '' ORDER BY i) FILTER (i > own), '') AS behind
  FROM (SELECT * FROM below UNION ALL SELECT * FROM above) GROUP BY lane, r, step
), fold(lane, r, step, hash) AS (
  SELECT lane, r, CAST(0 AS BIGINT), folded FROM leaf
  UNION ALL SELECT f.lane, f.r, f.step + 1, sha256(w.before || f.hash || w.behind) FROM fold f JOIN way w ON w.lane = f.lane AND w.r = f.r AND w.step = f.step
), proof AS (SELECT lane, r, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256, max(step) + 1 AS steps FROM way GROUP BY lane, r
), root AS (SELECT hash AS root FROM over WHERE n = 1)
SELECT l.doc_id, l.leaf, t.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = root AS verified
FROM leaf l JOIN tops t ON t.lane = l.lane LEFT JOIN proof p ON p.lane = l.lane AND p.r = l.r
     JOIN fold f ON f.lane = l.lane AND f.r = l.r AND f.step = coalesce(p.steps, 0), root
""",
    "op13_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), ids AS (SELECT c, {CRC.format("c")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)
), made AS (
  SELECT c, 0 AS part, p, role, text FROM ids JOIN t ON conv_id = c - c % 5 AND p < h
  UNION ALL SELECT c, 1, p, role, text FROM ids JOIN t ON conv_id = c AND p >= h
), begun AS (
  SELECT c, row_number() OVER w AS d, list(strlen(role) || ':' || role || text) OVER w AS way, strlen(text) AS bytes FROM made WINDOW w AS (PARTITION BY c ORDER BY part, p)
  UNION ALL SELECT c, 0, CAST([] AS VARCHAR[]), 0 FROM ids
), size AS (SELECT c, max(d) AS turns FROM begun GROUP BY c
), node AS (
  SELECT way, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = turns), '')) AS ends_sha256
  FROM begun JOIN size USING (c) GROUP BY way, d
), kids AS (SELECT way[:d - 1] AS up, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), known AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids ON up = way
), sums AS (
  SELECT a.way, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.own) AS BIGINT) AS saved_tokens FROM known a JOIN known b ON b.d >= a.d AND b.way[:a.d] = a.way GROUP BY a.way
)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM known k JOIN sums USING (way) LEFT JOIN node u ON k.d > 0 AND u.way = k.way[:k.d - 1]
""",
}
