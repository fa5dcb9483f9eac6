"""The queries of the corpus operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import table
from .conversation_repair import damaged, repair_conversations
from .decontaminate import decontaminate
from .html_extract import extract_text
from .language_id import dictionaries, identify_language
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .personal_data import KINDS, find_personal_data
from .quality import score_quality
from .suffix_dedup import suffix_dedup
from .topk_search import top_k


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights for the mix: documents labelled good count twice as much as unlabelled ones, those labelled bad half as much."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(F.col("_id").alias("doc_id"), "class_id", "class_size", (F.col("stays") & (F.col("_copy") == 1)).alias("stays"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("_q_score").alias("score"), F.col("_q_p_text").alias("p_text"), F.col("_q_p_meta").alias("p_meta"), (F.col("_q_score") >= 0.5).alias("accepted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify_language(docs, dictionaries(docs, learn=~held_out & F.col("doc_id").isNotNull()), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain identifiers of each document by kind and as a hash, and all spans, disguised ones too."""
    found = find_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    plain = found.withColumn("plain", F.filter("spans", lambda s: s["plain"]))
    kinds = F.transform("plain", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return plain.select("doc_id", *counts, F.sha2(_told(F.col("plain")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11_personal_data that its contract fixes, so that SQL can be held against them."""
    return op11_personal_data(spark, sf_dir).drop("spans")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage by the contract's checksum, each with its faults and its cheapest repair."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), "copies").drop("n_rows")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by the strength of their lowest cut."""
    return collocations(table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_license_scan that its contract fixes, so that SQL can be held against them."""
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_decontaminate, op3_license_scan, op4_html_extract, op5_topk_search, op6_line_dedup, op7_mix_sources, op8_near_dedup, op9_quality, op10_language_id, op11_personal_data, op12_conversation_repair, op13_collocations, license_phrases, pii_base)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT rid, i, p.n, item_id FROM places JOIN phrases p USING (n, k)),
hits AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)""",
    "license_phrases": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
p(phrase, n, label) AS (VALUES ('cc by', 2, 'cc-by'), ('general public license', 3, 'gpl'), ('all rights reserved', 3, 'reserved')),
f AS (SELECT rid, i - 1 AS place, label FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d) AS x JOIN p ON w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i:i + n - 1], ' ') = phrase)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY rid) USING (rid)""",
    "pii_base": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
kinds(o, kind, p) AS (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
marked AS (SELECT rid, o, kind, string_split(regexp_replace(text, '(' || p || ')', chr(57344) || '\1' || chr(57345), 'g'), chr(57344)) AS parts FROM d, kinds WHERE regexp_matches(text, p)),
found AS (SELECT rid, o, kind, split_part(parts[i], chr(57345), 1) AS m, length(replace(array_to_string(parts[1:i - 1], ''), chr(57345), '')) AS start FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM marked)),
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM found),
good AS (SELECT * FROM digits WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0 WHEN 'phone' THEN length(g) BETWEEN 8 AND 15
  ELSE length(g) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(g), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN x >= '5' THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0 END),
sums AS (SELECT rid, count_if(kind = 'email') AS n_email, count_if(kind = 'ip') AS n_ip, count_if(kind = 'card') AS n_card, count_if(kind = 'phone') AS n_phone, string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY o, start) AS told FROM good GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(told, '')) AS base_sha256 FROM d LEFT JOIN sums USING (rid)""",
    "op5_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 5""",
    "op12_conversation_repair": r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce('=' || conv_id, '-') AS conv, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
codes AS (SELECT k, xor(list_reduce(list_transform(string_split(k, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
  lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295), 4294967295) % 20 AS code FROM (SELECT DISTINCT k FROM o)),
d AS (SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o JOIN codes USING (k)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
f AS (SELECT conv, i, turn, role, text, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') AS cut,
  i > 0 AND coalesce(substr(lag(role) OVER (PARTITION BY conv ORDER BY i), 1, 1) || substr(role, 1, 1), '') NOT IN ('su', 'ua', 'au') AS illegal FROM e),
moves(s, initial, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
dp AS (SELECT conv, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'text': ''} AS best FROM (SELECT DISTINCT conv FROM f)
  UNION ALL
  SELECT conv, i + 1, m.s, min(m.best) FROM (
    SELECT g.conv, g.i, unnest(CASE WHEN blank OR duplicate THEN [{'s': g.s, 'best': {'cost': g.best.cost + 4, 'audit': g.best.audit || 'D', 'text': g.best.text}}]
      ELSE [{'s': g.s, 'best': {'cost': g.best.cost + 4, 'audit': g.best.audit || 'D', 'text': g.best.text}},
        {'s': CASE g.s WHEN 2 THEN 3 ELSE 2 END, 'best': {'cost': g.best.cost + 3 + 3 * cut::BIGINT, 'audit': g.best.audit || 'R', 'text': g.best.text || chr(10) || CASE g.s WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || f.text}},
        {'s': m.nxt, 'best': {'cost': g.best.cost + 3 * cut::BIGINT, 'audit': g.best.audit || 'K', 'text': g.best.text || chr(10) || f.role || ':' || f.text}}] END)
    FROM (SELECT conv, i, CASE WHEN ins = 0 THEN s WHEN s = 2 THEN 3 ELSE 2 END AS s, CASE WHEN ins = 0 THEN best ELSE {'cost': best.cost + 3, 'audit': best.audit || 'I', 'text': best.text || chr(10) || CASE s WHEN 2 THEN 'assistant' ELSE 'user' END || ':'} END AS best FROM dp, (VALUES (0), (1)) AS v(ins)) AS g
    JOIN f ON g.conv = f.conv AND g.i = f.i LEFT JOIN moves m ON m.s = g.s AND m.initial = substr(f.role, 1, 1)) AS x(conv, i, m) WHERE m.s IS NOT NULL GROUP BY conv, i, m.s),
n AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(cut) AS truncated, count_if(illegal) AS illegal FROM f GROUP BY conv),
ends AS (SELECT conv, min(best) AS best FROM (SELECT dp.conv, CASE WHEN s = 2 THEN {'cost': best.cost + 3, 'audit': best.audit || 'I', 'text': best.text || chr(10) || 'assistant:'} ELSE best END AS best FROM dp JOIN n ON dp.conv = n.conv AND dp.i = n.n WHERE s IN (0, 2, 3)) GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.text, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM o) LEFT JOIN n USING (conv) LEFT JOIN ends USING (conv)""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, cut, (1000 * c.a::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covered AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS b ON b.lang = c.lang AND b.k > c.k AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low ANTI JOIN covered USING (lang, phrase)) WHERE rank <= 2000""",
    "op6_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(l[i + 1:i + 3], chr(10)) AS k FROM (SELECT rid, doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
later AS (SELECT rid, i FROM (SELECT rid, i, rank() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, i) AS r FROM w WHERE regexp_matches(k, '\S')) WHERE r > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 3)) AS n FROM later),
kept AS (SELECT rid, string_agg(line, chr(10) ORDER BY n) AS text, count(*) AS n_kept FROM (SELECT rid, unnest(l) AS line, unnest(range(0, len(l))) AS n FROM d) ANTI JOIN gone USING (rid, n) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""",
    "op7_mix_sources": r"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0 ELSE 0.5 END) AS weight FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, hash(text) AS h,
  -ln((CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / coalesce(CAST(weight AS DOUBLE), 1.0) AS key
  FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, 2.0 * sum(size) AS cap, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w FROM d GROUP BY source),
l AS (SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS ratio, (sum(CAST(z AS DOUBLE)) OVER () * 1.5 - coalesce(sum(CAST(cap AS DOUBLE)) OVER before, 0)) / (sum(CAST(w AS DOUBLE)) OVER () - coalesce(sum(CAST(w AS DOUBLE)) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, z, least(CAST(cap AS DOUBLE), CAST(w AS DOUBLE) * (SELECT coalesce(arg_min(level, ratio), 'infinity'::DOUBLE) FROM l WHERE ratio >= level)) AS target FROM l),
e AS (SELECT *, CASE WHEN z > 0 THEN CAST(floor(target / z) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.z, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.z - (sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id IS NULL, d.doc_id, d.size, h ROWS UNBOUNDED PRECEDING) - d.size) AS room
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target, CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM p""",
}
