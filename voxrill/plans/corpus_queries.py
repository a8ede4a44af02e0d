"""Queries over clips, speakers, splits and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrill.functions import scalar as S
from voxrill.functions import text as T
from voxrill.operators import corpus as C
from voxrill.plans import adapters as A
from voxrill.plans.phone_queries import r6
from voxrill.plans.registry import query, view

SEED = "v1"


def seeded_sql(col: str) -> str:
    return f"sha256('{SEED}|' || {col})"


def speaker_table(spark, d):
    c = A.table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("speaker_id"),
        F.when(F.col("c_custkey") % 7 == 0, "unknown").when(F.col("c_custkey") % 3 == 0, "male").otherwise("female").alias("gender"),
    )


@query("corpus_index", "J1", ("clips_v",), """
SELECT clip_id, speaker_id, CASE WHEN speaker_id % 3 = 0 THEN 'male' ELSE 'female' END AS gender, 'text ' || clip_id AS sentence
FROM clips_v WHERE speaker_id % 7 <> 0 AND clip_id % 5 <> 0
""")
def corpus_index(spark, d):
    o = A.table(spark, d, "orders")
    utt = F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("utt")
    clips = A.clips(spark, d).select("speaker_id", "clip_id", F.concat(F.lit("u"), F.col("clip_id").cast("string")).alias("utt"))
    text = o.select(utt, F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("text "), F.col("o_orderkey").cast("string"))).alias("sentence"))
    return C.join_index(clips, speaker_table(spark, d), text).select("clip_id", "speaker_id", "gender", "sentence")


@query("duration_join", "J2 P4", ("clips_v",), """
SELECT clip_id, duration_ms FROM clips_v WHERE clip_id % 4 <> 0 AND duration_ms BETWEEN 4000 AND 15000
  AND duration_ms / 1000.0 BETWEEN CASE lang WHEN 'zh' THEN 2.5 WHEN 'en' THEN 2.5 ELSE 5 END AND CASE lang WHEN 'zh' THEN 12 WHEN 'en' THEN 18 ELSE 15 END
""")
def duration_join(spark, d):
    c = A.clips(spark, d)
    known = c.where("clip_id % 4 <> 0").select("path", "duration_ms")
    out = C.with_durations(c.drop("duration_ms"), known, 4000, 15000)
    return C.within_duration(out, F.col("lang"), F.col("duration_ms") / 1000).select("clip_id", "duration_ms")


view("balanced_v", f"""
SELECT clip_id, speaker_id, gender, h FROM (
  SELECT p.*, s.upto, s.n FROM (
    SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY h) AS rn FROM (SELECT *, {seeded_sql('clip_id')} AS h FROM clips_v)) p
  JOIN (SELECT speaker_id, n, sum(n) OVER (ORDER BY turn, side) AS upto FROM (
      SELECT speaker_id, least(3, count(*)) AS n, CASE gender WHEN 'male' THEN 0 ELSE 1 END AS side,
        row_number() OVER (PARTITION BY gender ORDER BY {seeded_sql('speaker_id')}) AS turn FROM clips_v GROUP BY speaker_id, gender)) s
  ON p.speaker_id = s.speaker_id WHERE rn <= 3) WHERE upto - n < 1000 ORDER BY h LIMIT 1000
""", ("clips_v",))


@query("balanced_sample", "W9", ("balanced_v",), "SELECT clip_id, speaker_id, gender FROM balanced_v")
def balanced_sample(spark, d):
    return C.balanced_sample(A.clips(spark, d), 1000, 3, SEED).select("clip_id", "speaker_id", "gender")


@query("round_robin", "W10", ("clips_v",), """
SELECT clip_id, speaker_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) AS turn FROM clips_v) WHERE turn <= 5
""")
def round_robin(spark, d):
    return C.round_robin(A.clips(spark, d), 5, ["clip_id"]).select("clip_id", "speaker_id", "turn").orderBy("turn", "speaker_id")


@query("gender_balance", "W11", ("clips_v",), f"""
SELECT clip_id, gender FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY {seeded_sql('clip_id')}) AS r FROM clips_v)
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM clips_v GROUP BY gender))
""")
def gender_balance(spark, d):
    return C.gender_balance(A.clips(spark, d), SEED).select("clip_id", "gender")


@query("first_k_clips", "W12", ("clips_v",), """
SELECT speaker_id, gender, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, string_agg('t' || clip_id, '' ORDER BY clip_id) AS transcript FROM (
  SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) AS rn FROM clips_v WHERE duration_ms >= 3000) WHERE rn <= 8 GROUP BY speaker_id, gender HAVING count(*) = 8
""")
def first_k_clips(spark, d):
    c = A.clips(spark, d).where("duration_ms >= 3000").withColumn("sentence", F.concat(F.lit("t"), F.col("clip_id").cast("string")))
    return C.first_clips(c, 8, ["clip_id"]).select("speaker_id", "gender", "duration_ms", "transcript")


@query("session_windows", "W13", ("clips_v",), """
SELECT speaker_id, CAST(cycle AS INTEGER) AS cycle, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, min(clip_id) AS first_clip FROM (
  SELECT *, (rn - 1) // 3 AS cycle FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) AS rn FROM clips_v) WHERE rn <= 9)
GROUP BY speaker_id, cycle HAVING count(*) = 3 ORDER BY cycle, speaker_id LIMIT 2000
""")
def session_windows(spark, d):
    return C.session_windows(A.clips(spark, d), 3, 3, 2000, ["clip_id"])


@query("speaker_pick", "W14", ("clips_v",), f"""
SELECT speaker_id, gender FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY {seeded_sql('speaker_id')}, speaker_id) AS rn
  FROM (SELECT DISTINCT speaker_id, gender FROM clips_v)) WHERE rn <= 40
""")
def speaker_pick(spark, d):
    return C.pick_speakers(A.clips(spark, d).select("speaker_id", "gender").distinct(), 40, SEED).select("speaker_id", "gender")


@query("pooled_splits", "U1", ("clips_v",), """
SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN 'test' ELSE 'train' END AS sentence FROM clips_v
""")
def pooled_splits(spark, d):
    c = A.clips(spark, d)
    train = c.select("clip_id", F.lit("train").alias("sentence"))
    return C.pool_splits([train, c.where("clip_id % 3 = 0").select("clip_id", F.lit("test").alias("sentence"))], "clip_id", "sentence")


@query("content_dedupe", "U5", (), """
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep, count(*) OVER (PARTITION BY h) AS copies FROM (SELECT doc_id, sha256(text) AS h FROM documents)
""")
def content_dedupe(spark, d):
    _, mapping = C.dedupe_by_content(A.table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))
    return mapping.select("doc_id", "rep", "copies")


@query("speaker_holdout", "U6", ("clips_v",), """
SELECT speaker_id, CAST('0x' || left(sha1('v0.2.0|' || speaker_id), 8) AS BIGINT) % 1000 < 100 AS holdout FROM (SELECT DISTINCT speaker_id FROM clips_v)
""")
def speaker_holdout(spark, d):
    s = A.clips(spark, d).select("speaker_id").distinct()
    return C.split_holdout(s, "v0.2.0", 0.10)


@query("resume_anti", "J7", ("clips_v",), "SELECT clip_id, path FROM clips_v WHERE clip_id % 2 = 1 OR duration_ms > 15000")
def resume_anti(spark, d):
    c = A.clips(spark, d)
    done = c.where("clip_id % 2 = 0 AND duration_ms <= 15000").select("path")
    return C.not_done(c, done, "path").select("clip_id", "path")


@query("corpus_totals", "A39", ("clips_v",), """
SELECT lang, gender, count(*) AS clips, round(sum(duration_ms) / 60000.0::DOUBLE, 6) AS minutes, CAST(grouping(lang, gender) AS INTEGER) AS level FROM clips_v GROUP BY ROLLUP (lang, gender)
""")
def corpus_totals(spark, d):
    return C.totals(A.clips(spark, d)).withColumn("minutes", F.round("minutes", 6))


# --- text --------------------------------------------------------------------------------------

_SPLIT = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def turns(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", "text")


@query("clean_transcripts", "F4", (), r"""
SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(text, '[^A-Za-z''\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS en,
  md5(trim(regexp_replace(lower(regexp_replace(nfc_normalize(text), '[^A-Za-zÀ-ÖØ-öø-ÿŒœ''\-\s]+', ' ', 'g')), '\s+', ' ', 'g'))) AS fr,
  trim(regexp_replace(regexp_replace(nfc_normalize(text), '[^가-힣\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS ko FROM conversations
""")
def clean_transcripts(spark, d):
    t = F.col("text")
    return turns(spark, d).select("conv_id", "turn", F.md5(T.clean_en(t)).alias("en"), F.md5(T.clean_fr(t)).alias("fr"), T.clean_ko(t).alias("ko"))


@query("unicode_normalise", "D1", (), "SELECT conv_id, turn, md5(nfc_normalize(text)) AS nfc FROM conversations")
def unicode_normalise(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.md5(T.nfc(F.col("text"))).alias("nfc"))


@query("clean_spaced", "F5", (), "SELECT conv_id, turn, md5(replace(replace(trim(text || ' <unk>'), ' ', ''), '<unk>', '')) AS zh FROM conversations")
def clean_spaced(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.md5(T.clean_zh(F.concat("text", F.lit(" <unk>")))).alias("zh"))


@query("word_tokens", "F6", (), rf"""
SELECT conv_id, turn, CAST(seq AS INTEGER) AS seq, CAST(sub AS INTEGER) AS sub, tok AS word FROM (
  SELECT conv_id, turn, seq, unnest(range(0, len(toks))) AS sub, unnest(toks) AS tok FROM (
    SELECT conv_id, turn, seq, string_split(c, ' ') AS toks FROM (
      SELECT conv_id, turn, unnest(range(0, len(ws))) AS seq, trim(regexp_replace(regexp_replace(unnest(ws), '[^A-Za-z''\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS c
      FROM (SELECT conv_id, turn, {_SPLIT.format(x='text')} AS ws FROM conversations)) WHERE c <> ''))
""")
def word_tokens(spark, d):
    w = turns(spark, d).select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("seq", "word"))
    w = w.withColumn("start", F.col("seq") * 0.5).withColumn("end", F.col("seq") * 0.5 + 0.4)
    return T.explode_words(w, ["conv_id", "turn"]).select("conv_id", "turn", "seq", "sub", "word")


@query("match_tokens", "F7", (), rf"""
SELECT conv_id, turn, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(text)), '[^\p{{L}}\p{{N}}\s'']', ' ', 'g'), '\s+'), lambda w: w <> '') AS t FROM conversations)
""")
def match_tokens(spark, d):
    m = turns(spark, d).withColumn("t", T.match_tokens(F.col("text"), F.lit("fr-FR")))
    return m.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("even_tokens", "F2", (), f"""
SELECT conv_id, turn, md5(array_to_string([x for x, i in {_SPLIT.format(x='text')} if i % 2 = 1], '')) AS digest FROM conversations
""")
def even_tokens(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.md5(T.even_tokens(F.col("text"))).alias("digest"))


@query("han_text", "F1 F9", (), r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '[一-鿿]'), ' ') AS han, len(regexp_extract_all(text, '[가-힣]')) AS hangul FROM documents
""")
def han_text(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.han_chars(F.col("text"), " ").alias("han"), S.token_count(F.lit("ko"), F.col("text")).cast("long").alias("hangul"))


@query("lexicon_filter", "F3", (), """
SELECT conv_id, turn, CASE WHEN length(k) >= 4 THEN md5(k) END AS kept FROM (SELECT conv_id, turn, regexp_replace(text, '[^' || l || ']', '', 'g') AS k
  FROM conversations, (SELECT string_agg(DISTINCT c, '' ORDER BY c) AS l FROM (SELECT unnest(regexp_extract_all(lower(n_name), '[a-z]')) AS c FROM nation)))
""")
def lexicon_filter(spark, d):
    """Keep the characters that occur in the lexicon (here: letters of nation names)."""
    chars = A.table(spark, d, "nation").select(F.explode(F.split(F.lower("n_name"), "")).alias("c")).where("c RLIKE '[a-z]'")
    lexicon = chars.agg(F.array_join(F.collect_set("c"), "").alias("l")).scalar()
    return turns(spark, d).select("conv_id", "turn", F.md5(T.keep_in_lexicon(F.col("text"), lexicon, 4)).alias("kept"))
