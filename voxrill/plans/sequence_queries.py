"""Queries over timelines: words, runs, gaps, pairing, chunks, pages, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrill.functions import scalar as S
from voxrill.operators import phones as P
from voxrill.operators import sequence as Q
from voxrill.operators.ordered import scan, trailing_count
from voxrill.operators.quantiles import quantiles
from voxrill.plans import adapters as A
from voxrill.plans.phone_queries import r6
from voxrill.plans.registry import query, view

REC = ["recording_id"]
BLOCK = A.TIMELINE_BLOCK_S


def _block(col="t"):
    return A.time_block(col)


# --- words ---------------------------------------------------------------------------


def word_items(spark, d):
    """Sign-ups act as words, everything else as phones."""
    t = A.timeline(spark, d)
    w = F.col("kind") == "signup"
    return t.select(
        "recording_id", "t", (~w).alias("is_phone"), "ref", "k", "phone", w.alias("is_word"),
        F.concat(F.lit("w"), (F.col("k") % 30).cast("string")).alias("word"), F.when(w, F.col("t")).alias("word_time"),
    )


def attached(spark, d):
    return P.attach_words(word_items(spark, d), REC, ["t", "is_phone", "ref"], _block())


view("words_v", """
SELECT recording_id, t AS word_time, 'w' || (k % 30) AS word, row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS word_index
FROM timeline_v WHERE kind = 'signup'
""", ("timeline_v",))
view("asof_v", """
SELECT p.recording_id, p.ref, p.t, p.phone, w.word, w.word_time, w.word_index,
  row_number() OVER (PARTITION BY p.recording_id, w.word_index ORDER BY p.t) - 1 AS nth
FROM (SELECT * FROM timeline_v WHERE kind <> 'signup') p ASOF JOIN words_v w ON p.recording_id = w.recording_id AND p.t >= w.word_time
""", ("words_v",))


@query("asof_words", "J3", ("asof_v",), "SELECT recording_id, ref, phone, word, round(word_time, 6) AS word_time, word_index, nth FROM asof_v")
def asof_words(spark, d):
    return attached(spark, d).select("recording_id", "ref", "phone", "word", *r6("word_time"), "word_index", "nth")


@query("asof_unknown_times", "J3", ("words_v",), """
SELECT p.recording_id, p.ref, w.word, w.word_index, row_number() OVER (PARTITION BY p.recording_id, w.word_index ORDER BY p.at, p.t) - 1 AS nth
FROM (SELECT *, max(CASE WHEN k % 5 <> 0 THEN t END) OVER (PARTITION BY recording_id ORDER BY t) AS at FROM timeline_v WHERE kind <> 'signup') p
ASOF JOIN words_v w ON p.recording_id = w.recording_id AND p.at >= w.word_time
""")
def asof_unknown_times(spark, d):
    """Every fifth phone has no time and keeps the word of the phone before it."""
    items = word_items(spark, d).withColumn("seq", F.col("t"))
    words, phones = items.where("is_word"), items.where("is_phone")
    gaps = phones.withColumn("t", F.when(F.col("k") % 5 != 0, F.col("t")))
    timed = P.known_times(gaps, REC, ["seq", "ref"], _block("seq"), "t").where("t IS NOT NULL")
    out = P.attach_words(timed.unionByName(words), REC, ["t", "is_phone", "seq", "ref"], _block())
    return out.select("recording_id", "ref", "word", "word_index", "nth")


@query("expected_phones", "J4", ("asof_v",), """
SELECT recording_id, ref, word, nth, CASE WHEN nth < len(n_name) THEN substr(n_name, CAST(nth AS INTEGER) + 1, 1) END AS expected
FROM asof_v LEFT JOIN nation ON word = 'w' || n_nationkey
""")
def expected_phones(spark, d):
    n = A.table(spark, d, "nation")
    dic = n.select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("word"), F.split("n_name", "").alias("phones"))
    return P.attach_expected(attached(spark, d), dic, F.col("word")).select("recording_id", "ref", "word", "nth", "expected")


# --- ends, runs, gaps --------------------------------------------------------------------

view("ends_v", """
SELECT *, CASE WHEN k % 4 = 0 THEN e - 0.05 ELSE e END AS "end", CASE WHEN k % 3 <> 0 THEN 100 + value END AS pitch,
  CASE WHEN k % 7 <> 0 THEN value / 500 END AS score FROM (
  SELECT *, round(t, 3) AS start, round(CASE WHEN lead(t) OVER r > t THEN lead(t) OVER r ELSE t + 0.1 END, 3) AS e
  FROM timeline_v WINDOW r AS (PARTITION BY recording_id ORDER BY t))
""", ("timeline_v",))


def ended(spark, d):
    t = A.timeline(spark, d).withColumn("start", F.col("t"))
    e = Q.phone_ends(t, REC, ["t"], _block())
    return e.withColumn("e", F.col("end")).withColumn("end", F.when(F.col("k") % 4 == 0, F.col("e") - 0.05).otherwise(F.col("e"))).withColumn(
        "pitch", F.when(F.col("k") % 3 != 0, 100 + F.col("value"))
    ).withColumn("score", F.when(F.col("k") % 7 != 0, F.col("value") / 500))


@query("phone_ends", "W1", ("ends_v",), 'SELECT recording_id, ref, start, e AS "end" FROM ends_v')
def phone_ends(spark, d):
    return ended(spark, d).select("recording_id", "ref", "start", F.col("e").alias("end"))


view("cells2_v", """
SELECT recording_id, cell, min(start) AS start, arg_max("end", t) AS "end", any_value(char) AS char, count(*) AS phones,
  sum(pitch * ("end" - start)) FILTER (pitch > 0 AND "end" > start) / sum("end" - start) FILTER (pitch > 0 AND "end" > start) AS pitch,
  sum(score * ("end" - start)) FILTER ("end" > start AND score IS NOT NULL) / sum("end" - start) FILTER ("end" > start AND score IS NOT NULL) AS score
FROM (SELECT *, sum(CASE WHEN coalesce(char <> '' AND pc = char AND abs(pe - start) < 0.02, false) THEN 0 ELSE 1 END)
        OVER (PARTITION BY recording_id ORDER BY t) AS cell
      FROM (SELECT *, lag(char) OVER r AS pc, lag("end") OVER r AS pe FROM ends_v WINDOW r AS (PARTITION BY recording_id ORDER BY t)))
GROUP BY recording_id, cell
""", ("ends_v",))


def cells(spark, d):
    return Q.char_groups(ended(spark, d), REC, ["t"], _block())


@query("char_groups", "W2 W3", ("cells2_v",), """
SELECT recording_id, CAST(cell AS BIGINT) AS cell, char, phones, round(start, 6) AS start, round("end", 6) AS "end", round(pitch, 4) AS pitch, round(score, 4) AS score FROM cells2_v
""")
def char_groups(spark, d):
    return cells(spark, d).select("recording_id", F.col("cell").cast("long").alias("cell"), "char", "phones", *r6("start", "end"), F.round("pitch", 4).alias("pitch"), F.round("score", 4).alias("score"))


@query("cell_formants", "W2", ("ends_v",), """
SELECT recording_id, round(min(start), 6) AS start, char, """ + ", ".join(
    f'round(sum(CASE WHEN f{i} IS NOT NULL AND "end" > start THEN f{i} * ("end" - start) END) / nullif(sum(CASE WHEN f{i} IS NOT NULL AND "end" > start THEN "end" - start END), 0), 4) AS f{i}'
    for i in (1, 2, 3)) + """
FROM (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY t) AS cell FROM (
  SELECT *, CASE WHEN char <> '' AND lag(char) OVER r = char AND abs(lag("end") OVER r - start) < 0.02 THEN 0 ELSE 1 END AS new,
    CASE WHEN k % 5 <> 0 THEN 300 + value END AS f1, 1200 + value AS f2, CASE WHEN k % 2 = 0 THEN 2500 + value END AS f3
  FROM ends_v WINDOW r AS (PARTITION BY recording_id ORDER BY t))) GROUP BY recording_id, cell, char
""")
def cell_formants(spark, d):
    k, v = F.col("k"), F.col("value")
    f = {"f1": F.when(k % 5 != 0, 300 + v), "f2": 1200 + v, "f3": F.when(k % 2 == 0, 2500 + v)}
    out = Q.char_groups(ended(spark, d).withColumns(f), REC, ["t"], _block(), formants=list(f))
    return out.select("recording_id", "char", *r6("start"), *[F.round(c, 4).alias(c) for c in f])


@query("gap_fill", "W4", ("cells2_v",), """
SELECT recording_id, CAST(cell AS BIGINT) AS cell, round(CASE WHEN char = '' THEN NULL WHEN pitch IS NOT NULL THEN pitch
  WHEN p IS NOT NULL AND n IS NOT NULL THEN p.pitch + (n.pitch - p.pitch) * CASE WHEN n.start - p.e > 0 THEN greatest(0, least(1, (start - p.e) / (n.start - p.e))) ELSE 0.5 END
  WHEN p IS NOT NULL THEN p.pitch ELSE n.pitch END, 4) AS pitch_filled
FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY cell ROWS UNBOUNDED PRECEDING) AS p,
    first_value(v IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM (SELECT *, CASE WHEN char <> '' AND pitch IS NOT NULL THEN struct_pack(pitch := pitch, start := start, e := "end") END AS v FROM cells2_v))
""")
def gap_fill(spark, d):
    out = Q.fill_pitch(cells(spark, d), REC, ["cell"], _block("start"))
    return out.select("recording_id", F.col("cell").cast("long").alias("cell"), F.round("pitch_filled", 4).alias("pitch_filled"))


@query("run_merge", "W5", ("ends_v",), """
SELECT recording_id, CAST(run AS BIGINT) AS run, any_value(label) AS label, round(min(start), 6) AS start, round(arg_max("end", t), 6) AS "end",
  round(least(1, greatest(0, sum(conf * ("end" - start)) / sum("end" - start))), 6) AS confidence
FROM (SELECT *, sum(CASE WHEN pl = label THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY t) AS run
  FROM (SELECT *, lag(label) OVER (PARTITION BY recording_id ORDER BY t) AS pl FROM (
    SELECT *, CASE WHEN pitch IS NULL THEN 'other' WHEN pitch < 145 THEN 'male' WHEN pitch > 185 THEN 'female' ELSE 'neutral' END AS label,
      CASE WHEN pitch IS NULL THEN 0.0 WHEN pitch < 145 THEN least(1.0, greatest(0.0, (145 - pitch) / 65)) WHEN pitch > 185 THEN least(1.0, greatest(0.0, (pitch - 185) / 65))
        ELSE greatest(0.0, 1 - abs(pitch - 165) / 20) END AS conf
    FROM ends_v WHERE "end" > start)))
GROUP BY recording_id, run
""")
def run_merge(spark, d):
    e = ended(spark, d)
    rows = e.withColumn("label", F.coalesce(S.pitch_side(F.col("pitch")), F.lit("other"))).withColumn("confidence", S.pitch_side_confidence(F.col("pitch")))
    out = Q.merge_runs(rows, REC, ["t"], _block())
    return out.select("recording_id", F.col("run").cast("long").alias("run"), "label", *r6("start", "end", "confidence"))


def numbered_frames(spark, d):
    """Frames numbered along each timeline, two-class probabilities, decoded label."""
    t = scan(A.timeline(spark, d), REC, ["t"], _block(), sums={"n": F.lit(1)})
    p = F.least(F.col("value") / 100, F.lit(1.0))
    return t.select(
        "recording_id", "t", "kind", (F.col("n") - 1).alias("frame_idx"), F.array(p, 1 - p).alias("probs"), F.when(p >= 0.5, 0).otherwise(1).alias("label_idx")
    )


view("frames_v", """
SELECT recording_id, kind, row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS frame_idx, p, CASE WHEN p >= 0.5 THEN 0 ELSE 1 END AS label_idx
FROM (SELECT *, least(value / 100, 1.0::DOUBLE) AS p FROM timeline_v)
""", ("timeline_v",))


@query("frame_runs", "W6", ("frames_v",), """
SELECT recording_id, CAST(run AS BIGINT) AS run, any_value(label_idx) AS label_idx, round(min(frame_idx) * 0.02::DOUBLE, 6) AS start_s, round((max(frame_idx) + 1) * 0.02::DOUBLE, 6) AS end_s,
  round(avg(CASE label_idx WHEN 0 THEN p ELSE 1 - p END), 9) AS confidence
FROM (SELECT *, sum(CASE WHEN pl = label_idx THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS run
  FROM (SELECT *, lag(label_idx) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS pl FROM frames_v)) GROUP BY recording_id, run
""")
def frame_runs(spark, d):
    out = Q.frame_runs(numbered_frames(spark, d), REC, F.floor(F.col("frame_idx") / 20))
    return out.select("recording_id", F.col("run").cast("long").alias("run"), "label_idx", *r6("start_s", "end_s"), F.round("confidence", 9).alias("confidence"))


@query("margin_softmax", "M1 M2", ("frames_v",), """
SELECT recording_id, frame_idx, round(abs(2 * p - 1), 6) AS margin, round(abs(2 * s / (s + r) - 1), 6) AS margin_t2, round(s / (s + r), 6) AS p_t2
FROM (SELECT *, sqrt(greatest(p, 1e-10)) AS s, sqrt(greatest(1 - p, 1e-10)) AS r FROM frames_v)
""")
def margin_softmax(spark, d):
    f = numbered_frames(spark, d).withColumn("soft", S.softmax_rescaled(F.col("probs"), 2.0))
    return f.select(
        "recording_id", "frame_idx", F.round(S.top2_margin(F.col("probs")), 6).alias("margin"),
        F.round(S.top2_margin(F.col("soft")), 6).alias("margin_t2"), F.round(F.col("soft")[0], 6).alias("p_t2"),
    )


# --- intervals, silences, chunks ----------------------------------------------------------

view("cells3_v", """
SELECT recording_id, ref AS idx, t AS start, least(t + value / 2, coalesce(lead(t) OVER (PARTITION BY recording_id ORDER BY t), 1e9)) AS "end"
FROM timeline_v WHERE kind = 'signup'
""", ("timeline_v",))


def disjoint_cells(spark, d):
    t = A.timeline(spark, d).where("kind = 'signup'").withColumn("start", F.col("t"))
    from voxrill.operators.ordered import neighbours

    n = neighbours(t, REC, ["t"], _block(), next={"_nx": F.col("t")})
    return n.select("recording_id", F.col("ref").alias("idx"), "start", F.least(F.col("t") + F.col("value") / 2, F.coalesce("_nx", F.lit(1e9))).alias("end"))


@query("point_lookup", "J11", ("cells3_v",), """
SELECT p.recording_id, p.ref, c.idx FROM (SELECT * FROM timeline_v WHERE kind <> 'signup') p
LEFT JOIN cells3_v c ON p.recording_id = c.recording_id AND p.t >= c.start AND p.t < c."end"
""")
def point_lookup(spark, d):
    pts = A.timeline(spark, d).where("kind <> 'signup'").select("recording_id", "ref", "t")
    return Q.locate(pts, disjoint_cells(spark, d), REC, BLOCK).select("recording_id", "ref", "idx")


# Silences and words on a compressed clock (30 days -> 144 s).
SCALE = 18.0


def silences(spark, d):
    t = A.timeline(spark, d).where("kind IN ('view', 'click')")
    return t.select("recording_id", "ref", (F.col("t") / SCALE).alias("start"), ((F.col("t") + F.col("value")) / SCALE).alias("end"))


def words(spark, d):
    t = A.timeline(spark, d).where("kind IN ('signup', 'error')")
    return t.select(
        "recording_id", "ref", F.concat(F.lit("w"), F.col("k").cast("string")).alias("word"),
        (F.col("t") / SCALE).alias("start"), ((F.col("t") + F.col("value") / 2) / SCALE).alias("end"),
    )


view("mids_v", """
SELECT s.recording_id, s.ref, s.mid FROM (SELECT recording_id, ref, (t / 18 + (t + value) / 18) / 2 AS mid FROM timeline_v WHERE kind IN ('view', 'click') AND (t + value) / 18 - t / 18 >= 0.5) s
WHERE NOT EXISTS (SELECT 1 FROM timeline_v w WHERE w.recording_id = s.recording_id AND w.kind IN ('signup', 'error') AND w.t / 18 < s.mid AND s.mid < (w.t + w.value / 2) / 18)
""", ("timeline_v",))


@query("cut_candidates", "J12 P18", ("mids_v",), "SELECT recording_id, ref, round(mid, 6) AS mid FROM mids_v")
def cut_candidates(spark, d):
    return Q.cut_candidates(silences(spark, d), words(spark, d), REC, 5.0).select("recording_id", "ref", *r6("mid"))


def fixed_chunks(spark, d):
    """Four equal chunks per recording over its word span."""
    span = words(spark, d).groupBy("recording_id").agg(F.max("end").alias("hi"))
    c = span.select("recording_id", "hi", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("chunk"))
    return c.select("recording_id", "chunk", (F.col("chunk") * F.col("hi") / 4).alias("start"), ((F.col("chunk") + 1) * F.col("hi") / 4).alias("end"), (F.col("chunk") == 3).alias("is_last"))


@query("chunk_words", "J13", ("timeline_v",), """
WITH w AS (SELECT recording_id, ref, 'w' || k AS word, (t / 18 + (t + value / 2) / 18) / 2 AS mid, (t + value / 2) / 18 AS e FROM timeline_v WHERE kind IN ('signup', 'error')),
c AS (SELECT recording_id, chunk, chunk * hi / 4 AS s, (chunk + 1) * hi / 4 AS e FROM (SELECT recording_id, max(e) AS hi, unnest([0, 1, 2, 3]) AS chunk FROM w GROUP BY recording_id)),
x AS (SELECT c.recording_id, c.chunk, count(w.ref) AS word_count, md5(string_agg(word, ' ' ORDER BY mid, ref)) AS digest
  FROM c LEFT JOIN w ON c.recording_id = w.recording_id AND w.mid >= s AND (w.mid < c.e OR (chunk = 3 AND w.mid <= c.e)) GROUP BY ALL)
SELECT recording_id, chunk, word_count, digest FROM x WHERE recording_id NOT IN (SELECT recording_id FROM x WHERE word_count = 0)
""".replace("WITH w AS", "SELECT * FROM (WITH w AS").rstrip() + ")")
def chunk_words(spark, d):
    out = Q.words_to_chunks(words(spark, d), fixed_chunks(spark, d), REC, 5.0)
    return out.select("recording_id", "chunk", "word_count", F.md5("transcript").alias("digest"))


@query("silence_pairs", "J18", ("timeline_v",), """
SELECT recording_id, pair, round(start, 6) AS start, round("end", 6) AS "end" FROM (
  SELECT s.recording_id, s.pair, s.t AS start, e.t AS "end" FROM
  (SELECT recording_id, t, row_number() OVER (PARTITION BY recording_id ORDER BY t) AS pair FROM timeline_v WHERE kind IN ('view', 'click')) s
  JOIN (SELECT recording_id, t, row_number() OVER (PARTITION BY recording_id ORDER BY t) AS pair FROM (
      SELECT *, lag(low) OVER (PARTITION BY recording_id ORDER BY t) AS was FROM (
        SELECT *, min(least(depth, 0)) OVER (PARTITION BY recording_id ORDER BY t) AS low FROM (
          SELECT *, sum(CASE WHEN kind IN ('view', 'click') THEN 1 ELSE -1 END) OVER (PARTITION BY recording_id ORDER BY t) AS depth
          FROM timeline_v WHERE kind <> 'signup')))
      WHERE kind IN ('purchase', 'error') AND low = coalesce(was, 0)) e
  ON s.recording_id = e.recording_id AND s.pair = e.pair)
""")
def silence_pairs(spark, d):
    t = A.timeline(spark, d).where("kind <> 'signup'").select("recording_id", "t", "ref", F.col("kind").isin("view", "click").alias("is_start"))
    return Q.pair_events(t, REC, _block()).select("recording_id", "pair", *r6("start", "end"))


CHUNK_S = 300.0


@query("chunk_merge", "W7", ("timeline_v",), """
SELECT recording_id, ref, round(t_local + off, 6) AS t, CAST(word_local + shift AS BIGINT) AS word_index FROM (
  SELECT p.*, off, coalesce(shift, 0) AS shift, least_n FROM
  (SELECT recording_id, ref, floor(t / 300) AS chunk, t - floor(t / 300) * 300 AS t_local, k % 3 AS word_local FROM timeline_v WHERE kind <> 'signup') p
  JOIN (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shift,
      min(np) OVER (PARTITION BY recording_id) AS least_n
    FROM (SELECT recording_id, floor(t / 300) AS chunk, floor(t / 300) * 300 AS off, count(*) FILTER (kind = 'signup') AS nw, count(*) FILTER (kind <> 'signup') AS np
      FROM timeline_v GROUP BY ALL)) c ON p.recording_id = c.recording_id AND p.chunk = c.chunk) WHERE least_n > 0
""")
def chunk_merge(spark, d):
    t = A.timeline(spark, d).withColumn("chunk", F.floor(F.col("t") / CHUNK_S))
    t = t.withColumn("t_local", F.col("t") - F.col("chunk") * CHUNK_S).withColumn("word_local", F.col("k") % 3)
    ch = t.select("recording_id", "chunk", (F.col("chunk") * CHUNK_S).alias("offset")).distinct()
    w, p = t.where("kind = 'signup'"), t.where("kind <> 'signup'")
    out = Q.merge_chunks(w.select("recording_id", "chunk"), p.select("recording_id", "chunk", "ref", "t_local", "word_local"), ch, REC)
    return out.select("recording_id", "ref", *r6("t"), F.col("word_index").cast("long").alias("word_index"))


@query("chunk_plan", "W19 D2", ("timeline_v", "mids_v"), """
SELECT * FROM (WITH RECURSIVE w AS (SELECT recording_id, ref, t / 18 AS s, (t + value / 2) / 18 AS e FROM timeline_v WHERE kind IN ('signup', 'error')),
r AS (
    SELECT recording_id, max(e) AS total FROM (SELECT *, lag(e) OVER (PARTITION BY recording_id ORDER BY s, ref) AS was FROM w) GROUP BY recording_id
    HAVING count(*) >= 2 AND count(*) FILTER (s > was) >= 2 AND max(e) BETWEEN 6 AND 160
), cuts AS (SELECT recording_id, total, mid, row_number() OVER (PARTITION BY recording_id ORDER BY mid) AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM mids_v JOIN r USING (recording_id)),
wish AS (SELECT recording_id, any_value(total) AS total, least(8, greatest(2, CAST(floor(any_value(total) / 10) AS BIGINT)), any_value(n) + 1) AS parts FROM cuts GROUP BY recording_id),
plan AS (
    SELECT recording_id, 0 AS i, 0.0::DOUBLE AS at_s, 0 AS cut, 0.0::DOUBLE AS longest, 1e9::DOUBLE AS shortest, CAST([] AS DOUBLE[]) AS mids FROM wish
    UNION ALL
    SELECT c.recording_id, c.i, c.mid, p.cut + 1, greatest(p.longest, c.mid - p.at_s), least(p.shortest, c.mid - p.at_s), list_append(p.mids, c.mid)
    FROM plan p JOIN cuts c ON c.recording_id = p.recording_id AND c.i > p.i AND c.mid - p.at_s BETWEEN 3 AND 20 JOIN wish v ON v.recording_id = p.recording_id AND p.cut + 1 < v.parts
), whole AS (
    SELECT p.recording_id, total, cut, mids, greatest(longest, total - at_s) AS longest, least(shortest, total - at_s) AS shortest
    FROM plan p JOIN wish USING (recording_id) WHERE cut > 0 AND total - at_s BETWEEN 3 AND 20
), most AS (SELECT * FROM whole QUALIFY cut = max(cut) OVER (PARTITION BY recording_id)),
near AS (SELECT * FROM most QUALIFY longest <= min(longest) OVER (PARTITION BY recording_id) + 1e-6),
best AS (SELECT recording_id, total, mids FROM (SELECT * FROM near QUALIFY shortest >= max(shortest) OVER (PARTITION BY recording_id) - 1e-12)
    QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY mids) = 1)
SELECT recording_id, chunk, round(CASE chunk WHEN 0 THEN 0 ELSE mids[chunk] END, 6) AS start, round(coalesce(mids[chunk + 1], total), 6) AS "end", chunk = len(mids) AS is_last
FROM (SELECT *, unnest(range(0, len(mids) + 1)) AS chunk FROM best))
""")
def chunk_plan(spark, d):
    """Balanced chunk plan; tests compare with exhaustive search, the check SQL walks through all plans."""
    recs = Q.chunkable(words(spark, d), REC, F.floor(F.col("start") / 5.0))
    cand = Q.cut_candidates(silences(spark, d), words(spark, d), REC, 5.0)
    return Q.plan_chunks(cand, recs, REC).select("recording_id", "chunk", *r6("start", "end"), "is_last")


@query("pages", "W15 D3", ("timeline_v",), """
SELECT recording_id, ref, page FROM (
  WITH RECURSIVE c AS (SELECT recording_id, ref, CAST(w AS BIGINT) AS w, row_number() OVER (PARTITION BY recording_id ORDER BY t) AS rn FROM (
      SELECT *, greatest(2, least(10, len(char))) AS w FROM timeline_v WHERE char <> '')),
  g AS (SELECT recording_id, ref, rn, w AS load, CAST(0 AS BIGINT) AS page FROM c WHERE rn = 1
    UNION ALL SELECT c.recording_id, c.ref, c.rn, CASE WHEN g.load + c.w > 24 THEN c.w ELSE g.load + c.w END, CASE WHEN g.load + c.w > 24 THEN g.page + 1 ELSE g.page END
    FROM g JOIN c ON c.recording_id = g.recording_id AND c.rn = g.rn + 1)
  SELECT * FROM g)
""")
def pages(spark, d):
    c = A.timeline(spark, d).select("recording_id", "t", "ref", Q.cell_weight(F.col("char")).alias("weight"))
    return Q.weight_pages(c, REC, ["t", "ref"], F.floor(F.col("t") / 600), 24).select("recording_id", "ref", "page")


@query("score_clusters", "W16", ("timeline_v",), """
SELECT recording_id, ref, CAST(cluster AS BIGINT) AS cluster, count(*) OVER (PARTITION BY recording_id, cluster) AS cluster_size,
  row_number() OVER (PARTITION BY recording_id, cluster ORDER BY ref) - 1 AS slot
FROM (SELECT *, sum(CASE WHEN value - pv < 0.8 THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY value, ref) AS cluster
  FROM (SELECT *, lag(value) OVER (PARTITION BY recording_id ORDER BY value, ref) AS pv FROM timeline_v))
""")
def score_clusters(spark, d):
    out = Q.gap_clusters(A.timeline(spark, d), REC, "value", "ref", 0.8, 10.0, 1_000_000.0)
    return out.select("recording_id", "ref", F.col("cluster").cast("long").alias("cluster"), "cluster_size", F.col("slot").cast("long").alias("slot"))


# --- retention, queues, limits --------------------------------------------------------------


@query("retention", "W17", ("timeline_v",), """
SELECT recording_id, ref FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY tick DESC, ref DESC) AS rn FROM timeline_v) WHERE rn <= 50
""")
def retention(spark, d):
    return Q.newest(A.timeline(spark, d), REC, "tick", "ref", 50).select("recording_id", "ref")


@query("byte_budget", "W17", ("timeline_v",), """
SELECT recording_id, ref, CAST(used AS BIGINT) AS used FROM (
  SELECT *, sum(k) OVER (PARTITION BY recording_id ORDER BY tick DESC, ref DESC) AS used FROM timeline_v) WHERE used <= 1500
""")
def byte_budget(spark, d):
    out = Q.within_budget(A.timeline(spark, d), REC, "tick", "ref", F.col("k"), 1500, F.floor(-F.col("t") / BLOCK))
    return out.select("recording_id", "ref", F.col("used").cast("long").alias("used"))


@query("queue_rank", "W18", ("timeline_v",), """
SELECT t.ref, coalesce(q.rn, -1) AS position FROM timeline_v t LEFT JOIN (
  SELECT ref, row_number() OVER (ORDER BY tick, ref) - 1 AS rn FROM timeline_v WHERE kind = 'signup') q ON t.ref = q.ref
""")
def queue_rank(spark, d):
    t = A.timeline(spark, d)
    q = scan(t.where("kind = 'signup'").select(F.lit("q").alias("queue"), "tick", "ref", "t"), ["queue"], ["tick", "ref"], _block(), sums={"rn": F.lit(1)})
    return t.select("ref").join(q.select("ref", "rn"), "ref", "left").select("ref", F.coalesce(F.col("rn") - 1, F.lit(-1)).cast("long").alias("position"))


@query("rate_limit", "R3", ("timeline_v",), """
SELECT recording_id, ref, n, n > 3 AS limited FROM (
  SELECT *, count(*) OVER (PARTITION BY recording_id ORDER BY tick RANGE BETWEEN 60000000000 PRECEDING AND CURRENT ROW) AS n FROM timeline_v)
""")
def rate_limit(spark, d):
    """Requests in the trailing minute (the timeline clock runs 1000 times faster)."""
    out = trailing_count(A.timeline(spark, d), REC, "tick", 60_000_000_000, "n")
    return out.select("recording_id", "ref", "n", (F.col("n") > 3).alias("limited"))


@query("queue_depth", "R4", ("timeline_v",), """
SELECT ref, CAST(sum(CASE kind WHEN 'signup' THEN 1 ELSE -1 END) OVER (ORDER BY tick, ref) AS BIGINT) AS depth FROM timeline_v WHERE kind IN ('signup', 'purchase')
""")
def queue_depth(spark, d):
    t = A.timeline(spark, d).where("kind IN ('signup', 'purchase')").select(F.lit("q").alias("queue"), "tick", "ref", "t", F.when(F.col("kind") == "signup", 1).otherwise(-1).alias("step"))
    return scan(t, ["queue"], ["tick", "ref"], _block(), sums={"depth": F.col("step")}).select("ref", F.col("depth").cast("long").alias("depth"))


# --- stage times, sliding windows -------------------------------------------------------------

view("stage_v", """
SELECT recording_id, coalesce(lag(kind) OVER r, 'boot') AS stage, t - coalesce(lag(t) OVER r, 0) AS dur, 2600.0::DOUBLE AS total FROM timeline_v WINDOW r AS (PARTITION BY recording_id ORDER BY t)
UNION ALL SELECT recording_id, arg_max(kind, t), 2600 - max(t), 2600 FROM timeline_v GROUP BY recording_id
""", ("timeline_v",))


@query("stage_profile", "A33 W8", ("stage_v",), """
SELECT stage, count(*) AS runs, round(avg(secs), 6) AS mean_s, round(avg(share), 6) AS mean_share FROM (
  SELECT recording_id, stage, sum(dur) AS secs, sum(dur) / any_value(total) AS share FROM stage_v GROUP BY ALL) GROUP BY stage
""")
def stage_profile(spark, d):
    from voxrill.operators.audit import stage_profile as profile

    t = A.timeline(spark, d).withColumn("total", F.lit(2600.0))
    return profile(t, REC, "t", "kind", "total", _block()).select("stage", "runs", *r6("mean_s", "mean_share"))


@query("sliding_robustness", "A37", ("timeline_v",), """
SELECT length_s, count(*) AS windows, count(median) AS computable, count(*) FILTER (median BETWEEN 85 AND 105) AS in_band,
  round(quantile_cont(median, 0.1), 6) AS m_p10, round(quantile_cont(median, 0.25), 6) AS m_p25, round(quantile_cont(median, 0.5), 6) AS m_p50,
  round(quantile_cont(median, 0.75), 6) AS m_p75, round(quantile_cont(median, 0.9), 6) AS m_p90,
  round(quantile_cont(secs, 0.1), 6) AS v_p10, round(quantile_cont(secs, 0.25), 6) AS v_p25, round(quantile_cont(secs, 0.5), 6) AS v_p50,
  round(quantile_cont(secs, 0.75), 6) AS v_p75, round(quantile_cont(secs, 0.9), 6) AS v_p90
FROM (SELECT length_s, recording_id, win, CASE WHEN count(v) >= 3 THEN quantile_cont(v, 0.5) END AS median, count(v) * 0.5::DOUBLE AS secs FROM (
    SELECT g.length_s, g.recording_id, g.win, CASE WHEN kind <> 'view' THEN 60 + value END AS v
    FROM (SELECT length_s, recording_id, unnest(range(0, CAST(floor((dur - length_s) / 30) AS BIGINT) + 1)) AS win
          FROM (SELECT recording_id, max(t) AS dur, unnest([90, 300, 600]) AS length_s FROM timeline_v GROUP BY recording_id)) g
    LEFT JOIN timeline_v f ON f.recording_id = g.recording_id AND f.t >= g.win * 30 AND f.t < g.win * 30 + g.length_s) GROUP BY ALL)
GROUP BY length_s
""")
def sliding_robustness(spark, d):
    """Three window lengths from the same panes, with percentiles of medians and of voiced time."""
    from voxrill.operators.audit import window_robustness

    t = A.timeline(spark, d)
    dur = t.groupBy("recording_id").agg(F.max("t").alias("dur"))
    voiced = t.where("kind <> 'view'").select("recording_id", "t", (60 + F.col("value")).alias("f0"))
    out = window_robustness(Q.pane_windows(voiced, dur, REC, [90, 300, 600], 30.0, 3), 85.0, 105.0, 0.5)
    return out.select("length_s", "windows", "computable", "in_band", *r6(*[f"{m}_p{p}" for m in "mv" for p in (10, 25, 50, 75, 90)]))
