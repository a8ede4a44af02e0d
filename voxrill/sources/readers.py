"""Source formats: aligner text, dictionaries, speaker tables, transcripts, bundles, results.

Each format is a function over a *lines* DataFrame (file, block, pos, line) or a
*paths* DataFrame, so the same rules apply to files and to text held in tables.
``read_lines`` reads files line by line: a file is never loaded whole, and its
splits keep their order through (block, pos).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrill import schemas as SC
from voxrill.functions import dims as D
from voxrill.functions import scalar as S
from voxrill.functions import text as T
from voxrill.operators.ordered import scan

STATS_JSON = "map<string,array<struct<mean:double,stdev:double,median:double,max:double,min:double>>>"


def read_lines(spark: SparkSession, path, glob: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """(file, block, pos, line) of text files below ``path``.

    ``block`` is the byte where the split starts and ``pos`` rises within it.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("encoding", encoding)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"),
    )


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


# --- aligner text ---------------------------------------------------------------------


def sections(lines: DataFrame) -> DataFrame:
    """Body lines with the name of their section.

    A line ending in ``:`` without tabs opens a section (an unknown name thereby
    closes the previous one); lines before the first header have none.
    """
    header = F.col("line").endswith(":") & ~F.col("line").contains("\t")
    out = scan(lines, ["file"], ["block", "pos"], F.col("block"), fills={"section": F.when(header, F.regexp_replace("line", ":$", ""))})
    return out.where(F.col("section").isNotNull() & ~header)


def aligner_words(lines: DataFrame) -> DataFrame:
    c = F.split("line", "\t")
    return sections(lines).where("section = 'Words' AND line <> ''").select(
        "file", "block", "pos", c[0].cast("double").alias("t"), F.get(c, F.lit(1)).alias("word"))


def aligner_phones(lines: DataFrame) -> DataFrame:
    """Phone rows; a malformed time is NULL, a cell with ``--`` is an undefined formant."""
    c = F.split("line", "\t")
    rows = sections(lines).where("section = 'Phonemes'").withColumn("_c", c).where(F.size("_c") >= 3)
    t = F.when(F.col("_c")[0].rlike(r"^-?\d+(?:\.\d+)?$"), F.col("_c")[0].cast("double"))
    f = [S.formant_number(F.get("_c", F.lit(2 + i))).alias(f"f{i}") for i in range(4)]
    return rows.select("file", "block", "pos", t.alias("t"), F.col("_c")[1].alias("phone"), *f)


def multi_ceiling(lines: DataFrame) -> DataFrame:
    """Long rows (file, block, pos, start, phone, f0, ceiling_hz, f1, f2, f3) of the multi-ceiling section."""
    n = len(D.CEILINGS)
    body = sections(lines).where("section = 'Multi-Ceiling-Formants'").where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    rows = body.withColumn("_c", F.split("line", "\t")).where(F.size("_c") >= 3 + 3 * n)
    num = lambda i: S.positive_number(F.col("_c")[i])
    per = F.array(*[
        F.struct(F.lit(hz).alias("ceiling_hz"), *[num(3 + 3 * k + j).alias(f"f{j + 1}") for j in range(3)]) for k, hz in enumerate(D.CEILINGS)
    ])
    return rows.select("file", "block", "pos", num(0).alias("start"), F.col("_c")[1].alias("phone"), num(2).alias("f0"), F.explode(per).alias("_p")).select(
        "file", "block", "pos", "start", "phone", "f0", "_p.*")


def dictionary(lines: DataFrame, lang: str) -> DataFrame:
    """(word, phones): six tab columns for zh/fr/ko, whitespace columns for en; the last entry of a word wins."""
    if lang in ("zh", "fr", "ko"):
        c = F.split("line", "\t")
        rows = lines.where(F.size(c) >= 6).select(c[0].alias("word"), tokens(c[5]).alias("phones"), "block", "pos")
    else:
        c = tokens(F.col("line"))
        rows = lines.where(F.size(c) >= 2).select(c[0].alias("word"), F.slice(c, F.lit(2), F.size(c) - 1).alias("phones"), "block", "pos")
    return rows.groupBy("word").agg(F.max_by("phones", F.struct("block", "pos")).alias("phones"))


def explode_stats(docs: DataFrame, text: str, keys=()) -> DataFrame:
    """Nested statistics JSON text to (keys, phoneme, formant, mean, stdev, median, max, min)."""
    m = docs.select(*keys, F.explode(F.from_json(F.col(text), STATS_JSON)).alias("phoneme", "cells"))
    return m.select(*keys, "phoneme", F.posexplode("cells").alias("formant", "c")).select(*keys, "phoneme", "formant", "c.*")


def weights(docs: DataFrame, text: str, keys=()) -> DataFrame:
    """Weights JSON to three columns; malformed text gives NULL."""
    w = F.from_json(F.col(text), "array<double>")
    return docs.select(*keys, *[F.get(w, F.lit(i)).alias(f"w{i + 1}") for i in range(3)])


# --- speakers and transcripts -------------------------------------------------------------


def speaker_table(lines: DataFrame) -> DataFrame:
    """id age gender accent, whitespace separated, ``#`` comments."""
    c = tokens(F.col("line"))
    return lines.where(~F.col("line").startswith("#") & (F.size(c) >= 4)).select(
        c[0].alias("speaker_id"), c[1].alias("age"), c[2].alias("gender"), c[3].alias("accent"))


def transcript_index(lines: DataFrame) -> DataFrame:
    """``wav<TAB>body`` to the Han text of the body; rows without Han text are dropped."""
    c = F.split("line", "\t", 2)
    rows = lines.where(F.col("line").contains("\t")).select(c[0].alias("utt"), T.han_chars(c[1]).alias("sentence"))
    return rows.where("sentence <> ''")


def interleaved_transcripts(lines: DataFrame) -> DataFrame:
    """``utt.wav<TAB or space>char pinyin char pinyin``: characters only, extension removed."""
    c = F.when(F.col("line").contains("\t"), F.split("line", "\t", 2)).otherwise(F.split("line", r"\s+", 2))
    return lines.where(F.size(c) == 2).select(F.regexp_replace(c[0], r"\.wav$", "").alias("utt"), T.even_tokens(c[1]).alias("sentence"))


def gender_list(lines: DataFrame) -> DataFrame:
    """``id gender`` with bare or S-prefixed ids."""
    c = tokens(F.col("line"))
    sid = F.when(c[0].startswith("S"), c[0]).otherwise(F.concat(F.lit("S"), c[0]))
    return lines.where(F.size(c) >= 2).select(sid.alias("speaker_id"), F.when(F.upper(c[1]).startswith("F"), "F").otherwise("M").alias("sex"))


def spaced_transcripts(lines: DataFrame) -> DataFrame:
    """``utt char char ...`` to (utt, speaker, joined text)."""
    c = F.split(F.trim("line"), r"\s+", 2)
    return lines.where(F.size(c) == 2).select(c[0].alias("utt"), utt_speaker(c[0]).alias("speaker_id"), F.replace(c[1], F.lit(" "), F.lit("")).alias("sentence"))


def utt_speaker(utt: Column) -> Column:
    """Speaker part of an utterance id: optional BAC009, then up to ``W``; S-prefixed."""
    core = F.regexp_extract(utt, "^(?:BAC009)?([^W]*)", 1)
    return F.when(core.startswith("S"), core).otherwise(F.concat(F.lit("S"), core))


def pipe_speakers(lines: DataFrame, subset: str | None = None) -> DataFrame:
    """``id | sex | subset | ...`` with ``;`` comments; only F and M speakers (of ``subset``)."""
    c = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = lines.where(~F.col("line").startswith(";") & (F.size(c) >= 3)).select(c[0].alias("speaker_id"), c[1].alias("sex"), c[2].alias("subset"))
    rows = rows.where("sex IN ('F', 'M')")
    if subset is not None:
        rows = rows.where(F.col("subset") == subset)
    return rows.select("speaker_id", F.when(F.col("sex") == "F", "female").otherwise("male").alias("gender"))


def chapter_transcripts(lines: DataFrame) -> DataFrame:
    """``utt sentence`` per line; the speaker is the folder that holds the file."""
    c = F.split("line", " ", 2)
    rows = lines.where(F.size(c) == 2).select("file", c[0].alias("utt"), F.trim(c[1]).alias("sentence"))
    return rows.where("utt <> '' AND sentence <> ''").select(F.element_at(F.split("file", "/"), -2).alias("speaker_id"), "utt", "sentence", "file")


def header_speakers(lines: DataFrame) -> DataFrame:
    """``SPEAKERID|NAME|SEX|...`` with a header row and m/f labels."""
    c = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    sex = F.lower(c[2])
    return lines.where((F.size(c) >= 3) & sex.isin("m", "f")).select(c[0].alias("speaker_id"), F.when(sex == "m", "male").otherwise("female").alias("gender"))


def tree_corpus(speaker_lines: DataFrame, transcript_lines: DataFrame) -> DataFrame:
    """Tree-walk corpus: transcripts of gender-labelled speakers with their audio path."""
    t = chapter_transcripts(transcript_lines)
    path = F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("utt"), F.lit(".flac"))
    return t.join(header_speakers(speaker_lines), "speaker_id").select("speaker_id", "gender", "utt", "sentence", path.alias("path"))


def load_index(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Corpus index by layout name: ``cv`` (crowd TSV) or ``tree``."""
    if layout == "cv":
        return crowd_rows(read_tsv(spark, f"{path}/validated.tsv", SC.CROWD))
    if layout == "tree":
        return tree_corpus(read_lines(spark, f"{path}/AUDIO_INFO"), read_lines(spark, path, "*.trans.txt"))
    raise ValueError(f"unknown corpus layout: {layout}")


def read_tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tab-separated file with a header and literal quotes."""
    return spark.read.option("sep", "\t").option("quote", "").option("header", "true").schema(schema).csv(path)


def crowd_rows(raw: DataFrame) -> DataFrame:
    """Crowd-corpus rows with a known gender, a path, a sentence and a speaker."""
    t = {c: F.trim(c) for c in ("client_id", "path", "sentence")}
    rows = raw.select(*[v.alias(k) for k, v in t.items()], S.normalize_gender(F.col("gender")).alias("gender"))
    return rows.where("gender IS NOT NULL AND path <> '' AND sentence <> '' AND client_id <> ''")


def clip_durations(raw: DataFrame) -> DataFrame:
    """(path, duration_ms) from text columns; rows without a whole number are skipped."""
    return raw.select(F.col("clip").alias("path"), F.col("duration").try_cast("bigint").alias("duration_ms")).dropna()


def list_clips(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length) of audio files; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return r.load(path).select("path", "length")


def clips_from_paths(paths: DataFrame, speaker_depth: int = -2) -> DataFrame:
    """(path, speaker_id, split, utt) from the directory layout .../<split>/wav/<speaker>/<utt>.<ext>."""
    p = F.split("path", "/")
    return paths.select(
        "path", F.element_at(p, speaker_depth).alias("speaker_id"), F.try_element_at(p, F.lit(speaker_depth - 2)).alias("split"),
        F.regexp_replace(F.element_at(p, -1), r"\.[^.]*$", "").alias("utt"))


# --- observations, results, bundles ----------------------------------------------------------


def observations(lines: DataFrame) -> DataFrame:
    """JSON lines (phoneme, F) to wide rows; blank and corrupt lines are skipped."""
    o = F.from_json("line", "phoneme string, F array<double>, audio_path string")
    ok = lines.where(F.trim("line") != "").withColumn("_o", o).where(F.col("_o.phoneme").isNotNull())
    return ok.select("_o.audio_path", "_o.phoneme", *[F.get("_o.F", F.lit(i)).alias(f"f{i}") for i in range(4)])


RESULT_JSON = "medianResonance double, meanResonance double, phones array<struct<phoneme:string,expected:string,F:array<double>,resonance:double>>"


def read_results(spark: SparkSession, path: str, key: str, pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """(key, raw): one result file per session below ``path``, its name (or what ``pattern`` finds in its path) as the key.

    Files are read whole, broken ones too, so that ``join_results`` can tell them from missing ones. Spark passes
    over files of no bytes at all, so those count as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = F.regexp_extract(F.url_decode("path"), pattern, 1)
    return files.select(found.alias(key), F.col("content").cast("string").alias("raw")).where(F.col(key) != "")


def join_results(manifest: DataFrame, raw: DataFrame, key: str, text: str) -> DataFrame:
    """Manifest rows with their parsed result and the reason where there is none."""
    parsed = F.from_json(F.col(text), RESULT_JSON, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json(F.col(text)).isNull()
    out = manifest.join(raw, key, "left").withColumn("result", parsed)
    reason = (
        F.when(F.col(text).isNull(), "no raw json").when(bad, "json decode")
        .when(F.coalesce(F.size("result.phones"), F.lit(0)) <= 0, "zero phones")
    )
    return out.withColumn("reason", reason).drop(text)


def bundle_key(path: Column) -> tuple[Column, Column]:
    """(lang, sex) from .../<lang>/sessions/<sex>/session_*.vga.json or .../part_lang=<lang>/part_sex=<sex>/."""
    forms = (r"/([^/]+)/sessions/([FM])/[^/]*$", r"/part_lang=([^/]+)/part_sex=([FM])/[^/]*$")
    found = [[F.nullif(F.regexp_extract(path, p, i), F.lit("")) for p in forms] for i in (1, 2)]
    return F.coalesce(*found[0]), F.coalesce(*found[1])


def read_bundles(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """Session bundles below ``path`` with their language and sex.

    ``layout="files"``: one document per file, <lang>/sessions/<sex>/ as folders.  ``layout="lines"``: one
    document per line, as ``write_bundles`` leaves them.  Language and sex come from the document, else from
    the folder.
    """
    r = spark.read.schema(SC.BUNDLE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    if layout == "files":
        r = r.option("multiLine", "true")
    elif layout != "lines":
        raise ValueError(f"unknown bundle layout: {layout}")
    b = r.json(path).withColumn("file", F.col("_metadata.file_path"))
    lang, sex = bundle_key(F.col("file"))
    return b.withColumn("lang", F.coalesce("calibration_meta.lang", lang)).withColumn("sex", F.coalesce("calibration_meta.sex", sex))


def bundle_sessions(bundles: DataFrame) -> DataFrame:
    """Calibration fields of the first session of each bundle."""
    ec = F.col("payload.sessions")[0]["summary"]["engine_c"]
    return bundles.select(
        "lang", "sex", ec["median_resonance"].alias("median_resonance"), ec["median_pitch_hz"].alias("median_pitch"),
        F.coalesce(ec["alignment_confidence"]["low_quality"], F.lit(False)).alias("low_quality"), ec["resonance_per_vowel"].alias("vowels"))


# --- fixed values: import limits ----------------------------------------------------------
EXPORT_VERSION = "1"
MAX_SESSIONS = 100
MAX_AUDIO_B64 = 30 * 1024 * 1024


def check_imports(docs: DataFrame, text: str, key: str, max_audio: int = MAX_AUDIO_B64) -> tuple[DataFrame, DataFrame]:
    """(sessions, rejects) of import files held as text.

    A file is rejected whole, with a reason, for broken JSON, a wrong version,
    no sessions, more than the allowed number, or a session without summary or
    analysis.  An oversize inline audio is dropped but its session stays.
    """
    b = docs.withColumn("_ok", F.try_parse_json(F.col(text)).isNotNull()).withColumn("_b", F.from_json(F.col(text), SC.IMPORT))
    s = F.col("_b.payload.sessions")
    reason = (
        F.when(~F.col("_ok"), "parse").when(~F.coalesce(F.col("_b.export_schema_version") == EXPORT_VERSION, F.lit(False)), "schema")
        .when(F.coalesce(F.size(s), F.lit(0)) <= 0, "malformed").when(F.size(s) > MAX_SESSIONS, "too_many")
        .when(F.exists(s, lambda x: x["summary"].isNull() | x["analysis"].isNull()), "malformed")
    )
    b = b.withColumn("reason", reason)
    rejects = b.where("reason IS NOT NULL").select(key, "reason")
    exported = F.unix_millis(F.try_to_timestamp(F.col("_b.exported_at")))
    good = b.where("reason IS NULL").select(key, exported.alias("_x"), F.posexplode(s).alias("idx", "s"))
    fits = F.coalesce(F.length("s.audio.base64"), F.lit(0)) <= max_audio
    out = good.select(
        key, "idx", F.coalesce(F.nullif("s.filename", F.lit("")), F.lit("imported")).alias("filename"), "s.summary", "s.analysis",
        S.first_positive(F.col("s.created_at"), F.col("s.audio.last_modified"), F.col("_x")).alias("created_at"),
        F.when(fits, F.col("s.audio.base64")).alias("audio"))
    return out, rejects


def word_timings(text: Column) -> Column:
    """JSON array of {word, start, end}; NULL unless it is an array of objects."""
    return F.from_json(text, "array<struct<word:string,start:double,end:double>>")


# --- names -------------------------------------------------------------------------------------


def name_speaker(name: Column) -> Column:
    """corpus:speaker of ``{m|f}_{corpus}_{speaker}_{utterance}``, else NULL."""
    p = F.split(name, "_", 4)
    return F.when((F.size(p) == 4) & p[0].isin("m", "f"), F.concat_ws(":", p[1], p[2]))


# --- fixed values: file-name patterns that carry a speaker --------------------------------------
FILE_PATTERNS = [
    ("^cmu_arctic_([a-z]+)_", "cmu_arctic_"),
    (r"^vctk_(p\d+|s\d+)_", "vctk_"),
    ("^test_([a-z]+)", "test_"),
    ("^synth_([a-z]+)_", "synth_"),
]


def file_speaker(stem: Column) -> Column:
    """Speaker from a file name; an unknown pattern is its own speaker."""
    found = []
    for pat, prefix in FILE_PATTERNS:
        found.append(F.when(stem.rlike(pat), F.concat(F.lit(prefix), F.regexp_extract(stem, pat, 1))))
    return F.coalesce(*found, stem)
