"""Explicit schemas of the table and document formats (nothing is inferred)."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()

CROWD = _struct(client_id=S, path=S, sentence=S, gender=S)
CLIP_DURATIONS = _struct(clip=S, duration=S)

SEGMENT = _struct(label=S, start_time=D, end_time=D, duration=D, confidence=D, confidence_frames=T.ArrayType(D))
VOWEL = _struct(
    vowel=S, n=L, is_vowel=B, resonance_med=D, z_F1_med=D, z_F2_med=D, z_F3_med=D, F1_med_hz=D, F2_med_hz=D, F3_med_hz=D,
)
ENGINE = _struct(
    median_resonance=D, median_pitch_hz=D, language=S, transcript=S, script=S,
    alignment_confidence=_struct(phone_ratio=D, coverage=D, low_quality=B), resonance_per_vowel=T.ArrayType(VOWEL),
)
SUMMARY = _struct(engine_c=ENGINE, overall_gender_score=D, dominant_label=S)
SESSION = _struct(
    filename=S, summary=SUMMARY, analysis=T.ArrayType(SEGMENT), created_at=L, audio=_struct(base64=S, mime=S, last_modified=L),
)
BUNDLE = _struct(
    export_schema_version=S, exported_at=S, payload=_struct(sessions=T.ArrayType(SESSION)),
    calibration_meta=_struct(lang=S, sex=S, spk_id=S, session_id=S, duration_sec=D, transcript_len_chars=L),
)
IMPORT = BUNDLE

PROGRESS = _struct(task_id=L, ts=T.TimestampType(), type=S, pct=I, msg_key=S, msg_params=S)
OBSERVATION = _struct(audio_path=S, ts=T.TimestampType(), phoneme=S, f0=D, f1=D, f2=D, f3=D)
