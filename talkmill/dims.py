"""Word lists, thresholds, language tables, formats.

Everything in this module must be equal to the published behaviour for results to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# -- fixed values: audio event categories ----------------------------------------------
DIALOGUE = "DIALOGUE"
VOCAL = "VOCAL_NON_SPEECH"
MUSIC = "MUSIC"
SFX = "SFX"
BACKGROUND = "BACKGROUND"
SILENCE = "SILENCE"
UNKNOWN = "UNKNOWN"
CATEGORIES = [DIALOGUE, VOCAL, MUSIC, SFX, BACKGROUND, SILENCE, UNKNOWN]

# Inclusive label-index ranges of the 527-label sound ontology; all others are SFX.
LABEL_COUNT = 527
LABEL_RANGES = [
    (DIALOGUE, 0, 5), (DIALOGUE, 7, 8), (DIALOGUE, 11, 11), (DIALOGUE, 15, 15),
    (VOCAL, 6, 6), (VOCAL, 9, 10), (VOCAL, 12, 14), (VOCAL, 16, 26), (VOCAL, 37, 50),
    (MUSIC, 27, 36), (MUSIC, 137, 282),
    (BACKGROUND, 68, 71), (BACKGROUND, 283, 299), (BACKGROUND, 506, 526),
    (SILENCE, 500, 500),
]

# -- fixed values: transcript validation -----------------------------------------------
STOCK_PHRASES = [
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "ありがとうございました",
    "チャンネル登録お願いします",
    "チャンネル登録よろしくお願いします",
    "最後までご視聴いただきありがとうございました",
    "字幕作成者",
    "시청해주셔서감사합니다",
    "구독과좋아요부탁드립니다",
    "다음영상에서만나요",
    "감사합니다",
    "아멘",
    "thankyouforwatching",
    "thanksforwatching",
    "pleasesubscribe",
    "subtitlesbytheamaraorgcommunity",
    "subtitlesby",
]
CREDIT_PATTERN = r"(?i)(자막\s*(by|제공)|字幕\s*[:：by]|subtitles?\s+by|captions?\s+by)"

# -- fixed values: segmentation profiles -----------------------------------------------
TERMINATORS = ".!?。！？…‥"
SOFT_BREAKS = ",、，;；:："
CLOSING_MARKS = ".,!?;:)]}%'\"、。！？」』）"
JA_ENDINGS = ["です", "ます", "ました", "ません", "でした", "だった", "ですね", "ますね",
              "でしょう", "ましょう", "ください", "だよ", "だね", "かな", "のだ", "んだ"]
KO_ENDINGS = ["습니다", "ㅂ니다", "습니까", "예요", "에요", "이에요", "아요", "어요",
              "해요", "네요", "지요", "죠", "는데요", "거든요", "잖아요", "십시오"]
# language: pause ms, minimum chars, maximum chars, maximum seconds, wait for endings, endings
PROFILES = {
    "default": (700, 12, 220, 8.0, False, []),
    "en": (600, 14, 240, 7.0, False, []),
    "ja": (900, 8, 90, 9.0, True, JA_ENDINGS),
    "ko": (900, 10, 110, 9.0, True, KO_ENDINGS),
    "zh": (800, 8, 90, 8.0, False, []),
    "hi": (650, 12, 220, 8.0, False, []),
}
# latency: (factor on waiting times, factor on lengths)
LATENCIES = {"low_latency": (0.6, 0.55), "balanced": (1.0, 1.0), "accurate": (1.6, 1.5)}

# -- fixed values: honorifics ----------------------------------------------------------
JA_HONORIFICS = {
    "さん": "-san", "君": "-kun", "くん": "-kun", "ちゃん": "-chan", "様": "-sama",
    "さま": "-sama", "先生": "-sensei", "先輩": "-senpai", "殿": "-dono",
}
KO_HONORIFICS = {
    "선배": "-seonbae", "후배": "-hubae", "언니": "-unnie", "오빠": "-oppa",
    "누나": "-noona", "형": "-hyung",
}
TITLES = r"Mr\.?|Mrs\.?|Ms\.?|Miss|Master|Sir|Madam|Teacher|Professor"
NAME = r"[A-Z][A-Za-z'’-]+"

# -- fixed values: languages -----------------------------------------------------------
LANGUAGE_NAMES = {
    "auto": "Auto-detect",
    "en": "English", "ja": "Japanese", "ko": "Korean", "zh": "Chinese",
    "hi": "Hindi", "mr": "Marathi", "ta": "Tamil", "te": "Telugu",
    "bn": "Bengali", "gu": "Gujarati", "kn": "Kannada", "ml": "Malayalam",
    "pa": "Punjabi", "ur": "Urdu", "as": "Assamese", "or": "Odia",
    "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese",
    "ru": "Russian", "ar": "Arabic",
}
PROMPT_LANGUAGES = ["en", "ja", "ko", "hi", "zh", "mr", "ta", "te", "bn", "es", "fr", "de",
                    "pt", "ru", "ar"]
NATIVE_NAMES = {
    "en": "English", "ja": "日本語", "ko": "한국어", "zh": "中文",
    "hi": "हिन्दी", "mr": "मराठी", "ta": "தமிழ்", "te": "తెలుగు",
    "bn": "বাংলা", "gu": "ગુજરાતી", "kn": "ಕನ್ನಡ", "ml": "മലയാളം",
    "pa": "ਪੰਜਾਬੀ", "ur": "اردو",
}
PAIRS = [("ja", "en", 1), ("ko", "en", 1), ("en", "hi", 1),
         ("en", "ja", 2), ("en", "ko", 2), ("en", "mr", 2), ("en", "ta", 2),
         ("en", "te", 2), ("en", "bn", 2)]
ISO_639_2 = {"en": "eng", "ja": "jpn", "ko": "kor", "hi": "hin", "zh": "zho", "es": "spa",
             "fr": "fra", "de": "deu"}
UNSPACED = ["ja", "zh", "ko", "th"]

# -- fixed values: jobs ----------------------------------------------------------------
STAGE_SPANS = {
    "queued": (0, 0), "preprocessing": (0, 5), "speech_detection": (5, 15),
    "transcribing": (15, 45), "translating": (45, 62), "synthesizing": (62, 92),
    "rendering": (92, 100), "completed": (100, 100),
}
TERMINAL = ["completed", "failed", "cancelled"]
JOB_INPUT_FIELDS = ["filename", "source_language", "target_language", "engine",
                    "output_format", "audio_mode", "subtitle_enabled",
                    "translation_quality", "voice"]

# -- fixed values: media types ---------------------------------------------------------
MEDIA_TYPES = {".wav": "wav", ".mp3": "mp3", ".m4a": "isobmff", ".flac": "flac",
               ".ogg": "ogg", ".mp4": "isobmff", ".mov": "isobmff", ".mkv": "matroska",
               ".webm": "matroska"}

# -- fixed values: translation prompt --------------------------------------------------
PROMPT_TEMPLATE = """You are a professional audiovisual translator working on {src} to {tgt} dialogue (subtitles and dubbing).

Rules:
- Translate ONLY the text inside <current>. The <context> lines are earlier dialogue, given so you can resolve omitted subjects, pronouns, references and tone. Never translate or repeat them.
- Preserve meaning, tone, register and politeness level. Keep slang as slang and render idioms with a natural {tgt} equivalent instead of word-for-word.
- Restore subjects or objects the {src} omits only when the context makes them clear; do not invent information that is not implied.
- Do not add explanations, notes, alternatives, romanization or quotation marks.
- {honorifics}
- Use the glossary translations exactly as given when the source term appears.
- Keep names and terminology consistent with the earlier translations.
{style}
Output only the {tgt} translation of the current line."""
POLICY_TEXT = {
    "preserve_honorifics":
        "Keep honorifics attached to names in romanized form ({examples}), "
        "e.g. 'Tanaka-san', instead of replacing them with Mr./Ms.",
    "remove": "Drop honorific suffixes and titles; use bare names.",
    "natural_english":
        "Render honorifics naturally in the target language (e.g. Mr./Ms./teacher, or "
        "nothing) while keeping the politeness level and relationship they imply.",
}

# -- fixed values: report sections -----------------------------------------------------
REPORT_COLUMNS = {
    "asr": [("Model", "model"), ("Items", "items"), ("WER", "wer"), ("CER", "cer"),
            ("Halluc. rate", "hallucination_rate"), ("P50 s", "latency.p50"),
            ("P95 s", "latency.p95"), ("RTF", "rtf"), ("Load s", "load_seconds"),
            ("Peak RSS GB", "resources.peak_rss_gb")],
    "translation": [("Model", "model"), ("Items", "items"), ("BLEU", "bleu"),
                    ("chrF", "chrf"), ("COMET", "comet"), ("P50 s", "latency.p50"),
                    ("P95 s", "latency.p95"), ("chars/s", "chars_per_second"),
                    ("Peak RSS GB", "resources.peak_rss_gb")],
    "tts": [("Model", "model"), ("Items", "items"), ("RTF", "rtf"), ("P50 s", "latency.p50"),
            ("Round-trip WER", "roundtrip_wer"), ("Round-trip CER", "roundtrip_cer"),
            ("Load s", "load_seconds"), ("Peak RSS GB", "resources.peak_rss_gb")],
    "engine": [("Engine", "engine"), ("Item", "id"), ("Status", "status"), ("BLEU", "bleu"),
               ("chrF", "chrf"), ("Wall s", "wall_seconds"), ("RTF", "rtf"),
               ("Duration ratio", "duration_ratio"),
               ("Silence ratio", "output_audio.silence_ratio"),
               ("Peak RSS GB", "resources.peak_rss_gb")],
    "realtime": [("Engine", "engine"), ("Item", "id"), ("TTFT s", "ttft"), ("TTFA s", "ttfa"),
                 ("Seg P50 s", "segment_latency.p50"), ("Seg P95 s", "segment_latency.p95"),
                 ("Segments", "segments")],
}


def profile(language: str, latency: str = "balanced") -> dict:
    """One segmentation profile, scaled for a latency preference."""
    pause, shortest, longest, seconds, wait, endings = PROFILES[language]
    on_time, on_length = LATENCIES[latency]
    return {
        "language": language, "latency": latency,
        "pause_threshold_ms": int(pause * on_time),
        "minimum_stable_chars": max(1, int(shortest * on_length)),
        "max_chars": max(16, int(longest * on_length)),
        "max_seconds": round(seconds * on_time, 2),
        "punctuation_flush": True, "sentence_final_bias": wait, "endings": list(endings),
    }


def lang_profiles(spark: SparkSession, extra: list[dict] | None = None) -> DataFrame:
    """The profile dimension; rows in ``extra`` replace built-in ones of the same key."""
    rows = {(r["language"], r["latency"]): r
            for r in [profile(lang, lat) for lang in PROFILES for lat in LATENCIES]
            + list(extra or [])}
    return spark.createDataFrame(list(rows.values()), (
        "language string, latency string, pause_threshold_ms int, minimum_stable_chars int, "
        "max_chars int, max_seconds double, punctuation_flush boolean, "
        "sentence_final_bias boolean, endings array<string>"))


def label_categories(spark: SparkSession) -> DataFrame:
    """Label index -> category, expanded from the ranges; unlisted labels are SFX."""
    from pyspark.sql import functions as F

    ranges = spark.createDataFrame(LABEL_RANGES, "category string, first int, last int")
    listed = ranges.select("category", F.explode(F.sequence("first", "last")).alias("label"))
    return (spark.range(LABEL_COUNT).select(F.col("id").cast("int").alias("label"))
            .join(F.broadcast(listed), "label", "left")
            .select("label", F.coalesce("category", F.lit(SFX)).alias("category")))


def languages(spark: SparkSession) -> DataFrame:
    rows = [(code, name, NATIVE_NAMES.get(code)) for code, name in LANGUAGE_NAMES.items()]
    return spark.createDataFrame(rows, "code string, name string, native_name string")


def language_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "source string, target string, tier int")


def stage_spans(spark: SparkSession) -> DataFrame:
    rows = [(stage, float(a), float(b)) for stage, (a, b) in STAGE_SPANS.items()]
    return spark.createDataFrame(rows, "stage string, span_from double, span_to double")
