"""Rules that judge a transcript: issues with penalties, gates with reasons, review evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Penalty of each issue. Fixed values.
PENALTIES = {
    "empty_text_while_speech_present": 0.35,
    "long_text_during_silence": 1.0,
    "repeated_3_to_10_token_ngram": 0.2,
    "shortest_loop_period_detected": 0.3,
    "characters_per_voiced_second_exceeded": 1.0,
    "decode_prefix_novelty_stalled": 0.2,
    "abnormally_compressible_repetition": 0.3,
    "repeated_sentence": 0.4,
    "unicode_replacement_character": 1.0,
    "consecutive_question_placeholders": 0.8,
    "illegal_control_character": 1.0,
    "manual_language_script_mismatch": 1.0,
    "abnormal_punctuation_density": 0.2,
    "unpaired_parenthesis_or_quote": 0.15,
    "missing_sentence_end_punctuation": 0.05,
    "numeric_or_unit_anomaly": 0.25,
    "low_word_timestamp_coverage": 0.25,
    "non_monotonic_word_timestamps": 1.0,
    "word_timestamp_outside_request": 1.0,
    "excessive_adjacent_word_overlap": 1.0,
    "speech_continues_after_text_timestamps_end": 0.35,
    "text_length_and_voiced_duration_mismatch": 0.35,
    "suspected_course_terminology_error": 0.2,
    "primary_and_structure_text_diverge": 0.25,
    "low_snr": 0.2,
    "far_field_audio": 0.2,
    "low_calibrated_quality": 0.35,
}
#: Issues of repetition, and those that reject a candidate outright. Fixed values.
REPETITION = ["repeated_3_to_10_token_ngram", "shortest_loop_period_detected", "decode_prefix_novelty_stalled", "abnormally_compressible_repetition", "repeated_sentence"]
HARD = [
    "long_text_during_silence", "characters_per_voiced_second_exceeded", "unicode_replacement_character", "consecutive_question_placeholders", "illegal_control_character",
    "manual_language_script_mismatch", "non_monotonic_word_timestamps", "word_timestamp_outside_request", "excessive_adjacent_word_overlap",
]
#: The issue that a loop excuses, as a loop itself makes text dense. Fixed value.
EXCUSED = "characters_per_voiced_second_exceeded"
MARKS, TERMINATORS = r"[.,!?;:。、！？；：「」『』（）()\[\]{}“”‘’\"]", r"[.!?。！？]\z"
NUMERIC_ANOMALY = r"(?i)(?:\d{8,}|(?:\b(?:kg|mg|ml|km|cm|mm|hz|khz|mhz|gb|mb)\b\s*){3,})"
PAIRED = [("(", ")"), ("（", "）"), ("[", "]"), ("{", "}"), ("「", "」"), ("『", "』")]


def found(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def text_rules(text: Column, voiced_seconds: Column, mismatch: Column) -> dict[str, Column]:
    """Issues that a text shows by itself and against the seconds of speech that it stands for."""
    visible = F.regexp_replace(text, r"(?U)\s", "")
    n = F.length(visible)
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    uneven = reduce(lambda a, b: a | b, (count(a) != count(b) for a, b in PAIRED))
    return {
        "unicode_replacement_character": F.contains(text, F.lit("�")),
        "consecutive_question_placeholders": F.contains(text, F.lit("??")),
        "illegal_control_character": F.regexp_like(text, F.lit(r"[\p{Cc}&&[^\n\t]]")),
        "manual_language_script_mismatch": mismatch,
        "abnormal_punctuation_density": (n >= 8) & (F.regexp_count(visible, F.lit(MARKS)) / F.greatest(n, F.lit(1)) > 0.35),
        "unpaired_parenthesis_or_quote": uneven,
        "missing_sentence_end_punctuation": (n >= 12) & ~F.regexp_like(visible, F.lit(TERMINATORS)),
        "numeric_or_unit_anomaly": F.regexp_like(text, F.lit(NUMERIC_ANOMALY)),
        "text_length_and_voiced_duration_mismatch": (voiced_seconds >= 4) & (text != "") & (n / F.greatest(voiced_seconds, F.lit(0.1)) < 0.25),
    }


def acoustic_rules(text: Column, voiced_seconds: Column, speech_ratio: Column, no_speech: Column, snr: Column, far: Column) -> dict[str, Column]:
    """Issues of a text against what is known of its sound; a null probability or ratio proves nothing."""
    n = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return {
        "empty_text_while_speech_present": (voiced_seconds >= 1) & (n == 0),
        "long_text_during_silence": (n >= 8) & (speech_ratio < 0.05) & F.coalesce(no_speech >= 0.8, F.lit(True)),
        "low_snr": F.coalesce(snr < 10, F.lit(False)),
        "far_field_audio": far,
    }


def timing_rules(monotonic: Column, inside: Column, overlap: Column, spoken: Column, coverage: Column, voiced_seconds: Column, late_uncovered: Column) -> dict[str, Column]:
    """Issues of word times: spans of words overlap by `overlap` of `spoken` units, and cover a share of the speech."""
    return {
        "non_monotonic_word_timestamps": ~monotonic,
        "word_timestamp_outside_request": ~inside,
        "excessive_adjacent_word_overlap": (spoken > 0) & (overlap / F.greatest(spoken, F.lit(1)) > 0.25),
        "low_word_timestamp_coverage": (voiced_seconds >= 2) & (coverage < 0.45),
        "speech_continues_after_text_timestamps_end": late_uncovered,
    }


def gate_score(issues: Column, calibrated: Column) -> Column:
    """One less the penalties of the issues, 0 at least, and no more than a calibrated quality if there is one."""
    table = F.create_map(*(F.lit(x) for pair in PENALTIES.items() for x in pair))
    left = F.greatest(F.lit(0.0), 1 - F.aggregate(issues, F.lit(0.0), lambda s, i: s + F.element_at(table, i)))
    return F.round(F.least(left, F.coalesce(calibrated, F.lit(1.0))), 6)


def blocked(issues: Column) -> Column:
    """Whether an issue rejects the candidate; density doesn't if there is repetition, which explains it."""
    hard = F.array_intersect(issues, F.array(*map(F.lit, HARD)))
    repeats = F.arrays_overlap(issues, F.array(*map(F.lit, REPETITION)))
    return F.size(F.when(repeats, F.array_remove(hard, EXCUSED)).otherwise(hard)) > 0


def alignment_reasons(seconds: Column, safe_seconds: Column, coverage: Column, voiced_seconds: Column, issues: Column, text: Column, language: Column, heard: Column) -> Column:
    """Why a text may not be aligned with its sound; none for a safe one. Bounds, names, languages, and which issues forbid."""
    has = lambda names: F.arrays_overlap(issues, F.array(*map(F.lit, names)))
    loops = ["repeated_3_to_10_token_ngram", "shortest_loop_period_detected", "decode_prefix_novelty_stalled"]
    missing = ["empty_text_while_speech_present", "speech_continues_after_text_timestamps_end"]
    unsafe = [
        *missing, *loops, "characters_per_voiced_second_exceeded", "unicode_replacement_character", "consecutive_question_placeholders", "illegal_control_character",
        "manual_language_script_mismatch", "text_length_and_voiced_duration_mismatch",
    ]
    ratio = F.when(voiced_seconds > 0, F.length(F.regexp_replace(text, r"(?U)\s", "")) / voiced_seconds).otherwise(0.0)
    return found(
        {
            "segment_reaches_safe_duration_limit": seconds >= F.least(F.lit(30.0), safe_seconds),
            "transcript_coverage_unreasonable": ~coverage.between(0.5, 1.0),
            "decode_loop_present": has(loops),
            "missing_text_present": has(missing),
            "abnormal_character_or_quality_signal": has(unsafe) | (voiced_seconds <= 0),
            "language_mismatch": ~(language.eqNullSafe(heard) & F.coalesce(language.isin("zh", "ja", "en"), F.lit(False))),
            "text_to_voiced_duration_ratio_abnormal": ~ratio.between(0.2, 24.0),
            "empty_final_text": F.trim(text) == "",
        }
    )


def reliability(error_rate: Column) -> Column:
    """A model's reliability from its error rate, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - error_rate))
