"""Column names, schemas and label tables shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "doc_id"
LABEL = "label"

# The 21 numeric features of the processed table, in file order.
FEATURES = [
    "adjective_count",
    "adverb_count",
    "noun_count",
    "verb_count",
    "flesch_reading_ease",
    "flesch_kincaid_grade_level",
    "gunning_fog_scale",
    "coleman_liau_index",
    "linsear_write_formula",
    "dale_chall_readability",
    "mcalpine_eflaw_readability",
    "reading_time",
    "syllable_count",
    "lexicon_count",
    "polysyllable_count",
    "monosyllable_count",
    "conjunction_count",
    "pronoun_count",
    "stopword_count",
    "present_tense_count",
    "past_tense_count",
]
COLUMNS = ["text", *FEATURES, LABEL]

# Six truth grades and their ordinal codes.
TRUTH_LABELS = {
    "true": 0,
    "mostly-true": 1,
    "half-true": 2,
    "barely-true": 3,
    "false": 4,
    "pants-fire": 5,
}
BINARY_LABELS = {"real": 0, "fake": 1}

FEATURE_SCHEMA = T.StructType(
    [T.StructField("text", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [T.StructField(LABEL, T.IntegerType())]
)

# Names follow the format note of the statement files, not the shifted names
# some readers of that format use for columns 9-14.
STATEMENT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "id",
            "label",
            "statement",
            "subjects",
            "speaker",
            "speaker_job_title",
            "state_info",
            "party_affiliation",
        )
    ]
    + [
        T.StructField(name, T.IntegerType())
        for name in (
            "barely_true_counts",
            "false_counts",
            "half_true_counts",
            "mostly_true_counts",
            "pants_on_fire_counts",
        )
    ]
    + [T.StructField("context", T.StringType())]
)
