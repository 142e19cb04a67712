"""Schemas of the data model, as Spark DDL."""

TABLE = "columns ARRAY<STRING>, data ARRAY<ARRAY<STRING>>"
METADATA = "table_id STRING, source STRING, original_metadata VARIANT, dimensions STRUCT<rows INT, columns INT>, schema STRUCT<columns ARRAY<STRING>, dtypes MAP<STRING, STRING>>"
QUALITY = "table_id STRING, lang_code STRING, bleu_score DOUBLE, threshold DOUBLE, decision STRING"
QA_PAIR = "question_id STRING, table_id STRING, question_type STRING, question STRING, answer ARRAY<ARRAY<STRING>>, evidence_cells ARRAY<STRING>, reasoning_category STRING"
SCORES = "category STRING, tables ARRAY<STRUCT<file: STRING, score: INT>>"

# Languages of table translation, and those of questions (all but the second list).
LANGUAGES = [
    "ar", "id_casual", "id_formal", "jv_krama", "jv_ngoko", "su_loma", "tl", "bn", "cs", "en", "es", "fr", "hi", "it",
    "mr", "ru_casual", "ru_formal", "sc", "si_formal_spoken", "ja_casual", "ja_formal", "ko_casual", "ko_formal", "th",
    "yo", "nan", "nan_spoken", "yue", "zh_cn", "az",
]
TRANSLATION_ONLY = ["ru_casual", "ja_casual", "ko_casual", "yo", "nan_spoken", "yue"]
QA_LANGUAGES = [x for x in LANGUAGES if x not in TRANSLATION_ONLY]

# Categories and types of questions.
REASONING = ["Comparative Reasoning", "Numerical Aggregation", "Multi-Hop Reasoning", "Temporal Reasoning", "Conditional Reasoning", "Proportional/Ratio Analysis", "Hypothetical Reasoning", "Correlation Inference", "Structural/Metadata Reasoning", "Outlier Detection"]
QUESTION_TYPES = ["value", "open_ended_reasoning"]
