"""Column types of the tables the engine reads and writes."""

from __future__ import annotations

# input column -> type it is cast to; names are matched case-insensitively
ADMISSIONS = {"subject_id": "bigint", "hadm_id": "string", "admittime": "timestamp"}
NOTE_IDS = {"subject_id": "bigint", "hadm_id": "string"}
LABELS = {"subject_id": "bigint", "readm": "int"}
TEXT_VARIANTS = ("text", "term", "cui")
