"""Schemas, enumerations and special tokens of the sentence/formula corpus."""

from __future__ import annotations

from pyspark.sql import types as T

# Connectors, complexity classes, special tokens in order of id.
CONNECTORS = ("¬", "∧", "∨", "→", "↔")
COMPLEXITY = ("simple", "intermediate", "advanced")
RANK = {"simple": 0, "intermediate": 1, "advanced": 2}
UNKNOWN_RANK = 99
SPECIAL_TOKENS = ("<|pad|>", "<|bos|>", "<|eos|>", "<|unk|>", "<|input|>", "<|output|>", "<|thought|>", "<|atoms|>", "<|connectors|>", "<|formula|>")
BOS, EOS, INPUT, THOUGHT, FORMULA = "<|bos|>", "<|eos|>", "<|input|>", "<|thought|>", "<|formula|>"
IGNORED_TARGET = -100
COMPOSED_BLOCK = "🧩 Composed"

EXAMPLE_DDL = (
    "natural_language_input STRING, complexity STRING, "
    "thought STRUCT<reasoning_steps: ARRAY<STRUCT<step: INT, explanation: STRING>>, "
    "identified_atoms: ARRAY<STRUCT<atom: STRING, definition: STRING>>, "
    "identified_connectors: ARRAY<STRUCT<connector: STRING, natural_language_cue: STRING>>>, "
    "output STRUCT<formula: STRING, formula_ascii: STRING>, block STRING, "
    "verification STRUCT<verified: BOOLEAN, api_error: BOOLEAN, corrected: BOOLEAN, confidence: DOUBLE, issues: ARRAY<STRING>>, "
    "augmented BOOLEAN, augmentation_type STRING"
)
VERDICT_DDL = "is_correct BOOLEAN, confidence DOUBLE, issues ARRAY<STRING>, corrected_formula STRING"
PROCESSED_DDL = "sequence STRING, natural_language_input STRING, formula STRING, complexity STRING, block STRING"


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
