"""Vocabularies, ranks and row types (as DDL) of the claim-evidence model."""

from __future__ import annotations

# Words of the stages, outcomes, reasons and validities, and what orders them.
EXECUTION = ("completed", "unavailable", "failed")
EXTRACTION = ("extracted", "absent", "invalid", "not_attempted")
COMPARISON = ("match", "mismatch", "not_applicable")
OUTCOMES = ("verified", "mismatch", "not_found", "unchecked", "error", "not_offered")
VALIDITY_RANK = {"artifact_absent": 0, "broken_pin": 1, "unpinned_artifact": 2, "authoritative": 3}
AUTHORITY_RANK = {"self_recorded": 0, "git_remote": 1, "osf": 2, "zenodo": 2, "trusted_timestamp": 3}
FRESHNESS_RANK = {"undetermined": 0, "stale": 1, "never_rerun": 2, "current": 3}
SEVERITIES = ("error", "warning", "ignore")
NEVER_OPENED = ("pkl", "pickle", "joblib", "pt", "pth", "ckpt")
UNSUPPORTED = ("mat", "rda", "rdata", "sas7bdat")
FORMATS = {
    "json": "tree", "yaml": "tree", "yml": "tree", "csv": "table", "tsv": "table", "txt": "prose", "md": "prose", "tex": "prose",
    "parquet": "columnar", "feather": "columnar", "arrow": "columnar", "npy": "array", "npz": "array", "sqlite": "sqlite", "db": "sqlite",
    "xlsx": "sheet", "dta": "stata", "rds": "r_frame", "sav": "spss", "zsav": "spss", "pdf": "page", "html": "page", "xml": "page", "docx": "page",
}

# What a resolution means for the extraction stage and the reason given, by kind of address.
RESOLUTION = {"resolved": "extracted", "absent": "absent", "ambiguous": "absent", "not_scalar": "invalid", "invalid_selector": "invalid"}
ABSENT_REASON = {
    "pointer": "pointer_absent", "table": "row_absent", "column": "column_absent", "row": "row_absent", "array": "row_absent", "prose": "passage_absent",
}

ARTIFACT = (
    "artifact_id string, path string, sha256 string, media_type string, origin struct<repository:string,commit:string,path:string>, "
    "basis string, reviewed struct<who:string,when_day:date,how:string,via:string>"
)
CLAIM = ("claim_id string, text string, place string, registration string, registration_note string")
EVIDENCE = (
    "claim_id string, ord int, kind string, name string, artifact_id string, reported string, mode string, tolerance string, "
    "conversion string, places int, locator string, basis string"
)
DECISION = (
    "claim_id string, ord int, execution string, extraction string, comparison string, outcome string, reason string, "
    "stored string, reported string, validity string"
)
CELL = (
    "artifact_id string, address_kind string, table_name string, row_ord long, column string, pointer string, index array<int>, "
    "raw string, native_type string, is_container boolean"
)


def rank_case(column: str, ranks: dict[str, int]) -> str:
    """SQL that gives the rank of a word."""
    return "CASE " + column + " " + " ".join(f"WHEN '{w}' THEN {r}" for w, r in ranks.items()) + " END"
