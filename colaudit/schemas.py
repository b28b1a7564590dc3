"""Explicit schemas of the engine's relations."""

from __future__ import annotations

#: One row per column of the target (M).
COLUMNS = (
    "qualified_name string, `table` string, name string, ordinal int, generic_type string, raw_type string, nullable boolean, "
    "`default` string, comment string, is_primary_key boolean, is_foreign_key boolean, foreign_key_target string, is_unique boolean, "
    "is_indexed boolean, char_max_length int, numeric_precision int, is_temporal boolean, sample_values array<string>, sample_size int, "
    "sample_null_fraction double, distinct_in_sample int, min_value string, max_value string"
)
#: One row per table of the target.
TABLES = "name string, schema string, row_count long, comment string, primary_key array<string>"
#: Keys and constraints that files do not carry: given by hand.
CONSTRAINTS = "`table` string, name string, is_primary_key boolean, is_foreign_key boolean, foreign_key_target string, is_unique boolean, is_indexed boolean, generic_type string"
#: One row per entry of a query log.
LOG = "ts timestamp, query_id string, operation string, sql string, service string, db_user string, template string, declared_reads array<string>, declared_writes array<string>, rows int"
#: Lineage of one distinct statement.
LINEAGE = "sql string, reads array<string>, writes array<string>, wildcards array<string>, unresolved array<string>, parsed_ok boolean, method string"
#: The three signals (S, U, R) that scoring joins.
SENSITIVITY = "qualified_name string, score double, is_sensitive boolean, tier string, pii_type string, confidence double, matched_rules array<string>"
USAGE = "qualified_name string, score double, tier string, read_count long, write_count long, last_access_at timestamp"
RETENTION = "qualified_name string, score double, is_overdue boolean, days_overdue int, policy_days int, anchor string, oldest_row_age_days int, basis string, fraction_overdue double"
