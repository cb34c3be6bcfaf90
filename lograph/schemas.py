"""Row layouts of the stored tables (see FIXTURES.md, section 1)."""

LOG_REFS = (
    "source_type string, identifier string, region string, prefix string, key string, "
    "timestamp timestamp_ntz, size_bytes bigint, unique_id string, path string"
)
LEDGER = (
    "unique_id string, source_type string, source_identifier string, key string, local_path string, "
    "downloaded_at timestamp_ntz, is_purged boolean, purged_at timestamp_ntz"
)
FINDINGS = (
    "seq bigint, source_file string, timestamp timestamp_ntz, severity string, message string, "
    "resource_arns array<string>, raw_lines array<string>, line_numbers array<int>, context map<string,string>"
)
RESOURCE_NODES = "arn string, resource_type string, name string, region string, properties map<string,string>"
RESOURCE_EDGES = "source_arn string, target_arn string, relationship string"
HEALTH = "struct<status:string,last_error:string,error_count:bigint,last_seen:timestamp_ntz>"
TOPOLOGY_NODES = f"arn string, resource_type string, name string, health {HEALTH}, metadata map<string,string>"
TOPOLOGY_EDGES = (
    "source_arn string, target_arn string, relationship string, request_count bigint, error_count bigint, position bigint"
)
SNAPSHOT_HEADER = "version bigint, generated_at timestamp_ntz, last_updated timestamp_ntz, batch string, folder string"
#: What a batch takes in, fixed when it starts.
MANIFEST = "unique_id string, source_type string, source_identifier string, key string, local_path string, downloaded_at timestamp_ntz"
REJECTS = "unique_id string, path string, reason string"
AUDIT = (
    "change_id string, timestamp timestamp_ntz, resource_arn string, change_type string, source string, "
    "triggered_by string, description string, previous_value string, new_value string, seq bigint, pos int"
)
FILE_RESULTS = "fingerprint string, abs_path string, file_name string, file_size bigint, result string"
EDITS = (
    "seq bigint, action string, arn string, target_arn string, relationship string, status string, "
    "last_error string, text string, resource_type string, name string, metadata map<string,string>"
)
