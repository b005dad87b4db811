"""Row types shared by operators."""

MESSAGE = "struct<role: string, content: string, reasoning_content: string, tool_calls: string, name: string, tool_call_id: string>"
CONVERSATION = f"id string, status string, conversations array<{MESSAGE}>, tools string"
FEATURE_SPEC = "struct<name: string, shape: array<int>, dtype: string, required: boolean, target_repr: string>"
SAMPLE_REF = f"sample_id string, run_id string, source_task_id string, uri string, feature_keys map<string, string>, feature_specs map<string, {FEATURE_SPEC}>, strategy string, schema_version int, num_tokens int, estimated_bytes bigint, metadata map<string, string>"
PRETOKENIZED = "input_ids array<int>, loss_mask array<int>"
METRIC = "metric string, pos int, num double, den double"
SCHEMA_VERSION = 1
#: Bytes of an element by its type name.
WIDTHS = {"float64": 8, "int64": 8, "float32": 4, "int32": 4, "float16": 2, "bfloat16": 2, "int16": 2, "int8": 1, "uint8": 1, "bool": 1}
