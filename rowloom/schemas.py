"""Table schemas and fixed value lists."""

from __future__ import annotations

# Job types, run modes and messages that results must match.
JOB_TYPES = ("run_on_collection", "run_on_stream", "run_on_files")
SINGLETON = "singleton"
CANCELLED_MESSAGE = "Job was cancelled by user"
EMPTY_MESSAGES = {
    "run_on_collection": "No items found in collection",
    "run_on_stream": "No items found in stream",
    "run_on_files": "No files to process",
}

# Names a run needs, for every mode and per mode, in report order.
BASE_REQUIRED = ("RUN_MODE", "DYNAMO_TABLE")
MODE_REQUIRED = {
    "RUN_ACTION": ("JOB_ID", "USERNAME", "DYNAMO_STREAMS_TABLE", "PRIMARY_BUCKET", "ACTION_ID"),
    "RUN_PLUSSCRIPT": ("JOB_ID", "USERNAME", "DYNAMO_STREAMS_TABLE", "PRIMARY_BUCKET", "ACTION_ID"),
    "RUN_JOB": ("JOB_ID", "USERNAME", "DYNAMO_STREAMS_TABLE", "PRIMARY_BUCKET"),
    "RUN_COLLECTION": ("JOB_ID", "USERNAME", "DYNAMO_STREAMS_TABLE", "PRIMARY_BUCKET"),
    "RUN_STREAM": ("JOB_ID", "USERNAME", "DYNAMO_STREAMS_TABLE", "PRIMARY_BUCKET"),
    "REGISTER_ACTIONS": (),
}

STATUSES = ("INITIALIZING", "RUNNING", "FAILED", "SUCCEEDED")

FIELDS = "map<string,string>"

JOBS = """object_id string, owner string, label string, username string, hostname string,
    job_type string, collection_owner string, stream_id string, file_keys array<string>,
    prefix string, input_data map<string,string>, status string, request_cancel boolean,
    created_at bigint, started_at bigint, completed_at bigint, updated_at bigint,
    percent int, success_count bigint, error_count bigint, error_message string"""

ITEMS = "owner string, pk string, object_id string, timestamp bigint, fields map<string,string>"

RECEIPTS = """job_id string, stream_id string, object_id string, seq bigint, success boolean,
    error_message string, timestamp bigint, outputs map<string,string>, cost double"""

RESULT = """struct<success:boolean,error_message:string,outputs:map<string,string>,
    primary_output:string,cost:double>"""

LINKS = "array<struct<source:string,sourceHandle:string,target:string,targetHandle:string>>"
NODES = "array<struct<unique_id:string,ntype:string,action_id:string>>"
MAPPINGS = "array<struct<source:string,target:string>>"

# Parameter type tags by the kind of value they carry.
STRING_TAGS = (
    "STRING", "ACE", "KEY", "PREFIX", "URL", "IP_ADDRESS", "CRON", "OBJECT_ID", "UNIQUE_ID",
    "JOB_ID", "USERNAME", "HOSTNAME", "ACTION_ID", "OWNER", "HIDDEN", "CSV_COLUMN",
    "COLOR_PICKER", "ICON_PICKER", "MAILING_ADDRESS", "STREAM_PARAM", "COLLECTION_PARAM",
    "FIXED_LIST_SINGLE_SELECT", "DISPLAY_ONLY",
)
LIST_TAGS = (
    "LIST", "FIXED_LIST_MULTI_SELECT", "CSV_COLUMNS", "OBJECT_IDS", "STREAM_PARAMS",
    "COLLECTION_PARAMS",
)
JSON_TAGS = (
    "JSON", "NESTED_OBJECT", "NESTED_OBJECTS", "STREAM_RECORD", "RECEIPT", "REQUEST_BODY",
    "RESPONSE_BODY", "DROPDOWN_ITEMS", "DASHBOARD_PARAMS", "ANY_TYPE_MAP",
)

# tag -> (field of the typed value, Spark type)
TYPE_OF_TAG = {
    **{tag: ("sval", "string") for tag in STRING_TAGS},
    "BOOLEAN": ("bval", "boolean"),
    "INTEGER": ("ival", "bigint"),
    "TIMESTAMP": ("ival", "bigint"),
    "FLOAT": ("dval", "double"),
    "BYTES": ("byval", "binary"),
    "DATETIME": ("sval", "timestamp"),
    **{tag: ("svals", "array<string>") for tag in LIST_TAGS},
    "VECTOR": ("dvals", "array<double>"),
    "STRING_MAP": ("smap", "map<string,string>"),
    "INTEGER_MAP": ("imap", "map<string,bigint>"),
    "DATERANGE": ("json_data", "struct<start:timestamp,end:timestamp>"),
    **{tag: ("json_data", "variant") for tag in JSON_TAGS},
}

# Typed value: a tag and one filled field. Nested values (lists and maps of typed
# values) have no fixed depth, so they travel as JSON text in ``json_data`` and are
# read as VARIANT.
VALUE_FIELDS = {
    "bval": "boolean",
    "ival": "bigint",
    "dval": "double",
    "sval": "string",
    "svals": "array<string>",
    "dvals": "array<double>",
    "ivals": "array<bigint>",
    "byval": "binary",
    "smap": "map<string,string>",
    "imap": "map<string,bigint>",
    "json_data": "string",
}
VALUE = "struct<ptype:string," + ",".join(f"{name}:{kind}" for name, kind in VALUE_FIELDS.items()) + ">"
