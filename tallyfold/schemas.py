"""Row layouts shared by sources, operators and sinks."""

CATALOG = (
    "table string, column string, order long, type string, nullable boolean, primary_key boolean, "
    "foreign_key string, description string, sample_values string"
)
METADATA = (
    "schema string, table string, column string, order long, type string, nullable boolean, "
    "primary_key boolean, foreign_key string"
)
EDGE = "node string, dep string"
INVENTORY = "bucket string, key string, size long"
BUNDLE = "file string, lang string, key string, value string, value_type string"
CORPUS = "path string, dir string, name string, content string"

# The nullable columns of one issue row, in order.
ISSUE = {
    "type": "string",
    "file": "string",
    "table": "string",
    "column": "string",
    "language": "string",
    "key": "string",
    "text": "string",
    "line": "int",
    "count": "bigint",
    "db_value": "string",
    "catalog_value": "string",
    "message": "string",
}

# Header of a catalog file.
CATALOG_HEADER = [
    "Table",
    "Column",
    "Order",
    "Type",
    "Nullable?",
    "Primary Key?",
    "Foreign Key",
    "Description",
    "Sample Values",
]
