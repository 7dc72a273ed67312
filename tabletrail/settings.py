"""Fixed values and defaults shared by all operators."""

# --- Fixed values: a result depends on each of them. -------------------------

FILE_TYPES = {"sql": "sql", "py": "python", "sh": "shell"}

# Names that follow FROM/JOIN/INTO/... but are keywords or noise, not tables.
STOP_WORDS = [
    "select", "from", "where", "join", "on", "as", "and", "or", "not",
    "in", "is", "null", "true", "false", "by", "group", "order", "having",
    "limit", "offset", "union", "all", "distinct", "case", "when", "then",
    "else", "end", "cast", "coalesce", "count", "sum", "avg", "max", "min",
    "date", "timestamp", "interval", "varchar", "int", "integer", "bigint",
    "float", "double", "boolean", "string", "array", "map", "struct",
    "current_date", "current_timestamp", "now", "values", "set", "with",
    "recursive", "lateral", "cross", "inner", "left", "right", "full",
    "outer", "natural", "using", "exists", "between", "like", "ilike",
    "replace", "engine", "index", "key", "primary", "default",
]

WRITE_OPERATIONS = ["WRITE", "CREATE", "INSERT", "UPDATE", "DELETE", "DROP"]

BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
BM25_CUT = 0.01

SEMANTIC_WEIGHT = 0.6
BM25_WEIGHT = 0.25
TABLE_WEIGHT = 0.15

HYBRID_SHARE = 0.4
JUDGED_SHARE = 0.6
MIN_JUDGED_SCORE = 0.3

TOP_K = 20
JUDGED_HITS = 15
MIN_CHUNK_CHARS = 10
BLOCK_LINES = 30
KNOWN_TABLES = 30

UNJUDGED_NOTE = "Ranked by hybrid score only; no judgements were given."

# --- Ours: how the work is spread. -------------------------------------------

# Copies of a lookup side when the other side may be crowded on few keys.
SALTS = 16
# Rows of a lookup side that may be broadcast; names and words are short, so this stays within some megabytes.
BROADCAST_ROWS = 50_000
# Directories the stored documents and postings are split into; thousands suit very large indexes. It is part of the
# stored layout: after a change, index again.
STORE_BUCKETS = 64
# Bucket files that a writing task keeps open; with more buckets its rows are sorted by bucket once it has opened so many.
OPEN_FILES = 256
# Segments of an index that is added to, before they are merged into one.
MAX_SEGMENTS = 16
# Common words are spared for a query, and the documents left looked up, if that leaves one in so many of its postings.
SPARED_POSTINGS = 3
# Query vectors sent to every task in one pass; more queries take more passes.
QUERY_VECTORS_PER_PASS = 4096
# Rows of an alias rule list that may travel inside the plan as literals.
INLINE_RULES = 1000
# Bytes of listed files that one task reads.
LISTED_BYTES = 128 << 20
# Cells that vectors are laid out in, and vectors their centres are fitted on.
VECTOR_CELLS = 64
CELL_SAMPLE = 20_000
