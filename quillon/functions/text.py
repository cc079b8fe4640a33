"""Text of model replies, SQL, file names and context prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that hold a statement in a reply, in order of preference.
TAGS = ("sql_generated", "sql_query", "sql_code", "sql", "sql_to_use")
# Names that are schemas, not databases, in front of a table.
SCHEMAS = (
    "public", "analytics", "information_schema", "pg_catalog", "pg_toast", "pg_temp_1", "pg_toast_temp_1", "pg_surgery",
    "timescaledb_experimental", "timescaledb_information", "timescaledb_internal", "_timescaledb_cache", "_timescaledb_catalog",
    "_timescaledb_config", "cron", "timescaledb_toolkit", "dbdev", "vault",
)
# Words that mark a question about databases.
DATABASE_WORDS = ("database", "table", "column", "query", "select", "from", "where", "count", "sum", "avg", "min", "max")

WHITE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(c, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_reasoning(c: Column) -> Column:
    """Without blocks of visible reasoning."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)###ponder###.*?###/ponder###", ""), r"(?s)<thinking>.*?</thinking>", "")


def unescape(c: Column) -> Column:
    """Backslashed quotes, line ends and tabs as the characters themselves; two backslashes as one; no comments."""
    for said, meant in (("\\'", "'"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(said), F.lit(meant))
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"--[^\n]*", "")


def sanitize_executor(c: Column) -> Column:
    """A statement for execution: unescaped, and without semicolons at its ends."""
    return F.regexp_replace(unescape(c), "^;+|;+$", "")


def sanitize_generator(c: Column) -> Column:
    """A statement from a reply: unescaped and trimmed; one closing semicolon stays if it ends a single statement."""
    clean = F.regexp_replace(unescape(c), r"[ \t\n\r\x0B\f]+$", "")
    body = strip(F.regexp_replace(clean, ";+$", ""))
    statements = F.size(F.filter(F.split(body, ";"), lambda s: strip(s) != ""))
    return F.when(clean.endswith(";") & (statements == 1), F.concat(body, F.lit(";"))).otherwise(body)


def extract_sql(c: Column, balanced: Column | None = None) -> Column:
    """The statement of a model's reply: from the first tag present, else from JSON with sql_query (an object
    around it, then everything between the outermost braces, then content='{...}', then `balanced`, the
    first balanced object, if given), else from a fenced block, else the reply; sanitised."""
    reply = strip_reasoning(c)
    tagged = [F.when(reply.rlike(f"(?s)<{t}>.*?</{t}>"), F.regexp_extract(reply, f"(?s)<{t}>(.*?)</{t}>", 1)) for t in TAGS]
    braces = [
        F.regexp_extract(reply, r'(?s)(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*"sql_query"[^{}]*\})', 1),
        F.regexp_extract(reply, r"(?s)(\{.*\})", 1),
        F.regexp_extract(reply, r"content='(\{.*\})'", 1),
        *([balanced] if balanced is not None else []),
    ]
    said = [F.get_json_object(b, "$.sql_query") for b in braces]
    fenced = F.when(reply.rlike(r"(?s)```(?:sql)?\n.*?\n```"), F.regexp_extract(reply, r"(?s)```(?:sql)?\n(.*?)\n```", 1))
    return sanitize_generator(strip(F.coalesce(*tagged, *said, fenced, reply)))


def strip_db_prefix(c: Column) -> Column:
    """An identifier without its database: db.schema.table gives schema.table; db.table gives table, unless the first
    part is a schema's name. Quotes around parts stay."""
    part = F.split(c, r"\.(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    first = F.lower(F.regexp_replace(part[0], '"', ""))
    two = F.when(first.isin(*SCHEMAS), c).otherwise(part[1])
    return F.when(F.size(part) == 3, F.concat_ws(".", part[1], part[2])).when(F.size(part) == 2, two).otherwise(c)


def safe_json(c: Column) -> Column:
    """Valid JSON text from a sloppy reply, or null: as it is, else without fences and control characters, else without
    commas before closing brackets and with single backslashes."""
    clean = strip(F.regexp_replace(F.regexp_replace(c, r"```(?:json)?", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    mended = F.replace(F.regexp_replace(clean, r",\s*([}\]])", "$1"), F.lit("\\\\"), F.lit("\\"))
    inner = F.regexp_extract(mended, r"(?s)(\{.*\})", 1)
    listed = F.regexp_extract(mended, r"(?s)(\[.*\])", 1)
    tried = [F.when(F.try_parse_json(x).isNotNull(), x) for x in (strip(c), clean, mended, non_empty(inner), non_empty(listed))]
    return F.coalesce(*tried)


def table_names(sql: Column) -> Column:
    """Names behind FROM, JOIN, INTO and UPDATE in a statement, each once, in order of first mention, outside literals and comments.
    A subquery's opening bracket is no name."""
    bare = F.regexp_replace(sql, r"(?s)'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?i)\b(?:from|join|into|update)\s+([a-z_][\w.]*)"), F.lit(1)))


def iso_format(c: Column) -> Column:
    """A timestamp in the session's zone as ISO-8601, with microseconds where it has any."""
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_parse(c: Column) -> Column:
    """ISO-8601 text (T or a space, seconds and fractions optional, without a zone) as a timestamp; null for anything else."""
    shaped = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    return F.when(shaped, F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" "))))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _extension(c: Column) -> Column:
    """The last dot and what follows, unless only dots stand before it."""
    return F.regexp_extract(c, r"^.*[^.].*?(\.[^.]*)$", 1)


def filename_store(c: Column) -> Column:
    """A file name for storage: its last part, other characters than word characters, - . and space as _, and at most 255
    characters, of which the extension stays."""
    name = F.regexp_replace(basename(c), r"(?U)[^\w\-_. ]", "_")
    ext = _extension(name)
    stem = F.length(name) - F.length(ext)
    return F.when(F.length(name) > 255, F.concat(F.substring(name, F.lit(1), F.least(stem, 255 - F.length(ext))), ext)).otherwise(name)


def filename_secure(c: Column) -> Column:
    """A file name for links: as above with - and . alone, no leading dots or spaces, never empty; null gives ''."""
    name = F.regexp_replace(basename(F.replace(c, F.lit("\\"), F.lit("/"))), r"^[. ]+", "")
    name = F.regexp_replace(name, r"(?U)[^\w\-.]", "_")
    return F.when(c.isNull(), F.lit("")).when(name == "", F.lit("unnamed_file")).otherwise(name)


def neutral_html(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<script"), F.lit("&lt;script")), F.lit("javascript:"), F.lit("javascript&#58;"))


def embed_prefix(c: Column, kind: str) -> Column:
    """A prefix for models that tell queries from documents, unless the text has one."""
    return F.when(c.rlike("^(search_query|search_document):"), c).otherwise(F.concat(F.lit(f"{kind}: "), c))


def context_prompt(parts: Column, question: Column, limit: int = 500) -> Column:
    """A prompt from an ordered array of contents, each cut to limit characters."""
    numbered = F.transform(parts, lambda p, i: F.concat(F.lit("\nContext "), (i + 1).cast("string"), F.lit(":\n"), F.substring(F.coalesce(p, F.lit("")), 1, limit), F.lit("\n")))
    return F.array_join(F.concat(F.array(F.lit("Use the following context to answer the question:")), numbered, F.array(F.concat(F.lit("\nQuestion: "), question))), "\n")


def str_to_bool(c: Column, default: bool | None = None) -> Column:
    said = F.lower(strip(c))
    return F.when(said.isin("true", "1", "yes", "y"), F.lit(True)).when(said.isin("false", "0", "no", "n"), F.lit(False)).otherwise(F.lit(default).cast("boolean"))


def asks_database(c: Column) -> Column:
    """Whether a question holds any database word, as a substring."""
    return F.lower(c).rlike("|".join(DATABASE_WORDS))


def answerable(c: Column, whole_words: bool = False) -> Column:
    """Whether a verdict says true or yes; as a substring, or as a word of its own."""
    return F.coalesce(F.lower(c).rlike(r"\b(true|yes)\b" if whole_words else "true|yes"), F.lit(False))


def session_id(user: Column, at: Column, ip: Column) -> Column:
    return F.sha2(F.concat(user.cast("string"), at.cast("string"), ip), 256)


def backoff(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2.0), attempt)
