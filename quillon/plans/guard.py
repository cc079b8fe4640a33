"""Read-only guards for SQL text.

`check` judges the parsed plan: only reading nodes may stand in it, wherever they are nested, so that a column named
created_at or a literal with drop is no finding, and a second statement or a comment can't hide. The two keyword
guards judge text, as columns, for those who need their verdicts on stored statements.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_reasoning

# Words and patterns of the guard in front of execution.
EXECUTOR_WORDS = ("drop", "delete", "truncate", "alter", "create", "insert", "update", "grant", "revoke", "exec", "execute", "merge")
EXECUTOR_PATTERNS = ("union select", "information_schema", "pg_", "sqlite_", "xp_", "sp_")
# Words and patterns (regular expressions) of the guard behind generation.
GRAPH_WORDS = ("drop", "delete", "insert", "update", "truncate", "alter", "exec", "execute", "merge", "replace")
GRAPH_PATTERNS = (
    r"union\s+select", r"information_schema", r"pg_", r"sqlite_", r"xp_", r"sp_", r"exec\s*\(", r"execute\s*\(", r"eval\s*\(",
    r"waitfor\s+delay", r"benchmark\s*\(", r"sleep\s*\(", r"load_file\s*\(", r"into\s+outfile", r"into\s+dumpfile", r"cmdshell",
    r"polyfromtext", r"st_astext", r"cast\s*\([^)]+\s+as", r"convert\s*\(", r"char\s*\(", r"nchar\s*\(", r"substring\s*\(",
    r"mid\s*\(", r"asc\s*\(", r"hex\s*\(", r"unhex\s*\(", r"quote\s*\(", r"concat\s*\(", r"group_concat\s*\(", r"load_xml\s*\(",
    r"extractvalue\s*\(", r"updatexml\s*\(", r"fn:\w+", r"declare\s+@\w+\s*=", r"set\s+@\w+\s*=", r"openrowset\s*\(",
    r"opendatasource\s*\(", r"bulk\s+insert", r"openquery\s*\(", r"execute\s+as", r"impersonate", r"shutdown", r"backup\s+database",
    r"restore\s+database", r"addsignature", r"makesignature", r"dbms_\w+\.", r"utl_\w+\.", r"ctxsys\.driddl", r"sys\.dbms", r"sys\.any",
    r"any_data", r"any_type", r"anydataset", r"sys\.xmlgen", r"sdo_util\.to_clob", r"sdo_sql\.shapefilereader",
    r"dbms_java\.grant_permission", r"dbms_javaxx", r"dbms_scheduler", r"dbms_pipe", r"dbms_alert", r"dbms_aq", r"dbms_datapump",
    r"dbms_metadata", r"dbms_repcat", r"dbms_registry", r"dbms_rule", r"dbms_streams", r"dbms_system", r"dbms_utility",
    r"dbms_workload_repository", r"dbms_xa", r"dbms_xstream", r"dbms_crypto", r"dbms_random", r"dbms_lock", r"dbms_lob", r"dbms_xmlgen",
    r"dbms_xmlstore", r"dbms_xmlschema", r"dbms_xmlquery", r"dbms_xmlsave", r"dbms_xmlparser",
)
NOT_SELECT = "Query does not start with SELECT"
NOT_READING = "SQL query does not start with SELECT or WITH, which is required for safety"
MULTIPLE = "Multiple SQL statements detected. Only single statements are allowed for safety."
COMMENTS = "SQL comments detected. These are not allowed for safety."
HEXADECIMAL = "Hexadecimal escape sequences detected. These are not allowed for safety."
BINARY = "Binary literals detected. These are not allowed for safety."

#: Plan nodes that only read.
READING = frozenset((
    "Project", "Filter", "UnresolvedHaving", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail",
    "Distinct", "Deduplicate", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation",
    "UnresolvedWith", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "WithWindowDefinition", "Window", "Generate", "Pivot",
    "Unpivot", "Sample", "UnresolvedHint", "ResolvedHint", "UnresolvedTableValuedFunction", "Range", "LateralSubquery",
))


#: Expressions that hold a plan.
SUBQUERIES = frozenset(("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"))


#: Expressions that the parser makes of operators, literals, names and calls (which are looked at by name). Any other is refused, so what
#: hides a name until analysis, such as IDENTIFIER(...), is too, and so are parameters.
EXPRESSIONS = SUBQUERIES | frozenset((
    "Add", "Alias", "And", "AnyValue", "AggregateExpression", "AttributeReference", "BitwiseAnd", "BitwiseNot", "BitwiseOr", "BitwiseXor", "CaseWhen", "Cast",
    "Coalesce", "Collate", "Concat", "CreateNamedStruct", "Cube", "CurrentRow$", "Divide", "EqualNullSafe", "EqualTo", "First", "GreaterThan",
    "GreaterThanOrEqual", "GroupingSets", "ILike", "In", "InSubquery", "IntegralDivide", "IsNotNull", "IsNull", "LambdaFunction", "Last", "LessThan",
    "LessThanOrEqual", "Like", "LikeAll", "LikeAny", "Literal", "Lower", "MultiAlias", "Multiply", "NamedArgumentExpression", "Not", "NotLikeAll", "NotLikeAny",
    "Or", "Overlay", "RLike", "Remainder", "Rollup", "SemiStructuredExtract", "ShiftLeft", "ShiftRight", "ShiftRightUnsigned", "SortOrder",
    "SpecifiedWindowFrame", "StringLocate", "StringTrim", "StringTrimLeft", "StringTrimRight", "Substring", "Subtract", "TimestampAdd", "TimestampDiff",
    "UnaryMinus", "UnaryPositive", "UnboundedFollowing$", "UnboundedPreceding$", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedCollation",
    "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal", "UnresolvedStar",
    "UnresolvedStarExceptOrReplace", "UnresolvedWindowExpression", "UnspecifiedFrame$", "WindowExpression", "WindowSpecDefinition",
))
#: Formats whose name in front of a path reads files.
FORMATS = frozenset(("parquet", "orc", "csv", "json", "text", "avro", "xml", "binaryfile", "delta", "jdbc", "kafka"))

#: Functions that run code of any class of the virtual machine.
RUNNING = frozenset(("reflect", "try_reflect", "java_method"))
#: Table functions that make rows of their arguments alone.
GENERATING = frozenset((
    "range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple",
    "variant_explode", "variant_explode_outer", "collations", "sql_keywords",
))
_builtin: set[str] = set()


def builtin(spark: SparkSession) -> set[str]:
    """Names of the engine's own functions."""
    if not _builtin:
        functions = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().listFunction()
        _builtin.update(functions.mkString(",").replace("`", "").lower().split(","))
    return _builtin


@dataclass
class Verdict:
    safe: bool
    issues: list[str] = field(default_factory=list)
    tables: list[tuple[str, ...]] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    #: Where the text names tables, and columns by more than their own name: (parts, first character, behind the last).
    relations: list[tuple[tuple[str, ...], int, int]] = field(default_factory=list)
    columns: list[tuple[tuple[str, ...], int, int]] = field(default_factory=list)
    local: set[str] = field(default_factory=set)


def _each(seq):
    for i in range(seq.size()):
        yield seq.apply(i)


def check(spark: SparkSession, sql: str, functions: frozenset[str] = frozenset()) -> Verdict:
    """Parses one statement and walks its whole plan: subqueries and common table expressions too. What can't be parsed is
    unsafe; so are nodes and expressions that aren't known to read only, functions that aren't built in (but for those named) or that run
    other code, table functions that read anything but their arguments, and paths in place of tables. tables: those read, in order of
    first mention, without common table expressions."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's own exceptions come through the gateway
        return Verdict(False, [f"cannot be parsed: {str(e).strip().splitlines()[0]}"])
    found, issues, aliases, local, relations, columns = [], [], {}, set(), [], []
    known, named = builtin(spark), {f.lower() for f in functions}

    def place(e) -> tuple[int, int] | None:
        first, last = e.origin().startIndex(), e.origin().stopIndex()
        return (first.get(), last.get() + 1) if first.isDefined() and last.isDefined() else None

    def expression(e) -> None:
        for inner in _each(e.children()):
            expression(inner)
        kind = e.getClass().getSimpleName() or e.getClass().getName().rsplit(".", 1)[-1]
        if kind not in EXPRESSIONS:
            issues.append(f"{kind} is not a reading expression")
        if kind == "UnresolvedAttribute" and e.nameParts().size() > 1 and place(e):
            columns.append((tuple(_each(e.nameParts())), *place(e)))
        elif kind == "UnresolvedStar" and e.target().isDefined() and place(e):
            columns.append(((*_each(e.target().get()), "*"), *place(e)))
        elif kind == "UnresolvedFunction":
            called(list(_each(e.nameParts())))
        elif kind == "UnresolvedGenerator":
            called([e.name().funcName()], True)
        if kind in SUBQUERIES:
            walk(e.plan())

    def called(parts: list[str], makes_rows: bool = False) -> None:
        name = parts[-1].lower()
        fine = name in GENERATING if makes_rows else name in known and name not in RUNNING
        if name not in named and (not fine or len(parts) > 1 and [p.lower() for p in parts[:-1]] not in (["builtin"], ["system", "builtin"])):
            issues.append(f"function {'.'.join(parts)} is not allowed")

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name not in READING:
            issues.append(f"{name} is not a reading operation")
            return
        if name == "UnresolvedWith":
            for cte in _each(node.cteRelations()):
                local.add(cte._1().lower())
            for inner in _each(node.innerChildren()):
                walk(inner)
        if name == "UnresolvedTableValuedFunction":
            called(list(_each(node.name())), True)
        if name == "UnresolvedRelation":
            parts = tuple(_each(node.multipartIdentifier()))
            if not (len(parts) == 1 and parts[0].lower() in local):
                if parts not in found:
                    found.append(parts)
                if place(node):
                    relations.append((parts, *place(node)))
                if any(c in p for p in parts for c in "/\\:") or len(parts) > 1 and parts[0].lower() in FORMATS:
                    issues.append(f"{'.'.join(parts)} is a path, not a table")
        if name == "SubqueryAlias" and node.child().getClass().getSimpleName() == "UnresolvedRelation":
            aliases[node.alias()] = ".".join(_each(node.child().multipartIdentifier()))
        for e in _each(node.expressions()):
            expression(e)
        for inner in _each(node.children()):
            walk(inner)

    walk(plan)
    return Verdict(not issues, issues, found, aliases, relations, columns, local)


def executor_issues(sql: Column) -> Column:
    """Findings of the guard in front of execution, as an array; empty for safe statements. A statement in the field sql_query of a JSON
    object, inside a fence, or after blocks of reasoning, is judged alone."""
    inside = F.when(F.ltrim(sql).startswith("{"), F.get_json_object(sql, "$.sql_query"))
    sql = F.coalesce(F.nullif(inside, F.lit("")), sql)
    fenced = F.when(sql.rlike(r"(?s)```(?:sql)?\n.*?\n```"), F.regexp_extract(sql, r"(?s)```(?:sql)?\n(.*?)\n```", 1)).otherwise(sql)
    low = F.trim(F.lower(strip_reasoning(fenced)))
    found = [F.when(~low.startswith("select"), F.lit(NOT_SELECT))]
    found += [F.when(F.contains(low, F.lit(w)), F.lit(f"Contains potentially harmful command: {w}")) for w in EXECUTOR_WORDS]
    found += [F.when(F.contains(low, F.lit(p)), F.lit(f"Contains potentially harmful pattern: {p}")) for p in EXECUTOR_PATTERNS]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def graph_issue(sql: Column) -> Column:
    """The first finding of the guard behind generation, or null."""
    low = F.trim(F.lower(sql))
    tests = [(F.contains(low, F.lit(w)), f"Potentially harmful SQL detected: {w}") for w in GRAPH_WORDS]
    tests.append((~(low.startswith("select") | low.startswith("with")), NOT_READING))
    tests += [(low.rlike(p), f"Potentially dangerous SQL pattern detected: {p}") for p in GRAPH_PATTERNS]
    tests.append((F.length(sql) - F.length(F.replace(sql, F.lit(";"), F.lit(""))) > 1, MULTIPLE))
    tests.append((F.contains(sql, F.lit("/*")) | F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("#")), COMMENTS))
    tests.append((low.rlike(r"'\\x[0-9a-f]{2}") | low.rlike(r"'0x[0-9a-f]+"), HEXADECIMAL))
    tests.append((low.rlike("b'[01]+'"), BINARY))
    first = F.filter(F.array(*(F.when(t, F.lit(m)) for t, m in tests)), lambda x: x.isNotNull())
    return F.get(first, F.lit(0))


def verdict(reply: Column) -> Column:
    """Whether a model's verdict (JSON with is_safe and confidence) clears a statement. Missing fields, and text that is no
    JSON, don't."""
    said = F.from_json(reply, "is_safe boolean, confidence double, explanation string")
    return F.coalesce(said["is_safe"] & said["confidence"].isNotNull(), F.lit(False))
