"""Code facts: declarations, calls, types and packages from landed parser output.

The reference runs a compiler front end and an XML-emitting parser per file.
Those programs are not rebuilt; their output is a landed column (XML text or
already-resolved fact rows) and the operators below turn it into fact tables
with built-in SQL functions (``xpath_*``, ``regexp_extract_all``, higher-order
array functions), partitioned by file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrail.functions.call_nodes import call_nodes
from codetrail.functions.lineage import materialize
from codetrail.functions.xml import balanced, parsed, well_formed, wrapped


# ---------------------------------------------------------------- X7
def distinct_facts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One fact per file and identity; the first in file order wins.

    ``order`` is a sortable (struct) column giving the file position.  Uses a
    ``min(struct(order, payload))`` aggregate, which combines map-side, rather
    than a ranking window.
    """
    payload = [c for c in df.columns if c not in keys and c != order]
    best = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in payload])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best." + c).alias(c) for c in payload])


# Error markers of the parser's output and the unit pattern of its result list.
PARSE_ERRORS_PREFIX = ("srcml: Unable to open file", "srcML translator error")
PARSE_ERROR_INFIX = "parser error"
UNIT_HEAD = r"<unit ([^>]*item=\"\d+\"[^>]*)>"
UNIT_BODY = "(?s)" + UNIT_HEAD + "(.*?)</unit>"


# ---------------------------------------------------------------- X8
def drop_failed_parses(df: DataFrame, xml_col: str) -> DataFrame:
    """Drop null parser output and output that reports a parse failure."""
    x = F.col(xml_col)
    bad = x.isNull() | x.startswith(PARSE_ERRORS_PREFIX[0]) | x.startswith(PARSE_ERRORS_PREFIX[1]) | x.contains(PARSE_ERROR_INFIX)
    return df.filter(~bad)


def _units(df: DataFrame, xml_col: str, keys: Sequence[str], scope: bool = False) -> DataFrame:
    """Result units of a parser xpath listing, with their position (and their ``scope`` attribute where asked for); one-line
    output has none."""
    unit = F.regexp_extract_all(F.col(xml_col), F.lit(UNIT_BODY), 2)
    multi = F.instr(F.regexp_replace(F.col(xml_col), r"\n+$", ""), "\n") > 0
    listing = drop_failed_parses(df, xml_col).filter(multi)
    if not scope:
        return listing.select(*keys, F.posexplode(unit).alias("unit_pos", "unit"))
    bodies = F.arrays_zip(F.regexp_extract_all(F.col(xml_col), F.lit(UNIT_BODY), 1).alias("head"), unit.alias("unit"))
    return (listing.select(*keys, F.posexplode(bodies).alias("unit_pos", "_u"))
            .select(*keys, "unit_pos", F.col("_u.unit").alias("unit"),
                    F.regexp_extract("_u.head", r'\bscope="(\w+)"', 1).alias("unit_scope")))


def malformed_units(df: DataFrame, xml_col: str, keys: Sequence[str] = ("repo", "idx", "path")) -> DataFrame:
    """Units per file, and how many of them aren't well-formed XML (the readers skip those)."""
    keys = list(keys)
    bad = ~well_formed(wrapped(F.col("unit")))
    return (_units(df, xml_col, keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_units"), F.count_if(bad).alias("n_malformed")))


# ---------------------------------------------------------------- X1
def calls_from_xml(df: DataFrame, xml_col: str = "calls_xml", keys: Sequence[str] = ("repo", "idx", "path")) -> DataFrame:
    """One row per ``<call>`` unit: innermost-last name, number of direct ``<argument>``s
    and the start line of the ``argument_list``; calls without a name or an argument list
    (hence without a line) are skipped, and so is a unit that isn't well-formed XML
    (``malformed_units`` counts those).

    Each unit is parsed once (``call_nodes``), which gives, in document order, the texts of the name, the ``pos:start``
    attributes of the argument lists (a position never looks like an identifier) and a null per direct ``<argument>``.
    """
    keys = list(keys)
    u = _units(df, xml_col, keys).withColumn("_doc", wrapped(F.col("unit")))
    u = u.select(*keys, "unit_pos", call_nodes("_doc").alias("_nodes"))
    is_pos = lambda v: v.rlike(r"^\d+:\d+$")

    def fields(arr):
        start = F.try_element_at(F.filter(arr, lambda v: v.isNotNull() & is_pos(v)), F.lit(1))
        return F.struct(F.array_join(F.filter(arr, lambda v: v.isNotNull() & ~is_pos(v)), "").alias("name"),
                        F.size(F.filter(arr, lambda v: v.isNull())).alias("n_args"),
                        F.split(start, ":").getItem(0).try_cast("int").alias("line"))
    # the fields are bound once inside a higher-order function and the kept row is produced by a generator, so the
    # optimizer cannot work them out again in a pushed-down filter
    kept = F.filter(F.transform(F.array("_nodes"), fields), lambda r: (r["name"] != "") & r["line"].isNotNull())
    return (u.select(*keys, "unit_pos", F.explode(kept).alias("_r"))
            .select(*keys, "unit_pos", F.col("_r.name").alias("name"), F.col("_r.n_args").alias("n_args"),
                    F.col("_r.line").alias("line")))


# ---------------------------------------------------------------- X3
# Elements that declare a method, and the elements that a declaration directly in a type stands in.
DECLARATIONS = ("function", "constructor", "function_decl")
TYPE_ELEMENTS = ("class", "interface", "enum", "annotation_defn")


def declarations_from_xml(df: DataFrame, xml_col: str = "decls_xml", keys: Sequence[str] = ("repo", "idx", "path"),
                          scope: str = "all") -> DataFrame:
    """Functions / constructors: name, parameter count (all nested ``parameter`` elements;
    ``...`` anywhere in the list -> varargs and one fewer), start and end line.

    Each unit is parsed once, tolerantly: a malformed one gives no row (``malformed_units`` counts them).
    ``scope="types"`` keeps declarations that stand directly in a type: the unit's ``scope`` attribute, which the
    listing gives the name of the enclosing element, must be a type element; "all" keeps every declaration.
    """
    if scope not in ("all", "types"):
        raise ValueError("scope is 'all' or 'types'")
    keys = list(keys)
    u = _units(df, xml_col, keys, scope=scope == "types")
    element = "STRUCT<name: STRING, parameter_list: STRING, `_pos:start`: STRING, `_pos:end`: STRING>"
    schema = ", ".join(f"{d} {element}" for d in DECLARATIONS)

    def fields(doc):
        d = F.coalesce(*[doc[x] for x in DECLARATIONS])
        params = d["parameter_list"]
        n = F.size(F.regexp_extract_all(params, F.lit(r"<parameter[\s/>]"), 0))
        varargs = params.contains("...")
        return F.struct(
            F.regexp_replace(d["name"], "<[^>]*>", "").alias("name"),
            F.when(varargs, n - 1).otherwise(n).alias("n_args"), varargs.alias("varargs"),
            doc["constructor"].isNotNull().alias("is_constructor"),
            F.split(d["_pos:start"], ":").getItem(0).try_cast("int").alias("line_start"),
            F.split(d["_pos:end"], ":").getItem(0).try_cast("int").alias("line_end"))
    # bound once per unit inside a higher-order function and emitted by a generator, so a pushed-down filter cannot
    # parse the unit again
    docs = F.transform(F.array(wrapped(F.col("unit"))), lambda x: F.when(balanced(x), parsed(x, schema)))
    kept = F.filter(F.transform(docs, fields),
                    lambda r: r["name"].isNotNull() & r["n_args"].isNotNull()
                    & r["line_start"].isNotNull() & r["line_end"].isNotNull())
    if scope == "types":
        u = u.filter(F.col("unit_scope").isin(*TYPE_ELEMENTS))
    cols = ["name", "n_args", "varargs", "is_constructor", "line_start", "line_end"]
    return (u.select(*keys, "unit_pos", F.explode(kept).alias("_r"))
            .select(*keys, "unit_pos", *[F.col("_r." + c).alias(c) for c in cols]))


# ---------------------------------------------------------------- X4
# A listing unit that holds plain text, and the position attributes among such texts.
UNIT_TEXT = r"<unit\b[^<>]*>([^<>]*)</unit>"
_POSITION = r'^{0}="(\d+):\d+"$'


def _texts(x):
    return F.regexp_extract_all(x, F.lit(UNIT_TEXT), 1)


def _is(kind: str, text):
    return text.rlike(_POSITION.format(kind))


def _line(kind: str, text):
    return F.regexp_extract(text, _POSITION.format(kind), 1)


def declaration_spans_from_xml(df: DataFrame, xml_col: str = "spans_xml",
                               keys: Sequence[str] = ("repo", "idx", "path")) -> DataFrame:
    """(start, end, name) lists of a file; nothing for the file if the three lists differ in length.

    The texts of the listing's units are classified: a start position, an end position, else a name (of letters, digits,
    ``_`` and ``$``, possibly empty).
    """
    keys = list(keys)

    def lists(texts):
        return F.struct(F.transform(F.filter(texts, lambda t: _is("start", t)), lambda t: _line("start", t)).alias("s"),
                        F.transform(F.filter(texts, lambda t: _is("end", t)), lambda t: _line("end", t)).alias("e"),
                        F.filter(texts, lambda t: t.rlike(r"^[\w$]*$")).alias("n"))
    kept = F.filter(F.transform(F.array(_texts(F.col(xml_col))), lists),
                    lambda r: (F.size(r["s"]) == F.size(r["e"])) & (F.size(r["e"]) == F.size(r["n"])))
    t = drop_failed_parses(df, xml_col).select(*keys, F.explode(kept).alias("_r"))
    z = F.arrays_zip(F.col("_r.s").alias("s"), F.col("_r.e").alias("e"), F.col("_r.n").alias("n"))
    return (t.select(*keys, F.posexplode(z).alias("k", "_z"))
            .select(*keys, "k", F.col("_z.n").alias("name"), F.col("_z.s").cast("int").alias("line_start"),
                    F.col("_z.e").cast("int").alias("line_end")))


# ---------------------------------------------------------------- X5
def types_from_xml(df: DataFrame, xml_col: str = "types_xml", keys: Sequence[str] = ("repo", "idx", "path")) -> DataFrame:
    """Class / enum / interface (name, start, end): a start position, an end position and a name that stand side by
    side in the listing; a pair of positions without a name (an anonymous class) is skipped."""
    keys = list(keys)
    t = drop_failed_parses(df, xml_col).select(*keys, F.filter(
        _texts(F.col(xml_col)), lambda x: _is("start", x) | _is("end", x) | x.rlike(r"^\w+$")).alias("_x"))
    # at each text, with the two texts before it
    triple = F.transform("_x", lambda x, i: F.struct(
        F.get(F.col("_x"), i - 2).alias("s"), F.get(F.col("_x"), i - 1).alias("e"), x.alias("n")))
    kept = F.filter(triple, lambda r: F.coalesce(_is("start", r["s"]) & _is("end", r["e"]) & r["n"].rlike(r"^\w+$"),
                                                 F.lit(False)))
    return (t.select(*keys, F.posexplode(kept).alias("k", "_c"))
            .select(*keys, "k", F.col("_c.n").alias("name"), _line("start", F.col("_c.s")).cast("int").alias("line_start"),
                    _line("end", F.col("_c.e")).cast("int").alias("line_end")))


# ---------------------------------------------------------------- X6
def add_default_constructors(decls: DataFrame, types: DataFrame, keys: Sequence[str] = ("repo", "idx", "path")) -> DataFrame:
    """Add a 0-argument constructor (with the type's lines) for each type that has no
    0-argument member of its own name in the same file."""
    keys = list(keys)
    # read twice; out of a parser's listing they would be parsed twice
    decls = materialize(decls)
    have = decls.filter(F.col("n_args") == 0).select(*keys, "name").distinct()
    missing = types.join(have, [*keys, "name"], "left_anti")
    synth = missing.select(*keys, "name", F.lit(0).alias("n_args"), F.lit(False).alias("varargs"),
                           F.lit(True).alias("is_constructor"), "line_start", "line_end")
    base = decls.select(*keys, "name", "n_args", "varargs", "is_constructor", "line_start", "line_end")
    return base.unionByName(synth)


# ---------------------------------------------------------------- X9
def invocations_per_file(raw: DataFrame, keys: Sequence[str] = ("project", "path"),
                         ident: Sequence[str] = ("cls", "return_type", "name", "arg_types", "n_args")) -> DataFrame:
    """Merge equal calls of a file keeping the sorted line list and count; flag ``java.`` classes;
    calls with an empty name are dropped."""
    keys, ident = list(keys), list(ident)
    r = raw.filter(F.col("name").isNotNull() & (F.col("name") != ""))
    return (r.groupBy(*keys, *ident)
            .agg(F.sort_array(F.collect_list("line")).alias("lines"), F.count(F.lit(1)).alias("count"))
            .withColumn("is_java", F.coalesce(F.col("cls").startswith("java."), F.lit(False))))


# ---------------------------------------------------------------- X10
def declared_members(df: DataFrame) -> DataFrame:
    """Declaration rows: ``args_types`` joined by ', ', ``n_args``, javadoc / body flags and spans
    (-1 when absent)."""
    return (df.withColumn("args_types", F.array_join("arg_type_list", ", "))
            .withColumn("n_args", F.size("arg_type_list"))
            .withColumn("has_javadoc", F.col("javadoc").isNotNull())
            .withColumn("javadoc_line_start", F.coalesce(F.col("javadoc_line_start"), F.lit(-1)))
            .withColumn("javadoc_line_end", F.coalesce(F.col("javadoc_line_end"), F.lit(-1)))
            .withColumn("has_body", F.col("body").isNotNull())
            .drop("arg_type_list"))


# ---------------------------------------------------------------- X11
def effective_visibility(df: DataFrame) -> DataFrame:
    """X11: ``is_public`` of a member given its ``modifier`` and ``ancestors`` (innermost first,
    ``kind`` in class / interface / enum / annotation / anonymous / local).

    Public is a member whose enclosing types are all public and neither anonymous nor local, and that is public itself
    or has no modifier in an interface or annotation.  A member without an enclosing type is public unless it is private
    or protected.
    """
    modifier, around = F.coalesce(F.col("modifier"), F.lit("")), F.col("ancestors")
    reachable = F.forall(around, lambda a: F.coalesce(a["modifier"] == "public", F.lit(False))
                         & ~F.coalesce(a["kind"].isin("anonymous", "local"), F.lit(False)))
    nearest = F.get(around, F.lit(0))["kind"]
    implied = ~modifier.isin("private", "protected") & (nearest.isin("interface", "annotation") | (F.size(around) == 0))
    return df.withColumn("is_public", reachable & ((modifier == "public") | F.coalesce(implied, F.lit(False))))


# ---------------------------------------------------------------- X12
def drop_local_types(df: DataFrame, qualified: str = "qualified_class") -> DataFrame:
    """Drop members of local / anonymous types or with an empty qualified class name."""
    return df.filter(~F.exists("ancestors", lambda a: a["kind"].isin("anonymous", "local"))
                     & F.col(qualified).isNotNull() & (F.col(qualified) != ""))


# ---------------------------------------------------------------- X13
def qualified_type_name(types: DataFrame, packages: DataFrame | None = None,
                        keys: Sequence[str] = ("project", "path")) -> DataFrame:
    """``outer.inner`` name from the enclosing types (innermost first in ``ancestors``);
    unresolved types get their file's package as prefix, joined with a dot."""
    keys = list(keys)
    outer = F.reverse(F.transform("ancestors", lambda a: a["name"]))
    local = F.array_join(F.concat(outer, F.array(F.col("name"))), ".")
    t = types.withColumn("_local", local)
    if packages is not None:
        p = packages.groupBy(*keys).agg(F.min("package").alias("_pkg"))
        t = t.join(p, keys, "left")
    else:
        t = t.withColumn("_pkg", F.lit(None).cast("string"))
    q = F.when(F.col("resolved"), F.col("binding_name")).otherwise(F.concat_ws(".", F.col("_pkg"), F.col("_local")))
    return t.withColumn("qualified_name", q).drop("_local", "_pkg")


# ---------------------------------------------------------------- X14
TYPE_KINDS = ("class", "interface", "enum", "annotation")


def type_declarations(types: DataFrame) -> DataFrame:
    """Distinct (project, path, qualified_name, kind code 0..3, resolved)."""
    code = (F.when(F.col("kind") == "class", 0).when(F.col("kind") == "interface", 1)
            .when(F.col("kind") == "enum", 2).when(F.col("kind") == "annotation", 3))
    return (types.filter(F.col("kind").isin(*TYPE_KINDS))
            .select("project", "path", "qualified_name", code.alias("kind_code"), "resolved").distinct())


# ---------------------------------------------------------------- X15
def package_declarations(pkgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (project, package, dir) and the files that declare more than one package."""
    d = pkgs.select("project", "package", "dir").distinct()
    multi = (pkgs.groupBy("project", "path").agg(F.count_distinct("package").alias("n_packages"))
             .filter(F.col("n_packages") > 1))
    return d, multi


# ---------------------------------------------------------------- X16
def public_members(methods: DataFrame, fields: DataFrame, calls: DataFrame) -> DataFrame:
    """Public methods, public fields and resolved calls (by key) with a ``kind`` column."""
    cols = ["project", "cls", "name"]
    m = methods.filter(F.col("is_public")).select(*cols, F.lit("method").alias("kind"))
    f = fields.filter(F.col("is_public")).select(*cols, F.lit("field").alias("kind"))
    c = calls.filter(F.col("cls").isNotNull()).select(*cols, F.lit("call").alias("kind")).distinct()
    return m.unionByName(f).unionByName(c)


# ---------------------------------------------------------------- X17
def relevant_files(files: DataFrame, facts: DataFrame, keys: Sequence[str] = ("repo", "idx", "path"),
                   content: str = "content") -> DataFrame:
    """Text and line count only for files that yielded at least one fact."""
    from codetrail.functions.text import java_lines
    keys = list(keys)
    f = files.join(facts.select(*keys).distinct(), keys, "left_semi")
    return f.withColumn("n_lines", F.size(java_lines(F.col(content))))


# ---------------------------------------------------------------- X19
def merge_projects(*dfs: DataFrame, distinct: bool = True) -> DataFrame:
    """Union of per-project results (null parts skipped), set-merged when ``distinct``."""
    parts = [d for d in dfs if d is not None]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out.distinct() if distinct else out


# ---------------------------------------------------------------- X20
def extraction_report(invocations: DataFrame, decls: DataFrame, packages: DataFrame, types: DataFrame) -> DataFrame:
    """Totals: calls (sum of line counts), unique (file, method) calls, declarations, packages, types.

    Each total is a partial aggregate (the two of the calls one together); the five values are stacked as rows and
    pivoted into one row (no join between the aggregates).
    """
    calls = invocations.agg(F.sum(F.size("lines")).cast("long").alias("n_calls"), F.count(F.lit(1)).alias("n_unique_calls"))
    parts = [
        calls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in calls.columns])).alias("_p"))
        .select("_p.k", "_p.v"),
        decls.agg(F.count(F.lit(1)).alias("v")).select(F.lit("n_declarations").alias("k"), "v"),
        packages.agg(F.count(F.lit(1)).alias("v")).select(F.lit("n_packages").alias("k"), "v"),
        types.agg(F.count(F.lit(1)).alias("v")).select(F.lit("n_types").alias("k"), "v"),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    names = ["n_calls", "n_unique_calls", "n_declarations", "n_packages", "n_types"]
    return stacked.groupBy().pivot("k", names).agg(F.first("v")).select(*names)
