"""Landed tables derived from the driver's test tables.

The library's inputs are landed tables (commit logs, file changes, parsed
facts, ...).  For tests and the registered queries they are derived from the
TPC-H-like test tables, so that every query's work grows with the data:

* commits        repo = o_custkey, sha = o_orderkey, oldest first by (o_orderdate, o_orderkey)
* file_changes   one row per (commit, l_partkey % 7); kind from the set of l_returnflag values
* items          line items with their part (new side) and the part numbered l_suppkey (old side)
* decl_facts     non-R items of a file version: name = p_name with '_', n_args = p_size % 3,
                 varargs = (p_type = 'PROMO'), one method line per item
* call_facts     one library call (lower(p_type)_(p_size % 4)) in each method body
* snapshots      file text of each version: imports, class line, one method per item, '}'
* diffs          word diff and line diff text of every edited (M/R) file, one hunk line per item
* api_catalog    one public-or-not library method per part

The matching DuckDB definitions live in ``codetrail.plans.oracle_carriers``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrail.operators.history import first_parent_chain, expand_changes, file_intervals
from codetrail.operators.facts import distinct_facts
from codetrail.functions.lineage import materialize
from codetrail.session import join_by_measured_size

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

N_PATHS = 7
# (l_orderkey, l_linenumber, l_partkey, l_suppkey) is not unique in every test set; items that tie on all of these are equal.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


def path_of(fno) -> F.Column:
    return F.concat(F.lit("src/F"), fno.cast("string"), F.lit(".java"))


class Landed:
    """Lazily built landed tables for one scale-factor folder.

    Derived tables are materialised once (reliable checkpoint) the first time
    they are used; ``Landed.get`` shares them between the queries of one Spark
    application, the way landed input tables are shared in production.
    """

    _shared: dict[tuple[str, str], "Landed"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str) -> "Landed":
        join_by_measured_size(spark)
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in cls._shared:
            cls._shared[key] = cls(spark, sf_dir)
        return cls._shared[key]

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- commit history -------------------------------------------------
    @cached_property
    def commit_log(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_custkey").alias("repo"), F.col("o_orderkey").cast("string").alias("sha"),
            F.col("o_orderkey").alias("okey"), F.col("o_orderdate").alias("ts"),
            F.col("o_orderpriority").alias("subject"))

    @cached_property
    def commits(self) -> DataFrame:
        return materialize(first_parent_chain(self.commit_log, order=["ts", "okey"]))

    @cached_property
    def repos(self) -> DataFrame:
        return self.t("customer").select(F.col("c_custkey").alias("repo"), F.col("c_name").alias("repo_name"),
                                         F.lower("c_mktsegment").alias("default_branch"))

    @cached_property
    def commit_keys(self) -> DataFrame:
        return self.commits.select("okey", "repo", "idx")

    @cached_property
    def touched(self) -> DataFrame:
        """A row per commit and file it touches: the kind of change and the line items in order.  An order's line items meet
        its commit and each other in one place."""
        li = self.t("lineitem").select("l_orderkey", *LINE_ORDER)
        at = li.join(self.commit_keys, li["l_orderkey"] == self.commit_keys["okey"]).withColumn(
            "fno", (F.col("l_partkey") % N_PATHS).cast("int"))
        g = at.groupBy("okey", "repo", "idx", "fno").agg(
            F.array_sort(F.collect_list(F.struct(*LINE_ORDER))).alias("lines"),
            F.min("l_returnflag").alias("fmin"), F.max("l_returnflag").alias("fmax"))
        kind = (F.when(F.col("fmax") == "A", "A").when(F.col("fmin") == "R", "D")
                .when((F.col("fmin") == "A") & (F.col("fmax") == "R"), "R").otherwise("M"))
        return materialize(g.select("repo", "idx", "fno", kind.alias("kind"), "lines"))

    @cached_property
    def lines(self) -> DataFrame:
        """lineitem rows placed on their commit, with the file number they touch and their place in it (``ord``)."""
        x = self.touched.select("repo", "idx", "fno", "kind", F.posexplode("lines").alias("ord", "_l"))
        return x.select("repo", "idx", "fno", "kind", "ord", "_l.*")

    @cached_property
    def file_changes(self) -> DataFrame:
        path, kind = path_of(F.col("fno")), F.col("kind")
        old = F.concat(F.lit("src/old/F"), F.col("fno").cast("string"), F.lit(".java"))
        return materialize(self.touched.select(
            "repo", "idx", "kind", F.when(kind == "R", old).when(kind == "A", F.lit(None).cast("string")).otherwise(path)
            .alias("old_path"), path.alias("path")))

    @cached_property
    def intervals(self) -> DataFrame:
        return materialize(file_intervals(expand_changes(self.file_changes)))

    # --- code facts -----------------------------------------------------
    @cached_property
    def part_facts(self) -> DataFrame:
        return self.t("part").select(
            "p_partkey", F.regexp_replace("p_name", " ", "_").alias("name"),
            (F.col("p_size") % 3).cast("int").alias("n_args"),
            (F.col("p_type") == "PROMO").alias("varargs"), "p_size", "p_type", "p_brand",
            F.concat(F.lower("p_type"), F.lit("_"), (F.col("p_size") % 4).cast("string")).alias("api"),
            F.concat(F.lit("org.lib."), F.lower("p_type"), F.lit("."), F.regexp_replace("p_brand", "#", "")).alias("cls"))

    @cached_property
    def file_items(self) -> DataFrame:
        """A row per commit and file with its line items, their part (new side / declared method) and partner part (old
        side), in order.  Texts are made from such a row, after the items met: the items travel, not their texts."""
        p = self.t("part")
        new = p.select("p_partkey", "p_name", "p_size", "p_type", "p_brand")
        old = p.select(F.col("p_partkey").alias("q_partkey"), F.col("p_name").alias("q_name"), F.col("p_size").alias("q_size"))
        li = self.lines
        j = li.join(old, li["l_suppkey"] == old["q_partkey"]).join(new, li["l_partkey"] == new["p_partkey"])
        g = j.groupBy("repo", "idx", "fno", "kind").agg(F.array_sort(F.collect_list(F.struct(
            "ord", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "p_name", "p_size", "p_type", "p_brand",
            "q_name", "q_size"))).alias("_i"))
        return materialize(g)

    @cached_property
    def _live_versions(self) -> DataFrame:
        """``file_items`` with ``live``, the non-R items: the content of the file version opened at the commit, where there is
        any."""
        return (self.file_items.filter(F.exists("_i", lambda i: i["l_returnflag"] != "R"))
                .withColumn("live", F.filter("_i", lambda i: i["l_returnflag"] != "R")))

    @cached_property
    def items(self) -> DataFrame:
        """Line items with their part and partner part; ``r`` is their place in the file."""
        x = self.file_items.select("repo", "idx", "fno", "kind", F.posexplode("_i").alias("_r", "_i"))
        return x.select("repo", "idx", "fno", "kind", *[c.alias(n) for n, c in named(F.col("_i")).items()], (F.col("_r") + 1).alias("r"))

    @cached_property
    def live_items(self) -> DataFrame:
        """Non-R items, with their place ``rl`` among the ``k`` of the file version.  They are rows before names are made of
        them, so that only what is asked for is made."""
        x = self.file_items.withColumn("_live", F.filter("_i", lambda i: i["l_returnflag"] != "R"))
        x = x.select("repo", "idx", "fno", F.size("_live").cast("long").alias("k"), F.posexplode("_live").alias("_r", "_i"))
        return x.select("repo", "idx", "fno", *[c.alias(n) for n, c in named(F.col("_i")).items()], (F.col("_r") + 1).alias("rl"), "k")

    @cached_property
    def live_files(self) -> DataFrame:
        """The file versions that have content, with their number of items."""
        return self._live_versions.select(
            "repo", "idx", path_of(F.col("fno")).alias("path"), "fno", F.size("live").cast("long").alias("k"))

    @cached_property
    def decl_facts(self) -> DataFrame:
        """Raw declaration facts in file order (may repeat an identity)."""
        li = self.live_items
        start = F.col("k") + 1 + F.col("rl")
        return li.select(
            "repo", "idx", path_of(F.col("fno")).alias("path"),
            F.struct(F.col("rl").alias("rl")).alias("pos"),
            "name", "n_args", "varargs", F.lit(False).alias("is_constructor"),
            start.cast("int").alias("line_start"), (start + F.col("p_size") % 2).cast("int").alias("line_end"))

    @cached_property
    def decls(self) -> DataFrame:
        """X7 applied: one declaration per file version and identity, first in file order."""
        # dealt by file version, which their intervals are joined on too
        return distinct_facts(self.decl_facts.repartition("repo", "path", "idx"), ["repo", "idx", "path", "name", "n_args", "varargs"], "pos")

    @cached_property
    def decl_versions(self) -> DataFrame:
        """Declarations with the validity interval of the file version that holds them."""
        iv = self.intervals.withColumnRenamed("valid_from", "idx")
        return materialize(self.decls.join(iv, ["repo", "path", "idx"]).withColumnRenamed("idx", "valid_from"))

    @cached_property
    def calls(self) -> DataFrame:
        """Distinct (repo, idx, name, n_args) call sites of every commit (part names)."""
        j = self.lines.join(self.part_facts, self.lines["l_partkey"] == self.part_facts["p_partkey"])
        return j.select("repo", "idx", "name", "n_args").distinct()

    @cached_property
    def call_facts(self) -> DataFrame:
        """Library calls inside the method bodies of each file version (one per live item)."""
        li = self.live_items
        return li.select("repo", "idx", path_of(F.col("fno")).alias("path"), F.col("api").alias("name"),
                         "n_args", (F.col("k") + 1 + F.col("rl")).cast("int").alias("line"))

    @cached_property
    def call_versions(self) -> DataFrame:
        """Distinct calls of each file version with the version's validity interval."""
        iv = self.intervals.withColumnRenamed("valid_from", "idx")
        live = self.call_facts.select("repo", "idx", "path", "name", "n_args").repartition("repo", "path", "idx").distinct()
        return materialize(live.join(iv, ["repo", "path", "idx"]).withColumnRenamed("idx", "valid_from"))

    # --- file text ------------------------------------------------------
    @cached_property
    def snapshots(self) -> DataFrame:
        """File text stored at the commit that opened each version: imports, class, one method per item."""
        def imp(i):
            return F.concat(F.lit("import "), named(i)["cls"], F.lit(";"))

        def meth(i):
            i = named(i)
            return F.concat(F.lit("    void "), i["name"], F.lit("() { return lib."), i["api"], F.lit("("),
                            args_text(i["n_args"]), F.lit("); }"))
        content = F.concat_ws("\n", F.array_join(F.transform("live", imp), "\n"),
                              F.concat(F.lit("public class F"), F.col("fno").cast("string"), F.lit(" {")),
                              F.array_join(F.transform("live", meth), "\n"), F.lit("}"))
        return materialize(self._live_versions.select(
            "repo", "idx", path_of(F.col("fno")).alias("path"), content.alias("content")))

    @cached_property
    def parsed_xml(self) -> DataFrame:
        """Parser listings (calls, declarations, types, spans) of each file version, see ``xml_units``."""
        return materialize(self._listings(*LISTINGS))

    def listing(self, name: str) -> DataFrame:
        """One of the four, made where it is read: its text is neither moved nor written.  A generator makes it, so that a
        filter on the text doesn't make it again."""
        x = self._listings(name)
        keys = [c for c in x.columns if c != name]
        return x.select(*keys, F.explode(F.array(name)).alias(name))

    def _listings(self, *names: str) -> DataFrame:
        k = F.size("live").cast("long")

        def units(kind):
            return F.transform("live", lambda i, n: xml_units(named(i), n + 1, k)[kind])
        g = self._live_versions.select("repo", "idx", "fno", k.alias("k"), *[units(LISTINGS[c]).alias("_" + c) for c in names])
        return g.select("repo", "idx", path_of(F.col("fno")).alias("path"),
                        *[listing_text(c, F.col("_" + c)).alias(c) for c in names])

    @cached_property
    def diffs(self) -> DataFrame:
        """Word diff and line diff text of every edited file (kinds M and R)."""
        old_path = F.when(F.col("kind") == "R", F.concat(F.lit("src/old/F"), F.col("fno").cast("string"), F.lit(".java"))).otherwise(
            path_of(F.col("fno")))
        it = self.file_items.filter(F.col("kind").isin("M", "R")).select(
            "repo", "idx", "_i", old_path.alias("old_path"), path_of(F.col("fno")).alias("path"))
        g = it.select("repo", "idx", "old_path", "path", F.transform(
            "_i", lambda i, n: diff_texts(named(i), n + 1, F.col("old_path"), F.col("path"))).alias("_f"))
        return materialize(g.select("repo", "idx", "old_path", "path",
                           F.array_join(F.transform("_f", lambda x: x["w"]), "\n").alias("word_diff"),
                           F.array_join(F.transform("_f", lambda x: x["l"]), "\n").alias("line_diff")))

    # --- mining (shared by the mining queries of one application) --------
    @cached_property
    def mining(self):
        return mining_inputs(self)

    @cached_property
    def checked(self):
        """Candidate replacements that pass the project-state checks (G1-G9), materialised."""
        from codetrail.plans.mining import candidate_pairs, checked_pairs
        return materialize(checked_pairs(self.mining, candidate_pairs(self.mining)))

    @cached_property
    def members(self):
        """The checked candidates with their groups' numbers, materialised."""
        from codetrail.plans.mining import members_of
        return materialize(members_of(self.checked))

    @cached_property
    def mined_groups(self):
        from codetrail.plans.mining import replacement_groups
        return materialize(replacement_groups(self.mining, self.members))

    @cached_property
    def mined(self):
        from codetrail.plans.mining import mine_replacements
        return mine_replacements(self.mining, materialize_inputs=False)

    # --- library knowledge ---------------------------------------------
    @cached_property
    def api_catalog(self) -> DataFrame:
        """Library declarations: one per part (project group|artifact|version, class, name, arity)."""
        p = self.t("part")
        return p.select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("org.lib|"), F.lower("p_type"), F.lit("|1."), (F.col("p_size") % 3).cast("string")).alias("project"),
            F.concat(F.lit("org.lib."), F.lower("p_type"), F.lit("."), F.regexp_replace("p_brand", "#", "")).alias("class"),
            F.concat(F.lower("p_type"), F.lit("_"), (F.col("p_size") % 4).cast("string")).alias("name"),
            (F.col("p_size") % 3).cast("int").alias("n_args"),
            (F.col("p_size") % 5 != 0).alias("is_public"))

    @cached_property
    def library_packages(self) -> DataFrame:
        """Packages declared by each library project: the type package and one sub-package per brand."""
        c = self.api_catalog
        top = c.select("project", F.regexp_extract("class", r"^(.*)\.[^.]+$", 1).alias("package"))
        sub = c.select("project", F.lower(F.col("class")).alias("package"))
        return top.union(sub).distinct()


def mining_inputs(L: "Landed"):
    from codetrail.operators.deps import base_packages
    from codetrail.plans.mining import MiningInputs
    return MiningInputs(
        commits=L.commits, repos=L.repos, file_changes=L.file_changes, diffs=L.diffs, snapshots=L.snapshots,
        intervals=L.intervals, decl_versions=L.decl_versions, call_versions=L.call_versions,
        api_catalog=L.api_catalog, base_packages=base_packages(L.library_packages))


XML_HEAD = ('<unit xmlns="http://www.srcML.org/srcML/src" xmlns:pos="http://www.srcML.org/srcML/position" '
            'revision="1.0.0">')


# listing -> the unit of ``xml_units`` it is made of
LISTINGS = {"calls_xml": "call_u", "decls_xml": "decl_u", "types_xml": "type_u", "spans_xml": "span_u"}


def listing_text(name: str, units) -> F.Column:
    """A listing of a file version with number ``fno`` and ``k`` live items, from their ``units``."""
    k, fno = F.col("k"), F.col("fno").cast("string")
    # a unit that breaks off follows the good ones
    broken = F.lit('\n<unit revision="1.0.0" language="Java" item="0"><call><name>cut</unit>\n</unit>')
    if name == "calls_xml":
        calls = F.concat(F.lit(XML_HEAD + "\n"), F.array_join(units, "\n"), broken)
        return F.when((F.col("fno") == 6) & (k == 1), F.lit("srcML translator error: cannot parse")).otherwise(calls)
    if name == "decls_xml":
        ctor = F.when(k % 2 == 0, F.concat(
            F.lit('\n<unit revision="1.0.0" language="Java" item="'), (k + 1).cast("string"),
            F.lit('"><constructor pos:start="'), (k + 1).cast("string"), F.lit(':5" pos:end="'), (k + 1).cast("string"),
            F.lit(':30"><name>F'), fno, F.lit('</name><parameter_list pos:start="'), (k + 1).cast("string"),
            F.lit(':20">()</parameter_list><block>{}</block></constructor></unit>'))).otherwise(F.lit(""))
        return F.concat(F.lit(XML_HEAD + "\n"), F.array_join(units, "\n"), ctor, broken)
    if name == "types_xml":
        cls_units = F.concat(F.lit('<unit revision="1.0.0" item="1">start="'), (k + 1).cast("string"),
                             F.lit(':1"</unit>\n<unit revision="1.0.0" item="2">end="'), (2 * k + 2).cast("string"),
                             F.lit(':1"</unit>\n<unit revision="1.0.0" item="3">F'), fno, F.lit("</unit>"))
        anon = F.array_join(F.filter(units, lambda t: t != ""), "\n")
        return F.concat_ws("\n", F.lit("<unit>"), cls_units, F.when(anon != "", anon), F.lit("</unit>"))
    spans = F.when(F.col("fno") == 0, F.concat(
        F.slice(units, 1, F.size(units) - 1),
        F.array(F.regexp_replace(F.element_at(units, -1), "\n[^\n]*$", "")))).otherwise(units)
    return F.concat_ws("\n", F.lit("<unit>"), F.array_join(spans, "\n"), F.lit("</unit>"))


def named(i) -> dict[str, F.Column]:
    """A line item of ``file_items`` and the names and arities that its parts stand for.  They are columns by name, not a
    struct: only those are worked out that a text is made of."""
    def plain(name):
        return F.replace(i[name], F.lit(" "), F.lit("_"))

    return {**{c: i[c] for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "p_size", "p_type", "p_brand")},
            "name": plain("p_name"), "n_args": (i["p_size"] % 3).cast("int"), "varargs": i["p_type"] == "PROMO",
            "api": F.concat(F.lower(i["p_type"]), F.lit("_"), (i["p_size"] % 4).cast("string")),
            "cls": F.concat(F.lit("org.lib."), F.lower(i["p_type"]), F.lit("."), F.replace(i["p_brand"], F.lit("#"), F.lit(""))),
            "old_name": plain("q_name"), "old_n_args": (i["q_size"] % 3).cast("int")}


def xml_units(i, rl, k) -> F.Column:
    """Of the ``rl``-th of ``k`` live items (``named``): its call unit, declaration unit, anonymous-class tokens and span tokens."""
    ln = i["l_linenumber"]
    place = rl.cast("string")
    line = (k + 1 + rl).cast("string")
    end = (k + 1 + rl + i["p_size"] % 2).cast("string")
    api = i["api"]
    name_xml = (F.when(ln % 3 == 0, F.concat(F.lit("<name>lib</name><operator>.</operator><name>"), api, F.lit("</name>")))
                .when(ln % 3 == 1, F.concat(F.lit("<name>"), api, F.lit(
                    "</name><argument_list type=\"generic\">&lt;<argument><name><name>java</name><operator>.</operator>"
                    "<name>T</name></name></argument>&gt;</argument_list>")))
                .otherwise(api))
    a1 = "<argument><expr><name>a</name></expr></argument>"
    n = i["n_args"]
    args_xml = (F.when(n == 0, F.lit("")).when(n == 1, F.lit(a1))
                .otherwise(F.concat(F.lit(a1 + ", <argument><expr><call><name>f</name><argument_list pos:start=\""), line,
                                    F.lit(':20">(<argument><expr>x</expr></argument>)</argument_list></call></expr></argument>'))))
    call_u = F.concat(F.lit('<unit revision="1.0.0" language="Java" item="'), place, F.lit('"><call><name>'), name_xml,
                      F.lit('</name><argument_list pos:start="'), line, F.lit(':9" pos:end="'), line, F.lit(':30">('),
                      args_xml, F.lit(")</argument_list></call></unit>"))
    p1 = "<parameter><decl><type><name>int</name></type> <name>a</name></decl></parameter>"
    params = F.when(n == 0, F.lit("")).when(n == 1, F.lit(p1)).otherwise(F.lit(p1 + ", " + p1.replace(">a<", ">b<")))
    va = "<parameter><decl><type><name>String</name>...</type> <name>rest</name></decl></parameter>"
    params = F.when(i["varargs"], F.concat(params, F.when(n > 0, F.lit(", ")).otherwise(F.lit("")), F.lit(va))).otherwise(params)
    decl_u = F.concat(F.lit('<unit revision="1.0.0" language="Java" item="'), place, F.lit('"><function pos:start="'), line,
                      F.lit(':5" pos:end="'), end, F.lit(':5"><type><name>void</name></type> <name>'), i["name"],
                      F.lit('</name><parameter_list pos:start="'), line, F.lit(':20">('), params,
                      F.lit(')</parameter_list><block>{<block_content/>}</block></function></unit>'))
    type_u = F.when(ln % 3 == 0, F.concat(F.lit('<unit revision="1.0.0" item="9">start="'), line,
                                          F.lit(':30"</unit>\n<unit revision="1.0.0" item="9">end="'), line,
                                          F.lit(':40"</unit>'))).otherwise(F.lit(""))
    span_u = F.concat(F.lit('<unit revision="1.0.0" item="1">start="'), line, F.lit(':5"</unit>\n<unit revision="1.0.0" item="2">end="'),
                      end, F.lit(':5"</unit>\n<unit revision="1.0.0" item="3">'), i["name"], F.lit("</unit>"))
    return F.struct(call_u.alias("call_u"), decl_u.alias("decl_u"), type_u.alias("type_u"), span_u.alias("span_u"))


def diff_texts(i, r, old_path, path) -> F.Column:
    """The ``r``-th item (``named``) of an edited file in its word diff (``w``) and its line diff (``l``)."""
    ln = i["l_linenumber"]
    pre = F.when(ln % 2 == 0, F.lit("x.size().")).otherwise(F.lit(""))
    old_call = F.concat(pre, i["old_name"], F.lit("("), args_text(i["old_n_args"]), F.lit(")"))
    new_call = F.concat(pre, F.lit("lib."), i["api"], F.lit("("), args_text(i["n_args"]), F.lit(")"))
    # variants: 0 an old call in a comment, 1 the same calls, 2 only an added call, 3 an assertion, 5 equal left texts
    v = diff_variant(i)
    old_args, new_args = args_text(i["old_n_args"]), args_text(i["n_args"])
    new_call = (F.when(v == 1, F.concat(pre, F.lit("lib."), i["old_name"], F.lit("("), old_args, F.lit(")")))
                .when(v == 2, F.concat(old_call, F.lit(".then()")))
                .when(v == 3, F.concat(pre, F.lit("assertOf("), new_args, F.lit(")")))
                .when(v == 5, F.concat(pre, i["api"], F.lit("("), new_args, F.lit(")"))).otherwise(new_call))
    old_call = F.when(v == 0, F.concat(old_call, F.lit(" /* "), i["name"], F.lit("(1) */"))).otherwise(old_call)
    flag = i["l_returnflag"]
    head = F.when(r == 1, F.concat(
        F.lit("diff --git a/"), old_path, F.lit(" b/"), path, F.lit("\n--- a/"),
        old_path, F.lit("\n+++ b/"), path))
    b = ln * 10 + i["l_suppkey"] % 7
    a = b + i["l_partkey"] % 5
    hunk = F.when((r == 1) | (ln % 3 == 1), F.when(
        i["l_suppkey"] % 4 == 0,
        F.concat(F.lit("@@ -"), b.cast("string"), F.lit(" +"), a.cast("string"), F.lit(" @@")))
        .otherwise(F.concat(F.lit("@@ -"), b.cast("string"), F.lit(","), (i["l_suppkey"] % 3 + 1).cast("string"),
                            F.lit(" +"), a.cast("string"), F.lit(","), (i["l_partkey"] % 3 + 1).cast("string"),
                            F.lit(" @@"))))
    blank_w = F.when(ln == 4, F.lit(""))
    blank_l = F.when(ln == 4, F.lit(" "))
    word = (F.when(flag == "N", F.concat(F.lit("    v"), ln.cast("string"), F.lit(" = [-"), old_call,
                                         F.lit("-]{+"), new_call, F.lit("+};")))
            .when(flag == "A", F.concat(F.lit("{+import "), i["cls"], F.lit(";+}")))
            .otherwise(F.concat(F.lit("[-import org.old."), i["name"], F.lit(";-]"))))
    line = (F.when(flag == "N", F.concat(F.lit("-    v"), ln.cast("string"), F.lit(" = "), old_call, F.lit(";\n+    v"),
                                         ln.cast("string"), F.lit(" = "), new_call, F.lit(";")))
            .when(flag == "A", F.concat(F.lit("+import "), i["cls"], F.lit(";")))
            .otherwise(F.concat(F.lit("-import org.old."), i["name"], F.lit(";"))))
    frag_w = F.concat_ws("\n", head, hunk, word, blank_w)
    frag_l = F.concat_ws("\n", head, hunk, line, blank_l)
    return F.struct(frag_w.alias("w"), frag_l.alias("l"))


def diff_variant(i) -> F.Column:
    """How the replaced text of an item differs from a plain replacement (see ``Landed.diffs``); 4 is plain."""
    skipped = (i["l_suppkey"] % 5 == 4) & (i["l_linenumber"] % 2 == 0) & (i["l_partkey"] % 3 == 0)
    return F.when(skipped, 5).otherwise((i["l_suppkey"] % 5).cast("int"))


def args_text(n: F.Column) -> F.Column:
    return F.when(n == 0, F.lit("")).when(n == 1, F.lit("a")).otherwise(F.lit("a, b"))
