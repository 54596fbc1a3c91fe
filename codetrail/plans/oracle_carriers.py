"""DuckDB definitions of the landed carrier tables (see ``codetrail.sources.carriers``).

These are plain-SQL restatements used only by the correctness oracles; the
Spark side builds the same tables with the library's own operators.
"""

from __future__ import annotations

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"

_CTES: dict[str, tuple[str, list[str]]] = {}


def _cte(name: str, deps: list[str], sql: str) -> None:
    _CTES[name] = (sql, deps)


_cte("commits", [], f"""
SELECT repo, sha, okey, ts, subject, idx, total,
       coalesce(lag(sha) OVER (PARTITION BY repo ORDER BY idx), '{EMPTY_TREE}') AS parent_sha
FROM (SELECT o_custkey AS repo, CAST(o_orderkey AS VARCHAR) AS sha, o_orderkey AS okey,
             o_orderdate AS ts, o_orderpriority AS subject,
             CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS idx,
             CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS total
      FROM orders) t""")

_cte("lines", ["commits"], """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_returnflag,
       l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_shipdate, c.repo, c.idx,
       CAST(l.l_partkey % 7 AS INTEGER) AS fno
FROM lineitem l JOIN commits c ON l.l_orderkey = c.okey""")

_cte("file_changes", ["lines"], """
SELECT repo, idx, kind,
       CASE WHEN kind = 'R' THEN 'src/old/F' || CAST(fno AS VARCHAR) || '.java'
            WHEN kind = 'A' THEN NULL
            ELSE 'src/F' || CAST(fno AS VARCHAR) || '.java' END AS old_path,
       'src/F' || CAST(fno AS VARCHAR) || '.java' AS path
FROM (SELECT repo, idx, fno,
             CASE WHEN max(l_returnflag) = 'A' THEN 'A'
                  WHEN min(l_returnflag) = 'R' THEN 'D'
                  WHEN min(l_returnflag) = 'A' AND max(l_returnflag) = 'R' THEN 'R'
                  ELSE 'M' END AS kind
      FROM lines GROUP BY repo, idx, fno) t""")

_cte("file_events", ["file_changes"], """
SELECT repo, idx, old_path AS path, 'delete' AS event FROM file_changes WHERE kind IN ('M', 'R')
UNION ALL SELECT repo, idx, path, 'delete' FROM file_changes WHERE kind = 'D'
UNION ALL SELECT repo, idx, path, 'add' FROM file_changes WHERE kind IN ('A', 'C', 'M', 'R')""")

_cte("intervals", ["file_events"], """
SELECT repo, path, idx AS valid_from, valid_to
FROM (SELECT repo, path, idx, is_add, lead(idx) OVER (PARTITION BY repo, path ORDER BY idx) AS valid_to
      FROM (SELECT repo, path, idx, max(CASE WHEN event = 'add' THEN 1 ELSE 0 END) AS is_add
            FROM file_events GROUP BY repo, path, idx) e) t
WHERE is_add = 1""")

_cte("part_facts", [], """
SELECT p_partkey, replace(p_name, ' ', '_') AS name, CAST(p_size % 3 AS INTEGER) AS n_args,
       p_type = 'PROMO' AS varargs, p_size, p_type, p_brand,
       lower(p_type) || '_' || CAST(p_size % 4 AS VARCHAR) AS api,
       'org.lib.' || lower(p_type) || '.' || replace(p_brand, '#', '') AS cls
FROM part""")

ARGS = "CASE {n} WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a, b' END"

_cte("items", ["lines", "part_facts"], """
SELECT l.*, p.name, p.n_args, p.varargs, p.p_size, p.p_type, p.p_brand, p.api, p.cls, q.name AS old_name, q.n_args AS old_n_args,
       row_number() OVER (PARTITION BY l.repo, l.idx, l.fno ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
                          l.l_returnflag, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_shipdate) AS r
FROM lines l JOIN part_facts p ON l.l_partkey = p.p_partkey JOIN part_facts q ON q.p_partkey = l.l_suppkey""")

_cte("live_items", ["items"], """
SELECT *, row_number() OVER (PARTITION BY repo, idx, fno ORDER BY l_linenumber, l_partkey, l_suppkey,
                             l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rl,
       count(*) OVER (PARTITION BY repo, idx, fno) AS k
FROM items WHERE l_returnflag <> 'R'""")

_cte("decl_facts", ["live_items"], """
SELECT repo, idx, 'src/F' || CAST(fno AS VARCHAR) || '.java' AS path,
       rl AS ln, l_partkey AS pk, l_suppkey AS sk,
       name, n_args, varargs, false AS is_constructor,
       CAST(k + 1 + rl AS INTEGER) AS line_start, CAST(k + 1 + rl + p_size % 2 AS INTEGER) AS line_end
FROM live_items""")

_cte("decls", ["decl_facts"], """
SELECT repo, idx, path, name, n_args, varargs, is_constructor, line_start, line_end, ln, pk, sk
FROM (SELECT *, row_number() OVER (PARTITION BY repo, idx, path, name, n_args, varargs
                                   ORDER BY ln, pk, sk) AS rn FROM decl_facts) t
WHERE rn = 1""")

_cte("decl_versions", ["decls", "intervals"], """
SELECT d.repo, d.path, d.name, d.n_args, d.varargs, d.is_constructor, d.line_start, d.line_end,
       v.valid_from, v.valid_to
FROM decls d JOIN intervals v ON d.repo = v.repo AND d.path = v.path AND d.idx = v.valid_from""")

_cte("calls", ["lines", "part_facts"], """
SELECT DISTINCT l.repo, l.idx, p.name, p.n_args FROM lines l JOIN part_facts p ON l.l_partkey = p.p_partkey""")

_cte("call_facts", ["live_items"], """
SELECT repo, idx, 'src/F' || CAST(fno AS VARCHAR) || '.java' AS path, api AS name, n_args,
       CAST(k + 1 + rl AS INTEGER) AS line
FROM live_items""")

_cte("call_versions", ["call_facts", "intervals"], """
SELECT c.repo, c.path, c.name, c.n_args, v.valid_from, v.valid_to
FROM (SELECT DISTINCT repo, idx, path, name, n_args FROM call_facts) c
JOIN intervals v ON c.repo = v.repo AND c.path = v.path AND c.idx = v.valid_from""")

_cte("snapshots", ["live_items"], f"""
SELECT repo, idx, 'src/F' || CAST(fno AS VARCHAR) || '.java' AS path,
       string_agg('import ' || cls || ';', chr(10) ORDER BY rl) || chr(10) || 'public class F' || CAST(fno AS VARCHAR)
       || ' {{' || chr(10) ||
       string_agg('    void ' || name || '() {{ return lib.' || api || '(' || {ARGS.format(n="n_args")} || '); }}',
                  chr(10) ORDER BY rl) || chr(10) || '}}' AS content
FROM live_items GROUP BY repo, idx, fno""")

_cte("edited_items", ["items", "file_changes"], """
SELECT i.*, f.old_path, f.path FROM items i JOIN file_changes f
  ON i.repo = f.repo AND i.idx = f.idx AND f.path = 'src/F' || CAST(i.fno AS VARCHAR) || '.java'
WHERE f.kind IN ('M', 'R')""")

_PRE = "CASE WHEN l_linenumber % 2 = 0 THEN 'x.size().' ELSE '' END"
# the same variants as the Spark side's diff_variant
_V = "CASE WHEN l_suppkey % 5 = 4 AND l_linenumber % 2 = 0 AND l_partkey % 3 = 0 THEN 5 ELSE l_suppkey % 5 END"
_OLD0 = f"{_PRE} || old_name || '(' || {ARGS.format(n='old_n_args')} || ')'"
_OLD = f"({_OLD0} || CASE WHEN {_V} = 0 THEN ' /* ' || name || '(1) */' ELSE '' END)"
_NEW = f"""(CASE {_V} WHEN 1 THEN {_PRE} || 'lib.' || old_name || '(' || {ARGS.format(n='old_n_args')} || ')'
  WHEN 2 THEN {_OLD0} || '.then()' WHEN 3 THEN {_PRE} || 'assertOf(' || {ARGS.format(n='n_args')} || ')'
  WHEN 5 THEN {_PRE} || api || '(' || {ARGS.format(n='n_args')} || ')'
  ELSE {_PRE} || 'lib.' || api || '(' || {ARGS.format(n='n_args')} || ')' END)"""
_B = "(l_linenumber * 10 + l_suppkey % 7)"
_A = f"({_B} + l_partkey % 5)"

_cte("diff_items", ["edited_items"], f"""
SELECT *,
  CASE WHEN r = 1 THEN 'diff --git a/' || old_path || ' b/' || path || chr(10) || '--- a/' || old_path
                       || chr(10) || '+++ b/' || path END AS head,
  CASE WHEN r = 1 OR l_linenumber % 3 = 1 THEN
       CASE WHEN l_suppkey % 4 = 0 THEN '@@ -' || CAST({_B} AS VARCHAR) || ' +' || CAST({_A} AS VARCHAR) || ' @@'
            ELSE '@@ -' || CAST({_B} AS VARCHAR) || ',' || CAST(l_suppkey % 3 + 1 AS VARCHAR) || ' +'
                 || CAST({_A} AS VARCHAR) || ',' || CAST(l_partkey % 3 + 1 AS VARCHAR) || ' @@' END END AS hunk_head,
  CASE WHEN r = 1 OR l_linenumber % 3 = 1 THEN {_B} END AS head_b,
  CASE WHEN r = 1 OR l_linenumber % 3 = 1 THEN {_A} END AS head_a,
  CASE WHEN r = 1 OR l_linenumber % 3 = 1 THEN CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE l_partkey % 3 + 1 END END AS head_na,
  CASE l_returnflag WHEN 'N' THEN '    v' || CAST(l_linenumber AS VARCHAR) || ' = [-' || {_OLD} || '-]{{+' || {_NEW} || '+}};'
                    WHEN 'A' THEN '{{+import ' || cls || ';+}}'
                    ELSE '[-import org.old.' || name || ';-]' END AS word_line,
  CASE l_returnflag WHEN 'N' THEN '-    v' || CAST(l_linenumber AS VARCHAR) || ' = ' || {_OLD} || ';' || chr(10)
                                  || '+    v' || CAST(l_linenumber AS VARCHAR) || ' = ' || {_NEW} || ';'
                    WHEN 'A' THEN '+import ' || cls || ';'
                    ELSE '-import org.old.' || name || ';' END AS unified_lines,
  {_OLD} AS old_text, {_NEW} AS new_text, {_V} AS variant
FROM edited_items""")

_cte("diffs", ["diff_items"], """
SELECT repo, idx, old_path, path,
  string_agg(concat_ws(chr(10), head, hunk_head, word_line, CASE WHEN l_linenumber = 4 THEN '' END), chr(10) ORDER BY r)
    AS word_diff,
  string_agg(concat_ws(chr(10), head, hunk_head, unified_lines, CASE WHEN l_linenumber = 4 THEN ' ' END), chr(10) ORDER BY r)
    AS line_diff
FROM diff_items GROUP BY repo, idx, old_path, path""")

_cte("api_catalog", [], """
SELECT p_partkey AS id, 'org.lib|' || lower(p_type) || '|1.' || CAST(p_size % 3 AS VARCHAR) AS project,
       'org.lib.' || lower(p_type) || '.' || replace(p_brand, '#', '') AS class,
       lower(p_type) || '_' || CAST(p_size % 4 AS VARCHAR) AS name, CAST(p_size % 3 AS INTEGER) AS n_args,
       p_size % 5 <> 0 AS is_public
FROM part""")

_cte("library_packages", ["api_catalog"], r"""
SELECT DISTINCT project, regexp_extract(class, '^(.*)\.[^.]+$', 1) AS package FROM api_catalog
UNION SELECT DISTINCT project, lower(class) FROM api_catalog""")


_cte("word_items", ["diff_items"], """
SELECT *, (CASE WHEN r = 1 THEN 3 ELSE 0 END) + (CASE WHEN hunk_head IS NOT NULL THEN 1 ELSE 0 END) AS pre_n,
       (CASE WHEN r = 1 THEN 3 ELSE 0 END) + (CASE WHEN hunk_head IS NOT NULL THEN 1 ELSE 0 END) + 1
       + (CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END) AS n_lines
FROM diff_items""")

_cte("word_items2", ["word_items"], """
SELECT *, coalesce(sum(n_lines) OVER (PARTITION BY repo, idx, path ORDER BY r
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos,
       sum(CASE WHEN hunk_head IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY repo, idx, path ORDER BY r
                   ROWS UNBOUNDED PRECEDING) AS hunk
FROM word_items""")

_cte("word_code", ["word_items2"], """
SELECT repo, idx, old_path, path, fno, start_pos + pre_n AS pos, hunk, ltrim(word_line) AS line,
       CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS ib, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS ia,
       l_returnflag, old_text, new_text, name, cls, l_linenumber, old_name, old_n_args, api, n_args, variant
FROM word_items2
UNION ALL
SELECT repo, idx, old_path, path, fno, start_pos + pre_n + 1, hunk, '', 1, 1, 'blank', NULL, NULL, NULL, NULL,
       l_linenumber, NULL, NULL, NULL, NULL, NULL
FROM word_items2 WHERE l_linenumber = 4""")

_cte("word_heads", ["word_items2"], """
SELECT repo, idx, path, hunk, head_b, head_a FROM word_items2 WHERE hunk_head IS NOT NULL""")

_cte("numbered", ["word_code", "word_heads"], """
SELECT c.*, CAST(h.head_b + coalesce(sum(c.ib) OVER w, 0) AS INTEGER) AS before,
       CAST(h.head_a + coalesce(sum(c.ia) OVER w, 0) AS INTEGER) AS after
FROM word_code c JOIN word_heads h ON c.repo = h.repo AND c.idx = h.idx AND c.path = h.path AND c.hunk = h.hunk
WINDOW w AS (PARTITION BY c.repo, c.idx, c.path, c.hunk ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

_cte("pairs", ["numbered"], """
SELECT repo, idx, old_path, path, fno, CAST(pos AS INTEGER) AS pos, CAST(hunk AS INTEGER) AS hunk, before, after,
       0 AS k, trim(old_text) AS removed, trim(new_text) AS added, l_linenumber,
       old_name, old_n_args, api AS new_name, n_args AS new_n_args,
       CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS n_calls, variant
FROM numbered WHERE l_returnflag = 'N'""")

_ALIVE = "{d}.valid_from <= {at} AND ({d}.valid_to IS NULL OR {d}.valid_to > {at})"
_ARITY = "CASE WHEN {d}.varargs THEN {d}.n_args <= {n} ELSE {d}.n_args = {n} END"

_cte("checked", ["pairs", "decl_versions", "call_versions"], f"""
SELECT p.* FROM pairs p
WHERE p.variant IN (0, 4) AND EXISTS (SELECT 1 FROM decl_versions d WHERE d.repo = p.repo AND d.name = p.old_name
              AND {_ARITY.format(d='d', n='p.old_n_args')} AND {_ALIVE.format(d='d', at='p.idx - 1')})
  AND NOT EXISTS (SELECT 1 FROM decl_versions d WHERE d.repo = p.repo AND d.name = p.old_name
              AND {_ARITY.format(d='d', n='p.old_n_args')} AND {_ALIVE.format(d='d', at='p.idx')})
  AND NOT EXISTS (SELECT 1 FROM decl_versions d WHERE d.repo = p.repo AND d.name = p.new_name
              AND {_ARITY.format(d='d', n='p.new_n_args')} AND {_ALIVE.format(d='d', at='p.idx')})
  AND EXISTS (SELECT 1 FROM call_versions v WHERE v.repo = p.repo AND v.name = p.new_name
              AND v.n_args = p.new_n_args AND {_ALIVE.format(d='v', at='p.idx')})""")


XML_HEAD = ('<unit xmlns="http://www.srcML.org/srcML/src" xmlns:pos="http://www.srcML.org/srcML/position" '
            'revision="1.0.0">')
_A1 = "<argument><expr><name>a</name></expr></argument>"
_P1 = "<parameter><decl><type><name>int</name></type> <name>a</name></decl></parameter>"
_P2 = _P1.replace(">a<", ">b<")
_VA = "<parameter><decl><type><name>String</name>...</type> <name>rest</name></decl></parameter>"

_cte("xml_units", ["live_items"], f"""
SELECT repo, idx, fno, k, rl, l_linenumber, api, name, n_args, varargs, p_size,
  CAST(k + 1 + rl AS INTEGER) AS line, CAST(k + 1 + rl + p_size % 2 AS INTEGER) AS line_end,
  '<unit revision="1.0.0" language="Java" item="' || CAST(rl AS VARCHAR) || '"><call><name>' ||
  CASE WHEN l_linenumber % 3 = 0 THEN '<name>lib</name><operator>.</operator><name>' || api || '</name>'
       WHEN l_linenumber % 3 = 1 THEN '<name>' || api || '</name><argument_list type="generic">&lt;<argument><name><name>java</name><operator>.</operator><name>T</name></name></argument>&gt;</argument_list>'
       ELSE api END ||
  '</name><argument_list pos:start="' || CAST(k + 1 + rl AS VARCHAR) || ':9" pos:end="' || CAST(k + 1 + rl AS VARCHAR) || ':30">(' ||
  CASE WHEN n_args = 0 THEN '' WHEN n_args = 1 THEN '{_A1}'
       ELSE '{_A1}, <argument><expr><call><name>f</name><argument_list pos:start="' || CAST(k + 1 + rl AS VARCHAR) ||
            ':20">(<argument><expr>x</expr></argument>)</argument_list></call></expr></argument>' END ||
  ')</argument_list></call></unit>' AS call_u,
  '<unit revision="1.0.0" language="Java" item="' || CAST(rl AS VARCHAR) || '"><function pos:start="' ||
  CAST(k + 1 + rl AS VARCHAR) || ':5" pos:end="' || CAST(k + 1 + rl + p_size % 2 AS VARCHAR) ||
  ':5"><type><name>void</name></type> <name>' || name || '</name><parameter_list pos:start="' ||
  CAST(k + 1 + rl AS VARCHAR) || ':20">(' ||
  CASE WHEN varargs THEN (CASE WHEN n_args = 0 THEN '' WHEN n_args = 1 THEN '{_P1}' ELSE '{_P1}, {_P2}' END) ||
                         (CASE WHEN n_args > 0 THEN ', ' ELSE '' END) || '{_VA}'
       ELSE (CASE WHEN n_args = 0 THEN '' WHEN n_args = 1 THEN '{_P1}' ELSE '{_P1}, {_P2}' END) END ||
  ')</parameter_list><block>{{<block_content/>}}</block></function></unit>' AS decl_u,
  CASE WHEN l_linenumber % 3 = 0 THEN '<unit revision="1.0.0" item="9">start="' || CAST(k + 1 + rl AS VARCHAR) ||
       ':30"</unit>' || chr(10) || '<unit revision="1.0.0" item="9">end="' || CAST(k + 1 + rl AS VARCHAR) || ':40"</unit>'
       ELSE '' END AS type_u,
  '<unit revision="1.0.0" item="1">start="' || CAST(k + 1 + rl AS VARCHAR) || ':5"</unit>' || chr(10) ||
  '<unit revision="1.0.0" item="2">end="' || CAST(k + 1 + rl + p_size % 2 AS VARCHAR) || ':5"</unit>' || chr(10) ||
  '<unit revision="1.0.0" item="3">' || name || '</unit>' AS span_u
FROM live_items""")

_cte("parsed_files", ["xml_units"], """
SELECT repo, idx, fno, 'src/F' || CAST(fno AS VARCHAR) || '.java' AS path, max(k) AS k FROM xml_units GROUP BY ALL""")


def with_carriers(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order)
    return f"WITH {ctes}\n{body}"
