"""Call extraction from code fragments (X2) and call rendering.

The reference sends each fragment to an external parser.  A fragment is a
short piece of a diff, so built-in expressions read it: comments go and
literals become empty ones, type arguments go, declarations and annotations
lose their names, and one walk over the remaining tokens keeps the open
brackets and says which call each token stands in.  A name followed by ``(`` is a
call, its arity the number of top-level commas up to the matching ``)`` or the
end of the text (empty argument list -> 0).  Control keywords are not calls;
``super(`` and ``this(`` are.  This is a documented approximation of a Java
parser: type arguments nest up to three deep, and a name after another word is
declared there unless that word is one of ``BEFORE_CALLS``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codetrail.functions.arrays import bound, scan

# Java keywords that may be followed by "(" without being a call.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "try", "do",
             "else", "case", "new", "instanceof", "assert", "default", "yield")
# Words that a call, not a declaration, follows.
BEFORE_CALLS = ("return", "throw", "new", "else", "case", "yield", "assert", "do", "instanceof", "default", "finally")

_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
_COMMENT_OR_LITERAL = r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|([\"'])(?:\\.|(?!\1)[^\\])*+(?:\1|\\?\z)"
_TYPE_ARGUMENTS = r"(?<=[\p{L}\p{N}_$])\s*<[^<>();{}\"']*>"
_ANNOTATION = rf"@\s*{_NAME}(?:\.{_NAME})*"
_DECLARED = rf"(?<![\p{{L}}\p{{N}}_$.])(?!(?:{'|'.join(BEFORE_CALLS)})\b){_NAME}(?:\.{_NAME})*(?:\s*\[\s*\])*(?:\.\.\.)?\s+{_NAME}\s*\("
_TOKEN = rf"{_NAME}\s*\(|{_NAME}|[^\s]"
# A name with its bracket, and the next token's first character unless that closes a bracket; else a whole name, so that none
# is looked at again from its middle.
_HEAD = rf"({_NAME}+\s*+)\((?=\s*+([^\s)\]}}]?))|{_NAME}+"
# What comments, literals, type arguments and annotations begin with.
_DECORATED = r"[\"'<@]|/[/*]"


def _counts(owners: Column, n: Column) -> Column:
    """How often each of 1..n occurs in ``owners``: one run of the sorted values each, as every number is put in once."""
    every = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)

    def runs(values: Column) -> Column:
        starts = F.filter(F.transform(values, lambda v, i: F.when(
            (i == 0) | (v != F.get(values, i - 1)), i)), lambda i: i.isNotNull())
        return bound(F.concat(starts, F.array(F.size(values))), lambda at: F.transform(
            F.slice(at, F.lit(1), F.size(at) - 1), lambda x, k: F.get(at, k + 1) - x - 1))

    return bound(F.array_sort(F.concat(F.filter(owners, lambda o: o > 0), every)), runs)


_OPEN = "struct<open:array<int>,n:int,owner:int>"


# Kinds of tokens; a token of any other kind is 0.
_CALL, _OPENS, _CLOSES, _COMMA = 1, 2, 3, 4


def _calls(code: Column) -> Column:
    """The calls in plain code.  A call has an argument if what follows its bracket doesn't close one, and one more for each
    comma that stands directly in it; code without commas is told from its calls alone."""
    # both lists are of the same matches
    heads = F.zip_with(F.regexp_extract_all(code, F.lit(_HEAD), 1), F.regexp_extract_all(code, F.lit(_HEAD), 2),
                       lambda name, after: F.struct(F.rtrim(name).alias("name"), (after != "").cast("int").alias("n_args")))
    return F.when(F.contains(code, F.lit(",")), bound(F.regexp_extract_all(code, F.lit(_TOKEN), 0), _calls_of_tokens)).otherwise(
        F.filter(heads, lambda h: (h["name"] != "") & ~h["name"].isin(*NOT_CALLS)))


def _calls_of_tokens(tokens: Column) -> Column:
    """The calls among the tokens: a walk that keeps the open brackets (0, or the number of the call that opened one) says
    which call a comma stands in."""
    def name_of(t):
        return F.rtrim(F.substring(t, F.lit(1), F.length(t) - 1))

    def kind(t):
        return (F.when(t.endswith("("), F.when((name_of(t) != "") & ~name_of(t).isin(*NOT_CALLS), _CALL).otherwise(_OPENS))
                .when(t.isin(")", "]", "}"), _CLOSES).when(t.isin("[", "{"), _OPENS).when(t == ",", _COMMA).otherwise(0))

    def step(state, k):
        held, n = state["open"], state["n"] + F.when(k == _CALL, 1).otherwise(0)
        left = (F.when(k == _CLOSES, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))
                .when(k == _CALL, F.concat(held, F.array(n))).when(k == _OPENS, F.concat(held, F.array(F.lit(0)))).otherwise(held))
        owner = F.when(k == _COMMA, F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit(0))).otherwise(F.lit(0))
        return F.struct(left.alias("open"), n.alias("n"), owner.alias("owner")).cast(_OPEN)

    def read(z):
        """z: tokens and their kinds."""
        heads = F.filter(F.transform(z["tokens"], lambda t, i: F.when(F.get(z["kinds"], i) == _CALL, F.struct(
            name_of(t).alias("name"), F.coalesce(F.get(z["kinds"], i + 1) != _CLOSES, F.lit(False)).alias("full")))),
            lambda h: h.isNotNull())
        start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("n"), F.lit(0).alias("owner")).cast(_OPEN)
        # what is no call, bracket or comma changes nothing, and only how often a call owns a comma is asked
        owners = scan(F.filter(z["kinds"], lambda k: k != 0), step, start, lambda st: st["owner"], F.array().cast("array<int>"))
        both = F.struct(heads.alias("heads"), owners.alias("owners"))
        return bound(both, lambda x: bound(_counts(x["owners"], F.size(x["heads"])), lambda c: F.transform(
            x["heads"], lambda h, i: F.struct(h["name"].alias("name"), F.when(F.get(c, i) > 0, F.get(c, i) + 1).otherwise(
                h["full"].cast("int")).cast("int").alias("n_args")))))

    return bound(F.struct(tokens.alias("tokens"), F.transform(tokens, kind).alias("kinds")), read)


def plain_code(code: Column) -> Column:
    """The fragment without comments, literal contents, type arguments, annotation names and declared names."""
    out = F.regexp_replace(code, _COMMENT_OR_LITERAL, " $1$1 ")
    for _ in range(3):
        out = F.regexp_replace(out, _TYPE_ARGUMENTS, "")
    out = F.when(code.rlike(_DECORATED), F.regexp_replace(out, _ANNOTATION, " ")).otherwise(code)
    return F.regexp_replace(out, _DECLARED, "; (")


def calls_from_text(code: Column) -> Column:
    """``array<struct<name, n_args>>`` of the calls in a code fragment, left to right; null for null."""
    return F.when(code.isNotNull(), bound(plain_code(code), _calls))


def calls_of_pair(removed: Column, added: Column) -> Column:
    """X2 for both sides of a diff pair: struct<removed_calls, added_calls>."""
    return F.struct(calls_from_text(removed).alias("removed_calls"), calls_from_text(added).alias("added_calls"))


def render_call(call: Column, with_class: bool = False, cls: Column | None = None) -> Column:
    """``name(n)`` or ``[Class] name(n)`` (class shown by its simple name)."""
    plain = F.format_string("%s(%d)", call["name"], call["n_args"])
    if not with_class or cls is None:
        return plain
    return F.when(cls.isNull(), plain).otherwise(
        F.format_string("[%s] %s(%d)", F.substring_index(cls, ".", -1), call["name"], call["n_args"]))


def render_declaration(name: Column, n_args: Column, varargs: Column, cls: Column) -> Column:
    """Declaration form ``name(n+)`` / ``[Class]    name(n+)`` (``+`` marks varargs)."""
    plus = F.when(varargs, F.lit("+")).otherwise(F.lit(""))
    plain = F.format_string("%s(%d%s)", name, n_args, plus)
    return F.when(cls.isNull(), plain).otherwise(
        F.format_string("[%s]    %s(%d%s)", F.substring_index(cls, ".", -1), name, n_args, plus))


def render_call_list(calls: Column) -> Column:
    """A call list joined by ``,``."""
    return F.array_join(F.transform(calls, lambda c: F.format_string("%s(%d)", c["name"], c["n_args"])), ",")


def render_signature(cls: Column, name: Column, args_types: Column, return_type: Column) -> Column:
    """The full form ``[package.Class] name (types) -> type`` of a call or declaration; a missing part is ``null``."""
    shown = [F.coalesce(c, F.lit("null")) for c in (cls, name, args_types, return_type)]
    return F.format_string("[%s] %s (%s) -> %s", *shown)
