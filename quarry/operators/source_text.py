"""Source text of a small functional language as token tables: JVM functions only, a file per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed tokens of the language: strings, comments, numbers, names, operators of two or three characters, single characters.
#: A string's runs are possessive, so that long ones need no stack. One that is never closed is a single quote mark and what follows.
TOKEN = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|//[^\n]*|[0-9][0-9_]*\.[0-9_]*|[0-9][0-9_]*|[A-Za-z_][A-Za-z0-9_]*|<=\.|>=\.|<\.|>\.|\+\.|-\.|\*\.|/\.|\|>|\|\||&&|==|!=|<=|>=|<>|->|<-|\.\.|<<|>>|[^\s]'


def tokens(text: Column) -> Column:
    """Tokens in order, comments left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~F.startswith(t, F.lit("//")))


def module_doc(text: Column) -> Column:
    """The lines after ``////``, joined."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^////[ ]?(.*)$"), F.lit(1)), lambda x: x), "\n")


def counted(files: DataFrame, text: str = "content") -> DataFrame:
    """Adds n_tokens, n_types, n_values, n_public, n_cases, n_branches and balanced.

    A definition is a ``type`` or ``fn`` outside all brackets; a fold over the tokens keeps the depth. ``fn`` inside a
    body is a lambda, which does not count. balanced: brackets close in the number in which they open, never before.
    """
    opens, closes = F.array(*map(F.lit, "([{")), F.array(*map(F.lit, ")]}"))
    start = F.struct(*[F.lit(0).alias(n) for n in ("depth", "types", "values", "public", "least")], F.lit("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        depth = (s["depth"] + F.array_contains(opens, t).cast("int") - F.array_contains(closes, t).cast("int")).cast("int")
        top = s["depth"] == 0
        is_type, is_value = top & (t == "type"), top & (t == "fn")
        return F.struct(depth.alias("depth"), (s["types"] + is_type.cast("int")).alias("types"), (s["values"] + is_value.cast("int")).alias("values"),
            (s["public"] + ((is_type | is_value) & (s["last"] == "pub")).cast("int")).alias("public"), F.least(s["least"], depth).alias("least"), t.alias("last"))

    df = files.withColumn("__t", tokens(F.col(text))).withColumn("__s", F.aggregate("__t", start, step))
    many = lambda word: F.size(F.filter("__t", lambda t: t == word))
    return df.select(*files.columns, F.size("__t").alias("n_tokens"), F.col("__s.types").alias("n_types"), F.col("__s.values").alias("n_values"), F.col("__s.public").alias("n_public"),
        many("case").alias("n_cases"), many("->").alias("n_arrows"), ((F.col("__s.depth") == 0) & (F.col("__s.least") >= 0)).alias("balanced"))


def operators(files: DataFrame, text: str = "content") -> DataFrame:
    """``(path, operator, n)``: how often each binary operator is used."""
    known = ["&&", "||", "==", "!=", "<", "<=", ">", ">=", "<.", "<=.", ">.", ">=.", "+", "-", "*", "+.", "-.", "*.", "/", "%", "/.", "<>", "|>"]
    used = files.select("path", F.explode(tokens(F.col(text))).alias("operator")).where(F.col("operator").isin(known))
    return used.groupBy("path", "operator").agg(F.count("*").alias("n"))


#: Fixed words and marks of the language, as its lexer tells them apart.
KEYWORDS = ("pub", "fn", "type", "let", "case", "if", "else", "use", "import", "external", "const", "as", "try", "assert", "todo", "True", "False", "auto", "delegate", "derive", "echo", "implement", "macro", "opaque", "panic", "test")
OPERATORS = ("<=.", ">=.", "->", "<-", "|>", "::", "..", "+.", "-.", "*.", "/.", "<.", ">.", "==", "!=", "<=", ">=", "<>", "<<", ">>", "&&", "||", "=", "|", "_", "+", "-", "*", "/", "%", "<", ">", "!", "?", "@")
PUNCTUATION = ("(", ")", "{", "}", "[", "]", "#", ":", ",", ".", ";")
#: Kind -> pattern of what is told by its form; the first that matches at a place is taken. A string's runs are possessive.
FORMS = {
    "module_comment": r"////[^\n]*", "doc_comment": r"///[^\n]*", "comment": r"//[^\n]*", "string": r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"', "float": r"[0-9]+\.[0-9]+", "int": r"[0-9]+",
    "name": r"[a-z][a-zA-Z0-9_]*", "type_name": r"[A-Z][a-zA-Z0-9_]*", "discard": r"_[a-zA-Z0-9_]+",
}
_MARKS = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", m) for m in (*OPERATORS, *PUNCTUATION))
#: Blanks between tokens are blank, tab and line ends; any other character that begins no token is an error of its own.
LEXEME = "|".join([*FORMS.values(), _MARKS, r"[^ \t\r\n]"])
INT_MOST = "9223372036854775807"
#: Files whose tokens a task holds.
FILES = 2000


def kind_of(token: Column) -> Column:
    """module_comment, doc_comment, comment, keyword, string, int, float, name, type_name, discard, operator, punctuation or error.

    A whole number beyond 64 bits is an error, as is a quote mark that opens no string.
    """
    begins = lambda *marks: F.coalesce(*[F.when(F.startswith(token, F.lit(m)), True) for m in marks], F.lit(False))
    digits = F.regexp_replace(token, "^0+(?=.)", "")
    large = (F.length(digits) > 19) | ((F.length(digits) == 19) & (digits > INT_MOST))
    return (
        F.when(begins("////"), "module_comment").when(begins("///"), "doc_comment").when(begins("//"), "comment")
        .when(F.startswith(token, F.lit('"')), F.when(F.length(token) > 1, "string").otherwise("error"))
        .when(token.isin(*KEYWORDS), "keyword").when(token.isin(*OPERATORS), "operator").when(token.isin(*PUNCTUATION), "punctuation")
        .when(F.rlike(token, F.lit("^[0-9]+$")), F.when(large, "error").otherwise("int")).when(F.rlike(token, F.lit("^[0-9]")), "float")
        .when(F.rlike(token, F.lit("^[a-z]")), "name").when(F.rlike(token, F.lit("^[A-Z]")), "type_name").when(F.rlike(token, F.lit("^_")), "discard").otherwise("error")
    )


def token_table(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """``(key, ord, kind, text, start, end, line, column)`` of every token of every file, comments and errors among them.

    start and end (exclusive) are code points from 0, line and column count from 1, by line feeds. The tokens of a file
    and the gaps before them alternate, so running sums of their lengths are the places, and running counts of line feeds
    the lines; a column is the way from the last line feed before. ``key`` must name each file once. Files are dealt out
    before they are cut, so their tokens are not shuffled, and by their number: a task has some ``FILES``, however many there are;
    null texts and texts of blanks have no tokens.
    """
    many = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.count() // FILES)
    dealt = files.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text")).repartition(many, "__key")
    found, gaps = F.regexp_extract_all("__text", F.lit(LEXEME), F.lit(0)), F.split("__text", LEXEME, -1)
    rows = dealt.select("__key", F.posexplode(F.arrays_zip(found.alias("t"), F.slice(gaps, 1, F.size(found)).alias("g"))).alias("ord", "x")).select("__key", "ord", F.col("x.t").alias("t"), F.col("x.g").alias("g"))
    by = Window.partitionBy("__key").orderBy("ord")
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    ahead = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("g") + F.length("t")).over(ahead)).withColumn("start", F.col("end") - F.length("t"))
    # Line feeds stand in gaps and in strings: those in a gap come before its token, those in a token after its start.
    rows = rows.withColumn("line", 1 + F.sum(feeds(F.col("g")) + feeds(F.col("t"))).over(ahead) - feeds(F.col("t")))
    after = lambda c: F.length(F.substring_index(c, "\n", -1))
    in_gap = F.when(F.contains("g", F.lit("\n")), F.col("start") - after(F.col("g")))
    in_token = F.when(F.contains("t", F.lit("\n")), F.col("end") - after(F.col("t")))
    begun = F.greatest(F.max(in_gap).over(ahead), F.max(in_token).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("column", F.col("start") - begun + 1)
    return rows.select(F.col("__key").alias(key), "ord", kind_of(F.col("t")).alias("kind"), F.col("t").alias("text"), "start", "end", "line", "column")


def lexical_errors(tokens: DataFrame, key: str = "path") -> DataFrame:
    """``(key, code, message, start_line, start_col, end_line, end_col)`` for every token of kind error; an error has no line feed within."""
    bad = tokens.where("kind = 'error'")
    wide = F.col("end") - F.col("start")
    return bad.select(key, F.lit("PARSE_ERROR").alias("code"), F.concat(F.lit("unexpected "), "text").alias("message"), F.col("line").alias("start_line"), F.col("column").alias("start_col"), F.col("line").alias("end_line"), (F.col("column") + wide).alias("end_col"))
