"""Registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import streaming
from quarry.functions import globs, names, registered
from quarry.operators import compare, encode, migrate, nodes, source_text, structure
from quarry.sources import documents, remote, tree_sink
from quarry.streaming import machine, progress, watching

from . import grown, logic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


V4 = lambda x: rf"regexp_extract_all({x}, '[^_\-/.:][^_\-/.:\p{{Lu}}]*')"
KEBAB = lambda x: f"lower(array_to_string({V4(x)}, '-'))"


@query(f"SELECT p_partkey AS key, {KEBAB('p_name')} AS kebab, len({V4('p_name')})::INT AS n_words FROM part UNION ALL SELECT o_orderkey, {KEBAB('o_orderpriority')}, len({V4('o_orderpriority')})::INT FROM orders")
def name_v4_words(spark, sf_dir):
    part, orders = read(spark, sf_dir, "part"), read(spark, sf_dir, "orders")
    both = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("n")).unionByName(orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("n")))
    words = names.v4_words(F.col("n"))
    return both.select("key", names.kebab(words).alias("kebab"), F.size(words).alias("n_words"))


_UP = "upper(substr(w, 1, 1)) || substr(w, 2)"


@query(f"""WITH x AS (SELECT p_partkey, {V4("n")} AS ws, n FROM (SELECT p_partkey, p_type || '_' || p_brand AS n FROM part))
SELECT p_partkey, lower(array_to_string(ws, '_')) AS snake, lower(array_to_string(ws, '-')) AS kebab,
  array_to_string(list_transform(ws, lambda w: {_UP}), '') AS title,
  array_to_string(list_prepend(lower(ws[1]), list_transform(ws[2:], lambda w: {_UP})), '') AS camel,
  array_to_string(list_transform(string_split_regex(n, '[-_]'), lambda w: {_UP}), '') AS pascal FROM x""")
def name_renderings(spark, sf_dir):
    n = F.concat_ws("_", "p_type", "p_brand")
    w = names.v4_words(n)
    return read(spark, sf_dir, "part").select("p_partkey", names.snake(w).alias("snake"), names.kebab(w).alias("kebab"), names.title(w).alias("title"), names.camel(w).alias("camel"), names.pascal(n).alias("pascal"))


_CLASSIC = lambda x: f"lower(array_to_string(regexp_extract_all({x}, '[a-zA-Z][a-z]*|[0-9]+'), '.'))"


@query(f"SELECT p_brand AS name, {_CLASSIC('p_brand')} AS words FROM part UNION SELECT r_name, {_CLASSIC('r_name')} FROM region")
def name_classic_words(spark, sf_dir):
    both = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).union(read(spark, sf_dir, "region").select("r_name")).distinct()
    return both.select("name", F.array_join(names.classic_words(F.col("name")), ".").alias("words"))


@query(rf"""SELECT key, regexp_full_match(lower(array_to_string({V4("n")}, '_')), '[\p{{Ll}}_]*') AS lowercase, regexp_full_match(n, '[a-z0-9-]+') AS kebab
FROM (SELECT p_partkey AS key, p_name AS n FROM part UNION ALL SELECT n_nationkey, lower(replace(n_name, ' ', '-')) FROM nation)""")
def name_is_lowercase(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("n"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.lower(F.translate("n_name", " ", "-")).alias("n"))
    return part.unionByName(nation).select("key", names.is_lowercase(names.v4_words(F.col("n"))).alias("lowercase"), names.is_kebab(F.col("n")).alias("kebab"))


_PATH = lambda x: f"array_to_string(list_transform(string_split({x}, '/'), lambda p: {KEBAB('p')}), '/')"


@query(f"""WITH s AS (SELECT s_suppkey, r_name || '/sdk' AS p, n_name AS m, s_name AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, {_PATH("p")} || ':' || {_PATH("m")} || '#' || {KEBAB("replace(l, '#', '')")} AS canonical, true AS same FROM s""")
def fqname_roundtrip(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat_ws(":", F.concat("r_name", F.lit("/sdk")), "n_name", F.translate("s_name", "#", ""))
    s = s.select("s_suppkey", names.canonical(names.fqname(text)).alias("canonical"))
    return s.withColumn("same", names.canonical(names.fqname_of_canonical(F.col("canonical"))) == F.col("canonical"))


@query(f"""WITH q AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE r_name || '/' || 'Sub' || ':' || n_name END AS t FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, CASE WHEN len(string_split(t, ':')) = 2 THEN {_PATH("string_split(t, ':')[1]")} END AS module, CASE WHEN len(string_split(t, ':')) = 2 THEN {KEBAB("string_split(t, ':')[2]")} END AS local FROM q""")
def qname_parse(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat("r_name", F.lit("/Sub:"), "n_name"))
    return n.select("n_nationkey", names.qname(t).alias("q")).select("n_nationkey", "q.module", "q.local")


_URLPATH = "regexp_extract(url, '^[a-z]+://[^/]*/?([^?#]*)', 1)"


@query(f"SELECT page_id, {_PATH(_URLPATH)} AS path, len(string_split({_URLPATH}, '/'))::INT AS n_names FROM pages")
def path_display(spark, sf_dir):
    p = F.regexp_extract("url", "^[a-z]+://[^/]*/?([^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", names.path_display(p).alias("path"), F.size(names.path_names(p)).alias("n_names"))


@query(r"SELECT s_suppkey, translate(s_name || '/a b\c', '/ \', '---') AS name FROM supplier")
def sanitize_name(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", names.sanitize(F.concat("s_name", F.lit("/a b\\c"))).alias("name"))


_SOURCES = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'github:org' || page_id || '/repo/dir/f.json@v' || (page_id % 10) WHEN 2 THEN 'gist:user/id' || page_id || '@r1#f.json'
  WHEN 3 THEN 'git@host:o/r.git' WHEN 4 THEN 'https://host/o/r' || page_id || '.git' WHEN 5 THEN './dir/' || page_id || '.json' WHEN 6 THEN 'github:alone' ELSE '  ' END AS s, page_id % 8 AS k, page_id AS i FROM pages"""


def _sources(spark, sf_dir):
    k, i = F.col("page_id") % 8, F.col("page_id").cast("string")
    s = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("github:org"), i, F.lit("/repo/dir/f.json@v"), (F.col("page_id") % 10).cast("string")))
        .when(k == 2, F.concat(F.lit("gist:user/id"), i, F.lit("@r1#f.json"))).when(k == 3, "git@host:o/r.git").when(k == 4, F.concat(F.lit("https://host/o/r"), i, F.lit(".git")))
        .when(k == 5, F.concat(F.lit("./dir/"), i, F.lit(".json"))).when(k == 6, "github:alone").otherwise("  ")
    )
    return read(spark, sf_dir, "pages").select("page_id", s.alias("s"))


@query(f"""SELECT page_id, CASE k WHEN 0 THEN CASE WHEN url_ends THEN 'git' ELSE 'http' END WHEN 1 THEN 'github' WHEN 2 THEN 'gist' WHEN 3 THEN 'git' WHEN 4 THEN 'git' WHEN 5 THEN 'local' ELSE 'invalid' END AS kind,
  CASE k WHEN 1 THEN 'tag' END AS ref_kind,
  CASE k WHEN 0 THEN s WHEN 1 THEN 'https://github.com/org' || i || '/repo/dir/f.json@v' || (i % 10) WHEN 2 THEN 'https://gist.github.com/id' || i || '/r1#f.json' WHEN 3 THEN s WHEN 4 THEN s WHEN 5 THEN 'file://' || s END AS url
  FROM (SELECT *, ends_with(s, '.git') AS url_ends FROM ({_SOURCES}))""")
def source_classify(spark, sf_dir):
    p = remote.parse(F.col("s"))
    return _sources(spark, sf_dir).select("page_id", p["kind"].alias("kind"), p["ref_kind"].alias("ref_kind"), remote.canonical_url(F.col("s")).alias("url"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha1(doc_id::VARCHAR) WHEN 1 THEN 'v' || doc_id ELSE source END AS ref FROM documents)
SELECT ref_kind, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(ref, '[0-9a-fA-F]{40}') THEN 'commit' WHEN regexp_matches(ref, '^v[0-9]') THEN 'tag' ELSE 'branch' END AS ref_kind FROM r) GROUP BY ref_kind""")
def git_ref_kind(spark, sf_dir):
    k = F.col("doc_id") % 3
    ref = F.when(k == 0, F.sha1(F.col("doc_id").cast("string").cast("binary"))).when(k == 1, F.concat(F.lit("v"), F.col("doc_id").cast("string"))).otherwise(F.col("source"))
    return read(spark, sf_dir, "documents").groupBy(remote.git_ref_kind(ref).alias("ref_kind")).agg(F.count("*").alias("n"))


_GLOBS = {"any_html": "**/*.html", "blog": "https://blog.*", "one": "http?://*/??/*", "set": "*.example.[a-n]*", "not_set": "*.[!a-n]*/en/*"}


@query(r"""SELECT page_id, regexp_full_match(url, '(.*/)?.*\.html') AS any_html, regexp_full_match(url, 'https://blog\..*') AS blog, regexp_full_match(url, 'http.://.*/../.*') AS one,
  regexp_full_match(url, '.*\.example\.[a-n].*') AS set, regexp_full_match(url, '.*\.[^a-n].*/en/.*') AS not_set FROM pages""")
def glob_match(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", *[globs.matches(F.col("url"), g).alias(n) for n, g in _GLOBS.items()])


@query(r"""SELECT page_id, NOT regexp_full_match(url, '.*/fr/.*') AND (regexp_full_match(url, 'https://.*') OR regexp_full_match(url, '.*\.org/.*')) AS allowed FROM pages""")
def policy_allow_deny(spark, sf_dir):
    rules = spark.createDataFrame([("allow", globs.regex_of("https://*")), ("allow", globs.regex_of("*.org/*")), ("deny", globs.regex_of("*/fr/*"))], "kind string, regex string")
    return globs.decide(read(spark, sf_dir, "pages"), rules).select("page_id", "allowed")


@query("SELECT event_id, epoch(timestamp '2024-06-01' - date_trunc('second', ts)) <= 86400 * 60 AS fresh, true AS always FROM events")
def cache_ttl_valid(spark, sf_dir):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", remote.fresh(ts, now, 86400 * 60).alias("fresh"), remote.fresh(ts, now, 0).alias("always"))


@query("SELECT count(*) AS entries, coalesce(sum(n_chars), 0)::BIGINT AS total_size FROM documents")
def cache_stats(spark, sf_dir):
    return remote.cache_stats(read(spark, sf_dir, "documents"), "n_chars")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'IntegerLiteral' WHEN 1 THEN 'IntegerLiteral' ELSE 'StringLiteral' END AS kind, CASE event_id % 3 WHEN 2 THEN event_type ELSE props->>'$.k' END AS value FROM events""")
def json_literal_decode(spark, sf_dir):
    k, n = F.col("event_id") % 3, F.get_json_object("props", "$.k")
    text = F.when(k == 0, F.concat(F.lit('{"IntegerLiteral":{"value":'), n, F.lit("}}"))).when(k == 1, F.concat(F.lit('["WholeNumberLiteral",'), n, F.lit("]"))).otherwise(F.concat(F.lit('{"StringLiteral":"'), "event_type", F.lit('"}')))
    return read(spark, sf_dir, "events").select("event_id", documents.literals(text).alias("l")).select("event_id", "l.kind", "l.value")


@query("""WITH v AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN '4.0.' || p_size WHEN 1 THEN (p_size % 7)::VARCHAR WHEN 2 THEN (p_size % 9)::VARCHAR WHEN 3 THEN '3.1' END AS version, CASE p_size % 4 WHEN 0 THEN 'Latest' WHEN 1 THEN 'V3' WHEN 2 THEN '4' ELSE 'x' END AS alias FROM part)
SELECT p_partkey, version AS raw, CASE WHEN version IS NULL THEN NULL WHEN p_size % 5 IN (0, 1, 3) AND version LIKE '4%' OR p_size % 5 IN (2, 3) AND version::DOUBLE >= 4 THEN 'v4' ELSE 'classic' END AS major,
  CASE alias WHEN 'Latest' THEN 'v4' WHEN '4' THEN 'v4' WHEN 'V3' THEN 'classic' END AS target FROM v""")
def version_detect(spark, sf_dir):
    """Texts, numbers and no version: a text counts by how it begins, a number by its value."""
    s = F.col("p_size")
    text = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    version = F.when(s % 5 == 0, text(F.concat(F.lit("4.0."), s.cast("string")))).when(s % 5 == 1, text(s % 7)).when(s % 5 == 2, (s % 9).cast("string")).when(s % 5 == 3, "3.1")
    content = F.when(version.isNull(), '{"distribution": {}}').otherwise(F.concat(F.lit('{"formatVersion": '), version, F.lit(', "distribution": {}}')))
    alias = F.when(s % 4 == 0, "Latest").when(s % 4 == 1, "V3").when(s % 4 == 2, "4").otherwise("x")
    v = documents.version_of(content)
    return read(spark, sf_dir, "part").select("p_partkey", v["raw"].alias("raw"), v["major"].alias("major"), documents.target_version(alias).alias("target"))


def spread(rows: DataFrame, key: str, each: int = 2000) -> DataFrame:
    """``rows`` in partitions of about ``each``, as many as there are cores at least: few bytes that much work hangs on, so the
    number is given, and adaptive execution doesn't join the partitions again."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each), key)


#: Documents of the corpus: some definitions each, by the part's key. The first holds all.
_SETS = (tuple(logic.DEFINITIONS), ("fee", "check"), ("zone",), ("ship", "wrapped", "spread"), ("spread", "zone", "fee"))
_ZERO = '{"Literal": {"literal": {"IntegerLiteral": {"value": 3}}, "attrs": {}}}'
_HOLE = '{"Hole": {"reason": {"Draft": {}}, "attrs": {}}}'
_TEXTS = [json.dumps(logic.document(names)) for names in _SETS]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for every part, whose doc_id is the part's key: a module with a type and some of the sample's values.

    Every second part refers to another package, every third has a hole in place of a number. Spread before decoding, as the documents
    are far larger than the rows they are made from.
    """
    size, text = F.col("p_size"), F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS) + 1).cast("int"))
    text = F.replace(text, F.lit("depot:parcels#gt-int"), F.when(size % 2 == 0, "depot:missing#gt-int").otherwise("depot:parcels#gt-int"))
    text = F.replace(text, F.lit(_ZERO), F.when(size % 3 == 0, _HOLE).otherwise(_ZERO))
    parts = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    docs = documents.documents(parts.select(F.col("p_partkey").cast("string").alias("path"), text.alias("content")))
    return docs.withColumn("doc_id", F.col("path").cast("long"))


_QUOTED = ", ".join("'" + t.replace("'", "''") + "'" for t in _TEXTS)
_CORPUS = f"""SELECT p_partkey AS doc_id, p_size, replace(replace([{_QUOTED}][p_partkey % {len(_TEXTS)} + 1], 'depot:parcels#gt-int', CASE WHEN p_size % 2 = 0 THEN 'depot:missing#gt-int' ELSE 'depot:parcels#gt-int' END),
  '{_ZERO}', CASE WHEN p_size % 3 = 0 THEN '{_HOLE}' ELSE '{_ZERO}' END) AS t FROM part"""
#: Each kind's opening text; a reference is a type where it has arguments, a unit only in types here.
_OPENINGS = [
    *[("value", k, f'"{k}": {{') for k in ("Apply", "Constructor", "Destructure", "Field", "FieldFunction", "Hole", "IfThenElse", "Lambda", "LetDefinition", "List", "Literal", "Native", "PatternMatch", "Record", "Tuple", "UpdateRecord", "Variable")],
    ("value", "Reference", '"Reference": {"fqname": "depot'), ("type", "Reference", '"Reference": {"fqname": "lang'), ("type", "Unit", '"Unit": {'),
    *[("pattern", k, f'"{k}": {{') for k in ("AsPattern", "ConstructorPattern", "EmptyListPattern", "HeadTailPattern", "LiteralPattern", "TuplePattern", "WildcardPattern")],
    *[("literal", k, f'"{k}": {{') for k in ("FloatLiteral", "IntegerLiteral", "StringLiteral")],
]
_KINDS = ", ".join(f"('{f}', '{k}', '{o}')" for f, k, o in _OPENINGS)


@query(f"""SELECT * FROM (SELECT doc_id, family, kind, ((length(t) - length(replace(t, o, ''))) // length(o))::BIGINT AS n
FROM ({_CORPUS}), (VALUES {_KINDS}) k(family, kind, o)) WHERE n > 0""")
def visitor_counts(spark, sf_dir):
    return nodes.kind_counts(corpus(spark, sf_dir))


def _profile(name: str) -> tuple[int, int, int]:
    """Nodes, depth and variables of a sample definition, counted by walking it as plain JSON: a node is an object of one kind's name."""

    def walk(x, depth):
        if isinstance(x, dict):
            for key, inner in x.items():
                node = key[:1].isupper() and key != "Arithmetic"
                if node:
                    found.append((key, depth))
                literal = key.endswith("Literal") and key != "Literal"
                if not literal:
                    walk(inner, depth + node)
        elif isinstance(x, list):
            for inner in x:
                walk(inner, depth)

    found: list[tuple[str, int]] = []
    walk(logic.DEFINITIONS[name], 0)
    return len(found) + 1, max(d for _, d in found), sum(k == "Variable" for k, _ in found)  # and the output type's unit


_PROFILES = ", ".join(f"({k}, '{n}', {_profile(n)[0]}, {_profile(n)[1]}, {_profile(n)[2]})" for k, names in enumerate(_SETS) for n in names)


#: A hole takes the place of a literal and its number, so it makes one node less where it stands; nothing is deeper there.
@query(f"""SELECT p_partkey AS doc_id, 'parcels' AS module, d AS def_name, (n - CASE WHEN d = 'fee' AND p_size % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_nodes, m::INT AS max_depth, v::BIGINT AS n_variables
FROM part JOIN (VALUES {_PROFILES}) t(k, d, n, m, v) ON p_partkey % {len(_SETS)} = k
UNION ALL SELECT p_partkey, 'parcels', 'speed', 1, 0, 0 FROM part""")
def node_depth_profile(spark, sf_dir):
    return nodes.depth_profile(corpus(spark, sf_dir))


#: A document answers references to its own values alone.
_ANSWERED = " OR ".join(f"(doc_id % {len(_SETS)} = {k} AND fqn IN ({', '.join(repr(f'depot:parcels#{n}') for n in ('speed', *names))}))" for k, names in enumerate(_SETS))


@query(f"SELECT DISTINCT doc_id, fqn FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\"fqname\": \"(depot:[^\"]*)\"', 1)) AS fqn FROM ({_CORPUS})) WHERE NOT ({_ANSWERED})")
def unresolved_refs(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return nodes.unresolved(nodes.shred(docs, nodes.NAMING), documents.definitions(docs), "depot")


#: The number that holes replace stands in the fee alone.
@query(f"SELECT p_partkey AS doc_id, 'hole' AS code, 'parcels#fee' AS subject FROM part WHERE p_size % 3 = 0 AND p_partkey % {len(_SETS)} IN {tuple(k for k, names in enumerate(_SETS) if 'fee' in names)}")
def validation_findings(spark, sf_dir):
    return nodes.findings_in(corpus(spark, sf_dir))


@query(f"""SELECT p_partkey AS doc_id, 'parcels' AS module, d AS def_name, kind, reason, n::BIGINT AS n FROM part JOIN (VALUES (0, 'fee', 'Hole', 'Draft', 1), (1, 'fee', 'Hole', 'Draft', 1), (4, 'fee', 'Hole', 'Draft', 1),
  (0, 'ship', 'Native', 'Arithmetic', 2), (3, 'ship', 'Native', 'Arithmetic', 2)) t(k, d, kind, reason, n) ON p_partkey % {len(_SETS)} = k WHERE kind = 'Native' OR p_size % 3 = 0""")
def incomplete_nodes(spark, sf_dir):
    return nodes.incomplete(nodes.shred(corpus(spark, sf_dir), ("Hole", "Native"))).groupBy("doc_id", "module", "def_name", "kind", "reason").agg(F.count("*").alias("n"))


_NAMES = ", ".join(f"({k}, '{n}')" for k, names in enumerate(_SETS) for n in names)


@query(f"""SELECT p_partkey AS doc_id, n AS name, CASE WHEN n = 'ship' THEN 'Native can''t be said in the classic dialect' WHEN n = 'fee' AND p_size % 3 = 0 THEN 'Hole can''t be said in the classic dialect' END AS diagnostic,
  n <> 'ship' AND NOT (n = 'fee' AND p_size % 3 = 0) AS same FROM part JOIN (VALUES {_NAMES}) t(k, n) ON p_partkey % {len(_SETS)} = k""")
def convert_trees(spark, sf_dir):
    """Value trees to the classic dialect and back: the same tree again, or why not."""
    defs = documents.definitions(corpus(spark, sf_dir)).where("family = 'value'")
    trees = defs.select("doc_id", "name", F.get_json_object("body", "$.ExpressionBody.body").alias("body"))
    classic = nodes.converted(trees, "value", False).select("doc_id", "name", F.col("body").alias("was"), F.col("converted").alias("body"), F.col("diagnostic").alias("down"))
    back = nodes.converted(classic, "value", True)
    same = F.coalesce(F.get_json_object("converted", "$") == F.get_json_object("was", "$"), F.lit(False))
    return back.select("doc_id", "name", F.col("down").alias("diagnostic"), same.alias("same"))


def classic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classic document for every customer: a module named after the segment, with an alias, a custom type and a value."""
    text = """{"formatVersion":3,"distribution":["Library",[["shop"],["no","@@"]],[[[["lang"],["sdk"]],{}],[[["other"]],{}]],{"modules":[[[["SEG"]],{"access":"public","value":{"types":[
      [["amount"],{"access":"Public","value":{"doc":"money","value":["TypeAliasDefinition",[["a"]],["Reference",{},[[["lang"],["sdk"]],[["basics"]],["float"]],[]]]}}],
      [["kind"],{"access":"Public","value":{"doc":"","value":["CustomTypeDefinition",[],{"access":"Private","value":[[["one"],[]],[["two"],[[["x"],["Variable",{},["a"]]],[["y"],["Unit",{}]]]]]}]}}]],
      "values":[[["balance","of"],{"access":"ACC","value":{"doc":"","value":{"inputTypes":[[["c"],{},["Variable",{},["a"]]],[["rate"],{},["Unit",{}]]],"outputType":["Unit",{}],
      "body":["IfThenElse",{"at":"@@"},["Literal",{},["BoolLiteral",true]],["Variable",{},["c"]],["Apply",{},["Reference",{},[[["shop"]],[["SEG"]],["flat"]]],["Literal",{},["WholeNumberLiteral",@@]]]]}}}]]}}]]}]}"""
    for mark, value in (("SEG", F.lower("c_mktsegment")), ("ACC", F.when(F.col("c_acctbal") < 0, "private").otherwise("public")), ("@@", F.col("c_custkey").cast("string"))):
        text = F.replace(F.lit(text) if isinstance(text, str) else text, F.lit(mark), value)
    docs = documents.documents(spread(read(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").cast("string").alias("path"), text.alias("content")))
    return docs.withColumn("doc_id", F.col("path").cast("long"))


@query("""SELECT c_custkey AS doc_id, 'classic' AS dialect, 'shop/no-' || c_custkey AS package, lower(c_mktsegment) AS module, family, name, CASE WHEN name = 'balance-of' AND c_acctbal < 0 THEN 'Private' ELSE 'Public' END AS access, kind AS def_kind, doc
FROM customer, (VALUES ('type', 'amount', 'TypeAliasDefinition', 'money'), ('type', 'kind', 'CustomTypeDefinition', ''), ('value', 'balance-of', 'ValueDefinition', '')) t(family, name, kind, doc)""")
def classic_definitions(spark, sf_dir):
    docs = classic_corpus(spark, sf_dir)
    return documents.definitions(docs).hint("merge").join(docs.select("doc_id", "dialect", "package"), "doc_id").select("doc_id", "dialect", "package", "module", "family", "name", "access", "def_kind", "doc")


@query("SELECT c_custkey AS doc_id, ord, dependency FROM customer, (VALUES (0, 'lang/sdk'), (1, 'other')) t(ord, dependency)")
def document_dependencies(spark, sf_dir):
    return documents.dependencies(classic_corpus(spark, sf_dir))


@query("""SELECT c_custkey AS doc_id, '{"formatVersion":"4.0.0","distribution":{"Library":{"packageName":"shop/no-' || c_custkey || '","dependencies":{},"def":{"modules":{"' || lower(c_mktsegment) || '":{"access":"Public","value":{"types":{' ||
  '"amount":{"access":"Public","value":{"doc":"money","value":{"TypeAliasDefinition":{"typeParams":["a"],"typeExp":{"Reference":{"fqname":"lang/sdk:basics#float","args":[],"attrs":{}}}}}}},' ||
  '"kind":{"access":"Public","value":{"doc":"","value":{"CustomTypeDefinition":{"typeParams":[],"constructors":{"access":"Private","value":[{"name":"one","args":[]},{"name":"two","args":[["x",{"Variable":{"name":"a","attrs":{}}}],["y",{"Unit":{"attrs":{}}}]]}]}}}}}},' ||
  '"values":{"balance-of":{"access":"' || CASE WHEN c_acctbal < 0 THEN 'Private' ELSE 'Public' END || '","value":{"doc":"","value":{"ExpressionBody":{"inputTypes":{"c":{"type":{"Variable":{"name":"a","attrs":{}}}},"rate":{"type":{"Unit":{"attrs":{}}}}},"outputType":{"Unit":{"attrs":{}}},' ||
  '"body":{"IfThenElse":{"condition":{"Literal":{"literal":{"BoolLiteral":{"value":true}},"attrs":{}}},"thenBranch":{"Variable":{"name":"c","attrs":{}}},"elseBranch":{"Apply":{"function":{"Reference":{"fqname":"shop:' || lower(c_mktsegment) || '#flat","attrs":{}}},' ||
  '"argument":{"Literal":{"literal":{"IntegerLiteral":{"value":' || c_custkey || '}},"attrs":{}}},"attrs":{}}},"attrs":{"extensions":{"at":"' || c_custkey || '"}}}}}}}}}}}}}}}}' AS content, true AS same FROM customer""")
def migrate_documents(spark, sf_dir):
    """Whole classic documents to version 4, and from there back and up again: the same document."""
    return _there_and_back(classic_corpus(spark, sf_dir))


def _there_and_back(docs: DataFrame) -> DataFrame:
    """``(doc_id, content, same)`` of classic documents: in version 4, and whether that down and up again is the same. What a migration
    wrote is read by the next as a document beside it, so nothing is written between, and no texts are joined."""
    needed = lambda df, *keep: df.select("doc_id", "package", "raw", *keep)
    again = lambda df, *keep: needed(documents.documents(df.withColumn("path", F.col("doc_id").cast("string")), *keep).withColumn("doc_id", F.col("path").cast("long")), *keep)
    new = migrate.migrated_in(needed(docs), True).select("doc_id", "content")
    old = migrate.migrated_in(again(new), False).select("doc_id", F.col("raw").alias("new"), "content")
    back = migrate.migrated_in(again(old, "new"), True)
    return back.select("doc_id", F.col("new").alias("content"), F.coalesce(F.col("content") == F.col("new"), F.lit(False)).alias("same"))


_MODULES = f"(SELECT k, unnest(CASE WHEN {grown.MODULES} = 2 THEN ['m', 'n'] ELSE ['m'] END) AS module FROM {grown.ROWS})"
_PLANTED = ", ".join(f"({n}, '{code}', '{path}')" for n, (_, code, path) in grown.FAULTS.items())
_PLACE = f"'$.body' || repeat('[4]', ({grown.LETS})::INT) || repeat('[3]', ({grown.RECURSIONS} + {grown.CALLS})::INT) || '[2][0][1]'"


@query(f"SELECT k AS doc_id, {grown.document(False, grown.body(False))} AS content, true AS same FROM {grown.ROWS}".replace("AS STRING", "AS VARCHAR"))
def migrate_grown(spark, sf_dir):
    """Classic documents of nested lets, recursion, calls and records, in one or two modules, to version 4; and down and up again: the same."""
    return _there_and_back(grown.corpus(spark, sf_dir, grown.document(True, grown.body(True))))


@query(f"SELECT k AS doc_id, module, 'value' AS family, 'go' AS name, {_PLACE} || path AS path, code FROM {_MODULES} JOIN (VALUES {_PLANTED}) t(f, code, path) ON {grown.FAULT} = f")
def malformed_nodes(spark, sf_dir):
    """Where documents are malformed, by JSON path: faults of six sorts, planted at the bottom of trees that vary."""
    docs = grown.corpus(spark, sf_dir, grown.document(True, grown.body(True, grown.faulty())))
    return nodes.faults_in(docs).select("doc_id", "module", "family", "name", "path", "code")


@query(f"SELECT k AS doc_id, CASE WHEN {grown.FAULT} BETWEEN 1 AND 6 THEN ({grown.MODULES})::INT ELSE 0 END AS n_diagnostics, NOT {grown.FAULT} BETWEEN 1 AND 6 AS done FROM {grown.ROWS}")
def migrate_refuses(spark, sf_dir):
    """Migration writes no document with a malformed definition, and says why for each."""
    docs = grown.corpus(spark, sf_dir, grown.document(True, grown.body(True, grown.faulty())))
    out = migrate.migrated_in(docs.select("doc_id", "package", "raw"), True)
    return out.select("doc_id", F.size("diagnostics").alias("n_diagnostics"), F.col("content").isNotNull().alias("done"))


_V4 = grown.document(False, grown.body(False))
_SEEN = f"""replace({_V4}, '"attrs":{{"extensions":{{"n":1}}}}', '"attrs":{{"extensions":{{"n":1}},"seen":true}}')"""


@query(f"SELECT k AS doc_id, true AS same, {_SEEN} AS content FROM {grown.ROWS}".replace("AS STRING", "AS VARCHAR"))
def encode_documents(spark, sf_dir):
    """Documents to nodes and back: the same text; and once more with the attributes of calls changed between."""
    tree = nodes.held(grown.corpus(spark, sf_dir, _V4).select("doc_id", "package", "raw"))
    seen = nodes.map_held(F.col("nodes"), {"Apply": lambda a: F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit(', "seen": true}'))})
    made = encode.documents_in(tree.withColumn("seen", seen), "nodes", "seen")
    return made.select("doc_id", F.col("nodes.content").eqNullSafe(F.col("raw")).alias("same"), F.col("seen.content").alias("content"))


#: Definitions of version 4 without an expression, by k: a native hint, a hole's reason, a platform, an incomplete type, a wrapped body.
_BARE = {
    0: ("value", '{"inputTypes":{},"outputType":{"Unit":{}},"body":{"NativeBody":{"hint":{"StringOp":{}}}}}', "NativeBody", "StringOp"),
    1: ("value", '{"inputTypes":{},"outputType":{"Unit":{}},"body":{"IncompleteBody":{"reason":{"TypeMismatch":{"expected":"a","found":"b"}}}}}', "IncompleteBody", "TypeMismatch"),
    2: ("value", '{"inputTypes":{},"outputType":{"Unit":{}},"body":{"ExternalBody":{"externalName":"e","targetPlatform":"jvm"}}}', "ExternalBody", "jvm"),
    3: ("type", '{"IncompleteTypeDefinition":{"typeParams":[],"incompleteness":{"Hole":{"UnresolvedReference":{"target":"a:b#c"}}}}}', "IncompleteTypeDefinition", "Hole.UnresolvedReference"),
    4: ("type", '{"IncompleteTypeDefinition":{"typeParams":["a"],"incompleteness":"Draft","partialTypeExp":{"Unit":{}}}}', "IncompleteTypeDefinition", "Draft"),
    5: ("value", '{"NativeBody":{"inputTypes":{},"outputType":{"Unit":{}},"hint":"Arithmetic"}}', "NativeBody", "Arithmetic"),
    6: ("value", '{"ExpressionBody":{"inputTypes":{},"outputType":{"Unit":{}},"body":{"Unit":{}}}}', None, None),
}
_BARE_AT = {"value": '"types":{},"values":{"d@":{"access":"Public","value":#}}', "type": '"types":{"d@":{"access":"Public","value":#}},"values":{}'}


@query(f"SELECT k AS doc_id, 'd' || k AS def_name, kind, reason FROM {grown.ROWS} JOIN (VALUES {', '.join(f"({n}, '{kind}', '{reason}')" for n, (_, _, kind, reason) in _BARE.items() if kind)}) t(n, kind, reason) ON k % 7 = n")
def incomplete_definitions(spark, sf_dir):
    """Native, external and incomplete bodies and incomplete types; nothing of them is malformed."""
    whole = lambda n: '{"formatVersion":4,"distribution":{"Library":{"packageName":"p","dependencies":{},"def":{"modules":{"m":{"access":"Public","value":{' + _BARE_AT[_BARE[n][0]].replace("#", _BARE[n][1]) + "}}}}}}}"
    docs = grown.corpus(spark, sf_dir, f"replace(CASE k % 7 {' '.join(f'WHEN {n} THEN {grown.text(whole(n))}' for n in _BARE)} END, '@', CAST(k AS STRING))")
    defs = documents.definitions(docs)
    told = nodes.faults_in(docs).select("doc_id", F.col("name").alias("def_name"), F.col("code").alias("kind"), F.col("path").alias("reason"))
    return nodes.incomplete_definitions(defs).select("doc_id", "def_name", "kind", "reason").unionByName(told)


#: A second version of each document, by k: a number changed, a call more, fields dealt otherwise, or the same.
_OTHER = grown.document(False, f"CASE k % 4 WHEN 1 THEN {grown.body(False, grown.text('{"Unit":{"attrs":{}}}'))} WHEN 2 THEN {grown.body(False, None, grown.CALLS + ' + 1')} WHEN 3 THEN replace({grown.body(False)}, {grown.text('"f0"')}, {grown.text('"g"')}) ELSE {grown.body(False)} END")
_AT = f"""'$.body' || repeat('.LetDefinition.body', ({grown.LETS})::INT) || repeat('.LetRecursion.body', ({grown.RECURSIONS})::INT) || repeat('.Apply.argument', ({grown.CALLS})::INT)""".replace("'$.body'", "'$.ExpressionBody.body'")


@query(f"""SELECT k AS doc_id, module, 'go' AS name, d.* FROM (SELECT *, {_AT} AS p FROM {_MODULES}), LATERAL (SELECT * FROM (VALUES
  (1, 'changed', p || '.Record.fields.f0', NULL, 'Literal', 'Unit'), (2, 'changed', p, NULL, 'Record', 'Apply'),
  (3, 'moved', p || '.Record.fields.g', p || '.Record.fields.f0', NULL, 'Literal'), (3, 'missing', p || '.Record.fields.f0', NULL, 'Literal', NULL)) t(v, diff, path, old_path, was, now) WHERE v = k % 4) d(v, diff, path, old_path, was, now)""".replace("d.* FROM", "diff, path, old_path, was, now FROM"))
def subtree_differences(spark, sf_dir):
    """Where two versions of documents differ, by subtree digests: a node changed, a call put between, a field renamed."""
    left, right = (structure.digests(grown.corpus(spark, sf_dir, text)) for text in (_V4, _OTHER))
    return structure.differences(left, right).select("doc_id", "module", "name", "diff", "path", "old_path", "was", "now")


@query(f"""SELECT k AS doc_id, module, ({grown.LETS} * ({grown.LETS} + 1) // 2)::BIGINT AS under_lets, CASE WHEN {grown.LETS} > 0 THEN {grown.CALLS} END::BIGINT AS calls_in_lets,
  CASE WHEN {grown.LETS} > 0 THEN '$.ExpressionBody.body' || repeat('.LetDefinition.body', ({grown.LETS} - 1)::INT) END AS innermost FROM {_MODULES} WHERE {grown.LETS} > 0""")
def nodes_below(spark, sf_dir):
    """Structural joins: variables named p-q below lets, counted once for each let around; references and the innermost let around them."""
    tree = nodes.shred(grown.corpus(spark, sf_dir, _V4), ("LetDefinition", "Variable", "Reference"))
    lets = tree.where("kind = 'LetDefinition'")
    pairs = structure.below(lets, tree.where("kind = 'Variable' AND name = 'p-q'"), {"kind": "let"}, {"kind": "variable"}).groupBy("doc_id", "module").agg(F.count("*").alias("under_lets"))
    near = structure.innermost(lets, tree.where("kind = 'Reference'"), {"path": "let"}, {"path": "reference"})
    near = near.groupBy("doc_id", "module").agg(F.count("*").alias("calls_in_lets"), F.max("let").alias("innermost"))
    return pairs.join(near.hint("merge"), ["doc_id", "module"])


@query(f"""SELECT p_partkey AS doc_id, CASE WHEN k IN (0, 3) THEN ['parcels#ship: Native can''t be said in the classic dialect'] ELSE [] END AS natives, k IN (0, 1, 4) AND p_size % 3 = 0 AS hole, NOT (k IN (0, 3) OR k IN (1, 4) AND p_size % 3 = 0) AS done
FROM (SELECT *, p_partkey % {len(_SETS)} AS k FROM part)""")
def cannot_downgrade(spark, sf_dir):
    """Documents that hold what the classic dialect can't say are reported, not written."""
    out = migrate.migrated_in(corpus(spark, sf_dir).select("doc_id", "package", "raw"), False)
    hole = F.exists("diagnostics", lambda d: F.startswith(d, F.lit("parcels#fee: Hole")))
    return out.select("doc_id", F.filter("diagnostics", lambda d: F.contains(d, F.lit("Native"))).alias("natives"), hole.alias("hole"), F.col("content").isNotNull().alias("done"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1), r AS (SELECT a, b, 1 AS hops FROM e UNION ALL SELECT r.a, e.b, r.hops + 1 FROM r JOIN e ON r.b = e.a)
SELECT a, b, min(hops)::INT AS hops FROM r GROUP BY a, b""")
def ref_closure(spark, sf_dir):
    _checkpoint_dir(spark)
    part = read(spark, sf_dir, "part").where("p_partkey > 1")
    return nodes.closure(part.select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b")))


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; make one only where none is set in a local session, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="quarry-"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, n_name) AS frontend, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, 'r' || n_regionkey) AS codegen
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def config_merge(spark, sf_dir):
    project = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("frontend"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("codegen"))
    workspace = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("frontend"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("codegen"))
    return compare.merged(project, workspace, ["nation"], ["frontend", "codegen"]).drop("nation")


_PREFIXES = ["http://", "https://", "https://blog.", "http://www.", "https://blog.tion", "http://t"]


@query(f"""SELECT page_id, prefix FROM (SELECT page_id, prefix, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC NULLS LAST) AS n
FROM pages LEFT JOIN (SELECT unnest({_PREFIXES}) AS prefix) ON starts_with(url, prefix)) WHERE n = 1""")
def longest_prefix(spark, sf_dir):
    prefixes = spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string")
    return compare.longest_prefix(read(spark, sf_dir, "pages"), prefixes, "url", "prefix").select("page_id", "prefix")


@query("SELECT user_id, event_type, min(event_id) AS position, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def indexmap_last_wins(spark, sf_dir):
    return documents.last_wins(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value")


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 97 > 0), b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 89 > 0)
SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' WHEN a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice THEN 'changed' END AS diff_kind,
  CASE WHEN a.o_orderstatus <> b.o_orderstatus AND a.o_totalprice <> b.o_totalprice THEN 'o_orderstatus,o_totalprice' WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' END AS fields
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE diff_kind IS NOT NULL""")
def module_diff(spark, sf_dir):
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    changed = orders.where(key % 89 > 0).withColumns({"o_orderstatus": F.when(key % 11 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(key % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return compare.module_diff(orders.where(key % 97 > 0), changed, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("""SELECT doc_id, module, name, diff_kind FROM (SELECT c_custkey AS doc_id, lower(c_mktsegment) AS module, c_custkey % 6 AS k, c_acctbal < 0 AS private FROM customer),
  LATERAL (SELECT unnest(CASE k WHEN 1 THEN ['-:missing_module'] WHEN 2 THEN ['kind:type_body'] WHEN 3 THEN ['balance-of:value_body'] WHEN 4 THEN ['amount:missing_type', 'sum:extra_type'] WHEN 5 THEN (CASE WHEN private THEN ['balance-of:access'] ELSE [] END) ELSE [] END) AS d),
  LATERAL (SELECT nullif(string_split(d, ':')[1], '-') AS name, string_split(d, ':')[2] AS diff_kind)
UNION ALL SELECT c_custkey, 'elsewhere', NULL, 'extra_module' FROM customer WHERE c_custkey % 6 = 1""")
def definition_diff(spark, sf_dir):
    """Classic documents against changed ones: by key another module, constructor, number, type name, access; or the same."""
    docs = classic_corpus(spark, sf_dir)
    k, raw, segment = F.col("doc_id") % 6, F.col("raw"), F.regexp_extract("raw", r'"modules":\[\[\[\["([a-z]+)"', 1)
    changed = (
        F.when(k == 1, F.replace(raw, F.concat(F.lit('"modules":[[[["'), segment, F.lit('"')), F.lit('"modules":[[[["elsewhere"')))
        .when(k == 2, F.replace(raw, F.lit('[["y"],["Unit",{}]]'), F.lit('[["y"],["Variable",{},["a"]]]')))
        .when(k == 3, F.replace(raw, F.lit('["BoolLiteral",true]'), F.lit('["BoolLiteral",false]')))
        .when(k == 4, F.replace(raw, F.lit('["amount"]'), F.lit('["sum"]')))
        .when(k == 5, F.replace(raw, F.lit('"access":"private"'), F.lit('"access":"public"')))
        .otherwise(F.replace(raw, F.lit('{"at"'), F.lit('{"seen":1,"at"')))
    )
    return compare.definition_diff(nodes.shapes(docs), nodes.shapes(docs.withColumn("raw", changed)))


@query("""SELECT p_partkey % 50 || '-' || p_size AS project, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL""")
def workspace_members(spark, sf_dir):
    """Projects right under apps/: not those of libs (named without a star), nor deeper ones."""
    k, name = F.col("p_partkey"), F.concat_ws("-", F.col("p_partkey") % 50, "p_size")
    at = F.when(k % 3 == 0, F.concat_ws("/", F.lit("apps"), name, F.lit("project.toml"))).when(k % 3 == 1, F.concat_ws("/", F.lit("libs"), name, F.lit("project.toml"))).otherwise(F.concat_ws("/", F.lit("apps"), name, F.lit("deep"), F.lit("project.toml")))
    found = read(spark, sf_dir, "part").select(at.alias("path"))
    return compare.members(found, ["apps/*", "libs"], "project.toml").join(found, "path").groupBy("project").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS doc_id, '{"package":"shop/no-' || c_custkey || '","module":"' || lower(c_mktsegment) || '","n_types":2,"n_values":1}' AS line FROM customer""")
def module_lines(spark, sf_dir):
    """A JSON line for each module."""
    docs = classic_corpus(spark, sf_dir)
    counts = documents.definitions(docs).groupBy("doc_id", "module").agg(F.count_if(F.col("family") == "type").alias("n_types"), F.count_if(F.col("family") == "value").alias("n_values"))
    rows = counts.hint("merge").join(docs.select("doc_id", "package"), "doc_id").select("doc_id", "package", "module", "n_types", "n_values")
    return documents.json_lines(rows, "doc_id")


@query("SELECT lang, source FROM documents EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 3 = 0")
def multiset_diff(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return compare.multiset_diff(d.select("lang", "source"), d.where("doc_id % 3 = 0").select("lang", "source"))


def _parcels(spark, sf_dir):
    """A parcel for every line: its weight, whether it is declared, its layers, the speed, the region and hops it goes."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    parcel = F.struct((F.col("l_quantity").cast("long") * F.col("p_size") * 15).alias("grams"), (F.col("l_returnflag") != "R").alias("declared"), (F.col("p_size") % 4).cast("long").alias("layers"))
    speed = F.when(n % 3 == 0, logic.SPEED.build("ground", [])).when(n % 3 == 1, logic.SPEED.build("air", [F.col("l_tax") * 10])).otherwise(logic.SPEED.build("courier", [F.col("l_discount") + 4, F.col("l_linenumber").cast("long")]))
    region, hops = F.when(n % 5 < 2, "EUROPE").otherwise("ASIA"), F.col("l_linenumber").cast("long") - 1
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", parcel.alias("parcel"), speed.alias("speed"), region.alias("region"), hops.alias("hops"))


_PARCELS = """SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * p_size * 15 AS grams, l_returnflag <> 'R' AS declared, p_size % 4 AS layers, (l_orderkey + l_linenumber) % 3 AS speed, l_tax * 10 AS extra, l_discount + 4 AS base,
  CASE WHEN (l_orderkey + l_linenumber) % 5 < 2 THEN 'EUROPE' ELSE 'ASIA' END AS region, l_linenumber - 1 AS hops FROM lineitem JOIN part ON l_partkey = p_partkey"""
_FEE = lambda kilos: f"CASE speed WHEN 0 THEN 3.25::DOUBLE + {kilos} * 0.5::DOUBLE WHEN 1 THEN extra + {kilos} * 1.25::DOUBLE WHEN 2 THEN CASE WHEN l_linenumber > 3 THEN base * 1.5::DOUBLE ELSE base END END"
_ISSUES = lambda grams, layers: f"concat_ws(',', CASE WHEN {grams} > 30000 THEN 'overweight' END, CASE WHEN NOT declared THEN 'undeclared' END, CASE WHEN {layers} <= 1 THEN 'fragile' END)"
_ZONE = "CASE WHEN hops = 0 THEN 'local' WHEN region = 'EUROPE' THEN CASE WHEN hops <= 2 THEN 'near' ELSE 'far' END ELSE 'overseas' END"


@query(f"SELECT l_orderkey, l_linenumber, {_FEE('(grams / 1000.0::DOUBLE)')} AS fee FROM ({_PARCELS})")
def logic_parcel_fee(spark, sf_dir):
    rows = logic.compiler().apply(_parcels(spark, sf_dir), logic.FEE, [F.col("speed"), F.col("parcel.grams").cast("double") / 1000.0], "fee")
    return rows.select("l_orderkey", "l_linenumber", "fee")


@query(f"SELECT l_orderkey, l_linenumber, {_ISSUES('grams', 'layers')} AS issues FROM ({_PARCELS})")
def logic_parcel_issues(spark, sf_dir):
    rows = logic.compiler().apply(_parcels(spark, sf_dir), logic.CHECK, [F.col("parcel")], "v")
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.col("v.tag"), ",").alias("issues"))


@query(f"SELECT l_orderkey, l_linenumber, {_ZONE} AS zone FROM ({_PARCELS})")
def logic_parcel_zone(spark, sf_dir):
    return logic.compiler().apply(_parcels(spark, sf_dir), logic.ZONE, [F.col("region"), F.col("hops")], "zone").select("l_orderkey", "l_linenumber", "zone")


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN i = '' THEN 'sent' ELSE 'held' END AS tag, CASE WHEN i = '' THEN {_FEE('((grams + 200) / 1000.0::DOUBLE)')} END AS fee, CASE WHEN i = '' THEN {_ZONE} END AS zone,
  CASE WHEN i <> '' THEN string_split(i, ',')[1] END AS first, CASE WHEN i <> '' THEN i END AS issues FROM (SELECT *, {_ISSUES('grams + 200', 'layers + 1')} AS i FROM ({_PARCELS}))""")
def logic_ship_parcel(spark, sf_dir):
    rows = logic.compiler().apply(_parcels(spark, sf_dir), logic.SHIP, [F.col(c) for c in ("parcel", "speed", "region", "hops")], "r")
    return rows.select("l_orderkey", "l_linenumber", "r.tag", "r.fee", "r.zone", "r.first", F.array_join(F.col("r.issues.tag"), ",").alias("issues"))


@query("SELECT l_orderkey, l_linenumber, least(a, b) AS low, greatest(a, b) AS high, abs(a - b) AS apart, -least(a, b) AS down FROM (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS a, l_suppkey % 70 AS b FROM lineitem)")
def logic_spread(spark, sf_dir):
    rows = logic.compiler().apply(read(spark, sf_dir, "lineitem"), logic.SPREAD, [F.col("l_partkey") % 100, F.col("l_suppkey") % 70], "r")
    return rows.select("l_orderkey", "l_linenumber", "r.*")


_OPS = {
    "and": "(x < y AND f < g)", "or": "(x < y OR f < g)", "eq": "x = y", "noteq": "x <> y", "ltint": "x < y", "lteqint": "x <= y", "gtint": "x > y", "gteqint": "x >= y", "ltfloat": "f < g", "lteqfloat": "f <= g",
    "gtfloat": "f > g", "gteqfloat": "f >= g", "addint": "x + y", "subint": "x - y", "multint": "x * y", "divint": "CASE WHEN y <> 0 THEN trunc(x::DOUBLE / y)::BIGINT END", "remainderint": "CASE WHEN y <> 0 THEN x % y END",
    "addfloat": "f + g", "subfloat": "f - g", "multfloat": "f * g", "divfloat": "CASE WHEN g <> 0 THEN f / g END", "concatenate": "s || s", "not": "NOT x < y", "negate": "-x", "pipe": "-y",
}


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'{sql} AS op_{n}' for n, sql in _OPS.items())} FROM (SELECT l_orderkey, l_linenumber, l_partkey % 7 - 3 AS x, l_suppkey % 5 - 2 AS y, l_extendedprice AS f, l_tax AS g, l_returnflag AS s FROM lineitem)")
def binary_operators(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    env = {"x": F.col("l_partkey") % 7 - 3, "y": F.col("l_suppkey") % 5 - 2, "f": F.col("l_extendedprice"), "g": F.col("l_tax"), "s": F.col("l_returnflag")}
    pair = lambda n: ("s", "s") if n == "concatenate" else ("f", "g") if n.endswith("float") else ("x", "y")
    alone = {"not": [logic.call("ltint", logic.var("x"), logic.var("y"))], "negate": [logic.var("x")], "pipe": [logic.var("y"), logic.ref("negate")]}
    truth = [logic.call("ltint", logic.var("x"), logic.var("y")), logic.call("ltfloat", logic.var("f"), logic.var("g"))]
    c = logic.compiler()
    return line.select("l_orderkey", "l_linenumber", *[c.compile(logic.call(n, *(alone[n] if n in alone else truth if n in ("and", "or") else map(logic.var, pair(n)))), env).alias(f"op_{n}") for n in _OPS])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE '{\"extensions\":{\"s\":\"' || o_orderstatus || '\"}}' END AS up, CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE '{\"s\":\"' || o_orderstatus || '\"}' END AS down FROM orders")
def convert_attrs(spark, sf_dir):
    """Attributes go up into extensions, and of those into the classic dialect come extensions alone."""
    attrs = F.when(F.col("o_orderkey") % 3 == 0, "{}").otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("s"))))
    trees = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('["Unit", '), attrs, F.lit("]")).alias("body"))
    new = nodes.converted(trees, "value", True).select("o_orderkey", F.col("converted").alias("body"))
    old = nodes.converted(new, "value", False)
    return old.select("o_orderkey", F.get_json_object("body", "$.Unit.attrs").alias("up"), F.get_json_object("converted", "$[1]").alias("down"))


#: Pieces of source; a file holds some of each, by its key.
_PIECES = [
    "pub type Colour { Red Mixed(Int, Int) } // two \"kinds\"\n",
    "pub fn shade(c: Colour, by: Int) -> Int {\n  case c { Red -> by Mixed(a, b) -> { a + b } * by }\n}\n",
    "fn again(n: Int) -> Int { let f = fn(x) { x + x } f(n) |> shade(Red, _) }\n",
    "pub fn label() -> String { \"type fn { case \\\\ \\\" \" <> \"}\" }\n",
]
_COUNTS = ["1 + k % 4", "k % 5", "k % 2", "k % 3"]


def _sources_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    many = [1 + k % 4, k % 5, k % 2, k % 3]
    return spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("path"), F.concat(*[F.repeat(F.lit(p), n.cast("int")) for p, n in zip(_PIECES, many, strict=True)]).alias("content"))


_FILES = f"SELECT p_partkey AS path, {', '.join(f'{c} AS n{i}' for i, c in enumerate(_COUNTS))} FROM (SELECT p_partkey, p_partkey AS k FROM part)"


@query(f"SELECT path, n0::INT AS n_types, (n1 + n2 + n3)::INT AS n_values, (n0 + n1 + n3)::INT AS n_public, n1::INT AS n_cases, true AS balanced, (12 * n0 + 37 * n1 + 34 * n2 + 12 * n3)::INT AS n_tokens FROM ({_FILES})")
def gleam_parse_counts(spark, sf_dir):
    return source_text.counted(_sources_of_parts(spark, sf_dir)).select("path", "n_types", "n_values", "n_public", "n_cases", "balanced", "n_tokens")


@query(f"SELECT * FROM (SELECT path, operator, CASE operator WHEN '+' THEN n1 + n2 WHEN '*' THEN n1 WHEN '|>' THEN n2 ELSE n3 END AS n FROM ({_FILES}), (VALUES ('+'), ('*'), ('|>'), ('<>')) t(operator)) WHERE n > 0")
def gleam_operator_counts(spark, sf_dir):
    return source_text.operators(_sources_of_parts(spark, sf_dir))


_MESSAGES = ["open", "load", "loaded", "change", "fail", "close", "noise"]


@query(f"""WITH m AS (SELECT user_id AS project, [{", ".join(f"'{m}'" for m in _MESSAGES)}][(event_id * 7 + user_id) % 11 % 7 + 1] AS message, event_id AS ts FROM events)
SELECT project, arg_max(CASE message WHEN 'load' THEN 'Loading' WHEN 'loaded' THEN 'Ready' WHEN 'change' THEN 'Stale' WHEN 'fail' THEN 'Error' ELSE 'Unloaded' END, ts) AS state, max(ts) AS since, count(*) AS n FROM m WHERE message <> 'noise' GROUP BY project""")
def project_states(spark, sf_dir):
    """The state that each project's last known message left, since when, and how many there were."""
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), ((F.col("event_id") * 7 + F.col("user_id")) % 11 % 7 + 1).cast("int"))
    return streaming.project_states(read(spark, sf_dir, "events").select(F.col("user_id").alias("project"), message.alias("message"), F.col("event_id").alias("ts")))


_SAID = ", ".join(f"'{m}'" for m in _MESSAGES)
_STEP = "CASE " + " ".join(f"WHEN s = '{state}' AND m = '{message}' THEN '{to}'" for state, by in machine.PROJECT.steps.items() for message, (to, _) in by.items()) + " ELSE s END"


def _folded(where: str) -> str:
    """DuckDB: the state that the machine's steps lead to from each user's messages in order."""
    return f"""SELECT user_id AS key, list_reduce(list_prepend('{machine.PROJECT.start}', list(m ORDER BY ts, event_id)), lambda s, m: {_STEP}) AS state, count(*) AS n
  FROM (SELECT *, [{_SAID}][(event_id * 7 + user_id) % 11 % 7 + 1] AS m FROM events) WHERE {where} GROUP BY user_id"""


def _said(events: DataFrame) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), ((F.col("event_id") * 7 + F.col("user_id")) % 11 % 7 + 1).cast("int"))
    return events.select(F.col("user_id").alias("key"), message.alias("message"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


@query(_folded("true"))
def machine_states(spark, sf_dir):
    """Each project's state after all its messages, by a machine whose steps depend on the state: functions composed in order."""
    return machine.final_states(_said(read(spark, sf_dir, "events")), machine.PROJECT)


@query(_folded("epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 3600000"))
def machine_stream(spark, sf_dir):
    """The same by keyed state over a stream of the table: what the watermark, an hour behind the newest message, has passed."""
    schema, at = read(spark, sf_dir, "events").schema, shared_folder(spark, "machine")
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    steps = machine.transitions(_said(stream), machine.PROJECT, late="1 hour")
    machine.started(steps.writeStream.format("parquet").option("path", f"{at}/steps").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True), spark).awaitTermination()
    rows = spark.read.schema(steps.schema).parquet(f"{at}/steps")
    return rows.groupBy("key").agg(F.max_by("after", F.struct("at", "seq")).alias("state"), F.count("*").alias("n"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


@query("""WITH e AS (SELECT 'f' || user_id % 50 AS path, event_id % 5 IN (2, 3) AS gone, date_trunc('milliseconds', ts) AS ts FROM events WHERE event_id % 5 < 4
UNION SELECT 'g' || user_id % 50, false, date_trunc('milliseconds', ts) FROM events WHERE event_id % 5 = 3),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, gone) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, gone) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e))
SELECT path, CASE WHEN arg_max(gone, ts) THEN 'deleted' ELSE 'modified' END AS kind, epoch_ms(min(ts)) AS first, epoch_ms(max(ts)) AS last, count(*) AS n FROM s GROUP BY path, session""")
def settled_events(spark, sf_dir):
    """Bursts of file events, two hours apart at least, by what their last event left."""
    k = F.col("event_id") % 5
    events = read(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, [*watching.KINDS, "odd"])), F.when(k < 4, k).otherwise(4).cast("int") + 1).alias("event_type"),
        F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("path"), F.concat(F.lit("g"), (F.col("user_id") % 50).cast("string")).alias("new_path"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"))
    return watching.settled(events, gap="2 hours").select("path", "kind", F.unix_millis("first").alias("first"), F.unix_millis("last").alias("last"), "n")


@query(f"""WITH n AS (SELECT count(*) FILTER ({grown.MODULES} = 1) AS one, count(*) FILTER ({grown.MODULES} = 2) AS two, count(*) FILTER (k % 10 = 7) AS bad, count(*) FILTER (k % 10 = 7 AND {grown.MODULES} = 2) AS bad_two FROM {grown.ROWS})
SELECT 0 AS ord, '{{"type":"progress","message":"decoded","definitions":' || (one + 2 * two - bad - bad_two) || ',"errors":' || bad || ',"modules":' || (one + 2 * two - bad - bad_two) || '}}' AS line FROM n
UNION ALL SELECT 1, '{{"type":"result","success":' || (bad = 0)::VARCHAR || '}}' FROM n""")
def progress_lines(spark, sf_dir):
    """JSON Lines of a decode's progress: what was observed while its rows passed."""
    docs = grown.corpus(spark, sf_dir, f"CASE WHEN k % 10 = 7 THEN '{{' ELSE {_V4} END")
    rows, watch = progress.observed(documents.definitions(docs), "decode", progress.decoding_metrics())
    rows.write.format("noop").mode("overwrite").save()
    return progress.result_lines(spark, watch, "decoded")


#: Source text by k: comments, strings over lines, numbers of any length, characters of several bytes and none of the language's.
_TEXT_PARTS = (
    ("'//// about ' || k || chr(10)", "k % 2"), ("'pub fn f' || k || '(a: Int, _b) -> Int {' || chr(10) || chr(9) || 'case a { 1 -> a |> g(2.5) }' || chr(10) || '}' || chr(13) || chr(10)", "1 + k % 3"),
    ("'let s = \"two' || chr(10) || 'lines ' || chr(92) || '\" of ' || k || '\" <> x.. ' || chr(10)", "k % 4"), ("'é😀 $ 99999999999999999999 007 _ Ab /// d' || chr(10)", "k % 3"), ("'a<=.b::c //e'", "1"), ("' \"open'", "k % 2"),
)
_TEXT = " || ".join(f"repeat({part}, CAST({n} AS INT))" for part, n in _TEXT_PARTS)
_LEXEME = source_text.LEXEME.replace("*+", "*").replace("'", "''")
_IN = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query(f"""WITH f AS (SELECT k, {_TEXT} AS text FROM {grown.ROWS}), t AS (SELECT k, text, regexp_extract_all(text, '{_LEXEME}') AS t, regexp_split_to_array(text, '{_LEXEME}') AS g FROM f),
r AS (SELECT k, text, unnest(t) AS t, unnest(g[1:len(t)]) AS g, generate_subscripts(t, 1) - 1 AS ord FROM t),
p AS (SELECT *, sum(length(g) + length(t)) OVER (PARTITION BY k ORDER BY ord) AS stop FROM r), q AS (SELECT *, stop - length(t) AS begun, left(text, (stop - length(t))::BIGINT) AS before FROM p)
SELECT k::VARCHAR AS path, ord::INT AS ord, t AS text, begun::BIGINT AS start, stop::BIGINT AS end, (1 + length(before) - length(replace(before, chr(10), '')))::BIGINT AS line, (1 + length(list_extract(string_split(before, chr(10)), -1)))::BIGINT AS column,
  CASE WHEN starts_with(t, '////') THEN 'module_comment' WHEN starts_with(t, '///') THEN 'doc_comment' WHEN starts_with(t, '//') THEN 'comment' WHEN starts_with(t, '"') AND length(t) > 1 THEN 'string' WHEN t IN ({_IN(source_text.KEYWORDS)}) THEN 'keyword'
  WHEN t IN ({_IN(source_text.OPERATORS)}) THEN 'operator' WHEN t IN ({_IN(source_text.PUNCTUATION)}) THEN 'punctuation' WHEN regexp_full_match(t, '[0-9]+') THEN CASE WHEN t::HUGEINT > 9223372036854775807 THEN 'error' ELSE 'int' END
  WHEN regexp_full_match(t, '[0-9]+[.][0-9]+') THEN 'float' WHEN t ~ '^[a-z]' THEN 'name' WHEN t ~ '^[A-Z]' THEN 'type_name' WHEN t ~ '^_.' THEN 'discard' ELSE 'error' END AS kind FROM q""")
def token_positions(spark, sf_dir):
    """Every token of source texts that vary, with kind, place, line and column."""
    return source_text.token_table(grown.texts(spark, sf_dir, _TEXT))


_LETS_IN_SQL = """SELECT /*+ MERGE(f) */ d.doc_id, n.module, ir_title(n.name) AS let_name, ir_local(f.fqn) AS called, count(*) AS n
FROM grown_documents d, LATERAL ir_nodes(d.raw) n JOIN (SELECT doc_id, m.module, m.fqn, m.path FROM grown_documents, LATERAL ir_nodes(raw) m WHERE m.kind = 'Reference') f
  ON d.doc_id = f.doc_id AND n.module = f.module AND startswith(f.path, concat(n.path, '.LetDefinition.body')) WHERE n.kind = 'LetDefinition' GROUP BY ALL"""


@query(f"SELECT k AS doc_id, module, 'V' AS let_name, 'f' AS called, ({grown.LETS} * {grown.CALLS})::BIGINT AS n FROM {_MODULES} WHERE {grown.LETS} > 0")
def sql_functions(spark, sf_dir):
    """A query in SQL text over registered functions: nodes as a lateral table function, names as SQL functions."""
    registered.register(spark)
    grown.corpus(spark, sf_dir, _V4).createOrReplaceTempView("grown_documents")
    return spark.sql(_LETS_IN_SQL)


@query(f"""SELECT 'shop-' || k AS package, module, 'value' AS family, 0 AS ord, 'go' AS name, 'Public' AS access, length({grown.body(False)}) AS n_chars, true AS same
FROM (SELECT s_suppkey AS k, unnest(CASE WHEN s_suppkey % 2 = 1 THEN ['m', 'n'] ELSE ['m'] END) AS module FROM supplier)""".replace("AS STRING", "AS VARCHAR"))
def tree_round_trip(spark, sf_dir):
    """Documents written as trees of files, a package each, and read back by their manifests: the same definitions."""
    at = shared_folder(spark, "tree")
    docs = grown.corpus(spark, sf_dir, f"replace({_V4}, '\"packageName\":\"shop\"', '\"packageName\":\"shop-' || CAST(k AS STRING) || '\"')", "supplier", "s_suppkey")
    defs = documents.definitions(docs)
    tree_sink.write_documents(docs, defs, at)
    held = defs.join(docs.select("doc_id", "package"), "doc_id").select("package", "module", "family", "name", F.get_json_object("body", "$").alias("was"))
    back = tree_sink.read_documents(spark, at).join(held, ["package", "module", "family", "name"], "left")
    same = F.coalesce(F.get_json_object("body", "$") == F.col("was"), F.lit(False))
    return back.select("package", "module", "family", "ord", "name", "access", F.length(F.get_json_object("body", "$.ExpressionBody.body")).alias("n_chars"), same.alias("same"))
