"""Differences between tables of definitions, configuration merges and prefix lookups, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def module_diff(left: DataFrame, right: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """One row per difference: ``keys`` and diff_kind (missing, extra, or changed with the changed columns).

    Columns are compared null-safely; a full join on the keys, so either side may be large.
    """
    l, r = left.select(*keys, F.struct(*compared).alias("__l")), right.select(*keys, F.struct(*compared).alias("__r"))  # noqa: E741
    both = l.join(r, keys, "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")), F.lit(c)) for c in compared]))
    kind = F.when(F.col("__r").isNull(), "missing").when(F.col("__l").isNull(), "extra").when(F.size(differs) > 0, "changed")
    return both.select(*keys, kind.alias("diff_kind"), F.when(kind == "changed", F.array_join(differs, ",")).alias("fields")).where("diff_kind IS NOT NULL")


def definition_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(doc_id, module, name, diff_kind)`` between two tables ``(doc_id, module, family, name, access, shape)``.

    Kinds: missing_module and extra_module (once a module), missing_ and extra_ with type or value, access, type_body and
    value_body. A module that one side lacks gives no rows for its definitions. Both tables are read once: their rows are dealt
    by module, and all else goes on inside a module.
    """
    key = ["doc_id", "module", "family", "name"]
    compared = F.struct("access", "shape")
    side = lambda t, n: t.select(*key, F.lit(n).alias("side"), compared.alias("row"))
    dealt = side(left, "l").unionByName(side(right, "r")).repartition("doc_id", "module")
    of = lambda n: F.collect_list(F.when(F.col("side") == n, F.col("row")))
    met = dealt.groupBy(*key).agg(of("l").alias("ls"), of("r").alias("rs"))
    has = lambda c: F.max(F.size(c) > 0).over(Window.partitionBy("doc_id", "module"))
    met = met.withColumn("has_l", has("ls")).withColumn("has_r", has("rs"))
    lone = F.when(~F.col("has_r"), "missing_module").when(~F.col("has_l"), "extra_module")
    first = F.row_number().over(Window.partitionBy("doc_id", "module").orderBy("family", "name")) == 1  # a module that one side lacks comes once
    met = met.withColumn("lone", lone).withColumn("first", first).where("lone IS NULL OR first")
    pairs = met.select(*key, "lone", F.explode_outer(F.when(F.col("lone").isNull(), F.col("ls"))).alias("l"), "rs").select(*key, "lone", "l", F.explode_outer(F.when(F.col("lone").isNull(), F.col("rs"))).alias("r"))
    own = lambda word: F.array(F.concat(F.lit(word), "family"))
    changed = F.array_compact(F.array(F.when(~F.col("l.access").eqNullSafe(F.col("r.access")), "access"), F.when(~F.col("l.shape").eqNullSafe(F.col("r.shape")), F.concat("family", F.lit("_body")))))
    kinds = F.when(F.col("lone").isNotNull(), F.array("lone")).when(F.col("r").isNull(), own("missing_")).when(F.col("l").isNull(), own("extra_")).otherwise(changed)
    return pairs.select("doc_id", "module", F.when(F.col("lone").isNull(), F.col("name")).alias("name"), F.explode(kinds).alias("diff_kind"))


def members(found: DataFrame, patterns: list[str], config: str) -> DataFrame:
    """``(project, path)`` of a workspace: directories right under ``dir`` for each pattern ``dir/*`` that hold the file ``config``.

    Members without a star are no patterns and are left out; a project that several patterns find comes once.
    """
    directories = [p.removesuffix("/*") for p in patterns if p.endswith("/*")]
    parts = F.split("path", "/")
    inside = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    rows = found.where((F.element_at(parts, -1) == config) & inside.isin(directories))
    return rows.select(F.get(parts, F.size(parts) - 2).alias("project"), "path").distinct()


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` beyond those of ``right``, repeated rows counted."""
    return left.exceptAll(right)


def merged(project: DataFrame, workspace: DataFrame, on: list[str], sections: list[str]) -> DataFrame:
    """A project's sections, each replaced as a whole by the workspace's where the project has none."""
    w = workspace.select(*on, *[F.col(s).alias(f"__{s}") for s in sections])
    out = project.join(w, on, "left")
    return out.withColumns({s: F.coalesce(s, f"__{s}") for s in sections}).drop(*[f"__{s}" for s in sections])


def merged_map(project: Column, workspace: Column) -> Column:
    """Both maps, the project's entry winning for a key that both have."""
    return F.map_concat(F.map_filter(workspace, lambda k, _: ~F.coalesce(F.map_contains_key(project, k), F.lit(False))), project)


def longest_prefix(rows: DataFrame, prefixes: DataFrame, text: str, prefix: str) -> DataFrame:
    """Each row, repeated ones too, with the longest of ``prefixes`` that its text begins with (null if none).

    Looked up by distinct texts: a text meets its own beginnings, of the lengths that occur among the prefixes, in an
    equi-join, so neither side is compared pair by pair; the longest hit is one partial aggregate, joined back by the text.
    """
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]  # lengths alone, a few numbers
    cut = F.explode(F.array(*[F.substring("__text", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>"))
    cuts = rows.select(F.col(text).alias("__text")).where("__text IS NOT NULL").distinct().withColumn("__p", cut)
    hits = cuts.join(prefixes.select(F.col(prefix).alias("__p")).distinct(), "__p")
    longest = hits.groupBy("__text").agg(F.max_by("__p", F.length("__p")).alias(prefix))
    return rows.join(longest, F.col(text) == F.col("__text"), "left").drop("__text")
