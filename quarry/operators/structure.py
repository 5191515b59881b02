"""Questions about the place of nodes: what lies below what, by number ranges, and where two documents differ, by subtree digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import shredded

#: What names a definition in a table of nodes.
DEFINITION = ("doc_id", "module", "section", "def_name", "def_ord")


def below(upper: DataFrame, lower: DataFrame, keep_upper: dict[str, str], keep_lower: dict[str, str]) -> DataFrame:
    """Pairs of a node of ``upper`` and one of ``lower`` below it, both parts of a table of nodes: an equi-join by definition with a range.

    ``keep_*`` name the columns kept of each side, old to new. A node has as many partners as it has ancestors among
    ``upper``, so pairs grow with depth, not with the square of a definition. Both sides are sorted: how many nodes a task
    makes of a text is nothing that Spark can foresee, so neither side may be sent whole.
    """
    u = upper.select(*DEFINITION, F.col("node_id").alias("__from"), F.col("last").alias("__to"), *[F.col(c).alias(n) for c, n in keep_upper.items()])
    low = lower.select(*DEFINITION, F.col("node_id").alias("__at"), *[F.col(c).alias(n) for c, n in keep_lower.items()])
    pairs = u.join(low.hint("merge"), list(DEFINITION)).where((F.col("__at") > F.col("__from")) & (F.col("__at") <= F.col("__to")))
    return pairs.select(*DEFINITION, *keep_upper.values(), *keep_lower.values(), "__from", "__at").withColumnsRenamed({"__from": "upper_id", "__at": "lower_id"})


def innermost(upper: DataFrame, lower: DataFrame, keep_upper: dict[str, str], keep_lower: dict[str, str]) -> DataFrame:
    """For each node of ``lower`` the nearest of ``upper`` around it: of all, the one that begins last. Nodes without any are left out."""
    pairs = below(upper, lower, keep_upper, keep_lower)
    nearest = [F.max_by(c, "upper_id").alias(c) for c in keep_upper.values()]
    return pairs.groupBy(*DEFINITION, "lower_id", *keep_lower.values()).agg(F.max("upper_id").alias("upper_id"), *nearest)


def steps(path: Column) -> Column:
    """The fields from a definition's root to a node, by / : its JSON path without kinds; a place in a list stays with its field."""
    inside = F.filter(F.split(path, r"\."), lambda p: ~F.rlike(p, F.lit(r"^[A-Z$]")))
    return F.array_join(inside, "/")


def _digests(defs: list[tuple]) -> Iterator[tuple]:
    owns: dict[tuple, str] = {}  # kinds, names and literals occur again
    for module, _, family, k, name, nodes in defs:
        paths = {row[0]: row[13] for row in nodes}
        inside: dict[int | None, list[str]] = {}
        out = []
        for row in reversed(nodes):  # children before parents
            told = (*row[5:11], row[12])
            own = owns.get(told)
            if own is None:
                own = owns[told] = hashlib.sha256(json.dumps(told).encode()).hexdigest()[:32]
            digest = hashlib.sha256("|".join([own, *reversed(inside.pop(row[0], []))]).encode()).hexdigest()[:32]
            inside.setdefault(row[1], []).append(f"{row[2]}={digest}")
            out.append((module, family, k, name, row[0], row[13], paths.get(row[1]), row[6], own, digest))
        yield from reversed(out)


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, module, family, def_ord, name, node_id, path, parent_path, kind, own, digest)`` of every node of ``documents``.

    own is a digest of a node's kind, names and literal, digest one of that and of the roles and digests of its children
    in order: equal subtrees have equal digests, wherever they stand. Attributes don't count.
    """
    return shredded(docs, "doc_id long, module string, family string, def_ord int, name string, node_id int, path string, parent_path string, kind string, own string, digest string", _digests)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(doc_id, module, family, name, diff, path, old_path, was, now)`` between two tables of ``digests``: where definitions of both differ.

    diff: changed (a node on both sides whose own kind, name or literal differs), missing or extra (the top of a subtree
    that one side alone has there), moved (such an extra subtree that equals a missing one of its definition; old_path is
    that one's, the smallest of several). was and now are kinds. What lies below a node that changed its kind is not told.
    Both tables are read once: rows of both are dealt by definition, and all else goes on inside a definition. Rows without a
    full key belong to no definition.
    """
    key = ["doc_id", "module", "family", "name"]
    at, row = [*key, "path"], F.struct("parent_path", "kind", "own", "digest")
    side = lambda t, n: t.where(" AND ".join(f"{c} IS NOT NULL" for c in key)).select(*at, F.lit(n).alias("side"), row.alias("row"))
    dealt = side(left, "l").unionByName(side(right, "r")).repartition(*key)
    has = lambda n: F.max(F.col("side") == n).over(Window.partitionBy(*key))
    dealt = dealt.withColumn("both", has("l") & has("r")).where("both")
    of = lambda n: F.collect_list(F.when(F.col("side") == n, F.col("row")))
    met = dealt.groupBy(*at).agg(of("l").alias("ls"), of("r").alias("rs")).select(*at, F.explode_outer("ls").alias("l"), "rs").select(*at, "l", F.explode_outer("rs").alias("r"))
    rows = met.where(~F.col("l.digest").eqNullSafe(F.col("r.digest")))
    rows = rows.select(*at, F.coalesce("l.parent_path", "r.parent_path").alias("up"), F.col("l.kind").alias("was"), F.col("r.kind").alias("now"), F.coalesce("l.digest", "r.digest").alias("digest"), F.coalesce(F.col("l.own") != F.col("r.own"), F.lit(False)).alias("changed"))
    # Lone nodes, and nodes of a new kind, hide what is below: they leave a mark at their own path, which their children meet at up.
    mark = F.when(~F.col("was").eqNullSafe(F.col("now")), F.struct(F.col("path").alias("at"), F.lit(True).alias("hides")))
    rows = rows.withColumn("place", F.explode(F.array_compact(F.array(F.struct(F.col("up").alias("at"), F.lit(False).alias("hides")), mark))))
    rows = rows.withColumn("hidden", F.col("place.at").isNotNull() & F.max("place.hides").over(Window.partitionBy(*key, "place.at"))).where("NOT place.hides")
    rows = rows.where("changed OR (was IS NULL OR now IS NULL) AND NOT hidden")
    origin = F.min(F.when(F.col("now").isNull(), F.col("path"))).over(Window.partitionBy(*key, "digest"))
    rows = rows.withColumn("old_path", F.when(F.col("was").isNull(), origin))
    diff = F.when(F.col("changed"), "changed").when(F.col("now").isNull(), "missing").when(F.col("old_path").isNull(), "extra").otherwise("moved")
    return rows.select(*key, diff.alias("diff"), "path", "old_path", "was", "now")
