"""Secret scans: pattern matches, plus sliding-window Shannon entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: kind -> (pattern, group of which ``least`` characters are asked; the order breaks ties of start).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
KINDS = (*BASE, "entropy")

#: Classes of characters, each with the pattern of its candidates and the bits a character that some window must reach: what
#: stands first of equal starts is told first. Runs of one class inside a wider one are candidates of their own; a candidate that
#: is one of an earlier class as a whole is not looked at again.
CLASSES = {"hex": (r"[0-9a-fA-F]{24,}", 3.0), "base64": (r"[A-Za-z0-9+/]{24,}={0,2}", 4.0), "mixed": (r"[A-Za-z0-9+/_=-]{24,}", 4.0)}
WINDOW = 24
#: Candidates that match one of these are no secrets: UUIDs, only letters (long words), only digits, dotted placeholders, repeated separators.
ALLOW = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[A-Za-z/_=-]+$", r"^[0-9/_=+-]+$", r"(?i)example|placeholder|changeme|xxxxx", r"(?i)^[a-z]*abcdefghijklmnopqrstuvwxyz", r"[-=_/+]{6}")
#: Fixed point for c * log2(c): sums stay exact, so the incremental window can't drift.
SCALE = 1 << 20
#: Matches of a text that are placed together.
RUN = 512


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s int, t string>>, s the 0-based code point where match t starts.

    The gaps between matches (``split``) and the matches (``regexp_extract_all``) alternate; their running lengths are
    the positions. They are summed in runs of RUN matches, then the runs, so that texts of very many matches stay cheap:
    appending copies a run, not all that came before.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("t"), F.slice(gaps, 1, F.size(found)).alias("g"))
    kind = "array<struct<s:int,t:string>>"
    none = F.array().cast(kind)
    width = lambda x: F.length(x["g"]) + F.length(x["t"])
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + width(x)).cast("int").alias("at"),
        F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["g"])).cast("int").alias("s"), x["t"].alias("t"))).alias("out"),
    )

    def placed(all_pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(all_pairs, k * RUN + 1, RUN), start, step))
        return F.get(F.transform(F.array(runs), shifted), 0)

    def shifted(runs: Column) -> Column:
        ahead = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.array_append(acc, (F.element_at(acc, -1) + r["at"]).cast("int")))
        return F.flatten(F.zip_with(runs, F.slice(ahead, 1, F.size(runs)), lambda r, by: F.transform(r["out"], lambda x: F.struct((x["s"] + by).cast("int").alias("s"), x["t"].alias("t")))))

    # Arrays of one element bind what is used more than once, else it would be computed for each use.
    return F.when(F.regexp_count(text, F.lit(pattern)) > 0, F.get(F.transform(F.array(pairs), placed), 0)).otherwise(none)


def running(values: Column, start: int, op) -> Column:
    """For each of an array of ints what ``op`` makes of ``start`` and all before it; in runs, as ``located``."""
    first, none = F.lit(start).cast("int"), F.array().cast("array<int>")
    step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def over(bound: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(bound, k * RUN + 1, RUN), F.struct(first.alias("at"), none.alias("out")), step))
        return F.get(F.transform(F.array(runs), shifted), 0)

    def shifted(runs: Column) -> Column:
        ahead = F.aggregate(runs, F.array(first), lambda acc, r: F.array_append(acc, op(F.element_at(acc, -1), r["at"])))
        return F.flatten(F.zip_with(runs, F.slice(ahead, 1, F.size(runs)), lambda r, by: F.transform(r["out"], lambda x: op(x, by))))

    return F.when(F.size(values) > 0, F.get(F.transform(F.array(values), over), 0)).otherwise(none)


def window_bits(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits a character) of any ``window`` consecutive characters of ``candidate``; 0 for a shorter one.

    The window slides by a character: the counts of the symbol that enters and of the one that leaves, among the window's
    characters, tell how the sum of c*log2(c) changes, by two table lookups in fixed-point integers. All other counts stay.
    """
    cost = [round(SCALE * c * math.log2(c)) if c else 0 for c in range(window + 2)]
    table = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    comes, goes, all_of = table(cost[c + 1] - cost[c] for c in range(window + 1)), table([0, *(cost[c - 1] - cost[c] for c in range(1, window + 1))]), table(cost)
    count = lambda w, c: window - F.length(F.replace(w, c, F.lit("")))

    def slide(acc: Column, c: Column) -> Column:
        w = acc["w"]
        leaves = F.substring(w, 1, 1)
        change = F.when(c == leaves, F.lit(0).cast("long")).otherwise(F.get(comes, count(w, c)) + F.get(goes, count(w, leaves)))
        return F.struct(F.concat(F.substring(w, 2, window), c).alias("w"), (acc["sum"] + change).alias("sum"), F.least(acc["least"], acc["sum"]).alias("least"))

    first = F.substring(candidate, 1, window)
    begin = F.aggregate(F.array_distinct(F.split(first, "")), F.lit(0).cast("long"), lambda acc, c: acc + F.get(all_of, count(first, c)))
    start = F.struct(first.alias("w"), begin.alias("sum"), F.lit(1 << 62).cast("long").alias("least"))
    after = F.slice(F.split(candidate, ""), window + 1, F.greatest(F.length(candidate) - window, F.lit(0)))
    least = F.aggregate(after, start, slide, lambda acc: F.least(acc["least"], acc["sum"]))
    return F.when(F.length(candidate) < window, 0.0).otherwise(math.log2(window) - least / F.lit(float(SCALE * window)))


def spans(text: Column, allow: Sequence[str] = ALLOW, window: int = WINDOW, classes: dict[str, tuple[str, float]] = CLASSES) -> dict[str, Column]:
    """Arrays of struct<s, e, k, kind> for each kind: start, end (exclusive), order of the kind, its name.

    Of entropy spans, which may be of several classes, k tells the class.
    """

    def span(k: int, kind: str):
        return lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["t"])).alias("e"), F.lit(k).alias("k"), F.lit(kind).alias("kind"))

    def long_enough(pattern: str, group: int, least: int):
        return lambda x: F.length(F.regexp_extract(x["t"], pattern, group)) >= least

    allowed = lambda t: F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.rlike(t, a)) if allow else F.lit(False)
    out = {kind: F.transform(F.filter(located(text, p), long_enough(p, group, least)), span(k, kind)) for k, (kind, (p, group, least)) in enumerate(BASE.items())}

    def random(bits: float, earlier: list[str]):
        again = lambda t: F.rlike(t, F.lit("^(?:" + "|".join(earlier) + ")$")) if earlier else F.lit(False)
        return lambda x: ~again(x["t"]) & ~allowed(x["t"]) & (window_bits(x["t"], window) >= bits)

    patterns = [pattern for pattern, _ in classes.values()]
    found = [F.transform(F.filter(located(text, pattern), random(bits, patterns[:k])), span(len(BASE) + k, "entropy")) for k, (pattern, bits) in enumerate(classes.values())]
    return out | {"entropy": F.concat(*found)}


def apart(base: Column, entropy: Column) -> Column:
    """The spans of ``entropy`` that overlap none of ``base`` and none of their own that comes before: sorted, by running ends and starts."""
    is_base = lambda x: x["k"] < len(BASE)

    def left(all_spans: Column) -> Column:
        ends = running(F.transform(all_spans, lambda x: x["e"]), 0, F.greatest)
        back = F.transform(F.reverse(all_spans), lambda x: F.when(is_base(x), x["s"]).otherwise((1 << 31) - 1).cast("int"))
        starts = F.reverse(running(back, (1 << 31) - 1, F.least))
        kept = F.filter(F.arrays_zip(all_spans.alias("x"), ends.alias("end"), starts.alias("start")), lambda z: ~is_base(z["x"]) & (z["x"]["s"] >= z["end"]) & (z["x"]["e"] <= z["start"]))
        return F.transform(kept, lambda z: z["x"])

    return F.when(F.size(entropy) > 0, F.get(F.transform(F.array(F.array_sort(F.concat(base, entropy))), left), 0)).otherwise(entropy)


def scan_secrets(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), **how) -> DataFrame:
    """Columns ``keep`` and, for every row, ``n_<kind>`` and ``spans``: array<struct<s, e, k, kind>> by start, then kind.

    Null text is empty and has no spans; repeated rows stay; other columns are dropped. Candidates of each class of characters
    are told by the entropy of their windows; an entropy span that overlaps a pattern's span, or one that begins before
    (or with it, of an earlier class), adds nothing and is left out.
    """
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    found = spans(F.col("__t"), **how)
    df = df.select(*keep, *[found[k].alias(f"__{k}") for k in KINDS])
    df = df.withColumn("__base", F.array_sort(F.concat(*[F.col(f"__{k}") for k in BASE])))
    df = df.withColumn("__extra", apart(F.col("__base"), F.col("__entropy")))
    every = F.when(F.size("__extra") > 0, F.array_sort(F.concat("__base", "__extra"))).otherwise(F.col("__base"))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return df.select(*keep, *counts, F.size("__extra").cast("long").alias("n_entropy"), F.col("__base").alias("base_spans"), every.alias("spans"))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", **how) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by ``[kind]``; ``length`` is counted anew.

    Overlapping spans are replaced once, by the first. Rows without spans are unchanged. A text is cut in runs of spans, and
    those between spans, so that one of very many spans is copied a few times, not once a span.
    """
    found = spans(F.coalesce(F.col(text), F.lit("")), **how)
    df = docs.select(F.struct(*docs.columns).alias("row"), F.array_sort(F.concat(*found.values())).alias("spans"))
    old = F.col("row")[text]
    # Each span with the end of all before it: what lies between is kept, unless the span begins before that end.
    ends = running(F.transform("spans", lambda x: x["e"]), 0, F.greatest)
    df = df.select("row", F.arrays_zip(F.col("spans").alias("x"), ends.alias("end")).alias("cuts"))

    def piece(part: Column, begin: Column):
        kept = lambda z: F.substring(part, z["end"] - begin + 1, z["x"]["s"] - z["end"])
        return lambda z: F.when(z["x"]["s"] < z["end"], "").otherwise(F.concat(kept(z), F.lit("["), z["x"]["kind"], F.lit("]")))

    def run(k: Column) -> Column:
        cuts = F.slice("cuts", k * RUN + 1, RUN)
        begin = F.get(cuts, 0)["end"]
        until = F.array_max(F.transform(cuts, lambda z: z["x"]["s"]))
        held = F.struct(F.substring(old, begin + 1, F.greatest(until - begin, F.lit(0))).alias("part"), begin.alias("begin"))
        return F.get(F.transform(F.array(held), lambda h: F.array_join(F.transform(cuts, piece(h["part"], h["begin"])), "")), 0)

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / RUN).cast("int")), run)
    last = F.array_max(F.transform("cuts", lambda z: z["x"]["e"]))
    new = F.when(F.size("cuts") > 0, F.concat(F.array_join(pieces, ""), F.substring(old, last + 1, F.length(old)))).otherwise(old)
    df = df.select("row", new.alias("new"))
    size = F.when(F.col("new").eqNullSafe(old), F.col("row")[length]).otherwise(F.length("new")) if length in docs.columns else None
    changed = {text: F.col("new")} | ({length: size.cast(docs.schema[length].dataType)} if size is not None else {})
    return df.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``."""
    df = scan_secrets(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "n_entropy")
