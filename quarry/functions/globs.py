"""Globs and allow/deny policies as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regex_of(glob: str, crosses: bool = True) -> str:
    """A regular expression for a glob: ``**/`` any directories, ``*`` any run (of any characters if it ``crosses``
    slashes), ``?`` one character, ``[...]`` and ``[!...]`` sets. Raises ValueError for a set that isn't closed."""
    out, at, any_one = [], 0, "." if crosses else "[^/]"
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif glob.startswith("**", at):
            out.append(".*")
            at += 2
        elif c == "*":
            out.append(f"{any_one}*")
            at += 1
        elif c == "?":
            out.append(any_one)
            at += 1
        elif c == "[":
            end = glob.find("]", at + 2 + (glob[at + 1 : at + 2] == "!"))
            if end < 0:
                raise ValueError(f"open set in {glob!r}")
            inner = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
            out.append(f"[^{inner[1:]}]" if inner.startswith("!") else f"[{inner}]")
            at = end + 1
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
            at += 1
    return "(?s)^" + "".join(out) + "$"


def matches(text: Column, glob: str) -> Column:
    """Does the whole text match? A glob with an open set falls back to its plain ends: prefix, suffix or contained text."""
    try:
        return F.rlike(text, F.lit(regex_of(glob)))
    except ValueError:
        if glob.startswith("*") and glob.endswith("*"):
            return F.contains(text, F.lit(glob[1:-1]))
        if glob.startswith("*"):
            return F.endswith(text, F.lit(glob[1:]))
        return F.startswith(text, F.lit(glob[:-1])) if glob.endswith("*") else text == glob


def allowed(url: Column, allow: Sequence[str], deny: Sequence[str], enabled: bool = True) -> Column:
    """Deny wins; no allow pattern allows everything that isn't denied; disabled allows nothing."""
    any_of = lambda globs: F.array_max(F.array(*[matches(url, g) for g in globs])) if globs else F.lit(False)
    return F.lit(False) if not enabled else ~any_of(deny) & (any_of(allow) if allow else F.lit(True))


def decide(urls: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """The same policy with ``patterns(kind, regex)`` as a table of rules: adds ``allowed``.

    The rules are collapsed to one row first (a policy is configuration, a few rows), so each url is read once.
    """
    rules = patterns.agg(F.collect_set(F.when(F.col("kind") == "allow", F.col("regex"))).alias("__allow"), F.collect_set(F.when(F.col("kind") == "deny", F.col("regex"))).alias("__deny"))
    hit = lambda rules: F.exists(rules, lambda r: F.rlike(F.col(url), r))
    out = urls.join(F.broadcast(rules))  # one row
    return out.withColumn("allowed", ~hit(F.col("__deny")) & ((F.size("__allow") == 0) | hit(F.col("__allow")))).drop("__allow", "__deny")
