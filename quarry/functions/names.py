"""Naming rules as column functions: words of a name, renderings, paths and qualified names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed rules: a version 4 word ends at _ - / . : and before every upper-case character; a classic word is a letter
#: followed by lower-case letters, or digits.
V4_WORD = r"[^_\-/.:][^_\-/.:\p{Lu}]*"
CLASSIC_WORD = r"([a-zA-Z][a-z]*|[0-9]+)"


def v4_words(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(V4_WORD), F.lit(0))


def classic_words(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(CLASSIC_WORD), F.lit(1)), F.lower)


def first_upper(word: Column) -> Column:
    """First character upper, the rest as it is."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def kebab(words: Column) -> Column:
    return F.lower(F.array_join(words, "-"))


def snake(words: Column) -> Column:
    return F.lower(F.array_join(words, "_"))


def camel(words: Column) -> Column:
    """First word lower-cased, each later one with an upper first letter and an unchanged rest."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(first_upper(w))), "")


def title(words: Column) -> Column:
    return F.array_join(F.transform(words, first_upper), "")


def pascal(name: Column) -> Column:
    """Parts between - and _ with an upper first letter, joined."""
    return F.array_join(F.transform(F.split(name, "[-_]"), first_upper), "")


def is_lowercase(words: Column) -> Column:
    return F.rlike(snake(words), F.lit(r"^[\p{Ll}_]*$"))


def is_kebab(name: Column) -> Column:
    return F.rlike(name, F.lit("^[a-z0-9-]+$"))


def path_names(path: Column) -> Column:
    """The names of a path, each as kebab text; '' has one empty name."""
    return F.transform(F.split(path, "/"), lambda p: kebab(v4_words(p)))


def path_display(path: Column) -> Column:
    return F.array_join(path_names(path), "/")


def classic_path_display(names: Column) -> Column:
    """Dot-joined names, each the joined words of a classic name."""
    return F.array_join(F.transform(names, lambda n: F.array_join(classic_words(n), "")), ".")


def qname(text: Column) -> Column:
    """``module:local`` as struct<module, local>; null unless there are two parts."""
    part = F.split(text, ":")
    return F.when(F.size(part) == 2, F.struct(path_display(part[0]).alias("module"), kebab(v4_words(part[1])).alias("local")))


def fqname(text: Column) -> Column:
    """``package:module:local`` as struct<package, module, local>; null unless there are three parts."""
    part = F.split(text, ":")
    return F.when(F.size(part) == 3, F.struct(path_display(part[0]).alias("package"), path_display(part[1]).alias("module"), kebab(v4_words(part[2])).alias("local")))


def fqname_of_canonical(text: Column) -> Column:
    """``package:module#local``: the first ``:``, then the first ``#`` after it; null where one is missing."""
    pattern = r"(?s)^([^:]*):([^#]*)#(.*)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(F.rlike(text, F.lit(pattern)), F.struct(path_display(part(1)).alias("package"), path_display(part(2)).alias("module"), kebab(v4_words(part(3))).alias("local")))


def fqname_strict(text: Column) -> Column:
    """The canonical form with exactly one ``#`` and, before it, exactly one ``:``; null otherwise."""
    return F.when(F.rlike(text, F.lit(r"^[^:#]*:[^:#]*#[^#]*$")), fqname_of_canonical(text))


def canonical(name: Column) -> Column:
    return F.concat(name["package"], F.lit(":"), name["module"], F.lit("#"), name["local"])


def sanitize(name: Column) -> Column:
    """Slashes, blanks and backslashes become hyphens."""
    return F.translate(name, "/ \\", "---")


def classic_json(words: Column) -> Column:
    """A classic name as JSON: the list of its words."""
    return F.to_json(words)


def classic_of_json(text: Column) -> Column:
    """The words of a classic name in JSON; null for other JSON."""
    return F.from_json(text, "array<string>")
