"""Source references (local, http, git, hosted shorthand, gist) parsed, printed and judged as columns; cache accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import globs

#: Fixed forms of references and addresses.
HUB, GIST = "https://github.com/", "https://gist.github.com/"


def kind(source: Column) -> Column:
    """local, http, git, github or gist; ``invalid`` for empty texts and shorthands without owner and repository."""
    s = F.trim(source)
    short = F.substring_index(F.regexp_extract(s, r"(?s)^github:(.*)$", 1), "@", 1)
    return (
        F.when(s == "", "invalid")
        .when(F.startswith(s, F.lit("github:")), F.when(F.contains(short, F.lit("/")), "github").otherwise("invalid"))
        .when(F.startswith(s, F.lit("gist:")), F.when(s == "gist:", "invalid").otherwise("gist"))
        .when(F.rlike(s, F.lit("^https?://")), F.when(F.endswith(s, F.lit(".git")), "git").otherwise("http"))
        .when(F.startswith(s, F.lit("git@")) | F.endswith(s, F.lit(".git")), "git")
        .otherwise("local")
    )


def git_ref_kind(ref: Column) -> Column:
    """commit for 40 hex digits, tag for v and a digit, else branch."""
    return F.when(F.rlike(ref, F.lit("^[0-9a-fA-F]{40}$")), "commit").when(F.rlike(ref, F.lit("^v[0-9]")), "tag").otherwise("branch")


def _none(text: Column) -> Column:
    return F.when(text != "", text)


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def parse(source: Column) -> Column:
    """struct<kind, url, owner, repo, id, ref, ref_kind, subpath>; fields that a kind doesn't have are null.

    A reference may be of any length: nothing here backtracks or recurses over it.
    """
    return _bound(F.struct(F.trim(source).alias("s"), kind(source).alias("kind")), lambda x: _parsed(x["s"], x["kind"]))


def _git(s: Column) -> Column:
    """struct<bare, ref> of a git address: a reference follows the last @, unless that belongs to git@host or an address' user."""
    last_at, scheme = F.length(s) - F.instr(F.reverse(s), F.lit("@")) + 1, F.instr(s, F.lit("://"))
    ssh = F.startswith(s, F.lit("git@")) & ~F.contains(F.substring(s, F.lit(1), last_at - 1), F.lit("://"))
    at = F.contains(s, F.lit("@")) & ~ssh & (last_at > F.greatest(scheme, F.lit(1)))
    return F.struct(F.when(at, F.substring(s, F.lit(1), last_at - 1)).otherwise(s).alias("bare"), F.when(at, F.substring_index(s, "@", -1)).alias("ref"))


def _git_parts(git: Column) -> Column:
    """struct<url, ref, subpath>: a path follows the first .git and a slash."""
    dot = F.instr(git["bare"], F.lit(".git"))
    under = (dot > 0) & (F.substring(git["bare"], dot + 4, F.lit(1)) == "/")
    url = F.when(under, F.substring(git["bare"], F.lit(1), dot + 3)).otherwise(git["bare"])
    return F.struct(url.alias("url"), git["ref"].alias("ref"), F.when(under, F.substring(git["bare"], dot + 5, F.length(git["bare"]))).alias("subpath"))


def _parsed(s: Column, what: Column) -> Column:
    http_url, http_sub = F.substring_index(s, "#", 1), F.when(F.contains(s, F.lit("#")), F.regexp_extract(s, r"(?s)^[^#]*#(.*)$", 1))
    git = F.when(what == "git", _bound(_git(s), _git_parts))
    git_url, git_ref, git_sub = git["url"], git["ref"], git["subpath"]
    hub = F.regexp_extract(s, r"(?s)^github:(.*)$", 1)
    hub_part = F.split(F.substring_index(hub, "@", 1), "/")
    hub_ref = F.when(F.contains(hub, F.lit("@")), F.regexp_extract(hub, r"(?s)^[^@]*@(.*)$", 1))
    hub_sub = F.when(F.size(hub_part) > 2, F.array_join(F.slice(hub_part, 3, F.greatest(F.size(hub_part) - 2, F.lit(0))), "/"))
    gist = F.regexp_extract(s, r"(?s)^gist:(.*)$", 1)
    gist_file = F.when(F.contains(gist, F.lit("#")), F.regexp_extract(gist, r"(?s)^[^#]*#(.*)$", 1))
    gist_at = F.substring_index(gist, "#", 1)
    gist_ref = F.when(F.contains(gist_at, F.lit("@")), F.regexp_extract(gist_at, r"(?s)^[^@]*@(.*)$", 1))
    gist_id = F.substring_index(F.substring_index(gist_at, "@", 1), "/", -1)
    pick = lambda **by: F.coalesce(*[F.when(what == k, v) for k, v in by.items()])
    ref = pick(git=git_ref, github=hub_ref, gist=gist_ref)
    return F.struct(
        what.alias("kind"), pick(local=s, http=http_url, git=git_url).alias("url"), pick(github=F.get(hub_part, 0)).alias("owner"), pick(github=F.get(hub_part, 1)).alias("repo"),
        pick(gist=gist_id).alias("id"), ref.alias("ref"), F.when(ref.isNotNull() & (what != "gist"), git_ref_kind(ref)).alias("ref_kind"),
        pick(http=http_sub, git=git_sub, github=hub_sub, gist=gist_file).alias("subpath"),
    )


def canonical_url(source: Column) -> Column:
    """The address that policies are matched against; null for an invalid reference."""
    return _bound(parse(source), _address)


def _address(p: Column) -> Column:
    at, under, piece = (F.coalesce(F.concat(F.lit(c), x), F.lit("")) for c, x in (("@", p["ref"]), ("/", p["subpath"]), ("#", p["subpath"])))
    return (
        F.when(p["kind"] == "local", F.concat(F.lit("file://"), p["url"]))
        .when(p["kind"] == "http", F.concat(p["url"], piece))
        .when(p["kind"] == "git", F.concat(p["url"], at, under))
        .when(p["kind"] == "github", F.concat(F.lit(HUB), p["owner"], F.lit("/"), p["repo"], under, at))
        .when(p["kind"] == "gist", F.concat(F.lit(GIST), p["id"], F.coalesce(F.concat(F.lit("/"), p["ref"]), F.lit("")), piece))
    )


def may_fetch(source: Column, allow: list[str], deny: list[str], trusted: list[str], enabled: bool = True) -> Column:
    """Local always; else, if enabled: a trusted owner passes even a deny pattern, others by the policy."""
    p = parse(source)
    known = F.coalesce(p["owner"].isin(trusted), F.lit(False)) if trusted else F.lit(False)
    passes = F.coalesce(globs.allowed(canonical_url(source), allow, deny), F.lit(False))
    return (p["kind"] == "local") | (F.lit(enabled) & (known | passes))


def cache_key(source: Column) -> Column:
    """16 hex digits of the canonical address."""
    return F.lower(F.lpad(F.hex(F.xxhash64(canonical_url(source))), 16, "0"))


def cache_path(root: str, source: Column) -> Column:
    key = cache_key(source)
    return F.concat_ws("/", F.lit(root), parse(source)["kind"], F.substring(key, 1, 2), key)


def fresh(modified: Column, now: Column, ttl_seconds: int) -> Column:
    """Is an entry still valid? Its age in seconds may be the limit, not more; 0 never expires."""
    return F.lit(True) if ttl_seconds == 0 else (F.unix_timestamp(now) - F.unix_timestamp(modified)) <= ttl_seconds


def cache_stats(index: DataFrame, size: str = "size") -> DataFrame:
    return index.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size"))
