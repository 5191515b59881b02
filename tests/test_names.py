import pytest
from pyspark.sql import functions as F

from quarry.functions import globs, names
from quarry.sources import remote


def one(spark, column, *values):
    names_ = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names_)).select(column(*map(F.col, names_)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "words"),
    [("processBuySDK_2x-foo.Bar", ["process", "Buy", "S", "D", "K", "2x", "foo", "Bar"]), ("", []), ("a1b2", ["a1b2"]), ("__a", ["a"]), ("ÄrgerÜber", ["Ärger", "Über"])],
)
def test_v4_words(spark, text, words):
    assert one(spark, names.v4_words, text) == words


@pytest.mark.parametrize(("text", "words"), [("", []), ("123", ["123"]), ("ABC", ["a", "b", "c"]), ("a1b2", ["a", "1", "b", "2"]), ("fooBar", ["foo", "bar"]), ("é", [])])
def test_classic_words(spark, text, words):
    assert one(spark, names.classic_words, text) == words


def test_renderings(spark):
    w = lambda f: one(spark, lambda c: f(names.v4_words(c)), "myFooURL")
    assert (w(names.camel), w(names.snake), w(names.kebab), w(names.title)) == ("myFooURL", "my_foo_u_r_l", "my-foo-u-r-l", "MyFooURL")
    assert w(names.is_lowercase) and not one(spark, lambda c: names.is_lowercase(names.v4_words(c)), "a1")


def test_qualified_names(spark):
    f = one(spark, names.fqname, "org/pkg:mod/sub:Func")
    assert tuple(f) == ("org/pkg", "mod/sub", "func")
    assert one(spark, lambda c: names.canonical(names.fqname(c)), "my/pkg:my/mod:myFunc") == "my/pkg:my/mod#my-func"
    assert one(spark, names.fqname, "a:b") is None and one(spark, names.fqname_of_canonical, "a:b") is None
    assert tuple(one(spark, names.fqname_of_canonical, "a:b#c")) == ("a", "b", "c")
    assert one(spark, names.fqname_strict, "a:b#c#d") is None and one(spark, names.qname, "m") is None
    assert tuple(one(spark, names.qname, "mypkg/mymod:MyFunc")) == ("mypkg/mymod", "my-func")
    assert one(spark, names.path_display, "Test/Module") == "test/module"
    assert one(spark, lambda c: F.size(names.path_names(c)), "") == 1


@pytest.mark.parametrize(
    ("pattern", "match", "other"),
    [("**/*.rs", "src/main.rs", "README.md"), ("src/**/*.rs", "src/utils/helper.rs", "tests/integration.rs"), ("**/mod.rs", "src/utils/mod.rs", "src/lib.rs"), ("target/**/*", "target/debug/app", "src/main.rs"), ("a[!b]?", "axy", "aby"), ("*x[", "ax[", "ax")],
)
def test_globs(spark, pattern, match, other):
    assert one(spark, lambda c: globs.matches(c, pattern), match)
    assert not one(spark, lambda c: globs.matches(c, pattern), other)


def test_policy(spark):
    ok = lambda url, **k: one(spark, lambda c: globs.allowed(c, **k), url)
    assert ok("https://a/x", allow=[], deny=[]) and not ok("https://a/x", allow=["https://a/*"], deny=["*x"])
    assert not ok("http://b", allow=["https://*"], deny=[]) and not ok("u", allow=[], deny=[], enabled=False)
    fetch = lambda s, **k: one(spark, lambda c: remote.may_fetch(c, **({"allow": [], "deny": ["*github*"], "trusted": ["me"]} | k)), s)
    assert fetch("./a") and fetch("github:me/r") and not fetch("github:you/r") and not fetch("github:me/r", enabled=False)


@pytest.mark.parametrize(
    ("text", "kind", "url", "ref", "subpath", "canonical"),
    [
        ("  ./a/b.json ", "local", "./a/b.json", None, None, "file://./a/b.json"),
        ("https://h/a.zip#x/y", "http", "https://h/a.zip", None, "x/y", "https://h/a.zip#x/y"),
        ("https://h/o/r.git", "git", "https://h/o/r.git", None, None, "https://h/o/r.git"),
        ("git@h:o/r.git", "git", "git@h:o/r.git", None, None, "git@h:o/r.git"),
        ("git@h:o/r.git/sub/x", "git", "git@h:o/r.git", None, "sub/x", "git@h:o/r.git/sub/x"),
        ("github:o/r/p/f@v1.2", "github", None, "v1.2", "p/f", "https://github.com/o/r/p/f@v1.2"),
        ("github:o/r@main/x", "github", None, "main/x", None, "https://github.com/o/r@main/x"),
        ("gist:u/abc@r1#f.json", "gist", None, "r1", "f.json", "https://gist.github.com/abc/r1#f.json"),
        ("github:o", "invalid", None, None, None, None), ("gist:", "invalid", None, None, None, None), ("", "invalid", None, None, None, None),
    ],
)
def test_sources(spark, text, kind, url, ref, subpath, canonical):
    p = one(spark, remote.parse, text)
    assert (p["kind"], p["url"], p["ref"], p["subpath"]) == (kind, url, ref, subpath)
    assert one(spark, remote.canonical_url, text) == canonical


def test_refs(spark):
    kind = lambda r: one(spark, remote.git_ref_kind, r)
    assert [kind("a" * 40), kind("v1"), kind("vx"), kind("main")] == ["commit", "tag", "branch", "branch"]


def test_cache(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    fresh = lambda ttl: spark.range(1).select(remote.fresh(t("2024-01-01 00:00:00"), t("2024-01-01 00:01:00"), ttl)).first()[0]
    assert fresh(60) and not fresh(59) and fresh(0)
    assert len(one(spark, remote.cache_key, "github:o/r")) == 16
    assert one(spark, lambda c: remote.cache_path("/c", c), "./a").startswith("/c/local/")


def test_classic_names_as_json(spark):
    row = spark.sql("SELECT array('local', 'date') AS w, '[\"a\",\"b\"]' AS j, '7' AS bad").select(names.classic_json(F.col("w")).alias("j"), names.classic_of_json(F.col("j")).alias("w"), names.classic_of_json(F.col("bad")).alias("none")).first()
    assert tuple(row) == ('["local","date"]', ["a", "b"], None)
