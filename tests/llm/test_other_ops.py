"""Archives, chats, vectors and the pipeline, against brute force and round trips."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import chat_format, itq_dedup, shared, token_counts, vector_search, warc_zstd

# archives

PAGES = [(1, "http://a", "x"), (2, "http://b\r\nWARC: 1 é", "x"), (3, None, None), (4, "http://c", ""), (5, "http://d", "é" * 300_000), (6, "http://e", "x\r\n\r\ny"), (7, "http://f", "x"), (7, "http://f", "x"), (None, "http://g", "lone")]


def through(spark, rows, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"salt": F.lit("own"), "payload": F.lit(1), "record_type": F.lit("x")})
    return warc_zstd.read_archives(warc_zstd.archive_files(warc_zstd.archive_pages(pages, **how))).collect()


@pytest.mark.parametrize("size", [1, 16 << 20])
def test_archives_round_trip(spark, size):
    rows = through(spark, PAGES, archive_bytes=size)
    want = collections.Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        refers = None if page is None or page == last else str(last)
        want[page if page is None else str(page), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers else "response", refers] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert all(r["error"] is None for r in rows)
    assert next(r for r in rows if r["page_id"] == "6")["payload"] == b"x\r\n\r\ny"
    assert next(r for r in rows if r["page_id"] == "1")["url"] == "http://a"


def test_pages_without_id_have_record_ids_of_their_own(spark):
    pages = spark.createDataFrame([(None, "http://a", f"x{i}") for i in range(4)], "page_id long, url string, html string").coalesce(1)
    files = warc_zstd.archive_files(warc_zstd.archive_pages(pages))
    ids = [line for f in files.collect() for data, _ in warc_zstd.frames(f["content"]) for line in data.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 4 and all(r["page_id"] is None for r in warc_zstd.read_archives(files).collect())


def test_small_payloads_and_empty_tables(spark):
    rows = through(spark, PAGES, least_bytes=100)
    assert {r["record_type"] for r in rows} == {"response"}
    assert through(spark, []) == []


def archive(records, dictionary=b"WARC/1.1 " * 20):
    packer = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary))
    return warc_zstd.leading_frame(dictionary) + b"".join(map(packer.compress, records))


def test_reader_finds_what_is_broken():
    good = warc_zstd.page_record("1", "http://a", b"hello", base64.b32encode(hashlib.sha1(b"hello").digest()).decode(), None)
    assert [warc_zstd.parse_record(d)["error"] for d, _ in warc_zstd.frames(archive([good, good]))] == [None, None]
    bad = [good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good[:-1], good.replace(b"hello", b"hellO"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), b""]
    found = [warc_zstd.parse_record(d)["error"] for d, _ in warc_zstd.frames(archive(bad))]
    assert found == ["no WARC version", "no warc-date", "wrong length", "wrong digest", "wrong payload length", "no WARC version"]
    whole = archive([good])
    assert list(warc_zstd.frames(whole[:-3]))[-1][1] == "cut short" and list(warc_zstd.frames(whole + b"12345678901"))[-1][1] == "no frame"
    plain = b"no dictionary " * 4
    squeezed = zstd.ZstdCompressor().compress(plain)
    packer = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(plain))
    assert list(warc_zstd.frames(warc_zstd.leading_frame(squeezed) + packer.compress(good)))[0][0] == good


# chats


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|>s/[]INST\\ab\né\U0001f600", max_size=6), st.text(alphabet="<|>s/[]INST\\ab\né\U0001f600", max_size=20)), max_size=4))
def test_rendering_is_reversible(turns):
    text, _ = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    inside = text.split(chat_format.MARK)
    assert len(inside) == 2 * len(turns) + 2 and not any(c in part for part in inside for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="ab \n'\u00e9\u4e2d\U0001f600\u0416.1", max_size=30)), max_size=4))
def test_offsets_are_the_library_s(turns):
    from tokenizers import Tokenizer

    text, _ = chat_format.render(turns)
    want = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY)).encode(text, add_special_tokens=False)
    ids, starts, ends = chat_format.encode_with_offsets(text, token_counts.VOCABULARY)
    assert ids.tolist() == want.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets


def test_chats(spark):
    say = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "B <|endoftext|> b"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "\n é\U0001f600 <"), (1, 4, "assistant", "\\| next"), (2, 0, None, "x"), (3, None, "assistant", ""),
        (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (None, 0, "assistant", "nobody"), (5, 0, "user", say), (5, 1, "assistant", say), (6, 0, "assistant", "long " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("own"), "turns": F.lit(1)})
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hexed("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), hexed(learned))
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_masks_equal_brute_force():
    r = random.Random(3)
    for _ in range(200):
        cuts = sorted(r.sample(range(60), 20))
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        spans = np.array(sorted(r.sample(range(60), 6)))
        want = [any(a < e and s < b for s, e in zip(spans[::2], spans[1::2], strict=True)) for a, b in zip(starts, ends, strict=True)]
        assert chat_format.mask_of(starts, ends, spans).tolist() == want


# vectors

INF, NAN = math.inf, math.nan


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"label": F.lit(None).cast("int"), "score": F.lit("own"), "id": F.lit("own"), "copies": F.lit("own"), "v": F.lit("own")})


def cloud(n, d=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    x = np.vstack([centres[i % 12] + 0.1 * rng.standard_normal(d) if i % 3 else rng.standard_normal(d) for i in range(n)])
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


ODD = [(1000, None), (1001, [0.0] * 24), (1002, [NAN] * 24), (1003, [INF] + [1.0] * 23), (1004, [1.0, None] * 12), (None, [1.0] * 24), (1005, []), (1006, [1.0, 2.0]), (1050, [1.0, 2.0, 0.0]), (1008, [1.0] * 24), (1008, [1.0] * 24)]


def brute_links(rows, cosine=0.9):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    d = max(len(v) for _, v in good)
    x = itq_dedup.unit(np.array([v + [0.0] * (d - len(v)) for _, v in good]))
    near = x @ x.T >= cosine
    links, up = collections.Counter(), {i: i for i, _ in good}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        if a != b:
            links[good[a][0]] += 1
            p, q = root(good[a][0]), root(good[b][0])
            up[max(p, q)] = min(p, q)
    return links, {i: root(i) for i, _ in good}


def partners(x, cosine, rng):
    """A unit vector at the given cosine of each row, in a random direction."""
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * itq_dedup.unit(away)


@pytest.mark.parametrize("size", [24, 64, 200])
@pytest.mark.parametrize("mean_square", [0.0, 0.5, 0.7])
def test_tables_find_pairs_of_every_cosine(size, mean_square):
    rng = np.random.default_rng(size)
    x = math.sqrt(1 - mean_square) * itq_dedup.unit(rng.standard_normal((4000, size))) + math.sqrt(mean_square / size)
    x = itq_dedup.unit(x)
    centre = x.mean(axis=0)
    plan = itq_dedup.plan_for(50_000, 0.9, float(centre @ centre))
    rotations = [itq_dedup.learn(x[:2000], seed, plan.centred) for seed in range(plan.words)]
    for cosine in (0.9, 0.92, 0.95, 0.99):
        a, b = (itq_dedup.codes_of(v, rotations) for v in (x[2000:], partners(x[2000:], cosine, rng)))
        meet = (itq_dedup.keys_of(a, plan) == itq_dedup.keys_of(b, plan)).any(axis=1)
        near = np.bitwise_count((a[:, 0] ^ b[:, 0]).view(np.uint64)) <= plan.most_bits
        assert (meet & near).mean() >= 0.97


def test_links_of_64_dimensions(spark):
    rng = np.random.default_rng(9)
    x = itq_dedup.unit(rng.standard_normal((1200, 64)))
    rows = np.vstack([x, *[partners(x[k * 300 : (k + 1) * 300], c, rng) for k, c in enumerate((0.9001, 0.91, 0.93, 0.95))], partners(x[:300], 0.899, rng)])
    got = {r["vec_id"]: r["n_links"] for r in itq_dedup.near_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(rows)], "double")).collect()}
    near = rows @ rows.T >= 0.9
    want = near.sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * want.sum() > 2000


def test_plans_grow_with_the_table_alone():
    plans = [itq_dedup.plan_for(n) for n in (1, 10**5, 10**7, 10**9)]
    assert [p.sub for p in plans] == [10, 10, 15, 21] and all(a.tables <= b.tables for a, b in zip(plans, plans[1:], strict=False))
    assert not itq_dedup.plan_for(100, 0.9, 0.95).centred and itq_dedup.plan_for(100, 1.0).tables == 1


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(itq_dedup, "BLOCK", 16)
    rows = cloud(600) + ODD
    got = itq_dedup.near_vectors(vectors(spark, rows)).collect()
    links, comps = brute_links(rows)
    assert len(got) == len(rows)
    copies = collections.Counter(i for i, _ in rows)
    found = sum(r["n_links"] for r in got)
    true = sum(n * 1 for n in links.values())
    assert 0.95 * true <= found <= true
    for r in got:
        i = r["vec_id"]
        assert r["n_links"] <= links[i] / max(1, copies[i]) + 1e-9
        if i not in comps:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    right = sum(r["component_id"] == comps.get(r["vec_id"], r["vec_id"]) for r in got)
    assert right >= 0.98 * len(rows)
    assert itq_dedup.near_vectors(vectors(spark, [])).count() == 0
    assert itq_dedup.near_vectors(vectors(spark, ODD[:5])).count() == 5


@pytest.mark.parametrize("cells", [3, 16, 256])
def test_top_k(spark, cells):
    rows = cloud(230) + ODD
    got = collections.defaultdict(list)
    for r in vector_search.top_k(vectors(spark, rows, "double"), candidates=40, queries=3, cells=cells).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {i: v for i, v in good if i % 50 == 0}
    want = {}
    for q, a in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:5]
        want[q] = [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert dict(got) == want
    assert vector_search.top_k(vectors(spark, [])).count() == 0
    few = vector_search.top_k(vectors(spark, [(0, [1.0]), (50, [1.0])])).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(0, 1, 50), (50, 1, 0)]


def test_few_exact_vectors_are_read(spark, monkeypatch):
    sizes, keep = {}, vector_search.materialize
    monkeypatch.setattr(vector_search, "materialize", lambda df, what: sizes.setdefault(what, keep(df, what)))
    rows = cloud(3000, 64)
    vector_search.top_k(vectors(spark, rows), candidates=500).count()
    assert sizes["approximation"].columns == ["row", "vec_id", "codes"] and sizes["approximation"].selectExpr("max(length(codes))").first()[0] == 64
    assert sizes["candidates"].count() < 60 * 3000 / 20


def test_bounds_hold(spark):
    rng = np.random.default_rng(1)
    exact, queries = rng.integers(-900, 700, (200, 30)).astype(float), rng.integers(-900, 700, (20, 30)).astype(float)
    for cells in (2, 7, 256):
        grid = vector_search.Grid(exact.min(axis=0).astype(int).tolist(), exact.max(axis=0).astype(int).tolist(), cells)
        scores, off = grid.bounds(grid.codes(exact), queries)
        assert (np.abs(scores - queries @ exact.T) <= off[:, None]).all()


def test_repeated_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(2000)] + [(50, [1.0, 0.5])] * 20 + [(3000, [1.0, 0.49])] * 9
    got = collections.defaultdict(list)
    for r in vector_search.top_k(vectors(spark, rows), candidates=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == got[3000] == [0, 1, 2, 3, 4] and len(got) == 41


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60, -1, -1)]
    got = vector_search.top_k(vectors(spark, rows), candidates=7, every=60).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_large_buckets_deal_few_rows(spark):
    rows = spark.range(50_000).selectExpr("7L AS key", "id", "1L AS comp").union(spark.sql("SELECT 7L, 50000L, 2L"))
    dealt = shared.cells_across(rows, "key", "id", "comp", 512)
    assert dealt.count() <= 50_000 + 2 + 50_001 // 512 + 1
    assert dealt.groupBy("cell").count().selectExpr("max(count)").first()[0] <= 4 * 512
    assert shared.cells_across(rows.where("comp = 1"), "key", "id", "comp", 512).count() == 0


def test_all_pairs_across_groups_meet(spark):
    r = random.Random(4)
    rows = [(k, 100 * k + i, r.choice([1, 1, 1, 2, 3])) for k, n in enumerate((3, 9, 40)) for i in range(n)]
    dealt = shared.cells_across(spark.createDataFrame(rows, "key long, id long, comp long"), "key", "id", "comp", 8).orderBy("cell").toPandas()
    met = set()
    for i, j in shared.meeting(dealt["cell"].astype("category").cat.codes.to_numpy(), dealt["side"].to_numpy(), dealt["alone"].to_numpy()):
        met |= {frozenset(p) for p in zip(dealt["id"].to_numpy()[i].tolist(), dealt["id"].to_numpy()[j].tolist(), strict=True)}
    want = {frozenset((a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
    assert want <= met


# pipeline


def test_pipeline(spark, odd_documents, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = "/root/testdata/sf0.01"
    docs, seen = spark.read.parquet(f"{source}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, source)
        out.write.parquet(str(tmp_path / str(k)))
        was, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen.append(name)
        if name in ("toxicity", "near_duplicates"):
            assert docs.join(was, docs.columns).count() == docs.count() < was.count()
        if name == "secrets":
            assert docs.count() == was.count() and docs.exceptAll(was).count() > 0
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == was.columns
    assert seen == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert docs.where("n_units > 0 AND batch_id IS NULL").count() == 0 and docs.count() > 0
    # The result holds the redacted, mixed corpus: pieces of a row, joined in order, are the texts that went in.
    rebuilt = docs.groupBy("doc_id", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece", "text")))["text"], "").alias("text"))
    mixed = was.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert rebuilt.select("doc_id", "text").exceptAll(mixed).isEmpty() and rebuilt.count() == mixed.count()


def test_stages_take_odd_documents(spark, odd_documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns
    once = pipeline.drop_near_duplicates(spark, odd_documents, "")
    # 5 copies 4, 8 and 9 copy 7, as do its repeated row and the one without id; 11 copies 10.
    assert collections.Counter(r["doc_id"] for r in once.collect()) == collections.Counter([1, 2, 3, 4, 6, 7, 10, 12, 13, 14, 15])
    clash = spark.createDataFrame([(1, "a b c d e f g h"), (1, "quite other words in this one here"), (2, "a b c d e f g h"), (None, "lone words of a row without id")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in pipeline.drop_near_duplicates(spark, clash, "").collect()) in ([(0, "l"), (1, "a"), (1, "q")], [(0, "l"), (1, "q"), (2, "a")])
