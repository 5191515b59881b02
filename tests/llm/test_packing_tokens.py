"""Packing counts tokens, not words."""

import collections

from tokenizers import Tokenizer

from quarry.llm import packing, token_counts


def test_op1_packs_tokens(spark, tmp_path):
    texts = {1: "x" * 100_000, 2: "one two", 3: "", 4: None, 5: "Überraschung, naïveté! " * 900, 6: "\n\n  "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    rows = packing.op1_length_buckets(spark, str(tmp_path)).collect()
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_units"]
        assert r["start"] == r["piece"] * packing.MAX_LEN and r["n_units"] <= r["bucket_len"] <= packing.MAX_LEN
    assert {i: got[i] for i in texts} == want and want[1] > packing.MAX_LEN


def test_pieces_hold_the_text(spark):
    texts = ["x" * 100_000, "one two", "", None, "Überraschung, naïveté! \U0001f600\U0001f680" * 900, "<|endoftext|>" * 3000, "one two"]
    tokenizer = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    rows = spark.createDataFrame([(i // 2, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(3)
    got = collections.defaultdict(list)
    for r in packing.pack_texts(rows, max_len=100).orderBy("row", "piece").collect():
        got[r["doc_id"], r["row"]].append((r["piece"], r["start"], r["n_units"], r["text"]))
    assert sorted((d, "".join(p[3] for p in ps)) for (d, _), ps in got.items()) == sorted((i // 2, t or "") for i, t in enumerate(texts))
    for ps in got.values():
        text = "".join(p[3] for p in ps)
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert sum(p[2] for p in ps) == n and [p[:2] for p in ps] == [(k, 100 * k) for k in range(len(ps))] and all(p[2] == 100 for p in ps[:-1])
    assert packing.pack_texts(rows.limit(0)).count() == 0
