"""Token counts of whole texts: pre-tokens that are proven to be one token are counted, only the rest is merged."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: How byte-level BPE vocabularies of this family cut a text before merging (fixed by the vocabulary).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENS = regex.compile(PRE_TOKEN).findall
#: Merged parts that a process remembers; beyond that it forgets and merges again.
REMEMBERED = 300_000
#: Characters of the longest part that is remembered.
LONGEST = 64
#: A blank that another white-space character follows, or the text's end.
UNEVEN = regex.compile(r" (?:\s|$)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes, alone, as exactly their own token.

    The proof is run once, on the driver; the result has at most as many strings as the vocabulary.
    """
    symbols = bytes_of_symbols()
    special = set(tokenizer.get_added_tokens_decoder())
    strings = {}
    for token, number in tokenizer.get_vocab().items():
        if number in special:
            continue
        try:
            text = bytes(symbols[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if PRE_TOKENS(text) == [text]:
            strings[text] = number
    texts, proven = list(strings), set()
    for at in range(0, len(texts), 1000):  # encodings are large objects
        part = texts[at : at + 1000]
        proven |= {t for t, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True) if e.ids == [strings[t]]}
    return frozenset(proven)


def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes and id of every token that merging can give, and the added tokens.

    Merging by ids gives what the file's merge list gives if the list has the ids in ascending order, which is proven
    here; a vocabulary for which it doesn't hold is refused.
    """
    with open(vocabulary_path(vocabulary), encoding="utf-8") as file:
        found = json.load(file)
    symbols, vocab = bytes_of_symbols(), found["model"]["vocab"]
    added = {t["content"]: t["id"] for t in found["added_tokens"]}
    ranks = {bytes(symbols[c] for c in token): number for token, number in vocab.items() if token not in added}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in found["model"]["merges"]]
    if merged != sorted(merged) or {*merged, *(ranks[bytes([b])] for b in range(256))} != set(ranks.values()):
        raise ValueError(f"{vocabulary}: the merges are not in the order of the ids")
    return ranks, added


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """A merger of whole texts by the vocabulary, once per process."""
    import tiktoken

    ranks, added = ranks_of(vocabulary)
    return tiktoken.Encoding(vocabulary, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=added)


class Counter:
    """Counts the tokens of a text. Added tokens (such as an end-of-text string) inside a text count one each.

    A blank before a visible character begins a pre-token, whatever stands before it. So a text is cut at its blanks, and
    a part is counted with the blank before it: one token if that is proven, else as many as merging gives, which the process
    remembers. Texts with a blank before more white space are cut into pre-tokens one by one.
    """

    def __init__(self, vocabulary: str, whole: frozenset[str]) -> None:
        self.merger, self.whole = encoding(vocabulary), whole
        added = sorted(self.merger.special_tokens_set, key=len, reverse=True)
        self.added = "|".join(map(re.escape, added))
        self.cut = regex.compile("|".join(map(regex.escape, added))).split if added else lambda text: [text]
        self.after_blank = {t[1:]: 1 for t in whole if t[0] == " " and t[1:].strip()}
        self.known = dict(self.after_blank)

    def size(self, text: str) -> int:
        return 1 if text in self.whole else len(self.merger.encode_ordinary(text))

    def count(self, text: str) -> int:
        parts = self.cut(text)
        return len(parts) - 1 + sum(map(self.count_part, parts))

    def count_part(self, text: str) -> int:
        if UNEVEN.search(text):
            return sum(map(self.size, PRE_TOKENS(text)))
        if len(self.known) > REMEMBERED:
            self.known = dict(self.after_blank)
        head, *parts = text.split(" ")
        sizes = list(map(self.known.get, parts))
        if None in sizes:
            merged = self.merger.encode_ordinary
            new = {p: len(merged(" " + p)) for p in {p for p, n in zip(parts, sizes) if n is None}}  # noqa: B905
            sizes = [new[p] if n is None else n for p, n in zip(parts, sizes)]  # noqa: B905
            self.known.update(new if max(map(len, new)) <= LONGEST else {p: n for p, n in new.items() if len(p) <= LONGEST})
        return self.size(head) + sum(sizes)


    def token_bytes(self, text: str) -> list[int]:
        """Number of bytes of each token of a text, in order; an added token is one."""
        added = re.findall(self.added, text) if self.added else []
        out: list[int] = []
        for i, part in enumerate(self.cut(text)):
            if i:
                out.append(len(added[i - 1].encode()))
            out += map(len, self.merger.decode_tokens_bytes(self.merger.encode_ordinary(part)))
        return out


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str, whole: frozenset[str]) -> Counter:
    """One for each worker process, so that its tasks share what was merged."""
    return Counter(vocabulary, whole)


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit for every row; nulls count as empty texts, other columns are dropped.

    Counts are those of the tokenizers library without begin, end or added special tokens. One narrow pass, no shuffle;
    a process holds one Arrow batch and a bounded memory of merged parts.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(proven_whole_tokens(Tokenizer.from_file(vocabulary_path(vocabulary))))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, whole.value).count
        for batch in batches:
            texts = batch.column("__text")
            n = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"))
