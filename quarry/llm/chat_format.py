"""Chat formatting with offset-aligned loss masks: render whole conversations, encode once, intersect spans by binary search."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .token_counts import VOCABULARY, encoding, ranks_of

#: Marks the begin of a role, of a text and of the end; the vocabulary's own added token, so no token crosses a mark.
MARK = "<|endoftext|>"
LEARNED = "assistant"
#: Conversations of one output batch.
BATCH = 256
#: What texts may not say in clear: <|...|>, <s>, </s>, [INST], [/INST]; a backslash after the bracket escapes, and one more each time.
CONTROL = regex.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
ESCAPED = regex.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted conversation and the ascending flat list of begin and end of each assistant text."""
    out, at, spans = [], 0, []
    for role, text in turns:
        safe = escape(text)
        head = f"{MARK}{escape(role)}{MARK}"
        out += [head, safe]
        at += len(head)
        if role == LEARNED and safe:
            spans += [at, at + len(safe)]
        at += len(safe)
    return "".join([*out, MARK]), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    parts = [unescape(p) for p in formatted.split(MARK)[1:-1]]
    return list(zip(parts[::2], parts[1::2], strict=True))


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that share characters with a span. Starts, ends and spans ascend: two binary searches a span."""
    first = np.searchsorted(ends, spans[0::2], side="right")
    last = np.searchsorted(starts, spans[1::2], side="left")
    edge = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.maximum(first, last), -1)
    return np.cumsum(edge[:-1]) > 0


def masked_parts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The runs of text under the mask; tokens that hold parts of one character overlap and are merged."""
    runs: list[list[int]] = []
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return [formatted[a:b] for a, b in runs]


@functools.lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> np.ndarray:
    """Number of bytes of each token, by id."""
    ranks, added = ranks_of(vocabulary)
    out = np.zeros(max(*ranks.values(), *added.values()) + 1, dtype=np.int64)
    out[list(ranks.values())] = list(map(len, ranks))
    out[list(added.values())] = [len(t.encode()) for t in added]
    return out


def encode_with_offsets(text: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the whole text's tokens, marks included, and the code points where each begins and ends.

    Tokens' bytes are the text's, so the running sum of their lengths gives byte offsets; a byte belongs to the code
    point that began last. Tokens that hold parts of one character have its offsets each.
    """
    ids = encoding(vocabulary).encode_to_numpy(text, allowed_special="all").astype(np.int32)
    ends = np.cumsum(token_bytes(vocabulary)[ids])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = ends - token_bytes(vocabulary)[ids]
    return ids, point[starts].astype(np.int32), (point[ends - 1] + 1).astype(np.int32)


def conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>)`` by turn; ties by role, then text; null turns first; null role or text is empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.array([]), kind))


def format_chats(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Training examples of ``rows(conv_id, turn, role, text)``, one per conversation.

    Columns: conv_id, formatted, input_ids, token_start, token_end (code points of ``formatted``), loss_mask. Learned
    are the assistant's texts, no marks. A null conv_id is a conversation. Repeated rows are repeated turns. Other
    columns are dropped; an empty table gives no rows. A conversation is rendered whole, in one row.
    """
    schema = "formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"
    grouped = conversations(rows)
    kind = grouped.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                done = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
                encoded = [encode_with_offsets(text, vocabulary) for text, _ in done]
                masks = [mask_of(starts, ends, np.array(spans, dtype=np.int64)) for (_, starts, ends), (_, spans) in zip(encoded, done, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([t for t, _ in done], pa.string()), *(lists([e[k] for e in encoded], pa.int32()) for k in range(3)), lists(masks, pa.bool_())],
                    names=["conv_id", "formatted", "input_ids", "token_start", "token_end", "loss_mask"])

    return grouped.mapInArrow(run, f"conv_id {kind}, {schema}")


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns from the text, learned text from offsets and mask."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                formatted = b.column(1)[i].as_py()
                starts, ends, mask = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                turns, learned = parse(formatted), "".join(map(unescape, masked_parts(formatted, starts, ends, mask)))
                out.append((len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), hexed(learned), len(formatted), len(mask), int(mask.sum())))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])

    return chats.select("conv_id", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(run, schema)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, and conversation -1, whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digests(format_chats(rows.union(extra))).drop("n_tokens", "loss_tokens")


#: Every mark has 13 characters, and an escaped text one more for each control string.
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP7_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
  13 + sum(26 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS formatted FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM g
"""
