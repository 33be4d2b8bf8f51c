"""Operator 4: chat formatting at token level.

A turn becomes [mark of its role] [tokens of its escaped text] [end mark]; a role without a mark of its own is
written as [other] [tokens of the escaped role] [text mark] .... Segments are encoded separately and the marks
are reserved ids above the vocabulary, so no text can form a mark. As text, too, the form is reversible:
backslashes in a text are doubled and a backslash goes into every control string after its first character.
The loss mask is a prefix sum of +1 where assistant text begins and -1 where it ends; marks are
outside of it.

Turns are encoded in parallel, then sorted by (conversation, turn, role, tokens) and read as a stream that keeps one
conversation's counters, so a conversation of any length takes bounded memory; its digests are sequential by
nature. Null roles and texts are empty strings; null turns come first; rows of a null conversation id form one
conversation; repeated rows and ties are turns of their own. An empty table gives no rows.
Vocabulary and pattern are parameters; every machine reads the file at the given path.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Pre-tokenisation pattern that belongs to the vocabulary above.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS = ("<|system|>", "<|user|>", "<|assistant|>", "<|other|>", "<|text|>", "<|end|>")
ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, TEXT, END = 3, 4, 5
# Control strings of this and of other common templates; each starts with one of its kind's brackets.
CONTROL = MARKS + ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def assemble(role: str, text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn: segments spliced with reserved ids, mask by prefix sum."""
    coder, reserved = encoding(path, pattern)
    body = coder.encode_ordinary(escape(text))
    if role in ROLES:
        head = [reserved + ROLES[role]]
    else:
        head = [reserved + OTHER, *coder.encode_ordinary(escape(role)), reserved + TEXT]
    ids = np.array([*head, *body, reserved + END], np.int32)
    step = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        step[len(head)] += 1
        step[len(head) + len(body)] -= 1
    return ids, np.cumsum(step)[:-1].astype(np.int8)


def read_back(ids: np.ndarray, mask: np.ndarray, path: str, pattern: str) -> tuple[str, str, str, str]:
    """(role, text, text under the loss mask, formatted text) of the tokens of one turn."""
    coder, reserved = encoding(path, pattern)
    text_of = lambda part: coder.decode_bytes(part.tolist()).decode("utf-8")
    cuts = np.flatnonzero(ids >= reserved)
    pieces = [text_of(ids[a + 1 : b]) for a, b in zip(cuts[:-1], cuts[1:])]
    marks = [MARKS[i - reserved] for i in ids[cuts]]
    formatted = "".join(m + p for m, p in zip(marks, [*pieces, ""]))
    first = int(ids[0]) - reserved
    role = unescape(pieces[0]) if first == OTHER else next(r for r, k in ROLES.items() if k == first)
    return role, unescape(pieces[-1]), unescape(text_of(ids[mask > 0])), formatted


def _encode(path: str, pattern: str):
    def run(batches):
        for batch in batches:
            ids, masks = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                i, m = assemble(role, text, path, pattern)
                ids.append(i.tobytes())
                masks.append(m.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role")), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())],
                names=["conv_id", "turn", "role", "ids", "mask"],
            )

    return run


def formatted_turns(table: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """conv_id, turn, role, ids (packed int32), mask (packed int8) per turn, each partition holding
    whole conversations in order."""
    turns = table.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    coded = turns.mapInArrow(_encode(path, pattern), "conv_id long, turn long, role string, ids binary, mask binary")
    return coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def _digests(path: str, pattern: str):
    """Reads sorted turns as a stream; a row is given out when its conversation ends."""

    def fresh():
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]

    def rows(done):
        columns = list(zip(*[(c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]) for c, s in done]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = [part.split()[0] for part in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        current, state, any_row = None, fresh(), False
        for batch in batches:
            done = []
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))):
                if any_row and conv != current:
                    done.append((current, state))
                    state = fresh()
                current, any_row = conv, True
                ids, mask = np.frombuffer(ids, np.int32), np.frombuffer(mask, np.int8)
                role, text, loss, formatted = read_back(ids, mask, path, pattern)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
                state[5] += len(ids)
                state[6] += int(mask.sum())
            if done:
                yield rows(done)
        if any_row:
            yield rows([(current, state)])

    return run


def op4_chat_format(spark: SparkSession, sf_dir: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    table = given.union(spark.createDataFrame(PROBE, given.schema))
    rows = formatted_turns(table, path=path, pattern=pattern).mapInArrow(_digests(path, pattern), DIGEST)
    return rows.drop("n_tokens", "loss_tokens")


QUERIES = {"op4_chat_format": op4_chat_format}
_ESCAPED = "length(regexp_replace({0}, '" + r"\\" + "', 'xx', 'g')) + len(regexp_extract_all({0}, '" + "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)) + "'))"
ORACLES = {
    "op4_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_ESCAPED.format("text")} + {len(MARKS[END])} + CASE {" ".join(f"WHEN role = '{r}' THEN {len(MARKS[k])}" for r, k in ROLES.items())}
                ELSE {len(MARKS[OTHER]) + len(MARKS[TEXT])} + {_ESCAPED.format("role")} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
