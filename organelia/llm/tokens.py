"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from organelia.session import send_file, sent_file

#: Vocabulary file: a line per token, the base64 of its bytes and its rank. Operators take another as ``path``, queries as the
#: session's ``spark.organelia.tokenizer``; the driver reads it and sends it to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenization pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def tokenizer(path: str = TOKENIZER, sent: str | None = None) -> Callable[[str], list[int]]:
    """The encoder of a vocabulary file; loaded once in a worker. ``sent`` is the name under which the driver sent it."""
    import tiktoken

    with open(path if sent is None else sent_file(sent, path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def count_tokens(text: str | None, path: str = TOKENIZER) -> int | None:
    return None if text is None else len(tokenizer(path)(text))


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text as a column, over whole texts in Arrow batches; NULL gives NULL. Executors get the vocabulary from the driver."""
    sent = send_file(SparkSession.active(), path)

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = tokenizer(path, sent)
        for texts in batches:
            yield pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return run(text)
