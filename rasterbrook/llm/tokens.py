"""Token counts: huge texts are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: A byte-level pre-tokenizer always splits between a visible character and the white space after
#: it: no pattern of it, and no special string, spans that border from the left. What follows then
#: depends on the text to the right alone, so an encoding that starts anywhere is in step there.
STABLE = re.compile(r"[!-~\w](?=[ \n])")
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def encoder(name: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The ids of a text as the .json vocabulary's library gives them, and each id's bytes.

    The rank file of the same vocabulary gives the same ids several times faster. Texts that its
    pattern engine refuses (white space in the millions) go to the library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    at = lambda x: x if os.path.isabs(x) else public_tokenizers.path(x)
    with open(at(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)}
    )
    slow = Tokenizer.from_file(at(f"{name}.json"))
    slow.no_truncation()
    slow.no_padding()
    lengths = np.zeros(len(ranks) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    lengths[-1] = len(SPECIAL)

    def ids(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # the engine's panic isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return ids, lengths


def spliced_count(ids: Callable[[str], list[int]], lengths: np.ndarray, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text by chunks of that many characters, each with an overlap into the next."""
    n, start, first, total = len(text), 0, 0, 0  # first: where the counted part of the chunk begins
    size = lambda a, b: len(text[a:b].encode())
    while True:
        core, wide = start + chunk, overlap
        while True:
            end = min(n, core + wide)
            ends = np.cumsum(lengths[ids(text[start:end])])
            before = np.searchsorted(ends, size(start, first), "right")
            if end == n:
                return total + len(ends) - int(before)
            cut = _agreed(ids, lengths, text, start, core, end, ends)
            if cut:
                break
            wide *= 2  # no stable border in common: take more text into the overlap
        total += int(np.searchsorted(ends, size(start, cut), "right") - before)
        start, first = core, cut


def _agreed(ids, lengths, text: str, start: int, core: int, end: int, ends: np.ndarray) -> int:
    """A stable border in the overlap at which this chunk and one that starts at core both split; 0: none."""
    other, shift = set(np.cumsum(lengths[ids(text[core:end])]).tolist()), len(text[start:core].encode())
    own = set(ends.tolist())
    for m in STABLE.finditer(text, core, end - 1):
        at = len(text[core : m.end()].encode())
        if at in other and shift + at in own:
            return m.end()
    return 0


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k", limit: int = 512, chunk: int = 16384, overlap: int = 256
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of docs (doc_id, text).

    tokenizer: a byte-level vocabulary (name.json and name.tiktoken, by name or path) that every
    executor has. Texts of up to chunk characters are encoded whole; longer ones in chunks that
    overlap. Null text: empty, 0 tokens. Other columns are ignored; repeated rows stay repeated.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = encoder(tokenizer)
        for b in pieces(batches, "text"):
            texts = (x.as_py() for x in b.column("text"))
            n = [len(ids(x)) if len(x) <= chunk else spliced_count(ids, lengths, x, chunk, overlap) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
