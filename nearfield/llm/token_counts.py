"""Token counts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded at once. A longer one is encoded in overlapping chunks; neighbours
are spliced where both have a token boundary that is proven stable, and the overlap is widened where there is none.

Proof of stability. The pre-tokenizer's pattern reads from left to right without looking back, and no alternative (nor
the special token) can match a non-space character followed by a space, so a place between a visible character and
white space ends a pre-token in every context. Merges never cross pre-tokens. Hence the tokens before such a place are
those of the whole text if the chunk's own start is one, and the tokens after it depend on nothing before it.

Nulls count as empty (0 tokens); rows are kept one for one, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Characters whose classes are alike in both libraries' Unicode tables; a text with any other goes to the slower one.
KNOWN = re.compile("[\t\n\r\x20-\x7e -ȳΑ-ΡΣ-ωА-я‐-‧‰-›€ぁ-ゖァ-ヺ一-龥가-힣]*")
STABLE = re.compile("(?<=[!-~¡-ȳΑ-ωА-яぁ-ゖァ-ヺ一-龥가-힣])(?=[ \n\t\r])")


class Encoder:
    """Ids of a string, from the merge ranks where they are sure to agree with the tokenizer file, else from the file."""

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.no_truncation()
        self.slow.no_padding()
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.length = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for piece, i in ranks.items():
            self.length[i] = len(piece)
        for piece, i in special.items():
            self.length[i] = len(piece.encode())

    def ids(self, text: str):
        if KNOWN.fullmatch(text):
            return self.fast.encode(text, allowed_special=self.special, disallowed_special=())
        return self.slow.encode(text, add_special_tokens=False).ids

    def ends(self, text: str) -> np.ndarray:
        """The offsets, in UTF-8 bytes, at which the text's tokens end."""
        return np.cumsum(self.length[np.asarray(self.ids(text), np.int64)])


@lru_cache(4)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def tokens_before(ends: np.ndarray, chunk: str, place: int) -> int | None:
    """How many tokens end at or before this character of the chunk; None if it is inside a token."""
    at = len(chunk[:place].encode())
    n = int(np.searchsorted(ends, at, "right"))
    return n if at == 0 or (n and ends[n - 1] == at) else None


def count(enc: Encoder, text: str, chunk_chars: int, overlap_chars: int) -> int:
    if len(text) <= chunk_chars:
        return len(enc.ids(text))
    total, start, size = 0, 0, chunk_chars  # start: the stable place that this chunk's tokens count from
    begin, behind = 0, 0  # the chunk's first character; its tokens before start
    end = min(len(text), begin + size)
    chunk = text[begin:end]
    ends = enc.ends(chunk)
    while end < len(text):
        overlap, spliced = overlap_chars, None
        while spliced is None and overlap < 2 * (end - start):
            low = max(start, end - overlap)
            places = [m.start() for m in STABLE.finditer(text, low + 1, end) if m.start() < end]
            if places:
                nxt_end = min(len(text), low + size)
                nxt = text[low:nxt_end] if nxt_end > end else text[low : (nxt_end := min(len(text), end + size))]
                nxt_ends = enc.ends(nxt)
                for place in sorted(places, key=lambda p: abs(p - (low + end) // 2)):
                    left, right = tokens_before(ends, chunk, place - begin), tokens_before(nxt_ends, nxt, place - low)
                    if left is not None and right is not None:
                        spliced = (place, left, right, low, nxt_end, nxt, nxt_ends)
                        break
            overlap *= 2
        if spliced:
            place, left, right, begin, end, chunk, ends = spliced[0], spliced[1], spliced[2], *spliced[3:]
            total, start, behind = total + left - behind, place, right
        else:  # one unbroken run: a longer chunk from the same place
            size *= 2
            begin, behind, end = start, 0, min(len(text), start + size)
            chunk = text[begin:end]
            ends = enc.ends(chunk)
            continue
        size = chunk_chars
    return total + len(ends) - behind


def count_tokens(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16384, overlap_chars: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens for each row. No shuffle; a task holds one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path, ranks_path)
        for b in batches:
            n = [count(enc, t, chunk_chars, overlap_chars) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    slim = docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return slim.mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long")
