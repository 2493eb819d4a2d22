"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split where no piece can reach across: at a single space between
two characters that are neither a space nor the piece marker. No piece of the
vocabulary has the marker after another character (checked when it loads), so a
text's count is the sum over its segments, each encoded with the space that the
encoder puts before it. Segments of a batch of bounded bytes are encoded
together, each distinct one once; counts of short segments are kept in a cache that
is bounded in number and bytes. A segment without a safe space is encoded whole.

Cases: a null text counts as empty, with no bytes and no tokens; repeated rows
give repeated rows; only the two named columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import common

#: Most segments whose counts a worker keeps, then it starts anew; and their greatest length in characters.
CACHE_SEGMENTS, CACHE_CHARS = 250_000, 64
#: Marker of a space inside pieces. A fixed value of the library.
MARKER = "▁"
#: A space at which segments part when the text holds runs of spaces or markers.
SAFE_SPACE = re.compile(f"(?<=[^ {MARKER}]) (?=[^ {MARKER}])")


class Counter:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        #: Whether segments may be encoded apart with this model.
        self.separable = not any(MARKER in p.lstrip(MARKER) for p in pieces)
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        if not self.separable:
            return [text]
        if "  " in text or MARKER in text or text[:1] == " " or text[-1:] == " ":
            return SAFE_SPACE.split(text)
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.segments(t) for t in texts]
        if len(self.known) > CACHE_SEGMENTS:
            self.known.clear()
        new = [*{s for p in parts for s in p}.difference(self.known)]
        counted = dict(zip(new, map(len, self.model.encode(new, num_threads=1)))) if new else {}
        self.known.update((s, n) for s, n in counted.items() if len(s) <= CACHE_CHARS)
        # What is longer, as texts without spaces are, is counted for these texts alone.
        rest = {s: n for s, n in counted.items() if len(s) > CACHE_CHARS}
        get = self.known.get
        return [sum(rest[s] if (n := get(s)) is None else n for s in p) for p in parts]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row."""
    path = path or default_path()

    def run(batches):
        model = counter(path)
        for part in common.rows(batches):
            texts = part.column(0).fill_null("")
            n = model.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kept = df.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"))
    return common.map_arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
