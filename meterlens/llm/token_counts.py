"""Token counts of whole texts, with huge documents encoded in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meterlens.llm.common import id_field, text_slices, texts_of, worker_state
from meterlens.llm.encoding import tokenizer_path


class ChunkedCounter:
    """Numbers of pieces that a sentencepiece BPE model gives for whole texts.

    A merge only ever makes a piece of the vocabulary. So where two neighbouring characters stand side by side in no
    piece, no merge crosses between them, whatever surrounds them: such a place is a stable boundary. Texts above
    `chunk` characters are encoded in chunks that overlap; two chunks are spliced at a stable boundary of the overlap at
    which both encodings begin a piece. Where there is none, the overlap is doubled, up to the end of the text.
    """

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 512):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.joined = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                self.joined.update(zip(piece, piece[1:]))

    def _stable(self, left: str, right: str) -> bool:
        return (left.replace(" ", "▁"), right.replace(" ", "▁")) not in self.joined

    def _begins(self, text: str, at: int) -> np.ndarray:
        """Places in the whole text where the pieces of `text`, which stands at `at`, begin (in characters)."""
        begins = np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        leads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return at + np.concatenate([[0], np.cumsum(leads)])[begins]

    def count(self, text: str) -> int:
        n = len(text)
        if n <= self.chunk:
            return len(self.model.encode(text))
        total = at = low = 0  # pieces before the boundary `at` are counted; the chunk in hand is text[low:high]
        high = self.chunk
        begins = self._begins(text[low:high], low)
        while high < n:
            overlap, splice = self.overlap, None
            while splice is None and high - overlap > at:
                left, right = high - overlap, min(n, high + self.chunk)
                after = self._begins(text[left:right], left)
                common = np.intersect1d(begins[begins > left], after)[::-1]
                splice = next((p for p in common.tolist() if p < high and self._stable(text[p - 1], text[p])), None)
                overlap *= 2
            if splice is None:  # no stable boundary since the last one: the chunk itself grows
                high = min(n, high + max(self.chunk, high - low))
                begins = self._begins(text[low:high], low)
            else:
                total += int(np.count_nonzero((begins >= at) & (begins < splice)))
                at, low, high, begins = splice, left, right, after
        return total + int(np.count_nonzero(begins >= at))

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk]
        known = iter([len(x) for x in self.model.encode(short, num_threads=1)] if short else [])
        return [next(known) if len(t) <= self.chunk else self.count(t) for t in texts]


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "piece_bpe_32k.model",
    limit: int = 4096,
    chunk: int = 32_768,
    overlap: int = 512,
) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether the tokens are more than `limit`: one row per row, nothing shuffled.

    Null texts count as empty: 0 bytes, 0 tokens. Null and repeated ids keep their rows; other columns aren't read.
    """
    state = worker_state(docs)
    out = T.StructType(
        [
            id_field(docs, id_col, "doc_id"),
            T.StructField("n_bytes", T.LongType(), False),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("over_limit", T.BooleanType(), False),
        ]
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = state.value
        if tokenizer not in kept:
            kept[tokenizer] = ChunkedCounter(tokenizer_path(tokenizer), chunk, overlap)
        for batch in text_slices(batches, text_col):
            tokens = np.array(kept[tokenizer].counts(texts_of(batch, text_col)), np.int64)
            size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), size, pa.array(tokens), pa.array(tokens > limit)], [f.name for f in out]
            )

    return docs.select(id_col, text_col).mapInArrow(count, out)
