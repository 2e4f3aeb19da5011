"""Token counts without token ids: pieces are counted once per distinct pre-token of a task and summed over its occurrences.

A pre-token is a run of spaces with the run of other characters after it. The model never merges across its start: no
piece of the vocabulary has a space mark behind another character (checked when the model is loaded). So the number of
pieces of a text is the sum over its pre-tokens. Every task holds one table of pre-token -> pieces, in which
each occurrence is looked up; only pre-tokens it lacks reach the library. No frequency per document is formed, and no join of
all documents' pre-tokens through a shuffle is made (see README).

Edge cases. A null text is empty (0 tokens). Repeated rows are counted each. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import ship, table, text_of
from vulnlake.llm.registry import query

MARK = "▁"  # how the model writes a space
LIMIT = 4096
#: Bound on a task's table; a full table is emptied and filled anew, which costs time but changes no result.
TABLE_ENTRIES = 1_500_000
#: Longer pre-tokens are counted directly and not kept.
LONG = 64


class Pieces:
    """Pieces per pre-token, counted on first sight."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        vocabulary = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(MARK in v.lstrip(MARK) for v in vocabulary)
        # With a dummy prefix, "x" reads as " x": pre-tokens are passed on without their first space.
        self.prefixed = self.model.encode("a", out_type=str)[:1] != ["a"]
        self.table: dict[str, int] = self.empty()

    def empty(self) -> dict[str, int]:
        """Only the last space of a text makes an empty unit."""
        return {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}

    def count(self, texts: list[str]) -> np.ndarray:
        if not (self.splits and self.prefixed):  # a model of another kind: no shorter unit than the text
            return np.array([len(x) for x in self.model.encode(texts, num_threads=1)], dtype=np.int64)
        units = [split(x) for x in texts]
        wanted = {u for x in units for u in x}
        if len(self.table) + len(wanted) > TABLE_ENTRIES:
            self.table = self.empty()
        known = self.table
        new = [u for u in wanted if u not in known]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        out = np.fromiter((sum(map(known.__getitem__, x)) for x in units), dtype=np.int64, count=len(units))
        for u in [u for u in new if len(u) > LONG]:
            del known[u]
        return out


def split(text: str) -> list[str]:
    """Pre-tokens without their first space; the first one's space is the model's own prefix."""
    if not text:
        return []
    text = text.replace(MARK, " ")  # the model reads them alike
    if "  " not in text and " " not in (text[0], text[-1]):
        return text.split(" ")
    # In a run of spaces, all but the first stand before the word, or alone at the end, in the unit that the first one opens.
    return [x[1:] for x in re.findall(r" *[^ ]+| +$", " " + text)]


def token_counts(docs: DataFrame, model_file: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file)
        for b in batches:
            n = pieces.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = text_of(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


ship(__name__)
