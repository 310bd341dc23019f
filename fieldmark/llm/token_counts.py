"""Tokens per document without materialising ids.

The pre-token frequencies of each document are joined, inside its worker, to a table in
which the pieces of each distinct pre-token were counted once, and the products are summed.
The join stays in the worker: a shuffled join of the documents' frequencies would move
several times the input.  Pre-tokens here are units (a word with the white space before
it, punctuation behind it apart), which no merge of a byte-level BPE with this pattern crosses and which keep special
strings whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import texts
from fieldmark.llm.units import MAX_UNITS, UnitTable, cuts_of, tokenizer
from fieldmark.llm.words import Block, blocks

_TABLES: dict[tuple, UnitTable] = {}


def _table(path: str, max_units: int) -> UnitTable:
    """The worker's table; it lasts from task to task."""
    if (path, max_units) not in _TABLES:
        tok = tokenizer(path)
        # a byte-level piece has a character for each of its bytes
        n_bytes = np.zeros(tok.get_vocab_size(), np.int64)
        for piece, i in tok.get_vocab().items():
            n_bytes[i] = len(piece)

        def encode(units: list[str]) -> Iterator[list[int]]:
            # a space and letters are a pre-token anywhere: many go in one call and are
            # told apart by their bytes
            found: dict[str, np.ndarray] = {}
            plain = [u for u in units if u[0] == " " and u[1:].isalpha()]
            chunks = [plain[i:i + 256] for i in range(0, len(plain), 256)]
            for chunk, e in zip(chunks, tok.encode_batch_fast(
                    ["".join(c) for c in chunks], add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                bytes_to = np.cumsum(n_bytes[ids])
                wanted = np.cumsum([len(u.encode()) for u in chunk])
                cuts = np.searchsorted(bytes_to, wanted)
                if cuts[-1] < len(ids) and (bytes_to[cuts] == wanted).all():
                    found.update(zip(chunk, np.split(ids, cuts[:-1] + 1)))
            rest = [u for u in units if u not in found]
            found.update(zip(rest, (e.ids for e in tok.encode_batch_fast(
                rest, add_special_tokens=False))))
            return map(found.__getitem__, units)

        _TABLES[path, max_units] = UnitTable(encode, max_units)
    return _TABLES[path, max_units]


def _wide_space_ends(block: Block, end: np.ndarray) -> np.ndarray:
    """Whether a unit's last character is white space beyond ASCII: the pattern then looks
    at the next unit's white space as well."""
    def byte(back: int) -> np.ndarray:
        return block.data[np.maximum(end - back, 0)]

    last, second, third = byte(1), byte(2), byte(3)
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    e280 = (third == 0xE2) & (second == 0x80) & (
        ((last >= 0x80) & (last <= 0x8A)) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    rest = ((third == 0xE1) & (second == 0x9A) & (last == 0x80)) | \
        ((third == 0xE2) & (second == 0x81) & (last == 0x9F)) | \
        ((third == 0xE3) & (second == 0x80) & (last == 0x80))
    return two | e280 | rest


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 512,
                 max_units: int = MAX_UNITS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    ``vocab_path`` is a tokenizers .json every executor can open.  Counts are those of the
    library for the whole text, no special tokens added; special strings in a text count as
    the library's default has it.  A null or empty text has 0 tokens, repeated rows
    are counted each, a null doc_id stays null, an empty table gives an empty result."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tok = _table(vocab_path, max_units), tokenizer(vocab_path)
        cuts = cuts_of(tok)
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            for block in blocks(batch.column("text"), cuts):
                start, end, doc = block.units()
                at = table.find(block, start, end, block.hashes(start, end))
                # frequencies of the units of each document
                n = table.index.n
                pairs, times = np.unique(doc * n + at, return_counts=True)
                own = np.bincount(pairs // n, times * table.sizes[pairs % n], block.texts) \
                    if n else np.zeros(block.texts)
                own = own.astype(np.int64)
                for i in np.unique(doc[_wide_space_ends(block, end)]):
                    own[i] = len(tok.encode(block.text(i), add_special_tokens=False).ids)
                totals[block.first:block.first + block.texts] = own
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals)],
                ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
