"""SentencePiece encoding and decoding over a model file's pieces and scores.

Encoding is the highest-scoring segmentation (the unigram rule): an Aho-Corasick automaton
over all pieces walks the text once, and at every position each piece that ends there
(the match and its output links) relaxes the best score.  Characters no piece covers fall
back to byte pieces.  A space is written as the model's space mark and one is put before
the text; pieces hold the mark only at their start, so the best segmentation of a text is
that of its units (space run and word), and each distinct unit is solved once per worker, its
word and punctuation apart if no piece joins them.

Decoding gives every text back exactly; a space mark in the text itself goes to byte pieces
for that.  For a BPE model file (its scores are merge ranks) the pieces can differ from the
library's merge order, but the library decodes them to the same text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.units import UnitTable
from fieldmark.llm.words import PUNCTUATION, blocks

MARK = "▁"
#: A character outside all pieces scores this much less than the lowest piece.
UNKNOWN_PENALTY = 10.0

#: Most units a worker remembers; beyond it its table starts anew (this changes the work,
#: not the results).
MAX_UNITS = 1_000_000
#: Rows decoded at once.
PART_ROWS = 500
_MODELS: dict[str, "Pieces"] = {}
_VOCABULARIES: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """The texts of a model file's pieces, which is all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n)
                         if model.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_ids.items()}
        self.bytes = [bytes([byte_of[i]]) if i in byte_of else
                      b"" if model.is_control(i) or model.is_unknown(i) else
                      model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Pieces(Vocabulary):
    """The automaton and both mappings of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from ahocorasick import Automaton

        super().__init__(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_pieces = set(self.byte_ids.values())
        self.automaton = Automaton()
        scores, white, joined = [], set(), set()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if i in byte_pieces or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            inner = piece.replace(MARK, " ").lstrip(" ")
            if " " in inner:
                raise ValueError("a piece holds a space after other characters")
            white.update(set(inner) & set("\t\n\v\f\r"))
            joined.update(b for a, b in zip(inner, inner[1:]) if a.isalnum())
            scores.append(model.get_score(i))
            self.automaton.add_word(piece.replace(MARK, " "), (len(piece), scores[-1], i))
        self.automaton.make_automaton()
        self.unknown = min(scores) - UNKNOWN_PENALTY
        #: White space that pieces hold: a text with it is solved as a whole.
        self.white = re.compile(f"[{''.join(sorted(white))}]".encode()) if white else None
        #: Punctuation that no piece holds behind a letter or digit.
        self.cuts = "".join(c for c in PUNCTUATION if c not in joined)
        self.table = UnitTable(self.encode_units, MAX_UNITS)

    def best(self, unit: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation; of equal ones, the first met (longer
        last piece first)."""
        n = len(unit)
        score, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        done = 0

        def fall_back(to: int, done: int) -> int:
            while done < to:
                if score[done] + self.unknown > score[done + 1]:
                    score[done + 1], back[done + 1] = score[done] + self.unknown, (1, None)
                done += 1
            return done

        for end, (size, value, i) in self.automaton.iter(unit):
            done = fall_back(end, done)
            if score[end + 1 - size] + value > score[end + 1]:
                score[end + 1], back[end + 1] = score[end + 1 - size] + value, (size, i)
        fall_back(n, done)
        ids, at = [], n
        while at:
            size, i = back[at]
            ids += [i] if i is not None else [
                self.byte_ids[b] for b in reversed(unit[at - 1].encode())]
            at -= size
        return ids[::-1], score[n]

    def encode_units(self, units: list[str]) -> Iterator[list[int]]:
        return (self.best(u)[0] for u in units)


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of ``text_col``, other columns kept.  A null
    or empty text has no ids; rows are encoded each for itself."""
    keep = [f for f in docs.schema.fields if f.name not in (text_col, "ids")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] +
                       ["ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for block in blocks(batch.column(text_col), m.cuts):
                start, end, doc = block.units()
                at = m.table.find(block, start, end, block.hashes(start, end))
                own, before = m.table.ids(at)
                to = before[np.searchsorted(doc, np.arange(block.texts), "right")]
                size = np.diff(to, prepend=0)
                if m.white and m.white.search(block.data):
                    each = np.split(own, to[:-1])
                    for i in range(block.texts):
                        if m.white.search(text := block.text(i).encode()):
                            each[i] = np.array(m.best(text.decode())[0], np.int32)
                            size[i] = len(each[i])
                    own = np.concatenate(each)
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).slice(block.first, block.texts) for f in keep] + [lists],
                    [f.name for f in keep] + ["ids"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.when(text != "", F.concat(F.lit(" "), text)).otherwise("")
    return docs.select(*[f.name for f in keep], marked.alias(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ``ids`` added; null or no ids give an empty text."""
    keep = [f for f in encoded.schema.fields if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] +
                       [f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = vocabulary(model_path)
        for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            text = [m.decode(x.values.to_pylist()) if x.is_valid else "" for x in
                    batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in keep] + [pa.array(text, pa.string())],
                [f.name for f in keep] + [text_col])

    return encoded.select(*[f.name for f in keep]).mapInArrow(run, schema)
