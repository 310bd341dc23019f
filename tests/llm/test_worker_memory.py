"""What a Python worker holds at once, and what it does for each text."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa

from fieldmark.llm import jaccard_join, language, pieces, words
from fieldmark.llm.words import CODES_LOWER, blocks, mix, parts, shingles


def test_token_sets_sort_text_by_text(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcD"), n)) for n in rng.integers(0, 40, 300)] + [
        "", " \n", "a", "A", "a b", "x y z w", "x x x x x x x x x"]

    def one_sort_for_all(*_):
        raise AssertionError("all tokens of a block sorted by two keys at once")

    monkeypatch.setattr(np, "lexsort", one_sort_for_all)
    (block,) = blocks(pa.array(texts))
    tokens, sizes = jaccard_join.token_sets(block, 5)
    assert len(sizes) == len(texts) and sizes.sum() == len(tokens)
    for text, own in zip(texts, np.split(tokens, np.cumsum(sizes)[:-1])):
        (alone,) = blocks(pa.array([text]))
        w, n = alone.word_hashes(CODES_LOWER), len(text.split())
        if n >= 5:
            expected = set(shingles(w, alone.doc, 5)[1].tolist())
        else:
            expected = {int(mix(shingles(w, alone.doc, n)[1] + np.uint64(n))[0])} if n else set()
        assert own.tolist() == sorted(expected)


def test_blocks_and_parts_are_small():
    # arrays over a block's bytes take many times their number
    assert words.BLOCK <= 1 << 19
    texts = ["a" * 200_000, None, "", "b" * 2_000_000, "c" * 300_000, "d" * 300_000, None] * 3
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts}).slice(1)
    got = list(parts(batch, "text"))
    assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist()
    for p in got:
        assert p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= words.BLOCK
    assert not list(parts(batch.slice(0, 0), "text"))


def test_language_scores_few_characters_at_once(monkeypatch):
    sizes = []

    def log2(self, windows):
        sizes.append(len(windows))
        return np.full((len(windows), 1), -1.0, np.float32)

    monkeypatch.setattr(language.Model, "log2", log2)
    texts = [language.normalise("word " * 20_000)] * 30  # 100,000 characters each
    got = language.Model(["en"]).cross_entropies(texts)
    assert got.shape == (30, 1) and np.allclose(got, 1.0)
    assert max(sizes) <= language.BLOCK_CHARS + 100_001


def test_decoding_builds_no_automaton():
    path = public_tokenizers.path("piece_bpe_32k.model")
    held, encoder = pieces.vocabulary(path), pieces.model(path)
    assert not hasattr(held, "automaton") and not hasattr(held, "table")
    for text in ("a plain text", "x\ty  ▁ z\n", "ünï 漢字 \U0001F600"):
        assert held.decode(encoder.best(" " + text)[0]) == text
    assert encoder.table.max_units <= 1_000_000
