"""Token counts from flat files against the tokenizer's own."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from odweave.llm import token_counts
from odweave.llm.bpe import vocabulary
from odweave.llm.token_counts import documents_counted


@pytest.mark.parametrize("block", [2, 64, 1 << 20])
def test_counts(documents, block):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["a few plain words", "", None, "<|endoftext|> isn't one here", "long text " * 300, "größe 日本 x", "a few plain words"]
    rows = [*enumerate(texts), (None, "no id"), (3, "again")]
    got = documents_counted(documents(rows).repartition(2), vocabulary(path), block=block).collect()
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert documents_counted(documents([]), vocabulary(path)).count() == 0


def test_ids_of_32_bits(documents):
    raw = vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.id_type(raw, 49407) == "<u2" and token_counts.id_type(raw, 70_000) == "<u4"
    got = documents_counted(documents([(1, "a few plain words"), (2, "")]), raw, separator=70_000, block=64).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 4, 2: 0}
