import pytest
from conftest import SMALL
from fixtures import documents, empty

from lectern.llm import tokens
from lectern.llm.queries import op5_tokens, tokenizer
from lectern.session import table

PATH = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer, models, normalizers

    own = Tokenizer(models.Unigram(tokens.vocabulary(PATH), unk_id=0, byte_fallback=True))
    own.normalizer = normalizers.Sequence([normalizers.Prepend(tokens.MARK), normalizers.Replace(" ", tokens.MARK)])
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


def test_whole_table(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in op5_tokens(spark, SMALL).collect()} == {i: reference(t) for i, t in texts.items()}


def test_awkward_documents(spark, reference):
    rows = documents(spark).collect()
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(documents(spark), PATH).collect()) == sorted(reference(r["text"]) for r in rows)
    assert tokens.count_tokens(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "\n", "\na", "a\n\nb ", "日本語 text", "😀 hi", "<s> x", "x ▁ y", " \n a", "\t\ta", " ", "<0x0A>"])
def test_ties_and_marks(text, reference):
    assert tokens.counter(PATH).count(text) == reference(text)
