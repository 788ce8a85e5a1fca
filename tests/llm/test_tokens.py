import pytest
from tokenizers import Tokenizer

from kalends.llm.encoder import Encoder, public
from kalends.llm.token_counts import count_tokens

ODD = ["", None, "a", "Hello  World.\n\nIt's  <|endoftext|> ok", " lead trail ", "x" * 5000, "é́ ΑΣ ß ﬁ １２    tab\tnew\r\n 's", "a\x00b c", "...!!! 12345 don't", "日本語 テキスト 😀 😀", "a \n b   c  d", "\x1c\x1d a"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    import pyarrow as pa

    own, library = Encoder(public(name)), Tokenizer.from_file(public(name))
    data = [t or "" for t in ODD]
    ids, counts = own.encode(pa.array(data))
    want = [e.ids for e in library.encode_batch(data, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_counts_equal_library(spark, texts):
    library = Tokenizer.from_file(public("word_bpe_49k.json"))
    long = [" ".join(f"word{i}'s É{i}." for i in range(900)), "y" * 3000 + " end " + "z" * 1500, "<|endoftext|> " * 200, "no" * 700 + "\n" + "1" * 900]
    rows = list(enumerate(ODD + long)) + [(3, ODD[3]), (len(ODD), long[0])]
    got = count_tokens(texts(rows), public("word_bpe_49k.json"), limit=100, chunk_chars=500, overlap_chars=40)
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows)
    assert sorted(map(tuple, got.collect())) == want


def test_counts_of_no_rows(texts):
    assert count_tokens(texts([]), public("word_bpe_49k.json")).collect() == []


def test_other_vocabularies_are_not_spliced(texts, tmp_path):
    from tokenizers import models, pre_tokenizers

    # a merge reaches over blanks, so a splice at a blank would be wrong
    own = Tokenizer(models.BPE({"a": 0, " ": 1, "a ": 2, "a a ": 3, "b": 4}, [("a", " "), ("a ", "a ")]))
    own.pre_tokenizer = pre_tokenizers.Split("b", "isolated")
    own.save(str(tmp_path / "own.json"))
    text = "a " * 701 + "b" + "a " * 33
    rows = [(1, text), (2, None), (3, "a a")]
    got = {r.doc_id: r.n_tokens for r in count_tokens(texts(rows), str(tmp_path / "own.json"), chunk_chars=100, overlap_chars=20).collect()}
    assert got == {i: len(own.encode(t or "").ids) for i, t in rows}
