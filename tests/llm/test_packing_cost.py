"""What packing's encoder asks the tokenizer for: each word once, while the worker knows it."""

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stridemill.llm.pieces import Pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def learned(monkeypatch):
    asked, learn = [], Pieces._learn

    def spied(self, words):
        asked.append(set(words))
        learn(self, words)

    monkeypatch.setattr(Pieces, "_learn", spied)
    return asked


def same(known: Pieces, texts: list[str]) -> None:
    lib = Tokenizer.from_file(PATH)
    n, ids = known.encode(pa.array(texts), True)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_word_is_learned_once_whatever_its_case_and_punctuation(learned):
    same(Pieces(PATH, blanks=False), ["River, river! RIVER river; Über (über) über\nÜBER.", "river... it's '' , River, $5 x<y"])
    assert learned[0] == {"river", "über", "(über)", "it's", "''", "$5", "x<y", "", ",", "!", ";", ".", "..."}


def test_pieces_that_come_again_outlast_the_bound(learned):
    known = Pieces(PATH, blanks=False, kept=300)
    often = " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    for k in range(8):
        same(known, [often, " ".join(chr(97 + k) + a + b for a in "uvwxyzabcdefg" for b in "ABCDEFGHIJ")])
        assert len(known.index) <= 300
    assert [len(x & set(often.split())) for x in learned] == [100] + [0] * 7


def test_parted_words_have_the_librarys_ids():
    odd = ["", " ", "\n\n", "a  b ", "\tA\rB", "ÀÉÎ, ÿ. ß; ŠČ! İI ıi ẞ", "é É̸ ≠ ≮", "x≠", "...,,, --- 's 'S it'S 'll", "µ ª º ² ½", "日本。 かな、", "<|endoftext|> a", "A\x00b \x00", "kK Å"]
    known = Pieces(PATH, blanks=False, kept=10)
    same(known, odd)
    same(known, ["".join(odd[:-3]), *reversed(odd)])
