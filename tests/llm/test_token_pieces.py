"""Texts cut into pieces before they are encoded: nothing is lost, the ids are
the library's, and a word is learned once whatever mark follows it."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from candleflow.llm import token_orc as T


def library():
    t = Tokenizer.from_file(T.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def pieces(texts):
    found, counts = T.cut_pieces(pa.array(texts, pa.string()))
    ends = np.concatenate(([0], np.cumsum(counts))).tolist()
    return [found.to_pylist()[a:b] for a, b in zip(ends, ends[1:])]


def test_where_texts_are_cut():
    assert pieces(["One, two.\nThree!", "", " x  y", "it's Aé. a\n\nb", "a  b  c", "d　 e×."]) == [
        ["One", ",", " two", ".", "\n", "Three", "!"], [], [" x  y"], ["it's", " Aé", ".", " a\n\nb"],
        ["a  b  c"], ["d　 e×."]]


def test_a_part_of_a_column():
    column = pa.array(["left out", "a b", None, "c."], pa.string())[1:]
    found, counts = T.cut_pieces(column)
    assert found.to_pylist() == ["a", " b", "c", "."] and counts.tolist() == [2, 0, 2]
    found, counts = T.cut_pieces(pa.array([], pa.string()))
    assert len(found) == 0 and len(counts) == 0


def test_ids_of_the_library():
    encode, mine = library(), T.Encoder(T.tokenizer_path())

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.text(st.sampled_from("abtsrevld' \n\n.,;!$&_19éßñ×÷\t\r\x0b\x1c\x85  　、日²ªΩж🙂́|<>"),
                            max_size=25), max_size=4))
    def same(texts):
        for _ in range(2):  # new, then remembered
            assert [np.frombuffer(c, "<u4").tolist() for c in mine.encode(texts)] == [encode(t) for t in texts]
        assert ["".join(p) for p in pieces(texts)] == texts

    same()
    assert mine.encode([]) == []


def test_full_generations_and_long_pieces(monkeypatch):
    monkeypatch.setattr(T, "MEMORY", 40)
    encode, mine = library(), T.Encoder(T.tokenizer_path())
    for i in range(30):
        texts = [f"word{chr(97 + i % 26) * (j % 5)} of, {chr(97 + (i + j) % 26)}x.\n{'y' * (60 + i)}" for j in range(7)]
        assert [np.frombuffer(c, "<u4").tolist() for c in mine.encode(texts)] == [encode(t) for t in texts]
        assert max(map(len, mine.young.slots), default=0) <= T.LONG_UNIT


def test_a_word_is_learned_once():
    mine, sent = T.Encoder(T.tokenizer_path()), []
    plain = mine._plain
    mine._plain = lambda texts: sent.extend(texts) or plain(texts)
    mine.encode(["so Erheasten, so", "so Erheasten. so", "so Erheasten$$$ so", "so Erheasten\nso"])
    assert sum(t.count("Erheasten") for t in sent) == 1
