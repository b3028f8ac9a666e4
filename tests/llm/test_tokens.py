import random

import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from candleflow.llm import pieces as P
from candleflow.llm import spm_codec as C
from candleflow.llm import token_counts as T

TEXTS = ["", " ", "a", "  two  spaces ", "\n\ttabs\r\n", "The quick brown fox's 12345 jumps!!", "naïve façade ñandú",
         "中文 and 日本語", "😀 é é \u0000 x", "a" * 3000, "xyzw" * 900, " " * 70, "word " * 500,
         "UPPER!! lower### (mixed)[case]{x}"]


@pytest.fixture(scope="module")
def bpe():
    return P.load_pieces()


@pytest.fixture(scope="module")
def unigram():
    proto = sentencepiece_model_pb2.ModelProto()
    with open(P.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:  # small scores, so that the library's 32-bit sums are exact enough
        piece.score = max(piece.score, -32000.0)
    sp = SentencePieceProcessor(model_proto=proto.SerializeToString())
    return sp, P.pieces_of(sp, bpe=False)


def test_ids_are_those_of_the_models_own_encoder(bpe):
    library, enc = SentencePieceProcessor(model_file=P.MODEL), C.Encoder(bpe)
    rnd = random.Random(5)
    made = ["".join(rnd.choice("abcdehiorstn  .,ÉéÜ#&$1") for _ in range(rnd.randint(1, 90))) for _ in range(300)]
    for t in TEXTS + made:
        ids = enc.encode(t)
        assert ids == library.encode(t), t
        assert C.decode(ids, bpe) == t
        assert ids == C.viterbi(P.SPACE + t.replace(" ", P.SPACE), bpe) if t else not ids
        assert len(ids) == sum(T.trie_counts(set(P.units(t, bpe)), bpe)[0][u] for u in P.units(t, bpe))


def test_unigram_model_gets_the_highest_sum(unigram):
    sp, p = unigram
    for t in ["the cat", "someone somewhere", "internationalisation", "New York", "aaaa bbbb"]:
        ids = C.Encoder(p).encode(t)
        best = sp.nbest_encode_as_ids(t, 2)[0]
        assert sum(p.scores[i] for i in ids) == pytest.approx(sum(p.scores[i] for i in best))
        assert C.decode(ids, p) == t


def test_window_is_bounded_and_commits(bpe):
    commits = []
    text = "abcde" * 400
    ids = C.viterbi(text, bpe, commits)
    assert len(commits) > 20 and commits == sorted(commits) and commits[-1] == len(text)
    assert max(b - a for a, b in zip([0] + commits, commits)) <= 4 * bpe.longest
    assert C.decode(C.viterbi(P.SPACE + text, bpe), bpe) == text and ids


def test_shared_prefixes_are_computed_once(bpe):
    words = ["abcd", "abce", "abc", "abcdef"]
    counts, nodes = T.trie_counts(words, bpe)
    assert nodes == len("abcdef") + 1  # abc, abcd, abcde, abcdef and abce
    assert set(counts) == set(words)


def test_frames(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (0, ""), (3, TEXTS[3]), (101, "very long " * 30_000)]
    df = docs(rows, [("ids", "x"), ("n_tokens", 1), ("decoded", 2)])
    out = T.with_token_count(C.with_text(C.with_ids(df))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"])
    for r in C.with_round_trip(df).collect():
        assert r["coded"]["same"] and r["coded"]["n_decoded"] == len(r["text"] or "")
    assert C.with_ids(df.limit(0)).count() == 0 and T.with_token_count(df.limit(0)).count() == 0
