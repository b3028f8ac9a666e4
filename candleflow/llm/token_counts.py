"""Token counts by dynamic programming over a shared trie (operator 10).

The distinct pre-tokens (units, see :mod:`.pieces`) of a batch form a trie.
Walking it depth first, the forward state of a prefix -- its best last piece
and the number of tokens up to it -- is computed once per trie node from the
states above it and shared by all pre-tokens below; a terminal node stores
its count.  A document's count is the sum over its pre-tokens, and equals
the number of ids of the streaming encoder.

The forward state is the unigram score for a unigram model; the supplied
file is a BPE model, whose forward state is the stable last piece (see
:mod:`.pieces`), so counts are those of the model's own encoder.

Sorted pre-tokens are the trie's depth-first order: the walk keeps one state
per character of the current path and cuts back to the prefix shared with
the next pre-token, so memory is bounded by the longest pre-token.

Defined cases: null and empty texts count 0; repeated rows count each; very
long texts are counted whole; other columns are kept, a column of the name
asked for is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .pieces import MODEL, Pieces, last_piece, load_pieces, n_ids, units
from .share import share, shared


def trie_counts(pretokens, p: Pieces) -> tuple[dict[str, int], int]:
    """Token count of every distinct pre-token, and the trie nodes computed."""
    counts: dict[str, int] = {}
    nodes, before = 0, ""
    state, used = p.fresh(), [0]  # per prefix of the current path
    for word in sorted(pretokens):
        same = 0
        for a, b in zip(before, word):
            if a != b:
                break
            same += 1
        del state[same + 1:], used[same + 1:]
        for end in range(same + 1, len(word) + 1):
            step = last_piece(word, end, state, 0, p)
            state.append(step)
            used.append(used[step[0]] + n_ids(step[1], word[end - 1], p))
        nodes += len(word) - same
        counts[word] = used[-1]
        before = word
    return counts, nodes


def with_token_count(docs: DataFrame, text: str = "text", out: str = "n_tokens",
                     model: str = MODEL) -> DataFrame:
    """Adds ``out long``; all columns of ``docs`` are kept."""
    pieces = share(docs.sparkSession, load_pieces(model))

    @F.arrow_udf("long")
    def count_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = shared(pieces)
        for a in batches:
            cut = [units(t or "", p) for t in a.to_pylist()]
            fresh = trie_counts(p.missing({u for us in cut for u in us}), p)[0]
            known = p.known
            known.update(fresh)
            yield pa.array([sum([known[u] for u in us]) for us in cut], pa.int64())

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, count_of(F.col(text)))
