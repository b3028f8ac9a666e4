"""SentencePiece encoding and decoding by streaming Viterbi (operator 6).

The search goes through a text position by position and keeps, for the best
path to each, the last piece and its start (:func:`.pieces.last_piece`).  A
later piece can only start in the window of the last ``longest`` positions.
Whenever the backpointer paths of all positions in the window run through
one boundary, everything before that boundary is final: its ids are committed
and its part of the table dropped, so a text without any space needs bounded
memory too.  Boundaries before a run of spaces lie on every path for any
text; texts are cut there first and each distinct unit is searched once per
task.

With the supplied BPE file the ids are those of the model's own encoder (see
:mod:`.pieces`); with a unigram file they have the highest sum of scores.

Decoding joins the pieces' bytes, turns U+2581 into spaces and drops the
leading one.  Encoding normalises nothing (other models are refused), so
decoding gives back the exact text, unless the text itself holds U+2581.

Defined cases: null and empty texts have no ids and decode to ''; texts of
any length are encoded whole; U+2581 in a text is read as a space, as the
model format does.  Repeated rows give repeated results; other columns are
kept, a column of the name asked for is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .pieces import MODEL, Pieces, last_piece, load_pieces, units, write_ids
from .share import share, shared


def viterbi(text: str, p: Pieces, commits: list[int] | None = None,
            state: list | None = None) -> list[int]:
    """Ids of a unit (or any text).  ``commits`` gets the committed boundaries.

    ``state`` may hold the table of a prefix of ``text`` that is shorter than
    a window; it is extended in place as long as nothing is committed.
    """
    n, longest = len(text), p.longest
    ids: list[int] = []
    base, state = 0, p.fresh() if state is None else state
    for end in range(len(state), n + 1):
        state.append(last_piece(text, end, state, base, p))
        if end < n and (end - base) % (2 * longest):
            continue
        meet = end
        if end < n:
            live = set(range(max(base, end + 1 - longest), end + 1))
            while len(live) > 1:
                live.add(state[(last := max(live)) - base][0])
                live.remove(last)
            meet = live.pop()
        at, path = meet, []
        while at > base:
            start, i = state[at - base][:2]
            path.append((i, at))
            at = start
        for i, at in reversed(path):
            write_ids(i, text[at - 1], p, ids)
        if path and end < n:
            base, state = meet, state[meet - base:]
        if path and commits is not None:
            commits.append(meet)
    return ids


#: texts whose units are held at once
PART = 250


class Encoder:
    """Encodes texts; remembers the ids of units as packed int32."""

    def __init__(self, p: Pieces) -> None:
        self.p = p

    def learn(self, fresh: set[str]) -> None:
        """Search units not seen before, in sorted order: the table of the
        prefix a unit shares with the one before it is used again."""
        p = self.p
        known = p.known
        state, before = p.fresh(), ""
        for u in sorted(fresh):
            if len(u) <= 2 * p.longest:
                same = 0
                for a, b in zip(before, u):
                    if a != b:
                        break
                    same += 1
                del state[same + 1:]
                ids, before = viterbi(u, p, None, state), u
            else:
                ids = viterbi(u, p)
            known[u] = array("i", ids).tobytes()

    def packed(self, texts) -> list[bytes]:
        """Packed ids of every text of a batch, ``PART`` texts at a time."""
        out: list[bytes] = []
        for at in range(0, len(texts), PART):
            found = [units(t or "", self.p) for t in texts[at:at + PART]]
            self.learn(self.p.missing({u for us in found for u in us}))
            known = self.p.known
            out += [b"".join([known[u] for u in us]) for us in found]
        return out

    def encode(self, text: str | None) -> list[int]:
        import numpy as np

        return np.frombuffer(self.packed([text])[0], "<i4").tolist()


def decode(ids, p: Pieces) -> str:
    """Text of ids; invalid UTF-8 from byte pieces becomes U+FFFD."""
    return b"".join([p.out[i] for i in ids]).decode("utf-8", "replace")[1:]


def with_ids(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds ``out array<int>``; all columns of ``docs`` are kept.  Units are
    remembered until the task ends (:meth:`.pieces.Pieces.forget`)."""
    pieces = share(docs.sparkSession, load_pieces(model))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        enc = Encoder(shared(pieces))
        try:
            for a in batches:
                packed = enc.packed(a.to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in packed])))
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                               pa.array(np.frombuffer(b"".join(packed), "<i4")))
        finally:
            enc.p.forget()
            pa.default_memory_pool().release_unused()

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, ids_of(F.col(text)))


def with_text(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the decoded text of ``ids`` (null ids: ''); all columns are kept."""
    pieces = share(rows.sparkSession, load_pieces(model))

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = shared(pieces)
        for a in batches:
            ids, at = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
            yield pa.array([decode(ids[i:j].tolist(), p) for i, j in zip(at, at[1:])], pa.string())

    bounded_batches(rows.sparkSession)
    return rows.withColumn(out, text_of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def with_round_trip(docs: DataFrame, text: str = "text", out: str = "coded", model: str = MODEL) -> DataFrame:
    """Adds ``out``: the ids, the characters of the text decoded from them,
    and whether it is the text; encoded and decoded in one pass."""
    pieces = share(docs.sparkSession, load_pieces(model))

    @F.arrow_udf("ids array<int>, n_decoded long, same boolean")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        p = shared(pieces)
        enc = Encoder(p)
        for a in batches:
            texts = a.to_pylist()
            packed = enc.packed(texts)
            decoded = [decode(np.frombuffer(b, "<i4").tolist(), p) for b in packed]
            offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in packed])))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.StructArray.from_arrays(
                [ids, pa.array(list(map(len, decoded)), pa.int64()),
                 pa.array([d == (t or "") for d, t in zip(decoded, texts)], pa.bool_())],
                ["ids", "n_decoded", "same"])

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, coded(F.col(text)))
