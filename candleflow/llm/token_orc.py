"""Token ids in ORC files (operator 12).

Layout
    Documents stand in ascending id order over a row of files, one for every
    range of ids; a row holds ``doc_id``, ``n_tokens`` and ``ids`` (32-bit,
    with the end id), and its place: ``shard`` (number of the file) and
    ``offset`` (ids of the file before it).  Integer columns are run-length
    encoded by ORC; every stripe carries a row index (minimum and maximum of
    each ``ROW_INDEX`` rows) and a Bloom filter of ``doc_id``, so a search for
    ids reads only the stripes and row groups that may hold them.

Writing
    The only shuffle deals whole texts to id ranges, about ``SHARD_BYTES`` of
    text each; every task sorts its range, encodes it and writes one file.  Rows
    of one id are told apart by their place in the input, so an id that a
    third of the rows share is cut over many files like any other range.

Reading
    :func:`read_tokens` reads stripes in parallel.  The ids before a document
    are ``offset`` plus what stands in the files before its own; those sums are
    a table with a row per file (:func:`shard_starts`), read from two columns.
    :func:`find_documents` pushes an id list down to the ORC reader.

Encoding
    The supplied byte-level BPE splits a text before it merges anything.  Texts
    are cut at places where it always does (:func:`cut_pieces`), each distinct
    piece is encoded once by the library, many new words as one text, and
    remembered: up to ``MEMORY`` pieces in two generations, without those over
    ``LONG_UNIT`` characters.  The ids equal the library's for the whole text
    (tested).  Names of special tokens in a text are ordinary text.

Defined cases: a null text is the empty text (the end id alone); null ids come
first; repeated rows are documents of their own, standing next to each other;
an empty table writes files without rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import bounded_batches
from .share import share, shared

END_ID = 0
SHARD_BYTES = 64 << 20
ROW_INDEX = 1000
STRIPE_BYTES = 16 << 20
MEMORY = 1_000_000
#: words that are encoded as one text
AT_ONCE = 2_000
#: how the vocabulary writes a space and a line feed
SPACE, LINE_FEED = "\u0120", "\u010a"
LONG_UNIT = 64
TOKENIZER = "byte_bpe_50k.json"

#: kinds of bytes; LETTER is also the last byte of a letter from U+00C0 to U+00FF
OTHER, LETTER, MARK, BLANK, LINE, WHITE = range(6)


def _byte_kinds() -> list[int]:
    kinds = [OTHER] * 256
    for c in map(chr, range(128)):
        kinds[ord(c)] = LETTER if c.isalpha() else BLANK if c == " " else LINE if c == "\n" else WHITE \
            if c.isspace() else MARK if c.isprintable() and not c.isdigit() and c != "'" else OTHER
    return kinds


#: white space beyond ASCII, as bytes
_WIDE_SPACE = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]


def cut_pieces(column: pa.StringArray):
    """The texts cut where the library's own splitting always cuts: before a
    single space or line feed between two other characters, between such a line
    feed and a letter, and between a letter and a punctuation mark (not the
    apostrophe).  The pieces (with their space), and how many each text has."""
    import numpy as np

    buffers, n = column.buffers(), len(column)
    ends = np.frombuffer(buffers[1], "<i4")[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int32)
    raw = np.frombuffer(buffers[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind = np.array(_byte_kinds(), np.uint8)[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    kind[after[(raw[after] != 0x97) & (raw[after] != 0xB7)]] = LETTER
    for white in _WIDE_SPACE if (raw > 127).any() else []:
        at = np.flatnonzero(raw[:len(raw) + 1 - len(white)] == white[0])
        for i, byte in enumerate(white[1:], 1):
            at = at[raw[at + i] == byte]
        for i in range(len(white)):
            kind[at + i] = WHITE
    held = ends[:-1] < ends[1:]
    first, last = ends[:-1][held], ends[1:][held] - 1
    before, behind = np.roll(kind, 1), np.roll(kind, -1)
    before[first], behind[last] = WHITE, WHITE
    between = (before < BLANK) & (behind < BLANK)
    line = between & (kind == LINE)
    cuts = between & (kind == BLANK) | line | (kind == MARK) & (before == LETTER)
    cuts[1:] |= line[:-1] & (kind[1:] == LETTER)
    cuts[first] = True
    at = np.append(np.flatnonzero(cuts), len(raw)).astype("<i4")
    pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw)))
    return pieces, np.diff(np.searchsorted(at[:-1], ends))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Slots(dict):
    """Piece -> its place in a generation; a piece that is not there gets the
    next place and is noted in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.next = 0

    def __missing__(self, piece: str) -> int:
        at = self[piece] = self.next
        self.next += 1
        self.fresh.append(piece)
        return at


class _Generation:
    """Remembered pieces: the ids of the one at place ``i`` are
    ``ids[starts[i]:starts[i + 1]]``."""

    def __init__(self) -> None:
        import numpy as np

        self.slots, self.n = _Slots(), 0
        self.ids, self.starts = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def add(self, ids, sizes) -> None:
        """The ids of the next ``len(sizes)`` places."""
        import numpy as np

        ends = self.starts[self.n] + np.cumsum(sizes)
        self.ids = _room(self.ids, int(self.starts[self.n]), int(ends[-1]))
        self.starts = _room(self.starts, self.n + 1, self.n + 1 + len(sizes))
        self.ids[self.starts[self.n]:ends[-1]] = ids
        self.starts[self.n + 1:self.n + 1 + len(sizes)] = ends
        self.n += len(sizes)

    def take(self, places):
        """The ids of ``places``, one after another, and how many each has."""
        import numpy as np

        first = self.starts[places]
        sizes = self.starts[places + 1] - first
        before = np.cumsum(sizes) - sizes
        at = np.repeat((first - before).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], sizes


def _room(column, used: int, wanted: int):
    """``column`` with place for ``wanted`` entries, the first ``used`` kept."""
    import numpy as np

    if wanted <= len(column):
        return column
    wider = np.zeros(max(wanted, len(column) * 3 // 2), column.dtype)
    wider[:used] = column[:used]
    return wider


class Encoder:
    """Whole texts -> little-endian 32-bit ids, remembered by piece."""

    def __init__(self, path: str) -> None:
        import os

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token[:1] == SPACE]] = True
        self.line = vocabulary[LINE_FEED]
        self.young, self.old = _Generation(), _Generation()

    def _plain(self, texts: list[str]):
        """The library's ids of every text, one after another, and how many."""
        import numpy as np

        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _together(self, words: list[str], spaced: bool):
        """The ids of words of letters, all after a space or all without: one
        text for the library, cut where a token starts with a space, or at line
        feeds."""
        import numpy as np

        ids, _ = self._plain(["".join(words) if spaced else "\n" + "\n".join(words)])
        starts = self.spaced[ids] if spaced else ids == self.line
        at = np.flatnonzero(starts)
        if len(at) != len(words):  # never seen: every word starts with such a token
            return self._plain(words)
        sizes = np.diff(np.append(at, len(ids)))
        return (ids, sizes) if spaced else (ids[~starts], sizes - 1)

    def _learn(self) -> list[str]:
        """Remembers the ids of the pieces that got a place without them: those that the older generation has, then all others."""
        import numpy as np

        young, old = self.young, self.old
        fresh, young.slots.fresh = young.slots.fresh, []
        if not fresh:
            return fresh
        known = np.fromiter(map(old.slots.get, fresh, repeat(-1)), np.int64, len(fresh)) if old.n else np.full(
            len(fresh), -1)
        had = np.flatnonzero(known >= 0)
        parts, order, kinds = [old.take(known[had])], [had], ([], [], [])
        for i in np.flatnonzero(known < 0).tolist():
            u = fresh[i]
            kinds[0 if u[0] == " " and u[1:].isalpha() else 1 if u.isalpha() else 2].append(i)
        for kind, places in enumerate(kinds):
            order.append(np.array(places, np.int64))
            for at in range(0, len(places), AT_ONCE):
                part = [fresh[i] for i in places[at:at + AT_ONCE]]
                parts.append(self._together(part, kind == 0) if kind < 2 else self._plain(part))
        # in the order of their places
        place = np.empty(len(fresh), np.int64)
        place[np.concatenate(order)] = np.arange(len(fresh))
        got = _Generation()
        got.add(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        young.add(*got.take(place))
        return fresh

    def encoded(self, texts: pa.StringArray, end: int | None = None):
        """The ids of all texts, one after another (each with the end id, if
        there is one), and how many each has."""
        import numpy as np

        pieces, counts = cut_pieces(texts)
        # a piece that a batch holds often is looked up once
        distinct = pieces.dictionary_encode()
        names = distinct.dictionary.to_pylist()
        place = np.fromiter(map(self.young.slots.__getitem__, names), np.int64, len(names))
        new = self._learn()
        ids, sizes = self.young.take(place[distinct.indices.to_numpy()])
        self._forget(new)
        sizes = np.diff(_before(sizes)[_before(counts)])
        if end is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
        return ids, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encoded(pa.array(texts, pa.string()))
        ends = _before(sizes).tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def _forget(self, new: list[str]) -> None:
        """Long pieces are forgotten at once; a full generation becomes the
        older one."""
        young = self.young
        for u in new:
            if len(u) > LONG_UNIT:
                del young.slots[u]
        if len(young.slots) > MEMORY // 2 or young.starts[young.n] > 8 * MEMORY:
            self.old, self.young = young, _Generation()


def _before(sizes):
    """Sums of all sizes before each, and of all."""
    import numpy as np

    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


class Coder:
    """What a worker keeps for all its tasks: the encoder, made when first
    used, and what it remembers."""

    def __init__(self, path: str) -> None:
        self.path, self.encoder = path, None

    def encoded(self, texts: pa.StringArray, end: int):
        if self.encoder is None:
            self.encoder = Encoder(self.path)
        return self.encoder.encoded(texts, end)


def write_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text",
                 tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> str:
    """Writes the files and returns their folder (a new one in the shared
    scratch folder if none is given)."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/tokens-{uuid.uuid4().hex}"
    packed = share(spark, Coder(tokenizer or tokenizer_path()))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")) \
               .withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_row")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order) \
               .select(F.spark_partition_id().alias("shard"), "doc_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder, offset = shared(packed), 0
        for batch in batches:
            coded, sizes = coder.encoded(batch.column("t").cast(pa.string()), end_id)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)),
                                           pa.array(coded.view("<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("doc_id"), pa.array(sizes),
                 pa.array(offset + ends - sizes), ids], ["shard", "doc_id", "n_tokens", "offset", "ids"])
            offset += int(ends[-1]) if len(ends) else 0

    rows.mapInArrow(run, f"shard int, doc_id {kind}, n_tokens long, offset long, ids array<int>") \
        .write.mode("errorifexists").option("compression", "zstd") \
        .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX)) \
        .option("orc.stripe.size", str(STRIPE_BYTES)) \
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    return path


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard`` and ``first``: the ids in all files before it.  A row per
    file is collected, as many as the writing job had tasks."""
    sums = spark.read.orc(path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    first, rows = 0, []
    for r in sorted(sums, key=lambda r: r["shard"]):
        rows.append((r["shard"], first))
        first += r["n"]
    return spark.createDataFrame(rows, "shard int, first long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` of every document; a row per file is the broadcast side."""
    rows = spark.read.orc(path)
    return rows.join(F.broadcast(shard_starts(spark, path)), "shard").select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The documents of the given ids: the list is pushed to the ORC reader,
    which passes over files, stripes and row groups by their index and Bloom
    filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(list(ids))).select("doc_id", "n_tokens", "ids")


def with_crc32(tokens: DataFrame, out: str = "ids_crc32") -> DataFrame:
    """Adds the unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    @F.arrow_udf("long")
    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from zlib import crc32

        import numpy as np

        for a in batches:
            at = a.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(a.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            yield pa.array([crc32(flat[4 * i:4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())

    bounded_batches(tokens.sparkSession)
    return tokens.withColumn(out, crc(F.col("ids")))
