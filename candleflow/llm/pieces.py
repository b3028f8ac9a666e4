"""The pieces of a SentencePiece model, and one step of the search over them.

Both tokenizer operators fill, position by position, a table of the best
last piece of every prefix.  What "best" means depends on the model file:

* unigram models: the highest sum of piece scores (of equal sums the
  earliest start of the last piece);
* BPE models: scores are merge ranks and their sums mean nothing (the best
  sum of the supplied file splits "▁the" into "▁t" "he").  There the last
  piece of a prefix is the one that is *stable* after the piece before it:
  merging the two pieces' characters by rank gives the same two pieces back.
  A sequence is the encoding by merges exactly if all its neighbours are
  stable, and every prefix has one such last piece, so the table holds one
  survivor per position and the ids are those of the model's own encoder.

A character no piece covers is written as its bytes (the model's byte
pieces) or, without those, as ``<unk>``; in unigram models it costs
``min_score - 10``.

Spaces become U+2581, one stands before the text.  No piece of the model
continues past another character into a U+2581, so every boundary between
another character and a U+2581 lies on all paths: texts are cut there into
*units*, and for the same reason between characters of classes that no piece
joins (letters, digits, others): see :func:`unit_pattern`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units, and stable pairs, remembered by one worker; emptied when full,
#: which changes no result.
REMEMBERED = 100_000


@dataclass
class Pieces:
    """Piece table, read once on the driver and sent to the tasks."""

    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    unknown: int
    bpe: bool
    out: list[bytes]
    stable: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids))
        self.floor = min(self.scores[i] for i in self.ids.values()) - 10.0
        self.names = {i: p for p, i in self.ids.items()}
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        #: automaton over the pieces, built where it is walked: the longest
        #: piece prefix that a text ends with -> (next nodes by character,
        #: pieces the text ends with as (length, id), longest first, name)
        self.nodes: dict[str, tuple] = {}
        #: what a worker has found for units, over all its tasks
        self.known: dict = {}
        self.older: dict = {}
        self.find_units = unit_pattern(self.ids).findall

    def missing(self, wanted) -> set[str]:
        """Which units have to be worked out.  A full table becomes the older
        one, from which units in use are taken over: rare ones are forgotten."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = set()
        for u in wanted:
            if u not in known:
                if u in older:
                    known[u] = older[u]
                else:
                    out.add(u)
        return out

    def forget(self) -> None:
        """Drops all that a worker has found.  Spark keeps more Python workers
        than run at a time and deals its tasks to them in turn: each would hold
        its own tables while it waits."""
        for found in (self.known, self.older, self.stable, self.nodes):
            found.clear()

    def node(self, name: str) -> tuple:
        found = self.nodes.get(name)
        if found is None:
            ends = [(len(name) - n, self.ids[name[n:]]) for n in range(len(name)) if name[n:] in self.ids]
            found = self.nodes[name] = ({}, ends, name)
        return found

    def step(self, node: tuple, char: str) -> tuple:
        name = node[2] + char
        while name and name not in self.prefixes:
            name = name[1:]
        found = node[0][char] = self.node(name)
        return found

    def fresh(self) -> list:
        """The table of the empty prefix."""
        return [(0, START, 0.0, self.node(""))]


def load_pieces(path: str = MODEL) -> Pieces:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(raw)
    if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models that normalise nothing are supported")
    return pieces_of(SentencePieceProcessor(model_proto=raw), proto.trainer_spec.model_type == 2)


def pieces_of(sp, bpe: bool) -> Pieces:
    n = sp.get_piece_size()
    ids = {sp.id_to_piece(i): i for i in range(n)
           if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece spans a word boundary: units do not hold for this model")
    byte_ids, out = [-1] * 256, [b""] * n
    for i in filter(sp.is_byte, range(n)):
        b = int(sp.id_to_piece(i)[3:5], 16)
        byte_ids[b], out[i] = i, bytes([b])
    for p, i in ids.items():
        out[i] = p.replace(SPACE, " ").encode()
    out[sp.unk_id()] = " ⁇ ".encode()
    return Pieces(ids, [sp.get_score(i) for i in range(n)],
                  byte_ids if min(byte_ids) >= 0 else [], sp.unk_id(), bpe, out)


def unit_pattern(ids) -> re.Pattern:
    """Pattern of the units: runs of one class of characters (letters, digits,
    all others), with the spaces before them.  Characters that pieces join
    across classes count as others; if pieces still do, a unit is everything
    up to the next space.  Digits stand alone if no piece joins two."""
    kind = lambda c: "S" if c == SPACE else "D" if re.match(r"\d", c) else "L" if re.match(r"[^\W_]", c) else "O"
    pairs = {p[n:n + 2] for p in ids for n in range(len(p) - 1)}
    odd = {c for x in pairs for c in x if kind(x[0]) != kind(x[1]) and "S" != kind(x[0]) and kind(c) == "L"}
    mixed = [x for x in pairs if x[0] != SPACE and ("O" if x[0] in odd else kind(x[0])) != (
        "O" if x[1] in odd else kind(x[1]))]
    if mixed:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    rare = re.escape("".join(sorted(odd)))
    digits = r"\d+" if any(kind(x[0]) == "D" for x in pairs) else r"\d"
    return re.compile(f"{SPACE}*(?:[^\\W\\d_{rare}]+|{digits}|(?:[^\\w{SPACE}]|[_{rare}])+)|{SPACE}+")


def units(text: str, p: Pieces) -> list[str]:
    """The units of a text, with the space that stands before it."""
    return p.find_units(SPACE + text.replace(" ", SPACE)) if text else []


def merged(text: str, p: Pieces) -> list[str]:
    """Characters merged by rank, best first, of equal ranks the leftmost."""
    parts, ids, scores = list(text), p.ids, p.scores
    while True:
        best, at = None, 0
        for i in range(len(parts) - 1):
            hit = ids.get(parts[i] + parts[i + 1])
            if hit is not None and (best is None or scores[hit] > best):
                best, at = scores[hit], i
        if best is None:
            return parts
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


#: Stands before the first piece, and for a character that no piece covers.
START, UNCOVERED = 1 << 30, -1


def is_stable(before: int, piece: int, p: Pieces) -> bool:
    if len(p.stable) > 2 * REMEMBERED:
        p.stable.clear()
    names = [p.names[i] for i in (before, piece) if i != START]
    ok = p.stable[before << 31 | piece] = merged("".join(names), p) == names
    return ok


def last_piece(text: str, end: int, state: list, base: int, p: Pieces) -> tuple[int, int, float, tuple]:
    """Start, id and score of the best last piece of ``text[:end]``, and the
    automaton's node.  ``state[i]`` holds them for the prefix that ends at
    ``base + i``; its last entry is that of ``end - 1``."""
    char = text[end - 1]
    node = state[-1][3]
    node = node[0].get(char) or p.step(node, char)
    if p.bpe:
        stable = p.stable
        for length, i in node[1]:
            start = end - length
            if start < base:
                continue
            before = state[start - base][1]
            if before < 0:  # an uncovered character merges with nothing
                before = START
            ok = stable.get(before << 31 | i)
            if ok or ok is None and is_stable(before, i, p):
                return start, i, 0.0, node
        return end - 1, UNCOVERED, 0.0, node
    best, single = None, False
    for length, i in node[1]:
        single |= length == 1
        if end - length >= base:
            score = state[end - length - base][2] + p.scores[i]
            if best is None or score > best[2]:
                best = (end - length, i, score, node)
    if not single:
        score = state[end - 1 - base][2] + p.floor
        if best is None or score > best[2]:
            best = (end - 1, UNCOVERED, score, node)
    return best


def write_ids(i: int, char: str, p: Pieces, ids: list[int]) -> None:
    if i >= 0:
        ids.append(i)
    else:
        ids += [p.byte_ids[b] for b in char.encode()] if p.byte_ids else [p.unknown]


def n_ids(i: int, char: str, p: Pieces) -> int:
    return 1 if i >= 0 or not p.byte_ids else len(char.encode())
