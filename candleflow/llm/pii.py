"""Personal data by candidate gradient boosting (operator 7), DataFrame and SQL
functions only.

Base spans
    email, ip, card, phone: leftmost non-overlapping matches of their
    pattern; a match that fails its check (ip parts, Luhn, digits) is
    dropped, without a retry.  The patterns below find the same matches with
    possessive loops and look-behinds, so that long runs of digits or letters
    cost linear time and no stack.

Candidates
    High-recall generators per kind search the text with all base spans
    blanked out: addresses with "(at)" or "[dot]" or without a domain ending,
    dotted quadruples in brackets, digit chains of card length with wide
    separators, phone numbers without a country prefix.  What a candidate is
    is checked on its plain form (obfuscation undone): right, wrong (no
    domain, parts over 255, failed Luhn, digits too few or too many), or not
    checkable (a phone number without its "+").  Base spans are right.

Ratings
    Gradient-boosted trees tell right candidates from all others by format and
    context of the plain form; what the check itself looks at ("+", "(at)", Luhn,
    part values) is no feature.  The rating of a candidate is thus the share
    of those that look and stand like it and are known to be right.

Thresholds
    Per kind, the lowest rating (to ``DIGITS`` decimals, at least
    ``MIN_RATING``) from which held-out checkable candidates were right with
    ``PRECISION``, over ``MIN_SUPPORT`` of them or more; candidates that cannot
    be checked count for neither side.  All held-out candidates of all
    documents are rated for it; a kind without such a rating adds nothing.  A
    candidate known to be wrong is never added; of overlapping additions the
    best rated stays.

The trees are fitted on at most ``SAMPLE`` candidates of each kind (smallest
hash of id and place, from all documents) with pyspark.ml and then written out
as a column expression, so every document is scored in place: no shuffle.
Work on a text is close to linear in its length and its number of spans:
positions are prefix sums and running maxima over blocks, and pieces are cut from
``CHUNK`` characters at a time.

Positions count code points, ends are exclusive.  Defined cases: null text
is the empty text and has no spans; repeated rows get the same spans; without
any candidate the model is None and only base spans remain, with right
candidates only all ratings are equal; other columns are kept, columns of the
added names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import let, no_null

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
PRECISION = 0.97
MIN_RATING = 0.5
MIN_SUPPORT = 25
DIGITS = 4
ROUNDS, DEPTH = 20, 3
CONTEXT = 24
#: elements and characters that are handled as one piece
BLOCK, CHUNK = 256, 1024
#: additions of at most NEAR_CHARS characters overlap at most NEAR others
NEAR, NEAR_CHARS = 72, 140
MASK = "\u0001"
RIGHT, WRONG, UNKNOWN = 1, 0, -1

#: A match starts a run of its first class, or where the last match ended:
#: from any later place in the run the rest would be the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of 12 to 19 digits; shorter and longer ones fail the check
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?(?:\(at\)|\[at\])\x20?)"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)"
CANDIDATE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)|\x20?\[dot\]\x20?)[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20._/-])[0-9](?:[\x20._/-]{0,2}+[0-9]){11,18}+(?![\x20._/-]{0,2}[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
             r"|(?<![0-9A-Za-z+@._-])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,8}+\)?){1,5}+(?![0-9A-Za-z])",
}
#: kinds are only searched in texts that hold one of these
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9][.\[(\x20]", "card": r"[0-9][\x20._/-]{0,2}[0-9]",
        "phone": r"[0-9][0-9]"}
CUE = r"(?i)tel|phone|call|fax|mail|contact|card|visa|pay|host|addr|server|\bip\b"


def _prefix(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For every element, ``merge`` of all before it (``zero`` for the first):
    block totals, their running merge, then the rest of the own block."""
    def whole(block: Column) -> Column:
        return F.aggregate(block, zero, merge)

    def inside(args: Column) -> Column:
        starts, all_ = args["starts"], args["all"]

        def before(_, i):
            b = F.floor(i / BLOCK).cast("int")
            return merge(F.get(starts, b), whole(F.slice(all_, b * BLOCK + 1, i % BLOCK)))

        return F.transform(all_, before)

    def with_starts(all_: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")),
                           lambda b: whole(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))
        starts = F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(
            acc, F.array(merge(F.element_at(acc, -1), x))))
        return let(F.struct(starts.alias("starts"), all_.alias("all")), inside)

    return let(values, with_starts)


def _offsets(lengths: Column) -> Column:
    """Sum of what stands before each element."""
    return _prefix(lengths, lambda a, b: a + b, F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def value(i: Column) -> Column:
        n = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(n > 4, 2 * n - 9).otherwise(2 * n)).otherwise(n)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _plain(kind: str, m: Column) -> Column:
    """A match with its obfuscation undone; a phone number without prefix."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(m, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    if kind == "ip":
        return F.regexp_replace(m, r"\x20?[(\[](?:\.|dot)[)\]]\x20?", ".")
    if kind == "card":
        return F.regexp_replace(m, r"[\x20._/-]+", " ")
    return F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*(?=[(0-9])", "")


def _known(kind: str, m: Column) -> Column:
    """RIGHT, WRONG or UNKNOWN by the kind's check on the plain form."""
    plain = _plain(kind, m)
    if kind == "email":
        return F.when(plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"), RIGHT).otherwise(WRONG)
    if kind == "phone":
        n = F.length(_digits(m))
        return F.when(~n.between(9, 15), WRONG).when(m.startswith("+"), RIGHT).otherwise(UNKNOWN)
    return F.when(_passes(kind, plain), RIGHT).otherwise(WRONG)


def _found(rows: DataFrame, text: str, patterns: dict[str, str], out: str) -> DataFrame:
    """Adds ``out_<kind>``: matches as (s, e, kind, m, left, right)."""
    empty = F.array().cast("array<string>")
    for kind, rx in patterns.items():
        some = F.col(text).rlike(HINT[kind])
        rows = rows.withColumns({
            "_m": F.when(some, F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(0))).otherwise(empty),
            "_gap": F.when(some, F.split(F.col(text), rx, -1)).otherwise(empty)})
        rows = rows.withColumn("_at", F.when(F.size("_m") > 0, _offsets(F.transform(
            "_m", lambda m, i: F.length(m) + F.length(F.get(F.col("_gap"), i))))))
        rows = rows.withColumn(f"{out}_{kind}", F.coalesce(F.transform("_m", lambda m, i: F.struct(
            (F.get(F.col("_at"), i) + F.length(F.get(F.col("_gap"), i))).alias("s"),
            (F.get(F.col("_at"), i) + F.length(F.get(F.col("_gap"), i)) + F.length(m)).alias("e"),
            F.lit(KINDS.index(kind)).alias("kind"), m.alias("m"),
            F.right(F.get(F.col("_gap"), i), F.lit(CONTEXT)).alias("left"),
            F.left(F.get(F.col("_gap"), i + 1), F.lit(CONTEXT)).alias("right"))),
            F.array().cast("array<struct<s:int,e:int,kind:int,m:string,left:string,right:string>>")))
        rows = rows.drop("_m", "_gap", "_at")
    return rows


def _spans(matches: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))


def _passing(kind: str) -> Column:
    return F.filter(f"_b_{kind}", lambda x: _passes(kind, x["m"]))


def _with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_t``, ``_base`` and, per kind, the passing matches ``_b_<kind>``."""
    rows = _found(docs.withColumn("_t", no_null(F.col(text))), "_t", BASE, "_b")
    rows = rows.withColumns({f"_b_{k}": _passing(k) for k in KINDS})
    return rows.withColumn("_base", F.array_sort(F.concat(*[_spans(F.col(f"_b_{k}")) for k in KINDS])))


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base``: the base spans (s, kind, e) by start, then kind."""
    return _with_base(docs, text).drop("_t", *[f"_b_{k}" for k in KINDS])


def replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with its spans (sorted) replaced: ``fill(span, covered)`` for
    each, where ``covered`` is how far the spans before it reach."""
    def cut(args: Column) -> Column:
        chunks, all_, ends, length = args["chunks"], args["spans"], args["ends"], args["length"]

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            n = F.floor((b - 1) / CHUNK).cast("int") - first + 1
            return F.when(b > a, F.substring(F.array_join(F.slice(chunks, first + 1, F.greatest(n, F.lit(0))), ""),
                                             a % CHUNK + 1, b - a)).otherwise("")

        parts = F.transform(all_, lambda x, i: F.concat(piece(F.get(ends, i), x["s"]), fill(x, F.get(ends, i))))
        last = F.greatest(F.element_at(ends, -1), F.element_at(all_, -1)["e"])
        return F.concat(F.array_join(parts, ""), piece(last, length))

    reach = _prefix(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0))
    chunks = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % CHUNK), F.lit(0))
    args = F.struct(chunks.alias("chunks"), spans.alias("spans"), reach.alias("ends"), F.length(text).alias("length"))
    return F.when(F.size(spans) == 0, text).otherwise(let(args, cut))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by
    ``[KIND]`` (the kind of the first)."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda x, covered: F.when(x["s"] >= covered, F.get(names, x["kind"])).otherwise(""))


def _blanked(text: Column, spans: Column) -> Column:
    """The text, of the same length, with a mark for every character in a span."""
    return replaced(text, spans, lambda x, covered: F.repeat(
        F.lit(MASK), F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], covered))))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _rated(matches: Column, kind: str, right: bool) -> Column:
    """Matches as (s, kind, e, x, y): features, and what is known of them."""
    def one(c: Column) -> Column:
        return let(_plain(kind, c["m"]), lambda plain: F.struct(
            c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"),
            F.array(*_features(kind, plain, c["left"], c["right"])).alias("x"),
            (F.lit(RIGHT) if right else _known(kind, c["m"])).alias("y")))

    return F.transform(matches, one)


def _features(kind: str, m: Column, left: Column, right: Column) -> list[Column]:
    def size(rx: str) -> Column:
        return F.length(F.regexp_replace(m, rx, ""))

    def group(n: int) -> Column:  # digits of the n-th group from the right
        return F.length(F.regexp_extract(m, "([0-9]+)" + "[^0-9]+[0-9]+" * n + "[^0-9]*$", 1))

    number = kind in ("card", "phone")
    shape = [size("[^0-9]"), size("[^A-Za-z]"), size("[^.]"), size(r"[^\x20-]"), size("[^()]")]
    out = [F.lit(float(kind == k)) for k in KINDS]
    out += [F.length(m) if not number else F.lit(0), *([F.lit(0)] * 2 + shape[2:] if number else shape)]
    out += [group(n) if number else F.lit(0) for n in range(3)]
    out += [_flag((left == "") | left.rlike(r"\s$")), _flag(left.rlike(r"\p{L}$")), _flag(left.rlike(r"[^\p{L}\s+(]$")),
            _flag((right == "") | right.rlike(r"^\s")), _flag(right.rlike(r"^\p{L}")), _flag(right.rlike(r"^\.")),
            _flag(left.rlike(CUE)), _flag(left.rlike("[=:\"]\\s?$"))]
    return [c.cast("double") for c in out]


def with_candidates(docs: DataFrame, text: str = "text", labelled: bool = False) -> DataFrame:
    """Adds ``_base`` and ``_cand``: candidates outside the base spans as (s,
    kind, e, x, y); with ``labelled`` also the base spans themselves, as right."""
    rows = _with_base(docs, text)
    rows = rows.withColumn("_t", _blanked(F.col("_t"), F.col("_base")))
    rows = _found(rows, "_t", CANDIDATE, "_c")
    parts = [_rated(F.col(f"_c_{k}"), k, False) for k in KINDS]
    if labelled:
        parts += [_rated(F.col(f"_b_{k}"), k, True) for k in KINDS]
    return rows.withColumn("_cand", F.concat(*parts)).drop("_t", *[f"_{g}_{k}" for g in "bc" for k in KINDS])


@dataclass
class PiiModel:
    trees: list[tuple[float, object]]  # weight and (feature, value, left, right) or a number
    thresholds: dict[int, float]

    def rating(self, x: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + weight * self._tree(tree, x)
        return 1 / (1 + F.exp(-2 * total))

    def _tree(self, node, x: Column) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        feature, value, left, right = node
        return F.when(F.get(x, F.lit(feature)) <= value, self._tree(left, x)).otherwise(self._tree(right, x))


def read_trees(debug: str) -> list[tuple[float, object]]:
    """The trees of a pyspark.ml ensemble from its description."""
    lines = [s.strip() for s in debug.splitlines()[1:] if s.strip()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # Else
        return int(m[1]), float(m[2]), left, node()

    trees = []
    while at < len(lines):
        weight = float(re.search(r"weight (\S+)\)", lines[at])[1])
        at += 1
        trees.append((weight, node()))
    return trees


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> PiiModel | None:
    """None if there are no candidates."""
    spark = docs.sparkSession
    # the outer form: for a plain explode Spark infers a filter on the size of
    # the array and works every pattern out once more for it
    cand = with_candidates(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", True) \
        .select("_id", F.explode_outer("_cand").alias("c")).where("c is not null") \
        .select("c.x", "c.y", "c.kind", F.xxhash64("_id", "c.s", "c.kind", F.lit(3)).alias("h"))
    cand = materialize(cand, "candidates")
    tenth = F.pmod("h", F.lit(10))
    fit = [r for kind in range(len(KINDS))
           for r in cand.where((F.col("kind") == kind) & (tenth < 7)).orderBy("h", "x", "y").limit(sample).collect()]
    if not fit:
        return None
    found = PiiModel([], {})
    if len({r["y"] == RIGHT for r in fit}) == 2:
        fit.sort(key=lambda r: (r["h"], r["x"], r["y"]))
        train = spark.createDataFrame([(Vectors.dense(r["x"]), float(r["y"] == RIGHT)) for r in fit],
                                      ["x", "y"]).coalesce(1)
        model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3,
                              seed=7, maxBins=32).fit(train)
        found.trees = read_trees(model.toDebugString)
    rated = cand.where((tenth >= 7) & (F.col("y") != UNKNOWN)) \
        .select("kind", "y", F.round(found.rating(F.col("x")), DIGITS).alias("p")) \
        .groupBy("kind", "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("right")).collect()
    for kind in range(len(KINDS)):
        best, n, right = None, 0, 0
        for r in sorted((r for r in rated if r["kind"] == kind and r["p"] >= MIN_RATING), key=lambda r: -r["p"]):
            n, right = n + r["n"], right + r["right"]
            if n >= MIN_SUPPORT and right >= PRECISION * n:
                best = r["p"]
        if best is not None:
            found.thresholds[kind] = best
    return found


def with_spans(docs: DataFrame, model: PiiModel | None, text: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans``: (s, kind, e), by start, then kind."""
    if model is None or not model.thresholds:
        rows = with_base_spans(docs, text)
        return rows.withColumns({"base_spans": F.col("_base"), "spans": F.col("_base")}).drop("_base")
    rows = with_candidates(docs, text)
    rows = rows.withColumn("_new", F.transform(F.filter("_cand", lambda c: c["y"] != WRONG), lambda c: F.struct(
        c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"),
        F.round(model.rating(c["x"]), DIGITS).alias("p"))))
    rows = rows.withColumn("_new", F.array_sort(F.filter("_new", lambda c: _over(c, model.thresholds))))

    def beaten(c: Column, others: Column) -> Column:
        return F.exists(others, lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]) & (
            (o["p"] > c["p"]) | ((o["p"] == c["p"]) & (F.struct(o["s"], o["kind"], o["e"]) <
                                                       F.struct(c["s"], c["kind"], c["e"])))))

    # in order of their starts, additions that overlap one stand near it
    # unless some are very long
    short = F.forall("_new", lambda c: c["e"] - c["s"] <= NEAR_CHARS)
    rows = rows.withColumn("_short", short)
    best = F.filter("_new", lambda c, i: ~F.when(F.col("_short"), beaten(c, F.slice(
        "_new", F.greatest(F.lit(1), i + 1 - NEAR), F.lit(2 * NEAR)))).otherwise(beaten(c, F.col("_new"))))
    rows = rows.withColumn("spans", F.array_sort(F.concat("_base", _spans(best))))
    return rows.withColumn("base_spans", F.col("_base")).drop("_base", "_cand", "_new", "_short")


def _over(c: Column, thresholds: dict[int, float]) -> Column:
    found = F.lit(False)
    for kind, p in thresholds.items():
        found = found | ((c["kind"] == kind) & (c["p"] >= p))
    return found


def spans_text(spans: Column) -> Column:
    """"kind:start:end", comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
