"""Quality rules by distribution divergence (operator 8), DataFrame functions
only.

Base rules: number of words, words in 3-word windows that occur twice or more
in the text, symbols, and repeated lines (see :func:`with_base_rules`).

Divergence: every language is described by two histograms over *all* its
documents, the shares of the character classes and the shares of its
``TOP_WORDS`` most frequent words among themselves.  A language has a usable
reference from ``MIN_LANG_CHARS`` characters, whatever its share.  A
document's histograms are compared by the Jensen-Shannon distance (base 2, 0
to 1) with those of its own language and of every large one (at least
``MIN_LANG_SHARE`` of all characters; that many are always looked at, the
others only where it matters).  A document that is far from all of these, or
has no ``lang`` where no language is large, is also compared with every other
language that shares a frequent word with it.  The nearest counts, so
a missing or a wrong ``lang`` does no harm, and a language's documents are
judged alike on both sides of ``MIN_LANG_SHARE``.  A document is rejected if it is
farther than ``MAX_CHAR_DISTANCE`` or ``MAX_WORD_DISTANCE`` from all of them;
where its ``lang`` has no usable reference, both distances stay silent.  Short
texts have ragged histograms: the character distance only speaks from
``MIN_CHARS`` characters, the word distance from ``MIN_WORDS`` words, of
which the expected share of frequent words would give a usable histogram.

The large languages are collected (at most ``1 / MIN_LANG_SHARE``, with
``TOP_WORDS`` words each); all others stay a table that documents meet by
``lang``, broadcast up to ``BROADCAST_LANGS`` rows and joined beyond.  For far
documents that table is a constant of the expression, ``BROADCAST_LANGS``
languages at a time.

Defined cases: null text is the empty text; repeated rows are judged alike;
with no language at all (empty table, null ``lang`` everywhere) only the base
rules judge; other columns are kept, columns of the added names are replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, let, no_null

TOP_WORDS = 24
#: languages from this share on are compared with every document
MIN_LANG_SHARE = 0.01
#: characters that a language below that share needs for a reference
MIN_LANG_CHARS = 10_000
BROADCAST_LANGS = 5_000
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.75
#: repeated-window keys up to this many are looked up one by one; more are
#: found by sorting -- two ways to the same positions
FEW_KEYS = 48

#: character classes as regular expressions of what is *not* in them
CLASSES = {
    "lower": r"[^a-z]+",
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "mark": r"[^.,;:!?'\"()-]+",
    "symbol": r"[^#*$%&|<>@^~=+_/\\{}\[\]`]+",
}


@dataclass
class Reference:
    """Shares of character classes and of frequent words: of the large
    languages as literals, of the ``n_small`` others as a table (``_l``, ``_q``
    by character class, ``_v`` by word)."""

    chars: dict[str, dict[str, float]]
    words: dict[str, dict[str, float]]
    small: DataFrame | None = None
    n_small: int = 0


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _class_counts(text: Column) -> dict[str, Column]:
    counts = {f"_n_{k}": F.length(F.regexp_replace(text, rx, "")) for k, rx in CLASSES.items()}
    return counts | {"_n_all": F.length(text)}


def fit_reference(docs: DataFrame, text: str = "text", lang: str = "lang") -> Reference:
    """Histograms of every language, over all documents."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_l"),
                                                      no_null(F.col(text)).alias("_t"))
    sums = rows.select("_l", F.struct(*[c.alias(k) for k, c in _class_counts(F.col("_t")).items()]).alias("c")) \
               .groupBy("_l").agg(*[F.sum(f"c.{k}").alias(k) for k in _class_counts(F.col("_t"))])
    sums = materialize(sums.where(F.col("_n_all") > 0), "languages")
    total = sums.agg(F.sum("_n_all")).first()[0] or 0
    is_large = F.col("_n_all") >= MIN_LANG_SHARE * total
    large = sums.where(is_large).collect()
    small = sums.where(~is_large & (F.col("_n_all") >= MIN_LANG_CHARS))
    n_small = small.count()
    chars = {}
    for r in sorted(large, key=lambda r: r["_l"]):
        shares = {k: r[f"_n_{k}"] / r["_n_all"] for k in CLASSES}
        chars[r["_l"]] = shares | {"other": max(0.0, 1.0 - sum(shares.values()))}
    words: dict[str, dict[str, float]] = {}
    top = _top_words(rows.where(F.col("_l").isin(list(chars)))).collect()
    for name in chars:
        own = sorted(((r["w"], r["count"]) for r in top if r["_l"] == name))
        words[name] = {w: n / sum(n for _, n in own) for w, n in own}
    if not n_small:
        return Reference(chars, words)
    few = _top_words(_by_lang(rows, "_l", small.select("_l"), n_small, list(chars), "inner"))
    share = F.struct("w", F.col("count") / F.sum("count").over(Window.partitionBy("_l")))
    few = few.select("_l", share.alias("_e")).groupBy("_l") \
             .agg(F.map_from_entries(F.collect_list("_e")).alias("_v"))
    rest = F.lit(1.0)
    for k in CLASSES:
        rest = rest - F.col(f"_n_{k}") / F.col("_n_all")
    shares = [(F.col(f"_n_{k}") / F.col("_n_all")).alias(k) for k in CLASSES]
    small = small.select("_l", F.struct(*shares, F.greatest(rest, F.lit(0.0)).alias("other")).alias("_q"))
    return Reference(chars, words, materialize(small.join(few, "_l", "left"), "small_languages"), n_small)


def _top_words(rows: DataFrame) -> DataFrame:
    """(_l, w, count): the most frequent words of every language."""
    # the outer form: a plain explode would work the words out twice, once
    # for an inferred filter on the size of the array
    counts = rows.select("_l", F.explode_outer(_words(F.lower("_t"))).alias("w")) \
                 .where("w is not null").groupBy("_l", "w").count()
    order = Window.partitionBy("_l").orderBy(F.desc("count"), "w")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= TOP_WORDS).drop("_r")


def _by_lang(rows: DataFrame, lang: str, side: DataFrame, n: int, large: list[str], how: str) -> DataFrame:
    """Joins the table of small languages (``_l``) to rows by their ``lang``.
    Where it is too large for a broadcast, rows of large languages or without
    one stay out of the shuffle, so that no key holds many rows."""
    side = side.withColumnRenamed("_l", "_sl")
    on = F.col(lang).cast("string") == F.col("_sl")
    if n <= BROADCAST_LANGS:
        return rows.join(F.broadcast(side), on, how).drop("_sl")
    met = F.coalesce(~F.col(lang).cast("string").isin(large), F.lit(False))
    out = rows.where(met).join(side, on, how)
    if how == "left":
        out = out.unionByName(rows.where(~met), allowMissingColumns=True)
    return out.drop("_sl")


def _xlog(p, m) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def _char_distance(shares: dict[str, Column], ref: dict[str, float] | Column) -> Column:
    total = F.lit(0.0)
    for k, p in shares.items():
        q = ref[k] if isinstance(ref, Column) else F.lit(float(ref[k]))
        m = (p + q) / 2
        total = total + (_xlog(p, m) + _xlog(q, m)) / 2
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _word_distance(entries: Column, ref: dict[str, float] | Column) -> Column:
    """``entries``: (w, p) of the frequent words that the document has; a
    reference word that it lacks adds half its share."""
    table = ref if isinstance(ref, Column) else F.create_map(*[F.lit(x) for kv in ref.items() for x in kv])

    def term(e: Column) -> Column:
        q = F.coalesce(F.element_at(table, e["w"]), F.lit(0.0))
        m = (e["p"] + q) / 2
        return (_xlog(e["p"], m) + _xlog(q, m) - q) / 2

    total = F.aggregate(entries, F.lit(0.5), lambda acc, e: acc + term(e))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def with_base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``; keeps the words as ``_w``."""
    text = no_null(F.col(text))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    rows = docs.withColumns({"_w": _words(text), "_lines": lines})
    words = F.col("_w")
    rows = rows.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        # one key for each window of three words
        "_k": F.when(F.size("_w") > 3, F.slice(F.transform(
            words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
            F.lit(1), F.size("_w") - 2)),
    }).drop("_lines")
    rows = rows.withColumn("_s", F.sort_array("_k"))
    sorted_keys, keys = F.col("_s"), F.col("_k")
    rows = rows.withColumn("_d", F.array_distinct(F.filter(
        sorted_keys, lambda k, i: (i > 0) & (k == F.get(sorted_keys, i - 1))))).drop("_s")
    twice = F.col("_d")
    at = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    rows = rows.withColumn("_at", F.when(F.size("_d") > FEW_KEYS, F.array_sort(at)))
    by_key = F.col("_at")
    few = F.filter(F.transform(keys, lambda k, i: F.when(F.array_contains(twice, k), i)),
                   lambda i: i.isNotNull())
    many = F.array_sort(F.transform(F.filter(by_key, lambda x, j: (
        (j > 0) & (x["k"] == F.get(by_key, j - 1)["k"])) | F.coalesce(
            x["k"] == F.get(by_key, j + 1)["k"], F.lit(False))), lambda x: x["i"]))
    rows = rows.withColumn("_p", F.when(F.size("_d") > FEW_KEYS, many).when(F.size("_d") > 0, few))
    starts = F.col("_p")
    covered = F.aggregate(
        F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3)))),
        F.lit(0), lambda acc, x: acc + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")) \
               .drop("_k", "_d", "_at", "_p")
    return rows.withColumn("base_failed", (F.col("n_words") < 50)
                           | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _small_constants(ref: Reference) -> list[Column]:
    """The small languages as constant arrays of (q, v), ``BROADCAST_LANGS`` in each."""
    names = [*CLASSES, "other"]
    kind = "array<struct<q:struct<" + ",".join(f"{k}:double" for k in names) + ">,v:map<string,double>>>"
    found, part = [], []
    for r in ref.small.orderBy("_l").toLocalIterator():
        part.append({"q": r["_q"].asDict(), "v": r["_v"] or {}})
        if len(part) == max(1, BROADCAST_LANGS):
            found.append(part)
            part = []
    return [F.from_json(F.lit(json.dumps(p)), kind) for p in [*found, part] if p]


def _entries(lower: Column, wanted) -> Column:
    """(w, p) of the wanted words of a document, by word."""
    def runs(f: Column) -> Column:
        first = F.filter(F.transform(f, lambda w, i: F.when((i == 0) | (w != F.get(f, i - 1)), i)),
                         lambda i: i.isNotNull())
        return let(F.struct(f.alias("f"), first.alias("b")), lambda x: F.transform(x["b"], lambda s, j: F.struct(
            F.get(x["f"], s).alias("w"),
            ((F.coalesce(F.get(x["b"], j + 1), F.size(x["f"])) - s) / F.size(x["f"])).alias("p"))))

    return let(F.sort_array(F.filter(lower, wanted)), runs)


def _nearest_small(rows: DataFrame, ref: Reference, shares: dict[str, Column], frequent: list[str]) -> DataFrame:
    """Both distances of far documents, and of those without ``lang`` where no
    language is large, to the nearest small language too."""
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) \
        | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    if not ref.chars:
        far = far | F.col("_own").isNull()

    def against(r: Column, lower: Column) -> Column:
        return let(_entries(lower, lambda w: w.isin(frequent) | F.map_contains_key(r["v"], w)),
                   lambda e: F.struct(_char_distance(shares, r["q"]).alias("c"), _word_distance(e, r["v"]).alias("w")))

    near = [let(F.transform("_w", lambda w: F.lower(w)), lambda lower: F.transform(
        F.filter(refs, lambda r: F.arrays_overlap(F.map_keys(r["v"]), lower)), lambda r: against(r, lower)))
        for refs in _small_constants(ref)]
    rows = rows.withColumn("_near", F.when(far, F.concat(*near) if len(near) > 1 else near[0]))
    some = F.size("_near") > 0
    char = F.array_min(F.transform("_near", lambda x: x["c"]))
    word = F.array_min(F.transform("_near", lambda x: x["w"]))
    return rows.withColumns({
        "char_distance": F.when(some & (F.col("_n_all") >= MIN_CHARS), F.least("char_distance", char))
        .otherwise(F.col("char_distance")),
        "word_distance": F.when(some & (F.col("n_words") >= MIN_WORDS), F.least("word_distance", word))
        .otherwise(F.col("word_distance"))}).drop("_near")


def with_verdict(docs: DataFrame, ref: Reference, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the base rules, ``char_distance``, ``word_distance`` (null where
    the guard or a ``lang`` without a usable reference keeps them silent) and
    ``kept``.  Without a column ``lang`` no document has one."""
    name = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    docs = docs.withColumn("_own", name).drop("_q", "_v", "_sl")
    if ref.n_small:
        docs = _by_lang(docs, "_own", ref.small, ref.n_small, list(ref.chars), "left")
    rows = with_base_rules(docs, text).withColumns(_class_counts(no_null(F.col(text))))
    if not ref.chars and not ref.n_small:
        none = F.lit(None).cast("double")
        rows = rows.withColumns({"char_distance": none, "word_distance": none})
    else:
        rest = F.col("_n_all")
        for k in CLASSES:
            rest = rest - F.col(f"_n_{k}")
        shares = {k: F.col(f"_n_{k}") / F.col("_n_all") for k in CLASSES} | {"other": rest / F.col("_n_all")}
        usable = F.coalesce(F.col("_own").isin(list(ref.chars)), F.lit(bool(ref.chars)))
        chars = [_char_distance(shares, r) for r in ref.chars.values()]
        if ref.n_small:
            usable = usable | F.col("_q").isNotNull()
            chars.append(F.when(F.col("_q").isNotNull(), _char_distance(shares, F.col("_q"))))
        frequent = sorted({w for r in ref.words.values() for w in r})
        rows = rows.withColumn("char_distance", F.when(
            usable & (F.col("_n_all") >= MIN_CHARS), F.array_min(F.array(*chars))))

        def counts(w: Column) -> Column:
            known = w.isin(frequent)
            return known | F.coalesce(F.map_contains_key("_v", w), F.lit(False)) if ref.n_small else known

        rows = rows.withColumn("_f", F.sort_array(F.filter(F.transform("_w", lambda w: F.lower(w)), counts)))
        f = F.col("_f")
        rows = rows.withColumn("_b", F.filter(
            F.transform(f, lambda w, i: F.when((i == 0) | (w != F.get(f, i - 1)), i)), lambda i: i.isNotNull()))
        b = F.col("_b")
        rows = rows.withColumn("_e", F.transform(b, lambda s, j: F.struct(
            F.get(f, s).alias("w"),
            ((F.coalesce(F.get(b, j + 1), F.size(f)) - s) / F.size(f)).alias("p"))))
        # without any frequent word the histograms share nothing: distance 1
        words = [_word_distance(F.col("_e"), r) for r in ref.words.values() if r]
        if ref.n_small:
            words.append(F.when(F.col("_v").isNotNull(), _word_distance(F.col("_e"), F.col("_v"))))
        word = F.when(F.size("_e") == 0, F.lit(1.0)).otherwise(F.array_min(F.array(*words))) if words else F.lit(1.0)
        rows = rows.withColumn("word_distance", F.when(usable & (F.col("n_words") >= MIN_WORDS), word)) \
                   .drop("_f", "_b", "_e")
        if ref.n_small:
            rows = _nearest_small(rows, ref, shares, frequent)
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) \
        | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & ~far) \
               .drop("_w", "_n_all", "_own", "_q", "_v", *[f"_n_{k}" for k in CLASSES])
