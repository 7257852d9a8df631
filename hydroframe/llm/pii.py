"""Personal data: patterns propose spans, boosted trees judge those that the base rules do not settle.

All of it is DataFrame work: spans are found with Spark's regular expressions, Spark ML fits the trees, and their
splits become one expression, so candidates are judged in the row that holds them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import text_of, unit_hash, written

KINDS = ["email", "ip", "card", "phone"]

#: The base rules' patterns. Possessive repeats and starts (at the end of the last match, or where no character before
#: could be part of the match) change no match; they keep long runs from being tried from each of their characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: High-recall generators, by kind: they may overlap the base spans and each other.
LOOSE = {
    "email": r"(?:\G|(?<![^\s@<>\x22',;]))[^\s@<>\x22',;]++@[^\s@<>\x22',;]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20./_-]{1,2}+[0-9]++)*+",
    "phone": r"(?:\G|(?<![0-9]))(?:00|\(|[0-9])[0-9().\x20/-]{6,}[0-9]",
}

#: Labelled candidates that the trees are fitted to, least hashes first.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 10, 3, 5
#: A threshold must have this precision on all labelled candidates of its kind, and so many true ones above it.
PRECISION, LEAST_TRUE = 0.99, 20

_NONE = "array<struct<value:string,start:int,end:int,before:string,after:string>>"
FEATURES = ["kind", "length", "digits", "letters", "separators", "dots", "luhn", "octets", "plus", "at", "host", "word_before", "word_after", "cue"]
#: A host's name after the ``@``: a dot and a last part of letters, then no letter or digit.
_HOST = r"@[^@]*\.\p{L}{2,}[^\p{L}\p{N}]*$"
_CUES = r"(?i)(mail|phone|tel|call|fax|card|visa|credit|ip|host|addr)"


def _running(lengths: Column) -> Column:
    """Running sums, in blocks of 256: appending to an array copies it."""
    size = 256
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), lambda b: F.slice(lengths, b * size + 1, size))
    zero = F.array().cast("array<int>")
    sums = lambda xs: F.aggregate(xs, zero, lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    inner = F.transform(blocks, sums)
    ends = sums(F.transform(inner, lambda xs: F.element_at(xs, -1)))
    return F.flatten(F.zip_with(inner, ends, lambda xs, e: F.transform(xs, lambda x: x + e - F.element_at(xs, -1))))


def _with_spans(d: DataFrame, name: str, pattern: str) -> DataFrame:
    """``d`` (it has ``text``) with all matches in ``name``: the pieces between them tell where they stand."""
    d = d.withColumn("_v", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    d = d.withColumn("_p", F.when(F.size("_v") > 0, F.split("text", pattern, -1)))
    d = d.withColumn("_e", F.when(F.size("_v") > 0, _running(F.transform("_v", lambda v, i: F.length(v) + F.length(F.get("_p", i))))))
    span = lambda v, i: F.struct(
        v.alias("value"), (F.get("_e", i) - F.length(v)).alias("start"), F.get("_e", i).alias("end"),
        F.right(F.get("_p", i), F.lit(24)).alias("before"), F.left(F.get("_p", i + 1), F.lit(1)).alias("after"),
    )
    return d.withColumn(name, F.when(F.size("_v") > 0, F.transform("_v", span)).otherwise(F.array().cast(_NONE))).drop("_v", "_p", "_e")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's check."""
    digits = _digits(value)

    def weighed(c: Column, i: Column) -> Column:
        x = c.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.(?!$)|$)){4}$")


def _valid(kind: str, value: Column) -> Column:
    """The base rules' checks."""
    n = F.length(_digits(value))
    return {"email": F.lit(True), "ip": _octets(value), "card": n.between(14, 19) & _luhn(value), "phone": n.between(10, 15)}[kind]


def _features(kind: str, s: Column) -> Column:
    v = s["value"]
    n = lambda chars: F.length(F.regexp_replace(v, f"[^{chars}]+", ""))
    values = {
        "kind": F.lit(KINDS.index(kind)), "length": F.least(F.length(v), F.lit(200)), "digits": F.least(n("0-9"), F.lit(200)),
        "letters": F.least(n("A-Za-z"), F.lit(200)), "separators": F.least(n(r"\x20()/_-"), F.lit(50)), "dots": F.least(n("."), F.lit(50)),
        "luhn": _luhn(v), "octets": _octets(v), "plus": v.startswith("+") | v.startswith("00"), "at": n("@"),
        "host": v.rlike(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), "word_before": s["before"].rlike(r"[\p{L}\p{N}.@+-]$"),
        "word_after": s["after"].rlike(r"^[\p{L}\p{N}@]"), "cue": s["before"].rlike(_CUES),
    }
    return F.array(*(values[k].cast("double") for k in FEATURES))


def _span(kind: str, s: Column, *more: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), *more)


def candidates(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` of each row, the ``base`` spans (``start``, ``kind`` number, ``end``), ``labelled`` candidates (matches of the
    base patterns: ``y`` is 1 if they pass the checks; and loose addresses without a host's name: 0) and ``loose`` ones, both with their features ``x``."""
    d = docs.select(F.struct(*keep).alias("_row"), text_of().alias("text"))
    for kind, pattern in BASE.items():
        d = _with_spans(d, f"b_{kind}", pattern)
    for kind, pattern in LOOSE.items():
        d = _with_spans(d, f"l_{kind}", pattern)

    def passed(kind: str) -> Column:
        return F.transform(F.filter(f"b_{kind}", lambda s: _valid(kind, s["value"])), lambda s: _span(kind, s))

    def labelled(kind: str, spans: Column, y: Callable[[Column], Column]) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), y(s["value"]).cast("int").alias("y"), _features(kind, s).alias("x")))

    def known(kind: str) -> Column:
        return labelled(kind, F.col(f"b_{kind}"), lambda v: _valid(kind, v))

    def hostless() -> Column:
        """The base pattern of addresses has no false matches: loose ones beside its matches, without a host's name, are."""
        beside = lambda s: ~F.exists("b_email", lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"]))
        return labelled("email", F.filter("l_email", lambda s: _plausible("email", s["value"]) & ~s["value"].rlike(_HOST) & beside(s)), lambda v: F.lit(0))

    def open_(kind: str) -> Column:
        return F.transform(F.filter(f"l_{kind}", lambda s: _plausible(kind, s["value"])), lambda s: _span(kind, s, _features(kind, s).alias("x")))

    return d.select(
        "_row", F.sort_array(F.concat(*map(passed, KINDS))).alias("base"), F.concat(*map(known, KINDS), hostless()).alias("labelled"),
        F.concat(*map(open_, LOOSE)).alias("loose"),
    )


def _plausible(kind: str, value: Column) -> Column:
    """What a loose match must have to be judged: a bare run of digits is no phone number."""
    n = F.length(_digits(value))
    return {"email": F.length(value) <= 320, "card": n.between(13, 19), "phone": n.between(7, 15) & value.rlike(r"^00|[().\x20/-]")}[kind]


def fitted(found: DataFrame) -> GBTClassificationModel | None:
    """Boosted trees over at most ``TRAIN_ROWS`` labelled candidates; none if all have one label."""
    rows = found.select(F.explode("labelled").alias("c")).select("c.*")
    rows = rows.withColumn("u", unit_hash(F.array_join("x", " "), F.monotonically_increasing_id(), seed=SEED)).orderBy("u").limit(TRAIN_ROWS)
    rows = written(rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")), "training")
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(rows)


def probability(model: GBTClassificationModel, x: Column) -> Column:
    """The model as an expression of an array of features: nested comparisons, summed over the trees."""

    def of(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.get(x, F.lit(split.featureIndex())) <= F.lit(float(split.threshold())), of(node.leftChild())).otherwise(of(node.rightChild()))

    margin = reduce(lambda a, b: a + b, (of(t._call_java("rootNode")) * F.lit(float(w)) for t, w in zip(model.trees, model.treeWeights, strict=True)))
    return 1 / (1 + F.exp(-2 * margin))


def thresholds(found: DataFrame, model: GBTClassificationModel) -> dict[int, float]:
    """By kind, the least score (in hundredths) from which up the labelled candidates have the precision asked for. All
    of them count; what is collected is a row for each kind, label and hundredth. A kind whose candidates all have one
    label has no threshold: nothing tells its true ones from others."""
    scored = found.select(F.explode("labelled").alias("c")).select("c.kind", "c.y", F.floor(probability(model, F.col("c.x")) * 100).cast("int").alias("p"))
    out: dict[int, float] = {}
    counts = {(r["kind"], r["p"], r["y"]): r["count"] for r in scored.groupBy("kind", "p", "y").count().collect()}
    for kind in range(len(KINDS)):
        if len({y for k, _, y in counts if k == kind}) < 2:
            continue
        true = false = 0
        for p in range(100, -1, -1):
            true, false = true + counts.get((kind, p, 1), 0), false + counts.get((kind, p, 0), 0)
            if true >= LEAST_TRUE and true >= PRECISION * (true + false):
                out[kind] = p / 100
    return out


def redactions(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` of each row, its ``base`` spans and the ``added`` ones (``start``, ``kind``, ``end``, code points).

    A loose candidate is added if its score reaches its kind's threshold, it overlaps no base span, and no
    better one that is added overlaps it. Texts are read once; candidates wait in a written table for the thresholds. Null and
    empty texts have no spans; repeated rows are judged each; without labelled candidates of both labels nothing is added; an
    empty table gives an empty result.
    """
    found = written(candidates(docs, keep), "candidates")
    model = fitted(found)
    least = thresholds(found, model) if model else {}
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    if not least:
        return found.select("_row", "base", none.alias("added"))
    at = lambda s: reduce(lambda a, kind: F.when(s["kind"] == kind, least[kind]).otherwise(a), least, F.lit(2.0))
    scored = F.transform("loose", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), probability(model, s["x"]).alias("score")))
    over = lambda s, t: (s["start"] < t["end"]) & (t["start"] < s["end"])
    d = found.withColumn("scored", scored)
    d = d.withColumn("free", F.filter("scored", lambda s: (s["score"] >= at(s)) & ~F.exists("base", lambda t: over(s, t))))
    return d.select("_row", "base", _best(F.col("free")).alias("added"))


def _best(free: Column) -> Column:
    """Spans from the best down, each added if it overlaps none added already; in the order they stand in the text."""
    over = lambda s, t: (s["start"] < t["end"]) & (t["start"] < s["end"])
    ranked = F.array_sort(F.transform(free, lambda s: F.struct((-s["score"]).alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<rank:double,kind:int,start:int,end:int>>")
    added = F.aggregate(ranked, none, lambda a, s: F.when(F.exists(a, lambda t: over(s, t)), a).otherwise(F.concat(a, F.array(s))))
    return F.sort_array(F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), (-s["rank"]).alias("score"))))


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the counts of base spans by kind, ``base_sha256``, and all ``spans`` as text."""
    d = redactions(docs, [F.col("doc_id")])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    plain = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    both = F.sort_array(F.concat("base", plain))
    sha = F.sha2(_listed(F.col("base")).cast("binary"), 256)
    return d.select("_row.doc_id", *map(count, KINDS), sha.alias("base_sha256"), _listed(both).alias("spans"))
