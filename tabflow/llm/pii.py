"""Personal data: base patterns, and boosted trees over the spans of high-recall generators. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# The base patterns, spelled so that every position is looked at once. A card is a maximal run of
# digits with single separators, so a run of the wrong length can be left out by the pattern itself.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators: wider forms of the same kinds. They may overlap each other and the base spans.
WIDE = {
    "email": r"(?i)[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[\[({]\x20?at\x20?[\])}])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,4}+(?:\x20?[.]\x20?|[\[({][.][\])}])){3}+[0-9]{1,4}+(?![0-9])|(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}+:){5,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.,/])[+(]{0,2}+[0-9](?:[\x20()./-]{0,3}+[0-9]){6,14}+(?![0-9A-Za-z])",
}
GATE = {
    "email": r"(?i)@|[\[({]\x20?at\x20?[\])}]",
    "ip": r"[0-9][\])}\x20]?[.][\x20\[({]?[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    "card": r"[0-9][\x20./_-]{0,2}[0-9][\x20./_-]{0,2}[0-9][\x20./_-]{0,2}[0-9]",
    "phone": r"[0-9][\x20()./-]{0,3}[0-9][\x20()./-]{0,3}[0-9][\x20()./-]{0,3}[0-9]",
}
# Words near a span that speak for its kind (fixed values).
NEAR = {"email": "mail|contact|write|@", "ip": r"\bip\b|server|host|addr|login", "card": "card|visa|credit|iban|pay|master", "phone": "phone|tel|call|fax|mobile|cell|whatsapp"}
LEFT, RIGHT = 24, 8
SPAN = "array<struct<start:int,kind:int,end:int,found:string>>"
# What every text with a base span holds.
HINTS = r"@[A-Za-z0-9-]+\.|\+[0-9][\x20().0-9-]{6}|[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]|[0-9]\.[0-9]+\.[0-9]"
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "n_digits", "n_letters", "n_chars", "n_groups", "longest_group", "shortest_group", "n_dots", "n_seps",
    "n_spaces", "plus", "paren", "at", "luhn", "parts_ok", "first_digit", "near", "left_word", "right_word", "left_symbol", "right_symbol", "shares_domain",
)


def found_spans(text: Column, pattern: str, gate: str | None, kind: int) -> Column:
    """Matches of a pattern with code-point offsets, in order."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What lies between the matches gives the offsets.
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    spans = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
                        (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("found"),
                    )
                ),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    # Most texts have no match: one scan that stops at the first.
    return F.when(F.regexp_like(text, F.lit(gate or pattern)), spans).otherwise(F.array().cast(SPAN))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check; the empty string does not."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return (F.length(number) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), step) % 10 == 0)


def parts_ok(found: Column) -> Column:
    """Whether four numbers, all at most 255."""
    parts = F.filter(F.split(found, "[^0-9]+"), lambda p: p != "")
    small = F.forall(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    return (F.size(parts) == 4) & small


def base_spans(text: Column) -> Column:
    """All valid base spans, by start, then kind as in ``KINDS``."""
    n = lambda s: F.length(digits(s["found"]))
    valid = [
        found_spans(text, BASE["email"], "@", 0),
        F.filter(found_spans(text, BASE["ip"], None, 1), lambda s: parts_ok(s["found"])),
        F.filter(found_spans(text, BASE["card"], None, 2), lambda s: luhn(digits(s["found"]))),
        F.filter(found_spans(text, BASE["phone"], r"\+[0-9]", 3), lambda s: (n(s) >= 9) & (n(s) <= 15)),
    ]
    return F.array_sort(F.concat(*valid))


def wide_spans(text: Column) -> Column:
    return F.concat(*[found_spans(text, WIDE[k], GATE[k], i) for i, k in enumerate(KINDS)])


def described(span: Column, text: Column) -> Column:
    """Features of a span: its format, and the text around it."""
    found = span["found"]
    left = F.lower(F.substr(text, F.greatest(span["start"] - LEFT, F.lit(0)) + 1, F.least(span["start"], F.lit(LEFT))))
    right = F.substr(text, span["end"] + 1, F.lit(RIGHT))
    groups = F.filter(F.split(found, "[^0-9]+"), lambda p: p != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    count = lambda c: F.length(F.regexp_replace(found, f"[^{c}]", ""))
    near = F.lit(False)
    for i, k in enumerate(KINDS):
        near = near | ((span["kind"] == i) & left.rlike(NEAR[k]))
    values = [
        *[span["kind"] == i for i in range(4)], F.length(digits(found)), count("A-Za-z"), F.length(found), F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)), count(r"."), count(r"/_-"), count(r"\x20"),
        F.startswith(found, F.lit("+")), F.contains(found, F.lit("(")), F.contains(found, F.lit("@")), luhn(digits(found)), parts_ok(found),
        F.coalesce(F.substr(digits(found), F.lit(1), F.lit(1)).try_cast("int"), F.lit(-1)), near,
        left.rlike("[a-z0-9]$"), right.rlike("^[A-Za-z0-9]"), left.rlike(r"[#$=/:_]\x20?$"), right.rlike(r"^[%$/:_]"), found.rlike(r"\.[A-Za-z]{2,}$"),
    ]
    return F.array(*[v.cast("double") for v in values])


def variants(span: Column) -> Column:
    """A base span in other spellings (label 1), and look-alikes that are none (label 0)."""
    f, kind = span["found"], span["kind"]
    one = lambda s, y: F.struct(s.alias("found"), F.lit(y).alias("label"))
    d = digits(f)
    grouped = lambda sep: F.regexp_replace(d, "(?<=^(?:.{4}|.{8}|.{12}|.{16}))(?=.)", sep)
    wrong = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), (F.pmod(F.substr(d, F.length(d), F.lit(1)).cast("int") + 3, F.lit(10))).cast("string"))
    return (
        F.when(kind == 0, F.array(one(f, 1), one(F.replace(f, F.lit("@"), F.lit(" [at] ")), 1), one(F.replace(f, F.lit("@"), F.lit("(at)")), 1),
                                  one(F.regexp_replace(F.replace(f, F.lit("@"), F.lit(" (at) ")), r"\.", " (dot) "), 1), one(F.regexp_replace(f, "@", " @ "), 1),
                                  one(F.regexp_replace(f, r"@.*", "@2.0"), 0), one(F.regexp_replace(f, r"@.*", " @ 10.50"), 0)))
        .when(kind == 1, F.array(one(f, 1), one(F.regexp_replace(f, r"\.", "[.]"), 1), one(F.regexp_replace(f, r"\.", " . "), 1),
                                 one(F.regexp_replace(f, r"^[0-9]+", "812"), 0), one(F.regexp_replace(f, r"[0-9]+$", "1999"), 0)))
        .when(kind == 2, F.array(one(f, 1), one(grouped("."), 1), one(grouped("/"), 1), one(grouped("  "), 1), one(wrong, 0), one(F.regexp_replace(wrong, "(.{4})(?=.)", "$1."), 0)))
        .otherwise(F.array(one(f, 1), one(F.regexp_replace(f, r"^\+[0-9]+ ?", ""), 1), one(F.regexp_replace(f, r"^\+", "00"), 1),
                           one(F.regexp_replace(F.regexp_replace(f, r"^\+[0-9]+ ?", ""), r"[() -]+", "-"), 1), one(F.substr(d, F.lit(1), F.lit(8)), 0),
                           one(F.concat(F.substr(d, F.lit(2), F.lit(4)), F.lit("-"), F.substr(d, F.lit(6), F.lit(2)), F.lit("-"), F.substr(d, F.lit(8), F.lit(2))), 0)))
    )


@dataclass
class Model:
    """Boosted trees as nested tests, and the least score of each kind (over 1: the kind selects nothing)."""

    trees: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    least: tuple = (2.0,) * len(KINDS)

    def score(self, x: Column) -> Column:
        """Probability of a feature array."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            i, cut, low, high = node
            return F.when(F.element_at(x, i + 1) <= cut, walk(low)).otherwise(walk(high))

        margin = sum((walk(t) * w for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, kind: Column, score: Column) -> Column:
        out = F.lit(False)
        for i, least in enumerate(self.least):
            out = out | ((kind == i) & (score >= least))
        return out


def _nodes(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return (int(node.split().featureIndex()), float(node.split().threshold()), _nodes(node.leftChild()), _nodes(node.rightChild()))


def _examples(docs: DataFrame, key: str, text: str) -> DataFrame:
    """draw, kind, found, left, right and whether it is a base span (its other spellings are rows too): all candidates of texts that hold base spans.

    Of a text only what ``described`` looks at goes on, so a row does not grow with its text.
    """
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    around = lambda s, base: F.struct(
        s["kind"].alias("kind"), s["found"].alias("found"), F.lit(base).alias("base"), F.substr("text", F.greatest(s["start"] - LEFT, F.lit(0)) + 1, F.least(s["start"], F.lit(LEFT))).alias("left"),
        F.substr("text", s["end"] + 1, F.lit(RIGHT)).alias("right"))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(key).cast("string"), text).alias("draw")).filter(F.rlike("text", F.lit(HINTS)))
    rows = rows.select("draw", "text", base_spans(F.col("text")).alias("base"))
    other = F.filter(wide_spans(F.col("text")), lambda s: ~F.exists("base", lambda b: touch(b, s)))
    spans = F.concat(F.transform("base", lambda s: around(s, True)), F.transform(other, lambda s: around(s, False)))
    found = rows.select("draw", F.explode(F.when(F.size("base") > 0, spans)).alias("s")).select("draw", "s.*")
    as_they_are = F.array(F.struct(F.col("found"), F.lit(0).alias("label")))
    spelled = F.when(F.col("base"), variants(F.struct("kind", "found"))).otherwise(as_they_are)
    return found.select("draw", "kind", "left", "right", F.explode(spelled).alias("v")).select("draw", "kind", "left", "v.found", "right", "v.label")


def fit_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 12, depth: int = 3, precision: float = 0.98) -> Model:
    """Train on the candidates of all texts that hold base spans.

    Labels are weak: base spans and their other spellings speak for a kind, look-alikes and generator spans that touch
    no base span against it. Two thirds of the texts fit the trees, the rest set for each kind the least score at which
    the share of true spans is ``precision``. With no such text, or labels of one kind only, nothing is selected.
    """
    span = F.struct(F.length("left").alias("start"), "kind", (F.length("left") + F.length("found")).alias("end"), "found")
    rows = _examples(docs, key, text).select("draw", "label", "kind", described(span, F.concat("left", "found", "right")).alias("x"))
    rows = cut_lineage(rows.select("draw", "label", "kind", *[F.col("x")[i].alias(f) for i, f in enumerate(FEATURES)]))
    if rows.select("label").distinct().count() < 2:
        return Model()
    fit = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.filter(F.pmod(F.shiftright("draw", 32), F.lit(3)) != 0))
    if fit.select("label").distinct().count() < 2:
        return Model()
    trained = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1, maxBins=32).fit(fit)
    java = trained._java_obj
    model = Model([_nodes(t.rootNode()) for t in java.trees()], [float(w) for w in java.treeWeights()])
    held = rows.filter(F.pmod(F.shiftright("draw", 32), F.lit(3)) == 0).select("kind", "label", F.floor(model.score(F.array(*FEATURES)) * 50).cast("int").alias("bin"))
    counts = {(r.kind, r.bin): (r.n, r.good) for r in held.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()}
    least = []
    for k in range(len(KINDS)):
        n = good = 0
        best = 2.0
        for b in range(50, 24, -1):
            n, good = n + counts.get((k, b), (0, 0))[0], good + counts.get((k, b), (0, 0))[1]
            if n >= 5 and good >= precision * n:
                best = b / 50
        least.append(best)
    model.least = tuple(least)
    return model


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every whole text: all columns of ``docs`` plus ``base_found`` and ``all_found``.

    Base spans always stay. A generator span is added if it touches no base span, its score reaches the least score of
    its kind, and no touching span of the same kind of standing scores higher (ties: the earlier, then the longer).
    Null counts as empty text and has no spans. Rows are worked on one by one, nothing is shuffled.
    """
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    out = docs.withColumn("_pii_text", F.coalesce(F.col(text), F.lit(""))).withColumn("base_found", base_spans(F.col("_pii_text")))
    if not model.trees:
        return out.withColumn("all_found", F.col("base_found")).drop("_pii_text")
    free = F.filter(wide_spans(F.col("_pii_text")), lambda s: ~F.exists("base_found", lambda b: touch(s, b)))
    scored = F.transform(F.col("_pii_free"), lambda s: s.withField("score", model.score(described(s, F.col("_pii_text")))))
    chosen = F.filter(F.col("_pii_scored"), lambda s: model.selects(s["kind"], s["score"]))
    rank = lambda s: F.struct(s["score"], -s["start"], s["end"], -s["kind"])
    best = F.filter(F.col("_pii_chosen"), lambda s: ~F.exists("_pii_chosen", lambda o: touch(s, o) & (rank(o) > rank(s))))
    out = out.withColumn("_pii_free", free).withColumn("_pii_scored", scored).withColumn("_pii_chosen", chosen)
    out = out.withColumn("all_found", F.array_sort(F.concat("base_found", F.transform(best, lambda s: s.dropFields("score")))))
    return out.drop("_pii_text", "_pii_free", "_pii_scored", "_pii_chosen")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of touching spans the first names the place."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    parts = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), names[s["kind"]]))).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, parts).otherwise(text)


def redact(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with spans of personal data replaced; a null text stays null. Other columns stay as they are, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    found = personal_data(rows, model, "row", "text")
    return found.select(*[redacted(F.col("text"), F.col("all_found")).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def span_digest(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans and all spans, for every row."""
    found = personal_data(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, "key", "text")

    def of_kind(i: int) -> Column:
        return F.size(F.filter("base_found", lambda s: s["kind"] == i)).cast("long")

    return found.select(
        F.col("key").alias(key),
        *[of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base_found")), 256).alias("base_sha256"),
        joined(F.col("all_found")).alias("spans"),
    )
