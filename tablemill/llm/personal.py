"""Personal data: exact patterns first, then boosted trees over candidates that broad patterns propose."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, columns_of, stored, text_of

KINDS = ("email", "ip", "card", "phone")

# Possessive loops take what greedy ones would, without stack or retries. A match begins where a
# run of its first characters begins or where the match before it ended, so a long run is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: What may be personal data, one broad pattern for each kind; their spans may overlap.
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[{]at[)\]}]|\x20at\x20)\x20?"
             r"[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{]dot[)\]}]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,24}+){1,4}+",
    "ip": r"(?<![0-9])[0-9]{1,5}+(?:[.,:][0-9]{1,5}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,5}+\)?){2,5}+(?![0-9])",
}
#: Words before a candidate that tell of it.
CUES = {
    "email": "mail|contact|write|schreib|escrib|courriel|correo",
    "ip": r"\bip\b|addr|server|host|login|node",
    "card": "card|visa|credit|karte|tarjeta|carte|pay",
    "phone": "phone|tel|call|fax|mobil|whatsapp|ruf|llam|appel",
}
BEFORE = 32
SPANS = "array<struct<s:int,kind:int,e:int>>"
#: None tells a form that the exact patterns read from one that they miss: plus is + or 00, spelled is at or dot as words.
FEATURES = ["length", "digits", "letters", "blanks", "dots", "dashes", "groups", "plus", "brackets", "spelled",
            "loose", "luhn", "joined", *[f"is_{k}" for k in KINDS], *[f"cue_{k}" for k in KINDS]]

#: At in brackets, and dot in brackets or as a word; a dot before a blank, as sentences end.
SPELLED = r"[(\[{](?:at|dot)[)\]}]|\x20dot\x20"
LOOSE = r"\.\x20"

TREES, DEPTH = 12, 3
#: Candidates that did not train: from the threshold of a kind on, so many of them are personal data.
PRECISION = 0.98
#: With fewer held-out candidates above it, a threshold is not trusted, and nothing of the kind is added.
ENOUGH = 25


def places(text: Column, pattern: str) -> Column:
    """[(s, e, m)]: leftmost matches that do not overlap, in code points, end exclusive.

    The texts between matches come from a split at the same pattern, so places
    are sums of lengths and no mark is put into the text.
    """
    empty = "CAST(array() AS array<struct<s:int,e:int,m:string>>)"

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.expr(empty).alias("out"))

        def add(state: Column, x: Column) -> Column:
            begin = state["at"] + x["g"]
            end = begin + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
                begin.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))
        return F.when(F.size(found) == 0, F.expr(empty)).otherwise(F.aggregate(pairs, start, add)["out"])
    return bind(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """The sum of digits, every second from the right doubled and its digits summed, ends in 0."""
    each = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: bind(
        c.try_cast("int"),
        lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """[(s, kind, e)] sorted by start, then kind: 0 email, 1 ip, 2 card, 3 phone."""
    none = "CAST(array() AS array<struct<s:int,e:int,m:string>>)"
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    emails = F.when(F.contains(text, F.lit("@")), places(text, EMAIL)).otherwise(F.expr(none))
    ips = F.filter(places(text, IP), lambda x: x["m"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
    cards = F.filter(places(text, CARD), lambda x: F.when(
        F.length(_digits(x["m"])).between(12, 19), _luhn(x["m"])).otherwise(F.lit(False)))
    phones = F.when(F.contains(text, F.lit("+")), F.filter(
        places(text, PHONE), lambda x: F.length(_digits(x["m"])).between(9, 15))).otherwise(F.expr(none))

    def of_kind(k: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("kind"), x["e"].alias("e"))
    return F.array_sort(F.concat(*[
        F.transform(one, of_kind(k)).cast(SPANS) for k, one in enumerate((emails, ips, cards, phones))]))


def candidates(text: Column) -> Column:
    """[(s, kind, e, features)] of the broad patterns, in no order."""
    def count(m: Column, chars: str) -> Column:
        return F.length(F.regexp_replace(m, f"[^{chars}]", "")).cast("double")

    def described(k: int):
        return lambda x: features(x, k)

    def features(x: Column, k: int) -> Column:
        m = x["m"]
        before = F.lower(F.substring(text, F.greatest(x["s"] + 1 - BEFORE, F.lit(1)),
                                     F.least(x["s"], F.lit(BEFORE))))
        touches = F.substring(text, x["e"] + 1, 1).rlike("[A-Za-z0-9@]").cast("double")
        values = [F.length(m).cast("double"), count(m, "0-9"), count(m, "A-Za-z"), count(m, r"\x20"),
                  count(m, "."), count(m, r"\-"),
                  F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), 0)).cast("double"),
                  m.rlike(r"^(?:\+|00)").cast("double"), count(m, r"(\[{"),
                  F.size(F.regexp_extract_all(m, F.lit(SPELLED), 0)).cast("double"),
                  count(F.regexp_replace(m, LOOSE, "\u0001"), "\u0001"),
                  _luhn(m).cast("double") if k == 2 else F.lit(0.0), touches,
                  *[F.lit(float(i == k)) for i in range(len(KINDS))],
                  *[before.rlike(CUES[c]).cast("double") for c in KINDS]]
        return F.struct(x["s"].alias("s"), F.lit(k).alias("kind"), x["e"].alias("e"),
                        F.array(*values).alias("f"))

    kind_ = "array<struct<s:int,kind:int,e:int,f:array<double>>>"
    email = F.when(F.contains(text, F.lit("@")) | text.rlike(r"at[)\]}\x20]"),
                   F.transform(places(text, BROAD["email"]), described(0)))
    rest = [F.when(text.rlike("[0-9]"), F.transform(places(text, BROAD[kind]), described(k)))
            for k, kind in enumerate(KINDS) if k]
    return F.concat(*[F.coalesce(one.cast(kind_), F.array().cast(kind_)) for one in (email, *rest)])


@dataclass
class Proposer:
    """Trees as a column expression, and each kind's threshold; null: the kind adds nothing."""

    model: GBTClassificationModel
    thresholds: list[float | None]

    def score(self, features: Column) -> Column:
        """The sum of the trees' weighted answers, half the log odds."""
        def answer(node) -> Column:
            if node.subtreeDepth() == 0:
                return F.lit(float(node.prediction()))
            split = node.split()
            return F.when(features[split.featureIndex()] <= float(split.threshold()),
                          answer(node.leftChild())).otherwise(answer(node.rightChild()))
        total = F.lit(0.0)
        for weight, tree in zip(self.model.treeWeights, self.model.trees):
            total = total + F.lit(float(weight)) * answer(tree._call_java("rootNode"))
        return total

    def chosen(self, x: Column) -> Column:
        wanted = F.lit(False)
        for k, limit in enumerate(self.thresholds):
            if limit is not None:
                wanted = wanted | ((x["kind"] == k) & (self.score(x["f"]) >= F.lit(limit)))
        return wanted


def rewritten(m: Column, kind: Column, word: Column) -> Column:
    """[(form, real)]: a vouched match in forms that the exact patterns do not read, and
    decoys that are like them but not personal data; ``word`` is a word that stands before it."""
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    dot = {x: F.regexp_replace(host, r"\.", x) for x in (" dot ", "[dot]", "(dot)")}
    bare, digits = F.substring(m, 2, 100), _digits(m)
    last = F.right(digits, F.lit(1)).try_cast("int")
    wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((last + 1) % 10).cast("string"))

    def forms(*each: tuple[Column, bool]) -> Column:
        return F.array(*[F.struct(f.alias("form"), F.lit(real).alias("real")) for f, real in each])

    def dotted(d: Column) -> Column:
        return F.regexp_replace(d, r"([0-9]{4})(?=[0-9])", "$1.")
    part = F.split(m, r"\.")
    return (F.when(kind == 0, forms(
        (F.concat(name, F.lit(" at "), host), True), (F.concat(name, F.lit(" at "), dot[" dot "]), True),
        (F.concat(name, F.lit("[at]"), dot["[dot]"]), True), (F.concat(name, F.lit(" (at) "), host), True),
        (F.concat(name, F.lit("(at)"), dot["(dot)"]), True), (F.concat(word, F.lit(" at "), host), False),
        (F.concat(word, F.lit(" at "), word, F.lit(". "), F.initcap(word)), False)))
        .when(kind == 1, forms((F.array_join(F.transform(
            part, lambda x: (F.coalesce(x.try_cast("int"), F.lit(0)) + 256).cast("string")), "."), False),
            (F.array_join(part, ","), False)))
        .when(kind == 2, forms((dotted(digits), True), (dotted(wrong), False)))
        .otherwise(forms(
            (F.concat(F.lit("00"), bare), True), (F.concat(F.lit("00"), F.regexp_replace(bare, r"[\x20-]+", ".")), True),
            (F.concat(F.lit("00"), F.regexp_replace(bare, r"[\x20-]+", "/")), True),
            (F.concat(F.lit("phone "), bare), True),
            (F.regexp_replace(digits, r"^.?([0-9]{2})([0-9])([0-9])([0-9])([0-9]).*$", "20$1-0$2-1$3 1$4-3$5"), False),
            (F.regexp_replace(digits, r"^([0-9]{1,3})([0-9]{3})([0-9]{3})([0-9]{1,3}).*$", "$1.$2.$3.$4"), False),
            (F.substring(bare, 1, 9), False), (F.concat(F.lit("00"), F.substring(bare, 1, 9)), False))))


def labelled(docs: DataFrame) -> DataFrame:
    """Distinct (kind, features, is_personal, held, fresh) of candidates of all documents, stored.

    Personal are the base spans' candidates and, fresh, those of base spans rewritten in forms that
    the exact patterns do not read. Not personal, and fresh, are the decoys, and candidates
    that their own text speaks against: another kind's base span overlaps them, a card's check
    digit is wrong, a phone has under 9 or over 15 digits, an e-mail runs on into the next sentence, and
    what is like an address of four numbers but is none. Any other candidate may be either and is left out.
    """
    digest = F.xxhash64("doc_id", "text")
    some = stored(docs.select(digest.alias("digest"), text_of().alias("text"), base_spans(text_of()).alias("base")), "vouched")

    def over(b: Column, x: Column) -> Column:
        return (b["s"] < x["e"]) & (b["e"] > x["s"])
    x, f = F.col("x"), dict(zip(FEATURES, (F.col("x.f")[i] for i in range(len(FEATURES)))))
    own = F.exists("base", lambda b: (b["kind"] == x["kind"]) & over(b, x))
    spoken = (F.exists("base", lambda b: over(b, x)) | (x["kind"] == 1) | ((x["kind"] == 2) & (f["luhn"] == 0))
              | ((x["kind"] == 3) & ~f["digits"].between(9, 15))
              | ((x["kind"] == 0) & (f["loose"] > 0) & (f["spelled"] == 0)))
    seen = (some.select("digest", "base", F.explode(candidates(F.col("text"))).alias("x"))
            .select("digest", "x", F.when(own, 1.0).when(spoken, 0.0).alias("is_personal"), (~own).alias("fresh"))
            .where("is_personal IS NOT NULL"))
    spans = some.select("digest", "text", F.explode("base").alias("b"))
    before = F.substring(F.col("text"), F.greatest(F.col("b.s") + 1 - BEFORE, F.lit(1)), F.least(F.col("b.s"), F.lit(BEFORE)))
    spans = spans.withColumn("before", before).withColumn(
        "m", F.substring(F.col("text"), F.col("b.s") + 1, F.col("b.e") - F.col("b.s")))
    word = F.coalesce(F.nullif(F.regexp_extract("before", r"([A-Za-z]{2,})[^A-Za-z]*$", 1), F.lit("")), F.lit("it"))
    made = spans.select("digest", "before", F.col("b.kind").alias("kind"),
                        F.explode(rewritten(F.col("m"), F.col("b.kind"), word)).alias("r"))
    made = made.where(F.length("r.form") > 0).select(
        "digest", "kind", "before", "r", F.concat("before", F.lit(" "), "r.form", F.lit(" ")).alias("text"))
    # the form's own candidate: nothing that only stands before it
    made = (made.select("digest", "kind", "before", "r", F.explode(candidates(F.col("text"))).alias("x"))
            .where(F.col("x.e") > F.length("before") + 1)
            .select("digest", "x", (F.col("r.real") & (F.col("x.kind") == F.col("kind"))).cast("double").alias("is_personal"),
                    F.lit(True).alias("fresh")))
    each = seen.unionByName(made).dropDuplicates(["digest", "x", "is_personal"])
    return stored(each.select(
        F.col("x.kind").alias("kind"), *[f[n].alias(n) for n in FEATURES], "is_personal", "fresh",
        (F.pmod(F.shiftright("digest", 23), F.lit(3)) == 0).alias("held")), "candidates")


def fit(docs: DataFrame) -> Proposer | None:
    """Trees fitted to two thirds of all documents' candidates, thresholds set on
    the rest, of which only what the exact patterns miss counts; None if only one class was seen."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled(docs))
    train = rows.where("not held")
    if train.select("is_personal").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="features", labelCol="is_personal", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=0.3, seed=5).fit(train)
    scored = model.transform(rows.where("held and fresh")).select(
        "kind", "is_personal", F.round(vector_to_array("rawPrediction")[1], 6).alias("raw"))
    # counts of each score: as few as there are ways through the trees, whatever the input
    counts = scored.groupBy("kind", "raw").agg(F.count("*").alias("n"), F.sum("is_personal").alias("real")).collect()
    limits: list[float | None] = []
    for k in range(len(KINDS)):
        limit, n, real = None, 0, 0.0
        for c in sorted((c for c in counts if c["kind"] == k), key=lambda c: -c["raw"]):
            n, real = n + c["n"], real + c["real"]
            if n >= ENOUGH and real >= PRECISION * n:
                limit = c["raw"] - 1e-5
        limits.append(limit)
    return Proposer(model, limits)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and spans: sorted arrays of (s, kind, e), in code points of the whole text.

    ``base`` is what the exact patterns find; ``spans`` is that and the candidates that
    the trees score at or above their kind's threshold, unless a base span or a
    candidate that begins before them, or is of an earlier kind, overlaps them. A null text has no spans.
    Repeated rows agree; columns named like the new ones are replaced; an empty table gives an empty one.
    """
    rows = docs.drop("base", "spans")
    model = fit(docs.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text")))
    based = rows.withColumn("__base", base_spans(text_of(text)))
    if model is None or not any(t is not None for t in model.thresholds):
        return based.select(*columns_of(based, {"__base"}), F.col("__base").alias("base"),
                            F.col("__base").alias("spans"))
    wanted = F.array_sort(F.transform(F.filter(candidates(text_of(text)), model.chosen), lambda x: F.struct(
        x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))).cast(SPANS))

    def apart(x: Column, others: Column) -> Column:
        return ~F.exists(others, lambda o: (o["s"] < x["e"]) & (o["e"] > x["s"]))

    free = bind(wanted, lambda w: F.filter(w, lambda x: apart(x, F.col("__base"))))
    first = bind(free, lambda w: F.filter(w, lambda x, i: apart(x, F.slice(w, 1, i))))
    return (based.withColumn("__added", first)
            .select(*columns_of(based, {"__base"}), F.col("__base").alias("base"),
                    F.array_sort(F.concat("__base", "__added")).alias("spans")))


def digests(rows: DataFrame) -> DataFrame:
    """Of ``found``: doc_id, counts of base spans by kind, their digest, and all spans as text."""
    def is_kind(k: int):
        return lambda x: x["kind"] == k
    count = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{kind}")
             for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *count, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                       _listed(F.col("spans")).alias("spans"))


def redacted(rows: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """``found`` rows with every span of the text replaced by its kind's mark; overlapping ones by the first's."""
    names = F.array(*[F.lit(mark.format(k.upper())) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, x: Column) -> Column:
        part = F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, x["s"] - state["at"]),
                        F.get(names, x["kind"]))
        return F.when(x["s"] < state["at"], F.struct(
            F.greatest(state["at"], x["e"]).alias("at"), state["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), part.alias("out")))
    done = F.aggregate("spans", start, cut)
    return rows.withColumn(text, bind(done, lambda d: F.concat(
        d["out"], F.substring(F.col(text), d["at"] + 1, F.length(text)))))
