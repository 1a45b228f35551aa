r"""Personal data: candidate spans, boosted trees, calibrated thresholds.

DataFrame functions and Spark's own trees only. Fixed patterns find the base
spans (email, ip, card, phone), which always stay. High-recall generators
propose further, overlapping spans: written-out addresses, national telephone
numbers, grouped digits, dotted numbers. A gradient-boosted classifier scores them by
format and context. Its positives are base spans in formats that the base patterns
don't know (addresses written out, numbers without plus or country code, other
separators). Its negatives are proposals that fail a check of length, range, Luhn or
ending, base spans broken so that they fail it, and numbers without a cue; all other
proposals have no label. The trees are fitted on a bounded sample of each kind and
class. For every kind the threshold is the least probability at which all held-out
labelled candidates of the whole table (a quarter of the spans, by hash) are at least
99 % right. The generators bound the parts of their spans as hosts and numbers are
bounded (64 and 63 characters, 6 labels, 4 digits a group).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The fixed base patterns, with starts and repeats written so that long runs
#: cost linear time (a match begins where its run begins or the last one ended).
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}+(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT|\.) |\.)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.,])[0-9]{1,3}(?: ?[.,] ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:00)?\(?[0-9]{1,4}\)?(?:[ ./-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])",
}
#: Words before a span that speak for a kind, in four languages.
CUES = {
    "email": r"mail|contact|write|correo|courriel|schreib",
    "ip": r"\bip\b|host|server|address|adresse|direcci",
    "card": r"card|visa|credit|karte|tarjeta|carte|amex|payment",
    "phone": r"phone|tel|call|fax|mobile|cell|anruf|ruf|llam|appel",
}
CONTEXT = 24
SPANS = "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"
SLIM = "array<struct<kind:string,start:int,end:int>>"
TRAIN_ROWS, PRECISION = 20_000, 0.99
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "n_digits", "n_chars", "n_groups", "n_seps", "has_paren", "has_bracket", "luhn", "small_parts", "first_digit", "sound", "cue", "word_before", "word_after", "quote_before", "dot_after"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0).otherwise(False)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return F.regexp_like(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (kind, start, end, match, before, after).

    Pieces between matches give the offsets and the context, so a long text is
    gone through once, not once a match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.left(g, F.lit(CONTEXT)).alias("l"), F.right(g, F.lit(CONTEXT)).alias("r")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]["n"]
        end = start + F.length(x["m"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("match"), x["g"]["r"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    def laid_out(b: Column) -> Column:
        pieces = F.transform(b["m"], lambda m, i: F.struct(m.alias("m"), F.get(b["g"], i).alias("g"), F.get(b["g"], i + 1)["l"].alias("after")))
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("all")), add)["all"]

    # the one element of an array binds the pieces, so they are made once
    bound = F.transform(F.array(F.struct(matches.alias("m"), gaps.alias("g"))), laid_out)
    return F.when(F.regexp_like(text, F.lit(pattern)), bound[0]).otherwise(F.array().cast(SPANS))


def _guarded(text: Column, kind: str, pattern: str) -> Column:
    """Spans, skipping texts that can't have any."""
    empty = F.array().cast(SPANS)
    need = {"email": F.contains(text, F.lit("@")) | F.regexp_like(text, F.lit(r"[\[({] ?(?:at|AT) ?[\])}]")), "phone": F.contains(text, F.lit("+")) if pattern == BASE["phone"] else F.lit(True)}
    return F.when(need.get(kind, F.lit(True)), _spans(text, kind, pattern)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind in the order of KINDS."""

    def valid(kind: str) -> Column:
        return F.filter(_guarded(text, kind, BASE[kind]), lambda s: _valid(kind, s["match"]))

    return _in_order(F.concat(*map(valid, KINDS)))


def _in_order(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s.alias("s")))), lambda x: x["s"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cue() -> Column:
    return reduce(lambda a, k: F.when(F.col("kind") == k, F.regexp_like(F.lower("before"), F.lit(CUES[k]))).otherwise(a), KINDS, F.lit(False))


def _by_kind(*forms: Column) -> Column:
    """The form for each of KINDS, by column ``kind``."""
    return reduce(lambda a, x: F.when(F.col("kind") == x[0], x[1]).otherwise(a), zip(KINDS, forms, strict=True), F.lit(None))


def disguised(candidates: DataFrame) -> DataFrame:
    """Base spans in the formats that the base patterns don't know: a row each."""
    m = F.col("match")
    name, host = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    email = F.array(F.concat(name, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))), F.concat(name, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" dot "))), F.concat(name, F.lit(" [at] "), host), F.concat(name, F.lit(" (at) "), host))
    ip = F.array(m, F.replace(m, F.lit("."), F.lit(" . ")), F.replace(m, F.lit("."), F.lit(",")))
    card = F.array(m, F.regexp_replace(m, "[ -]", "."), F.regexp_replace(m, "[ -]", " "))
    phone = F.array(F.regexp_replace(m, r"^\+", ""), F.regexp_replace(m, r"^\+", "00"), F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]*", ""))
    return candidates.withColumn("match", F.explode(F.array_distinct(_by_kind(email, ip, card, phone))))


def broken(candidates: DataFrame) -> DataFrame:
    """Base spans changed so that they fail the check of their kind."""
    m = F.col("match")
    email = F.concat(F.split_part(m, F.lit("@"), F.lit(1)), F.lit(" [at] "), F.split_part(F.split_part(m, F.lit("@"), F.lit(2)), F.lit("."), F.lit(1)), F.lit(".0"))
    ip = F.regexp_replace(m, "[0-9]+$", "999")
    card = F.concat(F.left(m, F.length(m) - 1), ((F.right(m, F.lit(1)).cast("int") + 5) % 10).cast("string"))
    phone = F.regexp_extract(m, r"^\+[0-9]{1,3}[ .-]*(.{1,6})", 1)
    return candidates.withColumn("match", _by_kind(email, ip, card, phone))


def sound(kind: Column, match: Column) -> Column:
    """Whether a proposal passes the checks of its kind, in whatever format."""
    digits, parts = _digits(match), F.split(F.regexp_replace(match, "[^0-9]+", "."), r"\.")
    email = F.regexp_like(match, F.lit(r"[\])}. ][A-Za-z]{2,24}$"))
    ip = F.forall(parts, lambda x: F.coalesce(F.try_to_number(F.nullif(x, F.lit("")), F.lit("999")), F.lit(999)) <= 255)
    card = F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(F.length(digits).between(7, 15))


def features(candidates: DataFrame) -> DataFrame:
    """Format and context features of candidates (kind, match, before, after)."""
    digits, seps = _digits(F.col("match")), F.regexp_replace(F.regexp_replace("match", r"^\+", ""), "[A-Za-z0-9]", "")
    num = lambda c: c.cast("double")
    parts = F.split(F.regexp_replace("match", "[^0-9]+", " "), " ")
    return candidates.withColumns(
        {f"is_{k}": num(F.col("kind") == k) for k in KINDS}
        | {
            "n_digits": num(F.length(digits)),
            "n_chars": num(F.length(F.regexp_replace("match", r"^\+", ""))),
            "n_groups": num(F.size(parts)),
            "n_seps": num(F.length(seps)),
            "has_paren": num(F.contains("match", F.lit("("))),
            "has_bracket": num(F.regexp_like("match", F.lit(r"[\[{]"))),
            "luhn": num(F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)),
            "small_parts": num(F.forall(parts, lambda p: F.when(F.length(p).between(1, 3), p.cast("int") <= 255).otherwise(False))),
            "first_digit": F.coalesce(F.try_to_number(F.nullif(F.left(digits, F.lit(1)), F.lit("")), F.lit("9")).cast("double"), F.lit(-1.0)),
            "sound": num(F.coalesce(sound(F.col("kind"), F.col("match")), F.lit(False))),
            "cue": num(_cue()),
            "word_before": num(F.regexp_like("before", F.lit(r"[\p{L}\p{N}]$"))),
            "word_after": num(F.regexp_like("after", F.lit(r"^[\p{L}\p{N}]"))),
            "quote_before": num(F.regexp_like("before", F.lit(r"[\"'=]$"))),
            "dot_after": num(F.regexp_like("after", F.lit(r"^[.,][0-9]"))),
        }
    )


def fit_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the labelled rows, shared out evenly over kinds and classes.

    A row is in by its hash, so no sort is needed and reruns agree. Kinds and classes
    that have fewer rows than their share are in whole.
    """
    share = rows / (2 * len(KINDS))
    # at most a row for each kind and class
    parts = {(r.kind, r.base): min(1.0, share / r.n) for r in labelled.groupBy("kind", "base").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("h", "match", F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    return labelled.filter(reduce(lambda a, x: a | ((F.col("kind") == x[0][0]) & (F.col("base") == x[0][1]) & (u < x[1])), parts.items(), F.lit(False)))


def fit(sample: DataFrame, iterations: int = 12, depth: int = 3):
    """Boosted trees on labelled candidates; None where one of the classes is empty."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = sample.agg(F.count_if("base"), F.count_if(~F.col("base"))).first()
    if not min(counts):
        return None
    rows = features(sample).withColumn("label", F.col("base").cast("double"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=iterations, maxDepth=depth, stepSize=0.2, seed=7, checkpointInterval=-1)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(rows)


def _scored(candidates: DataFrame, model) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(features(candidates)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def thresholds(held_out: DataFrame, model, precision: float = PRECISION) -> dict[str, float]:
    """Per kind the least probability with that precision (in steps of 0.01).

    A kind without held-out rows, or too wrong at every step, has none.
    """
    # at most 101 rows a kind
    steps = _scored(held_out, model).groupBy("kind", F.floor(F.col("p") * 100).cast("int").alias("step")).agg(F.count_if("base").alias("good"), F.count("*").alias("n")).collect()
    out = {}
    for kind in KINDS:
        good = n = 0
        for row in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            good, n = good + row.good, n + row.n
            if good / n >= precision:
                out[kind] = row.step / 100
    return out


def labelled_candidates(candidates: DataFrame) -> DataFrame:
    """kind, match, before, after, base (the label), h: the trees' examples.

    ``h`` is a hash of the span's kind and text, shared by all forms of a span, so
    that copies of a span fall on one side of the split.
    """
    single = candidates.groupBy("kind", "match", "base").agg(F.min(F.struct("before", "after")).alias("c")).select("kind", "match", "base", "c.before", "c.after")
    single = single.withColumn("h", F.xxhash64("kind", "match"))
    true, none = single.filter("base"), F.lit(False)
    wrong = single.filter(~F.col("base") & (~sound(F.col("kind"), F.col("match")) | ((F.col("kind") != "email") & ~_cue())))
    return disguised(true).unionByName(broken(true).withColumn("base", none)).unionByName(wrong)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, precision: float = PRECISION) -> DataFrame:
    """One row per input row: id, base (array of spans), extra (array of spans), text_key.

    Spans have kind, start and end in code points of the whole text, end
    exclusive. Null texts count as empty. Rows that repeat an id are kept apart
    by their texts. ``train_rows`` bounds the sample that the trees are fitted on
    (``fit_sample``); thresholds come from all held-out rows. A kind that has no base
    span in the table has no examples and gets no extra spans. Other columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    based = plain.withColumn("base", base_spans(F.col("text")))
    proposed = F.concat(*[_guarded(F.col("text"), k, GENERATORS[k]) for k in KINDS])
    found = written(based.select("id", "key", "base", proposed.alias("proposed")), "pii-candidates")
    inside = lambda c: F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    fresh = F.filter("proposed", lambda c: ~inside(c))
    tagged = F.concat(F.transform("base", lambda s: F.struct(F.lit(True).alias("base"), s.alias("s"))), F.transform(fresh, lambda s: F.struct(F.lit(False).alias("base"), s.alias("s"))))
    candidates = found.filter((F.size("base") > 0) | (F.size("proposed") > 0)).select("id", "key", F.explode(tagged).alias("t")).select("id", "key", "t.base", "t.s.*")
    labelled = written(labelled_candidates(candidates), "pii-labelled")
    held_out = F.pmod("h", F.lit(4)) == 0
    model = fit(written(fit_sample(labelled.filter(~held_out), train_rows), "pii-sample"))
    least = thresholds(labelled.filter(held_out), model, precision) if model else {}
    out = found.select("id", "key", slim(F.col("base")).alias("base"))
    if not least:
        return out.withColumn("extra", F.array().cast(SLIM)).select(F.col("id").alias(id_col), "base", "extra", F.col("key").alias("text_key"))
    enough = reduce(lambda a, k: F.when(F.col("kind") == k, F.col("p") >= least[k]).otherwise(a), least, F.lit(False))
    chosen = _scored(candidates.filter(~F.col("base") & sound(F.col("kind"), F.col("match"))), model).filter(enough)
    per = chosen.groupBy("id", "key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra")).select(F.col("id").alias("_i"), F.col("key").alias("_k"), "extra")
    both = out.join(per, F.col("id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "left")
    return both.select(F.col("id").alias(id_col), "base", F.coalesce("extra", F.array().cast(SLIM)).alias("extra"), F.col("key").alias("text_key"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets.

    Overlapping spans are merged; the kind of the first one is shown. Null texts stay
    null, and each row is redacted by its own text, repeated ids or not.
    """
    spans = find_pii(docs, id_col, text_col, **options).select(F.col(id_col).alias("__i"), F.col("text_key").alias("__k"), _in_order(F.concat("base", "extra")).alias("__s")).filter(F.size("__s") > 0).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.aggregate(
        "__s",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    both = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__i")) & (F.xxhash64(text) == F.col("__k")), "left")
    return both.withColumn(text_col, F.when(F.col("__s").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
