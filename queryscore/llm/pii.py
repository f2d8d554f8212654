"""Personal data by weak supervision: labelers vote on candidate spans, a classifier decides.

Base kinds (e-mail, IP address, card and phone number) are found by fixed rules and always stay.
Further candidates (credentials, obfuscated addresses, national numbers, titled names) come from
broad patterns. Shape, validity, gazetteer and context labelers vote for or against each candidate.
Expectation-maximisation over the counts of vote patterns estimates how reliable every labeler is
and how likely a pattern is personal data; a logistic classifier over votes and span shape is
fitted to those probabilities and decides. Only counts of patterns reach the driver, a table whose
size depends on the labelers and not on the documents.

Everything on the texts is Spark SQL. Positions come from cutting a text at its matches: the
pieces between and the matches alternate, so running sums of their lengths are the starts.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscore.llm.native import let, total
from queryscore.llm.scratch import kept

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "address", "number", "person")

_LOCAL = "A-Za-z0-9._%+-"
# Every pattern starts at the border of its run and keeps what it took: the same leftmost matches
# as the plain form, without trying all starts and lengths of a long run.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
    "address": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z]{{2,}}+",
    "number": r"(?<![0-9+.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?)\.?\x20\p{Lu}\p{L}{1,30}+(?:\x20\p{Lu}\p{L}{1,30}+)?",
}
#: A text without any of these cannot match, and is spared the pattern.
NEEDS = {"email": ("@",), "phone": ("+",), "address": ("at)", "at]", "AT)", "AT]")}
NEED_DIGIT = ("ip", "card", "phone", "secret", "number")

CONTEXT = 32
CUES = {
    "secret": r"(?i)(?:password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key|credential)s?[\x20\"'=:]*$",
    "address": r"(?i)(?:e-?mail|mail|contact|write|kontakt|courriel|correo)[\p{L}\x20:]{0,12}$",
    "number": r"(?i)(?:phone|tel|call|fax|mobile|ssn|social security|telefon|téléphone|teléfono)[\p{L}\x20.:#]{0,12}$",
    "person": r"(?i)(?:by|from|with|dear|von|liebe[r]?|par|de|por|con)\x20$",
}
AGAINST = r"(?i)(?:version|commit|build|sha|md5|isbn|page|figure|total|example|sample|test)[\x20=:#]*$"
GAZETTEER = {
    "secret": r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^github_pat_|^xox[abp]|^sk_(?:live|test)_",
    "address": r"(?i)(?:com|org|net|edu|gov|de|fr|es|it|uk|io|info)$",
    "number": r"^\(?(?:2(?!11)|[3-9](?!11))[0-9]",
    "person": r"(?i)\x20(?:anna|maria|john|james|mary|peter|paul|michael|thomas|hans|jean|pierre|marie|josé|juan|carmen|david|sarah|laura|jan|emma)(?:\x20|$)",
}
SHAPE = {
    "secret": r"^(?:[0-9a-f]{16,}+|[A-Z0-9]{20}|[A-Za-z0-9_]{32,}+)$",
    "address": r"(?i)[\[(]at[\])].*[\[(]dot[\])]",
    "number": r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})$",
    "person": r"\x20\p{Lu}\p{L}+\x20\p{Lu}\p{L}+$",
}
LABELERS = ("shape", "valid", "gazetteer", "context")
EM_ROUNDS = 50
FIT_ROUNDS = 400
LENGTH_STEPS = (8, 16, 24, 40)



_SPAN = "struct<kind:string,start:int,end:int,value:string>"
_NONE = f"array<{_SPAN}>"


def _running(values: Column) -> Column:
    """The running sums of an array of integers."""
    step = lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _spans(text: Column, kind: str) -> Column:
    """array<kind, start, end, value> of the leftmost non-overlapping matches; code points, end exclusive."""
    pattern = PATTERNS[kind]

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        before = F.concat(F.array(F.lit(0)), F.transform(found, lambda m: F.length(m)))
        starts = _running(F.zip_with(gaps, before, lambda g, m: g + m))
        return let(starts, lambda at: F.transform(found, lambda m, k: F.struct(
            F.lit(kind).alias("kind"), F.get(at, k).alias("start"), (F.get(at, k) + F.length(m)).alias("end"), m.alias("value"),
        )))

    none = F.array().cast(_NONE)
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)),
    )
    needed = F.lit(True)
    if kind in NEEDS:
        needed = F.lit(False)
        for sign in NEEDS[kind]:
            needed = needed | F.contains(text, F.lit(sign))
    if kind in NEED_DIGIT:
        needed = F.col("_digits") & needed
    return F.when(needed, found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value: Column) -> Column:
    def digit(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(
            i % 2 == 1, F.substring(s, i, F.lit(1)).cast("int")
        ).otherwise(F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), F.substring(s, i, F.lit(1)).cast("int") + 1)))
    return let(F.reverse(_digits(value)), lambda s: total(digit(s)) % 10 == 0)


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return (n >= 16) & (n <= 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _vote(for_: Column, against: Column | None = None) -> Column:
    vote = F.when(for_, 1)
    return (vote if against is None else vote.when(against, -1)).otherwise(0)


def _voted(text: Column, span: Column, kind: str) -> Column:
    """The span with the votes (1 for, -1 against, 0 none) and the two shape features."""
    value = span["value"]
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, first + 1, span["start"] - first)
    digits = F.length(_digits(value)) / F.length(value)
    valid = {
        "secret": _vote(digits.between(0.1, 0.9), ~digits.between(0.1, 0.9)),
        "number": _vote(~value.rlike("000"), value.rlike("000")),
    }.get(kind, F.lit(0))
    length = F.lit(0)
    for step in LENGTH_STEPS:
        length = length + (F.length(value) >= step).cast("int")
    return F.struct(
        span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        _vote(value.rlike(SHAPE[kind])).alias("shape"), valid.alias("valid"),
        _vote(value.rlike(GAZETTEER[kind])).alias("gazetteer"),
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)).alias("context"),
        length.alias("length"), F.floor(digits * 3.99).cast("int").alias("digits"),
    )


def candidates(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` in a struct, the valid base spans and the voted extra candidates of every document."""
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("_doc"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    rows = rows.withColumn("_digits", F.col("_text").rlike("[0-9]"))
    text = F.col("_text")
    base = F.flatten(F.array(*[_filtered(text, k) for k in BASE_KINDS]))
    extra = F.flatten(F.array(*[_candidates(text, k) for k in EXTRA_KINDS]))
    rows = rows.select("_doc", base.alias("_base"), extra.alias("_extra"))
    free = lambda e: ~F.exists("_base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))
    return rows.withColumn("_extra", F.filter("_extra", free))


def _filtered(text: Column, kind: str) -> Column:
    valid = F.filter(_spans(text, kind), lambda s: _passes(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _candidates(text: Column, kind: str) -> Column:
    return F.transform(_spans(text, kind), lambda s: _voted(text, s, kind))


def expected(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Pattern (kind, *votes, …) → probability of personal data, by expectation-maximisation.

    Each kind has its own prior and each labeler its own distribution of votes on true and false
    spans. The first probabilities are those of the majority vote, so a labeler counts as better
    than chance until the data say otherwise.
    """
    out = {}
    for kind in {p[0] for p in counts}:
        own = {p: n for p, n in counts.items() if p[0] == kind}
        prob = {p: 1 / (1 + math.exp(1 - 2 * sum(p[1:1 + len(LABELERS)]))) for p in own}
        for _ in range(EM_ROUNDS):
            seen = [sum(n * (prob[p] if y else 1 - prob[p]) for p, n in own.items()) for y in (0, 1)]
            prior = (seen[1] + 1) / (seen[0] + seen[1] + 2)
            given = {}
            for y, j, vote in itertools.product((0, 1), range(len(LABELERS)), (-1, 0, 1)):
                mass = sum(n * (prob[p] if y else 1 - prob[p]) for p, n in own.items() if p[1 + j] == vote)
                # smoothing leans to labelers that are right: votes for a true span, against a false one
                lean = 2 if vote == (1 if y else -1) else 1
                given[y, j, vote] = (mass + lean) / (seen[y] + 4)
            for p in own:
                like = [math.log(1 - prior), math.log(prior)]
                for y in (0, 1):
                    like[y] += sum(math.log(given[y, j, p[1 + j]]) for j in range(len(LABELERS)))
                prob[p] = 1 / (1 + math.exp(min(max(like[0] - like[1], -50), 50)))
        out.update(prob)
    return out


def _facts(pattern: tuple) -> list[tuple]:
    names = ("kind", *LABELERS, "length", "digits")
    return list(zip(names, pattern))


def fit(counts: dict[tuple, int], prob: dict[tuple, float]) -> dict[tuple, float]:
    """Weights of a logistic classifier, one per fact, fitted to the expected labels."""
    weights: dict[tuple, float] = {f: 0.0 for p in counts for f in _facts(p)}
    size = sum(counts.values())
    for _ in range(FIT_ROUNDS):
        slope = {f: 1e-3 * w for f, w in weights.items()}
        for p, n in counts.items():
            facts = _facts(p)
            error = 1 / (1 + math.exp(-sum(weights[f] for f in facts))) - prob[p]
            for f in facts:
                slope[f] += n / size * error
        weights = {f: w - 2.0 * slope[f] for f, w in weights.items()}
    return weights


def _accepted(span: Column, weights: dict[tuple, float]) -> Column:
    score = F.lit(0.0)
    for name in ("kind", *LABELERS, "length", "digits"):
        part = None
        for (fact, value), w in weights.items():
            if fact == name:
                hit = span[name] == value
                part = F.when(hit, w) if part is None else part.when(hit, w)
        if part is not None:
            score = score + part.otherwise(0.0)
    return score >= 0


def find(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` in the struct _doc, and _base and _extra: array<kind, start, end> of every document.

    A null text counts as empty. Rows with equal ids are treated one by one.
    """
    rows = kept(candidates(docs, carry), "candidates")
    span = F.explode("_extra")
    names = ("kind", *LABELERS, "length", "digits")
    grouped = rows.select(span.alias("s")).select(*[F.col("s")[n].alias(n) for n in names]).groupBy(*names).count().collect()
    counts = {tuple(r[n] for n in names): r["count"] for r in grouped}
    weights = fit(counts, expected(counts)) if counts else {}
    accepted = F.filter("_extra", lambda s: _accepted(s, weights)) if weights else F.col("_extra")
    plain = F.transform(accepted, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumn("_extra", plain)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, by kind and start, comma-joined."""
    order = F.create_map(*[F.lit(x) for pair in zip(BASE_KINDS + EXTRA_KINDS, range(8)) for x in pair])
    ranked = F.sort_array(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"], s["end"], s["kind"])))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, the number of base spans by kind, base_sha256, spans and n_extra; see ``find``."""
    found = find(docs, carry)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint")
    added = {f"n_{k}": count(k) for k in BASE_KINDS} | {
        "base_sha256": F.sha2(listed(F.col("_base")), 256),
        "spans": listed(F.concat("_base", "_extra")),
        "n_extra": F.size("_extra").cast("bigint"),
    }
    return found.select(*[F.col("_doc")[c].alias(c) for c in carry if c not in added], *[v.alias(k) for k, v in added.items()])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; n_chars follows, a null text stays."""
    found = find(docs, docs.columns)
    text = F.col("_doc")["text"]
    by_start = F.array_sort(F.transform(F.concat("_base", "_extra"), lambda s: F.struct(s["start"], (-s["end"]).alias("end"), s["kind"])))
    # a span that starts inside an earlier one is part of it
    outer = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            (-s["end"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind")))).alias("out"),
        )), lambda acc: acc["out"],
    )
    pieces = let(outer, lambda spans: F.concat(
        F.array_join(F.transform(spans, lambda s, k: F.concat(
            let(F.when(k > 0, F.get(spans, k - 1)["end"]).otherwise(0), lambda at: F.substring(text, at + 1, s["start"] - at)),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        )), ""),
        F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text)),
    ))
    masked = F.when(F.size("_base") + F.size("_extra") == 0, text).otherwise(pieces)
    rows = found.withColumn("_masked", masked)
    out = {c: F.col("_doc")[c] for c in docs.columns} | {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_masked").isNull(), out["n_chars"]).otherwise(F.length("_masked").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[out[c].alias(c) for c in docs.columns])
