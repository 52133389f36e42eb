"""Personal data by weak supervision, in DataFrame functions throughout.

Base spans follow fixed patterns.  Candidates beyond them are looser: numbers that look
like cards, phones or addresses but fail a check, phone numbers without a plus sign,
mail addresses spelled with "at" and "dot", national numbers.  Three labelers vote on
every candidate, for (1), against (-1) or not at all (0): a regular expression for its
strict shape, a gazetteer (mail domains' endings, card issuers' digits, dialling codes,
reserved addresses) and its context (telling words before it, or signs of code, versions
and prices).  Expectation-maximisation over the counts of vote patterns (at most
kinds x 27 rows, whatever the corpus) estimates how reliable each labeler is and how
likely each pattern is personal data.  These posteriors train a logistic classifier over
votes and shape features, again from counts of feature cells; it decides on every
candidate.  Base spans always stay.

Patterns are possessive where the plain form never needs to give characters back, so
matching is linear and needs no stack on very long texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvane.llm.common import cut_lineage

KINDS = ("email", "ip", "card", "phone")

#: The base patterns.  A local part starts where its run of characters does
#: or where the match before ended.
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
_NEEDS = {"email": "@", "phone": "+"}

#: Looser patterns, the kind that they would be, in order of precedence.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|00[0-9]{2,4})[ ./-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}

#: Gazetteers.
MAIL_ENDINGS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "info"]
DIAL_CODES = ["1", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91"]
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:ip|address|host|server|login|from|client)\W*(?:\w+\W+){0,1}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|payment|karte|tarjeta|carte|ssn|social)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|cell|dial|whatsapp)\W*(?:\w+\W+){0,2}$",
}
AGAINST = r"(?i)(?:version|v|release|isbn|doi|id|no|number|order|part|sku|page|[$€£#=/_])\W*$"

_SHAPE = {
    "email": rf"^{_LOCAL}++@(?:{_NAME}++\.)++[A-Za-z]{{2,}}$",
    "ip": r"^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$",
    "card": r"^(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{2,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ .-]?|0)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .-]?[0-9]{2,4}){2,4}$",
}
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_RESERVED = r"^(?:0|10|127|255|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
VOTES = ("regex", "gazetteer", "context")
FEATURES = (*VOTES, "base", "digits", "long", "is_email", "is_ip", "is_phone")
#: Where EM starts: by labeler, its chances to vote against, not at all and for, in personal data and elsewhere.
_START = (((0.2, 0.2, 0.6), (0.3, 0.3, 0.4)), ((0.2, 0.3, 0.5), (0.35, 0.35, 0.3)), ((0.05, 0.5, 0.45), (0.4, 0.55, 0.05)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled (less 9 above 9): the sum ends in 0."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.pmod(d.try_cast("int") * 2, F.lit(10)) + F.floor(d.try_cast("int") / 5)).otherwise(d.try_cast("int")))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, d: a + F.coalesce(d.cast("bigint"), F.lit(0).cast("bigint"))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0)) <= 255))
    n = F.length(_digits(match))
    return n.between(10, 15) if kind == "phone" else n.between(14, 19) & _luhn(_digits(match))


def _good(kind: str):
    return lambda span: _valid(kind, span.match)


def _failed(kind: str):
    return lambda span: ~_valid(kind, span.match) & (F.length(span.match) >= 7)


def _is(kind: str):
    return lambda span: span.kind == kind


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches as structs ``kind, start, end, match, before``: from the pieces between them.

    Split and extraction scan alike, so piece i lies before match i.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string>>").alias("all"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc.end + F.length(pair.piece)
        end = begin + F.length(pair.match)
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair.match.alias("match"), F.right(pair.piece, F.lit(40)).alias("before"))
        return F.struct(end.alias("end"), F.concat(acc["all"], F.array(span)).alias("all"))

    pairs = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.aggregate(F.filter(pairs, lambda x: x.match.isNotNull()), start, step, lambda acc: acc["all"])


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string>>")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good & ~bad, 1).when(bad & ~good, -1).otherwise(0)


def _judged(span: Column, base: Column) -> Column:
    """A span's struct with votes and features; ``base`` says whether it is a base span."""
    kind, match, digits = span.kind, span.match, _digits(span.match)

    def pick(by: dict[str, Column]) -> Column:
        return F.coalesce(*(F.when(kind == k, v) for k, v in by.items()))

    shape = pick({k: match.rlike(p) for k, p in _SHAPE.items()})
    listed = pick({
        "email": F.regexp_extract(F.lower(match), r"[. )\]]([a-z]+)$", 1).isin(MAIL_ENDINGS),
        "ip": ~match.rlike(_RESERVED),
        "card": digits.rlike(_ISSUER) & _luhn(digits),
        "phone": F.regexp_extract(digits, "^(?:00|0)?([1-9][0-9]?)", 1).isin(DIAL_CODES) | digits.startswith("1"),
    })
    reserved = pick({"email": F.lower(match).rlike(r"example|invalid|localhost"), "ip": match.rlike(_RESERVED), "card": ~_luhn(digits), "phone": digits.rlike(r"^(.)\1+$")})
    told = pick({k: span.before.rlike(p) for k, p in CONTEXT.items()})
    return F.struct(
        kind.alias("kind"), span.start.alias("start"), span.end.alias("end"), base.alias("base"),
        _vote(shape, ~shape).alias("regex"), _vote(listed, reserved & ~listed).alias("gazetteer"), _vote(told, span.before.rlike(AGAINST) & ~told).alias("context"),
        F.length(digits).between(7, 19).cast("int").alias("digits"), (F.length(match) > 12).cast("int").alias("long"),
        *((kind == k).cast("int").alias(f"is_{k}") for k in KINDS if k != "card"),
    )


def _spans(docs: DataFrame) -> DataFrame:
    """Adds ``base`` (spans) and ``more`` (candidates that overlap no base span) to ``docs`` with column ``text``."""
    text = F.col("text")
    raw = {}
    for kind, pattern in BASE.items():
        needed = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike(r"[0-9][\x20-]?[0-9]" if kind == "card" else r"[0-9]\.[0-9]")
        raw[f"__raw_{kind}"] = F.when(needed, _matches(text, pattern, kind)).otherwise(_none())
    loose = {"email": text.rlike(r"[(\[](?:at)[)\]]"), "phone": text.rlike(r"[(0][0-9]"), "card": text.rlike("[0-9]-[0-9]{2}-[0-9]")}
    for kind, pattern in LOOSE.items():
        raw[f"__loose_{kind}"] = F.when(loose[kind], _matches(text, pattern, kind)).otherwise(_none())
    found = docs.withColumns(raw)
    good = F.concat(*(F.transform(F.filter(f"__raw_{k}", _good(k)), lambda s: _judged(s, F.lit(True))) for k in KINDS))
    failed = [F.filter(f"__raw_{k}", _failed(k)) for k in KINDS if k != "email"]
    maybe = F.transform(F.concat(*failed, *(F.col(f"__loose_{k}") for k in LOOSE)), lambda s: _judged(s, F.lit(False)))
    found = found.withColumn("base", good).withColumn("__maybe", maybe)
    return found.withColumn("more", F.filter("__maybe", lambda c: ~F.exists("base", lambda b: (b.start < c.end) & (c.start < b.end)))).drop("__maybe", *raw)


def _expectation(cells: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Chance of each (kind, votes, base) to be personal data, by EM with independent labelers.

    ``cells``: (kind, votes, base, count).  Base spans are known to be positive; each
    labeler has, by kind and class, a chance to vote for, against and not at all.
    """
    belief = {}
    for kind in KINDS:
        own = [(v, b, n) for k, v, b, n in cells if k == kind]
        share, odds = 0.5, {(c, i): _START[i][1 - c] for c in (0, 1) for i in range(len(VOTES))}
        for _ in range(rounds):
            for votes, base, _ in own:
                yes, no = share, 1 - share
                for i, v in enumerate(votes):
                    yes, no = yes * odds[1, i][v + 1], no * odds[0, i][v + 1]
                belief[kind, votes, base] = 1.0 if base else yes / (yes + no)
            loose = [(n, belief[kind, v, b]) for v, b, n in own if not b]
            share = (1 + sum(n * p for n, p in loose)) / (2 + sum(n for n, _ in loose))
            for c, i in odds:
                mass = [10 * x for x in _START[i][1 - c]]
                for v, b, n in own:
                    mass[v[i] + 1] += n * (belief[kind, v, b] if c else 1 - belief[kind, v, b])
                odds[c, i] = tuple(m / sum(mass) for m in mass)
    return belief


def _classifier(cells: list[tuple[tuple[float, ...], float, int]], steps: int = 300) -> list[float]:
    """Weights and bias of a logistic regression on (features, chance, count), by gradient steps."""
    total = sum(n for *_, n in cells) or 1
    w = [0.0] * (len(FEATURES) + 1)
    for _ in range(steps):
        slope = [0.01 * x for x in w]
        for x, p, n in cells:
            x = (*x, 1.0)
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - p
            for i, v in enumerate(x):
                slope[i] += n / total * miss * v
        w = [a - 0.5 * s for a, s in zip(w, slope)]
    return w


def train(spans: DataFrame) -> list[float]:
    """The span classifier, from the counts of feature cells over all documents (at most kinds x 27 x 8 rows)."""
    every = spans.select(F.explode(F.concat("base", "more")).alias("s")).groupBy(*(F.col(f"s.{c}").alias(c) for c in ("kind", *FEATURES))).agg(F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in every.collect())
    width = len(VOTES)
    votes: dict[tuple, int] = {}
    for kind, *rest in rows:
        key = kind, tuple(rest[:width]), bool(rest[width])
        votes[key] = votes.get(key, 0) + rest[-1]
    belief = _expectation([(*k, n) for k, n in votes.items()])
    return _classifier([(tuple(map(float, x[:-1])), belief[kind, tuple(x[:width]), bool(x[width])], x[-1]) for kind, *x in rows])


def _accepted(weights: list[float]) -> Column:
    """Candidates that the classifier takes; of overlapping ones the first listed."""
    def logit(s: Column) -> Column:
        return sum((F.lit(w) * s[f].cast("double") for w, f in zip(weights, FEATURES)), F.lit(weights[-1]))

    taken = F.filter("more", lambda s: logit(s) > 0)
    return F.filter(taken, lambda s: ~F.exists(taken, lambda o: (o.start < s.end) & (s.start < o.end) & (F.struct(o.start, -o.end, o.kind) < F.struct(s.start, -s.end, s.kind))))


def _order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s.kind)
    return F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank(s).alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(_order(spans), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    Counts and ``base_sha256`` are of base spans; ``spans`` lists all, as
    ``kind:start:end`` in code points, by start, then kind.  Null texts count as empty.
    Null or repeated ids and repeated rows keep a row each; other columns are ignored; an
    empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = cut_lineage(_spans(texts).drop("text"))
    spans = F.concat("base", _accepted(train(found)))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; all columns stay.

    Overlapping spans of different kinds become one, named after the first.  A null text
    stays null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    weights = train(cut_lineage(_spans(docs.select(text.alias("text"))).drop("text").filter("size(base) > 0 or size(more) > 0")))
    whole = F.struct(*docs.columns)
    found = _spans(docs.select(whole.alias("__row"), text.alias("text")))
    ordered = _order(F.concat("base", _accepted(weights)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s.start >= acc["at"]
        added = F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.greatest(s.start - acc["at"], F.lit(0))), F.lit("<"), s.kind, F.lit(">"))
        return F.struct(F.greatest(acc["at"], s.end).alias("at"), F.when(new, added).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)))
    clean = F.when(F.size(ordered) > 0, clean).otherwise(F.col("text"))
    found = found.withColumn("__text", F.when(F.col("__row.text").isNotNull(), clean))
    return found.select(*[F.col("__text").alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])
