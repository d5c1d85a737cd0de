"""Personal data by weak-supervision aggregation, with DataFrame functions alone on the executors.

Candidates are the matches of the base patterns and of wider ones: obfuscated addresses, IPv6, shorter cards, national numbers,
and secrets (keys and tokens, a kind without a base pattern). Labelers vote for or against each: form and checksum, a gazetteer
(top-level domains, card prefixes, calling and area codes, reserved networks, key prefixes), context words to its left, and its
neighbours (a piece of a longer token is no personal data). Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliabilities and the prior of each kind, under priors whose weight grows with the counts, so that a vote says
the same on tables of any size; the posteriors train a logistic span classifier on the candidates' features. Base spans always
stay; wider candidates that the classifier accepts and that overlap no base span are added.

Positions are code points, end exclusive. A match is put between two marks (0x01; one in the text becomes 0x02 first, which no
pattern holds), the text is split there, and lengths give positions by sums over blocks of `RUN` pieces. A pattern runs only on
texts that hold what it cannot do without. One pass finds, places and checks all candidates and writes them; what reaches the
driver is a count for each pattern of votes and features (bounded by their number, about 5 x 3^4 x 60).

Defined results: null and empty texts have no spans; an empty table gives an empty table; repeated rows are judged each on
its own; other columns are not read. The patterns use possessive repeats and anchors, so they take linear time on runs of any
length, and match as the plain patterns do.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
WIDE_KINDS = (*KINDS, "secret")
RUN, CONTEXT = 256, 32
_LOCAL = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"
#: Fixed values of the task: the base patterns, in forms that never scan a run twice.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:\x20?[(\[]at[)\]]\x20?{_LABEL}{{1,63}}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?){_LABEL}{{2,63}}+){{1,4}}+|\x20at\x20{_LABEL}{{1,63}}+(?:\x20dot\x20{_LABEL}{{2,63}}+){{1,4}}+)",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,256}+[0-9])(?=[0-9_+/-]{0,256}+[A-Za-z])[A-Za-z0-9_+/-]{20,}+",
}
#: What a text must hold for a pattern to run: a string, or a cheaper pattern.
NEEDS = {
    "base_email": "@", "base_phone": r"\+[0-9]",
    "base_ip": r"[0-9]\.[0-9]", "base_card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "wider_email": r"[(\[]at[)\]]|\x20dot\x20", "wider_ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "wider_card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "wider_phone": r"[0-9][\x20.-][0-9]{4}", "wider_secret": r"[0-9][A-Za-z_+/-]|[A-Za-z_+/-][0-9]",
}
#: Common top-level domains, and calling words a kind; those of secrets stand right before them.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "ch", "at")
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|network|adresse|servidor)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|payment|pay|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|cell|fax|telefon|anruf|appel|llame)\b",
    "secret": r"""(?i)(?:token|secret|key|password|passwd|pwd|bearer|credential)s?["']?\x20?[:=]?\x20?["']?$""",
}
VOTERS = ("form", "gazetteer", "context", "neighbours")
#: P(vote 1 | is one) and P(vote 1 | is none) of each labeler before any count, and the prior's share of its votes. A secret
#: is seldom without a word that says so.
RELIABLE, HELD = ((0.8, 0.4), (0.7, 0.4), (0.4, 0.1), (0.98, 0.4)), 0.1
NAMED = ((0.8, 0.4), (0.7, 0.4), (0.8, 0.05), (0.98, 0.4))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") >= 5, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _valid_span(x: Column, kind: str) -> Column:
    return _valid(kind, x["m"])


def _bound(f: Callable, *more) -> Callable[[Column], Column]:
    """f of a span with the other arguments set."""
    return lambda x: f(x, *more)


def _pieces(text: Column, pattern: str, need: str) -> Column:
    """Alternately what lies between matches and matches, as (n, m, l, r): length; the match, if it is one; else its first
    and last characters, the context of the matches beside it. Null where nothing matches."""
    marked = F.regexp_replace(text, pattern, "\u0001$0\u0001")
    cut = F.split(marked, "\u0001", -1)

    def piece(s: Column, i: Column) -> Column:
        match = i % 2 == 1
        return F.struct(
            F.length(s).alias("n"),
            F.when(match, s).alias("m"),
            F.when(~match, F.substring(s, 1, 1)).alias("l"),
            F.when(~match, F.substring(s, -CONTEXT, CONTEXT)).alias("r"),
        )

    holds = F.instr(text, need) > 0 if len(need) == 1 else text.rlike(need)
    return F.when(holds & (F.instr(marked, "\u0001") > 0), F.transform(cut, piece))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _sums(pieces: Column) -> Column:
    """The characters before each run of RUN pieces."""
    runs = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int"))
    each = F.transform(runs, lambda b: F.aggregate(F.slice(pieces, b * RUN + 1, RUN), F.lit(0), lambda a, p: a + p["n"]))
    return F.aggregate(each, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def spans(pieces: Column, sums: Column) -> Column:
    """(s, e, m, l, r) of each match: start, end, text, the text to its left and the character to its right."""
    def one(i: Column) -> Column:
        block = F.floor(i / RUN).cast("int")
        start = F.get(sums, block) + F.aggregate(F.slice(pieces, block * RUN + 1, i % RUN), F.lit(0), lambda a, p: a + p["n"])
        own = F.get(pieces, i)
        return F.struct(start.alias("s"), (start + own["n"]).alias("e"), own["m"].alias("m"), F.get(pieces, i - 1)["r"].alias("l"), F.get(pieces, i + 1)["l"].alias("r"))

    return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), one)


_NONE = "cast(array() as array<struct<s:int,e:int,m:string,l:string,r:string>>)"


def _placed(text: Column, pattern: str, need: str) -> Column:
    found = _let(_pieces(text, pattern, need), lambda p: F.when(p.isNotNull(), _let(_sums(p), lambda s: spans(p, s))))
    return F.coalesce(found, F.expr(_NONE))


def candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, b_<kind> (valid base spans) and w_<kind> (wider candidates); written to the shared folder."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u0001"), F.lit("\u0002"))
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    out = [F.filter(_placed(F.col("text"), BASE[k], NEEDS[f"base_{k}"]), _bound(_valid_span, k)).alias(f"b_{k}") for k in KINDS]
    out += [_placed(F.col("text"), WIDER[k], NEEDS[f"wider_{k}"]).alias(f"w_{k}") for k in WIDE_KINDS]
    return staged(slim.select("doc_id", *out), "candidates")


def voted(kind: str, base: bool, x: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1, 0, or -1 for an abstention."""
    m, left = x["m"], F.coalesce(x["l"], F.lit(""))
    d = _digits(m)
    tail = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    form = {
        "email": F.when(m.rlike(r"^[.]|[.]@|[.]{2}"), 0).otherwise(1) if base else F.when(m.rlike(r"[(\[]"), 1).otherwise(0),
        "ip": F.when(m.rlike(r"(?:^|[.])0[0-9]"), 0).otherwise(1) if base else F.when(m.rlike("[A-Fa-f]"), 1).otherwise(0),
        "card": F.when(luhn(d), 1).otherwise(0),
        "phone": F.when(d.rlike("^[1-9]"), 1).otherwise(0) if base else F.when(d.rlike("^[2-9]"), 1).otherwise(0),
        "secret": F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), -1).when(F.length(d) * 5 < F.length(m), 0).otherwise(1),
    }[kind]
    known = {
        "email": F.when(tail.isin(*DOMAINS), 1).otherwise(0),
        "ip": F.when(m.rlike(r"^(?:0|127|2[2-5][0-9])\."), 0).otherwise(1) if base else F.when(m.rlike("^[23][0-9A-Fa-f]{3}:"), 1).otherwise(0),
        "card": F.when(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(0),
        "phone": F.when(m.rlike(r"^\+(?:1|3[0-9]|4[0-9])" if base else r"^\(?[2-9][0-8]"), 1).otherwise(0),
        "secret": F.when(m.rlike("^(?:AKIA|ASIA|AIza|eyJ|gh[opsu]_|glpat-|sk[-_]|xox[abp]-)"), 1).when(m.rlike("^[0-9A-Fa-f]+$") | m.contains("/"), 0).otherwise(-1),
    }[kind]
    context = F.when(left.rlike(WORDS[kind]), 1).otherwise(0)
    beside = F.when(F.concat(F.substring(left, -1, 1), F.coalesce(x["r"], F.lit(""))).rlike(r"[\p{L}0-9@.]" if kind == "secret" else r"[\p{L}0-9_=/#]"), 0).otherwise(1)
    return [c.cast("int") for c in (form, known, context, beside)]


def features(base: bool, x: Column) -> list[Column]:
    """Small numbers that describe a candidate: a base pattern's or not, length, share of digits, separators."""
    m = x["m"]
    n = F.length(m)
    return [F.lit(int(base)), F.least(F.floor(n / 6), F.lit(4)).cast("int"), F.floor(F.length(_digits(m)) * 3 / n).cast("int"), F.least(F.length(F.regexp_replace(m, r"[^\x20()\[\]-]", "")), F.lit(3)).cast("int")]


def judged(x: Column, kind: str, base: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[v.alias(name) for v, name in zip(voted(kind, base, x), VOTERS, strict=True)], *[f.alias(f"f{i}") for i, f in enumerate(features(base, x))])


def estimate(counts: list[tuple[str, tuple, int]], rounds: int = 50) -> dict[tuple[str, tuple], float]:
    """Expectation-maximisation over (kind, votes, count): the posterior of each (kind, votes). A kind has its own prior and
    its own two reliabilities of each labeler: calling words say little of addresses and much of secrets. They are held to a
    half and to `RELIABLE` by `HELD` of their counts and ten more: a labeler that says one thing only keeps telling the classes
    apart, and no prior climbs to 1."""
    post: dict[tuple[str, tuple], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = [(v, c) for k, v, c in counts if k == kind]
        n, total = len(own[0][0]), sum(c for _, c in own)
        prior = 0.5
        before = (NAMED if kind == "secret" else RELIABLE)[:n]
        hit, miss = [list(x) for x in zip(*before, strict=True)]  # P(vote 1 | voted, is one), P(vote 1 | voted, is none)
        for _ in range(rounds):
            for votes, _ in own:
                a, b = math.log(prior), math.log(1 - prior)
                for j, v in enumerate(votes):
                    if v >= 0:
                        a += math.log(hit[j] if v else 1 - hit[j])
                        b += math.log(miss[j] if v else 1 - miss[j])
                post[kind, votes] = 1 / (1 + math.exp(min(50.0, max(-50.0, b - a))))
            held = 2 + HELD * total
            prior = (sum(post[kind, v] * c for v, c in own) + held / 2) / (total + held)
            for j in range(n):
                yes = [(post[kind, v] * c, v[j]) for v, c in own if v[j] >= 0]
                no = [((1 - post[kind, v]) * c, v[j]) for v, c in own if v[j] >= 0]
                held = 10 + HELD * (sum(w for w, _ in yes) + sum(w for w, _ in no))
                hit[j] = (sum(w for w, v in yes if v) + held * before[j][0]) / (sum(w for w, _ in yes) + held)
                miss[j] = (sum(w for w, v in no if v) + held * before[j][1]) / (sum(w for w, _ in no) + held)
    return post


def classifier(rows: list[tuple[tuple, float, int]], steps: int = 300) -> dict[tuple, float]:
    """Logistic regression on one-hot (position, value) features: rows of (features, posterior, count) to weights. Each
    feature's step is over its own rows, so rare ones are learnt as well as frequent ones."""
    weights: dict[tuple, float] = {}
    share: dict[tuple, int] = {}
    for f, _, c in rows:
        for x in enumerate(f):
            share[x] = share.get(x, 0) + c
    for _ in range(steps):
        grad: dict[tuple, float] = {}
        for f, p, c in rows:
            z = sum(weights.get(x, 0.0) for x in enumerate(f))
            g = (1 / (1 + math.exp(min(50.0, max(-50.0, -z)))) - p) * c
            for x in enumerate(f):
                grad[x] = grad.get(x, 0.0) + g
        for x, g in grad.items():
            weights[x] = weights.get(x, 0.0) * 0.9999 - 6.0 / len(rows[0][0]) * g / share[x]
    return weights


def train(places: DataFrame) -> dict[tuple, float]:
    """The span classifier's weights, from the votes on all candidates of all documents."""
    parts = [F.transform(F.col(f"{'b' if base else 'w'}_{k}"), _bound(judged, k, base)) for base in (True, False) for k in (KINDS if base else WIDE_KINDS)]
    seen = places.select(F.explode(F.concat(*parts)).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    rows = sorted((r["c"]["kind"], tuple(r["c"][v] for v in VOTERS), tuple(r["c"][f"f{i}"] for i in range(4)), r["n"]) for r in seen)
    merged: dict[tuple, int] = {}
    for kind, votes, _, n in rows:
        merged[kind, votes] = merged.get((kind, votes), 0) + n
    post = estimate([(k, v, n) for (k, v), n in sorted(merged.items())])
    return classifier([((kind, *votes, *f), post[kind, votes], n) for kind, votes, f, n in rows])


def _accepted(x: Column, kind: str, weights: dict[tuple, float]) -> Column:
    values = [F.lit(kind), *voted(kind, False, x), *features(False, x)]
    score = F.lit(0.0)
    for j, value in enumerate(values):
        own = {v: w for (at, v), w in weights.items() if at == j}
        if j == 0:
            score = score + F.lit(own.get(kind, 0.0))
        elif own:
            score = score + F.coalesce(*[F.when(value == v, w) for v, w in sorted(own.items())], F.lit(0.0))
    return score > 0


def _free(x: Column, kind: str, weights: dict[tuple, float]) -> Column:
    """Accepted, and over no base span."""
    return _accepted(x, kind, weights) & ~F.exists(F.col("every"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _named(spans_: Column, kind: str) -> Column:
    return F.transform(spans_, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, b_<kind> (base spans) and x_<kind> (added spans), arrays of (s, e, m, l, r)."""
    places = candidates(documents, id_col, text_col)
    weights = train(places)
    every = F.concat(*[F.col(f"b_{k}") for k in KINDS])
    taken = places.withColumn("every", every)
    added = []
    for k in WIDE_KINDS:
        added.append(F.filter(F.col(f"w_{k}"), _bound(_free, k, weights)).alias(f"x_{k}"))
    return taken.select("doc_id", *[f"b_{k}" for k in KINDS], *added)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find(), and n_spans (long): the number of all spans."""
    base = F.array_join(F.concat(*[_named(F.col(f"b_{k}"), k) for k in KINDS]), ",")
    both = {k: F.array_sort(F.concat(F.col(f"b_{k}"), F.col(f"x_{k}")), lambda a, b: a["s"] - b["s"]) for k in KINDS} | {"secret": F.col("x_secret")}
    every = F.concat(*[_named(c, k) for k, c in both.items()])
    return found.select("doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), F.size(every).cast("long").alias("n_spans"))
