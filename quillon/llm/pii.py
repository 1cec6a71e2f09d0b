"""Personal data by weak supervision, with DataFrame functions only.

Candidates are spans of four kinds.  The base ones follow strict patterns and checks and always stay; looser
patterns add others (phones without a country code, e-mail addresses written out, short card numbers, IPv6).
Four labelers vote +1, 0 or -1 on each candidate: the strict pattern, a gazetteer (top-level domains, issuer
prefixes, calling codes, reserved addresses), the words before it, and its shape.  Spark counts the vote
patterns over all documents (a few hundred rows whatever the input); expectation-maximisation on those counts
estimates each labeler's reliability, and a logistic span classifier is trained on the resulting soft labels.
Loose spans that it accepts are added.

Spans are code points, end exclusive.  Kinds are matched independently and may overlap each other.  The patterns of one kind
exclude each other, so a loose span never overlaps a base one of its kind.  A text's cost is in step with its length, however many
matches it has.  A null or
empty text has none.  Each row is treated alone: repeated rows give repeated results.  Extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")

# Java patterns.  Possessive repeats and the look-behind (or \G, the end of the match before) keep long runs linear;
# they match what the plain forms match.  Digit counts of cards stand in the pattern: a whole run of digits is the match, or nothing is.
_RUN = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){%s}+(?![ -]?[0-9])"
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": _RUN % "15,18",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++(?![A-Za-z0-9._%+-]*+@)",
    "ip": r"(?<![0-9A-Fa-f:])(?<![0-9]\.)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:]|\.[0-9])",
    "card": _RUN % "12,14",
    # A base match is taken first, so that what lies in it is no loose one.
    "phone": STRICT["phone"] + r"|(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold for the pattern to match: cheap to test.
NEEDS = {
    ("email", True): lambda t: t.contains("@"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    ("phone", True): lambda t: t.contains("+"),
    ("email", False): lambda t: t.contains("(at)") | t.contains("[at]"),
    ("ip", False): lambda t: t.rlike(r":[0-9A-Fa-f]{1,4}:"),
    ("card", False): lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
}

GAZETTEER = {
    "email": r"(?i)[.) \]](?:com|org|net|edu|gov|info|io|dev|app|biz|example|test|de|fr|es|it|nl|uk|us|eu|ch|at|be|ca|au|jp|cn|in|br)$",
    "ip": r"^(?:(?!0+\.|255\.|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.)[0-9]|[23][0-9A-Fa-f]{3}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|65|62)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|from|to|cc|kontakt|correo|courriel|@)\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|from|login|connect\w*|ping)\W*$",
    "card": r"(?i)(?:card|visa|master\w*|amex|credit|debit|pay\w*|karte|carte|tarjeta)\W*(?:no|number|nr)?\W*$",
    "phone": r"(?i)(?:phone|tel\w*|call|mobile|cell|fax|whatsapp|sms|contact|numero|nummer)\W*(?:no|number|nr)?\W*$",
}
AGAINST = r"(?i)(?:order|invoice|version|release|isbn|issn|sku|serial|section|chapter|figure|table|ref|id|page|hash|v)\W*$"
CONTEXT_CHARS = 32

_MARK, _OTHER = "\ue000", "\ue001"  # a private-use mark around matches; one in the text is exchanged for another


def _pieces(text: Column, pattern: str) -> Column:
    clean = F.when(text.contains(_MARK), F.translate(text, _MARK, _OTHER)).otherwise(text)
    return F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


_SPANS = "array<struct<start:int,end:int,s:string,before:string>>"
#: Pieces of a text that one fold goes through; even, so that each begins outside a match.
FOLD = 64


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, needs: Column) -> Column:
    """Leftmost non-overlapping matches with code point places and the characters before.

    The text is cut at marks put around each match, and every second piece is a match; running sums of the pieces' lengths give
    the places.  A fold copies what it has gathered at each step, so pieces are folded FOLD at a time, each from its own start.
    """

    def spans(part: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.lit(False).alias("inside"), F.lit("").alias("before"), F.array().cast(_SPANS).alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            end = acc["at"] + F.char_length(piece)
            span = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("s"), acc["before"].alias("before"))
            return F.struct(
                end.alias("at"),
                (~acc["inside"]).alias("inside"),
                F.when(acc["inside"], F.lit("")).otherwise(F.right(piece, F.lit(CONTEXT_CHARS))).alias("before"),
                F.when(acc["inside"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(part, zero, step, lambda acc: acc["out"])

    def folded(pieces: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(FOLD))
        length = lambda first: F.aggregate(F.slice(pieces, first, F.lit(FOLD)), F.lit(0), lambda n, x: n + F.char_length(x))
        starts = F.aggregate(F.transform(firsts, length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        both = F.arrays_zip(firsts.alias("first"), F.slice(starts, F.lit(1), F.size(firsts)).alias("start"))
        return F.flatten(F.transform(both, lambda x: spans(F.slice(pieces, x["first"], F.lit(FOLD)), x["start"])))

    return F.when(needs, _let(_pieces(text, pattern), folded)).otherwise(F.array().cast(_SPANS))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(s)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _loose_ok(kind: str, s: Column) -> Column:
    if kind == "card":
        digits = _digits(s)
        return F.when(F.length(digits).between(13, 15), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return ~s.startswith("+")
    return F.lit(True)


def _votes(kind: str, x: Column, base: bool) -> list[Column]:
    vote = lambda yes, no=None: F.when(yes, F.lit(1)).when(no if no is not None else F.lit(False), F.lit(-1)).otherwise(F.lit(0))
    s, digits = x["s"], _digits(x["s"])
    known = s.rlike(GAZETTEER[kind])
    even = F.length(F.regexp_replace(digits, "(.)\\1*", "$1"))
    shape = {
        "email": vote((F.length(s) >= 8) & (F.length(s) <= 64), F.length(s) > 128),
        "ip": vote(F.length(s) >= 9, F.length(s) < 8),
        "card": vote((even > 4) & s.rlike("^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"), even <= 3),
        "phone": vote((even > 4) & F.length(digits).between(10, 13), even <= 3),
    }[kind]
    return [F.lit(1 if base else 0), vote(known, ~known), vote(x["before"].rlike(CONTEXT[kind]), x["before"].rlike(AGAINST)), shape]


def _kind_candidates(text: Column, k: int, kind: str, base: bool) -> Column:
    check = _valid if base else _loose_ok
    spans = _matches(text, (STRICT if base else LOOSE)[kind], NEEDS[kind, base](text))

    def entry(x: Column) -> Column:
        votes = (v.alias(f"v{i}") for i, v in enumerate(_votes(kind, x, base)))
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), *votes)

    return F.transform(F.filter(spans, lambda x: check(kind, x["s"])), entry)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: an array of (kind index, start, end, base, four votes) of each document, by kind and start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_kind_candidates(text, k, kind, base) for k, kind in enumerate(KINDS) for base in (True, False)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array_sort(F.concat(*found)).alias("spans"))


# ---------------------------------------------------------------- reliabilities and span classifier


def reliabilities(patterns: list[tuple], rounds: int = 50) -> tuple[list[float], list[dict[int, list[float]]], list[float]]:
    """Expectation-maximisation over (kind, v0..v3, count): prior of each kind, P(vote | class) of each labeler, posteriors.

    Starts from the votes' mean, so class 1 is what labelers vote for.  Counts of 1 are added to each cell.
    """
    total = lambda p: sum(p[1:5])
    post = [1 / (1 + math.exp(-1.5 * (total(p) - 1))) for p in patterns]
    prior, tables = [0.5] * len(KINDS), []
    for _ in range(rounds):
        prior = []
        for k in range(len(KINDS)):
            mine = [(p[5], q) for p, q in zip(patterns, post, strict=True) if p[0] == k]
            prior.append((1 + sum(n * q for n, q in mine)) / (2 + sum(n for n, _ in mine)))
        tables = []
        for j in range(4):
            cell = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, q in zip(patterns, post, strict=True):
                cell[p[1 + j]][1] += p[5] * q
                cell[p[1 + j]][0] += p[5] * (1 - q)
            sums = [sum(cell[v][c] for v in cell) for c in (0, 1)]
            tables.append({v: [cell[v][c] / sums[c] for c in (0, 1)] for v in cell})
        new = []
        for p in patterns:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(math.log(tables[j][p[1 + j]][1] / tables[j][p[1 + j]][0]) for j in range(4))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0)
        post = new
        if moved < 1e-6:
            break
    return prior, tables, post


def _inputs(p: tuple) -> list[float]:
    """Bias, kind, and agreement and objection of the labelers that look at a span (not of the strict pattern)."""
    return [1.0, *(float(p[0] == k) for k in range(len(KINDS))), *(float(p[j] > 0) for j in (2, 3, 4)), *(float(p[j] < 0) for j in (2, 3, 4))]


def train_spans(patterns: list[tuple], post: list[float], rounds: int = 300) -> list[float]:
    """Logistic regression on soft labels, by gradient steps on the pattern counts with a small ridge."""
    rows = [(_inputs(p), q, p[5]) for p, q in zip(patterns, post, strict=True)]
    n = sum(r[2] for r in rows) or 1
    w = [0.0] * (1 + len(KINDS) + 6)
    for _ in range(rounds):
        grad = [0.002 * x for x in w]
        for x, q, many in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, xi in enumerate(x):
                if xi:
                    grad[i] += (p - q) * many / n * xi
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _accepted(x: Column, w: list[float]) -> Column:
    kinds = F.element_at(F.array(*(F.lit(w[1 + k]) for k in range(len(KINDS)))), x["kind"] + 1)
    logit = F.lit(w[0]) + kinds
    for i, j in enumerate((1, 2, 3)):
        v = x[f"v{j}"]
        logit = logit + F.when(v > 0, F.lit(w[5 + i])).when(v < 0, F.lit(w[8 + i])).otherwise(F.lit(0.0))
    return logit >= 0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each document: the base spans and the accepted loose ones."""
    found = materialise(candidates(docs, id_col, text_col), "pii")
    one = found.select(F.explode("spans").alias("x")).select("x.kind", "x.v0", "x.v1", "x.v2", "x.v3")
    counts = one.groupBy("kind", "v0", "v1", "v2", "v3").agg(F.count("*").alias("many"))
    patterns = sorted(tuple(r) for r in counts.collect())  # 4 kinds x 2 x 27 rows at most
    _, _, post = reliabilities(patterns)
    w = train_spans(patterns, post)
    spans = F.col("spans")
    keep = F.transform(F.filter(spans, lambda x: x["base"] | _accepted(x, w)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    return found.select("doc_id", F.array_sort(keep).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda some: F.array_join(F.transform(some, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k))
    counts = [count(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
