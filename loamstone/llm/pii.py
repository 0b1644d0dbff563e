"""Personal data by weak supervision, with DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always
stay. Further candidates (national numbers, bank accounts, local phone numbers,
spelled-out addresses, persons) come from wider patterns. On every candidate five
labelers vote for, against or not at all: its shape, its checks, gazetteers, the
words before it, and the characters around it. Expectation-maximisation (Dawid &
Skene 1979) estimates from the votes alone how far each labeler can be trusted;
the posteriors are the soft labels of a logistic span classifier over kind, votes
and shape, which decides on the further candidates.

Candidates are found in one row's own arrays, so nothing but counts of vote
patterns is shuffled (their number is bounded: kinds x votes x flags); the
estimates are made from those counts on the driver. Texts are searched once: the
candidates are kept in the shared folder for the estimates and for the decision.
No length of a span or of the text before it is limited, but where a format has
one (account numbers have 15 to 34 signs).

Patterns are written with possessive quantifiers and look-behinds so that long
runs of one character class are scanned once; they match what the plain forms do.

Defined results: a null text is an empty one and has no spans. Overlapping base
spans of different kinds all stay; a further span that overlaps a base span is
left out. Rows are judged one by one; all other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import fresh, stored

# The base patterns, equal to the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "phone": "+"}
_TITLES = "Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Doña|Don"
#: Common given names of the four languages of the fixtures.
NAMES = ["Alice", "Andrea", "Anna", "Antonio", "Carlos", "Carmen", "Charles", "Claire", "David", "Elena", "Elizabeth", "Emma", "Francisco", "François", "Hans", "Isabel", "James", "Jean", "John", "José", "Juan", "Julia", "Jürgen", "Karl", "Klaus", "Laura", "Louis", "Luis", "Manuel", "Maria", "María", "Marie", "Mary", "Michael", "Miguel", "Monika", "Nicolas", "Patricia", "Paul", "Peter", "Pierre", "Robert", "Sabine", "Sophie", "Stefan", "Susan", "Thomas", "Ursula", "William", "Wolfgang"]
#: Country codes of bank account numbers, and common top-level domains.
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE"
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu"
MORE = (
    r"(?<![0-9A-Za-z._%+@-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
    r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?"
    r"|[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{2,}+)++"
    rf"|(?:{_TITLES})\.?\x20\p{{Lu}}[\p{{L}}'-]++(?:\x20\p{{Lu}}[\p{{L}}'-]++)?"
    rf"|(?:{'|'.join(NAMES)})\x20\p{{Lu}}[\p{{L}}'-]++)(?![0-9\p{{L}}])"
)
KINDS = [*BASE, "account", "address", "local_phone", "national", "person"]
LABELERS = ["shape", "checks", "gazetteer", "context", "edges"]
FLAGS = ["long", "many_digits", "capital", "after_colon"]
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words before a span that speak for it, by kind, and against any.
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|kontakt|correo|courriel|adresse?)\W*$",
    "ip": r"(?i)(ip|address|host|server|login|client|adresse?|dirección)\W*$",
    "card": r"(?i)(card|visa|mastercard|amex|karte|carte|tarjeta|payment|konto)\W*(?:no\.?|number|nr\.?)?\W*$",
    "phone": r"(?i)(tel|phone|call|mobile|fax|telefon|téléphone|teléfono|contact)\W*$",
    "account": r"(?i)(iban|account|konto|compte|cuenta|bank)\W*(?:no\.?|number|nr\.?)?\W*$",
    "address": r"(?i)(e-?mail|mail|contact|write|kontakt|correo|courriel)\W*$",
    "local_phone": r"(?i)(tel|phone|call|mobile|fax|telefon|téléphone|teléfono|contact)\W*$",
    "national": r"(?i)(ssn|social security|id|identity|passport|ausweis|dni|nif)\W*(?:no\.?|number|nr\.?)?\W*$",
    "person": r"(?i)(name|named|called|by|from|dear|contact|signed|von|por|par)\W*$",
}
COUNTER = r"(?i)(version|v|release|figure|fig|table|section|isbn|issn|order|invoice|page|part|model|serial)\W*(?:no\.?|nr\.?)?\W*$"
BLOCK = 128


def _running(widths: Column) -> Column:
    """Prefix sums of an array, in blocks, so that long arrays don't cost their square."""
    run = lambda xs: F.aggregate(xs, F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / BLOCK).cast("int")), lambda b: F.slice(widths, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, run)
    bases = run(F.transform(sums, lambda s: F.element_at(s, -1)))
    shifted = F.transform(sums, lambda s, i: F.transform(s, lambda x: x + F.when(i > 0, F.element_at(bases, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))))
    return F.flatten(shifted)


def _found(m: str, g: str) -> Column:
    """Spans of the matches m, which lie between the pieces g of the text."""
    widths = F.zip_with(F.col(m), F.slice(F.col(g), F.lit(1), F.size(m)), lambda x, y: (F.length(x) + F.length(y)).cast("long"))
    ends = _running(widths)
    made = F.transform(F.arrays_zip(F.col(m).alias("s"), ends.alias("e"), F.slice(F.col(g), F.lit(1), F.size(m)).alias("l"), F.slice(F.col(g), F.lit(2), F.size(m)).alias("r")), lambda z: F.struct((z["e"] - F.length(z["s"])).alias("start"), z["e"].alias("end"), z["s"].alias("s"), z["l"].alias("left"), F.substring(z["r"], 1, 1).alias("right")))
    return F.when(F.size(m) > 0, made).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,s:string,left:string,right:string>>"))


def _digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def _good(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(_digits(s).between(16, 19), F.call_function("luhn_check", F.regexp_replace(s, "[^0-9]", ""))).otherwise(F.lit(False))
    if kind == "phone":
        return _digits(s).between(8, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda z: _good(kind, z["s"])


def _judge(kind: str) -> Callable[[Column], Column]:
    return lambda z: _judged(F.lit(kind), z)


def _more_kind(s: Column) -> Column:
    return (
        F.when(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national")
        .when(s.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]"), "local_phone")
        .when(s.rlike(r"^[A-Z]{2}[0-9]{2}[\x20A-Z0-9]+$"), "account")
        .when(s.rlike(r"[(\[]at[)\]]"), "address")
        .otherwise("person")
    )


def _vote(for_: Column, against: Column) -> Column:
    return F.when(against, -1).when(for_, 1).otherwise(0)


def _judged(kind: Column, z: Column) -> Column:
    """The struct of a candidate: place, votes and flags."""
    s, left, right = z["s"], z["left"], z["right"]
    base = kind.isin(*BASE)
    no = F.lit(False)
    cue = F.lit(False)
    for k, pattern in CUES.items():
        cue = cue | ((kind == k) & left.rlike(pattern))
    compact = F.regexp_replace(s, r"\x20", "")
    votes = {
        "shape": _vote(base | kind.isin("national", "account", "address") | ((kind == "person") & s.rlike(rf"^(?:{_TITLES})\.?\x20")) | s.startswith("("), no),
        "checks": _vote(
            base | ((kind == "national") & s.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")) | ((kind == "account") & F.length(compact).between(15, 34) & s.rlike(rf"^(?:{COUNTRIES})")),
            ((kind == "national") & s.rlike(r"^(?:000|666|9)|-00-|-0000$")) | ((kind == "account") & ~s.rlike(rf"^(?:{COUNTRIES})")),
        ),
        "gazetteer": _vote(((kind == "person") & s.rlike(rf"(?:^|\x20)(?:{'|'.join(NAMES)})(?:\x20|$)")) | (kind.isin("email", "address") & s.rlike(rf"(?i)[.)\]]\x20?(?:{DOMAINS})$")), no),
        "context": _vote(cue, left.rlike(COUNTER)),
        "edges": _vote(F.lit(True), left.rlike(r"[0-9A-Za-z]$") | right.rlike(r"^[0-9A-Za-z]")),
    }
    flags = {"long": F.length(s) > 20, "many_digits": _digits(s) >= 8, "capital": s.rlike(r"^\p{Lu}"), "after_colon": left.rlike(r":\s*$")}
    return F.struct(kind.alias("kind"), z["start"].alias("start"), z["end"].alias("end"), *(v.cast("int").alias(k) for k, v in votes.items()), *(v.cast("int").alias(k) for k, v in flags.items()))


def candidates(docs: DataFrame, text_col: str = "text", names: tuple[str, str] = ("base", "more")) -> DataFrame:
    """docs with two arrays of judged candidates under `names` (not names of docs' columns), in order of kind and start."""
    none = F.array().cast("array<string>")
    patterns = BASE | {"more": MORE}
    t = fresh("__text", docs)
    m, g, s = ({k: fresh(f"__{x}_{k}", docs) for k in patterns} for x in "mgs")
    base, further = names
    held = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    found = {k: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in patterns.items()}
    held = held.withColumns({m[k]: F.when(F.contains(t, F.lit(GUARD[k])), v).otherwise(none) if k in GUARD else v for k, v in found.items()})
    held = held.withColumns({g[k]: F.when(F.size(m[k]) > 0, F.split(t, p, -1)).otherwise(none) for k, p in patterns.items()})
    held = held.withColumns({s[k]: _found(m[k], g[k]) for k in patterns})
    held = held.withColumns({s[k]: F.filter(s[k], _check(k)) for k in BASE})
    held = held.withColumn(base, F.concat(*(F.transform(s[k], _judge(k)) for k in BASE)))
    more = F.transform(s["more"], lambda z: _judged(_more_kind(z["s"]), z))
    held = held.withColumn(further, F.array_sort(F.filter(more, lambda z: ~F.exists(base, lambda b: (b["start"] < z["end"]) & (z["start"] < b["end"])))))
    return held.drop(t, *m.values(), *g.values(), *s.values())


@dataclass
class Model:
    prior: float
    #: reliability[labeler][y][vote + 1] = P(vote | y)
    reliability: dict[str, list[list[float]]]
    weights: dict[str, float]

    def logit(self, z: Column) -> Column:
        total = F.lit(self.weights["bias"])
        for k in KINDS:
            total = total + F.when(z["kind"] == k, self.weights[f"kind:{k}"]).otherwise(0.0)
        for k in LABELERS:
            total = total + F.when(z[k] > 0, self.weights[f"{k}:+"]).when(z[k] < 0, self.weights[f"{k}:-"]).otherwise(0.0)
        for k in FLAGS:
            total = total + z[k] * F.lit(self.weights[f"flag:{k}"])
        return total


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Posteriors of each vote pattern, the prior, and P(vote | y) as (labelers, 2, 3). n: how often each pattern occurs."""
    post = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    table = np.zeros((votes.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        prior = float((n @ post + 1) / (n.sum() + 2))
        for y, w in enumerate((n * (1 - post), n * post)):
            for v in (-1, 0, 1):
                table[:, y, v + 1] = ((votes == v) * w[:, None]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table)
        ll = [sum(logs[k, y, votes[:, k] + 1] for k in range(votes.shape[1])) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(math.log(1 - prior) - math.log(prior) + ll[0] - ll[1], -35, 35)))
        moved = float(np.abs(new - post).max(initial=0.0))
        post = new
        if moved < 1e-9:
            break
    return post, prior, table


def _logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights fitted to soft labels p by Newton's method; the first column is the bias."""
    w = np.zeros(x.shape[1])
    pen = ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + pen, x.T @ (n * (p - q)) - pen @ w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Estimates over the candidates of all rows."""
    names = fresh("__base", docs), fresh("__more", docs)
    return _estimated(candidates(docs.select(text_col), text_col, names), names)


def _estimated(held: DataFrame, names: tuple[str, str]) -> Model:
    every = held.select(F.explode(F.concat(*names)).alias("z")).select("z.*")
    got = every.groupBy("kind", *LABELERS, *FLAGS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS, *FLAGS).collect()
    n = np.array([r.n for r in got], float)
    votes = np.array([[r[k] for k in LABELERS] for r in got], int).reshape(len(got), len(LABELERS))
    post, prior, table = estimate(votes, n)
    names = ["bias", *(f"kind:{k}" for k in KINDS), *(f"{k}:{s}" for k in LABELERS for s in "+-"), *(f"flag:{k}" for k in FLAGS)]
    x = np.array([[1.0, *(r.kind == k for k in KINDS), *((r[k] > 0) if s == "+" else (r[k] < 0) for k in LABELERS for s in "+-"), *(r[k] for k in FLAGS)] for r in got], float).reshape(len(got), len(names))
    w = _logistic(x, post, n) if len(got) else np.zeros(len(names))
    return Model(prior, {k: table[i].tolist() for i, k in enumerate(LABELERS)}, dict(zip(names, w.tolist(), strict=True)))


def find(docs: DataFrame, model: Model | None = None, *, text_col: str = "text", keep_text: bool = True, least: float = 0.5, names: tuple[str, str] = ("base_spans", "more_spans")) -> DataFrame:
    """docs with two arrays of (kind, start, end) under `names`; columns of these names are replaced.

    Without a model, one is estimated from docs' own candidates. These are then kept in
    the shared folder beside docs' columns, so texts are searched once; without
    keep_text the text column is left out there and in the result.
    """
    cut = math.log(least / (1 - least))
    place = lambda z: F.struct(z["kind"].alias("kind"), z["start"].alias("start"), z["end"].alias("end"))
    docs = docs.drop(*names)
    base, further = fresh("__base", docs), fresh("__more", docs)
    held = candidates(docs, text_col, (base, further))
    held = held if keep_text else held.drop(text_col)
    if model is None:
        held = stored(held, "pii-candidates")
        model = _estimated(held, (base, further))
    held = held.withColumns({names[0]: F.transform(base, place), names[1]: F.transform(F.filter(further, lambda z: model.logit(z) >= cut), place)})
    return held.drop(base, further)


def spans_text(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", z["kind"], z["start"], z["end"])), ",")


def redact(docs: DataFrame, model: Model | None = None, *, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans go together, under the first one's kind."""
    names = fresh("__base_spans", docs), fresh("__more_spans", docs)
    held = find(docs, model, text_col=text_col, names=names)
    spans = F.array_sort(F.transform(F.concat(*names), lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end"), z["kind"].alias("kind"))))
    t = F.col(text_col)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        fresh_part = F.concat(acc["out"], F.array(F.substring(t, acc["at"].cast("int") + 1, (z["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(z["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], z["end"]).alias("at"), F.when(z["start"] >= acc["at"], fresh_part).otherwise(acc["out"]).alias("out"))

    built = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"].cast("int") + 1, F.length(t))))
    return held.withColumn(text_col, F.when(F.size(F.concat(*names)) > 0, built).otherwise(t)).drop(*names).select(*docs.columns)
