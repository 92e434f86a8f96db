"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from one strict pattern a kind with its check.  Looser
candidates add what the patterns miss: card numbers inside longer runs of
digits, phone numbers without a plus sign, and secret keys.  Five labelers
vote on every candidate, for, against or not at all:

    pattern    the strict form of the kind
    gazetteer  top-level domains, issuer digits, country codes, key prefixes
    context    cue words shortly before it
    checksum   Luhn, address and length checks
    shape      repeated characters, or a mix of letters and digits

Candidates are counted by kind, votes and length class, a few thousand patterns
at most whatever the corpus.  On these counts the driver estimates by
expectation-maximisation how reliable each labeler is, and trains a logistic
span classifier on the posteriors.  Its decisions for all patterns go back
into the plan.  Base spans stay whatever it says.

Cases: a null text is an empty one, and stays null when redacted.  Empty texts
and tables give no spans.  Repeated rows are judged alike.  Spans are ordered by
kind (email, ip, card, phone, then the method's own kind, secret) and start, so
there are no ties.  Other columns are kept whatever they are called.  A text of
any length is judged whole; it has to fit a task, as any row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fresh, materialise

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("card", "phone", "secret")

#: The patterns of the contract.  Look-behinds, \G and possessive repeats only spare
#: retries inside a run of characters that would end at the same place.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "card": r"(?<![0-9.])[0-9]{13,19}+(?![0-9])",
    "phone": r"(?<![0-9+)\x20-])(?<![0-9][\x20-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_/+=.-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{20,}+(?:\.[A-Za-z0-9_/+-]{16,}+)*+",
}
#: A text without these has no candidate of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE_NEEDS = {"card": "[0-9]{13}", "phone": "[0-9]{3}", "secret": "[0-9]"}
CUES = {
    "email": r"(?i)(mail|contact|write|from|to)\W*$",
    "ip": r"(?i)(\bip|host|server|address|addr|from)\W*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|payment|account)\W*$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|whatsapp)\W*$",
    "secret": r"(?i)(token|secret|password|passwd|api[_ -]?key|key|bearer|auth)\W*$",
}
AGAINST = r"(?i)(version|isbn|issn|doi|order|invoice|page|chapter|commit|sha1|md5|id)\W*$"
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|us|eu|ch|at|ca|au)$",
    "ip": r"^([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[4-7]|6011|65|62)",
    "phone": r"^\+?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9]",
    "secret": r"^(sk|pk|ghp|gho|xox|AKIA|eyJ|AIza)[A-Za-z0-9_-]|^[0-9a-f]{32,}$",
}
VOTERS = 5


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>>: leftmost non-overlapping matches with their code-point offsets."""
    kind = "array<struct<s:int,e:int,v:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v")))).alias("out"))

    def placed(p: Column) -> Column:
        steps = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["found"])), p["found"], lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
        return F.aggregate(steps, zero, step, lambda a: a["out"])

    # As a lambda's argument the two lists are made once, however often it names them.
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.transform(F.array(both), placed)[0]


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Luhn check of the digits of v."""
    places = F.transform(F.split(F.reverse(digits(v)), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits(v)).between(13, 19) & luhn(v)
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    need = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.when(need, F.filter(spans(text, BASE[kind]), lambda x: valid(kind, x["v"]))).otherwise(none)


def apart(candidates: Column, taken: Column) -> Column:
    """The candidates that overlap none of the spans in `taken`."""
    return F.filter(candidates, lambda c: ~F.exists(taken, lambda t: (c["s"] < t["e"]) & (t["s"] < c["e"])))


def votes(kind: str, v: Column, before: Column, strict: Column) -> Column:
    """One letter for each labeler: y for, n against, - for no vote; then a length class."""
    number = digits(v)
    yes = lambda c: F.when(c, "y")
    checks = {
        "email": yes(F.length(v) <= 100).otherwise("n"),
        "ip": yes(valid("ip", v)).otherwise("n"),
        "card": yes(luhn(v)).otherwise("n"),
        "phone": yes(F.length(number).between(10, 13)).otherwise("-"),
        "secret": yes(F.length(F.regexp_replace(v, "[^0-9]", "")) >= 4).otherwise("n"),
    }
    shapes = {
        "secret": yes(v.rlike("[0-9][A-Za-z].*[0-9][A-Za-z]")).otherwise("n"),
        "email": yes(v.rlike("^[A-Za-z0-9]")).otherwise("-"),
    }
    repeated = F.when(number.rlike(r"(.)\1{5,}"), "n").otherwise("-")
    return F.concat(
        F.lit(kind), F.lit(":"),
        yes(strict).otherwise("-"),
        yes(v.rlike(GAZETTEER[kind])).otherwise("-"),
        F.when(before.rlike(CUES[kind]), "y").when(before.rlike(AGAINST), "n").otherwise("-"),
        checks[kind],
        shapes.get(kind, repeated),
        F.least(F.floor(F.length(v) / 8), F.lit(7)).cast("string"),
    )


def candidates(text: Column) -> Column:
    """struct of `base` (kind, s, e, code) and `more` (the same, of looser candidates apart from base) of a text."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def coded(t: Column, kind: str, found: Column, strict: bool) -> Column:
        before = lambda x: F.substring(t, F.greatest(x["s"] - 15, F.lit(1)), F.least(x["s"], F.lit(16)))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), votes(kind, x["v"], before(x), F.lit(strict)).alias("code")))

    def strict(t: Column) -> Column:
        return F.struct(t.alias("t"), F.concat(*(coded(t, k, base_spans(t, k), True) for k in KINDS)).alias("base"))

    def loose(x: Column) -> Column:
        found = (coded(x["t"], k, F.when(x["t"].rlike(LOOSE_NEEDS[k]), apart(spans(x["t"], LOOSE[k]), x["base"])).otherwise(none), False) for k in EXTRA)
        return F.struct(x["base"].alias("base"), F.concat(*found).alias("more"))

    # As lambdas' arguments the text and its base spans are made once, however often they are named.
    return F.transform(F.transform(F.array(F.coalesce(text, F.lit(""))), strict), loose)[0]


@dataclass(frozen=True)
class SpanModel:
    #: Codes whose looser candidates count as personal data.
    accepted: tuple[str, ...]
    #: Labeler, estimated share of right votes.
    reliability: dict[str, float] = field(default_factory=dict)


def _features(code: str, kinds: list[str]) -> np.ndarray:
    kind, rest = code.split(":")
    row = [float(kind == k) for k in kinds]
    row += [float(rest[i] == c) for i, c in itertools.product(range(VOTERS), "yn")]
    return np.array([*row, int(rest[VOTERS]) / 7, 1.0])


def train(counts: dict[str, int], rounds: int = 60) -> SpanModel:
    """EM over the labelers' votes, then a logistic classifier on the posteriors."""
    codes = sorted(counts)
    if not codes:
        return SpanModel(())
    n = np.array([counts[c] for c in codes], float)
    n = np.minimum(n, n.sum()) ** 0.5  # frequent patterns must not drown the others
    ballots = np.array([[{"y": 1, "n": -1, "-": 0}[x] for x in c.split(":")[1][:VOTERS]] for c in codes])
    prior, right = 0.5, np.full(VOTERS, 0.8)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (ballots * np.log(right / (1 - right))).sum(axis=1)
        p = 1 / (1 + np.exp(-odds))
        cast = n[:, None] * (ballots != 0)
        agree = np.where(ballots > 0, p[:, None], 1 - p[:, None])
        right = np.clip(((cast * agree).sum(axis=0) + 8) / (cast.sum(axis=0) + 10), 0.55, 0.99)
        prior = float(np.clip((n @ p + 1) / (n.sum() + 2), 0.05, 0.95))
    kinds = sorted({c.split(":")[0] for c in codes})
    x, w = np.array([_features(c, kinds) for c in codes]), np.zeros(len(kinds) + 2 * VOTERS + 2)
    for _ in range(40):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (p - q)) - 0.1 * w
        hess = (x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    accepted = tuple(c for c, s in zip(codes, x @ w, strict=True) if s >= 0)
    names = ("pattern", "gazetteer", "context", "checksum", "shape")
    return SpanModel(accepted, dict(zip(names, right.tolist(), strict=True)))


def fit(found: DataFrame, column: str = "found") -> SpanModel:
    """A model from the candidates of all rows of `found`, in the struct `column`."""
    rows = found.select(F.explode(F.concat(f"{column}.base.code", f"{column}.more.code")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return train({r["code"]: r["n"] for r in rows.collect()})  # at most some thousand codes exist


ORDER = ("email", "ip", "card", "phone", "secret")


def all_spans(model: SpanModel, found: str = "found") -> Column:
    """Base spans and accepted candidates of the struct `found`, by kind and start."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, ORDER)), x["kind"])
    more = F.filter(f"{found}.more", lambda x: x["code"].isin(*model.accepted) if model.accepted else F.lit(False))
    keyed = F.transform(F.concat(f"{found}.base", more), lambda x: F.struct(rank(x).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def count_of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): base and all spans of every row, each (kind, s, e)."""
    found = materialise(df.select(F.col(id_col).alias("doc_id"), candidates(F.col(text_col)).alias("found")), "candidates")
    return found.select("doc_id", F.col("found.base").alias("base"), all_spans(fit(found)).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its texts replaced by its kind in angle brackets."""
    name = fresh("_found", df)
    marked = materialise(df.withColumn(name, candidates(F.col(text_col))), "marked")
    by_place = F.array_sort(F.transform(all_spans(fit(marked, name), name), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text = F.col(text_col)
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    step = lambda a, x: F.when(x["s"] < a["at"], F.struct(a["t"].alias("t"), F.greatest(a["at"], x["e"]).alias("at"))).otherwise(F.struct(F.concat(a["t"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("t"), x["e"].alias("at")))
    done = F.aggregate(by_place, zero, step, lambda a: F.concat(a["t"], F.substring(text, a["at"] + 1, F.length(text))))
    empty = (F.size(f"{name}.base") == 0) & (F.size(f"{name}.more") == 0)
    return marked.withColumn(text_col, F.when(text.isNull() | empty, text).otherwise(done)).select(*df.columns)
