"""Personal data by weak supervision, in SQL expressions only.

Candidates are the base matches of four kinds (email, ip, card, phone) and looser
forms of them: spelled-out mail addresses, IPv6, national phone numbers, and runs
of 12 to 19 digits that fail the check of card numbers (misread or masked ones,
but also order and serial numbers).  Three labelers vote on each, yes, no or
nothing: its form (a strict pattern or check), a gazetteer (mail domains, card
issuers, number plans, reserved networks) and the words around it.  The votes of
all candidates of the table are counted per pattern, a table of at most 4 x 27 x 8
rows whatever the corpus, and expectation-maximisation estimates from it how far
each labeler can be trusted for each kind.  The posteriors train a logistic span
classifier over votes, kind and shape, whose weights return as column arithmetic.
Every span comes with its probability.  Base matches always stay; other candidates
stay at a probability of ``keep`` or more where they overlap no base match.

The driver does the arithmetic of the fit on the counted patterns; rows are only
ever met by the engine's own functions.  Patterns are possessive and matches are
placed in blocks (see ``spans``), so long texts take time in proportion.

Defined cases: a null text counts as empty and has no spans; repeated rows are
judged each; spans are code points, stop exclusive; an empty table fits nothing
and gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import materialize, table
from glossmill.llm.spans import apart, count_of, joined, luhn, matches, nothing, replaced

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with loops made possessive where that cannot change a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms, of the kinds email, ip and phone.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z]{2,24}+"
IPV6 = r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"
NATIONAL = r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])"

# Strict forms of the first labeler, for and against, by kind.
FORMS = {
    0: (r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]++(?<=\.[A-Za-z]{2,24})$", r"\.\.|^[.-]|@-|[.-]@|@[0-9.]+$"),
    1: (r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$", r"(?:^|\.)0[0-9]"),
    3: (r"^\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{2,5}$", r"([0-9])\1{6}|[-.()\x20]{3}"),
}
# Gazetteers of the second labeler.
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl", "be", "example")
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35|30|36|38)"
RESERVED_NETS = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
# Words of the third labeler, for and against.
CUES = {
    0: r"(?i)(?:mail|contact|write|reach|courriel|correo)[^\n]{0,12}+$",
    1: r"(?i)(?:\bip\b|address|host|server|client|login)[^\n]{0,12}+$",
    2: r"(?i)(?:card|visa|credit|payment|carte|karte|tarjeta)[^\n]{0,12}+$",
    3: r"(?i)(?:phone|call|tel|mobile|fax|t[ée]l[ée]fono|anruf)[^\n]{0,12}+$",
}
AGAINST = r"(?i)(?:version|build|isbn|serial|order|invoice|sku|section)[^\n]{0,6}+$"
#: What follows a match that is part of something longer.
LONGER = r"^(?:[.:_-]?[0-9]|[A-Za-z_/])"


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _when(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(nothing())


def _digit_runs(text: Column) -> Column:
    """Maximal runs of 12 to 19 digits, single spaces and hyphens between them."""
    runs = F.filter(matches(text, CARD, 2), lambda s: F.length(_digits(s["word"])).between(12, 19))
    return _when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), runs)


def _base(text: Column, runs: Column) -> Column:
    """Base spans of all kinds that pass their check; ``runs`` has those of ``_digit_runs``."""

    def small(s: Column) -> Column:
        return F.forall(F.split(s["word"], r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)

    return F.concat(
        _when(F.contains(text, F.lit("@")), matches(text, EMAIL, 0)),
        _when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP, 1), small)),
        F.filter(runs, lambda s: luhn(_digits(s["word"]))),
        _when(
            F.contains(text, F.lit("+")),
            F.filter(matches(text, PHONE, 3), lambda s: F.length(_digits(s["word"])).between(9, 15)),
        ),
    )


def _loose(text: Column, runs: Column) -> Column:
    """Candidates of looser form."""
    return F.concat(
        _when(text.rlike(r"[\[(](?i:at)[\])]"), matches(text, SPELLED, 0)),
        _when(text.rlike(r"(?:[0-9a-fA-F]{1,4}:){7}"), matches(text, IPV6, 1)),
        F.filter(runs, lambda s: ~luhn(_digits(s["word"]))),
        _when(text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), matches(text, NATIONAL, 3)),
    )


def _vote(yes: Column, no: Column) -> Column:
    """1 yes, 0 no, 2 nothing."""
    return F.when(yes, 1).when(no, 0).otherwise(2)


def _judged(s: Column, base: bool) -> Column:
    """A candidate with its votes and shape, all small integers."""
    kind, word, before = s["kind"], s["word"], s["before"]
    digits = _digits(word)
    ending = F.lower(F.regexp_extract(word, r"([A-Za-z0-9-]+)$", 1))
    form = F.when(kind == 2, F.when(luhn(digits), 1).otherwise(0))
    for k, (good, bad) in FORMS.items():
        form = form.when(kind == k, _vote(word.rlike(good) & ~word.rlike(bad), word.rlike(bad)))
    listed = (
        F.when(kind == 0, _vote(ending.isin(*MAIL_ENDINGS), ending.rlike("^[0-9]+$")))
        .when(kind == 1, _vote(~word.rlike(RESERVED_NETS) & word.rlike(r"\."), word.rlike(r"^0\.")))
        .when(kind == 2, _vote(digits.rlike(CARD_ISSUERS), ~digits.rlike(CARD_ISSUERS)))
        .otherwise(_vote(digits.rlike("^(?:1|2[07]|3[0-469]|4[0-9])[2-9]?"), digits.rlike("^0{3}")))
    )
    cue = F.lit(False)
    for k, pattern in CUES.items():
        cue = cue | ((kind == k) & before.rlike(pattern))
    context = _vote(cue, before.rlike(AGAINST) | s["after"].rlike(LONGER))
    shape = (
        F.when(F.length(word) > 24, 1).otherwise(0)
        + F.when(F.length(digits) * 2 > F.length(word), 2).otherwise(0)
        + F.when(before.rlike(r"[A-Za-z0-9]$"), 4).otherwise(0)
    )
    return F.struct(
        s["start"].alias("start"),
        s["stop"].alias("stop"),
        kind.alias("kind"),
        F.lit(base).alias("base"),
        form.cast("int").alias("form"),
        listed.cast("int").alias("listed"),
        context.cast("int").alias("context"),
        shape.cast("int").alias("shape"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__found``: base spans and the looser candidates apart from them, with votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.withColumn("__runs", _digit_runs(text))
        .withColumn("__base", _base(text, F.col("__runs")))
        .withColumn("__more", apart(F.col("__base"), _loose(text, F.col("__runs"))))
        .withColumn(
            "__found",
            F.concat(F.transform("__base", lambda s: _judged(s, True)), F.transform("__more", lambda s: _judged(s, False))),
        )
        .drop("__runs", "__base", "__more")
    )


def estimate(patterns: list[tuple], rounds: int = 500) -> list[tuple[tuple, float, float]]:
    """(pattern, weight, posterior) by expectation-maximisation.

    A pattern is (kind, form, listed, context, shape); votes are independent given
    the truth, with a rate of yes, no and nothing for each labeler, kind and truth.
    """
    weights: dict[tuple, float] = {}
    for *key, n in sorted(patterns):
        weights[tuple(key)] = weights.get(tuple(key), 0) + n
    post = {k: 0.1 + 0.8 * (sum(v == 1 for v in k[1:4]) + 0.5) / (sum(v < 2 for v in k[1:4]) + 1) for k in weights}
    for _ in range(rounds):
        rate: dict[tuple, list[float]] = {}
        prior: dict[int, list[float]] = {}
        for k, n in weights.items():
            for truth in (0, 1):
                mass = n * (post[k] if truth else 1 - post[k])
                prior.setdefault(k[0], [1.0, 1.0])[truth] += mass
                for labeler in (1, 2, 3):
                    start = [1.0, 2.0, 2.0] if truth else [2.0, 1.0, 2.0]
                    rate.setdefault((k[0], labeler, truth), start)[k[labeler]] += mass
        fresh = {}
        for k in weights:
            logs = []
            for truth in (0, 1):
                value = math.log(prior[k[0]][truth])
                for labeler in (1, 2, 3):
                    r = rate[(k[0], labeler, truth)]
                    value += math.log(r[k[labeler]] / sum(r))
                logs.append(value)
            fresh[k] = 1 / (1 + math.exp(max(-60.0, min(60.0, logs[0] - logs[1]))))
        post = fresh
    return [(k, n, post[k]) for k, n in sorted(weights.items())]


def features(key: tuple) -> list[str]:
    """Indicators of a pattern for the span classifier."""
    kind, form, listed, context, shape = key
    return [f"k{kind}", f"f{form}", f"l{kind}_{listed}", f"c{context}", f"s{shape & 1}", f"d{shape >> 1 & 1}", f"b{shape >> 2}"]


def train(posteriors: list[tuple[tuple, float, float]], rounds: int = 300) -> dict[str, float]:
    """Weights of a logistic model fitted to the posteriors by gradient steps, with shrinkage."""
    model = dict.fromkeys(["bias", *sorted({f for k, _, _ in posteriors for f in features(k)})], 0.0)
    total = sum(n for _, n, _ in posteriors) or 1
    for _ in range(rounds):
        slope = {f: 0.001 * w for f, w in model.items()}
        for k, n, p in posteriors:
            own = ["bias", *features(k)]
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(model[f] for f in own)))))
            for f in own:
                slope[f] += n / total * (q - p)
        for f in model:
            model[f] -= 1.0 * slope[f]
    return model


def _probability(s: Column, model: dict[str, float]) -> Column:
    value = F.lit(float(model["bias"]))
    names = {
        "k": s["kind"].cast("string"),
        "f": s["form"].cast("string"),
        "l": F.concat_ws("_", s["kind"].cast("string"), s["listed"].cast("string")),
        "c": s["context"].cast("string"),
        "s": s["shape"].bitwiseAND(F.lit(1)).cast("string"),
        "d": F.shiftright(s["shape"], 1).bitwiseAND(F.lit(1)).cast("string"),
        "b": F.shiftright(s["shape"], 2).cast("string"),
    }
    for name, weight in model.items():
        if name != "bias":
            value = value + F.when(names[name[0]] == name[1:], float(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-value))


def judge(found: DataFrame, keep: float = 0.5) -> DataFrame:
    """A materialised table with ``__found``: adds ``__spans``, those that stay, in order."""
    fields = ("kind", "form", "listed", "context", "shape")
    counted = (
        found.select(F.explode("__found").alias("s"))
        .groupBy(*[F.col(f"s.{f}").alias(f) for f in fields])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    model = train(estimate([tuple(r) for r in counted.collect()]))
    model = model if len(model) > 1 else {"bias": 0.0}
    known = F.transform(
        "__found", lambda s: F.struct(s["start"], s["kind"], s["stop"], s["base"], _probability(s, model).alias("probability"))
    )
    stays = F.filter(known, lambda s: s["base"] | (s["probability"] >= keep))
    return found.withColumn("__spans", F.array_sort(stays)).drop("__found")


def redact(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows where it exists."""
    found = judge(materialize(candidates(docs), "pii-found"), keep)
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    changed = F.size("__spans") > 0
    # A new column first: within one projection a lambda could take the new text for the old.
    whole = replaced(F.col("text"), F.col("__spans"), labels)
    made = found.withColumn("__text", F.when(changed, whole).otherwise(F.col("text")))
    n_chars = F.when(changed, F.length("__text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    columns = {"text": F.col("__text"), "n_chars": n_chars}
    return made.select(
        *[columns[c].cast(docs.schema[c].dataType).alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns]
    )


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table, then the probability of each span, in percent and in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(materialize(candidates(docs).select("doc_id", "__found"), "pii-found"))
    base = F.filter("__spans", lambda s: s["base"])
    counts = [count_of(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.col("__spans"), KINDS).alias("spans"),
        F.array_join(F.transform("__spans", lambda s: F.round(s["probability"] * 100).cast("int").cast("string")), ",").alias("percent"),
    )
