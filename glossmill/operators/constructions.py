"""Fixed constructions around a word, and phrasal verbs by dictionary, and what they say of its sense.

A construction carries a policy and constraints.  SKIP leaves the word without a
sense.  CONSTRAIN forbids categories and prefers senses or categories.  OVERRIDE
names senses, the first of which that is a candidate is taken.  ``guidance`` finds
the one construction that counts for an item; ``senses.choose_guided`` applies it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.schemas import fixed_table

POLICIES = ("SKIP", "CONSTRAIN", "OVERRIDE")
CONSTRAINTS = ("forbid_supersenses", "prefer_synsets", "prefer_supersenses")

# Fixed values: (name, word, policy, pattern, constraints), in order.
CONSTRUCTIONS = (
    ("BE_GOING_TO", "go", "SKIP", r"\b(am|is|are|was|were|'m|'s|'re)\s+going\s+to\b", {}),
    ("GONNA", "go", "SKIP", r"\bgonna\b", {}),
    ("GO_ON", "go", "CONSTRAIN", r"\b(go|goes|went|gone|going)\s+on\b", {"prefer_supersenses": ["verb.stative", "verb.communication"]}),
    ("GO_AHEAD", "go", "CONSTRAIN", r"\b(go|goes|went|gone|going)\s+ahead\b", {"prefer_supersenses": ["verb.stative", "verb.communication"]}),
    ("GO_THROUGH", "go", "CONSTRAIN", r"\b(go|goes|went|gone|going)\s+through\b", {"prefer_supersenses": ["verb.cognition", "verb.change"]}),
    ("GO_OVER", "go", "CONSTRAIN", r"\b(go|goes|went|gone|going)\s+over\b", {"prefer_supersenses": ["verb.cognition"]}),
    ("COME_ON", "come", "CONSTRAIN", r"\bcome\s+on\b", {"prefer_supersenses": ["verb.stative", "verb.change"]}),
    ("COME_UP", "come", "CONSTRAIN", r"\b(come|comes|came|coming)\s+up\b", {"prefer_supersenses": ["verb.stative", "verb.change"]}),
    ("COME_ACROSS", "come", "CONSTRAIN", r"\b(come|comes|came|coming)\s+across\b", {"prefer_supersenses": ["verb.perception", "verb.cognition"]}),
    ("MAKE_SURE", "make", "CONSTRAIN", r"\bmake\s+sure\b", {"prefer_supersenses": ["verb.cognition"]}),
    ("MAKE_UP", "make", "CONSTRAIN", r"\b(make|makes|made|making)\s+(up|it\s+up)\b", {"prefer_supersenses": ["verb.creation", "verb.cognition", "verb.social"]}),
    ("MAKE_OUT", "make", "CONSTRAIN", r"\b(make|makes|made|making)\s+out\b", {"prefer_supersenses": ["verb.perception", "verb.cognition"]}),
    ("CALL_UP", "call", "CONSTRAIN", r"\b(call|calls|called|calling)\s+up\b", {"prefer_supersenses": ["verb.communication"]}),
    ("CALL_OFF", "call", "CONSTRAIN", r"\b(call|calls|called|calling)\s+off\b", {"prefer_supersenses": ["verb.communication"]}),
    ("AT_THE_TIME", "time", "CONSTRAIN", r"\bat\s+(the|that|this)\s+time\b", {"prefer_supersenses": ["noun.time"]}),
    ("IN_TIME", "time", "CONSTRAIN", r"\bin\s+time\b", {"prefer_supersenses": ["noun.time"]}),
    ("ON_TIME", "time", "CONSTRAIN", r"\bon\s+time\b", {"prefer_supersenses": ["noun.time"]}),
    ("POINT_OF_VIEW", "point", "SKIP", r"\bpoint\s+of\s+view\b", {}),
    ("TO_THE_POINT", "point", "CONSTRAIN", r"\bto\s+the\s+point\b", {"prefer_supersenses": ["noun.communication"]}),
    ("AT_THIS_POINT", "point", "CONSTRAIN", r"\bat\s+(this|that)\s+point\b", {"prefer_supersenses": ["noun.time"]}),
    ("LET_GO", "let", "CONSTRAIN", r"\blet\s+(go|it\s+go)\b", {"prefer_supersenses": ["verb.social"]}),
    ("LET_ALONE", "let", "SKIP", r"\blet\s+alone\b", {}),
    ("SEE_TO", "see", "CONSTRAIN", r"\b(see|sees|saw|seen|seeing)\s+to\b", {"prefer_supersenses": ["verb.social", "verb.cognition"]}),
    ("LOOK_FORWARD", "look", "CONSTRAIN", r"\b(look|looks|looked|looking)\s+forward\s+to\b", {"prefer_supersenses": ["verb.emotion"]}),
    ("LOOK_UP_TO", "look", "CONSTRAIN", r"\b(look|looks|looked|looking)\s+up\s+to\b", {"prefer_supersenses": ["verb.emotion"]}),
    ("OVER_THERE", "over", "OVERRIDE", r"\bover\s+there\b", {"prefer_synsets": ["over.r.01"]}),
    ("BY_THE_WAY", "way", "SKIP", r"\bby\s+the\s+way\b", {}),
    ("IN_A_WAY", "way", "CONSTRAIN", r"\bin\s+a\s+way\b", {"prefer_supersenses": ["noun.attribute"]}),
    ("FOR_LIFE", "life", "CONSTRAIN", r"\bfor\s+life\b", {"prefer_supersenses": ["noun.time"]}),
    ("TAKE_PLACE", "place", "SKIP", r"\btake\s+place\b", {}),
    ("IN_PLACE", "place", "CONSTRAIN", r"\bin\s+place\b", {"prefer_supersenses": ["noun.location", "noun.state"]}),
)


def table(spark: SparkSession, rows: Iterable[tuple] = CONSTRUCTIONS) -> DataFrame:
    """Constructions as rows (construction, lemma, policy, pattern, ord, and an array for each constraint).

    ``rows`` may hold a caller's own; an unknown policy or constraint is an error.
    """
    made = []
    for i, (name, word, policy, pattern, constraints) in enumerate(rows):
        if policy not in POLICIES or set(constraints) - set(CONSTRAINTS):
            raise ValueError(f"construction {name}: policy {policy} or constraints {sorted(constraints)} unknown")
        made.append((name, word, policy, f"(?i){pattern}", i, *(list(constraints.get(c, [])) for c in CONSTRAINTS)))
    arrays = ", ".join(f"{c} array<string>" for c in CONSTRAINTS)
    return fixed_table(spark, made, f"construction string, lemma string, policy string, pattern string, ord int, {arrays}")


def detect(items: DataFrame, patterns: DataFrame, item: str = "item") -> DataFrame:
    """(item, construction, policy, start, stop, place, constraints): matches in an item's sentence, longest first.

    ``items`` has item, lemma and sentence.  Patterns meet items by their word,
    so an item is held against those of its own word only.
    """
    found = F.regexp_substr("sentence", F.col("pattern"))
    rows = items.join(patterns, "lemma").withColumn("__m", found).where("__m is not null")
    start = (F.regexp_instr("sentence", F.col("pattern")) - 1).cast("int")
    made = rows.withColumn("start", start).withColumn("stop", (F.col("start") + F.length("__m")).cast("int"))
    longest = Window.partitionBy(item).orderBy(F.desc(F.length("__m")), "ord")
    placed = made.withColumn("place", F.row_number().over(longest))
    return placed.select(item, "construction", "policy", "start", "stop", "place", *CONSTRAINTS)


def guidance(matches: DataFrame, phrases: DataFrame, pairs: DataFrame, item: str = "item") -> DataFrame:
    """(item, construction, policy, constraints): the first pattern match, else the phrasal verb of the item.

    ``phrases`` (item, verb, particle) are those found in the items' sentences,
    ``pairs`` the dictionary with the senses that a phrasal verb prefers.  Both
    kinds come together by item and not by a join: ids that compress well look
    small to the optimizer, and a join's side would be sent whole to the driver.
    """
    first = matches.where("place = 1").select(item, "construction", "policy", *CONSTRAINTS, F.lit(0).alias("__kind"))
    none = F.expr("cast(array() as array<string>)")
    hints = pairs.select("verb", "particle", F.coalesce("prefer_synsets", none).alias("prefer_synsets"))
    rest = phrases.join(hints, ["verb", "particle"]).select(
        item,
        F.concat_ws("_", F.lit("PHRASAL"), F.upper("verb"), F.upper("particle")).alias("construction"),
        F.lit("CONSTRAIN").alias("policy"),
        none.alias("forbid_supersenses"),
        "prefer_synsets",
        none.alias("prefer_supersenses"),
        F.lit(1).alias("__kind"),
    )
    least = F.min("__kind").over(Window.partitionBy(item))
    return first.unionByName(rest).withColumn("__least", least).where("__kind = __least").drop("__kind", "__least")
