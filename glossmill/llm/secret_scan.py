"""Secret scanning through an incremental ledger of blobs, in SQL expressions only.

Every text is a blob named by its SHA-256.  The ledger is a parquet table of
(blob, rule, version, spans); an append happens only after its scan is whole.  A
scan asks which (blob, rule version) pairs the ledger lacks, scans one copy of
each such blob and appends the outcome, findings or none.  Findings then join
back to every row (path or version of history) that holds the blob.

A rule's version is a digest of its pattern and check, so changing a rule makes
just its own pairs unseen.  Rules have a cheap test for presence, which runs
where a text lies: a text that passes none travels as its digest alone.  A blob
that very many rows share is scanned once; joins on such a blob are salted.

Defined cases: a null text is the empty blob; repeated rows each get their
findings; scanning the same table again scans nothing; an empty table gives an
empty result; very long texts take time in proportion (see ``spans``); spans are
code points, stop exclusive; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import hot_keys, materialize, spread_join, table, text_or_empty, work_path
from glossmill.llm.spans import SPAN, count_of, joined, matches, nothing

KINDS = ("assign", "access", "hex")
LEDGER = "blob string, rule string, version string, spans array<struct<start:int,kind:int,stop:int,base:boolean>>"


@dataclass(frozen=True)
class Rule:
    """One kind of secret: a cheap test for presence, the pattern, and the least length of a part."""

    name: str
    kind: int
    present: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}|{self.pattern}|{self.group}|{self.least}".encode()).hexdigest()[:16]

    def spans(self, text: Column) -> Column:
        found = matches(text, self.pattern, self.kind)
        kept = F.filter(found, lambda s: F.length(F.regexp_extract(s["word"], self.pattern, self.group)) >= self.least)
        slim = F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["stop"], F.lit(self.base).alias("base")))
        none = F.transform(nothing(), lambda s: F.struct(s["start"], s["kind"], s["stop"], F.lit(self.base).alias("base")))
        return F.when(text.rlike(self.present), slim).otherwise(none)


# The base rules, and issued-token forms with a fixed prefix that count as access keys.
RULES = (
    Rule(
        "assign",
        0,
        r"(?i)(?:password|passwd|secret|token|api_?key)",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", 1, r"AKIA", r"AKIA[A-Z0-9]++", least=18),
    Rule("hex", 2, r"[0-9a-f]{16}", r"[0-9a-f]{16,}+", least=16),
    Rule("issued", 1, r"(?:gh[pousr]_|xox[abprs]-)", r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|xox[abprs]-[0-9A-Za-z-]{24,}+)", base=False),
)


class Ledger:
    """The parquet ledger below a path."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """Its rows; none where nothing has been appended yet."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        there = jvm.org.apache.hadoop.fs.Path(self.path)
        if not there.getFileSystem(conf).exists(there):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def scan_unseen(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan one copy of every blob of ``docs`` for the rule versions the ledger lacks, and append."""
    text = F.col("text")
    present = reduce(Column.__or__, [text.rlike(r.present) for r in rules])
    rows = docs.select(text_or_empty().alias("text"))
    blobs = rows.select(F.sha2("text", 256).alias("blob"), F.when(present, text).alias("text")).dropDuplicates(["blob"])
    known = ledger.read()
    wanted = F.array(*[F.lit(f"{r.name}:{r.version}") for r in rules])
    if known.limit(1).count():
        have = known.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("have"))
        lacks = F.array_except(wanted, F.coalesce("have", F.expr("cast(array() as array<string>)")))
        fresh = blobs.join(have, "blob", "left").withColumn("lacks", lacks).where(F.size("lacks") > 0)
    else:
        fresh = blobs.withColumn("lacks", wanted)
    fresh = fresh.withColumn("text", F.coalesce("text", F.lit("")))
    found = F.array(
        *[
            F.when(
                F.array_contains("lacks", f"{r.name}:{r.version}"),
                F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), r.spans(text).alias("spans")),
            )
            for r in rules
        ]
    )
    rows = fresh.select("blob", F.explode(found).alias("f")).where("f is not null")
    ledger.append(rows.select("blob", "f.rule", "f.version", "f.spans"))


def findings(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``: spans of the current rule versions, in order."""
    now = F.concat_ws(":", "rule", "version").isin(*[f"{r.name}:{r.version}" for r in rules])
    by_blob = (
        ledger.read()
        .where(now & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    rows = materialize(docs.select(F.col("doc_id"), F.sha2(text_or_empty(), 256).alias("blob")), "secret-rows")
    copies = rows.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = hot_keys(materialize(copies, "secret-copies"), "blob", "n")
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,base:boolean>>)")
    return spread_join(rows, by_blob, "blob", hot, ["doc_id"], "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table.

    A new ledger first gets the base rules; when the others are added, only their
    pairs are unseen.
    """
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark, work_path(spark, "secret-ledger"))
    scan_unseen(docs, ledger, tuple(r for r in RULES if r.base))
    scan_unseen(docs, ledger)
    found = findings(docs, ledger)
    base = F.filter("spans", lambda s: s["base"])
    counts = [count_of(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
    )
