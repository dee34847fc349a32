"""Runs over batches of model requests: parsing to a gated set of cards, retries through a cache, and jobs.

Models are callers' functions from a table of requests to a table of responses, so
any client fits, and tests and queries use rules in their place.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import families, qc
from glossmill.sources.shared import drop, exists, materialize, shared_path, shuffles_dropped

#: A model: (key, prompt) to (key, response); a key without a row got no answer.
Ask = Callable[[DataFrame], DataFrame]
#: Most of each kind of error among cards and errors together.
GATE = {"lemma_not_in_example": 0.01, "pos_mismatch": 0.01, "duplicate_sense": 0.01, "validation": 0.01}


class GateFailed(ValueError):
    """A set of cards has more errors of a kind than its gate lets through."""


@dataclass(frozen=True)
class Policy:
    """Which cards are asked for again."""

    empty: bool = True
    fallback: bool = True


def _errors(cards: DataFrame, kind: str, message: str) -> DataFrame:
    return cards.select("lemma", F.lit("download").alias("stage"), F.lit(kind).alias("error_type"), F.lit(message).alias("message"))


def strict(cards: DataFrame, pos_lists: DataFrame | None = None, mode: str = "word") -> tuple[DataFrame, DataFrame]:
    """Cards that pass all strict checks, and an error for every other one.

    In order: no example; a form of the lemma missing from an example; a headword of
    several words where ``mode`` is word; a part of speech that no chosen example
    has; a definition like that of an earlier card of the lemma.  ``card_id`` names a
    card and orders those of a lemma.
    """
    cards = cards.where(F.size("examples") > 0)
    missing = qc.lemma_missing(F.col("lemma"), F.col("examples"))
    errors = _errors(cards.where(missing), "lemma_not_in_example", "lemma not in every example")
    cards = cards.where(~missing)
    if mode == "word":
        several = F.contains(F.trim("lemma"), F.lit(" "))
        errors = errors.unionByName(_errors(cards.where(several), "headword_invalid_for_mode", "several words in word mode"))
        cards = cards.where(~several)
    if pos_lists is not None:
        chosen = cards.withColumn("indices", families.indices(F.col("selected_example_indices")))
        wrong = qc.pos_mismatch(chosen, pos_lists).select("card_id", "lemma")
        errors = errors.unionByName(_errors(wrong, "pos_mismatch", "part of speech not in chosen examples"))
        cards = cards.join(wrong.select("card_id"), "card_id", "left_anti")
    again = qc.duplicate_senses(cards.select(F.col("card_id").alias("ord"), "lemma", "definition_en"))
    errors = errors.unionByName(_errors(again, "duplicate_sense", "definition like that of another card"))
    return cards.join(again.select(F.col("ord").alias("card_id")), "card_id", "left_anti"), errors


def under_contract(cards: DataFrame) -> DataFrame:
    """``cards``; reading one without lemma, definition or examples, or with an index below 1, is an error."""
    low = F.exists(families.indices(F.col("selected_example_indices")), lambda i: i < 0)
    broken = (F.coalesce("lemma", F.lit("")) == "") | (F.coalesce("definition_en", F.lit("")) == "") | (F.size("examples") == 0) | low
    checked = F.when(broken, F.raise_error(F.concat(F.lit("a card breaks its contract: "), F.coalesce("key", F.lit("")))).cast("string"))
    return cards.withColumn("lemma", F.coalesce(checked, "lemma"))


def gate(errors: DataFrame, cards: int, thresholds: dict[str, float]) -> None:
    """GateFailed if a kind of error is more frequent than its threshold."""
    failed = qc.error_rates(errors.where(F.col("error_type").isin(*thresholds)), cards, thresholds, 1.0).where("failed").collect()
    if failed:
        raise GateFailed("; ".join(sorted(f"{r['error_type']}: {r['rate']:.4f} > {r['threshold']}" for r in failed)))


def parse_results(
    results: DataFrame,
    examples: DataFrame,
    path: str,
    pos_lists: DataFrame | None = None,
    thresholds: dict[str, float] = GATE,
    mode: str = "word",
) -> tuple[DataFrame, DataFrame]:
    """Cards and errors of ``results`` (key, response), checked, gated and written to ``path``/cards and ``path``/log.

    Nothing is written to ``cards`` unless the contract holds and the gate lets the set through.
    """
    spark = results.sparkSession
    parsed = families.parse(results)
    failed = parsed.where("error is not null").select(
        "lemma", F.lit("parse").alias("stage"), F.col("error").alias("error_type"), F.lit("").alias("message")
    )
    made = families.with_examples(parsed.where("error is null and card is not null"), examples)
    valid, invalid = families.valid(made)
    # Numbered once and written, so that later steps see the same numbers.
    numbered = valid.withColumn("card_id", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{path}/drafts")
    kept, dropped = strict(spark.read.schema(numbered.schema).parquet(f"{path}/drafts"), pos_lists, mode)
    errors = failed.unionByName(invalid).unionByName(dropped)
    errors.write.mode("overwrite").json(f"{path}/log")
    log = spark.read.schema(errors.schema).json(f"{path}/log")
    gate(log, spark.read.schema(numbered.schema).parquet(f"{path}/drafts").count(), thresholds)
    under_contract(kept).drop("card_id").withColumn("schema_version", F.lit("1")).write.mode("overwrite").parquet(f"{path}/cards")
    return spark.read.parquet(f"{path}/cards"), log


#: Digits of a cache key that name its bucket: 16 to the power of it buckets.
BUCKET_DIGITS = 2


def cached(
    requests: DataFrame, ask: Ask, path: str, keep: tuple[str, ...] = (), below: str | None = None, known: bool | None = None
) -> DataFrame:
    """(key, response, source) and the columns ``keep`` of requests: answers to ``requests`` (key, prompt), asked only where the cache below ``path`` has none.

    The cache is keyed by the SHA-256 of key and prompt, lies in buckets by its
    first digits, and is appended before anything is returned.  A call reads the
    buckets that its own requests fall into and no others, so few requests read
    little of a large cache; bucket names, 256 at most, are all that passes the
    driver.  Of an entry that is there twice, the least answer counts.  ``source``
    is cache or network; no answer is a null.

    Prompts are written once.  They are dealt out again only where some requests
    are the same or an earlier call may have left answers.  ``below`` is the folder of what
    is written besides the cache; ``known`` tells whether the cache may have answers to
    these requests, which is looked up where it is not given.
    """
    spark = requests.sparkSession
    key = F.sha2(F.concat_ws("|", "key", "prompt"), 256)
    named = materialize(requests.select("key", "prompt", *keep, key.alias("cache_key"), F.substring(key, 1, BUCKET_DIGITS).alias("bucket")), "requests", below)
    kind = "cache_key string, key string, response string, bucket string"
    known = exists(spark, path) if known is None else known
    if known:
        own = [r[0] for r in named.select("bucket").distinct().collect()]
        have = spark.read.schema(kind).parquet(path).where(F.col("bucket").isin(own))
    else:
        have = spark.createDataFrame([], kind)
    # What is in the cache now, before this call's own answers are appended.
    found = have.join(named.select("bucket", "cache_key").distinct(), ["bucket", "cache_key"], "left_semi")
    hits = materialize(found.groupBy("cache_key").agg(F.min("response").alias("response")), "hits", below)
    missing = named.join(hits.select("cache_key"), "cache_key", "left_anti") if known else named
    repeated = not missing.groupBy("cache_key").count().where("count > 1").isEmpty()
    asked = missing.select("key", "prompt")
    answers = ask(asked.distinct() if repeated else asked).where("response is not null")
    new = materialize(missing.join(answers, "key").select("cache_key", "key", "response", "bucket").dropDuplicates(["cache_key"]), "answers", below)
    new.repartition("bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(path)
    both = hits.withColumn("source", F.lit("cache")).unionByName(new.select("cache_key", "response", F.lit("network").alias("source")))
    return named.select("key", "cache_key", *keep).join(both, "cache_key", "left").select("key", *keep, "response", F.coalesce("source", F.lit("network")).alias("source"))


def retry(cards: DataFrame, examples: DataFrame, ask: Ask, cache: str, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Cards with those of retried lemmas replaced, and (lemma, source, outcome) of every lemma asked for again.

    A retry succeeds if all its cards are valid, have examples and no fallback;
    otherwise (validation_failed) or without an answer (failed) the old cards stay.
    """
    lemmas = families.retry_lemmas(cards, policy.empty, policy.fallback)
    known = lemmas.join(examples.where(F.size("examples") > 0), "lemma")
    prompts = known.select(F.concat(F.lit("lemma:"), F.col("lemma")).alias("key"), retry_prompt(F.col("lemma"), F.col("examples")).alias("prompt"))
    answers = cached(prompts, ask, cache)
    made = families.with_examples(
        families.parse(answers.where("response is not null").select("key", "response")).where("error is null and card is not null"), examples
    )
    valid, _ = families.valid(made)
    every = made.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))
    good = valid.groupBy("lemma").agg(F.count_if((F.size("examples") > 0) & ~F.col("examples_fallback")).alias("good"), F.count(F.lit(1)).alias("valid"))
    judged = (
        lemmas.join(answers.select(F.expr("substring(key, 7)").alias("lemma"), "source"), "lemma", "left")
        .join(every, "lemma", "left")
        .join(good, "lemma", "left")
    )
    outcome = F.when(F.col("n").isNull(), "failed").when((F.col("valid") > 0) & (F.col("good") == F.col("valid")), "success").otherwise("validation_failed")
    log = judged.select("lemma", F.coalesce("source", F.lit("network")).alias("source"), outcome.alias("outcome"))
    fresh = valid.join(log.where("outcome = 'success'").select("lemma"), "lemma", "left_semi")
    return families.merge_retries(cards, fresh.select(*cards.columns)), log


def retry_prompt(lemma: Column, examples: Column) -> Column:
    """The request of a second try: the first one's, and that every meaning must name its examples."""
    return F.concat(families.prompt(lemma, examples), F.lit("\n\nEvery meaning must name the numbers of its examples. Answer with valid JSON only."))


def cluster(blocks: DataFrame | list[DataFrame], ask: Ask, cache: str) -> DataFrame:
    """Cards (key, lemma, block, indices, ..) of all blocks of examples, with indices into all examples of a lemma.

    A lemma of one block takes one pass, a longer one a pass for each block.

    ``blocks`` may come in parts that share no lemma.  These are asked one after
    another; the prompts of a part go when its answers are written, so the disk holds those
    of one part at most.
    """
    own_columns = ("lemma", "block", "offset", "__n")
    if isinstance(blocks, DataFrame):
        answers = cached(_block_requests(blocks), ask, cache, keep=own_columns)
    else:
        answers = _answers_of_parts(blocks, ask, cache, own_columns)
    cards = families.parse(answers.where("response is not null"), keep=own_columns).where("error is null and card is not null")
    own = F.filter(families.indices(F.col("card.selected_example_indices")), lambda i: (i >= 1) & (i <= F.col("__n")))
    return families.merge_blocks(cards.withColumn("indices", own).drop("__n"))


def _block_requests(blocks: DataFrame) -> DataFrame:
    key = F.concat(F.lit("lemma:"), F.col("lemma"), F.lit("#"), F.col("block").cast("string"))
    texts = F.transform("examples", lambda e: e["text"])
    return blocks.select(key.alias("key"), families.prompt(F.col("lemma"), texts).alias("prompt"), "lemma", "block", "offset", F.size("examples").alias("__n"))


def _answers_of_parts(parts: list[DataFrame], ask: Ask, cache: str, keep: tuple[str, ...]) -> DataFrame:
    """(key, ``keep``, response) of the requests of all parts."""
    spark = parts[0].sparkSession
    path, known = shared_path(spark, "answered"), exists(spark, cache)
    with shuffles_dropped(spark):
        for part in parts:
            below = shared_path(spark, "part")
            answers = cached(_block_requests(part), ask, cache, keep, below, known).select("key", *keep, "response")
            answers.write.mode("append").option("compression", "zstd").parquet(path)
            drop(spark, below)
    return spark.read.schema(answers.schema).parquet(path)


def labelled(
    items: DataFrame, ask: Callable[[DataFrame, int], DataFrame], read: Callable[[Column], Column], tries: int = 3, journal: str | None = None
) -> DataFrame:
    """(key, attempts, answer): ``items`` (key, prompt) asked until an answer can be read, at most ``tries`` times.

    From the second time on the prompt asks for valid JSON only; what cannot be read then is null.

    Each try is written to the journal, a row a request by the digest of its try,
    key and prompt, before anything reads it: answers are parsed from there, and
    the next try starts from there.  So a plan that is computed again, or a run
    that is started again with the same ``journal``, asks nothing twice, and a
    model whose answers vary gives each item one row.  A request without an
    answer is a row too.  Without a path the journal is a fresh one in the shared folder.
    """
    spark = items.sparkSession
    journal = journal or shared_path(spark, "journal")
    kind = items.schema["key"].dataType.simpleString()
    schema = f"digest string, key {kind}, prompt string, response string"
    done, left = None, items.select("key", "prompt")
    for n in range(1, tries + 1):
        path = f"{journal}/try-{n}"
        prompt = F.col("prompt") if n == 1 else F.concat("prompt", F.lit("\n\nAnswer with valid JSON only."))
        asked = left.select("key", "prompt", prompt.alias("__asked"))
        named = asked.withColumn("digest", F.sha2(F.concat_ws("|", F.lit(str(n)), F.col("key").cast("string"), "__asked"), 256)).dropDuplicates(["digest"])
        if exists(spark, path):
            have = spark.read.schema(schema).parquet(path)
            missing = named.join(have.select("digest"), "digest", "left_anti")
        else:
            missing = named
        missing = materialize(missing, "requests")
        if not missing.isEmpty():
            answers = ask(missing.select("key", F.col("__asked").alias("prompt")), n).groupBy("key").agg(F.first("response", ignorenulls=True).alias("response"))
            missing.join(answers, "key", "left").select("digest", "key", "prompt", "response").write.mode("append").parquet(path)
        got = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        got = got.join(named.select("digest"), "digest", "left_semi").withColumn("answer", read(F.col("response")))
        part = got.where("answer is not null").select("key", F.lit(n).alias("attempts"), "answer")
        done = part if done is None else done.unionByName(part)
        left = got.where("answer is null").select("key", "prompt")
    return done.unionByName(left.select("key", F.lit(tries).alias("attempts"), F.lit(None).cast(done.schema["answer"].dataType).alias("answer")))


def waits(tries: int, first: float = 1.0) -> list[float]:
    """Seconds between tries: each wait is twice the one before."""
    return [first * 2**n for n in range(max(tries - 1, 0))]


class Jobs(Protocol):
    """A service that takes requests now and has results later."""

    def create(self, name: str, requests: DataFrame) -> None: ...

    def status(self, name: str) -> str: ...

    def results(self, name: str) -> DataFrame: ...


class LocalJobs:
    """Jobs answered by a function; a job runs when its state is first asked for."""

    def __init__(self, spark: SparkSession, path: str, ask: Ask):
        self.spark, self.path, self.ask = spark, path, ask
        self.states: dict[str, str] = {}

    def create(self, name: str, requests: DataFrame) -> None:
        if name in self.states:
            raise ValueError(f"job {name} exists")
        requests.select("key", "prompt").write.parquet(f"{self.path}/{name}/requests")
        self.states[name] = "PENDING"

    def status(self, name: str) -> str:
        if self.states[name] == "PENDING":
            self.states[name] = "RUNNING"
        elif self.states[name] == "RUNNING":
            self.ask(self.spark.read.parquet(f"{self.path}/{name}/requests")).write.parquet(f"{self.path}/{name}/results")
            self.states[name] = "SUCCEEDED"
        return self.states[name]

    def results(self, name: str) -> DataFrame:
        if self.states[name] != "SUCCEEDED":
            raise RuntimeError(f"job {name} is {self.states[name]}")
        return self.spark.read.parquet(f"{self.path}/{name}/results")


def wait(jobs: Jobs, name: str, polls: int = 100, first: float = 0.01, most: float = 60.0) -> str:
    """The final state of a job, asked for at growing intervals."""
    pause = first
    for _ in range(polls):
        state = jobs.status(name)
        if state in ("SUCCEEDED", "FAILED", "CANCELLED"):
            return state
        time.sleep(min(pause, most))
        pause *= 2
    raise TimeoutError(f"job {name} is not done after {polls} polls")
