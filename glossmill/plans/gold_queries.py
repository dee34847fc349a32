"""Queries over word senses and labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions import scores
from glossmill.operators import constructions, gold, report, senses
from glossmill.plans import oracle
from glossmill.plans.base import Registry, table
from glossmill.plans.source_queries import framed, guidance_sql, guided
from glossmill.sources import tables

query = Registry()
QUERIES, ORACLES = query.queries, query.sql


@query(
    "agg_4",
    """WITH a AS (SELECT c_mktsegment AS lemma, o_orderpriority AS supersense, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT lemma, supersense, count(*) AS sense_freq, count(DISTINCT o_orderdate) AS doc_count FROM a GROUP BY ALL)
    SELECT *, CAST(sum(sense_freq) OVER w AS BIGINT) AS book_freq, sense_freq / CAST(sum(sense_freq) OVER w AS DOUBLE) AS sense_ratio, count(*) OVER w AS sense_count,
      first_value(supersense) OVER (PARTITION BY lemma ORDER BY sense_freq DESC, supersense) AS dominant_supersense FROM s WINDOW w AS (PARTITION BY lemma)""",
)
def agg_4(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return senses.sense_statistics(
        rows.select(F.col("c_mktsegment").alias("lemma"), F.col("o_orderpriority").alias("supersense"), F.col("o_orderdate").alias("sentence_id"))
    )


def _centroids(vectors: DataFrame) -> DataFrame:
    parts = vectors.select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("gloss"))


_CENTROIDS = """
p AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS gloss FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY ALL) GROUP BY label),
e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS q FROM embeddings),
s AS (SELECT vec_id, label, list_dot_product(q, gloss) / ((sqrt(list_dot_product(q, q)) + 1e-10) * (sqrt(list_dot_product(gloss, gloss)) + 1e-10)) AS sim FROM e, c)
"""


@query("fn_9", f"WITH {_CENTROIDS} SELECT vec_id, label, round(sim, 6) AS sim FROM s")
def fn_9(spark, sf_dir):
    """Ten centroids at most, one a label, meet every vector."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(_centroids(vectors)))
    return rows.select("vec_id", "label", F.round(scores.cosine(F.col("embedding"), F.col("gloss")), 6).alias("sim"))


@query("rnk_11", f"WITH {_CENTROIDS} SELECT vec_id, 's' || arg_max(label, sim) AS synset_id, round(max(sim), 6) AS confidence FROM s GROUP BY vec_id HAVING max(sim) > 0")
def rnk_11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    glosses = _centroids(vectors).select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("synset_id"), F.col("label").alias("rank"), "gloss")
    pairs = vectors.select("vec_id", F.col("embedding").alias("query")).crossJoin(F.broadcast(glosses))
    found = senses.choose(pairs, "vec_id").where("synset_id is not null")
    return found.withColumn("confidence", F.round("confidence", 6))


#: The senses of rnk_10: label 3 is a sense that a construction names, and labels have categories in turn.
_GROUPS = ("noun.act", "noun.food", "verb.motion")
_SENSE = "CASE label WHEN 3 THEN 'over.r.01' WHEN 4 THEN 'surrender.v.01' ELSE 's' || label END"


@query(
    "rnk_10",
    f"""WITH {_CENTROIDS}, {guidance_sql('embeddings', 'vec_id')},
    b AS (SELECT vec_id, {_SENSE} AS synset_id, list_extract([{oracle.listed(_GROUPS)}], CAST(label % 3 AS INTEGER) + 1) AS supersense, label,
      least(greatest(sim + 0.08 * (label % 3) * 0.2, 0.0), 1.0) AS score FROM s),
    x AS (SELECT b.*, construction, coalesce(policy, '') AS policy,
      CASE WHEN policy = 'OVERRIDE' AND list_contains(prefer_synsets, synset_id) THEN len(prefer_synsets) - list_position(prefer_synsets, synset_id) + 1 ELSE 0 END AS forced,
      coalesce(policy IN ('CONSTRAIN', 'OVERRIDE') AND (list_contains(prefer_synsets, synset_id) OR list_contains(prefer_supersenses, supersense)), false) AS liked,
      coalesce(policy = 'SKIP' OR (policy = 'CONSTRAIN' AND list_contains(forbid_supersenses, supersense)), false) AS barred FROM b LEFT JOIN g ON item = vec_id),
    y AS (SELECT vec_id, any_value(construction) AS construction_tag, any_value(policy) AS policy,
      arg_max([synset_id, supersense], (forced, score, CAST(liked AS INTEGER), -label)) FILTER (WHERE NOT barred) AS best,
      max((forced, score)) FILTER (WHERE NOT barred) AS most FROM x GROUP BY vec_id),
    z AS (SELECT *, coalesce(most[1] > 0 OR most[2] > 0, false) AS good FROM y)
    SELECT vec_id, CASE WHEN good THEN best[1] END AS synset_id, CASE WHEN policy = 'SKIP' THEN 'construction' WHEN good THEN best[2] ELSE 'unknown' END AS sense_label,
      round(CASE WHEN good THEN most[2] ELSE 0.0 END, 6) AS confidence, construction_tag FROM z""",
)
def rnk_10(spark, sf_dir):
    """Senses of vectors whose framed sentences hold constructions, all policies applied."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label")
    group = F.element_at(F.array(*map(F.lit, _GROUPS)), (label % 3 + 1).cast("int"))
    glosses = _centroids(vectors).select(F.expr(_SENSE).alias("synset_id"), group.alias("supersense"), label.alias("rank"), "gloss", (label % 3 * 0.2).alias("boost"))
    pairs = vectors.select("vec_id", F.col("embedding").alias("query")).crossJoin(F.broadcast(glosses))
    rules = guided(framed(vectors, "vec_id")).withColumnRenamed("item", "vec_id")
    found = senses.choose_guided(pairs, rules, "vec_id", 0.08, constructions.POLICIES)
    return found.withColumn("confidence", F.round("confidence", 6))


@query(
    "rnk_12",
    """WITH p AS (SELECT l_orderkey AS item, synset_id, l_shipmode AS lexname, l_discount AS score, l_tax AS boost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, synset_id) AS r
      FROM (SELECT DISTINCT l_orderkey, l_discount, l_tax, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS synset_id, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
    t AS (SELECT *, r <= 2 AS top FROM p), q AS (SELECT *, max(CAST(top AS INT)) OVER (PARTITION BY item, lexname) = 1 AS seen, row_number() OVER (PARTITION BY item, lexname ORDER BY r) = 1 AS first FROM t),
    k AS (SELECT *, CASE WHEN top THEN 'top_score' WHEN NOT seen AND first THEN 'new_category' WHEN boost > 0.05 THEN 'context' END AS reason FROM q)
    SELECT item, synset_id, reason, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY CASE reason WHEN 'top_score' THEN 0 WHEN 'new_category' THEN 1 ELSE 2 END, r) AS INTEGER) AS place FROM k WHERE reason IS NOT NULL) WHERE place <= 4""",
)
def rnk_12(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("synset_id"),
        F.concat("l_returnflag", "l_linestatus").alias("lexname"),
        F.col("l_discount").alias("score"),
        F.col("l_tax").alias("boost"),
    )
    return senses.smart_candidates(rows.distinct(), "item", 4).select("item", "synset_id", "reason", "place")


@query(
    "jn_8",
    """WITH i AS (SELECT event_id, event_type AS lemma, CASE user_id % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'v' ELSE 'a' END AS pos FROM events),
    s(lemma, pos, synset_id) AS (VALUES ('click', 'n', 'c1'), ('click', 'v', 'c2'), ('view', 'n', 'v1'), ('view', 'n', 'v2'))
    SELECT event_id, synset_id FROM i JOIN s ON i.lemma = s.lemma AND i.pos = s.pos
    UNION ALL SELECT event_id, synset_id FROM i JOIN s ON i.lemma = s.lemma WHERE (i.lemma, i.pos) NOT IN (SELECT (lemma, pos) FROM s)""",
)
def jn_8(spark, sf_dir):
    pos = F.element_at(F.array(F.lit("n"), F.lit("v"), F.lit("a")), (F.col("user_id") % 3 + 1).cast("int"))
    items = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("lemma"), pos.alias("pos"))
    known = spark.createDataFrame([("click", "n", "c1"), ("click", "v", "c2"), ("view", "n", "v1"), ("view", "n", "v2")], "lemma string, pos string, synset_id string")
    return senses.candidates(items, known).select("event_id", "synset_id")


def _votes(spark, sf_dir) -> DataFrame:
    """Outputs of the judges of every order: its line items."""
    rows = table(spark, sf_dir, "lineitem")
    flags = F.when(F.col("l_discount") > 0.095, F.array(F.lit("needs_more_context"))).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.select(
        F.col("l_orderkey").alias("example_id"),
        F.col("l_linenumber").alias("judge"),
        F.col("l_returnflag").alias("synset_id"),
        (F.col("l_quantity") / 50).alias("confidence"),
        flags.alias("flags"),
    )


_VOTES = """
v AS (SELECT l_orderkey AS example_id, l_linenumber AS judge, l_returnflag AS synset_id, l_quantity / 50 AS confidence, l_discount > 0.095 AS flagged FROM lineitem),
w AS (SELECT *, count(*) OVER (PARTITION BY example_id, synset_id) AS votes, count(*) OVER (PARTITION BY example_id) AS n, avg(confidence) OVER (PARTITION BY example_id, synset_id) AS mean FROM v),
x AS (SELECT *, max(votes) OVER (PARTITION BY example_id) AS top FROM w),
y AS (SELECT example_id, max(n) AS n, max(top) AS top, count(DISTINCT CASE WHEN votes = top THEN synset_id END) AS ties, max(CAST(flagged AS INT)) = 1 AS flagged, max(confidence) AS most FROM x GROUP BY example_id),
z AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY votes = top DESC, confidence DESC, judge, synset_id) = 1)
"""


@query(
    "agg_13",
    f"""WITH {_VOTES} SELECT example_id, synset_id, round(CASE WHEN ties > 1 THEN confidence ELSE mean END, 9) AS confidence, y.top / CAST(y.n AS DOUBLE) AS agreement_ratio,
      CASE WHEN y.flagged THEN 'needs_more_context' ELSE '' END AS flags, y.n = 1 OR y.top / CAST(y.n AS DOUBLE) < 0.5 OR ties > 1 OR y.flagged OR most < 0.6 AS needs_referee, CAST(y.n AS INTEGER) AS judge_count FROM y JOIN z USING (example_id)""",
)
def agg_13(spark, sf_dir):
    found = gold.vote(_votes(spark, sf_dir))
    return found.withColumn("flags", F.array_join("flags", ",")).withColumn("confidence", F.round("confidence", 9))


@query("agg_15", f"WITH {_VOTES} SELECT count(*) AS total, count(*) FILTER (y.top = y.n) AS unanimous, round(avg(y.top / CAST(y.n AS DOUBLE)), 6) AS mean_agreement FROM y")
def agg_15(spark, sf_dir):
    return gold.vote(_votes(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("agreement_ratio") == 1).alias("unanimous"), F.round(F.avg("agreement_ratio"), 6).alias("mean_agreement")
    )


@query(
    "agg_14",
    f"WITH {_VOTES} SELECT a.example_id, a.synset_id <> b.synset_id OR a.confidence < 0.6 OR b.confidence < 0.6 OR a.flagged OR b.flagged AS needs_third FROM v a JOIN v b ON a.example_id = b.example_id AND a.judge = 1 AND b.judge = 2",
)
def agg_14(spark, sf_dir):
    votes = _votes(spark, sf_dir)
    return gold.needs_third(votes.where("judge = 1"), votes.where("judge = 2"))


_SMART = """j AS (SELECT example_id, max(CASE WHEN judge = 1 THEN synset_id END) AS a, max(CASE WHEN judge = 2 THEN synset_id END) AS b, max(CASE WHEN judge = 3 THEN synset_id END) AS referee FROM v GROUP BY example_id HAVING count(*) >= 2),
k AS (SELECT *, CASE WHEN a = b THEN 'full' WHEN referee IS NULL THEN 'pending_referee' WHEN referee IN (a, b) THEN 'majority' ELSE 'primary_fallback' END AS agreement_type FROM j)"""


@query(
    "agg_16",
    f"WITH {_VOTES}, {_SMART} SELECT example_id, CASE WHEN agreement_type = 'majority' AND referee = b THEN b ELSE a END AS synset_id, agreement_type, round(CASE agreement_type WHEN 'full' THEN 1.0 WHEN 'pending_referee' THEN 0.5 WHEN 'majority' THEN 2.0 / 3 ELSE 1.0 / 3 END, 9) AS confidence, agreement_type = 'pending_referee' AS needs_referee FROM k",
)
def agg_16(spark, sf_dir):
    wide = _votes(spark, sf_dir).groupBy("example_id").agg(
        *[F.max(F.when(F.col("judge") == i, F.col("synset_id"))).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "referee"))], F.count(F.lit(1)).alias("n")
    )
    found = gold.smart_vote(wide.where("n >= 2"))
    return found.select("example_id", "synset_id", "agreement_type", F.round("confidence", 9).alias("confidence"), "needs_referee")


def _judged(spark, sf_dir) -> DataFrame:
    """Rule predictions of the quality labels of documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(
        "doc_id",
        "lang",
        F.when(F.col("n_chars") > 1000, "good").otherwise("bad").alias("predicted"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"),
        F.when(F.col("n_chars") > 800, "x").otherwise("y").alias("predicted_supersense"),
        F.when(F.col("quality") == 1, "x").otherwise("y").alias("gold_supersense"),
    )
    return gold.judged(rows)


_JUDGED = """r AS (SELECT doc_id, lang, CASE WHEN n_chars > 1000 THEN 'good' ELSE 'bad' END AS predicted, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold,
  CASE WHEN n_chars > 800 THEN 'x' ELSE 'y' END = CASE WHEN quality = 1 THEN 'x' ELSE 'y' END AS same FROM documents JOIN labels USING (doc_id)),
m AS (SELECT *, predicted = gold AS ok, CASE WHEN predicted = gold THEN 'none' WHEN same THEN 'near_synonym' ELSE 'cross_supersense' END AS kind FROM r)"""
_METRICS = """count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (same) AS supersense_correct, round(avg(CAST(ok AS INT)), 9) AS accuracy, round(avg(CAST(same AS INT)), 9) AS supersense_accuracy,
  count(*) FILTER (kind = 'none') AS n_none, count(*) FILTER (kind = 'near_synonym') AS n_near_synonym, count(*) FILTER (kind = 'cross_supersense') AS n_cross_supersense"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "supersense_accuracy")})


@query("agg_17", f"WITH {_JUDGED} SELECT lang, {_METRICS} FROM m GROUP BY lang")
def agg_17(spark, sf_dir):
    return _rounded(gold.metrics(_judged(spark, sf_dir), "lang"))


@query("agg_18", f"WITH {_JUDGED} SELECT {_METRICS} FROM m")
def agg_18(spark, sf_dir):
    return _rounded(gold.metrics(_judged(spark, sf_dir)))


@query("agg_20", f"WITH {_JUDGED} SELECT predicted, gold, count(*) AS n FROM m WHERE NOT ok GROUP BY ALL ORDER BY n DESC, predicted, gold LIMIT 20")
def agg_20(spark, sf_dir):
    return gold.confusion(_judged(spark, sf_dir))


@query(
    "jn_10",
    f"WITH {_JUDGED}, o AS (SELECT doc_id, (CASE WHEN length(text) > 1500 THEN 'good' ELSE 'bad' END) = (CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END) AS before FROM documents JOIN labels USING (doc_id)) SELECT doc_id, CASE WHEN NOT before THEN 'improved' ELSE 'regressed' END AS change FROM o JOIN m USING (doc_id) WHERE before <> ok",
)
def jn_10(spark, sf_dir):
    now = _judged(spark, sf_dir)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    old = docs.join(labels, "doc_id").select("doc_id", ((F.length("text") > 1500) == (F.col("quality") == 1)).alias("is_correct"))
    return report.changes(old, now, "doc_id")


@query("jn_9", "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def jn_9(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quality", "lang")


@query("jn_13", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_13(spark, sf_dir):
    return tables.unfinished(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("smp_1", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 200")
def smp_1(spark, sf_dir):
    return gold.sample(table(spark, sf_dir, "documents"), "doc_id", 200).select("doc_id")


_LEVEL = "CASE WHEN p_size >= 35 THEN 'hard' WHEN p_size <= 15 THEN 'easy' ELSE 'medium' END"


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.floor(F.col("p_size") / 5).cast("int").alias("sense_count"), F.lit(0.3).alias("baseline_margin")
    )


@query(
    "smp_2",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size // 5 >= 7 THEN 'hard' WHEN p_size // 5 <= 3 THEN 'easy' ELSE 'medium' END AS d FROM part),
    h AS (SELECT d, count(*) AS have FROM r GROUP BY d), t AS (SELECT sum(have) AS total FROM h),
    w AS (SELECT d, have, CAST(floor(150 * (have / CAST(total AS DOUBLE))) AS BIGINT) AS want, CASE d WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS o FROM h, t),
    f AS (SELECT d, want + greatest(0, least(have - want, 150 - (SELECT sum(want) FROM w) - coalesce(sum(have - want) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS want FROM w),
    n AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY md5(p_partkey || '|42'), p_partkey) AS k FROM r)
    SELECT p_partkey, d AS difficulty FROM n JOIN f USING (d) WHERE k <= want""",
)
def smp_2(spark, sf_dir):
    return gold.stratified(_parts(spark, sf_dir), "p_partkey", 150).select("p_partkey", "difficulty")


@query(
    "smp_3",
    """WITH RECURSIVE s AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY md5(p_brand || '|42'), p_brand) AS k FROM part GROUP BY p_brand),
    r AS (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) AS room FROM part),
    w(k, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL
      SELECT s.k, CAST(CASE WHEN w.used + s.n <= room THEN w.used + s.n ELSE w.used END AS BIGINT), w.used + s.n <= room FROM w JOIN s ON s.k = w.k + 1, r)
    SELECT p_partkey, p_brand, CASE WHEN taken THEN 'dev' ELSE 'test' END AS split FROM part JOIN s USING (p_brand) JOIN w USING (k)""",
)
def smp_3(spark, sf_dir):
    return gold.split_by_source(_parts(spark, sf_dir), "p_brand").select("p_partkey", "p_brand", "split")


@query("smp_4", "SELECT doc_id, CASE WHEN contains(source, '1') THEN 'test' ELSE 'dev' END AS split FROM documents")
def smp_4(spark, sf_dir):
    split = F.when(F.contains(F.col("source"), F.lit("1")), "test").otherwise("dev")
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("split"))


@query("smp_5", "SELECT p_partkey FROM part ORDER BY md5(p_partkey || '|7'), p_partkey LIMIT 30")
def smp_5(spark, sf_dir):
    return gold.sample(table(spark, sf_dir, "part"), "p_partkey", 30, 7).select("p_partkey")


@query(
    "agg_19",
    "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))",
)
def agg_19(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("snk_3")
def snk_3(spark, sf_dir):
    return tables.table_checksum(table(spark, sf_dir, "documents"))
