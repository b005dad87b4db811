"""Queries over metrics, accuracy, array functions, ledgers and extracted answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.functions import text as X
from chatloom.operators import contracts, ledger, metrics, order
from chatloom.plans.registry import query, table


# Line items stand for batches and positions: an order is a batch, a line number a position.
LINES = "l AS (SELECT l_orderkey AS batch, l_linenumber AS pos, l_quantity AS denom, floor(l_quantity * (1 - l_discount)) AS correct, l_extendedprice / 1000 AS loss, l_tax AS acceptance, l_quantity AS loss_denom FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("denom"), F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("correct"),
        (F.col("l_extendedprice") / 1000).alias("loss"), F.col("l_tax").alias("acceptance"), F.col("l_quantity").alias("loss_denom"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


PER = f"{LINES}, per AS (SELECT pos, sum(correct)::DOUBLE / greatest(sum(denom), 1) AS acc, sum(acceptance * loss_denom) / sum(loss_denom) AS ar, sum(loss * loss_denom) / sum(loss_denom) AS pl FROM l GROUP BY pos)"


@query(
    "A08_A28_evaluate",
    f"""WITH {PER}, b AS (SELECT batch, sum(loss) AS loss, sum(loss_denom) AS tokens FROM l GROUP BY batch),
    sim AS (SELECT sum(c) AS v FROM (SELECT product(acc) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM per))
    SELECT metric, round(value, 6) AS value FROM (
      SELECT 'avg_loss' AS metric, sum(loss * tokens) / greatest(sum(tokens), 1) AS value FROM b
      UNION ALL SELECT 'avg_acc', min_by(acc, pos) FROM per
      UNION ALL SELECT 'simulated_acc_len', v FROM sim
      UNION ALL SELECT 'per_position_acc_' || pos, acc FROM per UNION ALL SELECT 'acceptance_rate_' || pos, ar FROM per UNION ALL SELECT 'ploss_' || pos, pl FROM per)""",
)
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    batches = x.groupBy("batch").agg(F.sum("loss").alias("loss"), F.sum("loss_denom").alias("tokens")).withColumns({"loss_num": F.lit(None).cast("double"), "loss_den": F.lit(None).cast("double")})
    return rounded(metrics.evaluate(batches, x.select("pos", "correct", "denom", "acceptance", F.col("loss").alias("ploss"), F.col("loss_denom").alias("tokens"))), "value")


@query(
    "A10_A13_ratio_metrics",
    f"WITH {LINES} SELECT batch % 8 AS \"window\", 'acc_' || pos AS metric, round(sum(correct)::DOUBLE / greatest(sum(denom), 1e-12), 6) AS value FROM l GROUP BY 1, pos UNION ALL SELECT batch % 8, 'loss', round(sum(loss) / greatest(sum(denom), 1e-12), 6) FROM l GROUP BY 1",
)
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir).withColumn("window", F.col("batch") % 8)
    long = x.select("window", F.lit("acc").alias("metric"), "pos", F.col("correct").cast("double").alias("num"), F.col("denom").cast("double").alias("den"))
    long = long.unionByName(x.select("window", F.lit("loss").alias("metric"), F.lit(0).cast(x.schema["pos"].dataType).alias("pos"), F.col("loss").cast("double").alias("num"), F.col("denom").cast("double").alias("den")))
    return rounded(metrics.ratio_metrics(long, ["window"]), "value")


@query(
    "A11_training_metrics",
    f"""WITH {LINES}, p AS (SELECT batch % 8 AS w, pos, sum(correct)::DOUBLE AS c, sum(denom) AS d, sum(loss * loss_denom) / sum(loss_denom) AS pl, sum(acceptance * loss_denom) / sum(loss_denom) AS ar FROM l GROUP BY 1, 2)
    SELECT w AS "window", round(sum(c) / sum(d), 6) AS acc, round(sum(pow(0.8, pos) * pl), 6) AS loss, round(avg(ar), 6) AS acceptance_rate FROM p GROUP BY w""",
)
def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir).withColumn("window", F.col("batch") % 8)
    return rounded(metrics.training_metrics(x, 0.8, ["window"]), "acc", "loss", "acceptance_rate")


@query("A12_rank_means", "SELECT l_returnflag AS metric, round(avg(m), 6) AS value FROM (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def rank_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"))
    return per.groupBy(F.col("l_returnflag").alias("metric")).agg(F.round(F.avg("m"), 6).alias("value"))


@query("A14_throughput", "SELECT event_type, round(sum(user_id) / sum(value), 6) AS samples_per_second, round(sum(value) / count(*), 6) AS seconds_per_step FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    return rounded(metrics.throughput(e, "user_id", "value", "one", ["event_type"]), "samples_per_second", "seconds_per_step")


@query(
    "A15_accept_length",
    "SELECT l_shipmode AS mode, sum(l_partkey)::BIGINT AS output_tokens, max(l_quantity)::DOUBLE AS latency, count(*) AS num_questions, round(sum(l_partkey) / max(l_quantity), 4) AS output_throughput, round(CASE WHEN sum(l_suppkey) = 0 THEN 1.0 ELSE sum(l_partkey) / sum(l_suppkey) END, 6) AS accept_length FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS l_shipmode, l_partkey, l_quantity, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_suppkey END AS l_suppkey FROM lineitem) GROUP BY 1",
)
def accept_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END").alias("mode"), "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.expr("CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_suppkey END").alias("v"))
    out = metrics.accept_length(x, "l_partkey", "v", F.col("l_quantity"), ["mode"])
    return rounded(rounded(out, "accept_length"), "output_throughput", digits=4)


@query("A16_run_averages", "SELECT user_id % 5 AS run, count(*) AS n, round(avg(value), 6) AS latency, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS accuracy FROM events GROUP BY 1")
def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).alias("run")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("latency"), F.round(F.avg(F.when(F.col("event_id") % 3 == 0, F.col("value"))), 6).alias("accuracy"))


@query("A17_load_test", "SELECT count(*) AS samples, sum(user_id)::BIGINT AS output_tokens, round(avg(value), 6) AS average_acceptance_length, NULL::BIGINT AS spec_verify_count FROM events")
def load_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("completion_tokens"), F.lit(0).cast("bigint").alias("verify_ct"), F.col("value").alias("accept_length"))
    return rounded(metrics.load_test(e), "average_acceptance_length")


PREDICTED = "p AS (SELECT b.doc_id, b.lang, CASE WHEN b.doc_id % 7 = 0 THEN NULL ELSE (b.n_chars % 3)::VARCHAR || CASE WHEN b.doc_id % 5 = 0 THEN '.0' ELSE '' END END AS pred, l.quality::VARCHAR AS label FROM documents b LEFT JOIN labels l ON b.doc_id = l.doc_id)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(lab, "doc_id", "left")
    return rows.select("doc_id", "lang", F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE cast(n_chars % 3 AS string) || CASE WHEN doc_id % 5 = 0 THEN '.0' ELSE '' END END").alias("pred"), F.col("quality").cast("string").alias("label"))


@query("J09_A18_label_accuracy", f"WITH {PREDICTED} SELECT lang, round(avg(CASE WHEN pred IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY lang")
def acc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).groupBy("lang").agg(F.round(metrics.label_accuracy(F.col("pred"), F.col("label")), 6).alias("accuracy"))


@query("A19_numeric_accuracy", f"WITH {PREDICTED} SELECT lang, round(sum(CASE WHEN pred = label OR abs(TRY_CAST(pred AS DOUBLE) - TRY_CAST(label AS DOUBLE)) < 1e-6 THEN 1.0 ELSE 0.0 END) FILTER (label IS NOT NULL) / count(label), 6) AS accuracy FROM p GROUP BY lang")
def acc_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.numeric_match(F.col("pred"), F.col("label"))
    return predicted(spark, sf_dir).groupBy("lang").agg(F.round(metrics.labelled_accuracy(m, F.col("label")), 6).alias("accuracy"))


@query("A19_integer_accuracy", f"WITH {PREDICTED} SELECT lang, round(sum(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FILTER (label IS NOT NULL) / count(label), 6) AS accuracy FROM p GROUP BY lang")
def acc_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.integer_match(F.col("pred"), F.col("label"))
    return predicted(spark, sf_dir).groupBy("lang").agg(F.round(metrics.labelled_accuracy(m, F.col("label")), 6).alias("accuracy"))


@query("A20_predicted_accuracy", f"WITH {PREDICTED} SELECT lang, round(coalesce(sum(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FILTER (pred IS NOT NULL) / count(pred), 0.0), 6) AS accuracy FROM p GROUP BY lang")
def acc_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.coalesce(F.col("pred") == F.col("label"), F.lit(False))
    return predicted(spark, sf_dir).groupBy("lang").agg(F.round(metrics.predicted_accuracy(m, F.col("pred")), 6).alias("accuracy"))


@query("A21_pass_rate", "SELECT lang, round(avg(CASE WHEN n_chars % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents GROUP BY lang")
def passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(metrics.pass_rate(F.col("n_chars") % 3 == 0), 6).alias("rate"))


@query(
    "J08_A23_speedup",
    """WITH r AS (SELECT user_id % 20 AS model, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'baseline' ELSE event_type END AS name, sum(value) AS v FROM events GROUP BY 1, 2),
    j AS (SELECT r.model, r.name, r.v, b.v AS base FROM r LEFT JOIN (SELECT * FROM r WHERE name = 'baseline') b ON r.model = b.model WHERE r.name <> 'baseline')
    SELECT model, name, round(v / base, 2) AS speedup, CASE WHEN v / base >= 2.0 THEN 'excellent' WHEN v / base >= 1.5 THEN 'good' WHEN v / base >= 1.1 THEN 'moderate' ELSE 'neutral' END AS class FROM j""",
)
def speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first"))
    r = e.crossJoin(F.broadcast(first)).groupBy((F.col("user_id") % 20).alias("model"), F.when(F.col("event_type") == F.col("first"), "baseline").otherwise(F.col("event_type")).alias("name")).agg(F.sum("value").alias("v"))  # one row
    out = metrics.with_baseline(r, ["model"], "name", "baseline", "v")
    return out.select("model", "name", "speedup", metrics.speedup_class(F.col("v"), F.col("base")).alias("class"))


@query("A24_first_of_each", "SELECT user_id, min_by(event_id, (user_id * 7 + event_id) % 4 * 1000000000 + event_id) AS event_id FROM events GROUP BY user_id")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("rank", (F.col("user_id") * 7 + F.col("event_id")) % 4)
    return metrics.first_of_each(e, "user_id", ["rank", "event_id"]).select("user_id", "event_id")


@query("A25_A26_masked_mean", "SELECT event_type, round(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END) / greatest(count(*) FILTER (event_id % 3 = 0), 1e-6), 6) AS m FROM events GROUP BY 1")
def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(metrics.masked_mean(F.col("value"), F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0)), 6).alias("m"))


@query("A27_running_best", "SELECT c AS run, e AS event_id FROM (SELECT user_id % 10 AS c, event_id AS e, value, max(value) OVER (PARTITION BY user_id % 10 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best")
def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 10)
    return metrics.running_best(e, "event_id", "value", 0.0, ["run"]).select("run", "event_id")


@query("A04_context_length", "SELECT lang, min(n) AS min_words, max(n) AS max_words, round(avg(n), 6) AS avg_words FROM (SELECT lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents) GROUP BY lang")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(X.words(F.col("text"))).cast("bigint")
    return rounded(table(spark, sf_dir, "documents").groupBy("lang").agg(*metrics.context_words(n)), "avg_words")


@query("A22_status_counts", "SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type <> 'click') AS others FROM events")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") != "click").alias("others"))


@query("M13_M14_block_terms", "WITH x AS (SELECT l_orderkey % 10 AS g, l_linenumber - 1 AS o, l_extendedprice / 1000 AS loss, l_partkey % 2 = 0 AS c, l_suppkey % 3 <> 0 AS v FROM lineitem) SELECT g, round(sum(CASE WHEN v THEN loss * exp(-greatest(o - 1, 0) / 4.0) END) / sum(CASE WHEN v THEN exp(-greatest(o - 1, 0) / 4.0) END), 6) AS loss, round(sum(CASE WHEN v AND c THEN 1.0 ELSE 0.0 END) / count(*) FILTER (v), 6) AS acc, (count(*) FILTER (v))::DOUBLE AS valid FROM x GROUP BY g")
def block_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("g"), (F.col("l_linenumber") - 1).alias("offset"), (F.col("l_extendedprice") / 1000).cast("double").alias("loss"), (F.col("l_partkey") % 2 == 0).alias("correct"), (F.col("l_suppkey") % 3 != 0).alias("valid"))
    return rounded(metrics.block_terms(x, 4.0, ["g"]), "loss", "acc")


@query("M17_depth_metrics", "SELECT l_linenumber AS depth, count(*) FILTER (l_partkey % 2 = 0 AND l_suppkey % 3 <> 0) AS correct, count(*) FILTER (l_suppkey % 3 <> 0) AS total, round(count(*) FILTER (l_partkey % 2 = 0 AND l_suppkey % 3 <> 0) / greatest(count(*) FILTER (l_suppkey % 3 <> 0), 1), 6) AS acc FROM lineitem GROUP BY 1")
def depth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("depth"), (F.col("l_partkey") % 2 == 0).alias("correct"), (F.col("l_suppkey") % 3 != 0).alias("in_vocab"))
    return rounded(metrics.depth_metrics(x), "acc")


# Embeddings stand for logits; a vector's neighbour (by id, within its label) for the other distribution.
def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.transform(F.reverse("embedding"), lambda x: x.cast("double")).alias("y"))


EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, list_transform(list_reverse(embedding), lambda v: v::DOUBLE) AS y FROM embeddings), s AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS lx, list_max(y) + ln(list_sum(list_transform(y, lambda v: exp(v - list_max(y))))) AS ly FROM e)"


@query("M05_logsumexp_argmax", f"WITH {EMB} SELECT vec_id, round(lx, 6) AS lse, (list_position(x, list_max(x)) - 1)::BIGINT AS top FROM s")
def lse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", F.round(A.logsumexp(F.col("x")), 6).alias("lse"), A.argmax(F.col("x")).alias("top"))


@query("M01_cross_entropy", f"WITH {EMB} SELECT vec_id, round(-list_sum(list_transform(range(1, 65), lambda i: exp(y[i] - ly) * (x[i] - lx))), 6) AS loss FROM s")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir).withColumn("p", A.softmax(F.col("y")))
    return rows.select("vec_id", F.round(A.cross_entropy(F.col("x"), F.col("p")), 6).alias("loss"))


@query("M02_M03_acceptance", f"WITH {EMB}, a AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: least(exp(x[i] - lx), exp(y[i] - ly)))) AS a FROM s) SELECT vec_id, round(a, 6) AS acceptance, round(CASE WHEN a > 0 THEN ln(a) ELSE 0 END, 6) AS log_acceptance FROM a")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.expected_acceptance(A.softmax(F.col("x")), A.softmax(F.col("y")))
    rows = logits(spark, sf_dir).select("vec_id", a.alias("a"))
    return rows.select("vec_id", F.round("a", 6).alias("acceptance"), F.round(A.log_acceptance(F.col("a")), 6).alias("log_acceptance"))


@query("M04_lk_loss", f"WITH {EMB}, a AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: least(exp(x[i] - lx), exp(y[i] - ly)))) AS a, -list_sum(list_transform(range(1, 65), lambda i: exp(y[i] - ly) * (x[i] - lx))) AS ce FROM s) SELECT vec_id, round(0.3 * ce - 0.7 * ln(a), 6) AS loss FROM a")
def lk_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir).withColumns({"p": A.softmax(F.col("x")), "q": A.softmax(F.col("y"))})
    a, ce = A.expected_acceptance(F.col("p"), F.col("q")), A.cross_entropy(F.col("x"), F.col("q"))
    return rows.select("vec_id", F.round(0.3 * ce - 0.7 * A.log_acceptance(a), 6).alias("loss"))


@query("M06_restricted_softmax", "WITH e AS (SELECT vec_id, list_transform(embedding[1:16], lambda v: v::DOUBLE) AS x FROM embeddings), s AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS l FROM e) SELECT vec_id, 16 AS n, round(exp(x[1] - l), 6) AS first FROM s")
def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i < 16)
    rows = logits(spark, sf_dir).select("vec_id", A.softmax(A.restrict(F.col("x"), keep)).alias("p"))
    return rows.select("vec_id", F.size("p").alias("n"), F.round(F.get("p", F.lit(0)), 6).alias("first"))


@query("M07_padded_teacher", "SELECT vec_id, 80 AS n, 0.0::DOUBLE AS last FROM embeddings")
def teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logits(spark, sf_dir).select("vec_id", A.pad(F.col("x"), F.lit(80), F.lit(0.0)).alias("p"))
    return rows.select("vec_id", F.size("p").alias("n"), F.element_at("p", -1).alias("last"))


@query("M09_M16_accepted_length", "WITH x AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 4 <> 0 AS ok, l_suppkey % 5 <> 0 AS v FROM lineitem) SELECT k, count(*) FILTER (v AND i < coalesce(f, 99)) AS accepted FROM (SELECT *, min(CASE WHEN v AND NOT ok THEN i END) OVER (PARTITION BY k) AS f FROM x) GROUP BY k")
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", F.when(F.col("l_partkey") % 4 != 0, 1).otherwise(0).alias("p"), (F.col("l_suppkey") % 5 != 0).alias("v")).alias("s"))
    rows = x.groupBy("k").agg(F.array_sort(F.collect_list("s")).alias("s"))  # a block's positions are few
    ones = F.transform("s", lambda z: F.lit(1))
    return rows.select("k", A.accepted_length(F.col("s.p"), ones, F.col("s.v")).cast("bigint").alias("accepted"))


@query("M10_simulated_length", "SELECT k, round(sum(c), 6) AS v FROM (SELECT l_orderkey AS k, product(l_discount * 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount ROWS UNBOUNDED PRECEDING) AS c FROM lineitem) GROUP BY k")
def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 10).cast("double").alias("a")))).alias("s"))
    return x.select("k", F.round(A.simulated_length(F.col("s.a")), 6).alias("v"))


@query("M11_M19_decay", "SELECT l_orderkey AS k, round(sum(exp(-greatest(l_linenumber - 2, 0) / 3.0)), 6) AS anchored, round(sum(exp(-(l_linenumber - 1) / 3.0)), 6) AS plain, round(sum(pow(0.8, r - 1) * l_tax), 6) AS discounted FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_tax) AS r FROM lineitem) GROUP BY 1")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_linenumber") - 1
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(A.decay_weight(p, 3.0)), 6).alias("anchored"), F.round(F.sum(A.decay_weight(p, 3.0, "plain")), 6).alias("plain"), F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_tax").cast("double").alias("t")))).alias("s"))
    return x.select("k", "anchored", "plain", F.round(A.discounted(F.col("s.t"), 0.8), 6).alias("discounted"))


@query("M12_pace_weights", "WITH x AS (SELECT l_orderkey AS k, row_number() OVER w AS i, product(l_discount * 5 + 0.25) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount)), y AS (SELECT k, i, sum(c) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM x) SELECT k, round(sum(s) / max(s), 6) AS total FROM y GROUP BY k")
def pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 5 + 0.25).cast("double").alias("c")))).alias("s"))
    return x.select("k", F.round(A.total(A.pace_weights(F.col("s.c"))), 6).alias("total"))


@query("M18_linear_schedule", "SELECT o_orderkey, round(greatest(0, 0.9 * (1 - least(o_orderkey / (60000 * 0.5), 1))), 6) AS v FROM orders")
def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(A.linear_schedule(F.col("o_orderkey"), F.lit(60000), 0.9, 0.5), 6).alias("v"))


@query("J06_J07_gather", "SELECT vec_id, round(embedding[(vec_id % 64)::INT + 1], 5) AS v, embedding[65] AS outside FROM embeddings")
def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.gather(F.col("embedding"), F.array((F.col("vec_id") % 64).cast("int"), F.lit(64)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", g.alias("g"))
    return rows.select("vec_id", F.round(F.get("g", F.lit(0)), 5).alias("v"), F.get("g", F.lit(1)).alias("outside"))


@query("P17_byte_estimate", "SELECT vec_id, len(embedding) * 4 * (vec_id % 3 + 1) AS bytes FROM embeddings")
def byte_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.size("embedding").cast("bigint"), F.col("vec_id") % 3 + 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", A.bytes_of(shape, contracts.width_of(F.lit("float32"))).alias("bytes"))


@query("P18_epoch_ids", "SELECT o_orderkey, printf('epoch%04d-prompt%012d', 2, o_orderkey) AS id FROM orders")
def epoch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("epoch%04d-prompt%012d", F.lit(2), "o_orderkey").alias("id"))


# Ledgers: events arrive in the order of event_id; user_id names the sample.
LEDGER = "done AS (SELECT DISTINCT user_id FROM events WHERE event_id % 10 < 2)"


@query("J01_R05_commit_fresh", f"WITH {LEDGER} SELECT event_id, user_id NOT IN (SELECT user_id FROM done) AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_fresh FROM events WHERE event_id % 10 >= 2")
def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ledger.fresh(e.filter("event_id % 10 >= 2"), e.filter("event_id % 10 < 2"), "user_id", "event_id").select("event_id", "is_fresh")


@query("J02_point_lookup", f"WITH {LEDGER} SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM done)")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.join(e.filter("event_id % 10 < 2").select("user_id").distinct(), "user_id", "left_semi").select("event_id")


@query("J03_R10_reconcile", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'released' ELSE 'requeued' END AS fate FROM events")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return ledger.reconcile(e, e.filter("event_id % 3 = 0"), F.col("event_id") % 2 == 0, "event_id")


@query("J05_F21_responses", "SELECT o_orderkey, CASE count(l_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'duplicate' END AS outcome FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_linenumber")
    return ledger.match_responses(o, r).select(F.col("sample_id").alias("o_orderkey"), "outcome")


@query("J04_zip_positions", "SELECT o_orderkey AS k, o_custkey AS a, o_custkey + 1 AS b FROM orders")
def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return ledger.zip_positions(o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a")), o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + 1).alias("b")), ["k"])


@query("F21_capture_outcome", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 2 THEN 'raise' WHEN 3 THEN 'aborted' ELSE 'ok' END AS outcome, o_orderkey % 5 = 1 AS retryable FROM orders")
def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k != 0, F.when(k == 2, -1).otherwise(F.col("o_orderkey"))).alias("result_id"), F.col("o_orderkey").alias("task_id"), F.when(k == 1, "busy").alias("server_error"), F.when(k == 3, 1).otherwise(2).alias("captured_len"), F.lit(2).alias("prompt_len"))
    return ledger.capture_outcome(rows).select("o_orderkey", "outcome", "retryable")


LIFE = "CASE event_id % 4 WHEN 0 THEN 'ingest' WHEN 1 THEN 'lease' WHEN 2 THEN 'fail' ELSE 'complete' END"


@query("R04_lifecycle", f"WITH l AS (SELECT user_id, count(*) FILTER (ev = 'fail') AS attempts, max_by(ev, event_id) AS last FROM (SELECT *, {LIFE} AS ev FROM events) GROUP BY user_id) SELECT user_id AS task_id, attempts, CASE WHEN last = 'complete' THEN 'completed' WHEN attempts >= 3 THEN 'failed' WHEN last = 'lease' THEN 'leased' ELSE 'pending' END AS state FROM l")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.expr(LIFE).alias("event"))
    return ledger.lifecycle(e, 3)


@query(
    "R07_hysteresis",
    """WITH RECURSIVE r AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id * 7 % 11 AS refs, event_id * 13 % 101 AS bytes FROM events),
    f AS (SELECT k, 0::BIGINT AS i, false AS paused, 0 AS pauses, 0 AS resumes FROM (SELECT DISTINCT k FROM r)
      UNION ALL SELECT f.k, r.i, CASE WHEN f.paused THEN NOT (refs <= 4 AND bytes <= 40) ELSE refs >= 10 OR bytes >= 100 END,
        f.pauses + CASE WHEN NOT f.paused AND (refs >= 10 OR bytes >= 100) THEN 1 ELSE 0 END, f.resumes + CASE WHEN f.paused AND refs <= 4 AND bytes <= 40 THEN 1 ELSE 0 END
      FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
    SELECT k, max_by(paused, i) AS paused, max(pauses) AS pauses, max(resumes) AS resumes FROM f GROUP BY k""",
)
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") * 7 % 11).alias("refs"), (F.col("event_id") * 13 % 101).alias("bytes")))).alias("s"))
    h = rows.select("k", ledger.hysteresis(F.col("s"), 10, 4, 100, 40).alias("h"))
    return h.select("k", F.element_at("h.paused", -1).alias("paused"), "h.pauses", "h.resumes")


@query("R08_outstanding_bytes", "SELECT k, sum(b)::BIGINT AS published, coalesce(sum(b) FILTER (r > 5), 0)::BIGINT AS outstanding FROM (SELECT user_id % 50 AS k, event_id % 97 AS b, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r FROM events) GROUP BY k")
def outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k"), "event_id", (F.col("event_id") % 97).alias("b"))
    return ledger.outstanding_bytes(e, "k", "event_id", "b", F.lit(5))


@query("R11_latest_generation", "SELECT user_id AS sample_id, max(event_id) AS generation, max_by(event_type, event_id) AS lease_token FROM events GROUP BY 1")
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("generation"), F.col("event_type").alias("lease_token"))
    return ledger.latest_generation(e)


@query("R16_advance", "SELECT event_id, coalesce(v >= max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM (SELECT event_id, user_id, event_id * 31 % 1009 AS v FROM events)")
def advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 31 % 1009).alias("v"))
    return ledger.advance(e, "user_id", "event_id", "v").select("event_id", "accepted")


@query("F17_F18_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.anti_resume(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("F10_pretokenized_error", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'input_ids must not be empty' WHEN 1 THEN 'input_ids and loss_mask must have equal length' WHEN 2 THEN 'loss_mask must be binary' WHEN 3 THEN 'input_ids and loss_mask are required' END AS error FROM documents")
def pretokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.expr("CASE doc_id % 5 WHEN 0 THEN array() WHEN 3 THEN NULL ELSE array(1, 2, 3) END")
    mask = F.expr("CASE doc_id % 5 WHEN 0 THEN array() WHEN 1 THEN array(1) WHEN 2 THEN array(1, 2, 0) ELSE array(0, 1, 1) END")
    return table(spark, sf_dir, "documents").select("doc_id", contracts.pretokenized_error(ids, mask).alias("error"))


@query("F13_capture_contract", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'missing features: target' WHEN vec_id % 4 = 1 THEN 'auxiliary width must be layers * hidden' WHEN vec_id % 4 = 2 THEN 'captured layers differ from the declared ones' END AS error FROM embeddings")
def capture_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id") % 4
    aux = F.array(F.lit(1), F.lit(16), F.when(k == 1, 190).otherwise(192))
    two = F.create_map(F.lit("aux_hidden_state"), aux)
    shapes = F.when(k == 0, two).otherwise(F.map_concat(two, F.create_map(F.lit("target"), F.array(F.lit(1), F.lit(16), F.lit(64)))))
    layers = F.when(k == 2, F.array(F.lit(1), F.lit(2), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return table(spark, sf_dir, "embeddings").select("vec_id", contracts.capture_error(layers, shapes, ["aux_hidden_state", "target"], [1, 2, 3], 64, 64).alias("error"))


@query("F14_mixed_batches", "SELECT user_id AS batch FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_type").alias("strategy"), F.lit(1).alias("schema_version"), F.lit("logits").alias("target_repr"))
    return contracts.mixed_batches(e).select("batch")


@query("F19_shared_prefix", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS n FROM documents")
def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array(F.lit(1), F.lit(2), F.lit(3)), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(9)))
    return table(spark, sf_dir, "documents").select("doc_id", A.shared_prefix(a, b).alias("n"))


@query("K06_without_nan", "SELECT vec_id FROM embeddings WHERE vec_id % 9 <> 0")
def no_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatloom.sources.sinks import without_nan

    e = table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: F.when(F.col("vec_id") % 9 == 0, F.lit(float("nan"))).otherwise(v)))
    return without_nan(e, "x").select("vec_id")


@query("U01_union_all", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents WHERE n_chars > 1000) GROUP BY lang")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chatloom.sources.readers import union_all as union

    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return union([d, d.filter("n_chars > 1000")]).groupBy("lang").agg(F.count("*").alias("n"))


@query("U04_intersection", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_id % 2 = 0")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_id % 2 = 0").select("user_id"))


@query("T17_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("T19_weighted_choice", "SELECT doc_id, CASE WHEN h < 4 THEN 'low' WHEN h < 8 THEN 'medium' ELSE 'high' END AS effort FROM (SELECT doc_id, ('0x' || substr(md5('7:' || doc_id), 1, 7))::BIGINT % 10 AS h FROM documents)")
def effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string")).cast("binary")), 1, 7), 16, 10).cast("bigint") % 10
    return table(spark, sf_dir, "documents").select("doc_id", F.when(h < 4, "low").when(h < 8, "medium").otherwise("high").alias("effort"))


@query("T20_request", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"model\":\"m\",\"temperature\":0.5}' ELSE '{\"model\":\"m\"}' END AS body FROM documents")
def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.when(F.col("doc_id") % 2 == 0, F.lit(0.5)).alias("temperature")))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


@query("T11_last_integer", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id * 1000 WHEN doc_id % 3 = 1 THEN -9999999 ELSE 7 END AS v FROM documents")
def last_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE doc_id % 3 WHEN 0 THEN 'so 5 then ' || CASE WHEN doc_id = 0 THEN '0' ELSE cast(doc_id AS string) || ',000' END WHEN 1 THEN 'none 007' ELSE '-7' END")
    return table(spark, sf_dir, "documents").select("doc_id", X.last_integer(c).alias("v"))


@query("T15_text_after", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS v FROM documents")
def text_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE WHEN doc_id % 2 = 0 THEN 'x Answer:  ' || lang || ' \\nAnswer: no' ELSE source END")
    return table(spark, sf_dir, "documents").select("doc_id", X.text_after(c).alias("v"))


@query("T14_choice_letter", "SELECT doc_id, substr('ABCD', (doc_id % 4)::INT + 1, 1) AS v FROM documents")
def choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'the answer is (' || substr('abcd', cast(doc_id % 4 AS int) + 1, 1) || ')' ELSE substr('ABCD', cast(doc_id % 4 AS int) + 1, 1) END")
    return table(spark, sf_dir, "documents").select("doc_id", X.choice_letter(c).alias("v"))


@query("W20_ledger_scan", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq FROM events")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order.ordered(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return out.select("event_id", (F.col("pos") + 1).alias("seq"))


@query("P16_payload", "SELECT vec_id, 64 AS hidden, label FROM embeddings")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = contracts.require(table(spark, sf_dir, "embeddings"), F.col("embedding").isNotNull(), "a feature is missing")
    return e.select("vec_id", F.size("embedding").alias("hidden"), "label")
