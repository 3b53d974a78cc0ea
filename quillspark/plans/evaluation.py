"""Token, error-rate, accuracy and metric queries, each with its SQL check."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import fixed
from quillspark.functions import text, vectors
from quillspark.operators import datasets, metrics, sampling, scoring
from quillspark.plans import adapters as a
from quillspark.session import scratch_folder

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_RX = fixed.LATEX_TOKEN.replace("'", "''")


@query(
    "latex_tokens",
    a.sql(
        f"""SELECT p_partkey, len(t) AS n_tokens, array_to_string(t, chr(31)) AS tokens
 FROM (SELECT p_partkey, regexp_extract_all(formula, '{_RX}') AS t FROM formulas)""",
        "formulas",
    ),
)
def latex_tokens(spark, sf_dir):
    tokens = text.latex_tokens(F.col("formula"))
    return a.part_formulas(spark, sf_dir).select("p_partkey", tokens.alias("t")).select(
        "p_partkey",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.array_join("t", "\x1f").alias("tokens"),
    )


# DuckDB's levenshtein counts bytes: each distinct token of a pair becomes one of 127 of them
_EDITS = """toks AS (SELECT *, regexp_extract_all(label, '{rx}') AS r, regexp_extract_all(pred, '{rx}') AS h FROM {pairs}),
voc AS (SELECT *, list_distinct(list_concat(r, h)) AS v FROM toks),
edits AS (SELECT * EXCLUDE (r, h, v, label, pred), len(r) AS ref_tokens,
 levenshtein(array_to_string(list_transform(r, lambda t: chr(list_position(v, t)::INTEGER)), ''),
             array_to_string(list_transform(h, lambda t: chr(list_position(v, t)::INTEGER)), '')) AS edits FROM voc)"""


def _edits_sql(pairs, body):
    views = ("chat0", "chat") if pairs == "chat" else ("formulas", "fpairs0", "fpairs")
    return a.sql("", *views).rstrip() + ",\n" + _EDITS.format(rx=_RX, pairs=pairs) + "\n" + body


@query("token_edits", _edits_sql("fpairs", "SELECT p_partkey, edits, ref_tokens FROM edits"))
def token_edits(spark, sf_dir):
    counted = metrics.pair_edits(a.formula_predictions(spark, sf_dir), kernel="jvm")
    return counted.select("p_partkey", "edits", "ref_tokens")


_RATE = """SELECT split, sum(edits)::BIGINT AS edits, sum(ref_tokens)::BIGINT AS ref_tokens,
 round(sum(edits) / sum(ref_tokens), 6) AS error_rate FROM edits GROUP BY split"""


def _rates(edits):
    return metrics.pooled_error_rate(edits, ["split"]).withColumn("error_rate", F.round("error_rate", 6))


@query("cer_by_split", _edits_sql("chat", _RATE))
def cer_by_split(spark, sf_dir):
    return _rates(metrics.pair_edits(a.chat_predictions(spark, sf_dir)))


@query("cer_long_kernel", _edits_sql("fpairs", _RATE))
def cer_long_kernel(spark, sf_dir):
    return _rates(metrics.pair_edits(a.formula_predictions(spark, sf_dir), kernel="arrow"))


_KNOWN = "sum(e)::BIGINT AS edits, sum(n)::BIGINT AS ref_tokens, round(sum(e) / sum(n), 6) AS error_rate"


# a changed character counts one edit; where a text only grows or only shrinks, the edits are the difference
@query(
    "cer_documents",
    a.sql(
        f"""SELECT split, {_KNOWN} FROM (SELECT split, len(regexp_extract_all(label, '{_RX}')) AS n,
 CASE WHEN contains(label, chr(92)) THEN 0 ELSE CASE {a.h("'pred'", "doc_id")} % 4 WHEN 0 THEN 0 WHEN 1 THEN length(label) - length(replace(label, 'e', ''))
 WHEN 2 THEN 4 ELSE length(label) - length(replace(label, 'on', '')) END END AS e FROM reg) GROUP BY split""",
        "reg",
    ),
)
def cer_documents(spark, sf_dir):
    return _rates(metrics.pair_edits(a.document_changes(spark, sf_dir, spread=True)))


def rule_reader():
    """Answers to labels: every e becomes a character that no label holds, but for labels with commands."""
    return lambda labels: [x if x is None or "\\" in x else x.replace("e", "\x07") for x in labels]


@query(
    "eval_cer",
    a.sql(
        f"""SELECT split, sum(e)::BIGINT AS edits, sum(n)::BIGINT AS ref_tokens, round(sum(e) / sum(n), 6) AS error_rate FROM
 (SELECT split, CASE WHEN contains(label, chr(92)) THEN 0 ELSE length(label) - length(replace(label, 'e', '')) END AS e,
  len(regexp_extract_all(label, '{_RX}')) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {a.h("'eval'", "img_path")}, img_path) AS r FROM reg) WHERE r <= {fixed.EVAL_SAMPLES})
 GROUP BY split""",
        "reg",
    ),
)
def eval_cer(spark, sf_dir):
    """Read the dataset -> a sample per split -> answers of a model -> pooled error rate. A changed token counts one edit."""
    path = scratch_folder(spark, "sft-eval")
    datasets.write_records(datasets.sft_records(a.samples(spark, sf_dir), keep=["split"]), path, "split")
    records = datasets.read_records(spark, path, splits=True)
    rows = records.select("split", *datasets.answers(records))
    chosen = sampling.sample_per_split(rows, dict.fromkeys(fixed.SPLITS, fixed.EVAL_SAMPLES), "eval")
    keys = ["split", "img_path"]
    given = scoring.score_batch(chosen, rule_reader, "rule_reader", keys, "label", T.StringType(), "pred")
    return _rates(metrics.pair_edits(scoring.joined_answers(chosen, given, keys, "pred")))


@query(
    "wer_by_split",
    a.sql(
        f"""SELECT split, {_KNOWN} FROM (SELECT split, len(regexp_extract_all(label, '{fixed.WORD_TOKEN}')) AS n,
 {a.h("'pred'", "img_path")} % 4 AS e FROM chat) GROUP BY split""",
        "chat0", "chat",
    ),
)
def wer_by_split(spark, sf_dir):
    return _rates(metrics.pair_edits(a.chat_changes(spark, sf_dir), tokenizer=fixed.WORD_TOKEN))


@query(
    "softmax_probs",
    a.sql(
        """SELECT vec_id, i - 1 AS class, round(exp(logits[i] - m) / z, 6) AS p FROM
 (SELECT *, list_sum(list_transform(logits, lambda x: exp(x - m))) AS z, unnest(range(1, len(logits) + 1)) AS i
 FROM (SELECT *, list_max(logits) AS m FROM lg))""",
        "lg",
    ),
)
def softmax_probs(spark, sf_dir):
    each = a.logits(spark, sf_dir).select(
        "vec_id", F.posexplode(vectors.softmax(F.col("logits"))).alias("class", "p")
    )
    return each.select("vec_id", F.col("class").cast("bigint"), F.round("p", 6).alias("p"))


@query(
    "top1_class",
    a.sql(
        "SELECT vec_id, ((list_position(logits, list_max(logits)) - 1) % 3 + 1)::INTEGER AS score FROM lg",
        "lg",
    ),
)
def top1_class(spark, sf_dir):
    best = vectors.top1(F.col("logits"), [fixed.CLASSES[i % 3] for i in range(64)])
    return a.logits(spark, sf_dir).select("vec_id", best.cast("int").alias("score"))


@query(
    "topk_accuracy",
    a.sql(
        """SELECT count(*) AS n, round(avg((rank < 1)::INTEGER) * 100, 4) AS top1, round(avg((rank < 5)::INTEGER) * 100, 4) AS top5
 FROM (SELECT len(list_filter(l, lambda x: x > l[target + 1])) AS rank FROM (SELECT logits AS l, target FROM lg))""",
        "lg",
    ),
)
def topk_accuracy(spark, sf_dir):
    found = metrics.accuracy(a.logits(spark, sf_dir), "logits", "target")
    return found.select("n", F.round("top1", 4).alias("top1"), F.round("top5", 4).alias("top5"))


@query(
    "cross_entropy",
    a.sql(
        """SELECT round(avg(ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) + m - logits[target + 1]), 6) AS loss, count(*) AS n
 FROM (SELECT *, list_max(logits) AS m FROM lg)""",
        "lg",
    ),
)
def cross_entropy(spark, sf_dir):
    loss = vectors.cross_entropy(F.col("logits"), F.col("target"))
    return a.logits(spark, sf_dir).agg(F.round(F.avg(loss), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query(
    "weighted_mean",
    a.sql(
        """SELECT phase, epoch, round(sum(loss * n) / sum(n), 8) AS loss, round(avg(lr), 8) AS lr FROM batches GROUP BY 1, 2""",
        "batches",
    ),
)
def weighted_mean(spark, sf_dir):
    return _epochs(a.lines_as_batches(spark, sf_dir))


def _epochs(batches):
    """Metric rows per epoch: weighted loss and the plain mean of the learning rates."""
    keys = ["phase", "epoch"]
    loss = F.round(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")), 8)
    return batches.groupBy(*keys).agg(loss.alias("loss"), F.round(F.avg("lr"), 8).alias("lr"))


@query(
    "weighted_means_all",
    a.sql(
        """SELECT phase, round(sum(loss * n) / sum(n), 8) AS loss, round(sum(lr * n) / sum(n), 8) AS lr FROM batches GROUP BY 1""",
        "batches",
    ),
)
def weighted_means_all(spark, sf_dir):
    means = metrics.weighted_means(a.lines_as_batches(spark, sf_dir), ["phase"], "n", ["loss", "lr"])
    return means.select("phase", F.round("loss", 8).alias("loss"), F.round("lr", 8).alias("lr"))


@query(
    "best_epoch",
    a.sql(
        """SELECT phase, epoch, loss FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY loss, epoch) AS r FROM
 (SELECT phase, epoch, round(sum(loss * n) / sum(n), 8) AS loss FROM batches GROUP BY 1, 2)) WHERE r = 1""",
        "batches",
    ),
)
def best_epoch(spark, sf_dir):
    summary = scratch_folder(spark, "summary")
    _epochs(a.lines_as_batches(spark, sf_dir)).write.mode("append").parquet(summary)
    rows = spark.read.schema("phase string, epoch int, loss double, lr double").parquet(summary)
    return metrics.best_epoch(rows, ["phase"], "loss")


@query(
    "best_epoch_increasing",
    a.sql(
        """SELECT phase, epoch, lr FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY lr DESC, epoch) AS r FROM
 (SELECT phase, epoch, round(avg(lr), 8) AS lr FROM batches GROUP BY 1, 2)) WHERE r = 1""",
        "batches",
    ),
)
def best_epoch_increasing(spark, sf_dir):
    return metrics.best_epoch(_epochs(a.lines_as_batches(spark, sf_dir)), ["phase"], "lr")
