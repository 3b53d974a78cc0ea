"""Batch scoring by a user's model, and the teacher and student steps built on it."""

import hashlib

from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import fixed, workers
from quillspark.functions import rules, vectors
from quillspark.operators import registry as reg
from quillspark.operators.sampling import sample_per_split
from quillspark.session import written

KEY = reg.KEY


def score_batch(df, factory, name, keys, value, result_type, output="answer", batch=fixed.SCORE_BATCH):
    """Run a model over `value`: `factory()` gives a function from a list to an equally long list.

    The model is built once per worker process, and again when the factory or what it holds has
    changed. Answers go with their key, never by row position.
    """
    version = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()
    kind = T.DataType.fromDDL(result_type) if isinstance(result_type, str) else result_type
    fields = [df.schema[k] for k in keys] + [T.StructField(output, kind)]

    def run(batches):
        score = workers.loaded(name, version, factory)
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                answers = score(part[value].tolist())
                if len(answers) != len(part):
                    raise ValueError(f"{len(part)} inputs gave {len(answers)} answers")
                yield part[keys].assign(**{output: answers})

    columns = list(dict.fromkeys([*keys, value]))
    return df.select(*columns).mapInPandas(run, T.StructType(fields))


def joined_answers(rows, answers, keys, output):
    """`rows` with the answer to each, by key. A row without an answer, or with two, is an error: none is lost in silence."""

    def wrong(what):
        return F.raise_error(F.concat_ws(" ", F.lit(what), *[F.col(k).cast("string") for k in keys])).cast(answers.schema[output].dataType)

    single = answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(output).alias("__answer"))
    value = F.when(F.col("__n") == 1, F.col("__answer")).when(F.col("__n") > 1, wrong("answered twice:")).otherwise(wrong("no answer:"))
    return rows.join(single, keys, "left").withColumn(output, value).drop("__n", "__answer")


def teacher_scores(registry, factory, name, sizes, seed, value="img_path"):
    """Answers of the teacher on a fixed number of rows per split; only class answers become scores."""
    subset = sample_per_split(registry, sizes, seed)
    answers = score_batch(subset, factory, name, KEY, value, T.StringType(), batch=1)
    return answers.select(*KEY, rules.class_score(F.col("answer")).alias("score"))


def label_with_teacher(registry, factory, name, sizes, seed, value="img_path"):
    """The registry after a labelling run, which first resets all scores."""
    scores = teacher_scores(registry, factory, name, sizes, seed, value)
    return reg.merge_scores(registry, scores, reset=True)


def label_with_student(registry, factory, name, value="img_path"):
    """Scores for every row without one: the class with the largest probability."""
    logits = score_batch(
        reg.unscored(registry), factory, name, KEY, value, T.ArrayType(T.DoubleType()), "logits"
    )
    best = vectors.top1(vectors.softmax(F.col("logits")), fixed.CLASSES)
    return reg.merge_scores(registry, logits.select(*KEY, best.cast("int").alias("score")))


COUNT_SCALE = 1 << 20


class CountedStudent:
    """A multinomial naive Bayes model in whole numbers: `words` has a row (word, w1, w2, ...), the gain of each class for a token of that word;
    `start` and `token` are each class's share and its gain for any token. Gains are natural logarithms times 2^20, rounded."""

    def __init__(self, classes, words, start, token):
        self.classes, self.words, self.start, self.token = classes, words, start, token


def _gain(number):
    return F.round(F.ln(number) * COUNT_SCALE).cast("bigint")


def counted_student(registry, text="label", classes=fixed.CLASSES):
    """A student in closed form: counts of words per class over the scored rows, each task adding up its own first.

    Only the table of words grows with the data, and it stays distributed; the driver gets the totals of the classes. A class without rows has the share of one row in them.
    """
    classes = [int(c) for c in classes]
    scored = registry.where(F.col("score").isin(*classes) & F.col(text).isNotNull())
    of = [(F.col("score") == c).cast("bigint") for c in classes]
    tokens = scored.select("score", F.explode(F.regexp_extract_all(F.col(text), F.lit(fixed.WORD_TOKEN), F.lit(0))).alias("word"))
    counts = written(tokens.groupBy("word").agg(*[F.sum(x).alias(f"n{c}") for c, x in zip(classes, of)]), "word-counts")
    rows = scored.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"r{c}") for c, x in zip(classes, of)])
    totals = counts.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"t{c}") for c in classes])
    everything = sum((F.col(f"r{c}") for c in classes), F.lit(len(classes)))
    start = [_gain((F.col(f"r{c}") + 1) / everything) for c in classes]
    token = [-_gain(F.col(f"t{c}") + F.col("v") + 1) for c in classes]
    found = rows.crossJoin(totals).select(F.array(*start).alias("start"), F.array(*token).alias("token")).first()  # two single rows
    words = counts.select("word", *[_gain(F.col(f"n{c}") + 1).alias(f"w{c}") for c in classes])
    return CountedStudent(classes, words, found.start, found.token)


def label_with_counts(registry, student, text="label"):
    """Scores for the rows without one: the class with the largest sum of gains, the lower one on a tie. Unknown words and empty texts are taken as they come.

    Tokens are far more than words, and some words are in every text: each task hashes its part of the words and streams the tokens, where a sort would hold them.
    """
    tokens = reg.unscored(registry).where(F.col(text).isNotNull()).select(*KEY, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(fixed.WORD_TOKEN), F.lit(0))).alias("word"))
    known = tokens.join(student.words.hint("shuffle_hash"), "word", "left")
    sums = known.groupBy(*KEY).agg(F.count("word").alias("n"), *[F.coalesce(F.sum(f"w{c}"), F.lit(0)).alias(f"w{c}") for c in student.classes])
    total = [F.col(f"w{c}") + F.col("n") * token + start for c, token, start in zip(student.classes, student.token, student.start)]
    best = F.array_max(F.array(*[F.struct(x.alias("x"), F.lit(-c).alias("c")) for c, x in zip(student.classes, total)]))
    return reg.merge_scores(registry, sums.select(*KEY, (-best["c"]).cast("int").alias("score")))


def trained_student(registry, text="label", features=1 << 12, iterations=20):
    """A text classifier trained on the scored rows, as a stand-in for an image classifier."""
    stages = [
        Tokenizer(inputCol=text, outputCol="__words"),
        HashingTF(inputCol="__words", outputCol="__features", numFeatures=features),
        LogisticRegression(
            labelCol="__class", featuresCol="__features", predictionCol="__best",
            probabilityCol="__p", rawPredictionCol="__raw", maxIter=iterations, regParam=0.01,
        ),
    ]
    scored = registry.where(F.col("score").isNotNull() & F.col(text).isNotNull())
    return Pipeline(stages=stages).fit(scored.withColumn("__class", (F.col("score") - 1).cast("double")))


def label_with_model(registry, model, text="label"):
    """Scores for the rows without one from a trained student."""
    rows = reg.unscored(registry).where(F.col(text).isNotNull())
    best = model.transform(rows).select(*KEY, (F.col("__best") + 1).cast("int").alias("score"))
    return reg.merge_scores(registry, best)
