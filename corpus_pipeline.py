"""The corpus pipeline: each stage works on all documents that the one before it kept, written as Parquet and read again.

Defined results: a row with a null text counts as one with an empty text; of all texts without a character that is not white space one row goes on (exact copies), and it has its
end id alone (packing). Of equal rows, repeated ids among them, one goes on. Rows without an id or a source are documents like others: they are never
trained on, and a missing source is a source of its own. Ties go to the smaller id, null last. Texts of any length pass whole. Extra columns, whatever their names, stay as they are until packing,
which has columns of its own. Without toxic labels nothing is rejected. An empty table of documents gives no pieces.
"""

import functools

from quillspark.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from quillspark.llm.queries import documents, tokenizer
from quillspark.session import clear_scratch_between, scratch_folder, scratch_mark


_before = []  # marks around the scratch folders of the stage before


def _stage(function):
    """A stage: one after the other they run in the same executors and on the same disk.

    Texts go to the workers some megabytes at a time. What a stage wrote besides its output goes when the next one begins, for by then its output is written.
    """

    @functools.wraps(function)
    def run(spark, docs, sf_dir):
        while _before:
            clear_scratch_between(spark, *_before.pop())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        first = scratch_mark()
        out = function(spark, docs, sf_dir)
        _before.append((first, scratch_mark()))
        return out

    return run


@_stage
def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_copies(spark, docs, sf_dir):
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


@_stage
def drop_near(spark, docs, sf_dir):
    """Of each group of near duplicates (five-word shingles, likeness 0.8 or more) one document stays."""
    return ngram_join.drop_near(docs)


@_stage
def mix_sources(spark, docs, sf_dir):
    """Documents in training order, repeated or left out so that sources meet their weights."""
    return mixing.mixed(docs)


@_stage
def pack_sequences(spark, docs, sf_dir):
    """Pieces of the mixed documents in sequences of at most 1024 tokens."""
    # the executors have run the other stages before: a small memory of pieces
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0, most_pieces=200_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The first stage is a fitted model and the last a tokenizer: SQL expresses neither. tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = scratch_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
