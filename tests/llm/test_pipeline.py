"""The stages of the pipeline against plain versions, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from odd import ODD
from test_ngram_join import plain_components
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(spark, tmp_path_factory, name, docs):
    folder = str(tmp_path_factory.mktemp(name) / "out")
    dict(corpus_pipeline.STAGES)[name](spark, docs, SF).write.parquet(folder)
    return spark.read.parquet(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_stages_one_after_the_other(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows_of(docs)
    clean = stage(spark, tmp_path_factory, "toxicity", docs)
    assert clean.columns == DOCS and set(rows_of(clean)) <= set(before) and clean.count() > 0.7 * len(before)

    before = rows_of(clean)
    single = stage(spark, tmp_path_factory, "exact_dedup", clean)
    best = {}
    for r in before:
        key = re.sub("[\x20\x09-\x0d]", "", r[1])
        best.setdefault(key, []).append((-len(r[1]), r[0]))
    assert [r[0] for r in rows_of(single)] == sorted(min(g)[1] for g in best.values())

    before = rows_of(single)
    apart = stage(spark, tmp_path_factory, "near_duplicates", single)
    want = plain_components([(r[0], r[1]) for r in before], 5, 80)
    assert [r[0] for r in rows_of(apart)] == sorted(i for i, n, c in want if not n or i == c)

    before = {r[0]: r for r in rows_of(apart)}
    mixed = stage(spark, tmp_path_factory, "mixing", apart)
    assert mixed.columns == DOCS
    counts, cut = Counter(), 0
    for r in rows_of(mixed):
        assert r[2:] == before[r[0]][2:] and before[r[0]][1].startswith(r[1])
        counts[r[0]] += 1
        cut += r[1] != before[r[0]][1]
    assert max(counts.values()) <= 3 and cut <= 20 and max(counts.values()) > 1

    packed = stage(spark, tmp_path_factory, "packing", mixed).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(encode.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(p.length for p in packed) == tokens
    assert tokens / 1024 / len({p.sequence_id for p in packed}) > 0.97


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def tables(spark, folder, rows, labels):
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, row string, mark int, score double"
    spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    clean = [(100 + i, f"document {i} speaks of nothing but number {i} and of {i * 7} again", "en", "s1" if i % 3 else None, 50) for i in range(60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + clean + clean[:5] + [(None, "without an id there is a text", "en", "s2", 1), (None, None, None, None, None)]
    sf = tables(spark, tmp_path, rows, [(100 + i, 1, 0) for i in range(40)] + [(None, 1, 1), (101, None, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, run in corpus_pipeline.STAGES[:3]:
        run(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
    # no toxic label: all are clean. Of equal texts the longest goes on, then the smallest id; of those without words one
    best = {}
    for i, t in [(r[0], r[1]) for r in rows]:
        best.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {min(v)[3] for v in best.values()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert packed and {p.doc_id for p in packed} <= set(kept)  # mixing may leave some out
    for p in packed:
        assert 0 < p.length <= 1024 and p.start + p.length <= p.doc_tokens


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0
