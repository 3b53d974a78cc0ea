import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import fixed
from quillspark.functions import hashing, permute
from quillspark.operators import datasets, dedup, sampling, scoring
from quillspark.operators import registry as reg
from quillspark.plans import curation

ROWS = "img_path string, label string, split string, score int"


def make(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def test_all_members_of_a_group_go_but_other_splits_stay(spark):
    df = make(spark, [("a", "x", "train", 1), ("b", "x", "train", 1), ("c", "x", "valid", 1), ("d", "y", "train", 1)])
    assert {r.img_path for r in dedup.drop_equal(df, "label").collect()} == {"c", "d"}
    assert {r.img_path for r in dedup.drop_equal(df, "label", "keep_first").collect()} == {"a", "c", "d"}
    blank = make(spark, [("a", None, "train", 1), ("b", None, "train", 1), ("c", "x", "train", 1)])
    for policy in ("drop_all", "keep_first"):
        assert dedup.drop_equal(blank, "label", policy).count() == 3
    with pytest.raises(ValueError):
        dedup.drop_equal(df, "label", "other")


def test_hot_fingerprint(spark):
    n = 20000
    df = spark.range(n).select(
        F.concat(F.lit("p"), "id").alias("img_path"), F.lit("train").alias("split"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("fp"))
    assert dedup.drop_equal(df, "fp").count() == n - len(range(0, n, 3))
    assert dedup.drop_equal(df, "fp", "keep_first").count() == n - len(range(0, n, 3)) + 1


def plain_signature(text, seeds):
    import hashlib

    words = text.split(" ")
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [text]
    hashed = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in runs]
    return [min((x * a + b) % dedup.PRIME for x in hashed) for a, b in seeds]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=80)) for _ in range(30)]
    texts = base + [t + " z" for t in base[:10]] + [base[0], "one", "one two", None, ""]
    rows = [(f"p{i}", t, rng.choice(["train", "train", "valid"]), None) for i, t in enumerate(texts)]
    df = make(spark, rows)
    signatures = dedup.minhash_signatures(df, F.col("label"))
    seeds = hashing.permutation_seeds(64, dedup.PRIME)
    plain = {p: plain_signature(t or "", seeds) for p, t, _, _ in rows}
    assert {r.img_path: list(r.minhash) for r in signatures.collect()} == plain
    want = {}
    for p, _, split, _ in rows:
        mine = [tuple(plain[p][b * 21 : b * 21 + 21]) for b in range(3)]
        others = [q for q, _, s, _ in rows if s == split and q != p]
        want[p] = sum(any(tuple(plain[q][b * 21 : b * 21 + 21]) == mine[b] for q in others) for b in range(3))
    flags = dedup.near_duplicate_flags(df, signatures)
    assert {r.img_path: r.bands_shared for r in flags.collect()} == want
    assert {r.img_path for r in dedup.drop_near(df, signatures).collect()} == {p for p in want if not want[p]}
    assert any(want.values()) and not all(want.values())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_are_made_once_and_texts_stay_where_they_are(spark):
    df = spark.createDataFrame([(f"{i}", "train", f"a b c {i % 3}") for i in range(9)], "img_path string, split string, label string")
    signatures = dedup.minhash_signatures(df, F.col("label"))
    for out in (dedup.near_duplicate_flags(df, signatures), dedup.drop_near(df, signatures)):
        assert str(dedup.PRIME) not in plan_of(out)
    executed = curation.near_dup_drop(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [line for line in executed.split("\n") if "Project" in line and "length(text" in line]


def test_quick_hash_signatures_agree_for_equal_texts(spark):
    df = make(spark, [("a", "u v w x", "train", None), ("b", "u v w x", "train", None), ("c", "other words here", "train", None)])
    kept = dedup.drop_near(df, dedup.minhash_signatures(df, F.col("label"), hasher=dedup.quick_hash))
    assert [r.img_path for r in kept.collect()] == ["c"]


def test_scores_new_wins_old_stays(spark):
    df = make(spark, [("a", "", "train", 1), ("b", "", "train", 2), ("a", "", "valid", None)])
    new = make(spark, [("a", "train", 3)], "img_path string, split string, score int")
    got = {(r.img_path, r.split): r.score for r in reg.merge_scores(df, new).collect()}
    assert got == {("a", "train"): 3, ("b", "train"): 2, ("a", "valid"): None}
    got = {(r.img_path, r.split): r.score for r in reg.merge_scores(df, new, reset=True).collect()}
    assert got == {("a", "train"): 3, ("b", "train"): None, ("a", "valid"): None}
    with pytest.raises(PySparkException, match="scored twice"):
        reg.merge_scores(df, new.union(new)).collect()
    bare = df.drop("score")
    assert reg.unscored(bare).count() == 3
    assert {r.score for r in reg.merge_scores(bare, new).collect()} == {3, None}


def test_upsert_keeps_known_rows(spark):
    now = make(spark, [("a", "old", "train", 1)])
    incoming = make(spark, [("a", "new", "train"), ("a", "new", "valid")], "img_path string, label string, split string")
    got = sorted((r.img_path, r.label, r.split, r.score) for r in reg.upsert(now, incoming).collect())
    assert got == [("a", "new", "valid", None), ("a", "old", "train", 1)]


def test_shares_count_unscored_rows_and_quota_truncates(spark):
    df = make(spark, [(f"p{i}", "", "train", 1 if i < 2 else None) for i in range(7)])
    row = reg.class_quotas(df, {"train": 8000}).first()
    assert (row.n_class, row.n_split, row.quota) == (2, 7, int(8000 * (2 / 7)))
    assert reg.class_quotas(df.where("false"), {"train": 8000}).count() == 0


def test_draws(spark):
    rows = [(f"p{i:04d}", f"<{i}>", "train" if i % 4 else "valid", i % 5 or None) for i in range(900)]
    rows = [(p, l, s, c if c in (1, 2, 3) else None) for p, l, s, c in rows]
    df = make(spark, rows)
    wanted = {"train": 80, "valid": 40, "test": 10}
    many = sampling.combined_samples(df.repartition(8), wanted, "s", max_size=64)
    one = sampling.combined_samples(df.coalesce(1), wanted, "s", max_size=64)
    members = sampling.draw_members(df, wanted, "s", max_size=64).collect()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    pool = {p: (s, c) for p, _, s, c in rows}
    draws = {}
    for m in members:
        assert pool[m.img_path] == (m.split, m.score)
        draws.setdefault((m.split, m.score, m.draw), {})[m.ordinal] = m.img_path
    quota = {(r.split, r.score): r.quota for r in reg.class_quotas(df, wanted).collect()}
    assert {k: sum(1 for d in draws if d[:2] == k) for k in quota} == quota
    label = {p: l for p, l, _, _ in rows}
    for row in many.collect():
        chosen = draws[(row.split, row.score, row.draw)]
        assert sorted(chosen) == list(range(row.n_members)) and 1 <= row.n_members <= 64
        assert len(set(chosen.values())) == row.n_members
        assert row.label == "".join(label[chosen[i]] for i in range(row.n_members))
    sizes = [r.n_members for r in many.collect()]
    assert min(sizes) < 16 and max(sizes) > 48


def test_permutations_visit_each_place_once(spark):
    sizes = [*range(1, 40), 64, 65, 100, 1000, 4097, 10_001]
    rows = spark.createDataFrame([(n, t) for n in sizes for t in range(3)], "size bigint, tag int")
    keys = permute.keys(lambda name: hashing.hash32(name, F.col("tag"), F.col("size")))
    rows = rows.select("size", "tag", *[k.alias(c) for c, k in keys.items()], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("i"))
    placed = permute.permuted(rows, "i", "size", "at")
    assert placed.columns == ["size", "tag", "i", "at"]
    sums = placed.groupBy("size", "tag").agg(F.countDistinct("at").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.sum((F.col("i") == F.col("at")).cast("int")).alias("still"))
    for r in sums.collect():
        assert (r.n, r.low, r.high) == (r["size"], 0, r["size"] - 1)
        assert r["size"] < 100 or r.still < 9


def test_all_pairs_are_drawn_alike(spark):
    pool, n, draws = 13, 4, 6000
    df = make(spark, [(f"p{i:02d}", "", "train", 1) for i in range(pool)])
    members = sampling.draw_members(df, {"train": draws}, "pairs", max_size=n)
    sizes, orders, pairs = {}, {}, {}
    for m in members.collect():
        sizes.setdefault(m.draw, {})[m.ordinal] = int(m.img_path[1:])
    wanted = 0
    for chosen in sizes.values():
        orders[chosen[0]] = orders.get(chosen[0], 0) + 1
        values = sorted(chosen.values())
        wanted += len(values) * (len(values) - 1) / 2
        for i, x in enumerate(values):
            for y in values[i + 1 :]:
                pairs[x, y] = pairs.get((x, y), 0) + 1
    # chi-square of 77 and of 12 degrees of freedom: the bounds leave one in a million
    assert len(sizes) == draws and len(pairs) == 78
    assert sum((c - wanted / 78) ** 2 for c in pairs.values()) / (wanted / 78) < 150
    assert sum((c - draws / pool) ** 2 for c in orders.values()) / (draws / pool) < 51


def test_any_sample_size_without_a_hot_task(spark):
    df = make(spark, [(f"p{i}", "", "train" if i % 7 else "valid", None) for i in range(9000)])
    out = sampling.sample_per_split(df, {"train": 5000, "valid": 2000}, "x")
    assert sorted((r.split, r["count"]) for r in out.groupBy("split").count().collect()) == [("train", 5000), ("valid", 1286)]


def test_samples_do_not_depend_on_partitions(spark):
    df = make(spark, [(f"p{i}", "", "train" if i % 9 else "valid", None) for i in range(500)])
    sizes = {"train": 12, "valid": 5, "test": 5}
    pick = lambda d: sorted((r.split, r.img_path) for r in sampling.sample_per_split(d, sizes, "x").collect())
    assert pick(df.repartition(7)) == pick(df.coalesce(1))
    assert len(pick(df)) == 17
    assert sampling.sample(df, 3, "x", "img_path").count() == 3


def test_score_batch_checks_lengths_and_sends_batches(spark):
    df = spark.range(50, numPartitions=2).select(F.col("id").cast("string").alias("img_path"))

    def short():
        return lambda items: items[:-1]

    def sizes():
        return lambda items: [str(len(items))] * len(items)

    with pytest.raises(PySparkException, match="inputs gave"):
        scoring.score_batch(df, short, "short", ["img_path"], "img_path", T.StringType()).collect()
    got = scoring.score_batch(df, sizes, "sizes", ["img_path"], "img_path", T.StringType(), batch=10).collect()
    assert len(got) == 50 and {int(r.answer) for r in got} <= {10, 5}


def test_teacher_resets_and_guards(spark):
    df = make(spark, [(f"p{i}", "", "train", 2) for i in range(20)])

    def teacher():
        return lambda paths: ["3" if int(p[1:]) % 2 else "maybe" for p in paths]

    got = {r.img_path: r.score for r in scoring.label_with_teacher(df, teacher, "odd", {"train": 20}, "s").collect()}
    assert got == {f"p{i}": (3 if i % 2 else None) for i in range(20)}


def test_dpo_keeps_wrong_answers_only(spark):
    rows = [("a", "x", " x\n"), ("b", "x ", "x"), ("c", "y", "z"), ("d", "y", None)]
    df = make(spark, rows, "img_path string, label string, pred string")
    out = datasets.dpo_records(df).collect()
    assert sorted((r.images[0], r.chosen.value, r.rejected.value) for r in out) == [("b", "x ", "x"), ("c", "y", "z")]
    assert datasets.dpo_records(df.where("img_path = 'a'")).count() == 0


def test_calibration_looks_at_the_first_message_only(spark):
    rows = [(1, 0, "human", "<image> what? "), (1, 1, "gpt", "this"), (2, 0, "system", "s"), (2, 1, "human", "<image>q"),
            (3, 0, "human", "no tag"), (3, 1, "gpt", "r")]
    df = make(spark, rows, "id int, pos int, who string, said string")
    pairs = datasets.first_messages(df, ["id"], "pos", "who", "said")
    out = {r.id: r.m for r in pairs.select(
        "id", datasets.calibration_messages(F.col("first"), F.col("second"), F.lit("i.png")).alias("m")).collect()}
    assert [m.role for m in out[1]] == ["user", "assistant"]
    assert out[1][0].parts[0].image == "file:///i.png" and out[1][0].parts[1].text == "what?"
    assert out[1][1].parts[0].text == "this"
    assert [(m.role, m.parts[0].text) for m in out[2]] == [("system", "s")]
    assert [(m.role, m.parts[0].text) for m in out[3]] == [("human", "no tag")]


def test_records_read_from_lines_and_arrays(spark, tmp_path):
    import json

    df = make(spark, [("a.png", "l\n\"1\"", "train", 1), ("b.png", "", "train", 1)])
    path = str(tmp_path / "sft")
    datasets.write_records(datasets.sft_records(df), path)
    lines = datasets.read_back(datasets.read_records(spark, path))
    whole = tmp_path / "sft.json"
    whole.write_text(json.dumps([
        {"conversations": [{"from": "human", "value": "<image>q"}, {"from": "gpt", "value": l}], "images": [p]}
        for p, l in (("a.png", "l\n\"1\""), ("b.png", ""))], indent=4))
    array = datasets.read_back(datasets.read_records(spark, str(whole), array_file=True))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, array.collect())) == [("a.png", "l\n\"1\""), ("b.png", "")]


def test_manifest(spark):
    import json

    text = json.loads(datasets.manifest({"sft": "sft_train.json", "dpo": "dpo_train.json"}))
    assert text["dpo"]["ranking"] is True and text["sft"]["columns"]["messages"] == "conversations"
    df = make(spark, [("a", "x", "y")], "img_path string, label string, pred string")
    out = reg.apply_manifest(datasets.dpo_records(df), fixed.DATASETS["dpo"])
    assert out.columns == ["messages", "chosen", "rejected", "images"]


def test_counted_student_is_the_plain_rule(spark):
    import math

    rng = random.Random(2)
    words = {1: "aa bb cc dd", 2: "bb cc ee ff", 3: "gg hh aa ff"}
    rows = []
    for i in range(300):
        score = rng.choice([1, 2, 2, 3])
        label = " ".join(rng.choices(words[score].split() + ["zz"], k=rng.randrange(0, 12)))
        rows.append((f"p{i}", label, "train" if i % 4 else "valid", score if i % 2 else None))
    rows += [("e", "", "train", None), ("n", None, "train", None), ("m", None, "train", 1), ("u", "new words \t only", "train", None), ("o", "aa", "train", 9)]
    df = make(spark, rows).repartition(4)
    student = scoring.counted_student(df)
    got = {r.img_path: r.score for r in scoring.label_with_counts(df, student).collect()}
    gain = lambda x: round(math.log(x) * 2**20)
    known = [r for r in rows if r[3] in (1, 2, 3) and r[1] is not None]
    counts = {c: {} for c in (1, 2, 3)}
    for _, label, _, c in known:
        for w in label.split():
            counts[c][w] = counts[c].get(w, 0) + 1
    vocabulary = len({w for c in counts.values() for w in c})

    def best(label):
        total = {}
        for c in (1, 2, 3):
            own = sum(r[3] == c for r in known)
            total[c] = gain((own + 1) / (len(known) + 3)) + sum(gain(counts[c].get(w, 0) + 1) - gain(sum(counts[c].values()) + vocabulary + 1) for w in label.split())
        return min(c for c in total if total[c] == max(total.values()))

    for path, label, _, score in rows:
        assert got[path] == (score if score is not None else None if label is None else best(label))
    right = sum(got[p] == (1 if "dd" in l else 2 if "ee" in l else 3 if "gg" in l else got[p]) for p, l, _, s in rows[:300] if s is None)
    assert right > 130
    nothing = scoring.label_with_counts(df, scoring.counted_student(df.where("score is null")))
    assert {r.score for r in nothing.where("label is not null").collect()} <= {1, 2, 3, 9}
    assert scoring.label_with_counts(df.where("false"), student).count() == 0


def test_tokens_are_not_sorted_by_word(spark):
    df = spark.createDataFrame([("a", "train", "x y", 1), ("b", "train", "x z", None)], "img_path string, split string, label string, score int")
    tokens_join = [line for line in plan_of(scoring.label_with_counts(df, scoring.counted_student(df))).split("\n") if "Join LeftOuter" in line and "word" in line]
    assert tokens_join and all("shuffle_hash" in line for line in tokens_join)


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifest")
    datasets.write_manifest(spark, {"sft": "a.json", "dpo": "b.json"}, path)
    got = {(r.dataset, r.file_name, r.theirs, r.ours) for r in datasets.read_manifest(spark, path).collect()}
    assert got == {(n, f, t, o) for n, f in (("sft", "a.json"), ("dpo", "b.json")) for t, o in fixed.DATASETS[n]["columns"].items()}
