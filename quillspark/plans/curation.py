"""Registry, scoring, duplicates, quotas, draws and dataset queries, each with its SQL check."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import fixed, schemas
from quillspark.functions import hashing, layout, permute, rules, text, vectors
from quillspark.operators import datasets, dedup, ordered, sampling, scoring, similar
from quillspark.operators import registry as reg
from quillspark.plans import adapters as a
from quillspark.session import scratch_folder, written
from quillspark.sources import images, ink, tables

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- registry ---------------------------------------------------------------------------------


@query(
    "registry_scan",
    a.sql("SELECT img_path, md5(label) AS label_md5, split, score FROM scored", "reg", "sc", "scored"),
)
def registry_scan(spark, sf_dir):
    root = scratch_folder(spark, "registry")
    saved = tables.read_or_create(spark, root, lambda: a.registry(spark, sf_dir).drop("doc_id"))
    return saved.select("img_path", F.md5("label").alias("label_md5"), "split", "score")


@query("split_counts", a.sql("SELECT split, count(*) AS n_rows FROM reg GROUP BY split", "reg"))
def split_counts(spark, sf_dir):
    return reg.split_counts(a.samples(spark, sf_dir))


@query("split_filter", a.sql("SELECT img_path, label FROM reg WHERE split = 'valid'", "reg"))
def split_filter(spark, sf_dir):
    return reg.split_rows(a.samples(spark, sf_dir), "valid").select("img_path", "label")


@query("unscored", a.sql("SELECT img_path, split FROM scored WHERE score IS NULL", "reg", "sc", "scored"))
def unscored(spark, sf_dir):
    return reg.unscored(a.registry(spark, sf_dir)).select("img_path", "split")


def _present(spark, sf_dir):
    """A registry that holds the labelled documents only."""
    rows = a.samples(spark, sf_dir).join(a.scores(spark, sf_dir), "doc_id")
    return rows.select("img_path", "label", "split", "score")


@query(
    "registry_new_entries",
    a.sql(
        "SELECT img_path, split FROM reg r WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id)", "reg"
    ),
)
def registry_new_entries(spark, sf_dir):
    incoming = a.samples(spark, sf_dir).select("img_path", "label", "split")
    return reg.new_entries(incoming, _present(spark, sf_dir)).select("img_path", "split")


@query(
    "registry_upsert",
    a.sql("SELECT img_path, split, length(label) AS chars, score FROM scored", "reg", "sc", "scored"),
)
def registry_upsert(spark, sf_dir):
    incoming = a.samples(spark, sf_dir).select("img_path", "label", "split")
    merged = reg.upsert(_present(spark, sf_dir), incoming)
    return merged.select("img_path", "split", F.length("label").cast("bigint").alias("chars"), "score")


def _second_opinion(spark, sf_dir):
    """New scores for the documents whose answer is one of the classes."""
    given = a.answers(spark, sf_dir).select("doc_id", rules.class_score(F.col("answer")).alias("score"))
    keys = a.samples(spark, sf_dir).select("doc_id", "img_path", "split")
    return given.where(F.col("score").isNotNull()).join(keys, "doc_id").drop("doc_id")


@query(
    "score_merge",
    a.sql(
        """SELECT img_path, split, coalesce(try_cast(trim(CASE WHEN trim(answer) IN ('1','2','3') THEN answer END) AS INTEGER), score) AS score
 FROM scored JOIN ans USING (doc_id)""",
        "reg", "sc", "scored", "ans",
    ),
)
def score_merge(spark, sf_dir):
    merged = reg.merge_scores(a.registry(spark, sf_dir), _second_opinion(spark, sf_dir))
    return merged.select("img_path", "split", "score")


@query(
    "score_domain",
    a.sql(
        """SELECT doc_id, CASE WHEN trim(answer) IN ('1','2','3') THEN trim(answer)::INTEGER END AS score,
 trim(answer) NOT IN ('1','2','3') AS rejected FROM ans""",
        "ans",
    ),
)
def score_domain(spark, sf_dir):
    score = rules.class_score(F.col("answer"))
    return a.answers(spark, sf_dir).select("doc_id", score.alias("score"), score.isNull().alias("rejected"))


_SHARES = """SELECT split, score, count(*) AS n_class, any_value(n_split) AS n_split, count(*) / any_value(n_split) AS share
 FROM (SELECT split, score, count(*) OVER (PARTITION BY split) AS n_split FROM {rows}) WHERE score IS NOT NULL GROUP BY 1, 2"""


@query(
    "class_share",
    a.sql(f"SELECT split, score, n_class, n_split, round(share, 6) AS share FROM ({_SHARES.format(rows='scored')})",
          "reg", "sc", "scored"),
)
def class_share(spark, sf_dir):
    shares = reg.class_shares(a.registry(spark, sf_dir))
    return shares.select("split", "score", "n_class", "n_split", F.round("share", 6).alias("share"))


# --- duplicates -------------------------------------------------------------------------------

_SQUEEZED = "md5(translate(label, ' '||chr(9)||chr(10)||chr(13), ''))"
_UNIQUE = f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY split, {_SQUEEZED}) AS copies FROM {{rows}}) WHERE copies = 1"""


def fingerprinted(rows):
    return rows.withColumn("phash", F.md5(F.translate("label", " \t\n\r", "")))


@query("dedup_exact", a.sql(f"SELECT img_path, split, length(label) AS chars FROM ({_UNIQUE.format(rows='reg')})", "reg"))
def dedup_exact(spark, sf_dir):
    kept = dedup.drop_equal(fingerprinted(a.samples(spark, sf_dir, spread=True)), "phash")
    return kept.select("img_path", "split", F.length("label").cast("bigint").alias("chars"))


@query(
    "dedup_keep_first",
    a.sql(f"SELECT min(img_path) AS img_path, split FROM reg GROUP BY split, {_SQUEEZED}", "reg"),
)
def dedup_keep_first(spark, sf_dir):
    kept = dedup.drop_equal(fingerprinted(a.samples(spark, sf_dir, spread=True)), "phash", policy="keep_first")
    return kept.select("img_path", "split")


@query(
    "fingerprint_groups",
    a.sql(
        f"""SELECT split, n_members, count(*) AS n_groups FROM
 (SELECT split, {_SQUEEZED} AS p, count(*) AS n_members FROM reg GROUP BY 1, 2) GROUP BY 1, 2""", "reg"),
)
def fingerprint_groups(spark, sf_dir):
    sizes = dedup.group_sizes(fingerprinted(a.samples(spark, sf_dir, spread=True)), "phash")
    return sizes.groupBy("split", "n_members").agg(F.count(F.lit(1)).alias("n_groups"))


_SEEDS = hashing.permutation_seeds(fixed.NUM_PERM, dedup.PRIME)
_A = "[" + ",".join(str(x) for x, _ in _SEEDS) + "]::BIGINT[]"
_B = "[" + ",".join(str(x) for _, x in _SEEDS) + "]::BIGINT[]"
_SIGNATURES = f"""words AS (SELECT img_path, split, string_split(label, ' ') AS w FROM reg),
shingles AS (SELECT img_path, split, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
 list_transform(range(1, len(w) - 1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) END) AS s FROM words),
hashed AS (SELECT DISTINCT img_path, split, ('0x'||substr(md5(s),1,8))::BIGINT AS x FROM shingles),
perm AS (SELECT unnest(range(0, {fixed.NUM_PERM})) AS k, unnest({_A}) AS a, unnest({_B}) AS b),
minima AS (SELECT img_path, split, k, min((x * a + b) % {dedup.PRIME}) AS m FROM hashed, perm GROUP BY 1, 2, 3),
sigs AS (SELECT img_path, split, list(m ORDER BY k) AS sig FROM minima GROUP BY 1, 2)"""
_BANDS = f"""bands AS (SELECT img_path, split, g, list(m ORDER BY k) AS key FROM
 (SELECT *, k // {fixed.LSH_ROWS} AS g FROM minima WHERE k < {fixed.LSH_BANDS * fixed.LSH_ROWS}) GROUP BY 1, 2, 3),
flags AS (SELECT img_path, split, sum((c > 1)::INTEGER)::INTEGER AS bands_shared FROM
 (SELECT *, count(*) OVER (PARTITION BY split, g, key) AS c FROM bands) GROUP BY 1, 2)"""


def _signatures(spark, sf_dir):
    return dedup.minhash_signatures(a.samples(spark, sf_dir, spread=True), F.col("label"))


@query(
    "minhash_signature",
    a.sql("SELECT img_path, array_to_string(sig, ',') AS minhash FROM sigs", "reg").replace(
        "\nSELECT img_path, array", ",\n" + _SIGNATURES + "\nSELECT img_path, array"),
)
def minhash_signature(spark, sf_dir):
    joined = F.array_join(F.col("minhash").cast("array<string>"), ",")
    return _signatures(spark, sf_dir).select("img_path", joined.alias("minhash"))


@query(
    "near_dup_flags",
    "WITH reg AS (" + a.VIEWS["reg"] + "),\n" + _SIGNATURES + ",\n" + _BANDS
    + "\nSELECT img_path, split, bands_shared FROM flags",
)
def near_dup_flags(spark, sf_dir):
    rows = a.samples(spark, sf_dir).select("img_path", "split")
    return dedup.near_duplicate_flags(rows, _signatures(spark, sf_dir))


@query(
    "near_dup_drop",
    "WITH reg AS (" + a.VIEWS["reg"] + "),\n" + _SIGNATURES + ",\n" + _BANDS
    + "\nSELECT img_path, split, length(label) AS chars FROM reg JOIN flags USING (img_path, split) WHERE bands_shared = 0",
)
def near_dup_drop(spark, sf_dir):
    rows = a.samples(spark, sf_dir).select("img_path", "split", F.length("label").cast("bigint").alias("chars"))
    return dedup.drop_near(rows, _signatures(spark, sf_dir))


_CLASSES = """words AS (SELECT img_path, split, string_split(label, ' ') AS w FROM reg),
grams AS (SELECT DISTINCT img_path, split, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
 list_transform(range(1, len(w) - 1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]) END) AS s FROM words),
sizes AS (SELECT img_path, split, count(*) AS n FROM grams GROUP BY 1, 2),
shared AS (SELECT x.split, x.img_path AS a, y.img_path AS b, count(*) AS c FROM grams x JOIN grams y
 ON x.split = y.split AND x.s = y.s AND x.img_path <> y.img_path GROUP BY ALL),
near AS (SELECT s.* FROM shared s JOIN sizes p ON p.img_path = a AND p.split = s.split JOIN sizes q ON q.img_path = b AND q.split = s.split
 WHERE c * 100 >= (p.n + q.n - c) * 90),
reach AS (SELECT split, img_path, img_path AS other FROM reg UNION
 SELECT r.split, r.img_path, n.b FROM reach r JOIN near n ON n.split = r.split AND n.a = r.other),
classes AS (SELECT img_path, split, min(other) AS class_path, count(*) AS class_size FROM reach GROUP BY 1, 2)"""


def _classes_sql(body):
    return "WITH RECURSIVE reg AS (" + a.VIEWS["reg"] + "),\n" + _CLASSES + "\n" + body


@query(
    "near_dup_pairs",
    _classes_sql("SELECT img_path, split, n::INTEGER AS n_shingles, class_path, class_size FROM classes JOIN sizes USING (img_path, split)"),
)
def near_dup_pairs(spark, sf_dir):
    """Every sample with its class of near duplicates and the class's representative."""
    return similar.near_classes(a.samples(spark, sf_dir, spread=True), F.col("label"))


@query(
    "near_dup_unique",
    _classes_sql("SELECT img_path, split, length(label) AS chars FROM reg JOIN classes USING (img_path, split) WHERE img_path = class_path"),
)
def near_dup_unique(spark, sf_dir):
    kept = similar.drop_near(a.samples(spark, sf_dir), F.col("label"))
    return kept.select("img_path", "split", F.length("label").cast("bigint").alias("chars"))


@query(
    "band_plans",
    "WITH reg AS (" + a.VIEWS["reg"] + f"""),
copies AS (SELECT split, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS share FROM
 (SELECT split, label, count(*) AS n FROM reg GROUP BY 1, 2) GROUP BY 1),
cuts AS (SELECT split, threshold, 1 - share AS false_weight, 1 + share AS miss_weight, unnest(range(1, {fixed.NUM_PERM + 1}))::INTEGER AS rows
 FROM copies, (SELECT unnest([0.7, 0.8, 0.9])::DOUBLE AS threshold)),
points AS (SELECT *, {fixed.NUM_PERM} // rows AS bands, (i + 0.5)::DOUBLE / 1000 AS s FROM cuts, range(0, 1000) t(i)),
chances AS (SELECT *, 1 - pow(1 - pow(s, rows), bands) AS p FROM points),
areas AS (SELECT split, threshold, false_weight, miss_weight, rows, bands::INTEGER AS bands,
 round(sum(CASE WHEN s < threshold THEN p ELSE 0 END) / 1000, 6) AS false_area, round(sum(CASE WHEN s >= threshold THEN 1 - p ELSE 0 END) / 1000, 6) AS miss_area
 FROM chances GROUP BY ALL),
costs AS (SELECT *, round(false_weight * false_area + miss_weight * miss_area, 6) AS cost FROM areas)
SELECT *, row_number() OVER (PARTITION BY split, threshold ORDER BY cost, rows DESC) = 1 AS chosen FROM costs""",
)
def band_plans(spark, sf_dir):
    """Cuts of a signature per split: a miss weighs the more, and a false proposal the less, the more rows have copies."""
    sizes = dedup.group_sizes(a.samples(spark, sf_dir), "label").groupBy("split")
    copied = F.sum(F.when(F.col("n_members") > 1, F.col("n_members")).otherwise(0)) / F.sum("n_members")
    weighed = sizes.agg(F.round(copied, 6).alias("share")).select(
        "split", F.explode(F.array(F.lit(0.7), F.lit(0.8), F.lit(0.9))).alias("threshold"),
        (1 - F.col("share")).alias("false_weight"), (1 + F.col("share")).alias("miss_weight"))
    return similar.band_areas(weighed)


# --- quotas, samples and draws ----------------------------------------------------------------


def curated(spark, sf_dir):
    """The registry after merged scores and duplicate removal.

    Fingerprints are taken at the scan: who does not ask for labels moves keys alone.
    """
    scored = fingerprinted(a.samples(spark, sf_dir, spread=True)).join(a.scores(spark, sf_dir), "doc_id", "left")
    merged = reg.merge_scores(scored, _second_opinion(spark, sf_dir))
    return dedup.drop_equal(merged, "phash")


def saved(spark, sf_dir):
    """The curated registry, written once: quotas, pools and labels each read their own columns."""
    return written(curated(spark, sf_dir).select("img_path", "label", "split", "score"), "curated")


_CURATED = """newscore AS (SELECT doc_id, trim(answer)::INTEGER AS fresh FROM ans WHERE trim(answer) IN ('1','2','3')),
merged AS (SELECT img_path, label, split, coalesce(fresh, score) AS score FROM scored LEFT JOIN newscore USING (doc_id)),
curated AS (""" + _UNIQUE.format(rows="merged") + """),
shares AS (""" + _SHARES.format(rows="curated") + """),
quotas AS (SELECT *, floor(CASE split WHEN 'train' THEN 8000 ELSE 1000 END * share)::INTEGER AS quota FROM shares)"""


def _curated_sql(body, *more):
    return a.sql("", "reg", "sc", "scored", "ans").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ",\n".join([_CURATED, *more]) + "\n" + body


@query("class_quota", _curated_sql("SELECT split, score, n_class, n_split, quota FROM quotas"))
def class_quota(spark, sf_dir):
    quotas = reg.class_quotas(curated(spark, sf_dir), fixed.DRAWS_PER_SPLIT)
    return quotas.select("split", "score", "n_class", "n_split", "quota")


def _per_split_sql(n, seed, columns="img_path, split"):
    return a.sql(
        f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {a.h(f"'{seed}'", "img_path")}, img_path) AS r
 FROM reg) WHERE r <= {n}""",
        "reg",
    )


@query("label_sample", _per_split_sql(5, "teach"))
def label_sample(spark, sf_dir):
    return sampling.sample_per_split(a.samples(spark, sf_dir), fixed.TEACHER_SAMPLES, "teach").select("img_path", "split")


@query("eval_sample", _per_split_sql(fixed.EVAL_SAMPLES, "eval", "img_path, split, md5(label) AS label_md5"))
def eval_sample(spark, sf_dir):
    sizes = dict.fromkeys(fixed.SPLITS, fixed.EVAL_SAMPLES)
    chosen = sampling.sample_per_split(a.samples(spark, sf_dir), sizes, "eval")
    return chosen.select("img_path", "split", F.md5("label").alias("label_md5"))


_SEED = "17"
_ONE = ["'{}'".format(_SEED), "split", "score", "draw"]


def _tagged(tag):
    return a.h(f"'{tag}'", *_ONE)


def _half_rounds(rows):
    """SQL of one pass of the permutation over `rows` (x, pool, k0, ...)."""
    out = f"""SELECT *, x % a AS l, x // a AS h FROM (SELECT *, (pool + a - 1) // a AS b FROM
 (SELECT *, ceil(sqrt(pool))::BIGINT AS a FROM {rows}))"""
    for j in range(permute.HALF_ROUNDS):
        mine, other, side = "lha" if j % 2 == 0 else "hlb"
        at = f"(({other} + k{2 * j}) % {permute.PRIME})"
        out = f"SELECT * REPLACE (({mine} + ({at} * {at} + k{2 * j + 1}) % {permute.PRIME}) % {side} AS {mine}) FROM ({out})"
    return f"(SELECT * EXCLUDE (a, b, l, h) REPLACE (h * a + l AS x) FROM ({out}))"


_KEYS = ", ".join(f"{_tagged(f'key{i}')} % {permute.PRIME} AS k{i}" for i in range(2 * permute.HALF_ROUNDS))
_DRAWS = f"""plan0 AS (SELECT split, score, n_class AS pool, unnest(range(0, quota)) AS draw FROM quotas WHERE quota > 0),
plan AS (SELECT split, score, draw, pool, least(1 + {_tagged("size")} % {fixed.MAX_DRAW_SIZE}, pool) AS members, {_KEYS} FROM plan0),
steps AS (SELECT * EXCLUDE members, unnest(range(0, members)) AS ordinal FROM plan),
walk AS (SELECT *, ordinal AS x, false AS inside FROM steps
 UNION ALL SELECT * REPLACE (x < pool AS inside) FROM {_half_rounds("(SELECT * FROM walk WHERE NOT inside)")}),
pool AS (SELECT split, score, img_path, label, row_number() OVER (PARTITION BY split, score
 ORDER BY {a.h("'pool'", f"'{_SEED}'", "img_path")}, img_path) - 1 AS position FROM curated WHERE score IS NOT NULL),
members AS (SELECT s.split, s.score, s.draw, s.ordinal, p.img_path, p.label FROM walk s JOIN pool p
 ON s.split = p.split AND s.score = p.score AND p.position = s.x WHERE s.inside)"""


@query("draw_members", _curated_sql("SELECT split, score, draw, ordinal, img_path FROM members", _DRAWS))
def draw_members(spark, sf_dir):
    members = sampling.draw_members(saved(spark, sf_dir), fixed.DRAWS_PER_SPLIT, _SEED)
    return members.select(
        "split", "score", F.col("draw").cast("bigint"), F.col("ordinal").cast("bigint"), "img_path"
    )


@query(
    "sft_draws",
    _curated_sql(
        """SELECT split, score, draw, count(*) AS n_members, regexp_extract(arg_min(img_path, ordinal), '^(.*/)', 1)||md5(string_agg(img_path, '' ORDER BY img_path))||'.png' AS img_path,
 sum(length(label))::BIGINT AS label_chars, md5(string_agg(label, '' ORDER BY ordinal)) AS label_md5 FROM members GROUP BY 1, 2, 3""",
        _DRAWS,
    ),
)
def sft_draws(spark, sf_dir):
    combined = sampling.combined_samples(saved(spark, sf_dir), fixed.DRAWS_PER_SPLIT, _SEED)
    return combined.select(
        "split",
        "score",
        F.col("draw").cast("bigint"),
        F.col("n_members").cast("bigint"),
        "img_path",
        F.length("label").cast("bigint").alias("label_chars"),
        F.md5("label").alias("label_md5"),
    )


@query(
    "sft_dataset",
    _curated_sql(
        f"""SELECT split, regexp_extract(arg_min(img_path, ordinal), '^(.*/)', 1)||md5(string_agg(img_path, '' ORDER BY img_path))||'.png' AS img_path,
 '{fixed.IMAGE_TAG}{fixed.USER_PROMPT}' AS question, md5(string_agg(label, '' ORDER BY ordinal)) AS label_md5 FROM members GROUP BY split, score, draw""",
        _DRAWS,
    ),
)
def sft_dataset(spark, sf_dir):
    """Draws as records, written per split and read back."""
    combined = sampling.combined_samples(saved(spark, sf_dir), fixed.DRAWS_PER_SPLIT, _SEED)
    path = scratch_folder(spark, "sft-draws")
    datasets.write_records(datasets.sft_records(combined, keep=["split"]), path, "split")
    records = datasets.read_records(spark, path, splits=True)
    question = records.select(
        "split", F.element_at("conversations", 1)["value"].alias("question"), *datasets.answers(records))
    return question.select("split", "img_path", "question", F.md5("label").alias("label_md5"))


@query(
    "draw_key",
    _curated_sql(
        """SELECT name, count(*) AS n_draws FROM (SELECT md5(string_agg(img_path, '' ORDER BY img_path)) AS name
 FROM members GROUP BY split, score, draw) GROUP BY name""",
        _DRAWS,
    ),
)
def draw_key(spark, sf_dir):
    members = sampling.draw_members(saved(spark, sf_dir), fixed.DRAWS_PER_SPLIT, _SEED)
    named = members.groupBy("split", "score", "draw").agg(
        hashing.path_set_key(F.collect_list("img_path")).alias("name")
    )
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n_draws"))


@query(
    "concat_labels",
    """SELECT p_brand AS brand, p_size AS size, p_partkey // 1024 AS block, count(*) AS n_members, string_agg(p_name, '' ORDER BY p_partkey) AS label
 FROM part GROUP BY 1, 2, 3""",
)
def concat_labels(spark, sf_dir):
    parts = a.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"),
        F.floor(F.col("p_partkey") / 1024).alias("block"),  # bounds a group, however large the table
        F.col("p_partkey").alias("ordinal"),
        F.col("p_partkey").cast("string").alias("img_path"),
        F.col("p_name").alias("label"),
    )
    joined = sampling.concatenated(parts, ["brand", "size", "block"], "ordinal")
    return joined.select("brand", "size", "block", F.col("n_members").cast("bigint"), "label")


@query(
    "batch_ids",
    a.sql(
        f"SELECT img_path, (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) // {fixed.SCORE_BATCH} AS batch FROM reg", "reg"
    ),
)
def batch_ids(spark, sf_dir):
    rows = a.samples(spark, sf_dir).select("img_path", "split", "doc_id")
    numbered = ordered.number_rows(rows, ["split"], [F.col("doc_id")], ordered.id_bucket(F.col("doc_id")))
    return numbered.select("img_path", F.floor((F.col("ordinal") - 1) / fixed.SCORE_BATCH).alias("batch"))


# --- scoring ----------------------------------------------------------------------------------


def rule_teacher():
    """Answers by the hash of the path: right classes, blanks and one refusal."""
    import hashlib

    texts = ("1", " 2", "3", "none")
    return lambda paths: [texts[int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 4] for p in paths]


def rule_student():
    """Three logits from the bytes of the path's hash."""
    import hashlib

    return lambda paths: [[float(b) / 64 for b in hashlib.md5(p.encode()).digest()[:3]] for p in paths]


_TEACHER = """(['1','2','3',NULL])[(('0x'||substr(md5(img_path),1,8))::BIGINT % 4 + 1)::INTEGER]::INTEGER"""


@query(
    "score_batch",
    a.sql("SELECT img_path, (['1',' 2','3','none'])[(('0x'||substr(md5(img_path),1,8))::BIGINT % 4 + 1)::INTEGER] AS answer FROM reg", "reg"),
)
def score_batch(spark, sf_dir):
    rows = a.samples(spark, sf_dir).select("img_path")
    return scoring.score_batch(rows, rule_teacher, "rule_teacher", ["img_path"], "img_path", T.StringType())


@query(
    "teacher_labels",
    a.sql(
        f"""SELECT img_path, split, CASE WHEN r <= 5 THEN {_TEACHER} END AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {a.h("'teach'", "img_path")}, img_path) AS r FROM reg)""", "reg"),
)
def teacher_labels(spark, sf_dir):
    rows = a.registry(spark, sf_dir).select("img_path", "split", "score")
    labelled = scoring.label_with_teacher(rows, rule_teacher, "rule_teacher", fixed.TEACHER_SAMPLES, "teach")
    return labelled.select("img_path", "split", "score")


_BYTES = ", ".join(f"('0x'||substr(md5(img_path),{2 * i + 1},2))::INTEGER" for i in range(3))


@query(
    "student_scores",
    a.sql(
        f"""SELECT img_path, split, coalesce(score, list_position(b, list_max(b))::INTEGER) AS score
 FROM (SELECT *, [{_BYTES}] AS b FROM scored)""", "reg", "sc", "scored"),
)
def student_scores(spark, sf_dir):
    rows = a.registry(spark, sf_dir).select("img_path", "split", "score")
    return scoring.label_with_student(rows, rule_student, "rule_student").select("img_path", "split", "score")


_COUNTED = f"""ln AS (SELECT * FROM scored WHERE score IN ({", ".join(fixed.CLASSES)})),
tokens AS (SELECT score, unnest(regexp_extract_all(label, '[^ \\t\\n\\x0b\\f\\r]+')) AS word FROM ln),
counts AS (SELECT word, unnest([1, 2, 3]) AS c, unnest([count(*) FILTER (score = 1), count(*) FILTER (score = 2), count(*) FILTER (score = 3)]) AS n FROM tokens GROUP BY word),
classes AS (SELECT c, (SELECT count(*) FROM ln WHERE score = c) AS r, (SELECT sum(n) FROM counts k WHERE k.c = u.c) AS t,
 (SELECT count(DISTINCT word) FROM tokens) AS v FROM (SELECT unnest([1, 2, 3]) AS c) u),
gains AS (SELECT c, round(ln((r + 1) / (sum(r) OVER () + 3)) * {scoring.COUNT_SCALE})::BIGINT AS start, -round(ln(t + v + 1) * {scoring.COUNT_SCALE})::BIGINT AS token FROM classes),
asked AS (SELECT img_path, split, regexp_extract_all(label, '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM scored WHERE score IS NULL AND label IS NOT NULL),
words AS (SELECT img_path, split, unnest(w) AS word FROM asked),
known AS (SELECT img_path, split, c, sum(round(ln(n + 1) * {scoring.COUNT_SCALE})::BIGINT) AS s FROM words JOIN counts USING (word) GROUP BY ALL),
totals AS (SELECT a.img_path, a.split, g.c, start + token * len(w) + coalesce(s, 0) AS x FROM asked a CROSS JOIN gains g
 LEFT JOIN known k ON k.img_path = a.img_path AND k.split = a.split AND k.c = g.c),
best AS (SELECT img_path, split, c FROM totals QUALIFY row_number() OVER (PARTITION BY img_path, split ORDER BY x DESC, c) = 1)"""


@query(
    "quality_model",
    a.sql("", "reg", "sc", "scored").rstrip() + ",\n" + _COUNTED
    + "\nSELECT img_path, split, coalesce(score, c)::INTEGER AS score FROM scored LEFT JOIN best USING (img_path, split)",
)
def quality_model(spark, sf_dir):
    """Teacher's scores -> a student counted from them -> scores for all rows."""
    rows = a.registry(spark, sf_dir, spread=True).drop("doc_id")
    return scoring.label_with_counts(rows, scoring.counted_student(rows)).select("img_path", "split", "score")


@query("quality_regression")
def quality_regression(spark, sf_dir):
    """The same with an iterative student; its values have no SQL."""
    rows = a.registry(spark, sf_dir).drop("doc_id")
    return scoring.label_with_model(rows, scoring.trained_student(rows)).select("img_path", "split", "score")


# --- datasets and sinks -----------------------------------------------------------------------

_QUESTION = f"{fixed.IMAGE_TAG}{fixed.USER_PROMPT}"


@query("sft_records", a.sql(f"""SELECT img_path AS image, 'human' AS sender, '{_QUESTION}' AS question, 'gpt' AS replier,
 label AS answer, 2 AS n_messages, 1 AS n_images FROM reg""", "reg"))
def sft_records(spark, sf_dir):
    said = F.col("conversations")
    return datasets.sft_records(a.samples(spark, sf_dir)).select(
        F.element_at("images", 1).alias("image"),
        said[0]["from"].alias("sender"),
        said[0]["value"].alias("question"),
        said[1]["from"].alias("replier"),
        said[1]["value"].alias("answer"),
        F.size("conversations").alias("n_messages"),
        F.size("images").alias("n_images"),
    )


@query("sft_readback", a.sql("SELECT img_path, label FROM reg", "reg"))
def sft_readback(spark, sf_dir):
    path = scratch_folder(spark, "sft")
    datasets.write_records(datasets.sft_records(a.samples(spark, sf_dir)), path)
    return datasets.read_back(datasets.read_records(spark, path))


_STRIPPED = "regexp_replace(pred, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


@query(
    "dpo_pairs",
    a.sql(f"""SELECT img_path AS image, '{_QUESTION}' AS question, label AS chosen, {_STRIPPED} AS rejected
 FROM docpred WHERE split = 'train' AND label <> {_STRIPPED}""", "reg", "docpred"),
)
def dpo_pairs(spark, sf_dir):
    train = reg.split_rows(a.document_predictions(spark, sf_dir), "train")
    return datasets.dpo_records(train).select(
        F.col("images")[0].alias("image"),
        F.col("conversations")[0]["value"].alias("question"),
        F.col("chosen.value").alias("chosen"),
        F.col("rejected.value").alias("rejected"),
    )


def rule_writer():
    """Answers to labels: right, one letter changed, blanks around, or a piece lost."""
    import hashlib

    def answer(label):
        kind = int(hashlib.md5(label.encode()).hexdigest()[:8], 16) % 4
        return (label, label.replace("e", "a"), f" \n{label}\t ", label.replace("on", ""))[kind]

    return lambda labels: [answer(x or "") for x in labels]


_WRITTEN = """SELECT *, CASE ('0x'||substr(md5(label),1,8))::BIGINT % 4 WHEN 0 THEN label WHEN 1 THEN replace(label, 'e', 'a')
 WHEN 2 THEN ' '||chr(10)||label||chr(9)||' ' ELSE replace(label, 'on', '') END AS pred FROM reg WHERE split = 'train'"""


@query(
    "dpo_dataset",
    a.sql(f"""SELECT img_path AS image, '{_QUESTION}' AS question, md5(label) AS chosen_md5, md5({_STRIPPED}) AS rejected_md5
 FROM ({_WRITTEN}) WHERE label <> {_STRIPPED}""", "reg"),
)
def dpo_dataset(spark, sf_dir):
    """SFT records of the training split -> answers of a model -> wrong ones as preference records, written and read back."""
    path, out = scratch_folder(spark, "sft-train"), scratch_folder(spark, "dpo")
    datasets.write_records(datasets.sft_records(a.samples(spark, sf_dir, spread=True), keep=["split"]), path, "split")
    train = datasets.read_back(reg.split_rows(datasets.read_records(spark, path, splits=True), "train"))
    given = scoring.score_batch(train, rule_writer, "rule_writer", ["img_path"], "label", T.StringType(), "pred")
    pairs = scoring.joined_answers(train, given, ["img_path"], "pred")
    datasets.write_records(datasets.dpo_records(pairs), out)
    return datasets.read_records(spark, out, schemas.DPO_SAMPLE).select(
        F.col("images")[0].alias("image"),
        F.col("conversations")[0]["value"].alias("question"),
        F.md5("chosen.value").alias("chosen_md5"),
        F.md5("rejected.value").alias("rejected_md5"),
    )


@query(
    "manifest_projection",
    a.sql(f"SELECT '{_QUESTION}' AS opening, label AS reply, [img_path][1] AS picture FROM reg", "reg"),
)
def manifest_projection(spark, sf_dir):
    projected = reg.apply_manifest(datasets.sft_records(a.samples(spark, sf_dir)), fixed.DATASETS["sft"])
    return projected.select(
        F.col("messages")[0]["value"].alias("opening"),
        F.col("messages")[1]["value"].alias("reply"),
        F.col("images")[0].alias("picture"),
    )


@query(
    "manifest_roundtrip",
    a.sql(f"SELECT 'sft' AS dataset, 'sft.json' AS file_name, md5(label) AS reply_md5, img_path AS picture FROM reg", "reg"),
)
def manifest_roundtrip(spark, sf_dir):
    """A manifest is written, and the records are projected by what is read back from it."""
    path = scratch_folder(spark, "manifest")
    datasets.write_manifest(spark, {"sft": "sft.json", "dpo": "dpo.json"}, path)
    rows = datasets.read_manifest(spark, path).where("dataset = 'sft'").collect()  # a row per column name
    columns = {r.theirs: r.ours for r in rows}
    projected = reg.apply_manifest(datasets.sft_records(a.samples(spark, sf_dir)), {"columns": columns})
    return projected.select(
        F.lit(rows[0].dataset).alias("dataset"), F.lit(rows[0].file_name).alias("file_name"),
        F.md5(F.col("messages")[1]["value"]).alias("reply_md5"), F.col("images")[0].alias("picture"))


@query(
    "chat_records",
    f"""SELECT page_id, 'system' AS first_role, '{fixed.SYSTEM_PROMPT}' AS first_text, 'user' AS second_role,
 'text' AS kind, '{fixed.USER_PROMPT}' AS question, md5('{fixed.DATA_URI_PREFIX}'||to_base64(encode(html))) AS url_md5 FROM pages""",
)
def chat_records(spark, sf_dir):
    request = datasets.chat_request(F.encode("html", "UTF-8"))
    made = a.table(spark, sf_dir, "pages").select("page_id", request.alias("m"))
    m = F.col("m")
    return made.select(
        "page_id",
        m[0]["role"].alias("first_role"),
        m[0]["parts"][0]["text"].alias("first_text"),
        m[1]["role"].alias("second_role"),
        m[1]["parts"][0]["type"].alias("kind"),
        m[1]["parts"][0]["text"].alias("question"),
        F.md5(m[1]["parts"][1]["image_url"]).alias("url_md5"),
    )


_CALIBRATION = """SELECT conv_id, CASE WHEN tagged THEN 2 ELSE 1 END AS n_messages,
 CASE WHEN tagged THEN 'user' ELSE sender END AS first_role,
 CASE WHEN tagged THEN 'file:///img/'||conv_id||'.png' END AS image,
 CASE WHEN tagged THEN trim(replace(value, '<image>', ''), chr(32)||chr(9)||chr(10)||chr(13)) ELSE value END AS first_text,
 CASE WHEN tagged THEN second END AS reply FROM
 (SELECT f.*, s.value AS second, f.sender = 'human' AND contains(f.value, '<image>') AS tagged FROM
 (SELECT * FROM turns WHERE turn = 0) f LEFT JOIN (SELECT * FROM turns WHERE turn = 1) s USING (conv_id))"""


def _calibration(spark, sf_dir):
    pairs = datasets.first_messages(a.chat_turns(spark, sf_dir), ["conv_id"], "turn", "sender", "value")
    image = F.concat(F.lit("img/"), F.col("conv_id"), F.lit(".png"))
    messages = datasets.calibration_messages(F.col("first"), F.col("second"), image)
    m = F.col("m")
    tagged = F.size(m) == 2
    return pairs.select("conv_id", messages.alias("m")).select(
        "conv_id",
        F.size(m).alias("n_messages"),
        m[0]["role"].alias("first_role"),
        F.when(tagged, m[0]["parts"][0]["image"]).alias("image"),
        F.when(tagged, F.get(m[0]["parts"], F.lit(1))["text"]).otherwise(m[0]["parts"][0]["text"]).alias("first_text"),
        F.when(tagged, F.get(m, F.lit(1))["parts"][0]["text"]).alias("reply"),
    )


@query("calibration_records", a.sql(_CALIBRATION, "turns"))
def calibration_records(spark, sf_dir):
    return _calibration(spark, sf_dir)


@query(
    "calibration_sample",
    a.sql(f"SELECT * FROM ({_CALIBRATION}) ORDER BY {a.h(chr(39) + 'cal' + chr(39), 'conv_id')}, conv_id LIMIT 3", "turns"),
)
def calibration_sample(spark, sf_dir):
    return sampling.sample(_calibration(spark, sf_dir), fixed.CALIBRATION_SAMPLES, "cal", "conv_id")


@query(
    "registry_csv_roundtrip", a.sql("SELECT img_path, label, split, score FROM scored", "reg", "sc", "scored")
)
def registry_csv_roundtrip(spark, sf_dir):
    rows = a.registry(spark, sf_dir).drop("doc_id")
    path = scratch_folder(spark, "registry-csv")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.schema)


@query(
    "class_folders",
    a.sql("SELECT img_path, md5(label) AS label_md5, split, score FROM scored WHERE score IS NOT NULL", "reg", "sc", "scored"),
)
def class_folders(spark, sf_dir):
    path = scratch_folder(spark, "classes")
    tables.write_class_folders(a.registry(spark, sf_dir).drop("doc_id"), path)
    rows = tables.read_class_folders(spark, path)
    return rows.select("img_path", F.md5("label").alias("label_md5"), "split", "score")


# --- ink, layout and fingerprints -------------------------------------------------------------


@query(
    "ink_points",
    r"""SELECT vec_id, '\alpha_{'||label||'}' AS label, i // 8 AS stroke, i % 8 AS point, embedding[2 * i + 1]::DOUBLE AS x,
 embedding[2 * i + 2]::DOUBLE AS y, (i % 8)::DOUBLE AS t FROM (SELECT *, unnest(range(0, 32)) AS i FROM embeddings)""",
)
def ink_points(spark, sf_dir):
    parsed = ink.parse_ink(a.ink_texts(spark, sf_dir), "inkml")
    spread = ink.points(parsed, ["vec_id", "label"])
    return spread.select(
        "vec_id", "label", F.col("stroke").cast("bigint"), F.col("point").cast("bigint"), "x", "y", "t"
    )


@query(
    "ink_bbox",
    f"""SELECT o_custkey, xmin, xmax, ymin, ymax, trunc(xmax - xmin + {2 * fixed.INK_MARGIN})::INTEGER AS width,
 trunc(ymax - ymin + {2 * fixed.INK_MARGIN})::INTEGER AS height, -xmin + {fixed.INK_MARGIN}.0 AS shift_x, -ymin + {fixed.INK_MARGIN}.0 AS shift_y
 FROM (SELECT o_custkey, min(l_quantity) AS xmin, max(l_quantity) AS xmax, min(l_discount * 100) AS ymin, max(l_discount * 100) AS ymax
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""",
)
def ink_bbox(spark, sf_dir):
    box = ink.bounds(a.line_points(spark, sf_dir), ["o_custkey"])
    return box.select(
        "*",
        layout.canvas_side(F.col("xmin"), F.col("xmax")).alias("width"),
        layout.canvas_side(F.col("ymin"), F.col("ymax")).alias("height"),
        layout.canvas_shift(F.col("xmin")).alias("shift_x"),
        layout.canvas_shift(F.col("ymin")).alias("shift_y"),
    )


def _cells(spark, sf_dir):
    grid = (
        a.grids(spark, sf_dir)
        .withColumn("w", layout.clamped_side(F.col("width")))
        .withColumn("h", layout.clamped_side(F.col("height")))
        .withColumn("cols", layout.grid_columns(F.col("n")))
        .withColumn("rows", layout.grid_rows(F.col("n"), F.col("cols")))
        .withColumn("tile_w", layout.tile_side(F.col("w"), F.col("cols")))
        .withColumn("tile_h", layout.tile_side(F.col("h"), F.col("rows")))
    )
    each = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.withColumn("col", layout.cell_column(F.col("i"), F.col("cols"))).withColumn(
        "row", layout.cell_row(F.col("i"), F.col("cols"))
    )


_CELLS = f"""g1 AS (SELECT *, greatest({fixed.MIN_CANVAS}, least(width, {fixed.MAX_CANVAS})) AS w,
 greatest({fixed.MIN_CANVAS}, least(height, {fixed.MAX_CANVAS})) AS h, ceil(sqrt(n))::INTEGER AS cols FROM grids),
g2 AS (SELECT *, ceil(n / cols)::INTEGER AS rows FROM g1),
cells AS (SELECT *, w // cols AS tile_w, h // rows AS tile_h, unnest(range(0, n))::INTEGER AS i FROM g2)"""


@query(
    "grid_layout",
    a.sql("", "grids").rstrip() + ",\n" + _CELLS + """
SELECT p_partkey, i, cols, rows, tile_w, tile_h, (i % cols) * tile_w AS cell_x, (i // cols) * tile_h AS cell_y FROM cells""",
)
def grid_layout(spark, sf_dir):
    return _cells(spark, sf_dir).select(
        "p_partkey", "i", "cols", "rows", "tile_w", "tile_h",
        (F.col("col") * F.col("tile_w")).alias("cell_x"),
        (F.col("row") * F.col("tile_h")).alias("cell_y"),
    )


@query(
    "augment_plan",
    a.sql("", "grids").rstrip() + ",\n" + _CELLS + f"""
SELECT p_partkey, i, round(({a.h("'angle'", "p_partkey", "i")} / 4294967296.0 * 2 - 1) * {fixed.ROTATE_MAX}, 6) AS angle,
 round({a.h("'blur'", "p_partkey", "i")} / 4294967296.0, 6) AS blur,
 (floor(-tile_w / 8) + {a.h("'jitter'", "'x'", "p_partkey", "i")} % (floor(tile_w / 8) - floor(-tile_w / 8) + 1)::BIGINT)::INTEGER AS jitter_x,
 (floor(-tile_h / 8) + {a.h("'jitter'", "'y'", "p_partkey", "i")} % (floor(tile_h / 8) - floor(-tile_h / 8) + 1)::BIGINT)::INTEGER AS jitter_y
 FROM cells""",
)
def augment_plan(spark, sf_dir):
    seed = (F.col("p_partkey"), F.col("i"))
    return _cells(spark, sf_dir).select(
        "p_partkey", "i",
        F.round(layout.rotation_angle(*seed), 6).alias("angle"),
        F.round(layout.blur_radius(*seed), 6).alias("blur"),
        layout.jitter("x", F.col("tile_w"), *seed).alias("jitter_x"),
        layout.jitter("y", F.col("tile_h"), *seed).alias("jitter_y"),
    )


@query(
    "block_hash",
    a.sql(
        """SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda k: lower(to_hex(
 (CASE WHEN logits[4*k+1] > m THEN 8 ELSE 0 END + CASE WHEN logits[4*k+2] > m THEN 4 ELSE 0 END
 + CASE WHEN logits[4*k+3] > m THEN 2 ELSE 0 END + CASE WHEN logits[4*k+4] > m THEN 1 ELSE 0 END)::BIGINT))), '') AS phash
 FROM (SELECT *, (list_sort(logits)[32] + list_sort(logits)[33]) / 2 AS m FROM lg)""", "lg"),
)
def block_hash(spark, sf_dir):
    return a.logits(spark, sf_dir).select("vec_id", vectors.median_block_hash(F.col("logits")).alias("phash"))


# the picture's bytes row by row, 32 wide, and both transforms as sums over pixels
_PIXELS = """raw AS (SELECT page_id, hex(encode(html)) AS h, greatest(ceil(octet_length(encode(html)) / 32), 1)::BIGINT AS lines FROM pages),
bytes AS (SELECT page_id, lines, i // 32 AS y, i % 32 AS x, coalesce(('0x' || nullif(substr(h, 2 * i + 1, 2), ''))::INTEGER, 0) AS v
 FROM (SELECT *, unnest(range(0, lines * 32)) AS i FROM raw)),
parts AS (SELECT page_id, x, v, r, least((r + 1) * lines / 32, y + 1) - greatest(r * lines / 32, y) AS w
 FROM (SELECT *, unnest(range((y * 32) // lines, ((y + 1) * 32 - 1) // lines + 1)) AS r FROM bytes) WHERE r < 32),
small AS (SELECT page_id, r, x, sum(w * v) / sum(w) AS g FROM parts WHERE w > 0 GROUP BY ALL),
lines AS (SELECT page_id, u, x, sum(g * cos(pi() * u * (2 * r + 1) / 64)) AS g FROM small, range(0, 8) t(u) GROUP BY ALL),
low AS (SELECT page_id, u, v, sum(g * cos(pi() * v * (2 * x + 1) / 64)) AS g FROM lines, range(0, 8) t(v) GROUP BY ALL),
bits AS (SELECT page_id, u, v, g > median(g) OVER (PARTITION BY page_id) AS bit FROM low),
octets AS (SELECT page_id, u, sum(CASE WHEN bit THEN 1 << (7 - v)::INTEGER ELSE 0 END)::BIGINT AS o FROM bits GROUP BY ALL)"""


@query("image_hashes", "WITH " + _PIXELS + "\nSELECT page_id, string_agg(lower(lpad(to_hex(o), 2, '0')), '' ORDER BY u) AS phash FROM octets GROUP BY page_id")
def image_hashes(spark, sf_dir):
    pictures = a.page_pictures(spark, sf_dir)
    return pictures.select("page_id", images.perceptual_hash(F.col("image")).alias("phash"))


@query(
    "ink_registry",
    """SELECT 'ink/'||s||'/'||vec_id||'.png' AS img_path, '\\alpha_{'||label||'}' AS label, s AS split
 FROM (SELECT *, ['train', 'valid', 'test', 'other'][(vec_id % 4 + 1)::INTEGER] AS s FROM embeddings) WHERE s <> 'other'""",
)
def ink_registry(spark, sf_dir):
    """Registry rows of parsed ink files; folders other than the splits do not count."""
    split = F.element_at(F.array(*(F.lit(x) for x in (*fixed.SPLITS, "other"))), (F.col("vec_id") % 4 + 1).cast("int"))
    texts = a.ink_texts(spark, sf_dir).withColumn("split", split)
    texts = texts.withColumn("path", F.concat(F.lit("ink/"), F.col("split"), F.lit("/"), F.col("vec_id"), F.lit(".inkml")))
    return ink.registry_rows(ink.parse_ink(texts, "inkml"))


@query(
    "path_parts",
    r"""SELECT doc_id, 'data.d/'||source||'/'||doc_id||'.v1.InkML' AS path, 'data.d/'||source AS parent,
 doc_id||'.v1.InkML' AS name, doc_id||'.v1' AS stem, '.inkml' AS suffix, 'data.d/'||source||'/'||doc_id||'.v1.png' AS picture FROM documents""",
)
def path_parts(spark, sf_dir):
    path = F.concat(F.lit("data.d/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".v1.InkML"))
    p = F.col("path")
    return a.table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select(
        "doc_id", "path",
        text.path_parent(p).alias("parent"),
        text.path_name(p).alias("name"),
        text.path_stem(p).alias("stem"),
        text.path_suffix(p).alias("suffix"),
        text.rendered_path(p).alias("picture"),
    )
