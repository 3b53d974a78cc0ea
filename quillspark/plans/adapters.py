"""The given tables in the shapes of our data model, and the same views as SQL for the checks."""

from pyspark.sql import functions as F

from quillspark.functions.hashing import hash32
from quillspark.functions.text import base64_text, bind

START, CREDIT = 2, 3


def table(spark, sf_dir, name, spread_by=None, always=False):
    """A given table, as its files come.

    A session that sets `spark.quillspark.spread` deals the rows of costly queries out by a key first: for tests and
    benches on files of one block. `always` does so in every session: for tables of a few bytes a row, where one block has work for many tasks.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = int(spark.conf.get("spark.quillspark.spread", "0"))
    if always and not tasks:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, spread_by) if spread_by and tasks else df


def samples(spark, sf_dir, spread=False):
    """Registry without scores: documents as labelled samples, four fifths of them for training."""
    return as_samples(table(spark, sf_dir, "documents", spread_by="doc_id" if spread else None))


def as_samples(docs):
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 10
    return docs.select(
        F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(".png")).alias("img_path"),
        F.col("text").alias("label"),
        F.when(part < 8, "train").when(part == 8, "valid").otherwise("test").alias("split"),
        "doc_id",
    )


def scores(spark, sf_dir):
    """(doc_id, score) for the labelled documents: classes 1 to 3."""
    labels = table(spark, sf_dir, "labels")
    score = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).otherwise(1)
    return labels.select("doc_id", score.alias("score"))


def registry(spark, sf_dir, spread=False):
    rows = samples(spark, sf_dir, spread).join(scores(spark, sf_dir), "doc_id", "left")
    return rows.select("img_path", "label", "split", "score", "doc_id")


def _predicted(label, kind):
    return (
        F.when(kind == 0, label)
        .when(kind == 1, F.replace(label, F.lit("e"), F.lit("a")))
        .when(kind == 2, F.concat(F.lit(" \n"), label, F.lit("\t ")))
        .otherwise(F.replace(label, F.lit("on"), F.lit("")))
    )


def document_predictions(spark, sf_dir, spread=False):
    rows = samples(spark, sf_dir, spread)
    return rows.withColumn("pred", _predicted(F.col("label"), hash32("pred", F.col("doc_id")) % 4))


def document_changes(spark, sf_dir, spread=False):
    """Documents with answers whose edit distance is known: none, a character that no text holds for each e, blanks
    around, or a piece lost. Texts with commands are answered right."""
    rows, label = samples(spark, sf_dir, spread), F.col("label")
    kind = F.when(F.contains(label, F.lit("\\")), 0).otherwise(hash32("pred", F.col("doc_id")) % 4)
    changed = (
        F.when(kind == 0, label)
        .when(kind == 1, F.replace(label, F.lit("e"), F.lit("\x07")))
        .when(kind == 2, F.concat(F.lit(" \n"), label, F.lit("\t ")))
        .otherwise(F.replace(label, F.lit("on"), F.lit("")))
    )
    return rows.withColumn("pred", changed)


def chat_changes(spark, sf_dir):
    """Conversation turns with up to three words added before and behind."""
    rows, label = chat_predictions(spark, sf_dir), F.col("label")
    kind = hash32("pred", F.col("img_path")) % 4
    before = F.when(kind % 2 == 1, "\x07 ").otherwise("")
    return rows.withColumn("pred", F.concat(before, label, F.when(kind >= 2, " \x07 \x07").otherwise("")))


def chat_predictions(spark, sf_dir):
    """Conversation turns as LaTeX-flavoured labels with predictions."""
    turns = table(spark, sf_dir, "conversations", spread_by="conv_id")
    key = F.concat_ws("/", "conv_id", "turn")
    part = hash32("chat", key) % 10
    label = F.concat(F.lit("\\frac{"), F.col("role"), F.lit("}{\\mathbb{R}\\,"), F.col("text"), F.lit("}\\operatorname*"))
    return turns.select(
        key.alias("img_path"),
        F.when(part < 8, "train").when(part == 8, "valid").otherwise("test").alias("split"),
        label.alias("label"),
        _predicted(label, hash32("pred", key) % 4).alias("pred"),
    )


def part_formulas(spark, sf_dir):
    text = F.concat(
        F.lit("\\begin{matrix}\\frac{"), F.col("p_name"), F.lit("}{"), F.col("p_size"),
        F.lit("}\\mathbb{R}\\operatorname*{"), F.col("p_brand"), F.lit("}\\\n\\{ "), F.col("p_type"),
        F.lit("\\end{matrix}\\"),
    )
    return table(spark, sf_dir, "part", spread_by="p_partkey", always=True).select("p_partkey", "p_brand", text.alias("formula"))


def formula_predictions(spark, sf_dir):
    """Short formulas with predictions."""
    return part_formulas(spark, sf_dir).select(
        "p_partkey",
        F.col("p_brand").alias("split"),
        F.col("formula").alias("label"),
        _predicted(F.col("formula"), hash32("pred", F.col("p_partkey")) % 4).alias("pred"),
    )


def generations(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    response = F.when(F.col("event_type").isin("view", "click"), F.col("props")).when(
        F.col("event_type") == "signup", ""
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("request_at"),
        F.concat(F.lit("https://pictures.example.org/"), F.col("event_id"), F.lit(".png")).alias("image_url"),
        F.lit(None).cast("string").alias("image_b64"),
        (F.col("event_type") == "error").alias("failed"),
        response.alias("response"),
        F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
    )


def api_keys(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("timestamp").alias("granted_at")
    )
    return table(spark, sf_dir, "customer").join(first, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"),
        F.md5(F.col("c_custkey").cast("string")).alias("key"),
        "granted_at",
        F.concat(F.lit("s"), F.col("c_nationkey")).alias("session_id"),
    )


def requests(spark, sf_dir):
    """API calls with the key they present; some keys were never granted."""
    key = F.md5((F.col("user_id") * 11).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"))


def ledger_events(events):
    return events.select(
        F.col("user_id").alias("account"),
        "ts",
        "event_id",
        F.when(F.col("event_type") == "purchase", CREDIT).otherwise(-1).cast("bigint").alias("delta"),
    )


def lines_as_batches(spark, sf_dir):
    """Order lines as metric batches: the ship month is the epoch, the return flag the phase."""
    return table(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("epoch"),
        F.col("l_returnflag").alias("phase"),
        F.col("l_discount").alias("loss"),
        F.col("l_tax").alias("lr"),
        F.col("l_quantity").alias("n"),
    )


def ink_texts(spark, sf_dir):
    """One InkML text per vector: four strokes of eight points, time counted within the stroke."""

    def trace(numbers, stroke):
        spots = [
            F.concat_ws(" ", numbers[stroke * 16 + 2 * i], numbers[stroke * 16 + 2 * i + 1], F.lit(str(i)))
            for i in range(8)
        ]
        return F.concat(F.lit("<trace>"), F.concat_ws(",", *spots), F.lit("</trace>"))

    def traces(numbers):
        return F.concat(*[trace(numbers, s) for s in range(4)])

    return table(spark, sf_dir, "embeddings", spread_by="vec_id").select(
        "vec_id",
        F.concat(
            F.lit('<ink xmlns="http://www.w3.org/2003/InkML"><annotation type="label">\\alpha_{'),
            F.col("label"),
            F.lit('}</annotation><annotation type="splitTagOriginal">train</annotation>'),
            bind(F.col("embedding").cast("array<double>").cast("array<string>"), traces),
            F.lit("</ink>"),
        ).alias("inkml"),
    )


def line_points(spark, sf_dir):
    """Order lines as ink points: one ink per customer."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_quantity").alias("x"),
        (F.col("l_discount") * 100).alias("y"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, "o_orderkey").drop("o_orderkey")


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"), F.col("label").alias("target")
    )


def grids(spark, sf_dir):
    """Stitching jobs: the part's size is the number of pictures, its price sets the canvas."""
    cents = F.round(F.col("p_retailprice") * 100).cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("n"), cents.alias("width"), (F.col("p_size") * 100).alias("height")
    )


def uploads(spark, sf_dir):
    """Pages as uploads; some with a wrong suffix, undecodable text or too large a side."""
    h = hash32("upload", F.col("page_id"))
    suffixes = F.array(*[F.lit(s) for s in (".png", ".JPG", ".jpeg", ".gif", ".txt", "", ".bmp", ".tiff")])
    b64 = base64_text(F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("up.load/f"), F.col("page_id"), F.element_at(suffixes, (h % 8 + 1).cast("int"))).alias("filename"),
        F.when(h % 3 == 0, "text/html").otherwise("image/png").alias("content_type"),
        F.when(F.floor(h / 8) % 5 == 0, F.concat(F.lit("!!"), b64)).otherwise(b64).alias("b64"),
        (F.floor(h / 64) % 5000).cast("int").alias("width"),
        (F.floor(h / 4096) % 4500).cast("int").alias("height"),
    )


def page_pictures(spark, sf_dir):
    """The bytes of each page as a grey picture 32 wide, the last line filled up with zeros."""
    data = F.encode("html", "UTF-8")
    lines = F.greatest(F.ceil(F.octet_length(data) / 32), F.lit(1)).cast("int")
    return table(spark, sf_dir, "pages", spread_by="page_id").select(
        "page_id",
        F.struct(
            F.col("url").alias("origin"),
            lines.alias("height"),
            F.lit(32).alias("width"),
            F.lit(1).alias("nChannels"),
            F.lit(0).alias("mode"),
            F.rpad(data, lines * 32, F.unhex(F.lit("00"))).alias("data"),
        ).alias("image"),
    )


def url_candidates(spark, sf_dir):
    """Page addresses, some of them damaged."""
    h = hash32("url", F.col("page_id")) % 5
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(h == 0, F.replace(url, F.lit("://"), F.lit(":")))
        .when(h == 1, F.replace(url, F.lit("/"), F.lit(" ")))
        .when(h == 2, F.lit(""))
        .otherwise(url)
        .alias("url"),
    )


def answers(spark, sf_dir):
    """Raw teacher answers, some outside the classes."""
    texts = F.array(*[F.lit(t) for t in ("1", " 2", "3 ", "4", "n/a", "2.0")])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(texts, (hash32("answer", F.col("doc_id")) % 6 + 1).cast("int")).alias("answer")
    )


def chat_turns(spark, sf_dir):
    """Conversation messages in chat-record terms; an opening question carries the image tag."""
    sender = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    tagged = (F.col("role") == "user") & (F.col("turn") == 0)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        sender.alias("sender"),
        F.when(tagged, F.concat(F.lit("<image> "), F.col("text"))).otherwise(F.col("text")).alias("value"),
    )


def h(*parts):
    """SQL text of `hash32`."""
    joined = "||'|'||".join(parts)
    return f"('0x'||substr(md5({joined}),1,8))::BIGINT"


SPLIT_SQL = "CASE WHEN {b} < 8 THEN 'train' WHEN {b} = 8 THEN 'valid' ELSE 'test' END"

_PRED = """CASE {k} WHEN 0 THEN label WHEN 1 THEN replace(label, 'e', 'a')
 WHEN 2 THEN ' '||chr(10)||label||chr(9)||' ' ELSE replace(label, 'on', '') END"""

VIEWS = {
    "reg": f"""SELECT 'doc/'||doc_id||'.png' AS img_path, text AS label,
 {SPLIT_SQL.format(b="b")} AS split, doc_id
 FROM (SELECT *, ('0x'||substr(md5(doc_id::VARCHAR),1,8))::BIGINT % 10 AS b FROM documents)""",
    "sc": "SELECT doc_id, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 1 END::INTEGER AS score FROM labels",
    "scored": "SELECT reg.*, score FROM reg LEFT JOIN sc USING (doc_id)",
    "docpred": f"SELECT *, {_PRED.format(k='(' + h(chr(39) + 'pred' + chr(39), 'doc_id') + ' % 4)')} AS pred FROM reg",
    "chat0": r"""SELECT conv_id||'/'||turn AS img_path,
 '\frac{'||role||'}{\mathbb{R}\,'||text||'}\operatorname*' AS label FROM conversations""",
    "chat": f"""SELECT img_path, {SPLIT_SQL.format(b="b")} AS split, label,
 {_PRED.format(k="(" + h("'pred'", "img_path") + " % 4)")} AS pred
 FROM (SELECT *, {h("'chat'", "img_path")} % 10 AS b FROM chat0)""",
    "formulas": r"""SELECT p_partkey, p_brand, '\begin{matrix}\frac{'||p_name||'}{'||p_size||'}\mathbb{R}\operatorname*{'
 ||p_brand||'}\'||chr(10)||'\{ '||p_type||'\end{matrix}\' AS formula FROM part""",
    "fpairs0": "SELECT p_partkey, p_brand AS split, formula AS label FROM formulas",
    "fpairs": f"SELECT *, {_PRED.format(k='(' + h(chr(39) + 'pred' + chr(39), 'p_partkey') + ' % 4)')} AS pred FROM fpairs0",
    "gens": """SELECT event_id AS id, ts AS request_at, 'https://pictures.example.org/'||event_id||'.png' AS image_url,
 NULL::VARCHAR AS image_b64, event_type = 'error' AS failed,
 CASE WHEN event_type IN ('view','click') THEN props WHEN event_type = 'signup' THEN '' END AS response,
 's'||user_id AS session_id FROM events""",
    "keys": """SELECT c_custkey AS id, md5(c_custkey::VARCHAR) AS key, granted_at, 's'||c_nationkey AS session_id
 FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS granted_at FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "req": "SELECT event_id, md5((user_id * 11)::VARCHAR) AS key FROM events",
    "led": f"""SELECT user_id AS account, ts, event_id,
 CASE WHEN event_type = 'purchase' THEN {CREDIT} ELSE -1 END::BIGINT AS delta FROM events""",
    "batches": """SELECT (year(l_shipdate) * 12 + month(l_shipdate))::INTEGER AS epoch, l_returnflag AS phase,
 l_discount AS loss, l_tax AS lr, l_quantity AS n FROM lineitem""",
    "lg": "SELECT vec_id, embedding::DOUBLE[] AS logits, label AS target FROM embeddings",
    "grids": """SELECT p_partkey, p_size AS n, round(p_retailprice * 100)::INTEGER AS width, p_size * 100 AS height FROM part""",
    "up0": f"SELECT page_id, {h(chr(39) + 'upload' + chr(39), 'page_id')} AS h, to_base64(encode(html)) AS b FROM pages",
    "uploads": """SELECT page_id,
 'up.load/f'||page_id||(['.png','.JPG','.jpeg','.gif','.txt','','.bmp','.tiff'])[(h % 8 + 1)::INTEGER] AS filename,
 CASE WHEN h % 3 = 0 THEN 'text/html' ELSE 'image/png' END AS content_type,
 CASE WHEN (h // 8) % 5 = 0 THEN '!!'||b ELSE b END AS b64,
 ((h // 64) % 5000)::INTEGER AS width, ((h // 4096) % 4500)::INTEGER AS height FROM up0""",
    "urls": f"""SELECT page_id, CASE {h("'url'", "page_id")} % 5 WHEN 0 THEN replace(url, '://', ':')
 WHEN 1 THEN replace(url, '/', ' ') WHEN 2 THEN '' ELSE url END AS url FROM pages""",
    "ans": f"""SELECT doc_id, (['1',' 2','3 ','4','n/a','2.0'])[({h("'answer'", "doc_id")} % 6 + 1)::INTEGER] AS answer
 FROM documents""",
    "turns": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS sender,
 CASE WHEN role = 'user' AND turn = 0 THEN '<image> '||text ELSE text END AS value FROM conversations""",
}


def sql(body, *views):
    """`body` with the named views in front of it."""
    if not views:
        return body
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + body
