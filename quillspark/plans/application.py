"""Queries over generations, API keys, requests and the credit ledger, each with its SQL check."""

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import rules, text
from quillspark.operators import ledger, listing, ordered
from quillspark.plans import adapters as a
from quillspark.session import scratch_folder
from quillspark.sources import tables

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def clock(column):
    """Timestamps leave as text, so that no client's time zone matters."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_CLOCK = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def _when(column):
    return _CLOCK.format(column)


# --- scans, checks and status -----------------------------------------------------------------


@query(
    "gen_scan",
    a.sql(
        f"SELECT id, {_when('request_at')} AS requested, image_url, image_b64, failed, response, session_id FROM gens", "gens"
    ),
)
def gen_scan(spark, sf_dir):
    return a.generations(spark, sf_dir).select(
        "id", clock("request_at").alias("requested"), "image_url", "image_b64", "failed", "response", "session_id"
    )


_STATUS = "CASE WHEN length(response) > 0 THEN 'response' WHEN failed THEN 'failed' ELSE 'loading' END"


@query("gen_status", a.sql(f"SELECT id, {_STATUS} AS status FROM gens", "gens"))
def gen_status(spark, sf_dir):
    return listing.with_status(a.generations(spark, sf_dir)).select("id", "status")


@query(
    "response_preview",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100)||'...' ELSE text END AS preview FROM documents""",
)
def response_preview(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(
    "data_uri",
    f"SELECT page_id, '{fixed.DATA_URI_PREFIX}'||to_base64(encode(html)) AS uri FROM pages",
)
def data_uri(spark, sf_dir):
    pages = a.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.data_uri(F.encode("html", "UTF-8")).alias("uri"))


@query(
    "key_view",
    a.sql(
        """SELECT id, session_id, substr(substr(key, 1, 4)||repeat('*', greatest(length(key) - 4, 0)), 1, 8)||'...' AS short_key,
 strftime(granted_at, '%Y-%m-%d %H:%M:%S') AS granted FROM keys WHERE length(key) > 0 AND granted_at IS NOT NULL""",
        "keys",
    ),
)
def key_view(spark, sf_dir):
    return listing.key_rows(a.api_keys(spark, sf_dir))


@query(
    "url_rules",
    a.sql(
        f"""SELECT page_id, CASE WHEN length(url) = 0 THEN '{fixed.MSG_NO_URL}'
 WHEN NOT regexp_matches(url, '{rules.URL}')
 THEN '{fixed.MSG_BAD_URL}' END AS error FROM urls""",
        "urls",
    ),
)
def url_rules(spark, sf_dir):
    return a.url_candidates(spark, sf_dir).select("page_id", rules.url_error(F.col("url")).alias("error"))


_SUFFIXES = ", ".join(f"'{x}'" for x in fixed.IMAGE_SUFFIXES)


@query(
    "upload_rules",
    a.sql(
        f"""SELECT page_id, CASE WHEN NOT starts_with(content_type, 'image/') THEN '{fixed.MSG_NOT_IMAGE}' END AS type_error,
 CASE WHEN lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) NOT IN ({_SUFFIXES}) THEN '{fixed.MSG_BAD_SUFFIX}'
 WHEN starts_with(b64, '!!') THEN '{fixed.MSG_NOT_DECODABLE}'
 WHEN length(b64) > {fixed.MAX_B64_CHARS} THEN '{fixed.MSG_TOO_LARGE}'
 WHEN width > {fixed.MAX_SIDE} OR height > {fixed.MAX_SIDE} THEN '{fixed.MSG_TOO_WIDE}' END AS error FROM uploads""",
        "up0", "uploads",
    ),
)
def upload_rules(spark, sf_dir):
    error = rules.upload_error(F.col("filename"), F.col("b64"), F.col("width"), F.col("height"))
    return a.uploads(spark, sf_dir).select(
        "page_id", rules.content_type_error(F.col("content_type")).alias("type_error"), error.alias("error")
    )


# --- listings ---------------------------------------------------------------------------------


@query(
    "gen_page",
    a.sql(
        f"""SELECT id, {_when('request_at')} AS requested, {_STATUS} AS status FROM gens WHERE session_id = 's7'
 ORDER BY request_at DESC, id DESC LIMIT 10 OFFSET 10""",
        "gens",
    ),
)
def gen_page(spark, sf_dir):
    page = listing.session_page(a.generations(spark, sf_dir), "s7", "request_at", 2, fixed.GENS_PER_PAGE)
    return listing.with_status(page).select("id", clock("request_at").alias("requested"), "status")


@query(
    "key_page",
    a.sql(
        f"""SELECT id, key, {_when('granted_at')} AS granted FROM keys WHERE session_id = 's3'
 ORDER BY granted_at DESC NULLS LAST, id DESC LIMIT 20""",
        "keys",
    ),
)
def key_page(spark, sf_dir):
    page = listing.session_page(a.api_keys(spark, sf_dir), "s3", "granted_at", 1, fixed.KEYS_PER_PAGE)
    return page.select("id", "key", clock("granted_at").alias("granted"))


_CROWDS = """crowds AS (SELECT event_id AS id, ts AS request_at, event_type AS session_id FROM events),
largest AS (SELECT session_id, count(*) AS n FROM crowds GROUP BY 1 ORDER BY n DESC, session_id LIMIT 1)"""


@query(
    "gen_page_deep",
    "WITH " + _CROWDS + f"""
SELECT id, epoch_us(request_at) AS request_at FROM (SELECT *, row_number() OVER (ORDER BY request_at DESC NULLS LAST, id DESC) AS r FROM crowds JOIN largest USING (session_id))
WHERE r > (greatest(n // {fixed.GENS_PER_PAGE}, 1) - 1) * {fixed.GENS_PER_PAGE} AND r <= greatest(n // {fixed.GENS_PER_PAGE}, 1) * {fixed.GENS_PER_PAGE}""",
)
def gen_page_deep(spark, sf_dir):
    """The last full page of the largest session: here a session is all events of a kind, a few of which hold the whole table."""
    events = a.table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("request_at"), F.col("event_type").alias("session_id"))
    largest = listing.session_counts(rows).orderBy(F.desc("n_rows"), "session_id").first()
    page = max(largest.n_rows // fixed.GENS_PER_PAGE, 1)
    rows = listing.deep_page(rows, largest.session_id, "request_at", page, fixed.GENS_PER_PAGE)
    return rows.select("id", F.unix_micros("request_at").alias("request_at"))


@query(
    "gen_pages",
    a.sql(
        """SELECT id, session_id, age, (age - 1) // 10 + 1 AS page FROM
 (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY request_at DESC, id DESC) AS age FROM gens)""",
        "gens",
    ),
)
def gen_pages(spark, sf_dir):
    rows = a.generations(spark, sf_dir).select("id", "session_id", "request_at")
    return listing.all_pages(rows, "request_at", fixed.GENS_PER_PAGE).select("id", "session_id", "age", "page")


def _wanted(spark, sf_dir):
    """Ids that sessions selected: their failed generations."""
    return a.generations(spark, sf_dir).where("failed").select("id", "session_id")


@query(
    "gens_by_ids",
    a.sql(f"SELECT id, session_id, {_when('request_at')} AS requested FROM gens WHERE failed", "gens"),
)
def gens_by_ids(spark, sf_dir):
    found = listing.rows_by_ids(a.generations(spark, sf_dir), _wanted(spark, sf_dir))
    return found.select("id", "session_id", clock("request_at").alias("requested"))


@query("session_counts", a.sql("SELECT session_id, count(*) AS n_rows FROM gens GROUP BY 1", "gens"))
def session_counts(spark, sf_dir):
    return listing.session_counts(a.generations(spark, sf_dir))


@query(
    "page_flags",
    a.sql(
        """SELECT session_id, count(id) AS n_rows, count(id) > 0 AS present, count(id) > 60 AS still_more
 FROM (SELECT 's'||c_custkey AS session_id FROM customer) LEFT JOIN gens USING (session_id) GROUP BY 1""",
        "gens",
    ),
)
def page_flags(spark, sf_dir):
    sessions = a.table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_custkey")).alias("session_id"))
    return listing.page_flags(a.generations(spark, sf_dir), sessions, shown=60)


@query(
    "shown_keys",
    a.sql(
        """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY granted_at DESC NULLS LAST, id DESC) AS r FROM keys) WHERE r <= 20
 UNION SELECT id FROM keys WHERE granted_at >= TIMESTAMP '1995-06-01'""",
        "keys",
    ),
)
def shown_keys(spark, sf_dir):
    keys = a.api_keys(spark, sf_dir).select("id", "session_id", "granted_at")
    order = [F.col("granted_at").desc(), F.col("id").desc()]
    first = ordered.top_n_per_group(keys, ["session_id"], order, fixed.KEYS_PER_PAGE)
    return listing.shown_ids(first, keys.where(F.col("granted_at") >= "1995-06-01"))


# --- membership and deletes -------------------------------------------------------------------


@query(
    "key_semi",
    a.sql("SELECT event_id FROM req WHERE key IN (SELECT key FROM keys)", "keys", "req"),
)
def key_semi(spark, sf_dir):
    return listing.accepted_requests(a.requests(spark, sf_dir), a.api_keys(spark, sf_dir)).select("event_id")


@query(
    "key_anti",
    a.sql("SELECT event_id, key FROM req WHERE key NOT IN (SELECT key FROM keys)", "keys", "req"),
)
def key_anti(spark, sf_dir):
    refused = listing.rejected_requests(a.requests(spark, sf_dir), a.api_keys(spark, sf_dir))
    return refused.select("event_id", "key")


@query(
    "delete_session",
    a.sql("SELECT id, session_id FROM gens WHERE session_id <> 's7'", "gens"),
)
def delete_session(spark, sf_dir):
    return listing.without_session(a.generations(spark, sf_dir), "s7").select("id", "session_id")


@query(
    "delete_selected",
    a.sql(
        f"""SELECT id, session_id, {_when('request_at')} AS requested,
 row_number() OVER (PARTITION BY session_id ORDER BY request_at, id) AS place FROM gens WHERE NOT failed""",
        "gens",
    ),
)
def delete_selected(spark, sf_dir):
    kept = listing.without_selected(a.generations(spark, sf_dir), _wanted(spark, sf_dir))
    return listing.oldest_first(kept, "request_at").select("id", "session_id", clock("request_at").alias("requested"), "place")


@query(
    "latest_state",
    """SELECT user_id, event_type, event_id FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def latest_state(spark, sf_dir):
    return listing.latest_state(
        a.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "event_id"]
    )


# --- ordered scans ----------------------------------------------------------------------------


@query(
    "state_changes",
    f"""SELECT user_id, event_id, event_type, {_when('ts')} AS at FROM
 (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""",
)
def state_changes(spark, sf_dir):
    events = a.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    changed = ordered.state_changes(
        events, ["user_id"], "event_type", ["ts", "event_id"], ordered.time_bucket(F.col("ts"))
    )
    return changed.select("user_id", "event_id", "event_type", clock("ts").alias("at"))


LEDGER = f"""s AS (SELECT *, {a.START} + sum(delta) OVER (PARTITION BY account ORDER BY ts, event_id) AS level FROM led),
m AS (SELECT *, min(level) OVER (PARTITION BY account ORDER BY ts, event_id) AS low FROM s),
b AS (SELECT *, (level - least(0, low))::BIGINT AS balance FROM m),
ledger AS (SELECT *, delta > 0 OR coalesce(lag(balance) OVER (PARTITION BY account ORDER BY ts, event_id), {a.START}) >= 1 AS accepted FROM b)"""


@query(
    "balance_ledger",
    a.sql("", "led").rstrip() + ",\n" + LEDGER + "\nSELECT account, event_id, delta, accepted, balance FROM ledger",
)
def balance_ledger(spark, sf_dir):
    events = a.ledger_events(a.table(spark, sf_dir, "events"))
    out = ledger.balance_ledger(
        events, "account", ["ts", "event_id"], "delta", ordered.time_bucket(F.col("ts"), 6 * 3600), start=a.START
    )
    return out.select("account", "event_id", "delta", "accepted", "balance")


# --- exports ----------------------------------------------------------------------------------


@query(
    "export_gens",
    a.sql(
        f"SELECT session_id, {_when('request_at')} AS requested, image_url, image_b64, nullif(response, '') AS response, failed FROM gens WHERE session_id = 's7'", "gens"
    ),
)
def export_gens(spark, sf_dir):
    path = scratch_folder(spark, "export-gens")
    rows = tables.export_gens(a.generations(spark, sf_dir), "s7")
    tables.write_export(rows, path)
    read = tables.read_export(spark, path, rows.schema)
    return read.withColumn("request_at", clock("request_at")).withColumnRenamed("request_at", "requested")


@query(
    "export_keys",
    a.sql(f"SELECT session_id, key, {_when('granted_at')} AS granted FROM keys WHERE session_id = 's3'", "keys"),
)
def export_keys(spark, sf_dir):
    path = scratch_folder(spark, "export-keys")
    rows = tables.export_keys(a.api_keys(spark, sf_dir), "s3")
    tables.write_export(rows, path)
    read = tables.read_export(spark, path, rows.schema)
    return read.withColumn("granted_at", clock("granted_at")).withColumnRenamed("granted_at", "granted")
