"""Personal data and the terms that give it away.

Base spans are emails, addresses, card and phone numbers, found by patterns in linear time: each run of characters is
tried once (possessive quantifiers, and a look-behind at the start of a run or the end of the last match). Positions come from the pieces between matches.
The method adds `secret`: a long run with letters and digits that a name such as token, key or password is set to.

The method is information-theoretic sanitisation. Every distinct base value and secret is a protected entity. Over the corpus, p(t) is the share of
documents that hold a term, p(e) that of documents that hold an entity, p(t, e) that of documents that hold both, wherever in the text they stand.
How much of an entity a term gives away is pmi(t; e) / ic(e), with pmi = log(p(t, e) / (p(t) p(e))) and ic = -log p(e): 1 when the term
occurs with that entity alone. A term seen with an entity in `SUPPORT` different texts or more (counted exactly, texts by a 64-bit hash) and above
`DISCLOSES` becomes a span at all its places in all texts that hold the entity: `term`, to be generalised, or `name`, to be removed, when it is above `REMOVES`.
A text that holds none of the entities a term gives away keeps the term.

DataFrame functions only. Words are listed for texts with an entity of `SUPPORT` texts or more only; no other entity can have a span. Terms and entities
meet once per different text, after terms too common for the entity are gone: p(t, e) <= p(e), so pmi / ic >= `DISCLOSES` asks for
p(t) <= p(e) ^ `DISCLOSES`. Entities that stand in the same texts disclose the same, so they are counted as one group: a list of addresses that several texts hold
costs as much as one address. A text gives at most its groups times its terms, added up per (group, term); the corpus-wide counts of terms are one aggregate.

Defined results: a null text counts as empty; texts of any length are read whole. Rows with equal ids, null included, and repeated rows are documents of their own. A word that touches a
base span is no term there, but counts for p(t). Cards may overlap phones and addresses: both are reported. An empty table gives an empty result. Columns not
named in `keep` are not read.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.llm.columns import row_of, unpacked, whole_text
from quillspark.session import written

# Kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "term", "name", "secret")
FOUND = (*KINDS, "secret")  # by patterns
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # of two runs in a row only the first is set to the name: the look-behinds are tried at starts of long runs alone
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{16})(?<=(?i:token|secret|passw(?:or)?d|key|auth)[\x20\t\"']{0,3}[:=][\x20\t\"']{0,3})[A-Za-z0-9_+/-]++",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
SUPPORT = 2
DISCLOSES = 0.7
REMOVES = 0.9
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # letters, other alphabets included
TERM_CHARS = 3


def _digits(match):
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits):
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int"))
    doubled = F.transform(value, lambda d, i: F.when((n - 1 - i) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind, match):
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _hint(kind, text):
    """A cheap test that texts without the kind mostly fail."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(PATTERNS[kind])


def _matches(kind, text):
    """Array of all matches of a pattern: kind, number, lengths of the gap before and of the match, the match."""
    gaps = F.split(text, PATTERNS[kind], -1)
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    paired = F.arrays_zip(found.alias("value"), gaps.alias("gap"))
    rows = F.transform(
        F.slice(paired, F.lit(1), F.size(found)),
        lambda m, i: F.struct(
            F.lit(ALL_KINDS.index(kind)).alias("kind"), i.alias("number"), F.length(m["gap"]).alias("gap"), F.length(m["value"]).alias("length"),
            m["value"].alias("value"),
        ),
    )
    return F.when(_hint(kind, text), rows)


def _numbered(docs, keep):
    """A row per document: rid (a number of its own), row (the columns `keep`), copy (a hash of the text), matches of all kinds, the text if there are any."""
    text = whole_text()
    matches = F.concat(*(F.coalesce(_matches(k, text), F.array()) for k in FOUND))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), row_of(keep), F.xxhash64(text).alias("copy"), matches.alias("matches"), text.alias("text"))
    return written(rows.withColumn("text", F.when(F.size("matches") > 0, F.col("text"))), "matches")


def _base(rows):
    """A row per base span: rid, copy, kind, start, end, entity."""
    m = rows.select("rid", "copy", F.inline("matches"))
    so_far = Window.partitionBy("rid", "kind").orderBy("number")
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    passes = F.lit(False)
    for kind in FOUND:
        passes = F.when(F.col("kind") == ALL_KINDS.index(kind), _passes(kind, F.col("value"))).otherwise(passes)
    entity = F.xxhash64("kind", F.lower("value"))
    return m.where(passes).select("rid", "copy", "kind", "start", "end", entity.alias("entity"))


def _words(rows, base, holders):
    """A row per word of a text that `holders` names and that touches no base span: rid, copy, term, start, end."""
    rids = holders.select("rid").distinct()
    found, gaps = F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.split("text", _TERM, -1)
    words = F.transform(F.arrays_zip(found.alias("word"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")), lambda w, i: F.struct(
        i.alias("number"), F.length(w["gap"]).alias("gap"), F.length(w["word"]).alias("length"), F.lower(w["word"]).alias("term")))
    so_far = Window.partitionBy("rid").orderBy("number")
    words = rows.join(rids, "rid", "left_semi").select("rid", "copy", F.inline(words))
    words = words.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    words = words.where(F.col("length") >= TERM_CHARS).select("rid", "copy", "term", "start", "end")
    spans = base.join(rids, "rid", "left_semi").select("rid", "copy", F.lit(None).cast("string").alias("term"), "start", "end")
    is_base = F.col("term").isNull()
    order = Window.partitionBy("rid").orderBy("start", F.col("term").asc_nulls_first())
    up_to, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    touches = (F.max(F.when(is_base, F.col("end"))).over(up_to) > F.col("start")) | (F.min(F.when(is_base, F.col("start"))).over(after) < F.col("end"))
    both = words.unionByName(spans).withColumn("touches", F.coalesce(touches, F.lit(False)))
    return both.where(~is_base & ~F.col("touches")).drop("touches")


def _holders(base):
    """A row per document and entity of `SUPPORT` different texts or more: rid, copy, entity, with_entity."""
    held = base.select("rid", "copy", "entity").distinct()
    entities = held.groupBy("entity", "copy").agg(F.count("*").alias("docs"))
    entities = entities.groupBy("entity").agg(F.sum("docs").alias("with_entity"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    return held.join(entities.drop("texts"), "entity").select("rid", "copy", "entity", "with_entity")


def entity_groups(holders):
    """A row per different text and group of entities that stand in the same texts: copy, entity (one of the group), with_entity, docs (rows of that text).

    Two sums of hashes over its texts name an entity's group, so that none is gathered; they differ from another's but by chance of a 128-bit hash.
    """
    held = holders.groupBy("copy", "entity", "with_entity").agg(F.count("*").alias("docs"))
    sums = [F.sum(F.xxhash64("copy", F.lit(i)).cast("decimal(38, 0)")).alias(f"sum{i}") for i in range(2)]
    texts = held.groupBy("entity").agg(F.count("*").alias("n_texts"), *sums)
    groups = texts.groupBy("n_texts", "sum0", "sum1").agg(F.min("entity").alias("entity"))  # the group's other entities have the same rows
    return held.join(groups.select("entity"), "entity", "left_semi")


def disclosures(words, holders, docs):
    """copy, entity (one of each group), term, disclosure of the terms with enough support, for each different text: pmi(t; e) / ic(e)."""
    n_docs = float(docs.count())
    all_words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole_text()), F.lit(_TERM), F.lit(0))))
    terms = docs.select(all_words.alias("term")).groupBy("term").agg(F.count("*").alias("with_term")).where(F.col("with_term") >= SUPPORT)
    here = words.select("copy", "term").distinct().join(terms, "term")
    entities = entity_groups(holders)
    ic = F.log(F.lit(n_docs) / F.col("with_entity"))
    rare = F.log(F.lit(n_docs) / F.col("with_term")) + 1e-9 >= DISCLOSES * ic
    pairs = written(here.join(entities, "copy").where(rare), "pairs")
    together = pairs.groupBy("entity", "term", "with_entity", "with_term").agg(F.sum("docs").alias("both"), F.count("*").alias("texts"))
    pmi = F.log(F.lit(n_docs) * F.col("both") / (F.col("with_term") * F.col("with_entity")))
    shown = together.where(F.col("texts") >= SUPPORT).select("entity", "term", F.when(ic > 0, pmi / ic).alias("disclosure"))
    return pairs.select("copy", "entity", "term").join(shown.where(F.col("disclosure") >= DISCLOSES), ["entity", "term"])


def find(docs, keep=("doc_id",)):
    """A row per document: row (the columns `keep`) and spans, an array of (start, kind, end) in order; kind numbers a name in ALL_KINDS."""
    rows = _numbered(docs, keep)
    base = written(_base(rows), "base-spans")
    holders = written(_holders(base), "holders")
    words = written(_words(rows, base, holders), "words")
    shown = disclosures(words, holders, docs.select("text")).groupBy("copy", "term").agg(F.max("disclosure").alias("disclosure"))
    kind = F.when(F.col("disclosure") >= REMOVES, ALL_KINDS.index("name")).otherwise(ALL_KINDS.index("term"))
    terms = words.join(shown, ["copy", "term"]).select("rid", "start", "end", kind.alias("kind"))
    both = base.select("rid", "start", "end", "kind").unionByName(terms)
    spans = both.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("rid", "row").join(spans, "rid", "left").select("row", F.coalesce("spans", empty).alias("spans"))


def _listed(spans):
    names = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def summary(docs):
    """doc_id, counts of base kinds, base_sha256, spans of each row."""
    rows = find(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(i) for i, k in enumerate(KINDS)}
    return rows.select("row.doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(docs):
    """The rows of `docs` with `text` changed: base spans and secrets by their kind in brackets, terms by `[TERM]`, names removed."""
    rows, text = find(docs, docs.columns), F.coalesce(F.col("row.text"), F.lit(""))
    labels = F.array(*(F.lit("" if k == "name" else f"[{k.upper()}]") for k in ALL_KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done, span):
        new = F.concat(F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.element_at(labels, span["kind"] + 1))
        return F.when(span["start"] < done["at"], F.struct(F.greatest(done["at"], span["end"]).alias("at"), done["parts"].alias("parts"))).otherwise(
            F.struct(span["end"].alias("at"), F.array_append(done["parts"], new).alias("parts"))
        )

    done = F.aggregate("spans", start, step)
    rows = rows.withColumn("done", done)
    changed = F.concat(F.array_join("done.parts", ""), F.substring(text, (F.col("done.at") + 1).cast("int"), F.length(text)))
    return unpacked(rows.withColumn("row", F.col("row").withField("text", F.when(F.size("spans") > 0, changed).otherwise(F.col("row.text")))), docs.columns)
