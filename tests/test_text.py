import pathlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import fixed, workers
from quillspark.functions import text
from quillspark.operators import metrics

PIECES = ["\\frac", "\\mathbb{R}", "\\mathbb{RR}", "\\begin{matrix}", "\\end{x}", "\\operatorname*", "\\operatorname",
          "\\", "\\\n", "\\\\", "{", "}", " ", "\n", "\t", "a", "Z", "1", "é", "𝔸", " ", "\\é", "*", "\\ ", "\r", "\\\r"]


def plain_tokens(s):
    """A scanner by hand, as an independent statement of the token rule."""

    def word(i, ok):
        j = i
        while j < len(s) and ok(s[j]):
            j += 1
        return j

    letter = lambda c: c.isascii() and c.isalpha()
    lower = lambda c: c.isascii() and c.islower()
    out, i = [], 0
    while i < len(s):
        end = i + 1
        if s[i] == "\\" and i + 1 < len(s) and s[i + 1] != "\n":
            end = max(i + 2, word(i + 1, letter))
            if s.startswith("\\operatorname*", i):
                end = i + len("\\operatorname*")
            for name in ("\\begin{", "\\end{"):
                if s.startswith(name, i):
                    stop = word(i + len(name), lower)
                    if stop > i + len(name) and s[stop : stop + 1] == "}":
                        end = stop + 1
            if s.startswith("\\mathbb{", i) and s[i + 9 : i + 10] == "}" and letter(s[i + 8]):
                end = i + 10
        out.append(s[i:end])
        i = end
    return out


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def random_texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, longest))) for _ in range(n)]


def test_latex_tokens_equal_a_plain_scanner(spark):
    texts = random_texts(2000, 1)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for row in df.select("i", text.latex_tokens(F.col("s")).alias("t")).collect():
        assert row.t == plain_tokens(texts[row.i])


def test_edits_equal_the_full_table(spark):
    labels, preds = random_texts(300, 2, 60), random_texts(300, 3, 60)
    labels += ["", "", "abc", "x" * 700, "ab" * 400]
    preds += ["", "abc", "", "y" * 690, "ba" * 300]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(labels, preds))]
    df = spark.createDataFrame(rows, "i int, label string, pred string")
    for tokenizer, plain in ((text.latex_tokens, plain_tokens), (text.word_tokens, str.split), (text.char_tokens, list)):
        if tokenizer is text.word_tokens:
            # \S+ and str.split() differ in exotic blanks; words are compared without them
            df = df.withColumn("label", F.regexp_replace("label", " ", "")).withColumn(
                "pred", F.regexp_replace("pred", " ", ""))
        kept = [(a.replace(" ", ""), b.replace(" ", "")) if tokenizer is text.word_tokens else (a, b)
                for a, b in zip(labels, preds)]
        expected = [plain_edits(plain(a), plain(b)) for a, b in kept]
        pattern = {text.latex_tokens: fixed.LATEX_TOKEN, text.word_tokens: fixed.WORD_TOKEN}.get(
            tokenizer, fixed.CHAR_TOKEN)
        for kernel, cut in (("jvm", tokenizer), ("arrow", tokenizer), ("jvm", pattern), ("arrow", pattern)):
            counted = metrics.pair_edits(df, tokenizer=cut, kernel=kernel)
            got = {r.i: (r.edits, r.ref_tokens) for r in counted.collect()}
            assert [got[i][0] for i in range(len(rows))] == expected
            assert [got[i][1] for i in range(len(rows))] == [len(plain(a)) for a, _ in kept]
        df = spark.createDataFrame(rows, "i int, label string, pred string")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcde"), max_size=90))
def test_bit_edits(a, b):
    assert workers.bit_edits(a, b) == plain_edits(a, b)


def test_bands_widen_until_they_hold_the_distance():
    rng = random.Random(11)
    for changes in (0, 3, 60, 200, 700):
        a = rng.choices("abcdefgh", k=1500)
        b = list(a)
        for _ in range(changes):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choices("abcdefghx", k=rng.randrange(3))
        assert workers.bit_edits(a, b) == plain_edits(a, b)
    # same token counts in another order: the first band is too narrow
    a = rng.choices("ab", k=1600)
    b = a[400:] + a[:400]
    assert workers.bit_edits(a, b) == plain_edits(a, b)


def test_many_distinct_tokens(spark):
    """More distinct tokens than one block of characters holds."""
    words = [f"w{i}" for i in range(70000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(["x", *words[1:-1]]))], "label string, pred string")
    row = metrics.pair_edits(df, tokenizer=text.word_tokens).first()
    assert (row.edits, row.ref_tokens) == (2, 70000)
    short = spark.createDataFrame([(" ".join(words[:3000]), " ".join(words[3:3000]))], "label string, pred string")
    assert metrics.pair_edits(short, tokenizer=text.word_tokens, kernel="jvm").first().edits == 3


def test_pooled_rate_can_pass_one_and_be_null(spark):
    df = spark.createDataFrame([("v", "ab", "wxyz"), ("v", "", "q"), ("e", "", "z")], "split string, label string, pred string")
    for kernel in ("jvm", "arrow"):
        rates = metrics.pooled_error_rate(metrics.pair_edits(df, kernel=kernel), ["split"])
        got = {r.split: r for r in rates.collect()}
        assert got["v"].edits == 5 and got["v"].error_rate == 2.5
        assert got["e"].error_rate is None


def test_null_texts_count_for_nothing(spark):
    df = spark.createDataFrame([(None, "a"), ("b", None), ("c", "d")], "label string, pred string")
    for kernel in ("jvm", "arrow"):
        got = [(r.edits, r.ref_tokens) for r in metrics.pair_edits(df, kernel=kernel).collect()]
        assert got == [(None, None), (None, 1), (1, 1)]


def test_strip_takes_every_blank(spark):
    texts = [" a ", " b　", "\x1cc\x85", "\n\td e\r\n", "​f​", "   ", "", " x "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", text.strip(F.col("s")).alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [s.strip() for s in texts]


def test_preview_and_mask(spark):
    texts = ["é" * 100, "é" * 101, "", "short"]
    keys = ["abcdefghijkl", "abcde", "abc", ""]
    df = spark.createDataFrame(list(zip(texts, keys)), "s string, k string")
    for r in df.select("s", "k", text.preview(F.col("s")).alias("p"), text.masked_key(F.col("k")).alias("m")).collect():
        assert r.p == r.s[:100] + ("..." if len(r.s) > 100 else "")
        assert r.m == (r.k[:4] + "*" * (len(r.k) - 4))[:8] + "..."


def test_path_parts_equal_pathlib(spark):
    paths = ["a/b/c.png", "a.b/c", "/x/y.tar.GZ", "p/.hidden", "q/n.", "r/s.JPG"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    c = F.col("p")
    cols = [text.path_name(c), text.path_parent(c), text.path_stem(c), text.path_suffix(c)]
    for r in df.select("p", *[x.alias(f"c{i}") for i, x in enumerate(cols)]).collect():
        p = pathlib.PurePosixPath(r.p)
        if r.p == "q/n.":
            continue  # Python versions disagree on a trailing dot
        assert (r.c0, r.c1, r.c2, r.c3) == (p.name, str(p.parent), p.stem, p.suffix.lower())


def test_data_uri_has_no_line_breaks(spark):
    import base64

    body = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(body),)], "b binary")
    assert df.select(text.data_uri(F.col("b")).alias("u")).first().u == (
        "data:image/jpeg;base64," + base64.b64encode(body).decode())


def test_changed_or_lost_tokens_alone_need_no_table(monkeypatch):
    """Answers with characters changed, lost or added alone are counted in one pass; others still come out right."""
    text = "the one and only lesson of the evening " * 60
    for answer, edits in ((text.replace("e", "\x07"), text.count("e")), (text.replace("on", ""), 2 * text.count("on")), (" \n" + text + "\t ", 4)):
        monkeypatch.setattr(workers, "_banded_edits", None)
        monkeypatch.setattr(workers, "_table_edits", None)
        assert workers.bit_edits(text, answer) == edits == workers.bit_edits(answer, text)
    monkeypatch.undo()
    for a, b in (("ab" * 40, "ba" * 40), ("xaby", "xbay"), ("aab", "ab"), ("", "a"), ("abcabc", "cabcab"), ("aa", "aba")):
        assert workers.bit_edits(a, b) == plain_edits(a, b)


def test_formulas_of_one_file_go_to_all_tasks(spark):
    """The table of parts is one block here, and its pairs are costly: they are dealt out in a session without settings too."""
    from quillspark.plans import adapters

    sf = "/root/testdata/sf0.01"
    assert adapters.table(spark, sf, "part").rdd.getNumPartitions() == 1
    assert adapters.formula_predictions(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
