"""Text columns: tokens, edit distance, previews, masks, path parts, data URIs."""

from pyspark.sql import functions as F

from quillspark import fixed

# fixed values: the characters that str.strip() removes
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def bind(value, body):
    """body(value) with `value` computed once, also when a lambda uses it per element."""
    return F.transform(F.array(value), body)[0]


def tokens(s, pattern=fixed.LATEX_TOKEN):
    """All matches of a token pattern, in order."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def latex_tokens(s):
    return tokens(s, fixed.LATEX_TOKEN)


def char_tokens(s):
    return tokens(s, fixed.CHAR_TOKEN)


def word_tokens(s):
    return tokens(s, fixed.WORD_TOKEN)


def _code_char(position):
    """One character per vocabulary position, from planes 1 to 16: no surrogate is met."""
    code = F.lpad(F.hex(position + F.lit(0xFFFF)), 8, "0")
    return F.decode(F.unhex(code), "UTF-32")


def _encoded(tokens, vocab):
    return F.array_join(
        F.transform(tokens, lambda t: _code_char(F.array_position(vocab, t).cast("bigint"))), ""
    )


def _distance(a, b):
    """Exact distance; narrow bands are tried first, so near texts cost little."""
    exact = F.levenshtein(a, b)
    for band in (256, 16):
        banded = F.levenshtein(a, b, band)
        exact = F.when(banded >= 0, banded).otherwise(exact)
    return F.when(a == b, F.lit(0)).otherwise(exact)


def token_edits(ref_tokens, hyp_tokens):
    """Edit distance between two token arrays, inside the JVM.

    Every distinct token of the pair becomes one character, then `levenshtein` counts. Its cost is
    the product of both lengths: `operators.metrics.pair_edits` has a kernel for long texts.
    """

    def of(pair):
        vocab = F.array_distinct(F.concat(pair["r"], pair["h"]))
        return bind(
            F.struct(pair["r"].alias("r"), pair["h"].alias("h"), vocab.alias("v")),
            lambda p: bind(
                F.struct(
                    _encoded(p["r"], p["v"]).alias("a"), _encoded(p["h"], p["v"]).alias("b")
                ),
                lambda e: _distance(e["a"], e["b"]),
            ),
        )

    return bind(F.struct(ref_tokens.alias("r"), hyp_tokens.alias("h")), lambda pair: F.when(pair["r"] == pair["h"], 0).otherwise(of(pair)))


def strip(s):
    """Remove outer white space of every kind, not only blanks."""
    return F.btrim(s, F.lit(BLANKS))


def preview(s, chars=fixed.PREVIEW_CHARS):
    return F.when(F.length(s) > chars, F.concat(F.substring(s, 1, chars), F.lit("..."))).otherwise(s)


def masked_key(key):
    """First four characters, stars, cut after eight, three dots."""
    stars = F.repeat(F.lit("*"), F.greatest(F.length(key) - 4, F.lit(0)))
    return F.concat(F.substring(F.concat(F.substring(key, 1, 4), stars), 1, 8), F.lit("..."))


def path_name(path):
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_parent(path):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_stem(path):
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]+$", "")


def path_suffix(path):
    return F.lower(F.regexp_extract(path_name(path), r"(?<=.)(\.[^.]+)$", 1))


def rendered_path(path):
    """Path of the picture drawn from an ink file: same folder and stem."""
    return F.concat(path_parent(path), F.lit("/"), path_stem(path), F.lit(".png"))


def base64_text(content):
    """Base64 in one line: the built-in breaks it every 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def data_uri(content):
    """Binary content as the data URI that a chat request carries."""
    return F.concat(F.lit(fixed.DATA_URI_PREFIX), base64_text(content))


def tagged_prompt(question=fixed.USER_PROMPT):
    return F.concat(F.lit(fixed.IMAGE_TAG), F.lit(question))


def untagged(prompt):
    return strip(F.replace(prompt, F.lit(fixed.IMAGE_TAG), F.lit("")))
