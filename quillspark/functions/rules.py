"""Validation rules and status columns of the application tables."""

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions.text import path_suffix

# a host name may be international; addresses are checked part by part
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
_NAME = rf"(?:{_LABEL}\.)+(?:\p{{L}}{{2,63}}|xn--[a-zA-Z0-9-]{{2,59}})\.?"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
_HEX = r"[0-9a-fA-F]{1,4}"
_V6 = "|".join(
    [rf"(?:{_HEX}:){{7}}{_HEX}", rf"(?:{_HEX}:){{1,7}}:", rf"::(?:{_HEX}:){{0,6}}{_HEX}", "::", rf"(?:{_HEX}:){{6}}{_V4}", rf"::(?:{_HEX}:){{0,5}}{_V4}"]
    + [rf"(?:{_HEX}:){{1,{7 - n}}}(?::{_HEX}){{{n}}}" for n in range(1, 7)]
)
URL = (
    r"^(?:https?|ftps?)://"
    r"(?:[^\s:@/?#\[\]]+(?::[^\s:@/?#\[\]]*)?@)?"
    rf"(?:{_NAME}|{_V4}|localhost|\[(?:{_V6})\])"
    r"(?::[0-9]{1,5})?(?:[/?#][^\s]*)?$"
)


def url_error(url):
    """Null for a usable URL, else the message for the first rule it breaks."""
    return (
        F.when(F.coalesce(F.length(url), F.lit(0)) == 0, F.lit(fixed.MSG_NO_URL))
        .when(~url.rlike(URL), F.lit(fixed.MSG_BAD_URL))
        .otherwise(F.lit(None).cast("string"))
    )


def content_type_error(content_type):
    bad = ~F.coalesce(content_type.startswith("image/"), F.lit(False))
    return F.when(bad, F.lit(fixed.MSG_NOT_IMAGE))


def suffix_error(filename):
    return F.when(~path_suffix(filename).isin(*fixed.IMAGE_SUFFIXES), F.lit(fixed.MSG_BAD_SUFFIX))


def image_error(b64, width, height, max_chars=fixed.MAX_B64_CHARS, max_side=fixed.MAX_SIDE):
    """First broken rule: decodable, length of the base64 text, then both sides."""
    return (
        F.when(F.try_to_binary(b64, F.lit("base64")).isNull(), F.lit(fixed.MSG_NOT_DECODABLE))
        .when(F.length(b64) > max_chars, F.lit(fixed.MSG_TOO_LARGE))
        .when((width > max_side) | (height > max_side), F.lit(fixed.MSG_TOO_WIDE))
    )


def upload_error(filename, b64, width, height, **limits):
    return F.coalesce(suffix_error(filename), image_error(b64, width, height, **limits))


def status(response, failed):
    """An empty response counts as absent."""
    return (
        F.when(F.length(response) > 0, F.lit("response"))
        .when(failed, F.lit("failed"))
        .otherwise(F.lit("loading"))
    )


def class_score(answer, classes=fixed.CLASSES):
    """Integer class of a model answer; null when the answer is not one of the classes."""
    return F.when(F.trim(answer).isin(*classes), F.trim(answer).try_cast("int"))
