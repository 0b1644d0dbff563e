"""Text expressions that mean the same in Spark and in SQL engines with RE2 patterns; `unescape_all` alone runs in Python."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \w and \s are ASCII-only, so words are spelled out as letters and numbers.
WORD = r"[\p{L}\p{N}]+"


def tokenize(text: Column | str) -> Column:
    """Lower-cased words of letters and numbers; null gives null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def normalize_ws(text: Column | str) -> Column:
    """Lower case, runs of ASCII white space to one space, ends trimmed."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f\v]+", " "))


def html_to_text(page: Column | str) -> Column:
    """Visible text: script, style, nav and footer, comments and tags out; the five basic entities decoded last."""
    c = F.col(page) if isinstance(page, str) else page
    for tag in ("script", "style", "nav", "footer"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(c), r"[ \t\n\r\f\v]+", " "))


def unescape(text: Column) -> Column:
    """The five basic entities and the hard space; & last, so that nothing is decoded twice."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def unescape_all(text: Column | str) -> Column:
    """Every named and numeric character reference of HTML, decoded once by the standard library, in Arrow batches; texts without an & don't change."""

    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or "&" not in t else html.unescape(t) for t in texts.to_pylist()], pa.string())

    return decode(F.col(text) if isinstance(text, str) else text)


def url_canonical(url: Column | str) -> Column:
    """Lower-case scheme and host; fragment, tracking parameters and a trailing ? out."""
    c = F.col(url) if isinstance(url, str) else url
    c = F.regexp_replace(c, r"#.*$", "")
    c = F.regexp_replace(c, r"([?&])(?:utm_[^=&]*|gclid|fbclid)=[^&]*", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"&+", "&"), r"\?&", "?")
    c = F.regexp_replace(c, r"[?&]+$", "")
    head = F.regexp_extract(c, r"^[^:/?#]+://[^/?#]*", 0)
    return F.concat(F.lower(head), F.substring(c, F.length(head) + 1, F.length(c)))
