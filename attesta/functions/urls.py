"""URL functions as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import strip
from attesta.registry.post_values import BOARDS

# scheme, authority, path, query of a URL; the fragment is left out.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
MAX_URL = 2048
ACCESS_BY_ERROR = {
    "ENVELOPE_INVALID": "inaccessible", "MALFORMED_URL": "inaccessible",
    "UNSUPPORTED_SCHEME": "unsupported", "URL_CREDENTIALS": "unsafe", "UNSAFE_HOST": "unsafe",
    "URL_TOO_LONG": "unsafe", "DNS_RESOLUTION_FAILED": "inaccessible",
    "UNSAFE_REDIRECT": "unsafe", "REDIRECT_LIMIT_EXCEEDED": "unsafe",
    "TLS_FAILURE": "inaccessible", "TIMEOUT": "inaccessible", "CONNECT_FAILURE": "inaccessible",
    "HTTP_CLIENT_ERROR": "inaccessible", "HTTP_SERVER_ERROR": "inaccessible",
    "UNSUPPORTED_CONTENT_TYPE": "unsupported", "RESPONSE_TOO_LARGE": "unsafe",
    "NO_EXTRACTABLE_TEXT": "accessible", "PARSER_EXCEPTION": "inaccessible",
    "CONTENT_BLOCK_LIMIT_EXCEEDED": "unsafe",
}
CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "text/markdown")
MAX_BODY = 2 * 1024 * 1024
MAX_BLOCKS = 5000


def part(url: Column, index: int) -> Column:
    return F.regexp_extract(strip(url), PARTS, index)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def user_info(url: Column) -> Column:
    return F.regexp_extract(authority(url), r"^(.*)@", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::\d*)?$", 1))


def port(url: Column) -> Column:
    """Port as written, null when there is none."""
    digits = F.regexp_extract(authority(url), r":(\d+)$", 1)
    return F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999")).cast("int")


def _query(url: Column) -> Column:
    query = part(url, 4)
    return F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))


def url_key(url: Column) -> Column:
    """Key of a job-post URL: lower scheme and host, no trailing slash, query kept."""
    path = F.regexp_replace(part(url, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(
        F.when(scheme(url) == "", "").otherwise(F.concat(scheme(url), F.lit(":"))),
        F.when(authority(url) == "", "").otherwise(F.concat(F.lit("//"), F.lower(authority(url)))),
        path, _query(url),
    )


def _idna(hosts: pd.Series) -> pd.Series:
    def encode(name):
        try:
            return None if name is None else name.encode("idna").decode("ascii")
        except UnicodeError:
            return name

    return hosts.map(encode)


def normalize_submitted_url(url: Column, with_idna: bool = False) -> Column:
    """Submitted URL in one spelling; null when it has no host.

    The host is encoded in Python only when asked to; plain ASCII hosts do not need it.
    """
    name = host(url)
    if with_idna:
        name = F.when(name.rlike(r"^[\x00-\x7f]*$"), name).otherwise(F.pandas_udf(_idna, "string")(name))
    default = ((scheme(url) == "http") & (port(url) == 80)) | ((scheme(url) == "https") & (port(url) == 443))
    suffix = F.when(port(url).isNull() | default, "").otherwise(F.concat(F.lit(":"), port(url)))
    user = F.when(user_info(url) == "", "").otherwise(F.concat(user_info(url), F.lit("@")))
    prefix = F.when(scheme(url) == "", "").otherwise(F.concat(scheme(url), F.lit(":")))
    return F.when(
        name != "",
        F.concat(prefix, F.lit("//"), user, name, suffix, part(url, 3), _query(url)),
    )


def is_ip_literal(name: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return name.rlike(rf"^(?:{octet}\.){{3}}{octet}$") | name.contains(":")


def url_error(url: Column) -> Column:
    """Error code of an unsafe or unusable URL, null when it may be fetched. No name lookup."""
    used = F.coalesce(port(url), F.when(scheme(url) == "https", 443).otherwise(80))
    return (
        F.when(F.length(url) > MAX_URL, "URL_TOO_LONG")
        .when((scheme(url) == "") | (host(url) == ""), "MALFORMED_URL")
        .when(authority(url).contains("@"), "URL_CREDENTIALS")
        .when(~scheme(url).isin("http", "https"), "UNSUPPORTED_SCHEME")
        .when(~used.isin(80, 443), "UNSAFE_HOST")
        .when(is_ip_literal(host(url)), "UNSAFE_HOST")
    )


def access_status(error: Column) -> Column:
    """Access status of a retrieval error; no error means accessible."""
    chain = F.when(error.isNull(), "accessible")
    for code, status in ACCESS_BY_ERROR.items():
        chain = chain.when(error == code, status)
    return chain.otherwise("inaccessible")


def retrieval_error(status: Column, media_type: Column, n_blocks: Column, n_bytes: Column) -> Column:
    """Error code of a fetch result, null when it is usable."""
    return (
        F.when(n_bytes > MAX_BODY, "RESPONSE_TOO_LARGE")
        .when(status.between(400, 499), "HTTP_CLIENT_ERROR")
        .when(status >= 500, "HTTP_SERVER_ERROR")
        .when(status != 200, "HTTP_CLIENT_ERROR")
        .when(media_type.isNull() | ~media_type.isin(*CONTENT_TYPES), "UNSUPPORTED_CONTENT_TYPE")
        .when(n_blocks == 0, "NO_EXTRACTABLE_TEXT")
        .when(n_blocks > MAX_BLOCKS, "CONTENT_BLOCK_LIMIT_EXCEEDED")
    )


def media_type(header: Column) -> Column:
    """Media type without parameters, null when empty."""
    return F.nullif(F.lower(strip(F.split_part(header, F.lit(";"), F.lit(1)))), F.lit(""))


#: Names of character sets as bodies declare them, and Spark's names.
CHARSETS = {
    "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "us-ascii": "US-ASCII", "ascii": "US-ASCII",
    "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-32": "UTF-32",
}


def declared_charset(header: Column) -> Column:
    return F.lower(F.regexp_extract(header, r'(?i)charset="?([^";\s]+)', 1))


def decode_body(body: Column, header: Column) -> Column:
    """Body text by the declared charset where Spark knows it, else UTF-8 with replacement."""
    charset = declared_charset(header)
    chain = F
    for name, java in CHARSETS.items():
        chain = chain.when(charset == name, F.decode(body, java))
    return chain.otherwise(F.make_valid_utf8(body.cast("string")))


def charset_error(header: Column) -> Column:
    """CHARSET_UNKNOWN where ``decode_body`` falls back to UTF-8 for a charset it does not know."""
    charset = declared_charset(header)
    return F.when(~charset.isin("", "utf-8", "utf8", *CHARSETS), "CHARSET_UNKNOWN")


def source_name(url: Column) -> Column:
    """Job board of a URL, else the name in its host."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    chain = F
    for domain, board in BOARDS.items():
        chain = chain.when((name == domain) | name.endswith("." + domain), board)
    label = F.regexp_replace(F.split_part(name, F.lit("."), F.lit(1)), "-", " ")
    return chain.when(name == "", "").otherwise(F.concat(F.initcap(label), F.lit(" careers")))
