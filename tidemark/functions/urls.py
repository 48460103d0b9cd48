"""URL keys and cleaning, with patterns that mean the same to Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Query fields that hold a post's number, and those that name its board: fixed values.
NUMBER_FIELDS = "document_srl|No|no|number|num|wr_id|id"
BOARD_FIELDS = "id|table|code|bo_table"
POST_NUMBER = rf"(?:^|&)(?:{NUMBER_FIELDS})=([0-9]+)"
BOARD_NAME = rf"(?:^|&)(?:{BOARD_FIELDS})=([A-Za-z][A-Za-z0-9_]*)"


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))


def url_key(url: Column) -> Column:
    """Key that equal posts share whatever their URLs' paging: host#[board:]number, from the query or else from the last number
    of four or more digits that ends a part of the path; else host, path and query. Null for null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 1)), r"^www\.", "")
    path, query = F.regexp_extract(url, PARTS, 2), F.regexp_extract(url, PARTS, 3)
    number, board = F.regexp_extract(query, POST_NUMBER, 1), F.regexp_extract(query, BOARD_NAME, 1)
    # each part of the path between slashes that ends with such a number; the last one counts
    numbers = F.filter(F.transform(F.split(path, "/"), lambda p: F.regexp_extract(F.concat(F.lit("-"), p), "-([0-9]{4,})$", 1)), lambda n: n != "")
    return (
        F.when(number != "", F.concat(host, F.lit("#"), F.when(board != "", F.concat(board, F.lit(":"))).otherwise(""), number))
        .when(F.size(numbers) > 0, F.concat(host, F.lit("#"), F.try_element_at(numbers, F.lit(-1))))
        .otherwise(F.concat(host, path, F.lit("?"), query))
    )


#: Query fields that only say at which place of a list, or how, a post was opened: fixed values.
LIST_FIELDS = ("page", "p", "po", "pg", "od", "category", "groupCd", "bm", "iskin", "kind", "select", "query", "subselect", "subquery", "user", "site")
#: Fields that only say where a visitor came from; dropped where a caller asks for it.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "page", "from")


def clean_url(url: Column, domain: Column | None = None, drop: tuple[str, ...] = LIST_FIELDS) -> Column:
    """https URL without fragment and without the given query fields; null unless its host is domain or under it."""
    host, path, query = (F.regexp_extract(url, PARTS, i) for i in (1, 2, 3))
    host = F.lower(host)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda f: (f != "") & ~F.element_at(F.split(f, "="), 1).isin(*drop)), "&")
    out = F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    fits = host != ""
    if domain is not None:
        fits = fits & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))
    return F.when(fits, out)
