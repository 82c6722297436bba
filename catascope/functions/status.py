"""Status codes of lookups and harvests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the codes outside HTTP.
STATUS_LABELS = {
    600: "Not Specified",
    666: "Robots.txt",
    702: "Connection Error",
    703: "Connection Timeout",
    704: "Read Timeout",
    705: "HTTPError",
    706: "TooManyRedirects",
    707: "Timeout",
    801: "ValueError",
    802: "TimeoutError",
    901: "InvalidUrl",
    902: "InvalidSchema",
    903: "MissingSchema",
    904: "MissingDatasets",
}
# Code of an exception class. A class that extends an earlier one has its code.
EXCEPTION_CODES = {
    "ConnectionError": 702,
    "ConnectTimeout": 702,
    "SSLError": 702,
    "ProxyError": 702,
    "ReadTimeout": 704,
    "HTTPError": 705,
    "TooManyRedirects": 706,
    "Timeout": 707,
    "CKANAPIError": 708,
    "ValueError": 801,
    "JSONDecodeError": 801,
    "InvalidSchema": 801,
    "MissingSchema": 801,
    "TimeoutError": 802,
    "InvalidUrl": 901,
}
# Code of a transport error while downloading.
TRANSPORT_CODES = {
    "KeyError": 601,
    "IgnoreRequest": 602,
    "NotSupported": 603,
    "ConnectError": 604,
    "ConnectionRefusedError": 605,
    "DNSLookupError": 606,
    "TCPTimedOutError": 607,
    "TimeoutError": 608,
}
ROBOTS_DENIED = 666


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def status_label(status: Column) -> Column:
    return F.coalesce(_lookup(STATUS_LABELS, status.cast("int")), status.cast("string"))


def exception_code(name: Column) -> Column:
    """Code of a harvest exception given by class name, with or without its module."""
    return F.coalesce(_lookup(EXCEPTION_CODES, F.substring_index(name, ".", -1)), F.lit(600))


def transport_code(name: Column) -> Column:
    return F.coalesce(_lookup(TRANSPORT_CODES, F.substring_index(name, ".", -1)), F.lit(600))


def harvest_status(exc: Column) -> Column:
    return F.when(exc.isNull(), F.lit(200)).otherwise(exception_code(exc))


def status_class(status: Column) -> Column:
    return (
        F.when(status == 200, "ok")
        .when((status > 400) & (status < 600), "error")
        .otherwise("other")
    )
