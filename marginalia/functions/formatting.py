"""Formatting of values, and the envelope of a service's answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(millis: Column) -> Column:
    """``500 ms``, ``1 s 0 ms`` or ``1 min 5 s 0 ms``."""
    m = millis.cast("bigint")
    ms, s = F.pmod(m, F.lit(1000)), F.pmod(F.floor(m / 1000), F.lit(60))
    return (
        F.when(m < 1000, F.format_string("%d ms", m))
        .when(m < 60000, F.format_string("%d s %d ms", s, ms))
        .otherwise(F.format_string("%d min %d s %d ms", F.floor(m / 60000), s, ms))
    )


def percent(share: Column) -> Column:
    """A share as percent with two decimals, rounded half up; null for null."""
    return F.when(share.isNotNull(), F.format_string("%.2f%%", F.round(share * 100, 2)))


def query_string(url: str, parameters: dict[str, Column]) -> Column:
    """A URL with percent-encoded parameters."""
    parts = [F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in parameters.items()]
    return F.concat(F.lit(url + "?"), F.concat_ws("&", *parts)) if parts else F.lit(url)


def decode_answer(status: Column, body: Column, data_type: str = "string") -> Column:
    """The data of an answer ``{data, message, code}``: null for the codes -1 and -2, an error otherwise."""
    answer = F.from_json(body, f"data {data_type}, message string, code int")
    ok = (status == 200) & (answer["code"] == 0)
    absent = (status == 200) & answer["code"].isin(-1, -2)
    return F.when(ok, answer["data"]).when(absent, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("answer refused: "), F.coalesce(answer["message"], F.lit("")))))


def answer_kind(status: Column, code: Column) -> Column:
    """``data``, ``absent`` or ``error`` by status and code."""
    return F.when((status == 200) & (code == 0), "data").when((status == 200) & code.isin(-1, -2), "absent").otherwise("error")
