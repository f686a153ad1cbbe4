"""Artist facts from saved API responses (S-14, P-12): XML search/getinfo bodies and JSON location bodies.

Responses are a table ``(artist_name, source, kind, body)`` and, where answers
were saved more than once, ``received`` (a time or number): the newest answer of
an artist counts, without it the greatest text.  Parsing is ``from_xml`` /
``from_json`` with declared schemas, and the response rules are column
expressions, so the whole step is two aggregates and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import latest_not_after

XML_SCHEMA = "code string, answer string, country string, mbid string, sexe string, year_debut string"
JSON_SCHEMA = "headers struct<status:string>, results array<struct<locations:array<struct<country:string>>>>"
CODE_OK, CODE_LIMIT, ANSWER_OK = "100", "103", "valid"


def newest(responses: DataFrame) -> Column:
    """Order of an artist's answers of one kind: by ``received`` (no time first), then by their text."""
    received = F.col("received") if "received" in responses.columns else F.lit(None).cast("long")
    return F.struct(received.isNotNull(), received, "body")


def search_status(x) -> Column:
    """P-12 rule of a parsed search answer: code 103 is ``limit``, else it must have code 100 and answer ``valid``."""
    ok = F.coalesce((x["code"] == CODE_OK) & (x["answer"] == ANSWER_OK), F.lit(False))
    return F.when(x["code"] == CODE_LIMIT, F.lit("limit")).when(ok, F.lit("ok")).otherwise(F.lit("error"))


def answers_as_of(requests: DataFrame, responses: DataFrame, time_col: str, artist_col: str = "artist_name") -> DataFrame:
    """S-14 / P-12 for requests with a time: every request with ``status`` and ``artist_country`` of the search
    answer that was the newest when the request was made; no answer yet: null."""
    search = responses.where((F.col("source") == "musicovery") & (F.col("kind") == "search"))
    found = latest_not_after(requests, search.withColumnRenamed("artist_name", artist_col), [artist_col], time_col, ["body"], right_time="received", out_col="_answer")
    parsed = found.withColumn("_x", F.from_xml("_answer.body", XML_SCHEMA))
    status = F.when(F.col("_answer").isNotNull(), search_status(F.col("_x")))
    return parsed.withColumn("status", status).withColumn("artist_country", F.when(F.col("status") == "ok", F.col("_x.country"))).drop("_x", "_answer")


def parse_search_info(responses: DataFrame) -> DataFrame:
    """S-14 / P-12 (first source): per artist ``status``, ``country``, ``sex``, ``year``.

    The search response must have code 100 and answer ``valid`` (else status
    ``error``; code 103 is ``limit``).  Country comes from the search and is
    overridden by getinfo; sex and year come from getinfo.
    """
    x = responses.where(F.col("source") == "musicovery").withColumn("x", F.from_xml("body", XML_SCHEMA))
    search = x.where(F.col("kind") == "search").groupBy("artist_name").agg(F.max_by("x", newest(x)).alias("s"))
    info = x.where(F.col("kind") == "getinfo").groupBy("artist_name").agg(F.max_by("x", newest(x)).alias("g"))
    j = search.join(info, "artist_name", "left")
    ok = (F.col("s.code") == CODE_OK) & (F.col("s.answer") == ANSWER_OK)
    has_info = ok & F.col("s.mbid").isNotNull() & (F.col("g.mbid").isNull() | (F.col("g.mbid") == F.col("s.mbid")))
    return j.select(
        "artist_name",
        search_status(F.col("s")).alias("status"),
        F.when(ok, F.coalesce(F.when(has_info, F.col("g.country")), F.col("s.country"))).alias("artist_country"),
        F.when(has_info, F.col("g.sexe")).alias("artist_sex"),
        F.when(has_info, F.col("g.year_debut")).alias("artist_year"),
    )


def parse_locations(responses: DataFrame) -> DataFrame:
    """S-14 / P-12 (fallback source): country of the first location of the first hit when status is ``success``."""
    j = responses.where(F.col("source") == "jamendo").withColumn("j", F.from_json("body", JSON_SCHEMA))
    first = F.try_element_at(F.try_element_at(F.col("j.results"), F.lit(1))["locations"], F.lit(1))["country"]
    country = F.when(F.col("j.headers.status") == "success", first)
    return j.groupBy("artist_name").agg(F.max_by(country, newest(j)).alias("artist_country"))
