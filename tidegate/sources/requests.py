"""Requests from event tables, and the text form of requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY_HEADER, KEY_HEADER = "X-Forwarded-For", "Idempotency-Key"
ANONYMOUS = "anonymous"

#: Reason phrases by status (fixed values); all others are "Status".
REASONS = {200: "OK", 201: "Created", 400: "Bad Request", 409: "Conflict", 422: "Unprocessable Entity", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway"}


def from_events(events: DataFrame) -> DataFrame:
    """Events as requests: seq, now_ms, identity, idem_key, method, target, body, backend_status. Those of no user share
    one identity and have no key."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"),
        F.coalesce(F.col("user_id").cast("string"), F.lit(ANONYMOUS)).alias("identity"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("idem_key"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("target"),
        F.col("props").alias("body"),
        F.when(F.col("event_type") == "error", 503).otherwise(201).alias("backend_status"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever the case of its name; null if there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), 0)["value"]


def path_of(target: Column) -> Column:
    return F.substring_index(target, "?", 1)


def _length(text: Column) -> Column:
    """A header's value as a length; 0 where it is none."""
    return F.coalesce(F.when(F.regexp_like(text, F.lit(r"^\+?[0-9]+$")), F.try_to_number(F.ltrim(text, F.lit("+")), F.lit("9" * 18))).cast("long"), F.lit(0).cast("long"))


def _headers(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))


def _parts(raw: DataFrame, column: str) -> DataFrame:
    """``raw`` with the words of the first line, the header lines, the headers and the rest as bytes."""
    text = F.regexp_replace(F.col(column), "\r\n", "\n")
    # the head ends before the first empty line; the body is counted in bytes of the original
    head = F.split_part(text, F.lit("\n\n"), F.lit(1))
    mark = F.regexp_instr(F.col(column), F.lit(r"\r?\n\r?\n"))
    tail = F.when(mark > 0, F.regexp_replace(F.substr(F.col(column), mark), r"^\r?\n\r?\n", "")).otherwise("")
    out = raw.withColumns({"__head": head, "__tail": tail.cast("binary")})
    lines = F.array_compact(F.transform(F.split("__head", "\n"), lambda x: F.when(x != "", x)))
    out = out.withColumns({"__first": F.split(F.get(lines, 0), " "), "__lines": F.slice(lines, 2, 1 << 30)})
    return out.withColumn("__headers", _headers(F.col("__lines")))


_BAD_HEADER = "malformed header line"


def _no_colon() -> Column:
    return F.exists("__lines", lambda x: ~F.contains(x, F.lit(":")))


def parsed(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` with ``request`` struct<method, target, headers, body> and ``error``.

    The request is null where the text is empty (a clean end, no error), where the first line has no method or target,
    where a header line has no colon, and where the body is shorter than its Content-Length. What follows the body is
    left out.
    """
    out = _parts(raw, column)
    size = _length(header(F.col("__headers"), "Content-Length"))
    method, target = F.coalesce(F.get("__first", 0), F.lit("")), F.coalesce(F.get("__first", 1), F.lit(""))
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    error = (
        F.when(empty, F.lit(None))
        .when((method == "") | (target == ""), "malformed request line")
        .when(_no_colon(), _BAD_HEADER)
        .when(F.octet_length("__tail") < size, "body too short")
    )
    request = F.struct(method.alias("method"), target.alias("target"), F.col("__headers").alias("headers"), F.substring(F.col("__tail"), F.lit(1), size.cast("int")).alias("body"))
    return out.withColumns({"error": error, "request": F.when(error.isNull() & ~empty, request)}).select(*raw.columns, "request", "error")


def parsed_response(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` with ``response`` struct<status, headers, body> and ``error``. Without a readable Content-Length the body
    is all that follows the head; an empty text is an error here."""
    out = _parts(raw, column)
    stated = header(F.col("__headers"), "Content-Length")
    whole = stated.isNull() | ~F.regexp_like(stated, F.lit(r"^\+?[0-9]+$"))
    size = F.when(whole, F.octet_length("__tail").cast("long")).otherwise(_length(stated))
    code = F.get("__first", 1)
    status = F.when(F.regexp_like(code, F.lit("^[0-9]{1,5}$")), code.cast("int"))
    status = F.when(status <= 65535, status)
    error = (
        F.when(F.coalesce(F.col(column), F.lit("")) == "", "empty response").when(status.isNull(), "bad status line")
        .when(_no_colon(), _BAD_HEADER).when(F.octet_length("__tail") < size, "body too short")
    )
    response = F.struct(status.alias("status"), F.col("__headers").alias("headers"), F.substring(F.col("__tail"), F.lit(1), size.cast("int")).alias("body"))
    return out.withColumns({"error": error, "response": F.when(error.isNull(), response)}).select(*raw.columns, "response", "error")


def reason(status: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, status.cast("int")), F.lit("Status"))


def _lines(headers: Column, own: tuple[str, ...]) -> Column:
    kept = F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*own))
    return F.array_join(F.transform(kept, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")


def rendered_response(status: Column, headers: Column, body: Column) -> Column:
    """A response as text; its Content-Length is that of the body, whatever the headers say."""
    return F.concat(
        F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), reason(status), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n"), _lines(headers, ("content-length",)), F.lit("\r\n"), body,
    )


def rendered_request(method: Column, target: Column, headers: Column, body: Column) -> Column:
    """A request as it is forwarded: one to a connection, with its own length."""
    return F.concat(
        method, F.lit(" "), target, F.lit(" HTTP/1.1\r\n"), _lines(headers, ("content-length", "connection")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\nConnection: close\r\n\r\n"), body,
    )


def within_cap(requests: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with status 413) by size of the body; a null one is empty."""
    fits = F.coalesce(F.octet_length("body"), F.lit(0)) <= cap
    return requests.where(fits), requests.where(~fits).withColumn("status", F.lit(413))


def outcome_headers(headers: Column) -> Column:
    """Headers as a map; of repeated names the last counts."""
    last = F.filter(headers, lambda h, i: ~F.exists(F.slice(headers, i + 2, F.size(headers)), lambda o: o["name"] == h["name"]))
    return F.map_from_entries(F.array_sort(last))
