"""Not-modified revisits of a web archive, resolved against the captures they stand for.

A revisit record says that a page had not changed; its body is that of an earlier full response.
As-of join: per canonical URL the latest response strictly before the revisit, whose validators must agree. The
headers of the revisit then update those of the response, as far as a 304 answer may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: header fields of a 304 answer that never update a stored response; parameters that only track. ---
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING_PREFIX = "utm_"
# --- End of fixed values. ---

#: Seconds of one slot of the as-of join; a URL's captures are sorted slot by slot.
SLOT_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Key under which captures of one page meet; null without ``://``.

    Scheme and fragment go; host in lower case without ``www.`` and default port; no slash at the
    end of the path; tracking parameters go, the others are sorted.
    """
    no_fragment = F.regexp_extract(url, r"(?s)^[^#]*?://([^#]*)", 1)
    host = F.regexp_replace(
        F.regexp_replace(F.lower(F.regexp_extract(no_fragment, r"(?s)^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", ""
    )
    path = F.regexp_replace(F.regexp_extract(no_fragment, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(no_fragment, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith(TRACKING_PREFIX)))
    return F.when(
        url.contains("://"),
        F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")),
    )


def with_lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then collide, the first in order stays."""
    entries = F.map_entries(headers)
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(
        F.transform(lower, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: F.array_position(F.transform(lower, lambda x: x["key"]), e["key"]) == e["i"] + 1,
    )
    return F.map_from_entries(
        F.transform(first, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    )


def merged_headers(stored: Column, update: Column) -> Column:
    """``stored`` with the permitted fields of ``update``; both with lower-case names."""
    permitted = F.map_filter(update, lambda k, v: ~k.isin(*NOT_UPDATED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(permitted), k))
    return F.map_concat(kept, permitted)


def validator_state(stored: Column, update: Column) -> Column:
    """``resolved`` if the validators agree: the entity tag by weak comparison where the revisit
    has one, else the modification date, else both sides must have none."""

    def tag(headers: Column) -> Column:
        return F.regexp_replace(headers["etag"], r"^W/", "")

    by_tag = F.coalesce(tag(stored) == tag(update), F.lit(False))
    by_date = F.coalesce(stored["last-modified"] == update["last-modified"], F.lit(False))
    none = stored["etag"].isNull() & stored["last-modified"].isNull()
    agrees = (
        F.when(update["etag"].isNotNull(), by_tag).when(update["last-modified"].isNotNull(), by_date).otherwise(none)
    )
    return F.when(agrees, "resolved").otherwise("validator_mismatch")


def latest_earlier(records: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """(record_id, refers_to) of every revisit: the latest response of its key strictly before it.

    Works on ids and times only. Each URL's time is cut into slots: the last response of every
    slot is found with map-side aggregation and carried to later slots, and rows are sorted
    within one (URL, slot). So a URL with a third of all captures is spread over its slots.
    """
    events = records.where(F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()).select(
        "record_id", "url_key", "captured_at", F.col("kind") == "response",
        F.floor(F.col("captured_at") / slot_seconds).alias("slot"),
    ).toDF("record_id", "url_key", "captured_at", "full", "slot")
    found = F.struct("captured_at", "record_id")
    per_slot = events.groupBy("url_key", "slot").agg(F.max(F.when(F.col("full"), found)).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slot.select(
        "url_key", "slot", F.last("last", ignorenulls=True).over(before).alias("carried")
    ).where(F.col("carried").isNotNull())
    # at equal times revisits come first: a response of the same moment is not earlier
    within = (
        Window.partitionBy("url_key", "slot")
        .orderBy("captured_at", "full", "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = events.withColumn(
        "inside", F.last(F.when(F.col("full"), found), ignorenulls=True).over(within)
    ).where(~F.col("full"))
    return inside.join(carried, ["url_key", "slot"], "left").select(
        "record_id", F.coalesce(F.col("inside"), F.col("carried"))["record_id"].alias("refers_to")
    )


def resolve_revisits(records: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per revisit of ``records`` (record_id, uri, captured_at in seconds, kind
    ``response`` or ``revisit``, headers as a map, payload_digest).

    Columns: record_id, url_key, captured_at, state, refers_to, headers, payload_digest.
    ``state`` is resolved, validator_mismatch, or orphan (no earlier response, or uri or time
    missing); refers_to, headers and payload_digest are set for resolved revisits only. Bodies stay where they are:
    refers_to names the record that has them.

    Equal times: a response does not answer a revisit of the same second; of responses at one time the
    largest record_id counts. Repeated rows count once. Null headers: none. Other kinds and null
    record_ids are ignored, other columns too. Empty table: no rows.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    keyed = (
        records.where(F.col("record_id").isNotNull() & F.col("kind").isin("response", "revisit"))
        .select("record_id", canonical_url(F.col("uri")).alias("url_key"), "captured_at", "kind",
                with_lower_names(headers).alias("headers"), "payload_digest")
        .dropDuplicates(["record_id"])
    )
    joined = latest_earlier(keyed, slot_seconds)
    stored = keyed.where(F.col("kind") == "response").select(
        F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"), F.col("payload_digest").alias("digest")
    )
    revisits = keyed.where(F.col("kind") == "revisit").drop("kind", "payload_digest")
    state = F.when(F.col("refers_to").isNull(), "orphan").otherwise(
        validator_state(F.col("stored"), F.col("headers"))
    )
    done = F.col("state") == "resolved"
    return (
        revisits.join(joined, "record_id", "left")
        .join(stored, "refers_to", "left")
        .withColumn("state", state)
        .select(
            "record_id",
            "url_key",
            "captured_at",
            "state",
            F.when(done, F.col("refers_to")).alias("refers_to"),
            F.when(done, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"),
            F.when(done, F.col("digest")).alias("payload_digest"),
        )
    )
