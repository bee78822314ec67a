"""Not-modified revisits of web captures, resolved to earlier full responses.

A revisit record says that a page had not changed; its payload is that of the
latest earlier full response for the same canonical URL, if the validators
agree.  The as-of join has two levels: within (URL, time bucket) a window
finds the latest response before each revisit, and one row per (URL, bucket)
carries the latest response on to later buckets.  A URL with a third of all
captures is spread over its buckets; the second level sees at most `buckets`
rows of it.

Records: record_id, kind (response or revisit), url, ts, status, etag,
last_modified, headers map<string,string> (lower-case names), digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 may update in a stored response (RFC 9110, 15.4.5, and validators); fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical(url: Column) -> Column:
    """Scheme, its default port, `www.`, fragment, tracking parameters, dot segments and a closing slash go; the host is lower-cased and hexadecimal digits after a `%` are upper-cased.

    The order of parameters stays: it can matter.  Null stays null.
    """
    secure = F.lower(url).startswith("https://")
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", "")
    host = F.when(secure, F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    kept = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", r"$1")
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    kept = F.array_join(F.transform(F.split(kept, "%"), lambda x, i: F.when((i > 0) & x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), x.substr(F.lit(3), F.length(x)))).otherwise(x)), "%")
    path, query = F.regexp_extract(kept, r"^([^?]*)", 1), F.regexp_extract(kept, r"^[^?]*(.*)$", 1)
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    dotted = path.contains("/.")
    plain = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), up), "/")
    return F.concat(host, F.regexp_replace(F.concat(F.when(dotted, plain).otherwise(path), query), r"/+$", ""))


def header_lines(headers: Column) -> Column:
    """name: value lines, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resolve(records: DataFrame, buckets: int = 256) -> DataFrame:
    """Each revisit with what it stands for.

    outcome: `resolved`, `mismatch` (a response was found whose validators
    differ; also where the revisit has none), `orphan` (none earlier, or no
    URL).  If the revisit has an ETag it alone decides, compared weakly;
    otherwise Last-Modified.  Only resolved rows have digest, status and headers:
    the response's, with the permitted ones of the revisit put in.  Of
    responses at one time the larger record_id counts; only responses of status
    200 are full (a 206 is a part, and a redirect or an error is no page); a response at the
    revisit's own time is not earlier.  Records without a time are orphans if
    revisits and are not found if responses.  Repeated revisits stay.
    """
    keyed = records.select("record_id", "kind", canonical(F.col("url")).alias("canonical_url"), "ts", "status", "etag", "last_modified", "headers", "digest")
    lo, hi = keyed.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // buckets + 1)
    whole = F.struct("ts", "record_id", "etag", "last_modified", "status", "digest", F.array_sort(F.map_entries("headers")).alias("headers"))
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull(), whole)
    known = keyed.where(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull())
    at = known.withColumn("bucket", F.floor((F.col("ts") - F.lit(lo or 0)) / width)).withColumn("full", full)
    key = ["canonical_url", "bucket"]
    before = Window.partitionBy(*key).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = at.withColumn("found", F.max("full").over(before)).where(F.col("kind") == "revisit").drop("full")
    carried = at.groupBy(*key).agg(F.max("full").alias("full"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*key, F.max("full").over(earlier).alias("carried"))
    found = near.join(carried, key, "left").withColumn("r", F.coalesce("found", "carried")).drop("found", "carried", "bucket")
    lost = keyed.where((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("ts").isNull())).withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    every = found.unionByName(lost)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    agrees = F.when(F.col("etag").isNotNull(), weak(F.col("etag")) == weak(F.col("r.etag"))).otherwise(F.col("last_modified") == F.col("r.last_modified"))
    outcome = F.when(F.col("r").isNull(), "orphan").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    ours = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    theirs = F.filter(F.coalesce("r.headers", F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.map_contains_key(ours, e["key"]))
    merged = F.map_concat(F.map_from_entries(theirs), ours)
    done = F.col("outcome") == "resolved"
    return every.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", "outcome", F.col("r.record_id").alias("response_id"),
        F.when(done, F.col("r.status")).alias("status"), F.when(done, F.col("r.digest")).alias("digest"), F.when(done, merged).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A capture log over pages: of each, a full response and four revisits.

    Before the response (an orphan unless another page has its canonical URL),
    then with its ETag in weak form, with only its Last-Modified, and with an
    ETag that has changed.
    """
    tag, modified = F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"')), F.concat(F.lit("day "), F.pmod(F.col("page_id"), F.lit(28)).cast("string"))
    t = F.col("page_id") * 10
    null = F.lit(None).cast("string")

    def row(k: int, kind: str, status: int, etag: Column, last: Column) -> Column:
        names = {"date": F.concat(F.lit("t"), (t + k).cast("string"))}
        if kind == "response":
            names |= {"content-type": F.lit("text/html"), "content-length": F.octet_length("html").cast("string"), "cache-control": F.lit("max-age=60"), "etag": etag, "last-modified": last}
        else:
            names |= {"content-length": F.lit("0"), "server": F.lit("cache"), "cache-control": F.lit("max-age=" + str(600 + k))}
        heads = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in names.items()]), lambda e: e["value"].isNotNull()))
        return F.struct(
            (F.col("page_id") * 5 + k).alias("record_id"), F.lit(kind).alias("kind"), "url", (t + k).alias("ts"), F.lit(status).alias("status"),
            etag.alias("etag"), last.alias("last_modified"), heads.alias("headers"), (F.md5(F.col("html")) if kind == "response" else null).alias("digest"),
        )

    rows = [row(0, "revisit", 304, tag, modified), row(1, "response", 200, tag, modified), row(2, "revisit", 304, F.concat(F.lit("W/"), tag), null), row(3, "revisit", 304, null, modified), row(4, "revisit", 304, F.concat(F.lit('"'), F.md5(F.col("url")), F.lit('"')), modified)]
    return pages.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: captures() and resolve() in one statement over pages, with header_lines of the merged headers.
SQL = r"""
with p as (
  select page_id, url, html, page_id * 10 as t, '"' || md5(html) || '"' as tag, 'day ' || cast(page_id % 28 as varchar) as modified from pages
), rec as (
  select page_id * 5 as record_id, 'revisit' as kind, url, t as ts, tag as etag, modified, 600 as age, null as digest, null as size from p
  union all select page_id * 5 + 1, 'response', url, t + 1, tag, modified, 60, md5(html), octet_length(encode(html)) from p
  union all select page_id * 5 + 2, 'revisit', url, t + 2, 'W/' || tag, null, 602, null, null from p
  union all select page_id * 5 + 3, 'revisit', url, t + 3, null, modified, 603, null, null from p
  union all select page_id * 5 + 4, 'revisit', url, t + 4, '"' || md5(url) || '"', modified, 604, null, null from p
), bare as (
  select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from rec
), kept as (
  select *, regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.', '') as host,
    regexp_replace(regexp_extract(b, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g') as rest from bare
), keyed as (
  select *, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+$', '') as canonical_url from kept
), found as (
  select *, max(case when kind = 'response' then struct_pack(ts := ts, record_id := record_id, etag := etag, modified := modified, digest := digest, size := size) end)
    over (partition by canonical_url order by ts range between unbounded preceding and 1 preceding) as r from keyed
), judged as (
  select *, case when r is null then 'orphan'
    when coalesce(case when etag is not null then regexp_replace(etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') else modified = r.modified end, false) then 'resolved'
    else 'mismatch' end as outcome from found where kind = 'revisit'
)
select record_id, canonical_url, ts, outcome, r.record_id as response_id,
  case when outcome = 'resolved' then 200 end as status,
  case when outcome = 'resolved' then r.digest end as digest,
  case when outcome = 'resolved' then 'cache-control: max-age=' || cast(age as varchar) || chr(10) || 'content-length: ' || cast(r.size as varchar) || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: t' || cast(ts as varchar) || chr(10) || 'etag: ' || r.etag || chr(10) || 'last-modified: ' || r.modified end as header_lines
from judged
"""
