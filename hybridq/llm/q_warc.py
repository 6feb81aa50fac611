"""op6: fixity audit of all pages against a replica with planted damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq.llm.registry import query, table
from hybridq.llm.warc_fixity import END, FAN, FILE_RECORDS, archive, audit
from hybridq.plans.stages import materialise

# the replica: every 97th page has a changed byte, every 389th record is lost
CHANGED, LOST = "page_id % 97 = 13", "page_id % 389 = 7"

_UUID = "||'-'||".join(f"substr(h, {a}, {n})" for a, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)])
_NODE = "sha256(string_agg({p}idx || ':' || {p}low || ':' || {p}high || ':' || {p}hash, ',' ORDER BY {p}idx))"


def _level(name: str, below: str) -> str:
    return (
        f"{name} AS (SELECT file, idx // {FAN} AS idx, min(b.low) AS low, max(b.high) AS high, {_NODE.format(p='b.')} AS hash "
        f"FROM (SELECT * FROM {below}) b GROUP BY file, b.idx // {FAN})"
    )


SQL = f"""
WITH r AS (
  SELECT page_id, page_id // {FILE_RECORDS} AS file, coalesce(url, '') AS u, coalesce(html, '') AS t, md5(coalesce(url, '') || chr(10) || coalesce(html, '')) AS h FROM pages
), w AS (
  SELECT page_id, file, 'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:' || {_UUID} || '>\r\nWARC-Target-URI: ' || u ||
    '\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: ' || strlen(t) || '\r\n\r\n' || t || '\r\n\r\n' AS rec FROM r
), o AS (
  SELECT page_id, file, row_number() OVER f - 1 AS idx, CAST(sum(strlen(rec)) OVER f AS BIGINT) - strlen(rec) AS low, CAST(sum(strlen(rec)) OVER f AS BIGINT) AS high, sha256(rec) AS hash
  FROM w WINDOW f AS (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING)
), {_level("l1", "o")}, {_level("l2", "l1")}, {_level("l3", "l2")}
SELECT o.page_id, o.file, o.idx AS seq, o.low AS "offset", o.high - o.low AS length, o.hash AS sha256, l3.hash AS root,
  CASE WHEN o.page_id % 389 = 7 THEN 'missing' WHEN o.page_id % 97 = 13 THEN 'corrupt' ELSE 'sound' END AS status
FROM o JOIN l3 USING (file)
""".replace("\\r\\n", "' || chr(13) || chr(10) || '").replace("\r\n", "' || chr(13) || chr(10) || '")


@query("op6_warc_fixity", SQL)
def op6(spark, sf_dir):
    records = archive(table(spark, sf_dir, "pages"))
    damaged = F.overlay("record", F.lit("warc"), 1, 4)  # one changed byte is as good as four
    columns = ["file", "piece", "seq", "offset", "length", "page_id"]
    both = materialise(
        records.select(
            *columns, F.sha2(F.concat("record", F.lit(END)), 256).alias("ours"),
            F.when(F.expr(LOST), None).otherwise(F.sha2(F.concat(F.when(F.expr(CHANGED), damaged).otherwise(F.col("record")), F.lit(END)), 256)).alias("theirs"),
        ),
        "replicas",
    )
    place = [F.col("file"), F.col("piece"), F.col("seq").alias("idx"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high")]
    ours, theirs = both.select(*place, F.col("ours").alias("hash")), both.where("theirs IS NOT NULL").select(*place, F.col("theirs").alias("hash"))
    damage, roots = audit(ours, theirs)
    found = both.withColumnRenamed("seq", "idx").join(damage, ["file", "piece", "idx"], "left").join(
        roots.select("file", "piece", F.col("hash").alias("root")), ["file", "piece"]
    )
    return found.select(
        "page_id", "file", F.col("idx").alias("seq"), "offset", "length", F.col("ours").alias("sha256"), "root",
        F.coalesce("status", F.lit("sound")).alias("status"),
    )
