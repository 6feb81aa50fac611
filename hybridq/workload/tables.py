"""Input tables of the workload, derived from the given Parquet tables.

One SQL text serves Spark and DuckDB: `dialect` swaps the three names that differ.
No table is cut down: every view reads all rows of its sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hybridq.operators.embedding import index_build
from hybridq.operators.filters import listing_words
from hybridq.plans.stages import materialise

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

CITIES = "Bangalore|Hyderabad|Pune|Chennai|Mumbai|Gurgaon|Noida|Ahmedabad|Kochi|Kolkata|Jaipur"
TECH = "Java|AWS|React|Python|Kubernetes|Spring Boot|SQL|Docker|Kafka|Go|C#|.NET|Machine Learning"

VIEWS: dict[str, tuple[list[str], str]] = {}

VIEWS["listings"] = (
    ["part", "supplier", "nation", "region", "documents"],
    f"""
SELECT k.p_partkey AS id, k.p_name AS title, k.p_brand AS company,
 concat(split_part('{CITIES}', '|', CAST(n.n_nationkey % 11 AS INT) + 1), ', ', n.n_name, ', ', r.r_name) AS location,
 (k.p_size % 3 = 0) AS remote,
 CASE k.p_type WHEN 'PROMO' THEN 'INTERNSHIP' WHEN 'SMALL' THEN 'PART_TIME' WHEN 'ECONOMY' THEN 'CONTRACT'
   ELSE 'FULL_TIME' END AS employment_type,
 CAST(k.p_size % 13 AS INT) AS experience_min,
 CAST(k.p_size % 13 + 1 + k.p_size % 4 AS INT) AS experience_max,
 CAST(k.p_size AS BIGINT) * 50000 + 300000 AS salary_min,
 CAST(k.p_size AS BIGINT) * 50000 + 500000 + (k.p_partkey % 7) * 50000 AS salary_max,
 CASE WHEN k.p_size = 50 THEN 'USD' ELSE 'INR' END AS currency,
 split(concat_ws('|', replace(k.p_name, ' ', '|'), lower(k.p_type),
   split_part('{TECH}', '|', CAST(k.p_partkey % 13 AS INT) + 1),
   split_part('{TECH}', '|', CAST((k.p_partkey + 1 + k.p_size) % 13 AS INT) + 1)), '[|]') AS skills,
 d.text AS description,
 split(concat_ws('|', k.p_name, concat('Brand ', k.p_brand), concat('Works with ', lower(k.p_type), ' parts.'),
   CASE WHEN k.p_size % 5 <> 0 THEN concat('Size ', CAST(k.p_size AS STRING)) END), '[|]') AS requirements,
 split(concat_ws('|', k.p_brand, k.p_name, 'Ship orders on time.', 'Keep data pipelines healthy'), '[|]') AS responsibilities,
 split(concat_ws('|', lower(k.p_type), 'insurance', CASE WHEN k.p_size % 2 = 0 THEN 'free lunch' END), '[|]') AS benefits,
 CAST(CASE WHEN k.p_partkey % 31 = 5 THEN NULL ELSE DATE '2024-01-01' + CAST(k.p_partkey % 85 AS INT) END AS DATE) AS posted_date,
 concat('https://example.com/items/', CAST(k.p_partkey AS STRING)) AS application_url
FROM (SELECT p.*, p_partkey % (SELECT count(*) FROM supplier) AS sup_key,
        p_partkey % (SELECT count(*) FROM documents) AS doc_key FROM part p) k
JOIN supplier s ON s.s_suppkey = k.sup_key
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN documents d ON d.doc_id = k.doc_key
""",
)

# one search per supplier: skills, keywords only, or no topic at all
VIEWS["query_log"] = (
    ["supplier", "part", "nation"],
    """
SELECT k.s_suppkey AS query_id,
 concat('Find ', CASE WHEN k.s_suppkey % 3 = 0 THEN 'remote ' ELSE '' END, p.p_name, ' jobs in ', n.n_name,
   ' with ', CAST(k.s_suppkey % 10 AS STRING), ' years experience above ', CAST(5 + k.s_suppkey % 20 AS STRING), ' LPA') AS text,
 CASE WHEN k.s_suppkey % 4 <> 3 THEN p.p_name END AS skill_words,
 CASE WHEN k.s_suppkey % 8 = 3 THEN concat(p.p_name, ' data') END AS keyword_words,
 CASE WHEN k.s_suppkey % 5 <> 1 THEN n.n_name END AS location,
 CASE WHEN k.s_suppkey % 3 = 0 THEN TRUE WHEN k.s_suppkey % 11 = 1 THEN FALSE END AS remote,
 CASE WHEN k.s_suppkey % 2 = 0 THEN CAST(k.s_suppkey % 10 AS INT) END AS experience_min,
 CASE WHEN k.s_suppkey % 2 = 0 OR k.s_suppkey % 9 = 1 THEN CAST(k.s_suppkey % 10 AS INT) END AS experience_max,
 CASE WHEN k.s_suppkey % 4 <> 1 THEN CAST((5 + k.s_suppkey % 20) * 100000 AS BIGINT) END AS salary_min,
 CASE WHEN k.s_suppkey % 7 = 2 THEN CAST((9 + k.s_suppkey % 20) * 100000 AS BIGINT) END AS salary_max,
 CASE WHEN k.s_suppkey % 5 = 0 THEN 'FULL_TIME' END AS employment_type
FROM (SELECT s.*, (s_suppkey * 7) % (SELECT count(*) FROM part) AS part_key FROM supplier s) k
JOIN part p ON p.p_partkey = k.part_key
JOIN nation n ON n.n_nationkey = k.s_nationkey
""",
)

# one message per customer, mixing every kind of wording the parser knows
VIEWS["requests"] = (
    ["customer"],
    """
SELECT c_custkey AS query_id, (c_custkey % 3 <> 0) AS has_previous,
 concat_ws(' ',
  nullif(split_part('Find|Show me|Compare|Only|What about|Tell me more about|hello|Looking for|Which of these are|thanks', '|', CAST(c_custkey % 10 AS INT) + 1), ''),
  nullif(split_part('remote|on-site||not remote|work from home||in-office|WFH', '|', CAST(c_custkey % 8 AS INT) + 1), ''),
  nullif(split_part('Java and springboot|k8s, Docker|react native / React|node js|C# or .NET|go developer|Go developer|golang + REST APIs|machine learning (ML)|CI/CD pipelines|github actions & Git||rest api|postgres|Express checkout|express.js|asp.net core|power bi||SQL,SQL;sql', '|', CAST(c_custkey % 20 AS INT) + 1), ''),
  nullif(split_part('jobs|roles|backend engineer positions|openings for testers|the first job|the last one|first three jobs|job #1042|#77 and #205|cloud data work|2 and 4||the second and third role', '|', CAST(c_custkey % 13 AS INT) + 1), ''),
  nullif(split_part('in Bengaluru|in Pune, India|near Hyd|||in India|Mumbai or Chennai', '|', CAST(c_custkey % 7 AS INT) + 1), ''),
  nullif(split_part('3-5 years|under 5 years|at most 4 yrs|more than 6 years experience|7+ years||2 years|fresher|0 to 1 yr||less than 1 year', '|', CAST(c_custkey % 11 AS INT) + 1), ''),
  nullif(split_part('12-18 LPA|above 10 lpa|up to 25 lakhs|15.5 LPA|min 8 lakh max 20 lakh||₹9 lacs||from 6 to 9 l|', '|', CAST(c_custkey % 17 AS INT) + 1), ''),
  nullif(split_part('internship|part-time|contract|full time|permanent||', '|', CAST(c_custkey % 19 AS INT) + 1), ''),
  CASE WHEN c_custkey % 4 = 1 THEN concat('for ', lower(c_mktsegment), ' clients?') END
 ) AS text
FROM customer
""",
)

VIEWS["messages"] = (
    ["conversations"],
    """
SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, upper(role) AS role, text,
 timestamp_seconds((1704067200 + conv_id * 7200 + turn * 60)) AS ts
FROM conversations
""",
)

# item events: errors and views unsave, all others save; the item comes from the event number
VIEWS["save_events"] = (
    ["events", "part"],
    """
SELECT event_id, ts, user_id, CASE WHEN event_type IN ('error', 'view') THEN 'unsave' ELSE 'save' END AS action,
 event_id % ((SELECT count(*) FROM part) + 50) AS id
FROM events
""",
)

# some ratings name unknown values, some name messages that do not exist
VIEWS["ratings"] = (
    ["events", "conversations"],
    """
SELECT e.event_id, e.ts, e.conv * 1000 + e.event_id % 7 AS message_id,
 CASE e.event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' WHEN 'signup' THEN 'sideways' END AS rating
FROM (SELECT ev.*, event_id % ((SELECT max(conv_id) FROM conversations) + 3) AS conv FROM events ev) e
""",
)


def duck_sql(text: str) -> str:
    out = text.replace("'[|]'", "'|'").replace("split(", "string_split(").replace("AS STRING", "AS VARCHAR")
    return out.replace("timestamp_seconds(", "make_timestamp(1000000 * ")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over named DataFrames: every `FROM name` / `JOIN name` becomes that frame."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        for lead in ("FROM ", "JOIN "):
            for end in (" ", ")", "\n"):
                text = text.replace(f"{lead}{name}{end}", f"{lead}{{{name}}}{end}")
    return spark.sql(text, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or one of the derived views, as a DataFrame."""
    if name in BASE:
        return base(spark, sf_dir, name)
    needs, text = VIEWS[name]
    frames = {n: view(spark, sf_dir, n) for n in needs}
    if name == "requests":
        # a file is one task where it has one row group, and what is read from a message costs far more than its row
        frames["customer"] = frames["customer"].repartition("c_custkey")
    return run_sql(spark, text, **frames)


_STAGES: dict = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that many queries start from, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = materialise(build(), name)
    return _STAGES[key]


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, dealt out before the texts are joined, so that they are shuffled once."""
    needs, text = VIEWS["listings"]
    frames = {n: view(spark, sf_dir, n) for n in needs}
    return run_sql(spark, text, **frames | {"part": frames["part"].repartition("p_partkey")})


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "listings", lambda: _listings(spark, sf_dir))


def listing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings without their descriptions: queries that ask for facts only move no texts."""
    return staged(spark, sf_dir, "listing_facts", lambda: _listings(spark, sf_dir).drop("description"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all listings."""
    return staged(spark, sf_dir, "words", lambda: listing_words(listings(spark, sf_dir)))


def listing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all listings with their vectors."""
    return staged(spark, sf_dir, "index", lambda: index_build(listings(spark, sf_dir)))


#: Whole vectors as two whole numbers a chunk: how many entries, and their rounded values weighted by place.
VECTOR_SUM = "count(val) AS entries, CAST(sum(CAST(floor(val * 1e6 + 0.5) AS BIGINT) * (idx + 1)) AS BIGINT) AS vector_sum"


def vector_sums(index: DataFrame) -> DataFrame:
    """(document_id, entries, vector_sum) of an index with idx and val."""
    weigh = F.zip_with("idx", "val", lambda i, v: F.floor(v * 1e6 + F.lit(0.5)).cast("long") * (i + 1))
    total = F.aggregate(weigh, F.lit(0).cast("long"), lambda a, x: a + x)
    return index.select("document_id", F.size("val").cast("long").alias("entries"), total.alias("vector_sum"))


def criteria_of(df: DataFrame) -> DataFrame:
    """query_log with its columns gathered in a criteria struct."""
    from hybridq.operators.understanding import criteria_struct

    c = F.col
    words = lambda name: F.when(c(name).isNotNull(), F.split(name, " "))
    return df.select(
        "query_id",
        "text",
        criteria_struct(
            keywords=words("keyword_words"), skills=words("skill_words"), location=c("location"), remote=c("remote"),
            experience_min=c("experience_min"), experience_max=c("experience_max"), salary_min=c("salary_min"),
            salary_max=c("salary_max"), employment_type=c("employment_type"),
        ).alias("criteria"),
    )


def query_log(spark, sf_dir):
    return criteria_of(view(spark, sf_dir, "query_log"))
