"""Queries of the catalogue input operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq import vocab
from hybridq.operators.embedding import index_build, index_manifest, index_status
from hybridq.schema import JSON_NAMES
from hybridq.plans.refresh import refresh_index
from hybridq.plans.stages import materialise, stage_path
from hybridq.sources import listings as L
from hybridq.sources.catalogue_store import catalogue_read, catalogue_sync, catalogue_write
from hybridq.sources.index_store import index_read, index_write
from hybridq.workload.duck import cte, with_ctes
from hybridq.workload.registry import query
from hybridq.workload.tables import VECTOR_SUM, listing_facts, listings, run_sql, vector_sums, view

FLAT_LISTS = ["skills", "requirements", "responsibilities", "benefits"]
LISTING_COLS = [
    "id", "title", "company", "location", "remote", "employment_type", "experience_min", "experience_max",
    "salary_min", "salary_max", "currency", "description", "application_url",
]


def flat(name):
    return F.array_join(F.col(name).cast("array<string>"), "|").alias(name)


def scratch(spark) -> str:
    return stage_path(spark, "job")


def as_json_names(df):
    return df.select(*[F.col(n).alias(j) for n, j in JSON_NAMES.items() if n in df.columns])


DUCK_FLAT = ", ".join(
    [*LISTING_COLS, *[f"array_to_string({n}, '|') AS {n}" for n in FLAT_LISTS], "CAST(posted_date AS VARCHAR) AS posted_date"]
)


@query("load_listings", with_ctes(f"SELECT {DUCK_FLAT} FROM listings", "listings"))
def load_listings(spark, sf):
    """Write the catalogue as JSON lines, read it back."""
    path = scratch(spark)
    rows = as_json_names(listings(spark, sf))
    rows.write.mode("overwrite").json(f"{path}/lines")
    loaded = L.normalise_listings(L.load_listings(spark, f"{path}/lines", envelope=False))
    return loaded.select(*LISTING_COLS, *[flat(n) for n in FLAT_LISTS], F.col("posted_date").cast("string").alias("posted_date"))


@query("load_envelopes", with_ctes(f"SELECT {DUCK_FLAT} FROM listings", "listings"))
def load_envelopes(spark, sf):
    """Write the catalogue as envelope files of about 200 listings each, read them back."""
    path, rows = scratch(spark), listings(spark, sf)
    files = -(-rows.count() // 200)
    job = F.struct(*as_json_names(rows).columns)
    jobs = as_json_names(rows).select(F.pmod(F.xxhash64("id"), F.lit(files)).alias("file"), job.alias("job"))
    envelope = F.struct(F.lit("catalogue").alias("dataset"), F.lit("unknown to the reader").alias("note"), F.collect_list("job").alias("jobs"))
    jobs.groupBy("file").agg(F.to_json(envelope).alias("value")).write.partitionBy("file").text(f"{path}/envelopes")
    loaded = L.normalise_listings(L.load_listings(spark, f"{path}/envelopes/*/*.txt"))
    return loaded.select(*LISTING_COLS, *[flat(n) for n in FLAT_LISTS], F.col("posted_date").cast("string").alias("posted_date"))


# raw rows with holes: unset fields, swapped ranges
RAW = """
SELECT id, CASE WHEN id % 50 <> 0 THEN title END AS title, CASE WHEN id % 77 <> 3 THEN company END AS company,
 CASE WHEN remote OR id % 9 <> 0 THEN location END AS location,
 CASE WHEN id % 6 <> 1 THEN remote END AS remote, CASE WHEN id % 4 <> 2 THEN employment_type END AS employment_type,
 CASE WHEN id % 13 <> 4 THEN experience_min END AS experience_min,
 CASE WHEN id % 7 = 0 THEN 0 ELSE experience_max END AS experience_max,
 salary_min, CASE WHEN id % 8 = 0 THEN salary_min - 50000 ELSE salary_max END AS salary_max,
 CASE WHEN id % 3 = 0 THEN currency END AS currency, CASE WHEN id % 10 <> 0 THEN skills END AS skills,
 CASE WHEN id % 12 <> 0 THEN description END AS description, CASE WHEN id % 14 <> 0 THEN requirements END AS requirements,
 responsibilities, CASE WHEN id % 15 <> 0 THEN benefits END AS benefits, CAST(posted_date AS STRING) AS posted_date,
 application_url
FROM listings l
"""
cte("raw_listings", ["listings"], RAW.replace("AS STRING", "AS VARCHAR"))


def raw_listings(spark, sf):
    return run_sql(spark, RAW, listings=listings(spark, sf))


@query(
    "normalise_listings",
    with_ctes(
        """SELECT id, title, company, coalesce(location, 'Not specified') AS location, coalesce(remote, false) AS remote,
        coalesce(employment_type, 'FULL_TIME') AS employment_type, coalesce(experience_min, 0) AS experience_min,
        greatest(coalesce(experience_min, 0), coalesce(experience_max, 0)) AS experience_max, salary_min,
        greatest(salary_min, salary_max) AS salary_max, coalesce(currency, 'INR') AS currency,
        coalesce(description, '') AS description, application_url,
        coalesce(array_to_string(skills, '|'), '') AS skills, coalesce(array_to_string(requirements, '|'), '') AS requirements,
        array_to_string(responsibilities, '|') AS responsibilities, coalesce(array_to_string(benefits, '|'), '') AS benefits,
        posted_date FROM raw_listings""",
        "raw_listings",
    ),
)
def normalise(spark, sf):
    out = L.normalise_listings(raw_listings(spark, sf))
    return out.select(*LISTING_COLS, *[flat(n) for n in FLAT_LISTS], F.col("posted_date").cast("string").alias("posted_date"))


@query(
    "quarantine_listings",
    with_ctes(
        """SELECT id, CASE WHEN title IS NULL OR company IS NULL THEN 'rejected' ELSE 'ok' END AS verdict,
        concat_ws('|', CASE WHEN title IS NULL THEN 'missing title' END, CASE WHEN company IS NULL THEN 'missing company' END) AS reasons
        FROM raw_listings""",
        "raw_listings",
    ),
)
def quarantine(spark, sf):
    # no verdict asks for the text
    raw = run_sql(spark, RAW.replace("CASE WHEN id % 12 <> 0 THEN description END AS description, ", ""), listings=listing_facts(spark, sf))
    ok, bad = L.quarantine_listings(raw)
    return ok.select("id", F.lit("ok").alias("verdict"), F.lit("").alias("reasons")).unionByName(
        bad.select("id", F.lit("rejected").alias("verdict"), flat("reasons"))
    )


# earlier catalogue: posted up to 20 March; incoming one: posted since 10 January, remote titles changed
SYNC_OLD = "posted_date <= DATE '2024-03-20'"
SYNC_NEW = "posted_date >= DATE '2024-01-10' OR posted_date IS NULL"


@query(
    "sync_listings",
    with_ctes(
        f"""SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.title = n.title THEN 'unchanged'
        ELSE 'update' END AS change_type, coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title
        FROM (SELECT id, title FROM listings WHERE {SYNC_OLD}) o FULL JOIN
        (SELECT id, CASE WHEN remote THEN upper(title) ELSE title END AS title FROM listings WHERE {SYNC_NEW}) n ON o.id = n.id""",
        "listings",
    ),
)
def sync(spark, sf):
    rows = listings(spark, sf)
    incoming = rows.where(SYNC_NEW).withColumn("title", F.when(F.col("remote"), F.upper("title")).otherwise(F.col("title")))
    return L.sync_listings(rows.where(SYNC_OLD), incoming).select("change_type", "id", "title")


@query(
    "catalogue_sync",
    with_ctes(
        f"""SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.title = n.title THEN 'unchanged'
        ELSE 'update' END AS change_type, coalesce(n.id, o.id) AS id, n.title AS stored_title
        FROM (SELECT id, title FROM listings WHERE {SYNC_OLD}) o FULL JOIN
        (SELECT id, CASE WHEN remote THEN upper(title) ELSE title END AS title FROM listings WHERE {SYNC_NEW}) n ON o.id = n.id""",
        "listings",
    ),
)
def sync_stored(spark, sf):
    """The earlier catalogue is stored, then brought in step; what is stored and what was reported must agree."""
    rows, path = listings(spark, sf), scratch(spark)
    incoming = rows.where(SYNC_NEW).withColumn("title", F.when(F.col("remote"), F.upper("title")).otherwise(F.col("title")))
    catalogue_write(rows.where(SYNC_OLD), path)
    report = catalogue_sync(incoming, path)
    stored = catalogue_read(spark, path).select("id", F.col("title").alias("stored_title"))
    return stored.join(report, "id", "full_outer").withColumn("change_type", F.coalesce("change_type", F.lit("unchanged")))


_cells = ", ".join(
    f"coalesce(array_to_string({n}, chr(30)), '\\N')" if n in FLAT_LISTS else f"coalesce(CAST({n} AS VARCHAR), '\\N')"
    for n in sorted([*LISTING_COLS, *FLAT_LISTS, "posted_date"])
)
cte("row_hashes", ["listings"], f"SELECT id, sha256(concat_ws(chr(31), {_cells}, '{vocab.CHUNKING_VERSION}')) AS row_hash FROM listings")


@query("row_fingerprints", with_ctes("SELECT id, row_hash FROM row_hashes", "row_hashes"))
def row_fingerprints(spark, sf):
    return L.row_fingerprints(listings(spark, sf))


_sums = ", ".join(
    f"CAST(sum(('0x' || substr(row_hash, {1 + 15 * i}, 15))::BIGINT) AS VARCHAR)" for i in range(4)
)


@query(
    "dataset_fingerprint",
    with_ctes(
        f"SELECT n_rows, sha256(concat_ws(':', CAST(n_rows AS VARCHAR), sums)) AS dataset_hash FROM "
        f"(SELECT count(*) AS n_rows, concat_ws(':', {_sums}) AS sums FROM row_hashes)",
        "row_hashes",
    ),
)
def dataset_fingerprint(spark, sf):
    return L.dataset_fingerprint(L.row_fingerprints(listings(spark, sf)))


@query(
    "stale_index_plan",
    with_ctes(
        f"""SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'drop' WHEN n.row_hash = o.row_hash AND
        o.provider = 'local' THEN 'keep' ELSE 'rebuild' END AS action FROM
        (SELECT h.id, CASE WHEN l.remote THEN reverse(h.row_hash) ELSE h.row_hash END AS row_hash FROM row_hashes h JOIN listings l ON l.id = h.id
          WHERE {SYNC_NEW}) n FULL JOIN
        (SELECT h.id, h.row_hash, CASE l.employment_type WHEN 'CONTRACT' THEN 'remote' ELSE 'local' END AS provider
          FROM row_hashes h JOIN listings l ON l.id = h.id WHERE {SYNC_OLD}) o ON o.id = n.id""",
        "row_hashes",
    ),
)
def stale_plan(spark, sf):
    rows = listings(spark, sf)
    hashes = L.row_fingerprints(rows)
    tagged = hashes.join(rows.select("id", "remote", "employment_type", "posted_date"), "id")
    now = tagged.where(SYNC_NEW).select(
        "id", F.when(F.col("remote"), F.reverse("row_hash")).otherwise(F.col("row_hash")).alias("row_hash")
    )
    provider = F.when(F.col("employment_type") == "CONTRACT", "remote").otherwise("local")
    old = tagged.where(SYNC_OLD).select("id", "row_hash", provider.alias("provider"), F.lit("m").alias("model"))
    return L.stale_index_plan(now, old, "local", "m")


# quality: some duplicated ids, equal salaries, odd skill counts
DIRTY = """
SELECT id, title, company, location, remote, employment_type, experience_min,
 CASE WHEN id % 17 = 2 THEN experience_min ELSE experience_max END AS experience_max, salary_min,
 CASE WHEN id % 40 = 0 THEN salary_min WHEN id % 33 = 1 THEN salary_max + 1 ELSE salary_max END AS salary_max, skills, requirements,
 responsibilities, posted_date
FROM listings l
UNION ALL SELECT id, title, company, location, remote, employment_type, experience_min, experience_max, salary_min, salary_max,
 skills, requirements, responsibilities, posted_date FROM listings l WHERE salary_min > 2700000
"""
cte("dirty_listings", ["listings"], DIRTY)
_allowed = ", ".join("'" + s + "'" for s in vocab.SKILLS)


cte(
    "violations",
    ["dirty_listings"],
    f"""SELECT id, unnest([CASE WHEN posted_date IS NULL THEN 'missing posted_date' END,
          CASE WHEN salary_min >= salary_max THEN 'salary_min >= salary_max' END,
          CASE WHEN salary_min % 50000 <> 0 OR salary_max % 50000 <> 0 THEN 'salary not rounded' END,
          CASE WHEN employment_type <> 'INTERNSHIP' AND experience_max <= experience_min THEN 'experience band' END,
          CASE WHEN len(skills) NOT BETWEEN 4 AND 8 THEN 'skills count ' || len(skills) END,
          CASE WHEN len(requirements) NOT BETWEEN 4 AND 6 THEN 'requirements count ' || len(requirements) END,
          CASE WHEN len(responsibilities) NOT BETWEEN 4 AND 6 THEN 'responsibilities count ' || len(responsibilities) END,
          CASE WHEN posted_date < DATE '2024-01-05' OR posted_date > DATE '2024-03-20' THEN 'posted_date out of range' END]) AS violation FROM dirty_listings
        UNION ALL SELECT id, 'bad skill ' || s FROM (SELECT id, unnest(skills) AS s FROM dirty_listings)
          WHERE s NOT IN ({_allowed}, 'economy', 'standard', 'small', 'medium', 'large', 'promo')""",
)


@query(
    "validate_listings",
    with_ctes(
        """SELECT id, violation, count(*) AS n FROM violations WHERE violation IS NOT NULL GROUP BY ALL
        UNION ALL SELECT id, 'duplicate id', count(*) - 1 FROM dirty_listings GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT NULL, 'expected 120 rows, got ' || count(*), 1 FROM dirty_listings HAVING count(*) <> 120""",
        "violations",
    ),
)
def validate(spark, sf):
    dirty = run_sql(spark, DIRTY, listings=listings(spark, sf))
    words = L.skill_vocabulary(spark, ["economy", "standard", "small", "medium", "large", "promo"])
    return L.validate_listings(
        dirty, words, {"first_date": "2024-01-05", "last_date": "2024-03-20", "rows": 120}
    )


@query(
    "profile_listings",
    with_ctes(
        """SELECT unnest(['rows', 'companies', 'remote', 'aws_remote', 'java_pune', 'pay_12']) AS metric,
        unnest([count(*), count(DISTINCT company), count(*) FILTER (remote),
          count(*) FILTER (remote AND list_contains(skills, 'AWS')),
          count(*) FILTER (list_contains(skills, 'Java') AND location LIKE 'Pune%'), count(*) FILTER (salary_max >= 1200000)]) AS value FROM listings
        UNION ALL SELECT 'employment_type=' || employment_type, count(*) FROM listings GROUP BY 1
        UNION ALL SELECT 'title=' || title, count(*) FROM listings GROUP BY 1""",
        "listings",
    ),
)
def profile(spark, sf):
    has = lambda s: F.array_contains("skills", s)
    return L.profile_listings(
        listings(spark, sf),
        {
            "aws_remote": has("AWS") & F.col("remote"),
            "java_pune": has("Java") & F.col("location").startswith("Pune"),
            "pay_12": F.col("salary_max") >= 1_200_000,
        },
    )


# one response per 32 vectors, every kind of defect by batch number; positions run backwards
def embedding_responses(spark, sf):
    e = view(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 32).cast("bigint").alias("batch_id"),
        (F.col("vec_id") % 32).cast("int").alias("at"),
        "embedding",
    )
    item = F.concat(
        F.lit('{"embedding":['),
        F.when((F.col("batch_id") % 5 == 4) & (F.col("at") == 3), F.lit("")).otherwise(
            F.array_join(F.col("embedding").cast("array<string>"), ",")
        ),
        F.lit('],"index":'),
        F.when((F.col("batch_id") % 7 == 6) & (F.col("at") == 1), F.lit("0")).otherwise(F.col("at").cast("string")),
        F.lit("}"),
    )
    b = e.groupBy("batch_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("at"), item.alias("t")))), lambda x: x.t), ",").alias("items"),
        F.count("*").cast("int").alias("n"),
    )
    body = F.concat(F.lit('{"data":['), F.col("items"), F.lit("]}"))
    k = F.col("batch_id")
    raw = (
        F.when(k % 6 == 5, F.lit('[{"error":{"message":"quota exceeded"}}]'))
        .when(k % 8 == 7, F.lit('{"data":['))
        .when(k % 3 == 1, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return b.select("batch_id", raw.alias("raw"), F.when(k % 4 == 3, F.col("n") + 1).otherwise(F.col("n")).alias("expected"))


@query(
    "ingest_embedding_batches",
    """WITH e AS (SELECT vec_id // 32 AS b, vec_id % 32 AS pos, embedding, count(*) OVER (PARTITION BY vec_id // 32) AS n FROM embeddings),
    verdict AS (SELECT b, n, max(pos) AS last, CASE WHEN b % 6 = 5 THEN 'Embeddings error: quota exceeded'
      WHEN b % 8 = 7 THEN 'Could not parse embeddings response'
      WHEN b % 4 = 3 THEN 'Embeddings endpoint returned ' || n || ' embeddings, expected ' || (n + 1)
      WHEN b % 5 = 4 AND max(pos) >= 3 THEN 'Malformed embedding at position ' || (n - 4)
      WHEN b % 7 = 6 AND max(pos) >= 1 THEN 'Embeddings response is missing embeddings for some inputs' END AS error FROM e GROUP BY b, n)
    SELECT e.b AS batch_id, CAST(e.pos AS INTEGER) AS position, floor(list_sum(list_transform(e.embedding, lambda x, i: x::DOUBLE * i)) * 1e6 + 0.5) / 1e6 AS checksum, NULL AS error
    FROM e JOIN verdict v ON v.b = e.b WHERE v.error IS NULL
    UNION ALL SELECT b, NULL, NULL, error FROM verdict WHERE error IS NOT NULL""",
)
def ingest(spark, sf):
    vectors, rejects = L.ingest_embedding_batches(embedding_responses(spark, sf))
    weighted = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b
    )
    good = vectors.select(
        "batch_id", "position", (F.floor(weighted * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias("checksum"),
        F.lit(None).cast("string").alias("error"),
    )
    return good.unionByName(rejects, allowMissingColumns=True)


def built_index(spark, sf):
    return index_build(listings(spark, sf))


@query(
    "index_build",
    with_ctes(
        f"""SELECT c.document_id, coalesce(v.entries, 0) AS entries, coalesce(v.vector_sum, 0) AS vector_sum FROM listing_chunks c
        LEFT JOIN (SELECT k, {VECTOR_SUM} FROM le GROUP BY k) v ON v.k = c.document_id""",
        "listing_chunks", "le",
    ),
)
def build_vectors(spark, sf):
    return vector_sums(built_index(spark, sf))


@query(
    "index_manifest",
    with_ctes(
        f"""SELECT 'local' AS provider, 'local-hashing-bow-1024' AS model, 1024 AS dimensions, (SELECT count(*) FROM listings) AS job_count,
        count(*) AS chunk_count FROM listing_chunks""",
        "listing_chunks",
    ),
)
def build(spark, sf):
    manifest = index_manifest(built_index(spark, sf), "local", "local-hashing-bow-1024", 1024, "", "2024-01-30")
    return manifest.select("provider", "model", "dimensions", "job_count", "chunk_count")


@query(
    "index_status",
    with_ctes(
        """SELECT true AS indexed, (SELECT count(*) FROM listings) AS job_count, (SELECT count(*) FROM listing_chunks) AS chunk_count,
        'local' AS provider, 'local-hashing-bow-1024' AS model, 1024 AS dimensions, '2024-01-30' AS indexed_at""",
        "listing_chunks",
    ),
)
def status(spark, sf):
    from hybridq.operators.documents import chunk_listings

    # counted twice below: cut once
    chunks = materialise(chunk_listings(listings(spark, sf)).select("document_id", "job_id"), "counted")
    manifest = index_manifest(chunks, "local", "local-hashing-bow-1024", 1024, "", "2024-01-30")
    return index_status(chunks, manifest)


@query(
    "index_write_read",
    with_ctes(
        f"""SELECT c.document_id, c.section, c.part_text AS text, coalesce(v.entries, 0) AS entries, coalesce(v.vector_sum, 0) AS vector_sum
        FROM listing_chunks c LEFT JOIN (SELECT k, {VECTOR_SUM} FROM le GROUP BY k) v ON v.k = c.document_id""",
        "listing_chunks", "le",
    ),
)
def write_read(spark, sf):
    path = scratch(spark)
    manifest = spark.range(1).select(F.lit("local").alias("provider"), F.lit("m").alias("model"))
    index_write(built_index(spark, sf), manifest, path, 1)
    index, _ = index_read(spark, path)
    return index.select("document_id", "section", "text").join(vector_sums(index), "document_id")


@query(
    "index_refresh",
    with_ctes(
        f"""SELECT c.document_id, c.section, c.part_text AS text, coalesce(v.entries, 0) AS entries, coalesce(v.vector_sum, 0) AS vector_sum,
        CASE WHEN l.posted_date <= DATE '2024-03-20' AND NOT l.remote THEN 1 ELSE 2 END AS built
        FROM listing_chunks c JOIN listings l ON l.id = c.id LEFT JOIN (SELECT k, {VECTOR_SUM} FROM le GROUP BY k) v ON v.k = c.document_id
        WHERE {SYNC_NEW}""",
        "listing_chunks", "le",
    ),
)
def refresh(spark, sf):
    """An index over the earlier catalogue, where remote titles differ, brought in step with the later one."""
    rows, path = listings(spark, sf), scratch(spark)
    before = rows.where(SYNC_OLD).withColumn("title", F.when(F.col("remote"), F.upper("title")).otherwise(F.col("title")))
    refresh_index(before, path, "local", "m", "2024-03-20")
    refresh_index(rows.where(SYNC_NEW), path, "local", "m", "2024-03-25")
    index, _ = index_read(spark, path, keep_version=True)
    return index.select("document_id", "section", "text", F.col("version").cast("int").alias("built")).join(
        vector_sums(index), "document_id"
    )
