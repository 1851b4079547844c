"""Registered queries of the operators over their whole tables, and SQL for those that SQL can express.

Each query calls its operator and derives the digest columns from what it returns.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, fingerprint, grid_join, line_dedup, merkle, mixing, ngram_join, secret_scan, suffix_dedup, token_shards, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tokenizers file; executors need it at the same place.
TOKENIZER = os.environ.get("FARESIGHT_TOKENIZER", "")


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Rows of an Arrow batch while these queries run. Documents are wide, and Spark's default of 10,000 rows takes executor
#: memory that neither side of the exchange needs. A session that has chosen its own number keeps it.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """What the queries need of a session: small Arrow batches, and the package on the path of local Python workers.

    A cluster installs the package, so the path matters only where driver and executors share this folder.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Patterns of the secret kinds as the SQL reads them, written out apart from the operator's: kind, pattern, role, weak.
_SECRETS = [
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", False),
    ("access", "AKIA[A-Z0-9]+", "identifier", False),
    ("hex", "[0-9a-f]+", "secret", False),
    ("id", r"""(?:[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", "identifier", True),
    ("key", "[A-Za-z0-9+/_-]{20,}", "secret", True),
    ("url", r"""[a-z]+://[^\x00-\x20"'<>]+""", "endpoint", True),
]
_REACH = 200


def _secret_sql() -> str:
    found = " UNION ALL ".join(
        f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, {str(weak).lower()} AS weak, '{role}' AS role, h[i] AS hit,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
        FROM (SELECT rid, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h FROM d WHERE regexp_matches(t, '{p}')),
        unnest(range(1, len(h) + 1)) u(i)"""
        for rank, (kind, pattern, role, weak) in enumerate(_SECRETS)
        for p in [pattern.replace("'", "''")]
    )
    assign = _SECRETS[0][1].replace("'", "''")
    near = lambda role: f"EXISTS (SELECT 1 FROM c q WHERE q.rid = p.rid AND q.role = '{role}' AND abs(q.s - p.s) <= {_REACH})"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT *, s + length(hit) AS e FROM ({found})),
    b AS (SELECT * FROM m WHERE NOT weak AND CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{assign}', 2)) >= 8 WHEN 'access' THEN length(hit) >= 16 ELSE length(hit) >= 32 END),
    c AS (SELECT * FROM b UNION ALL SELECT * FROM m WHERE weak AND (kind <> 'key' OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]')
          AND regexp_matches(hit, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = m.rid AND b.s < m.e AND m.s < b.e)))),
    r AS (SELECT * FROM c p WHERE NOT weak OR (kind = 'id' AND {near('secret')}) OR (kind = 'key' AND {near('identifier')})
          OR (kind = 'url' AND {near('identifier')} AND {near('secret')})),
    o AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
          string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE NOT weak) AS base,
          count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c
          FROM r GROUP BY rid)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN o USING (rid)"""


@query("op1_secret_scans", _secret_sql())
def secret_scans(spark, sf):
    found = secret_scan.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = secret_scan.span_text(F.filter("spans", lambda s: ~s["weak"]))
    return found.select("doc_id", *[of(k) for k in secret_scan.BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


@query(
    "op2_url_filters",
    """
    WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    v AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
          WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
          WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
          WHEN ('.' || host) LIKE '%.net' THEN 'net/' END AS rule FROM h)
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM v
    """,
)
def url_filters(spark, sf):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), rules).drop("url")


@query("op3_suffix_dedup")
def suffix_dedup_all(spark, sf):
    out = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), keep_first=False)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_fingerprints")
def fingerprints(spark, sf):
    return fingerprint.edit_likeness(table(spark, sf, "documents").select("doc_id", "text"))


@query("op5_toxicity")
def toxicity_scores(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op6_ngram_jaccard",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) u(i)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
    """,
)
def ngram_jaccard(spark, sf):
    return ngram_join.similar_classes(table(spark, sf, "documents").select("doc_id", "text"))


@query("op7_token_shards")
def token_shard_files(spark, sf):
    folder = token_shards.shard_folder(spark)
    token_shards.write_shards(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path(), folder)
    return token_shards.documents_of(token_shards.read_shards(spark, folder))


@query(
    "op8_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || doc_id) AS o FROM documents),
    t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
    u AS (SELECT *, (2 * source_size)::DOUBLE AS most, (2 * source_size)::DOUBLE / w AS ratio, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM t),
    v AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM u),
    g AS (SELECT source, source_size, least((SELECT level FROM v WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1) * w, most) AS target FROM v),
    c AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target, CAST(greatest(0, least(floor(target) - ahead, size)) + greatest(0, least(floor(target) - source_size - ahead, size)) AS BIGINT) AS taken FROM c
    """,
)
def source_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_bpe")
def bpe_round_trip(spark, sf):
    out = bpe.round_trip(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path())
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query(
    "op10_embeddings",
    """
    WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
    """,
)
def embedding_duplicates(spark, sf):
    return grid_join.cosine_components(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))


#: crc32 of a text of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, CAST(i AS INT), 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _manifest_sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda t: "sha256(" + " || ".join([*map(field, merkle.FIELDS[:4]), field(t)]) + ")"
    id_ = "CAST(doc_id AS VARCHAR)"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC.format(id_)} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS later FROM documents),
    o AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
          row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
    t AS (SELECT g, 0 AS level, pos, n, leaf AS h FROM o
          UNION ALL SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, level, pos // 3, n),
    s AS (SELECT g, level AS above, h FROM t WHERE n = 1),
    u AS (SELECT 0 AS level, g AS pos, (SELECT count(*) FROM s) AS n, h FROM s
          UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
    step AS (SELECT o.rid, t.level AS k, t.pos, t.h, o.pos // CAST(3 ** t.level AS BIGINT) AS mine
             FROM o JOIN t ON t.g = o.g AND t.n > 1 AND t.pos // 3 = o.pos // CAST(3 ** (t.level + 1) AS BIGINT)
             UNION ALL SELECT o.rid, s.above + u.level, u.pos, u.h, o.g // CAST(3 ** u.level AS BIGINT)
             FROM o JOIN s ON s.g = o.g JOIN u ON u.n > 1 AND u.pos // 3 = o.g // CAST(3 ** (u.level + 1) AS BIGINT)),
    pairs AS (SELECT rid, k, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < mine), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > mine), '') AS r FROM step GROUP BY rid, k),
    path AS (SELECT rid, list({{'l': l, 'r': r}} ORDER BY k) AS path, string_agg(l || r, '' ORDER BY k) AS siblings FROM pairs GROUP BY rid),
    f AS (SELECT rid, 1 AS i, later AS h, path FROM o LEFT JOIN path USING (rid) UNION ALL SELECT rid, i + 1, sha256(path[i].l || h || path[i].r), path FROM f WHERE i <= len(path))
    SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
    FROM o JOIN s USING (g) CROSS JOIN (SELECT h FROM u WHERE n = 1) root LEFT JOIN path p ON p.rid = o.rid JOIN f ON f.rid = o.rid AND f.i = coalesce(len(p.path), 0) + 1"""


@query("op11_merkle_manifest", _manifest_sql())
def merkle_manifest(spark, sf):
    docs = table(spark, sf, "documents").select(*merkle.FIELDS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify(docs, tampered)


@query(
    "op12_line_dedup",
    f"""
    WITH l AS (SELECT rid, doc_id, i, lines[i] AS line, translate(trim(lines[i], {' || '.join(f'chr({c})' for c in (32, 9, 10, 11, 12, 13))}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
               FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) u(i)),
    k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT l.*, k.key IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN k USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id
    """,
)
def line_duplicates(spark, sf):
    out = line_dedup.drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_whitening")
def embedding_whitening(spark, sf):
    out = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
