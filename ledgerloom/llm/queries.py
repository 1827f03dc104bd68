"""One query for each operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.simhash import simhash_components

    return simhash_components(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.suffix_dedup import remove_repeats

    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.line_dedup import remove_repeated_lines

    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return remove_repeated_lines(_read(spark, sf_dir, "documents")).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), kept.alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.html_extract import extract

    return extract(_read(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.chunk_dedup import remove_repeated_chunks

    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return remove_repeated_chunks(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_chunks", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.mixing import taken

    return taken(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.kdshard import tree_shards

    return tree_shards(_read(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.repetition import quality

    return quality(_read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.ordinal import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).withColumnRenamed("selected", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.codebook import compress

    return compress(_read(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.periodic import periodic_runs

    # a tenth of the documents get a period: each word i >= a becomes the word a + (i - a) % p
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    made = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")).otherwise(F.col("text"))
    runs = periodic_runs(docs.select("doc_id", made.alias("text")), digest=True)
    key = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))
    longest = F.array_max(F.transform("runs", key))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("runs_sha256"), F.lower(F.hex("collapsed")).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.less")
    return out.select("doc_id", "n_runs", (-F.col("top.back")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.less").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.caps import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_near_vectors": op13_near_vectors,
    "pipeline": pipeline,
}

#: Every 50-byte string (100 hex digits) with the first document that has it, and each byte's last start before it. Documents are cut into parts of 256 bytes first.
SUFFIX_DEDUP_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
q AS (SELECT doc_id, o, n, substr(hx, 2 * o + 1, 610) AS part FROM (SELECT doc_id, hx, n, unnest(range(0, n, 256)) AS o FROM d)),
b AS (SELECT doc_id, o + i AS p, n, substr(part, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, least(256, n - o))) AS i FROM q)),
k AS (SELECT doc_id, p, g FROM b WHERE p + 50 <= n),
f AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, p FROM k JOIN f USING (g) WHERE first < doc_id),
m AS (SELECT doc_id, p, left(g, 2) AS byte, max(c.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b LEFT JOIN c USING (doc_id, p)),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM m),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

#: Windows of three lines that came before go, and shorter texts that came before as a whole; what is left is joined again.
LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 1))) AS pos FROM l WHERE text <> ''),
k AS (SELECT doc_id, pos, len(ls) AS n, row_number() OVER (PARTITION BY array_to_string(ls[pos + 1:pos + 3], chr(10)) ORDER BY doc_id, pos) AS turn FROM w),
c AS (SELECT DISTINCT doc_id, pos + j AS line FROM k, (SELECT unnest([0, 1, 2]) AS j) WHERE turn > 1 AND pos + j < n),
g AS (SELECT doc_id, list(line ORDER BY line) AS gone FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(ls) AS body, unnest(range(0, len(ls))) AS line FROM l),
t AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY line) AS text FROM e ANTI JOIN c USING (doc_id, line) GROUP BY doc_id)
SELECT l.doc_id, len(l.ls) AS n_lines, coalesce(len(g.gone), 0) AS n_removed, coalesce(array_to_string(g.gone, ','), '') AS removed_lines, sha256(coalesce(t.text, '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: The target line by line, then one slot of the schedule after another. The block size follows the operator's rule.
MIXING_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id || ':0') AS mark FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS w FROM d GROUP BY src),
r AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM s),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level FROM r WINDOW p AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, CASE WHEN ratio <= level THEN 2.0::DOUBLE * source_size ELSE w * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM v),
b AS (SELECT greatest(16, (sum(source_size) // 1048576)::BIGINT) AS block FROM s),
n AS (SELECT t.*, block, floor(target)::BIGINT AS want, ceil(source_size / block)::BIGINT AS blocks, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t, b),
m AS (SELECT *, epochs * blocks + ceil((want - epochs * source_size) / block)::BIGINT AS slots FROM n),
e AS (SELECT *, unnest(range(0, slots)) AS rank FROM m),
q AS (SELECT src, rank % blocks AS bl, sum(least((rank % blocks + 1) * block, source_size, want - (rank // blocks) * source_size) - (rank % blocks) * block)::BIGINT AS words, max(block) AS block, list(least((rank % blocks + 1) * block, source_size, want - (rank // blocks) * source_size)) AS stops FROM e GROUP BY src, rank % blocks),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
h AS (SELECT o.*, unnest(range(start // block, (start + size - 1) // block + 1)) AS bl FROM o, b WHERE size > 0),
g AS (SELECT h.doc_id, h.src, h.start, sum(list_sum([greatest(0, least(h.start + h.size, x) - greatest(h.start, h.bl * q.block)) FOR x IN q.stops])) AS taken FROM h JOIN q USING (src, bl) GROUP BY ALL)
SELECT o.doc_id, o.size, t.source_size, t.target, coalesce(g.taken, 0)::BIGINT AS taken FROM o JOIN t USING (src) LEFT JOIN g ON g.doc_id = o.doc_id AND g.src = o.src AND g.start = o.start AND o.size > 0
"""

#: Entries by part, then rounds of nearest entries and floored means. The part width is that of 64 components or however many there are.
_NEAREST = "SELECT r, k, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, y)])::BIGINT, 'e': e}}) AS best FROM p JOIN {0} c USING (k) GROUP BY r, k"
_MEANS = "SELECT k, e, list(m ORDER BY o) AS y FROM (SELECT k, e, o, CASE WHEN n > 0 THEN ((s - ((s % n) + n) % n) // n)::BIGINT ELSE y END AS m FROM (SELECT c.k, c.e, o, any_value(c.y[o]) AS y, sum(x[o])::BIGINT AS s, count(x) AS n FROM {0} c CROSS JOIN (SELECT unnest(range(1, w + 1)) AS o FROM w) LEFT JOIN (SELECT p.k, best.e AS e, x FROM p JOIN {1} USING (r, k)) a ON a.k = c.k AND a.e = c.e GROUP BY c.k, c.e, o)) GROUP BY k, e"
VECTOR_CODES_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r, * FROM (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
w AS (SELECT greatest(1, ceil(max(len(q)) / 16))::BIGINT AS w FROM v),
p AS (SELECT r, k, [coalesce(q[k * w + i], 0) FOR i IN range(1, w + 1)] AS x FROM v, w, (SELECT unnest(range(16)) AS k)),
c0 AS MATERIALIZED (SELECT k, r - 1 AS e, x AS y FROM p WHERE r <= 64),
a0 AS MATERIALIZED ({_NEAREST.format("c0")}),
c1 AS MATERIALIZED ({_MEANS.format("c0", "a0")}),
a1 AS MATERIALIZED ({_NEAREST.format("c1")}),
c2 AS MATERIALIZED ({_MEANS.format("c1", "a1")}),
a2 AS MATERIALIZED ({_NEAREST.format("c2")}),
s AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c2),
t AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY k) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN t USING (r), s
"""

#: A run with a period q of 2^k to 2^(k+1) - 1 agrees with itself q further on at two places in a row that 2^k divides; where it does, the whole stretch is looked at.
PERIODIC_RUNS_SQL = r"""
WITH RECURSIVE z(b, c) AS (SELECT b, CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END FROM (SELECT unnest(range(256))::BIGINT AS b)),
z2 AS (SELECT b, c, 1 AS n FROM z UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM z2 WHERE n < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM z2 WHERE n = 8),
f AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c, 0 AS i FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, xor(c // 256, t[1 + xor(c % 256, ascii(s[i + 1]))::BIGINT]), i + 1 FROM f, tab WHERE i < len(s)),
h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM f WHERE i = len(s)),
w0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
w1 AS (SELECT r, doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM w0 LEFT JOIN h USING (doc_id)),
w2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM w1),
w3 AS (SELECT *, CASE WHEN a < n THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM w2),
d AS MATERIALIZED (SELECT r, doc_id, n, [ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] AS ws FROM w3),
w AS MATERIALIZED (SELECT r, n, i, ws[i + 1] AS w FROM (SELECT r, n, ws, unnest(range(n)) AS i FROM d)),
k AS (SELECT unnest(range(16)) AS k),
m AS (SELECT r, n, k, i, w FROM w JOIN k ON i % (1 << k) = 0 AND 4 * (1 << k) <= n),
e AS (SELECT m.r, m.k, m.i, x.i - m.i AS q FROM m JOIN w x ON x.r = m.r AND x.w = m.w AND x.i >= m.i + (1 << m.k) AND x.i < m.i + 2 * (1 << m.k)),
c AS (SELECT DISTINCT e.r, e.q FROM e JOIN e y ON y.r = e.r AND y.k = e.k AND y.q = e.q AND y.i = e.i + (1 << e.k)),
g AS (SELECT c.r, c.q, x.i, x.i - row_number() OVER (PARTITION BY c.r, c.q ORDER BY x.i) AS s FROM c JOIN w x ON x.r = c.r JOIN w y ON y.r = c.r AND y.i = x.i + c.q AND y.w = x.w),
u AS (SELECT r, min(q) AS q, a, l FROM (SELECT r, q, min(i) AS a, count(*) + q AS l FROM g GROUP BY r, q, s) WHERE l >= greatest(6, 4 * q) GROUP BY r, a, l),
o AS (SELECT r, count(*) AS n_runs, max({'l': l, 'a': -a, 'q': -q}) AS top, sha256(string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q)) AS runs_sha256 FROM u GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(a + q, a + l)) AS i FROM u),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -top.a AS start, top.l AS length, -top.q AS period, 1000 * top.l // -top.q AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (r) LEFT JOIN kept USING (r)
"""

#: All pairs of one label, then what each vector reaches. The operator misses a few pairs near the bound, so this holds where there are none.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
c(a, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON c.m = l.a),
g AS (SELECT a, min(m) AS component_id FROM c GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN g ON g.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": SUFFIX_DEDUP_SQL, "op3_line_dedup": LINE_DEDUP_SQL, "op6_mixing": MIXING_SQL, "op11_vector_codes": VECTOR_CODES_SQL, "op12_periodic_runs": PERIODIC_RUNS_SQL, "op13_near_vectors": NEAR_VECTORS_SQL}
