"""The package's registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import attention_lm, ego_join, fim, licenses, mixing, parity_join, pii, run_index, sharding, toxicity, value_codes, warc, winnow
from jobloom.llm.common import shared_folder, table

SHARDS = 40


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))[0]


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_text")


def op4_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return warc.read(spark, folder, warc.write(table(spark, sf_dir, "pages"), folder))


def op5_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op7_parity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scores(table(spark, sf_dir, "documents"))


def op10_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op11_fim_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(table(spark, sf_dir, "documents"))
    digests = (F.sha2(c.cast("binary"), 256) for c in (F.col("output"), fim.restored(F.col("output"), F.col("form"))))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(d.alias(a) for d, a in zip(digests, ("output_sha256", "restored_sha256"), strict=True)))


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_index.remove_repeats(table(spark, sf_dir, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return rows.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_value_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = value_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(value_codes.digest(books)))


_OPERATORS = (
    op1_bounded_ring, op2_weak_pii, op3_winnowing, op4_warc_shards, op5_label_model,
    op6_ego_join, op7_parity_sketch, op8_sentence_rules, op9_attention_lm, op10_fair_queueing,
    op11_fim_arrow, op12_run_index, op13_value_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every run of 10 document words beside every run of 10 item words (all words of a shorter item).
WINNOWING = rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
 win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS g
         FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
 lens AS (SELECT DISTINCT n FROM win),
 grams AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g
           FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, lens WHERE len(ws) >= n)),
 hit AS (SELECT DISTINCT doc_id, n, k, item_id FROM grams JOIN win USING (n, g)),
 words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
 ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_COMPONENTS = """
 reach AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a),
 low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
"""

EGO = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 both_ways AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
{_COMPONENTS}
SELECT v.vec_id, CAST((SELECT count(*) FROM both_ways e WHERE e.a = v.vec_id) AS BIGINT) AS n_links,
       least(v.vec_id, coalesce(low.y, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(low.y, v.vec_id)) AS kept
FROM v LEFT JOIN low ON low.x = v.vec_id
"""

#: Shingles that two documents share, counted over all pairs that share any.
PARITY = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + least(3, len(ws)) - 1], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS k FROM w WHERE len(ws) > 0)),
 size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 inter AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
 both_ways AS (SELECT a, b FROM inter JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
{_COMPONENTS}
SELECT w.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN low ON low.x = w.doc_id
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
 p AS (SELECT coalesce(source, '') AS s, source IS NULL AS u, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 r AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY u, s) - 1) % 3 + 1]::DOUBLE AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM p),
 l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                  - coalesce(sum(cap) OVER (ORDER BY cap / w, u, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY cap / w, u, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r),
 t AS (SELECT u, s, source_size, CASE WHEN lvl * w >= cap THEN cap ELSE w * (SELECT lvl FROM l WHERE lvl * w < cap ORDER BY cap / w, u, s LIMIT 1) END AS target FROM l),
 c AS (SELECT doc_id, t.u, t.s, size, source_size, target,
              CAST(sum(size) OVER (PARTITION BY t.u, t.s ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
       FROM d JOIN t ON t.u = (d.source IS NULL) AND t.s = coalesce(d.source, '')),
 k AS (SELECT *, upto + turn * source_size AS place FROM c, (VALUES (0), (1)) v(turn) WHERE size > 0),
 g AS (SELECT *, sum(size) OVER (ORDER BY place / target, u, s, place ROWS UNBOUNDED PRECEDING) AS running FROM k),
 kept AS (SELECT doc_id, upto, u, s, count(*) AS n FROM g WHERE running <= (SELECT 1.5 * sum(size) FROM d) GROUP BY ALL)
SELECT c.doc_id, size, source_size, target, CAST(coalesce(n, 0) * size AS BIGINT) AS taken
FROM c LEFT JOIN kept USING (doc_id, upto, u, s)
"""


_HEX = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))

FIM = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 e AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {_HEX} FROM d),
 c AS (SELECT doc_id, t, n, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                   WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
 p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _codes_sql(rounds: int = 2) -> str:
    """Every part beside every entry of its codebook, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
 near{r} AS (SELECT vec_id, p, min(struct_pack(error := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best, any_value(x) AS x
             FROM parts JOIN book{r} USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
 moved{r} AS (SELECT p, e, list(m ORDER BY d) AS c FROM (
                SELECT p, best.e AS e, d, CAST(floor(sum(x[d]) / count(*)) AS BIGINT) AS m FROM near{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS d) GROUP BY ALL) GROUP BY p, e),
 book{r + 1} AS (SELECT p, e, coalesce(moved{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN moved{r} USING (p, e))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
 parts AS (SELECT vec_id, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS p)),
 firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64),
 book0 AS (SELECT p, e, x AS c FROM parts JOIN firsts USING (vec_id)),{",".join(steps)},
 codes AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.error) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
 labelled AS (SELECT vec_id, label, code, error FROM codes JOIN v USING (vec_id)),
 books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM labelled, books
"""


def _license_sql() -> str:
    """The same tables of sentences and rules, matched by list functions."""
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in licenses.SENTENCES.items())
    names = sorted({n for n, _ in licenses.RULES})
    tests = {n: " OR ".join(f"contains(line, ',{','.join(ids)},')" for m, ids in licenses.RULES if m == n) for n in names}
    hits = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items())
    return rf"""
WITH s AS (SELECT doc_id, regexp_split_to_array({_LOWER}, '[.!?]+[\x20\x09-\x0D]+|[\x0A\x0D]+') AS ss FROM documents),
 i AS (SELECT doc_id, list_filter(list_transform(ss, lambda x: CASE trim(regexp_replace(x, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) {case} END), lambda y: y IS NOT NULL) AS ids FROM s),
 l AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS line FROM i),
 f AS (SELECT doc_id, ids, list_filter([{hits}], lambda y: y IS NOT NULL) AS found FROM l)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses, CAST(len(found) AS BIGINT) AS n_licenses, len(ids) > 0 AND len(found) = 0 AS unmatched FROM f
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force."""
    return {
        "op3_winnowing": WINNOWING, "op6_ego_join": EGO, "op7_parity_sketch": PARITY,
        "op8_sentence_rules": _license_sql(), "op10_fair_queueing": MIX, "op11_fim_arrow": FIM, "op13_value_codes": _codes_sql(),
    }
