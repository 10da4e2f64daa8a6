"""The named queries of this package, each over whole tables, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.llm import audit, codes, decontaminate, embeddings, jaccard, langid, lines, lm, packing, pii, quality, sharding, toxicity
from tallywing.llm.common import table

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    def wrap(build: Build) -> Build:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return wrap


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from the labels that are not held out."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 ids."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, sizes being near equal, and its place there."""
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# Line dedup in DuckDB: windows of two written lines and lines of 50 words alone, compared by their text; no chunks.
LINES_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), written AS (
  SELECT doc_id, l, i, lead(l) OVER w AS next_l, lead(i) OVER w AS next_i
  FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), piece AS (
  SELECT doc_id, i AS a, next_i AS b, 2 AS n, l || chr(10) || next_l AS piece FROM written WHERE next_i IS NOT NULL
  UNION ALL SELECT doc_id, i, i, 1, l FROM written
  WHERE len(list_filter(regexp_split_to_array(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) >= 50
), gone AS (
  SELECT doc_id, unnest(range(a, b + 1)) AS i FROM (
    SELECT * FROM piece QUALIFY row_number() OVER (PARTITION BY n, piece ORDER BY doc_id, a) > 1)
), judged AS (
  SELECT line.doc_id, line.i, l, g.i IS NOT NULL AS gone
  FROM line LEFT JOIN (SELECT DISTINCT doc_id, i FROM gone) g ON g.doc_id = line.doc_id AND g.i = line.i
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM judged
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS removed_lines, CAST(count(*) FILTER (WHERE first) AS INT) AS removed_chunks,
       md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_md5
FROM runs GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document, and a digest of the text that stays."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed_chunks", F.md5("text").alias("text_md5"))


# Decontamination in DuckDB: the same windows, compared exactly without fingerprints.
DECONTAMINATE_SQL = """
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT *, len(w) AS n, least(5, len(w)) AS k FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0
), item_gram AS (
  SELECT item_id, n, k, place, list_slice(w, place + 1, place + k) AS gram
  FROM (SELECT *, unnest(range(0, n - k + 1)) AS place FROM item)
), doc_gram AS (
  SELECT doc_id, k, pos, list_slice(w, pos + 1, pos + k) AS gram
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM doc, (SELECT DISTINCT k FROM item))
), win AS (
  SELECT DISTINCT d.doc_id, g.item_id, g.n, g.k, d.pos - g.place AS start FROM doc_gram d JOIN item_gram g USING (k, gram)
), cut AS (
  SELECT win.*, list_slice(w, greatest(start, 0) + 1, n + start) AS ww FROM win JOIN doc USING (doc_id)
), counted AS (
  SELECT doc_id, item_id, start, len(ww) - k + 1 AS size, list_slice(ww, p + 1, p + k) AS gram, count(*) AS c
  FROM (SELECT *, unnest(range(0, len(ww) - k + 1)) AS p FROM cut) GROUP BY ALL
), item_counted AS (
  SELECT item_id, n - k + 1 AS item_size, gram, count(*) AS ic FROM item_gram GROUP BY ALL
), both_sides AS (
  SELECT doc_id, item_id, start, size + item_size AS sizes, CAST(sum(least(c, ic)) AS BIGINT) AS shared
  FROM counted JOIN item_counted USING (item_id, gram) GROUP BY doc_id, item_id, start, size, item_size
)
SELECT doc_id, item_id, CAST(greatest(start, 0) AS INT) AS start, shared, CAST(sizes - shared AS BIGINT) AS total
FROM both_sides WHERE shared * 100 >= (sizes - shared) * 75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (sizes - shared) DESC, greatest(start, 0)) = 1
"""


@query("op10_decontaminate", DECONTAMINATE_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best window for every benchmark item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


# Every pair of documents that share a shingle, and their components; for tables of the small sizes.
JACCARD_SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), gram AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM doc)
), size AS (
  SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""


@query("op3_jaccard", JACCARD_SQL)
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the component of its links."""
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


@query("op7_embeddings")
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links by cosine and the component of them."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the interpolated model, beside the smoothed unigram one."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query("op5_pseudonyms")
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values of each kind it had. The key is a stand-in."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), b"stand-in key of the named query")
    return out.select("doc_id", "text", *[c for c in out.columns if c.startswith("n_")])


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity grade of every document; learnt from the labels that are not held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _codes_sql() -> str:
    """Codes in DuckDB: all distances of all rounds, as one chain of tables."""
    far = "list_sum(list_transform(range(1, len(a.y) + 1), lambda i: (a.y[i] - b.y[i]) * (a.y[i] - b.y[i])))"
    nearest = f"SELECT a.r, a.p, min(CAST({far} AS BIGINT) * 256 + b.e) AS k FROM part a JOIN book{{0}} b USING (p) GROUP BY 1, 2"
    rounds = "".join(
        f""", near{i} AS ({nearest.format(i)}),
        mean{i} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (
            SELECT p, k % 256 AS e, i, CAST(floor(sum(y[i]) / count(*)) AS BIGINT) AS m
            FROM near{i} JOIN part USING (r, p), LATERAL (SELECT unnest(range(1, len(y) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        book{i + 1} AS (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM book{i} b LEFT JOIN mean{i} m USING (p, e))"""
        for i in range(codes.ROUNDS)
    )
    last = codes.ROUNDS
    return f"""WITH v AS (
      SELECT row_number() OVER (ORDER BY vec_id, x) - 1 AS r, * FROM (
        SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding))
    ), part AS (
      SELECT r, p, list_slice(x, p * (len(x) // 4) + 1, (p + 1) * (len(x) // 4)) AS y FROM v, range(0, 4) t(p)
    ), book0 AS (SELECT p, r AS e, y FROM part WHERE r < 256){rounds}, found AS ({nearest.format(last)}),
    coded AS (
      SELECT vec_id, label, string_agg(lpad(format('{{:x}}', k % 256), 2, '0'), '' ORDER BY p) AS code, CAST(sum(k // 256) AS BIGINT) AS error
      FROM found JOIN v USING (r) GROUP BY r, vec_id, label
    ), print AS (
      SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last}
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, print"""


@query("op11_codes", _codes_sql())
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error and that of its label, and a digest of the codebooks."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


# The audit in DuckDB: every filter on every row at once.
AUDIT_SQL = """
WITH label AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1
), doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(doc.doc_id > min(doc.doc_id) OVER (PARTITION BY t), false)} AS f
  FROM doc LEFT JOIN label USING (doc_id)
), masked AS (
  SELECT part, good, toxic, f.A AS A, f.B AS B, f.C AS C, f.D AS D, f.E AS E, count(*) AS n FROM failed GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), filter_orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), each AS (
  SELECT part, good, toxic, n, filter_order, step, filter_order[step] AS own,
         list_filter([if(A, 'A', ''), if(B, 'B', ''), if(C, 'C', ''), if(D, 'D', ''), if(E, 'E', '')], lambda x: x <> '') AS fails,
         left(filter_order, step - 1) AS earlier
  FROM masked, filter_orders, range(1, 6) s(step)
), judged AS (
  SELECT *, list_contains(fails, own) AS hit, len(list_filter(fails, lambda x: contains(earlier, x))) > 0 AS gone FROM each
), counted AS (
  SELECT part, filter_order, step, own, sum(if(hit OR gone, 0, n)) AS kept, sum(if(hit AND NOT gone, n, 0)) AS removed,
         sum(if(hit AND gone, n, 0)) AS redundant, sum(if(hit AND len(fails) = 1, n, 0)) AS unique_fails,
         sum(if(hit AND NOT gone, n * good, 0)) AS good_lost, sum(if(hit AND NOT gone, n * toxic, 0)) AS toxic_lost
  FROM judged GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every part and order."""
    return audit.audit(spark, f"{sf_dir}/documents.parquet*", table(spark, sf_dir, "labels"))


@query("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))
