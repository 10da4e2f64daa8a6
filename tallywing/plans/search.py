"""Retrieval of similar examples over the whole embedding and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.operators import retrieval as V
from tallywing.plans.registry import register
from tallywing.sources.fixture import table


@register(
    "v01_nearest_examples",
    """WITH parts AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings),
            means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY 1, 2),
            c AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY 1),
            s AS (SELECT c.label AS query_id, vec_id AS example_id,
                         list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS similarity FROM c, embeddings)
       SELECT query_id, example_id, round(similarity, 6) AS similarity,
              row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, example_id) AS rank
       FROM s QUALIFY rank <= 5""",
)
def v01_nearest_examples(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The examples closest to the mean of each label."""
    corpus = table(spark, sf_dir, "embeddings")
    queries = V.centroids(corpus, "label", "embedding")
    found = V.nearest_examples(queries, corpus.select("vec_id", "embedding"), k)
    return found.withColumn("similarity", F.round("similarity", 6))


# All pairs that share a word, with the same whole-number weights.
WORDS_SQL = """
WITH stored AS (SELECT conv_id || '/' || turn AS id, text FROM conversations WHERE role = 'user'),
both_sides AS (SELECT 'c' AS side, id, text FROM stored UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), text FROM benchmark),
word AS (SELECT side, id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[\\x20\\x09-\\x0D]+')) AS term FROM both_sides),
counted AS (SELECT side, id, term, count(*) AS n FROM word WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counted WHERE side = 'c' GROUP BY 1),
weighed AS (SELECT side, id, term, CAST(round((ln(CAST(n AS DOUBLE)) + 1)
              * ln(((SELECT count(DISTINCT id) FROM stored) + 1e0) / (coalesce(df, 0) + 1e0)) * 1000) AS BIGINT) AS w
            FROM counted LEFT JOIN df USING (term)),
normed AS (SELECT *, sqrt(CAST(sum(w * w) OVER (PARTITION BY side, id) AS DOUBLE)) AS norm FROM weighed WHERE w > 0),
pair AS (SELECT CAST(q.id AS BIGINT) AS query_id, c.id AS example_id,
                CAST(sum(q.w * c.w) AS DOUBLE) / (max(q.norm) * max(c.norm)) AS similarity
         FROM normed q JOIN normed c ON q.term = c.term AND q.side = 'q' AND c.side = 'c' GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, example_id) AS rank
FROM pair QUALIFY rank <= 3"""


@register("v02_question_features", WORDS_SQL)
def v02_question_features(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """For each benchmark item the most similar user messages, by TF-IDF over words."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    stored = turns.select(F.concat_ws("/", "conv_id", "turn").alias("example"), "text")
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return V.similar_texts(asked, V.word_index(stored), k)
