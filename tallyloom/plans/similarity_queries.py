"""Queries on like content: dense vectors, words, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import word_count
from tallyloom.operators import content as K
from tallyloom.operators import similarity as V
from tallyloom.operators import training as M
from tallyloom.operators.cooccurrence import shared_cosine
from tallyloom.operators.records import numbered
from tallyloom.operators.timing import bare_id
from tallyloom.plans.base import comments, sql_records
from tallyloom.session import cut, table

THRESHOLD, EMBEDDING_THRESHOLD = 0.85, 0.3
BITS, TABLES, DIM = 12, 4, 80
TOP_K = 40
PAIR_THRESHOLDS = tuple(round(0.4 + 0.01 * i, 2) for i in range(56))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return V.unit(table(spark, d, "comment_vectors"), "vec_id", "vec")


def dense_range_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.range_pairs(cut(_vectors(spark, d)), THRESHOLD).select("a", "b", F.round("similarity", 5).alias("similarity"))


def embedding_range_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = cut(V.unit(table(spark, d, "embeddings"), "vec_id", "embedding"))
    return V.range_pairs(v, EMBEDDING_THRESHOLD, strict=True).select("a", "b", F.round("similarity", 5).alias("similarity"))


def suspicious_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Authors of like comments: pairs of vectors of different authors, rolled up by author."""
    owner = table(spark, d, "comment_vectors").select("vec_id", F.col("comment_id").alias("id")).join(comments(spark, d, "author", "subreddit").where("author IS NOT NULL"), "id")
    owner = owner.select("vec_id", "author", "subreddit").distinct()
    pairs = V.range_pairs(cut(_vectors(spark, d)), THRESHOLD)
    both = pairs.join(owner.select(F.col("vec_id").alias("a"), F.col("author").alias("author_a")), "a").join(owner.select(F.col("vec_id").alias("b"), F.col("author").alias("author_b")), "b")
    return V.account_rollup(both.where("author_a <> author_b").withColumn("similarity", F.round("similarity", 5)), digits=4)


def sampled_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The 0.99 quantile of the similarity of 50,000 random pairs."""
    return spark.createDataFrame([(50_000, V.sampled_threshold(cut(_vectors(spark, d)), 50_000, 0.99))], "pairs int, threshold double")


def _lsh(spark: SparkSession, d: str, top_k: int | None) -> DataFrame:
    v = cut(V.unit(table(spark, d, "comment_vectors"), "vec_id", "vec", scaled=False))
    return V.probed_pairs(v, V.signatures(v, DIM, BITS, TABLES), BITS, THRESHOLD, top_k)


def lsh_topk_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _lsh(spark, d, TOP_K)


def lsh_range_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _lsh(spark, d, None)


def lsh_compare(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of both bucketed searches side by side."""
    return V.compare_pairs(cut(lsh_topk_pairs(spark, d)), cut(lsh_range_pairs(spark, d)))


def hamming_rescored(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_vectors(spark, d))
    return V.hamming_pairs(v, cut(V.signatures(v, DIM, 32, 1)), THRESHOLD, 50, F.col("id") % 50 == 0)


def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of bucketed search against the exact one, over a grid of bits and tables, and of the searches with
    neighbouring buckets (flips = 1) that lsh_range_pairs and, with top_k, lsh_topk_pairs make."""
    v = cut(_vectors(spark, d))
    exact = cut(V.range_pairs(v, THRESHOLD))
    out = None
    for bits in (8, 16):
        for tables in (1, 4):
            row = V.recall_precision(exact, V.bucket_pairs(v, V.signatures(v, DIM, bits, tables), THRESHOLD)).select(F.lit(bits).alias("bits"), F.lit(tables).alias("tables"), F.lit(0).alias("flips"), F.lit(None).cast("int").alias("top_k"), "*")
            out = row if out is None else out.union(row)
    for top_k in (None, TOP_K):
        row = V.recall_precision(exact, _lsh(spark, d, top_k)).select(F.lit(BITS).alias("bits"), F.lit(TABLES).alias("tables"), F.lit(1).alias("flips"), F.lit(top_k).cast("int").alias("top_k"), "*")
        out = out.union(row)
    return out


def density_labels(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_vectors(spark, d))
    return V.density_clusters(v, cut(V.range_pairs(v, THRESHOLD)), 3)


def cluster_term_table(spark: SparkSession, d: str) -> DataFrame:
    """The terms that mark each density cluster of comments."""
    text = table(spark, d, "comment_vectors").select(F.col("vec_id"), F.col("comment_id").alias("id")).distinct().join(comments(spark, d, "body"), "id")
    rows = density_labels(spark, d).where("label >= 0").join(text.select(F.col("vec_id").alias("id"), "body"), "id")
    return K.cluster_terms(K.terms(rows.select(F.col("label").alias("cluster"), "body"), "body"), 5)


def cluster_community_table(spark: SparkSession, d: str) -> DataFrame:
    """How each density cluster spreads over communities, with the first three as a line."""
    owner = table(spark, d, "comment_vectors").select("vec_id", F.col("comment_id").alias("id")).distinct().join(comments(spark, d, "subreddit").where("subreddit IS NOT NULL"), "id")
    rows = density_labels(spark, d).join(owner.select(F.col("vec_id").alias("id"), "subreddit"), "id").select(F.col("label").alias("cluster"), F.col("subreddit").alias("topic"))
    topics = cut(K.cluster_topics(rows))
    return topics.where("rank = 1").select("cluster", F.col("topic").alias("dominant"), "cluster_size", "pct").join(K.topic_line(topics), "cluster")


def cluster_previews(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "comment_vectors").select("vec_id", F.col("comment_id").alias("id")).distinct().join(comments(spark, d, "body"), "id")
    rows = density_labels(spark, d).join(text.select(F.col("vec_id").alias("id"), F.col("body").alias("text")), "id")
    return K.cluster_preview(rows)


def cluster_listing(spark: SparkSession, d: str) -> DataFrame:
    """The larger density clusters in order of size, with some of their texts."""
    text = table(spark, d, "comment_vectors").select("vec_id", F.col("comment_id").alias("id")).distinct().join(comments(spark, d, "body"), "id")
    rows = density_labels(spark, d).join(text.select(F.col("vec_id").alias("id"), F.col("body").alias("text")), "id")
    return K.cluster_listing(cut(rows))


def pairs_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The like pairs by similarity, highest first, ties by id."""
    return numbered(dense_range_pairs(spark, d), [F.desc("similarity"), F.col("a"), F.col("b")])


def _labeled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labeled pairs (text_a, text_b, label): replies and what they answer, 1 if by one author; and the vectors of texts."""
    c = comments(spark, d, "author", "body", "parent_id").where("author IS NOT NULL AND body IS NOT NULL")
    parents = c.select(F.col("id").alias("parent"), F.col("body").alias("text_b"), F.col("author").alias("other"))
    pairs = c.select(F.col("id").alias("pair_id"), F.col("body").alias("text_a"), "author", bare_id("parent_id").alias("parent")).join(parents, "parent")
    pairs = pairs.select("pair_id", "text_a", "text_b", (F.col("author") == F.col("other")).cast("int").alias("label"))
    owner = table(spark, d, "comment_vectors").select("vec_id", F.col("comment_id").alias("id")).join(c.select("id", "body"), "id").groupBy(F.col("body").alias("text")).agg(F.min("vec_id").alias("vec_id"))
    return pairs, owner.join(_vectors(spark, d).withColumnRenamed("id", "vec_id"), "vec_id").select("text", "v")


def unique_pair_texts(spark: SparkSession, d: str) -> DataFrame:
    return V.unique_texts(_labeled(spark, d)[0]).select(F.md5("text").alias("text_hash"))


def labeled_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return V.score_pairs(*_labeled(spark, d)).select("pair_id", "label", F.round("similarity", 5).alias("similarity"))


def labeled_pair_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the similarity as a sign of the label at 56 thresholds, and which is the best."""
    scored = labeled_pair_scores(spark, d).select(F.col("label").alias("y"), F.col("similarity").alias("score"))
    sweep = cut(M.threshold_sweep(scored, PAIR_THRESHOLDS))
    best = M.best_threshold(sweep, 0.0)
    return sweep.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], (F.col("threshold") == best).alias("best"))


def exact_duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = comments(spark, d, "author", "body").select("id", "author", F.col("body").alias("text")).where("text NOT IN ('[deleted]', '[removed]')")
    return K.duplicate_texts(rows).select(F.md5("text").alias("text_hash"), "n_authors", "n_posts", "first_id")


def word_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of comments of at least ten words with a TF-IDF cosine of 0.8 or more."""
    rows = comments(spark, d, "author", "body").where("author IS NOT NULL AND body NOT IN ('[deleted]', '[removed]')").where(word_count("body") >= 10)
    weights = cut(K.word_weights(rows.select("id", F.col("body").alias("text"))))
    return shared_cosine(weights, 0.8).select("a", "b", F.round("similarity", 5).alias("similarity"), "shared")


def pooled_document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents by a stand-in encoder over chunks of 2,000 characters, pooled."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL AND text <> ''")
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(2000))
    chunks = docs.select("id", F.explode(F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(2000)))).alias("chunk"))
    return V.pooled_chunks(V.embed(chunks, "chunk", V.hashed_words()).select("id", "v"))


SQL_UNIT = "v0 AS (SELECT vec_id, min(vec)::DOUBLE[] AS v FROM comment_vectors WHERE vec IS NOT NULL AND len(vec) > 0 GROUP BY vec_id), v AS (SELECT vec_id AS id, v FROM v0 WHERE list_sum(list_transform(v, lambda x: x * x)) > 0)"
SQL_PAIRS = f"pr AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD})"
_OWNER = "o AS (SELECT DISTINCT vec_id, author, subreddit FROM comment_vectors JOIN c0 ON c0.id = comment_id)"
_LABELS = f"""sy AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), dg AS (SELECT v.id, count(sy.b) + 1 AS n FROM v LEFT JOIN sy ON sy.a = v.id GROUP BY 1),
co AS (SELECT id FROM dg WHERE n >= 3),
ce AS (SELECT a, b FROM sy WHERE a IN (SELECT id FROM co) AND b IN (SELECT id FROM co)),
re(id, root) AS (SELECT id, id FROM co UNION SELECT ce.b, re.root FROM re JOIN ce ON ce.a = re.id WHERE re.root < ce.b),
rt AS (SELECT id, min(root) AS root FROM re GROUP BY 1), lb AS (SELECT id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS label FROM rt),
bd AS (SELECT sy.a AS id, min(label) AS near FROM sy JOIN lb ON lb.id = sy.b GROUP BY 1),
l AS (SELECT v.id, coalesce(lb.label, bd.near, -1) AS label FROM v LEFT JOIN lb USING (id) LEFT JOIN bd USING (id))"""
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TEXT_OF = f"""vt AS (SELECT DISTINCT vec_id, trim(regexp_replace(body, '{_SPACE}', ' ', 'g')) AS t FROM comment_vectors JOIN c0 ON c0.id = comment_id),
tx AS (SELECT label, l.id, CASE WHEN length(t) <= 180 THEN t ELSE substr(t, 1, 177) || '...' END AS text, row_number() OVER (PARTITION BY label ORDER BY l.id) AS k FROM l JOIN vt ON vt.vec_id = l.id)"""
_LABELED = f"""{sql_records('comments', 'c0', 'author', 'body', 'parent_id')}, {SQL_UNIT}, c AS (SELECT * FROM c0 WHERE author IS NOT NULL AND body IS NOT NULL),
lp AS (SELECT x.id AS pair_id, x.body AS text_a, y.body AS text_b, (x.author = y.author)::INT AS label FROM c x JOIN c y ON y.id = regexp_replace(x.parent_id, '^t[123]_', '')),
tv AS (SELECT body AS text, min(vec_id) AS vec_id FROM comment_vectors JOIN c ON c.id = comment_id GROUP BY 1), te AS (SELECT text, v FROM tv JOIN v ON v.id = tv.vec_id),
ps AS (SELECT pair_id, label, round(list_cosine_similarity(x.v, y.v), 5) AS similarity FROM lp JOIN te x ON x.text = text_a JOIN te y ON y.text = text_b)"""

QUERIES = {f.__name__: f for f in (dense_range_pairs, embedding_range_pairs, suspicious_accounts, sampled_quantile, lsh_topk_pairs, lsh_range_pairs, lsh_compare, hamming_rescored, lsh_recall, density_labels, cluster_term_table, cluster_community_table, cluster_previews, cluster_listing, pairs_in_order, unique_pair_texts, labeled_pair_scores, labeled_pair_sweep, exact_duplicate_texts, word_pairs, pooled_document_vectors)}
SQL = {
    "dense_range_pairs": f"WITH {SQL_UNIT}, {SQL_PAIRS} SELECT * FROM pr",
    "embedding_range_pairs": f"WITH v AS (SELECT vec_id AS id, min(embedding)::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS similarity FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) > {EMBEDDING_THRESHOLD}",
    "suspicious_accounts": f"""WITH {sql_records('comments', 'c0', 'author', 'subreddit')}, {SQL_UNIT}, {SQL_PAIRS}, {_OWNER},
e AS (SELECT x.author AS p, y.author AS q, similarity FROM pr JOIN o x ON x.vec_id = a JOIN o y ON y.vec_id = b WHERE x.author <> y.author)
SELECT author, count(*) AS cross_account_matches, max(s) AS max_similarity, round(avg(s), 4) AS avg_similarity FROM (SELECT p AS author, similarity AS s FROM e UNION ALL SELECT q, similarity FROM e) GROUP BY 1""",
    "density_labels": f"WITH RECURSIVE {SQL_UNIT}, {SQL_PAIRS}, {_LABELS} SELECT * FROM l",
    "cluster_community_table": f"""WITH RECURSIVE {sql_records('comments', 'c0', 'author', 'subreddit')}, {SQL_UNIT}, {SQL_PAIRS}, {_OWNER}, {_LABELS},
n AS (SELECT label AS cluster, subreddit AS topic, count(*) AS n FROM l JOIN o ON o.vec_id = l.id WHERE subreddit IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic) AS r FROM n)
SELECT cluster, max(CASE WHEN r = 1 THEN topic END) AS dominant, CAST(any_value(size) AS BIGINT) AS cluster_size, round(100.0 * max(CASE WHEN r = 1 THEN n END) / any_value(size), 2) AS pct, string_agg(topic || ' (' || n || ')', ', ' ORDER BY r) FILTER (r <= 3) AS topics FROM k GROUP BY cluster""",
    "cluster_previews": f"""WITH RECURSIVE {sql_records('comments', 'c0', 'body')}, {SQL_UNIT}, {SQL_PAIRS}, {_LABELS}, {_TEXT_OF}
SELECT label, k AS place, id, text FROM tx WHERE k <= 10""",
    "cluster_listing": f"""WITH RECURSIVE {sql_records('comments', 'c0', 'body')}, {SQL_UNIT}, {SQL_PAIRS}, {_LABELS}, {_TEXT_OF},
sz AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM tx WHERE label >= 0 GROUP BY 1 HAVING count(*) >= 5)
SELECT place, label, size, k, id, text FROM tx JOIN sz USING (label) WHERE k <= 5""",
    "pairs_in_order": f"WITH {SQL_UNIT}, {SQL_PAIRS} SELECT *, row_number() OVER (ORDER BY similarity DESC, a, b) AS place FROM pr",
    "unique_pair_texts": f"WITH {_LABELED} SELECT md5(t) AS text_hash FROM (SELECT text_a AS t FROM lp UNION SELECT text_b FROM lp)",
    "labeled_pair_scores": f"WITH {_LABELED} SELECT pair_id, label, similarity FROM ps",
    "labeled_pair_sweep": f"""WITH {_LABELED}, cf AS (SELECT t AS threshold, count(*) FILTER (similarity >= t AND label = 1) AS tp, count(*) FILTER (similarity >= t AND label = 0) AS fp, count(*) FILTER (similarity < t AND label = 1) AS fn, count(*) FILTER (similarity < t AND label = 0) AS tn FROM ps, (SELECT unnest([{', '.join(map(str, PAIR_THRESHOLDS))}]::DOUBLE[]) AS t) GROUP BY 1),
pq AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cf), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pq)
SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, threshold = (SELECT threshold FROM f ORDER BY f DESC, threshold LIMIT 1) AS best FROM f""",
    "exact_duplicate_texts": f"""WITH {sql_records('comments', 'c0', 'author', 'body')}, t AS (SELECT id, author, trim(regexp_replace(body, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS text FROM c0 WHERE author IS NOT NULL AND body NOT IN ('[deleted]', '[removed]'))
SELECT md5(text) AS text_hash, count(DISTINCT author) AS n_authors, count(*) AS n_posts, min(id) AS first_id FROM t WHERE text <> '' GROUP BY text HAVING count(DISTINCT author) >= 2""",
}
