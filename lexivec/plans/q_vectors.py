"""Vector queries: normalisation, kNN, closest-in-lexicon, means, retrofitting,
synonym/antonym tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import lexicon as L
from lexivec.operators import presets as P
from lexivec.operators import retrofit as R
from lexivec.operators import vectors as V
from lexivec.plans.catalog import query
from lexivec.plans.sqlparts import DOC_TOKENS_CTE, r6
from lexivec.sources import tables as S

TOPN = 10
N_ITER = 10

VEC_SQL = """v AS (SELECT vec_id::VARCHAR AS word, label::VARCHAR AS cls, embedding::DOUBLE[] AS vec FROM embeddings)"""
LONG_SQL = """lv AS (SELECT vec_id::VARCHAR AS word, label::VARCHAR AS cls, unnest(embedding::DOUBLE[]) AS v0,
  unnest(generate_series(0, len(embedding) - 1))::BIGINT AS dim FROM embeddings)"""
KNN_SQL = f"""{VEC_SQL},
knn AS (SELECT * FROM (SELECT a.word AS query, b.word AS word, list_cosine_similarity(a.vec, b.vec) AS sim,
          row_number() OVER (PARTITION BY a.word ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.word) AS rank
        FROM v a JOIN v b ON a.word <> b.word) WHERE rank <= {TOPN})"""


def l2_normalize_q(spark, sf_dir):
    e = S.load(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").cast("string").alias("word"),
                 V.l2_normalize(F.col("embedding").cast("array<double>"), eps=1e-6).alias("vec"))
    return V.to_long(v, "word")


query("l2_normalize", f"""WITH x AS (SELECT vec_id::VARCHAR AS word, embedding::DOUBLE[] AS v FROM embeddings),
y AS (SELECT word, unnest(v) AS x, unnest(generate_series(0, len(v) - 1))::BIGINT AS dim, sqrt(list_sum(list_transform(v, lambda t: t * t)) + 1e-6) AS nrm FROM x)
SELECT word, dim, {r6('x / nrm')} AS value FROM y""")(l2_normalize_q)


def cosine_knn(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    return V.knn(vec, vec, TOPN).select("query", "word", "rank", F.round("sim", 6).alias("sim"))


query("cosine_knn", f"""WITH {KNN_SQL} SELECT query, word, rank, {r6('sim')} AS sim FROM knn""")(cosine_knn)


def closest_class_score(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    s = V.closest_class_scores(vec, S.vector_lexicon(spark, sf_dir))
    return s.select("word", "cls", F.round("score", 6).alias("score"))


query("closest_class_score", f"""WITH {VEC_SQL}
SELECT a.word, b.cls, {r6('max(list_cosine_similarity(a.vec, b.vec))')} AS score
FROM v a, v b GROUP BY a.word, b.cls""")(closest_class_score)


def closest_class_rank(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    lex = S.vector_lexicon(spark, sf_dir)
    nb = V.knn(vec, vec, TOPN)
    out = V.closest_class_ranks(nb, lex, TOPN, vec)
    return out.select("word", "cls", F.round("rank_score", 6).alias("rank_score"))


query("closest_class_rank", f"""WITH {KNN_SQL},
hit AS (SELECT k.query, v.cls, min(k.rank) AS r FROM knn k JOIN v ON v.word = k.word GROUP BY k.query, v.cls),
grid AS (SELECT a.word, c.cls FROM v a, (SELECT DISTINCT cls FROM v) c)
SELECT g.word, g.cls, {r6(f'coalesce((h.r - 1) / {float(TOPN)}, 2.0)')} AS rank_score
FROM grid g LEFT JOIN hit h ON h.query = g.word AND h.cls = g.cls""")(closest_class_rank)


def mean_vector(spark, sf_dir):
    e = S.load(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("cls"),
                                                    F.col("embedding").cast("array<double>").alias("vec"))
    m = V.mean_vectors(e, "cls")
    return m.select("cls", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


query("mean_vector", f"""WITH {LONG_SQL} SELECT cls, dim, {r6('avg(v0)')} AS value FROM lv GROUP BY cls, dim""")(mean_vector)


def _iter_sql(step: str, n_iter: int, prev: str = "q0", cols: str = "word, cls, dim, v0, n") -> tuple[str, str]:
    """Chain of CTEs q1..qN where ``step`` is a SELECT over ``{prev}``."""
    parts = []
    for i in range(1, n_iter + 1):
        parts.append(f"q{i} AS ({step.format(prev=f'q{i - 1}')})")
    return ",\n".join(parts), f"q{n_iter}"


def retrofit_class(spark, sf_dir):
    return R.retrofit_class(S.vectors(spark, sf_dir), S.vector_lexicon(spark, sf_dir), 0.5, 0.5, N_ITER)


_R1_STEP = """SELECT p.word, p.cls, p.dim, p.v0, p.n,
  CASE WHEN p.n > 0 THEN (p.n * 0.5 * p.v0 + 0.5 * (s.S - p.q)) / (p.n * 1.0) ELSE p.v0 END AS q
  FROM {prev} p JOIN (SELECT cls, dim, sum(q) AS S FROM {prev} GROUP BY cls, dim) s USING (cls, dim)"""
_r1_chain, _r1_last = _iter_sql(_R1_STEP, N_ITER)
query("retrofit_class", f"""WITH {LONG_SQL},
sz AS (SELECT cls, count(DISTINCT word) - 1 AS n FROM lv GROUP BY cls),
q0 AS (SELECT lv.*, sz.n, lv.v0 AS q FROM lv JOIN sz USING (cls)),
{_r1_chain}
SELECT word, dim, {r6('q')} AS value FROM {_r1_last}""")(retrofit_class)


def retrofit_repel(spark, sf_dir):
    return R.retrofit_repel(S.vectors(spark, sf_dir), S.vector_lexicon(spark, sf_dir), 1.0, 1.0, 1.0, N_ITER)


_R2_STEP = """SELECT p.word, p.cls, p.dim, p.v0, p.n,
  CASE WHEN p.n > 0 THEN (p.n * 1.0 * p.v0 + 1.0 * (s.S - p.q) - 1.0 * (t.T - s.S)) / (p.n * 2.0) ELSE p.v0 END AS q
  FROM {prev} p JOIN (SELECT cls, dim, sum(q) AS S FROM {prev} GROUP BY cls, dim) s USING (cls, dim)
  JOIN (SELECT dim, sum(q) AS T FROM {prev} GROUP BY dim) t USING (dim)"""
_r2_chain, _r2_last = _iter_sql(_R2_STEP, N_ITER)
query("retrofit_repel", f"""WITH {LONG_SQL},
sz AS (SELECT cls, count(DISTINCT word) - 1 AS n FROM lv GROUP BY cls),
q0 AS (SELECT lv.*, sz.n, lv.v0 AS q FROM lv JOIN sz USING (cls)),
{_r2_chain}
SELECT word, dim, {r6('q')} AS value FROM {_r2_last}""")(retrofit_repel)


def retrofit_graph(spark, sf_dir):
    return R.retrofit_graph(S.vectors(spark, sf_dir), S.edges(spark, sf_dir), N_ITER)


_R4_STEP = """SELECT p.word, p.dim, p.v0, p.n,
  CASE WHEN p.n > 0 THEN (p.n * p.v0 + s.nsum) / (2.0 * p.n) ELSE p.v0 END AS q
  FROM {prev} p LEFT JOIN (SELECT e.src AS word, x.dim, sum(x.q) AS nsum FROM e JOIN {prev} x ON x.word = e.dst
                           GROUP BY e.src, x.dim) s USING (word, dim)"""
_r4_chain, _r4_last = _iter_sql(_R4_STEP, N_ITER)
query("retrofit_graph", f"""WITH {LONG_SQL},
e AS (SELECT DISTINCT src, dst FROM (
        SELECT vec_id::VARCHAR AS src, (lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id))::VARCHAR AS dst FROM embeddings
        UNION ALL
        SELECT vec_id::VARCHAR AS src, (lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id))::VARCHAR AS dst FROM embeddings)
      WHERE dst IS NOT NULL),
deg AS (SELECT src AS word, count(*) AS n FROM e GROUP BY src),
q0 AS (SELECT lv.word, lv.dim, lv.v0, deg.n, lv.v0 AS q FROM lv LEFT JOIN deg USING (word)),
{_r4_chain}
SELECT word, dim, {r6('q')} AS value FROM {_r4_last}""")(retrofit_graph)


def _token_keys(spark, sf_dir):
    """A document's tokens as vector words: a token's length, and "A" and the
    length for tokens that hold one (no vector has such a word)."""
    d = S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("t"))
    return d.select("doc_id", F.transform("t", lambda w: F.concat(F.when(F.contains(w, F.lit("a")), F.lit("A")).otherwise(""), F.length(w).cast("string"))).alias("keys"))


def doc_vectors(spark, sf_dir):
    """Whole documents as concatenated vectors: their length, and a sum
    of all values that counts each by its place."""
    v = V.doc_vectors(_token_keys(spark, sf_dir), F.col("keys"), S.vectors(spark, sf_dir), 64)
    cells = v.select("doc_id", F.size("vec").cast("long").alias("n_values"), F.posexplode_outer("vec").alias("i", "x"))
    weighted = F.coalesce(F.sum(F.col("x") * (F.col("i") % 89 + 1)), F.lit(0.0))
    return cells.groupBy("doc_id", "n_values").agg(F.round(weighted, 3).alias("weighted"))


query("doc_vectors", f"""WITH {DOC_TOKENS_CTE},
k AS (SELECT doc_id, pos, CASE WHEN contains(tok, 'a') THEN NULL ELSE length(tok)::VARCHAR END AS word FROM dt),
e AS (SELECT vec_id::VARCHAR AS word, unnest(embedding::DOUBLE[]) AS x, unnest(generate_series(0, len(embedding) - 1)) AS d FROM embeddings),
m AS (SELECT k.doc_id, sum(x * ((k.pos * 64 + d) % 89 + 1)) AS weighted FROM k JOIN e USING (word) GROUP BY k.doc_id)
SELECT doc_id, n * 64 AS n_values, round(coalesce(weighted, 0), 3) + 0.0 AS weighted
FROM (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) LEFT JOIN m USING (doc_id)""")(doc_vectors)


LABELS = [str(i) for i in range(10)]


def closest_block(spark, sf_dir):
    """M10's vector block: mean closest-class scores of a document's tokens of
    the kept tags."""
    d = _token_keys(spark, sf_dir).join(S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("t")), "doc_id")
    tags = F.transform("t", lambda w: S.pos_tag(w, ("SHORT", "MEDIUM", "LONG")))
    words = d.select(F.explode("keys").alias("word")).select(F.lower("word").alias("word")).distinct()
    scores = V.closest_class_scores(S.vectors(spark, sf_dir), S.vector_lexicon(spark, sf_dir), words)
    block = P.closest_block(d, F.col("keys"), scores, LABELS, P.MEAN, tags, ["MEDIUM", "LONG"])
    return block.select("doc_id", "name", F.round("value", 6).alias("value"))


query("closest_block", f"""WITH {DOC_TOKENS_CTE},
k AS (SELECT doc_id, CASE WHEN contains(tok, 'a') THEN 'a' ELSE '' END || length(tok) AS word FROM dt WHERE length(tok) > 3),
w AS (SELECT DISTINCT word FROM k),
c AS (SELECT DISTINCT label::VARCHAR AS cls FROM embeddings),
s AS (SELECT w.word, m.label::VARCHAR AS cls, max(list_cosine_similarity(e.embedding::DOUBLE[], m.embedding::DOUBLE[])) AS score
  FROM w JOIN embeddings e ON e.vec_id::VARCHAR = w.word, embeddings m GROUP BY ALL),
n AS (SELECT doc_id, word, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT doc_id, c.cls, sum(n * coalesce(s.score, -1.0)) / sum(n) AS v
  FROM n CROSS JOIN c LEFT JOIN s ON s.word = n.word AND s.cls = c.cls GROUP BY ALL)
SELECT doc_id, 'closest-' || c.cls AS name, {r6('coalesce(v, 0)')} AS value
FROM documents CROSS JOIN c LEFT JOIN f USING (doc_id, cls)""")(closest_block)


def synonyms(spark, sf_dir):
    """The lines of a synonym list, a class's words (sorted) in pieces."""
    pieces = L.invert(S.vector_lexicon(spark, sf_dir))
    return pieces.select("cls", "piece", F.array_join("terms", " ").alias("line"), F.col("n_terms").alias("n_words"))


query("synonyms", f"""WITH p AS (SELECT label::VARCHAR AS cls, vec_id::VARCHAR AS term,
  (row_number() OVER (PARTITION BY label ORDER BY vec_id::VARCHAR) - 1) // {L.PIECE} AS piece FROM embeddings)
SELECT cls, piece, string_agg(term, ' ' ORDER BY term) AS line, count(*) AS n_words FROM p GROUP BY ALL""")(synonyms)


def antonyms(spark, sf_dir):
    """C4: for each word, one row per other class (its antonym list is that
    class's synonym line).  The other classes come in numbered
    pieces of the class list (no theta join); word lists are not repeated per word, which
    would emit every cross-class word pair."""
    from lexivec.operators.similarity import with_pieces
    from lexivec.session import sized_broadcast
    lex = S.vector_lexicon(spark, sf_dir)
    sizes = lex.groupBy(F.col("cls").alias("other_cls")).agg(F.count(F.lit(1)).alias("n_antonyms"))
    w = with_pieces(lex, lex.select(F.col("cls").alias("other_cls")), "other_cls").where("cls <> other_cls")
    return w.join(sized_broadcast(sizes), "other_cls").select("term", "cls", "other_cls", "n_antonyms")


query("antonyms", """WITH l AS (SELECT vec_id::VARCHAR AS term, label::VARCHAR AS cls FROM embeddings),
sz AS (SELECT cls, count(*) AS n_antonyms FROM l GROUP BY cls)
SELECT a.term, a.cls, b.cls AS other_cls, b.n_antonyms FROM l a JOIN sz b ON b.cls <> a.cls""")(antonyms)


def _questions(spark, sf_dir):
    """Analogy questions from the vector table: four consecutive ids of a label
    (section = label; sections in the order of their first id)."""
    from lexivec.operators.ordering import successors
    e = S.load(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = successors(e, "label", "vec_id", [1, 2, 3])
    q = n.select(F.col("label").cast("string").alias("section"), F.col("vec_id").cast("string").alias("a"),
                 F.col("vec_id_1").cast("string").alias("b"), F.col("vec_id_2").cast("string").alias("c"),
                 F.col("vec_id_3").cast("string").alias("d"))
    order = e.groupBy(F.col("label").cast("string").alias("section")).agg(F.min("vec_id").alias("section_no"))
    return q.where(F.col("d").isNotNull()).withColumn("qid", F.col("a")).join(order, "section")


def analogy_accuracy(spark, sf_dir):
    return V.analogy_accuracy(_questions(spark, sf_dir), S.vectors(spark, sf_dir))


query("analogy_accuracy", f"""WITH {VEC_SQL},
u AS (SELECT word, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda t: t * t)))) AS u FROM v),
q AS (SELECT * FROM (SELECT label::VARCHAR AS section, vec_id::VARCHAR AS a,
        (lead(vec_id, 1) OVER (PARTITION BY label ORDER BY vec_id))::VARCHAR AS b,
        (lead(vec_id, 2) OVER (PARTITION BY label ORDER BY vec_id))::VARCHAR AS c,
        (lead(vec_id, 3) OVER (PARTITION BY label ORDER BY vec_id))::VARCHAR AS d FROM embeddings) WHERE d IS NOT NULL),
qv AS (SELECT q.*, list_transform(generate_series(1, len(ua.u)), lambda i: ub.u[i] - ua.u[i] + uc.u[i]) AS qv
       FROM q JOIN u ua ON ua.word = q.a JOIN u ub ON ub.word = q.b JOIN u uc ON uc.word = q.c),
best AS (SELECT * FROM (SELECT qv.a, qv.section, qv.d, x.word AS answer,
           row_number() OVER (PARTITION BY qv.a ORDER BY list_cosine_similarity(qv.qv, x.vec) DESC, x.word) AS r
         FROM qv JOIN v x ON x.word NOT IN (qv.a, qv.b, qv.c)) WHERE r = 1),
per AS (SELECT section, count(*) AS n_questions, sum((answer = d)::INTEGER) AS n_correct FROM best GROUP BY section),
ranked AS (SELECT per.*, row_number() OVER (ORDER BY o.first) AS sr FROM per JOIN (SELECT label::VARCHAR AS section, min(vec_id) AS first FROM embeddings GROUP BY label) o USING (section))
SELECT section, CASE WHEN sr <= 5 THEN 'semantic' ELSE 'syntactic' END AS kind, n_questions::BIGINT AS n_questions,
  n_correct::BIGINT AS n_correct, {r6('n_correct / n_questions')} AS accuracy FROM ranked""")(analogy_accuracy)


SPILL_ITER, SPILL_D = 4, 0.1


def retrofit_spill(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    lex = S.vector_lexicon(spark, sf_dir)
    nb = V.knn(vec, vec.join(lex.withColumnRenamed("term", "word"), "word", "left_semi"), 5)
    return R.retrofit_spill(vec, lex, nb, 0.5, 0.5, SPILL_D, SPILL_ITER)


# One iteration: class step (r), class sums after it (c), then the spill (q).
_R3_CHAIN = ",\n".join(f"""r{i} AS (SELECT p.word, p.cls, p.dim, p.v0, p.n,
  CASE WHEN p.n > 0 THEN (p.n * 0.5 * p.v0 + 0.5 * (s.S - p.q)) / (p.n * 1.0) ELSE p.q END AS q
  FROM q{i - 1} p JOIN (SELECT cls, dim, sum(q) AS S FROM q{i - 1} GROUP BY cls, dim) s USING (cls, dim)),
c{i} AS (SELECT cls, dim, sum(q) AS S FROM r{i} GROUP BY cls, dim),
q{i} AS (SELECT r.word, r.cls, r.dim, r.v0, r.n,
  CASE WHEN w.k IS NULL THEN r.q ELSE {SPILL_D} * ({SPILL_D} * o.n * 0.5 * r.v0 + 0.5 * (c.S - o.q)) END AS q
  FROM r{i} r LEFT JOIN win w ON w.k = r.word LEFT JOIN r{i} o ON o.word = w.query AND o.dim = r.dim
  LEFT JOIN c{i} c ON c.cls = o.cls AND c.dim = o.dim)""" for i in range(1, SPILL_ITER + 1))

query("retrofit_spill", f"""WITH {LONG_SQL},
sz AS (SELECT cls, count(DISTINCT word) - 1 AS n FROM lv GROUP BY cls),
q0 AS (SELECT lv.*, sz.n, lv.v0 AS q FROM lv JOIN sz USING (cls)),
{VEC_SQL},
nb AS (SELECT * FROM (SELECT a.word AS query, a.cls, b.word AS k,
         row_number() OVER (PARTITION BY a.word ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.word) AS rank
       FROM v a JOIN v b ON a.word <> b.word) WHERE rank <= 5),
win AS (SELECT k, max(query) AS query FROM nb JOIN sz ON sz.cls = nb.cls AND sz.n > 0 GROUP BY k),
{_R3_CHAIN}
SELECT word, dim, {r6('q')} AS value FROM q{SPILL_ITER}""")(retrofit_spill)
