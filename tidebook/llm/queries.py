"""The registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import ann, bpe, collocations, common, decontaminate, html_extract, language_model, licence_scan, near_dedup, quality, secret_scan, suffix_dedup, toxicity, vector_codes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(common.crc_mod("doc_id", 3) == 1, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.col("toxic_clauses").alias("n_clauses"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    spans = secret_scan.find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(common.table(spark, sf_dir, "documents"), common.crc_mod("doc_id", 7) == 2)


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(common.table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item"]).alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("least_edits"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(common.table(spark, sf_dir, "embeddings"), label="label")
    rows = vector_codes.totals_by_label(common.cut_lineage(coded), "error")
    code = F.concat(*(F.lower(F.lpad(F.hex(F.col("codes")[i]), 2, "0")) for i in range(vector_codes.PARTS)))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", F.col("total").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan.find_licences(common.table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    base = F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",")
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), base.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_quality": op2_quality, "op3_toxicity": op3_toxicity, "op4_neighbours": op4_neighbours, "op5_secret_scan": op5_secret_scan, "op6_html_extract": op6_html_extract, "op7_language_model": op7_language_model, "op8_bpe_roundtrip": op8_bpe_roundtrip, "op9_near_dedup": op9_near_dedup, "op10_decontaminate": op10_decontaminate, "op11_vector_codes": op11_vector_codes, "op12_licence_scan": op12_licence_scan, "op13_collocations": op13_collocations}


#: All 50-byte windows as hexadecimal digits; spans join where a window begins at most 50 bytes after the one before.
SUFFIX_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, MIN(doc_id) OVER (PARTITION BY s) AS first_doc FROM w) WHERE first_doc < doc_id),
g AS (SELECT doc_id, i, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i - LAG(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM t)),
sp AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 49 AS b FROM g GROUP BY doc_id, span),
cut AS (SELECT doc_id, a, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, b FROM sp),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) || substr(any_value(h), 2 * MAX(b) + 1) AS k, SUM(b - a + 1) AS removed, COUNT(*) AS spans FROM cut JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(COALESCE(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Full shingle sets, links by a join on shingles, components by reachability.
NEAR_SQL = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
 GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * COUNT(*) >= 75 * (nx.n + ny.n - COUNT(*))),
r AS (SELECT a AS doc, b AS other FROM l UNION SELECT r.doc, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc, MIN(other) AS m FROM r GROUP BY doc)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(c.m, d.doc_id)) AS component_id, LEAST(d.doc_id, COALESCE(c.m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc = d.doc_id"""



def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds written out one after the other, every round over all parts."""
    steps = ["""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, i AS part, v[i * (len(v) // {parts}) + 1 : (i + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(i))",
        f"c0 AS MATERIALIZED (SELECT part, ROW_NUMBER() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, MIN((d, e)) AS b FROM (SELECT p.vec_id, p.part, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} c USING (part)) GROUP BY ALL)")
        if r < rounds:
            moved = f"(SELECT part, e, list(q ORDER BY j) AS v FROM (SELECT part, b[2] AS e, j, CAST(floor_div(SUM(x), COUNT(*)) AS BIGINT) AS q FROM (SELECT a.part, a.b, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS j FROM a{r} a JOIN p USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL)"
            moved = moved.replace("floor_div(SUM(x), COUNT(*))", "(SUM(x) - ((SUM(x) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, COALESCE(m.v, c.v) AS v FROM c{r} c LEFT JOIN {moved} m USING (part, e))")
    return "WITH " + ",\n".join(steps) + f""",
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT vec_id, string_agg(printf('%02x', b[2]), '' ORDER BY part) AS code, CAST(SUM(b[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT f.vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), s"""


#: All phrases by position, scores in whole numbers of 128 bits.
PHRASES_SQL = """WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pc),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 4) t(k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, COUNT(*) AS f FROM g GROUP BY ALL HAVING COUNT(*) >= 10),
n AS (SELECT lang, SUM(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, cut, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score FROM c
 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT lang, k, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, MIN(score) AS score FROM s GROUP BY ALL),
h AS (SELECT lang, phrase, MAX(a) AS most FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM b WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express over ``documents``; the others need a trained model, a tokenizer, an edit distance or an index, and tests/llm holds brute-force versions."""
    return {"op1_suffix_dedup": SUFFIX_SQL, "op9_near_dedup": NEAR_SQL, "op13_collocations": PHRASES_SQL}


def vector_oracle_sql() -> dict[str, str]:
    """The same over ``embeddings``."""
    return {"op11_vector_codes": codes_sql()}
