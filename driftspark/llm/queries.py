"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import (
    bpe,
    centroids,
    chat_format,
    decontaminate,
    filter_audit,
    jaccard_join,
    kd_search,
    language_id,
    license_scan,
    lm_score,
    phrase_dedup,
    quality_rules,
    suffix_dedup,
)
from driftspark.llm._common import read


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the driver finds a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), tokenizer_file())


def op3_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digest_documents(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("blocks")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_documents(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(planted).alias("text"))
                    for t, r in enumerate(("user", "assistant"))
                )
            )
        ).alias("x")
    )
    own = own.select(F.lit(-7).cast("long").alias("conv_id"), "x.turn", "x.role", "x.text")
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat_format.read_back(chat_format.format_examples(table))
    loss = F.array_join("losses", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centres = centroids.cluster(read(spark, sf_dir, "embeddings"))
    sums = centroids.inertia(state)
    own = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in sums.items() for x in pair)), F.col("cluster").cast("long")) if sums else F.lit(None).cast("long")
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        own.alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.sha2(centroids.text_of(centres, F.col("cluster")), 256).alias("centroid_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_bpe": op2_bpe,
        "op3_kd_search": op3_kd_search,
        "op4_decontaminate": op4_decontaminate,
        "op5_phrase_dedup": op5_phrase_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_language_id": op8_language_id,
        "op9_chat_format": op9_chat_format,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_filter_audit": op11_filter_audit,
        "op12_centroids": op12_centroids,
        "op13_quality_rules": op13_quality_rules,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_SPACED = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"


#: A table of masks by brute force: failures of each document, then every order is applied to them.
_AUDIT = r"""WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 e AS (SELECT a.rid FROM d a WHERE EXISTS (SELECT 1 FROM d b WHERE b.t = a.t AND b.doc_id < a.doc_id)),
 f AS (SELECT rid, coalesce(lang, '') AS part, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), rid IN (SELECT rid FROM e)] AS fails FROM d),
 n AS (SELECT part, fails, len(list_filter(fails, lambda x: x)) AS k, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY ALL),
 l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), o AS (SELECT [a.i, b.i, c.i, g.i, h.i] AS o FROM l a, l b, l c, l g, l h WHERE len(list_distinct([a.i, b.i, c.i, g.i, h.i])) = 5),
 s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o), x AS (SELECT n.*, o, step, fails[o[step]] AS here, len(list_filter(o[1 : step - 1], lambda j: fails[j])) > 0 AS gone FROM n, s)
 SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
 CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT here), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND here), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE gone AND here), 0) AS BIGINT) AS redundant,
 CAST(coalesce(sum(n) FILTER (WHERE here AND k = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n_good) FILTER (WHERE NOT gone AND here), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (WHERE NOT gone AND here), 0) AS BIGINT) AS toxic_lost,
 CAST(coalesce(sum(sum(n) FILTER (WHERE NOT gone AND here)) OVER (PARTITION BY part, o[step]), 0) AS BIGINT) AS shapley FROM x GROUP BY part, o, step"""


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """All distances to all centroids, in every round."""
    dot = "list_dot_product({0}, {1})"
    gap = f"CAST({dot.format('v.e', 'v.e')} - 2 * {dot.format('v.e', 'c.e')} + {dot.format('c.e', 'c.e')} AS BIGINT)"
    steps = [
        f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 c0 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL) WHERE c < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(e) AS e, min_by(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT v.rid, v.vec_id, v.e, c.c, {gap} AS d FROM v, c{r} c) GROUP BY rid)")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i),
 c{r + 1} AS (SELECT c, coalesce(n.e, o.e) AS e FROM c{r} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM m{r} GROUP BY c) n USING (c))""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(f.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} f USING (c)"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express, in DuckDB's; brute force over whole tables, for small ones."""
    return {
        "op3_kd_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op4_decontaminate": f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
 s AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), k AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
 x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k))),
 h AS (SELECT doc_id, item, unnest(range(i, i + n)) AS pos FROM x JOIN k USING (n, g)), t AS (SELECT doc_id, count(DISTINCT pos) AS n_hit, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN t USING (doc_id)""",
        "op5_phrase_dedup": f"""WITH d AS (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents), x AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d)),
 f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)), h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM x JOIN f USING (g) WHERE doc_id > first),
 s AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d), k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM s ANTI JOIN h USING (doc_id, pos) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
        "op9_chat_format": r"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
 o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
 8 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)(/?s>)', '<\\\1\2', 'g')) + length(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g')) AS chars FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
 e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
        "op10_jaccard_join": f"""WITH d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k))
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN
 (WITH RECURSIVE r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id""",
        "op11_filter_audit": _AUDIT,
        "op12_centroids": _cluster_sql(),
    }
