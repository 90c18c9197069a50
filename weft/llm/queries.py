"""The queries over the text tables, one for each operator, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontamination, fill_middle, filter_audit, line_dedup, mixing, ppm, quality, sentencepiece_codec, simhash, substring_dedup, suffix_dedup, token_counts, toxicity

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_words(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), short=True).drop("kept_text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.with_digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_divergence,
        op2_suffix_array_dedup,
        op3_sentencepiece_codec,
        op4_token_counts,
        op5_substring_dedup,
        op6_toxicity,
        op7_lm_scoring,
        op8_line_dedup,
        op9_decontamination,
        op10_simhash_near_dedup,
        op11_filter_audit,
        op12_source_mixing,
        op13_fill_middle,
    )
}

_LOW = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"

ORACLES = {
    "op2_suffix_array_dedup": """
        WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        wins AS (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS nth
                 FROM (SELECT doc_id, unnest(list_transform(range(n - 99), lambda s: md5_number(array_slice(t, s + 1, s + 100)))) AS m, unnest(range(n - 99)) AS s FROM docs WHERE n >= 100)),
        later AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM wins WHERE nth > 1),
        runs AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM later),
        spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY 1, 2),
        edges AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
                  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY 1),
        kept AS (SELECT d.doc_id, string_agg(hex(array_slice(t, a + 1, coalesce(b, n))), '' ORDER BY a) AS k FROM docs d JOIN edges e ON d.doc_id = e.doc_id GROUP BY 1),
        counts AS (SELECT doc_id, count(*) AS n_spans FROM spans GROUP BY 1)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - coalesce(length(k) // 2, n) AS BIGINT) AS n_removed,
               CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, hex(t)))) AS kept_sha256
        FROM docs d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "op9_decontamination": f"""
        WITH i AS (SELECT item_id, {_LOW} AS w FROM benchmark), d AS (SELECT doc_id, {_LOW} AS w FROM documents),
        si AS (SELECT DISTINCT item_id, list_slice(w, s, s + 4) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS s FROM i WHERE len(w) > 4)),
        sd AS (SELECT DISTINCT doc_id, list_slice(w, s, s + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) > 4)),
        n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY 1),
        c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sd JOIN si ON sd.g = si.g GROUP BY 1, 2)
        SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles""",
    "op5_substring_dedup": rf"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM docs WHERE len(w) >= 20),
        wins AS (SELECT doc_id, s, row_number() OVER (PARTITION BY list_slice(w, s + 1, s + 20) ORDER BY doc_id, s) AS nth FROM starts),
        gone AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS i FROM wins WHERE nth > 1),
        each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
        kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t, count(*) AS n
                 FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op11_filter_audit": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
        x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) AS n, list_unique(w) AS k, length(t) AS c,
                     len(regexp_extract_all(t, '[A-Z]')) AS u, regexp_matches(t, '[#$%&*|]') AS marked, coalesce(doc_id > first, doc_id IS NULL AND first IS NOT NULL) AS late
              FROM (SELECT *, regexp_extract_all(t, '{WORDS}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d) LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, good, toxic, (n < 200)::INT + 2 * (100 * k < 50 * n)::INT + 4 * (100 * u > 2 * c)::INT + 8 * marked::INT + 16 * late::INT AS m FROM x),
        c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
        o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a JOIN f b ON b.name <> a.name JOIN f c ON c.name NOT IN (a.name, b.name)
              JOIN f d ON d.name NOT IN (a.name, b.name, c.name) JOIN f e ON e.name NOT IN (a.name, b.name, c.name, d.name)),
        s AS (SELECT filter_order, step, bit AS f, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
              FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o) JOIN f ON filter_order[step] = name)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (m & (b | f) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (m & f <> 0 AND m & b = 0), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (m & f <> 0 AND m & b <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (m = f), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (m & f <> 0 AND m & b = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (m & f <> 0 AND m & b = 0), 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(n * 120 // greatest(bit_count(m), 1)) FILTER (m & f <> 0), 0) AS BIGINT) AS shapley
        FROM c CROSS JOIN s GROUP BY part, filter_order, step, f, b""",
    "op12_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
        a AS (SELECT source, sum(size)::BIGINT AS s, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY 1),
        r AS (SELECT *, [5, 2, 1][sid % 3 + 1] AS w, 2.0 * s / [5, 2, 1][sid % 3 + 1] AS r, sum(s) OVER () AS words, sum(n) OVER () AS n_all FROM a),
        g AS (SELECT r, coalesce(sum(2 * s) OVER before, 0) AS given, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free, words, lag(r) OVER (ORDER BY r, sid) AS below FROM r
              WINDOW before AS (ORDER BY r, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT max((1.5 * words - given) / free) AS level FROM g WHERE (1.5 * words - given) / free <= r AND (below IS NULL OR (1.5 * words - given) / free >= below)),
        q AS (SELECT sid, source, s, least(w * coalesce(level, 0), 2.0 * s)::DOUBLE AS target,
                     greatest(ceil(s / greatest(4096, ceil(words / 1048576))), ceil(n / greatest(64, ceil(n_all / 1048576))), 1)::BIGINT AS need FROM r, v),
        b AS (SELECT *, CASE WHEN need = 1 THEN 0 ELSE length(bin(need - 1)) END AS bits FROM q),
        p AS (SELECT d.*, sid, s, target, ('0x' || h[1:15])::BIGINT AS k1, ('0x' || h[16:30])::BIGINT AS k2, ('0x' || h[1:15])::BIGINT & ((1::BIGINT << bits) - 1) AS block FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
        e AS (SELECT sid, bits, pass, quota, ('0x' || md5('0:' || sid || ':' || pass)[1:15])::BIGINT % (1::BIGINT << 48) AS salt FROM (
              SELECT *, 1 AS pass, least(round(target)::BIGINT, s) AS quota FROM b UNION ALL SELECT *, 2, greatest(round(target)::BIGINT - s, 0) FROM b) WHERE quota > 0),
        x AS (SELECT *, (d * 741103597 + (salt >> 24)) & ((1::BIGINT << bits) - 1) AS y FROM (SELECT *, unnest(range(1::BIGINT << bits)) AS d FROM e)),
        o AS (SELECT *, (xor(y, y >> greatest(1, ceil(bits / 2))::INT) * 612420109 + (salt & 16777215)) & ((1::BIGINT << bits) - 1) AS block FROM x),
        w AS (SELECT sid, block, sum(size) AS words FROM p GROUP BY 1, 2),
        t AS (SELECT o.sid, pass, o.block, coalesce(words, 0) AS words, quota, coalesce(sum(words) OVER (PARTITION BY o.sid, pass ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM o LEFT JOIN w ON o.sid = w.sid AND o.block = w.block),
        u AS (SELECT sid, block, k1, k2, size, count(*) AS m FROM p GROUP BY ALL),
        z AS (SELECT u.*, pass, least(words, quota - before) AS cut, coalesce(sum(size * m) OVER (PARTITION BY u.sid, u.block, pass ORDER BY CASE pass WHEN 1 THEN k1 ELSE k2 END, k1, k2, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM u JOIN t ON u.sid = t.sid AND u.block = t.block WHERE before < quota),
        c AS (SELECT sid, block, k1, k2, size, sum(least(size, greatest(0, (cut - ahead) // m))) AS taken FROM z GROUP BY 1, 2, 3, 4, 5)
        SELECT doc_id, p.size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
        FROM p LEFT JOIN c ON p.sid = c.sid AND p.block = c.block AND p.k1 = c.k1 AND p.k2 = c.k2 AND p.size = c.size""",
    "op13_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
                          WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, least(a, b)), ''), '') AS pre, coalesce(array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), ''), '') AS mid,
                     coalesce(array_to_string(list_slice(u, greatest(a, b) + 1, n), ''), '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
}
