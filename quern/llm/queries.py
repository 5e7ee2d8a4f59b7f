"""The registered queries of this subpackage; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_dedup import window_dedup

    return window_dedup(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import planted, run_digest

    return run_digest(table(spark, sf_dir, "documents"), rewrite=planted)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import grafted, prefix_trie

    return prefix_trie(grafted(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_ann": op9_ann,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_window_dedup": op11_window_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Unsigned CRC-32 of a column's decimal digits, bit by bit.
_STEP = "xor(s, CASE WHEN k % 8 = 0 THEN ascii(substr(CAST({id} AS VARCHAR), k // 8 + 1, 1)) ELSE 0 END)"
_CRC32 = f"xor(list_reduce(range(0, 8 * length(CAST({{id}} AS VARCHAR))), lambda s, k: xor({_STEP} >> 1, CASE WHEN {_STEP} % 2 = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295)"

#: DuckDB SQL for the queries above that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
      bi AS (SELECT item, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0),
      win AS (SELECT DISTINCT item, k, array_to_string(ws[i : i + k - 1], ' ') AS w FROM bi), ks AS (SELECT DISTINCT k FROM win),
      di AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k), dg AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS w FROM di),
      hit AS (SELECT doc_id, item, k, i FROM dg JOIN win USING (k, w)), wi AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hit), n AS (SELECT doc_id, count(*) AS n_hit FROM wi GROUP BY doc_id),
      it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
      SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_suffix_dedup": """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
      o AS (SELECT doc_id, hx, n, unnest(range(0, n - 99, 500)) AS o FROM h WHERE n >= 100), bx AS (SELECT doc_id, n, o, substr(hx, 2 * o + 1, 1198) AS bx FROM o),
      p AS (SELECT doc_id, o, bx, unnest(range(least(500, n - 99 - o))) AS i FROM bx), w AS (SELECT doc_id, o + i AS p, row_number() OVER (PARTITION BY md5(substr(bx, 2 * i + 1, 200)) ORDER BY doc_id, o + i) AS r FROM p),
      s AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS opens FROM w WHERE r > 1), g AS (SELECT doc_id, p, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM s),
      runs AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, g), m AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
      e AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, n, n FROM h), k AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS f FROM e),
      kept AS (SELECT doc_id, string_agg(substr(hx, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS kx FROM k JOIN h USING (doc_id) GROUP BY doc_id)
      SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kx)) AS kept_sha256 FROM h JOIN kept USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_window_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
      w AS (SELECT doc_id, place, string_agg(word, ' ') OVER following AS x, count(*) OVER following AS n FROM words WINDOW following AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
      h AS (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY md5(x)) AS earliest FROM w WHERE n = 13),
      gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place FROM h WHERE earliest < doc_id),
      kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kx FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
      SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kx, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_periodic_runs": r"""WITH o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, CRC AS h FROM documents),
      p AS (SELECT doc_id, ws, len(ws) AS n, h, (h // 10) % greatest(len(ws), 1) AS a FROM o), q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
      d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM q),
      w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM d),
      e AS (SELECT x.doc_id, y.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
      g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e),
      r AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
      runs AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
      s AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'n': length, 'p': period}, (-length, start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
      gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
      k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kx FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
      SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.p AS period, 1000 * b.n // b.p AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(kx, '')) AS collapsed_sha256, n AS n_words, n - coalesce(n_kept, 0) AS n_dropped
      FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)""".replace("CRC", _CRC32.format(id="doc_id")),
    "op13_prefix_trie": """WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
      c AS (SELECT conv_id, CRC % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)),
      n AS (SELECT c.conv_id, h, base, count(b.i) AS taken FROM c LEFT JOIN t b ON b.conv_id = base AND b.i <= h GROUP BY c.conv_id, h, base),
      s AS (SELECT n.conv_id, i AS d, r, t FROM n JOIN t b ON b.conv_id = base AND i <= h UNION ALL SELECT n.conv_id, taken + i - h, r, t FROM n JOIN t USING (conv_id) WHERE i > h),
      p AS (SELECT conv_id, d, length(t) AS len, md5(string_agg(md5(length(r) || ':' || r || t), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM n),
      q AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS pk, max(d) OVER (PARTITION BY conv_id) AS total FROM p),
      v AS (SELECT k, min(d) AS depth, min(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, min(len) AS len, string_agg(CASE WHEN d = total THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM q GROUP BY k),
      m AS (SELECT pk AS k, count(*) AS m FROM v WHERE pk IS NOT NULL GROUP BY pk), f AS (SELECT v.*, coalesce(m, 0) AS m FROM v LEFT JOIN m USING (k)),
      u AS (SELECT q.k, CAST(sum(CAST(m = 0 AS INT)) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * f.len) AS BIGINT) AS saved_tokens FROM f JOIN q ON q.conv_id = f.conv_id AND q.d <= f.depth GROUP BY q.k)
      SELECT f.conv_id, f.depth, o.conv_id AS parent_conv_id, f.n_convs, f.m AS n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256 FROM f JOIN u USING (k) LEFT JOIN v o ON o.k = f.pk""".replace("CRC", _CRC32.format(id="conv_id")),
}
