"""The queries over the operators, and SQL for what SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversation, langid, lm, media, near_dup, neural, packing, secrets, warc, whitening
from .common import crc32_of

WORD_TOKENS = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENS))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(_read(spark, sf_dir, "documents"))


def _verdicts(scores: DataFrame, modulus: int, remainder: int, least: float) -> DataFrame:
    return scores.select("doc_id", (crc32_of("doc_id") % modulus == remainder).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(crc32_of("doc_id") % 3 != 1)
    return _verdicts(neural.quality_scores(_read(spark, sf_dir, "documents"), labels), 3, 1, 0.5)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two deliveries, by the last sign of their source's name; the second scans only what the first had not."""
    docs = _read(spark, sf_dir, "documents")
    delivery = F.ascii(F.right(F.coalesce("source", F.lit("")), F.lit(1))) % 2 + 1
    found, _ = secrets.scan(docs, deliveries=delivery)
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.spans_line(base), 256).alias("base_sha256"), secrets.spans_line(spans).alias("spans"), "generation")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(_read(spark, sf_dir, "documents"), lm.held_out_rows(2, 7))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, with_ids=False)


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = _read(spark, sf_dir, "documents"), crc32_of("doc_id") % 4 != 2
    return _verdicts(neural.toxicity_scores(docs, _read(spark, sf_dir, "labels").where(learn), docs.where(learn)), 4, 2, 0.3)


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(_read(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return conversation.audits(conversation.damaged(rows), rows)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_read(spark, sf_dir, "documents"), crc32_of("doc_id") % 3 != 1)
    return found.select("doc_id", (crc32_of("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(_read(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_media_columns, op3_quality_classifier, op4_secret_scan, op5_near_duplicates, op6_language_scores, op7_byte_bpe, op8_nearest_vectors, op9_toxicity, op10_warc_archives, op11_conversation_repair, op12_language_id, op13_embedding_whitening)}



def _secret_sql() -> str:
    """Each rule's matches and what lies between them, so starts are sums of lengths."""
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    tables, n = [], len(secrets.RULES)
    for i, r in enumerate(secrets.RULES):
        value = f"regexp_replace(m, {quoted('^' + r.prefix)}, '')" if r.prefix else "m"
        tables.append(
            f"f{i} AS (SELECT doc_id, t, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS ms, string_split_regex(t, {quoted(r.pattern)}) AS gaps FROM docs), "
            f"o{i} AS (SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS nth FROM f{i} WHERE len(ms) > 0), "
            f"s{i} AS (SELECT doc_id, {i} AS no, '{r.kind}' AS kind, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY nth) AS stop, length({value}) >= {r.least} AS ok FROM o{i})"
        )
    every = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(n))
    line, base = "string_agg(said, ',' ORDER BY start, no)", ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, min(ascii(right(coalesce(source, ''), 1)) % 2 + 1) OVER (PARTITION BY coalesce(text, '')) AS generation FROM documents), {', '.join(tables)},
      placed AS (SELECT doc_id, no, kind, CAST(stop - length(m) AS BIGINT) AS start, kind || ':' || CAST(CAST(stop - length(m) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS said FROM ({every}) WHERE ok),
      found AS (SELECT doc_id, {counts}, {line} AS spans, {line} FILTER (kind IN ({base})) AS base FROM placed GROUP BY 1)
      SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(generation AS INTEGER) AS generation FROM docs d LEFT JOIN found USING (doc_id)"""


def _repair_sql() -> str:
    """Forward over the rows: for each of the four states (nothing, system, user, assistant last) the cheapest edits so far and, of equally
    cheap ones, the least in ASCII, with the rows that they leave."""
    far, kept = 1_000_000_000, {"e": "", "s": "e", "u": "esa", "a": "u"}
    add = lambda state, cost, edit, line: f"{{'c': {state}.c + {cost}, 'said': {state}.said || '{edit}', 'kept': {state}.kept || CASE WHEN {state}.kept = '' THEN '' ELSE chr(10) END || {line}}}"
    least = lambda options: f"list_sort([{', '.join(options)}])[1]"
    placed = {"u": "'user:'", "a": "'assistant:'"}
    inserted = lambda first, before: least([first, *(add(x, 2, "I", placed[first]) for x in before)])

    def after(to: str) -> str:
        options = [f"{{'c': {to}.c + 3, 'said': {to}.said || 'D', 'kept': {to}.kept}}"]
        for x in kept[to]:
            options.append(f"CASE WHEN NOT must AND role[1] = '{to}' THEN {add(x, 'cut', 'K', chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')} ELSE never END")
            if to in placed:
                options.append(f"CASE WHEN NOT must THEN {add(x, '2 + cut', 'R', placed[to] + ' || text')} ELSE never END")
        return f"{least(options)} AS {to}"

    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    return rf"""WITH RECURSIVE fed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
      hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM fed, (VALUES (0), (1)) AS t(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS tail FROM hurt),
      seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
      marked AS (SELECT *, tail = '' OR again AS must, CASE WHEN tail = '' OR again OR tail IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut FROM seen),
      counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (tail = '') AS blank, count(*) FILTER (tail <> '' AND again) AS duplicate, coalesce(sum(cut), 0) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY 1),
      walk(conv_id, i, e, s, u, a) AS (
        SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'said': '', 'kept': ''}}, {{'c': {far}::BIGINT, 'said': '', 'kept': ''}}, {{'c': {far}::BIGINT, 'said': '', 'kept': ''}}, {{'c': {far}::BIGINT, 'said': '', 'kept': ''}} FROM counts
        UNION ALL
        SELECT conv_id, i + 1, {after('e')}, {after('s')}, {after('u')}, {after('a')} FROM (
          SELECT * REPLACE ({inserted('a', 'u')} AS a), {{'c': {far}::BIGINT, 'said': '', 'kept': ''}} AS never FROM (
            SELECT w.conv_id, w.i, e, s, {inserted('u', 'esa')} AS u, w.a, m.role, m.text, m.must, m.cut FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1))),
      ends AS (SELECT w.conv_id, e, s, a, {inserted('u', 'esa')} AS u FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n),
      best AS (SELECT conv_id, {least(['e', inserted('a', 'u')])} AS b FROM ends)
      SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.said, '') AS audit, sha256(coalesce(b.kept, '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""


#: Results of the other operators rest on tokenizers, trained models, searches that may miss, or forms that the
#: operator adds beside the contract's columns; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_secret_scan": _secret_sql(),
    "op5_near_duplicates": r"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS words FROM split),
      listed AS (SELECT doc_id, unnest(words) AS s FROM sets), sized AS (SELECT doc_id, len(words) AS n FROM sets),
      shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM listed a JOIN listed b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
      links AS (SELECT x, y FROM shared JOIN sized i ON i.doc_id = x JOIN sized j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
      sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), reached AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT r.doc_id, s.y FROM reached r JOIN sides s ON s.x = r.other),
      least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
      SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)""",
    "op11_conversation_repair": _repair_sql(),
    "op10_warc_archives": r"""WITH p AS (SELECT page_id, lower(trim(coalesce(url, ''))) AS u, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
      f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first, regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') AS host,
        coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM p),
      k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM f)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
        url_key, captured, row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) AS capture FROM k""",
}
