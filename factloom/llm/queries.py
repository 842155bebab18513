"""The registered queries of the corpus operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import audit, chat, decontaminate, knn, licenses, mixing, neardup, pii, secrets, tokens, toxicity, vq, warc
from factloom.llm.common import table

#: Equal payloads of at least so many bytes are revisits.
REVISIT_BYTES = 0


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), least=REVISIT_BYTES)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id", "lang", "source"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), words=2)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vq.compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_warc,
        op3_tokens,
        op4_topk,
        op5_secrets,
        op6_toxicity,
        op7_chat,
        op8_mixing,
        op9_neardup,
        op10_decontaminate,
        op11_licenses,
        op12_codes,
        op13_filter_audit,
    )
}

_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

_OP10 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[p : p + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, p, w[p : p + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw CROSS JOIN sizes WHERE len(w) >= n)
), found AS (
  SELECT s.doc_id, s.p, s.n, x.item_id FROM spots s JOIN windows x ON s.n = x.n AND s.win = x.win
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def _share_sql(name: str, above: str, keys: list[str]) -> str:
    """One level of the tree: children share their parent's budget by weight, up to capacity."""
    level, parent = keys[-1], keys[:-1]
    weight = "".join(f" WHEN {level} = '{v}' THEN {w}" for v, w in (mixing.WEIGHTS.get(level) or {}).items())
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    cols = ", ".join(keys)
    return f"""
{name}_r AS (
  SELECT *, capacity / w AS ratio FROM (
    SELECT {cols}, capacity, budget, {f"CASE{weight} ELSE 1.0 END" if weight else "1.0"}::DOUBLE AS w
    FROM (SELECT {cols}, sum(capacity) AS capacity FROM leaves GROUP BY {cols}) {join})
), {name}_f AS (
  SELECT *, ratio <= rate AS is_full FROM (
    SELECT *, (budget - coalesce(sum(capacity) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {name}_r)
), {name} AS (
  SELECT {cols}, CASE WHEN is_full THEN capacity ELSE w * max(CASE WHEN NOT is_full THEN rate END) OVER ({by}) END AS budget
  FROM {name}_f
)"""


_OP8 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce('d' || translate(left(md5(source), 1), '0123456789abcdef', '0000111122223333'), '') AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {mixing.MAX_EPOCHS} AS DOUBLE) AS capacity
  FROM docs GROUP BY ALL
), top AS (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {mixing.SHARE}) AS budget FROM leaves),
{_share_sql("a", "top", ["domain"])},
{_share_sql("b", "a", ["domain", "lang"])},
{_share_sql("c", "b", ["domain", "lang", "source"])},
planned AS (
  SELECT *, CASE WHEN epochs < {mixing.MAX_EPOCHS} THEN quota - epochs * tokens ELSE 0 END AS rest FROM (
    SELECT *, CAST(least(quota // tokens, {mixing.MAX_EPOCHS}) AS BIGINT) AS epochs FROM (
      SELECT domain, lang, source, tokens, CAST(floor(budget) AS BIGINT) AS quota
      FROM leaves JOIN c USING (domain, lang, source) WHERE tokens > 0))
), ordered AS (
  SELECT doc_id, domain, lang, source, n, epochs, rest,
    sum(n) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{mixing.SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM docs JOIN planned USING (domain, lang, source)
)
SELECT doc_id, lang, source, domain AS mix_domain, n AS mix_tokens, copies FROM (
  SELECT *, CAST(epochs + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ordered
) WHERE copies > 0
"""


def _lloyd_sql(rounds: int = 6) -> str:
    """Rounds of Lloyd's method, a pair of tables each."""
    far = "list_sum(list_transform(generate_series(1, len(p.part)), lambda i: (p.part[i] - b.part[i]) * (p.part[i] - b.part[i])))"
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
, a{r} AS MATERIALIZED (
  SELECT rid, j, part, k, far FROM (
    SELECT p.rid, p.j, p.part, b.k, {far} AS far, row_number() OVER (PARTITION BY p.rid, p.j ORDER BY {far}, b.k) AS r
    FROM p JOIN b{r} b ON p.j = b.j) WHERE r = 1
)"""
        if r < rounds:
            steps += f"""
, b{r + 1} AS MATERIALIZED (
  SELECT b.j, b.k, coalesce(n.part, b.part) AS part FROM b{r} b LEFT JOIN (
    SELECT j, k, list((s - ((s % c) + c) % c) // c ORDER BY i) AS part FROM (
      SELECT j, k, i, CAST(sum(part[i]) AS BIGINT) AS s, count(*) AS c
      FROM (SELECT j, k, part, unnest(generate_series(1, len(part))) AS i FROM a{r}) GROUP BY j, k, i) GROUP BY j, k
  ) n ON b.j = n.j AND b.k = n.k
)"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id, e) AS rid FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (
  SELECT rid, j, e[j * (len(e) // 8) + 1 : (j + 1) * (len(e) // 8)] AS part FROM v, (SELECT unnest(generate_series(0, 7)) AS j)
), b0 AS MATERIALIZED (SELECT j, rid - 1 AS k, part FROM p WHERE rid <= 16)
{steps}
, coded AS (
  SELECT rid, string_agg(format('{{:02x}}', CAST(k AS INTEGER)), '' ORDER BY j) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
), digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY j, k)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM v JOIN coded USING (rid) CROSS JOIN digest
"""


_OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM t
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), states AS (
  SELECT part, a, b, c, d, e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM judged LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p FROM (SELECT v.f || w.f || x.f || y.f || z.f AS p FROM letters v, letters w, letters x, letters y, letters z)
  WHERE len(list_distinct(string_split(p, ''))) = 5
), gone AS (
  SELECT part, p, step, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * good) AS BIGINT) AS good, CAST(sum(n * toxic) AS BIGINT) AS toxic FROM (
    SELECT part, p, n, good, toxic, least(CASE WHEN a THEN instr(p, 'A') ELSE 6 END, CASE WHEN b THEN instr(p, 'B') ELSE 6 END,
      CASE WHEN c THEN instr(p, 'C') ELSE 6 END, CASE WHEN d THEN instr(p, 'D') ELSE 6 END, CASE WHEN e THEN instr(p, 'E') ELSE 6 END) AS step
    FROM states CROSS JOIN orders) GROUP BY part, p, step
), failing AS (
  SELECT part, f, CAST(sum(CASE WHEN fails THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS BIGINT) AS alone
  FROM (
    SELECT part, f, n, CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
      a::INT + b::INT + c::INT + d::INT + e::INT AS many FROM states CROSS JOIN letters) GROUP BY part, f
), whole AS (SELECT part, CAST(sum(n) AS BIGINT) AS n FROM states GROUP BY part),
every AS (
  SELECT part, p, step, substr(p, step, 1) AS f, whole.n AS whole, coalesce(gone.n, 0) AS removed, coalesce(gone.good, 0) AS good_lost,
    coalesce(gone.toxic, 0) AS toxic_lost
  FROM whole CROSS JOIN orders CROSS JOIN (SELECT unnest(generate_series(1, 5)) AS step) LEFT JOIN gone USING (part, p, step)
)
SELECT part, p AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(whole - sum(removed) OVER (PARTITION BY part, p ORDER BY step) AS BIGINT) AS kept, removed, failing.n - removed AS redundant,
  failing.alone AS unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM every JOIN failing USING (part, f)
"""

ORACLES: dict[str, str] = {
    "op4_topk": _OP4,
    "op8_mixing": _OP8,
    "op10_decontaminate": _OP10,
    "op12_codes": _lloyd_sql(),
    "op13_filter_audit": _OP13,
}
