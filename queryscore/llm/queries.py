"""The queries of this package over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queryscore.llm import decision_list, decontaminate, exact_dedup, licences, mixture, near_dedup, pii, prefix_trie, quality_fm, substring_dedup, toxicity, warc, whitening
from queryscore.llm.scratch import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = decision_list.apply_rules(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"]
    )
    return rules.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query(oracle=rf"""
WITH sized AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM sources
), ordered AS (
    SELECT *, sum(source_size) OVER () AS everything,
           sum(source_size) OVER (w ROWS UNBOUNDED PRECEDING) AS sizes,
           sum(weight) OVER () - sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) + weight AS later
    FROM weighed
    WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
), limited AS (
    SELECT *, source_size * 2 * later <= (CAST(1.5 AS DOUBLE) * everything - (sizes - source_size) * 2) * weight AS at_limit
    FROM ordered
), goals AS (
    SELECT source, source_size,
           CASE WHEN at_limit THEN CAST(source_size * 2 AS DOUBLE) ELSE
               (CAST(1.5 AS DOUBLE) * everything - sum(CASE WHEN at_limit THEN source_size * 2 ELSE 0 END) OVER ())
               * weight / sum(CASE WHEN at_limit THEN 0 ELSE weight END) OVER () END AS target
    FROM limited
), ranked AS (
    SELECT doc_id, size, source_size, target,
           row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS FIRST) - 1 AS k,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor((k + 1) * rate + {mixture.offset()!r}::DOUBLE) - floor(k * rate + {mixture.offset()!r}::DOUBLE)) AS BIGINT) * size AS taken
FROM ranked
""")
def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query(oracle=r"""
WITH paid AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM paid
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
""")
def op7_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"]
    )


def _labels_and_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")


@query()
def op5_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _labels_and_texts(spark, sf_dir)
    return toxicity.classify(docs, labels, ["doc_id"]).select("doc_id", "held_out", "score", "predicted")


@query()
def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _labels_and_texts(spark, sf_dir)
    return quality_fm.classify(docs, labels, ["doc_id"]).select("doc_id", "held_out", "score", "predicted")


@query()
def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id", "copies", "links")


@query()
def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{licences._COPYRIGHT_LINE}', '', 'g')"
    out = rf"' ' || trim(regexp_replace(replace({out}, '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for one, other in licences.SPELLINGS:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim({out})"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.KNOWN)


@query(oracle=f"""
WITH known AS (
    SELECT sha256({_canonical_sql('t')}) AS digest, min(licence) AS licence FROM (VALUES {_KNOWN_SQL}) k(licence, t) GROUP BY 1
), digested AS (
    SELECT row_number() OVER () AS r, doc_id, text, sha256({_canonical_sql('text')}) AS text_digest FROM documents
), noticed AS (
    SELECT r, list_sort(list_distinct(list(licence))) AS names FROM (
        SELECT r, unnest(string_split(text, chr(10))) AS line FROM digested
    ) JOIN known ON digest = sha256({_canonical_sql('line')}) WHERE regexp_matches(line, '{licences._SPEAKS}') GROUP BY r
)
SELECT doc_id, text_digest, licence, coalesce(array_to_string(names, ','), '') AS notices
FROM digested LEFT JOIN known ON text_digest = digest LEFT JOIN noticed USING (r)
""")
def op2_canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.builtin(spark), ["doc_id"])


@query(oracle=r"""
WITH spaced AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM spaced
""")
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.components_of(vectors, "embedding", ["vec_id"])


@query(oracle=r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
               lambda crc, c: list_reduce([xor(crc, c)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, bit: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h
    FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT c.conv_id, t.pos AS k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1000000000 + t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), placed AS (
    SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS size,
           md5(string_agg(md5(role) || md5(text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), members AS (
    SELECT conv_id, depth, size, node FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), last_of AS (
    SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id
), nodes AS (
    SELECT node, m.depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
           string_agg(CASE WHEN m.depth = l.depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
    FROM members m JOIN last_of l USING (conv_id) GROUP BY node, m.depth
), linked AS (
    SELECT n.*, p.node AS up FROM nodes n LEFT JOIN members p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), children AS (
    SELECT up AS node, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY up
), whole AS (
    SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (node)
), below AS (
    SELECT a.node, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved
    FROM whole w JOIN members a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.node
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM whole w JOIN below b USING (node) LEFT JOIN nodes p ON p.node = w.up
""")
def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))
