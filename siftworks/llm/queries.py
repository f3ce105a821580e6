"""The queries over these operators, and the SQL that gives the same rows where there is such."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents, table
from .decontam import hit_digest
from .exactdedup import exact_digest
from .fertility import judge
from .fim import fim_digest
from .linededup import removal_digest
from .merkle import manifest_digest
from .mixing import mix_digest
from .pii import pii_digest
from .records import token_records
from .secrets import secret_digest
from .sharding import shard_digest
from .simhash import near_duplicates
from .weaklabel import classify


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(documents(spark, sf_dir))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))


def op7_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(documents(spark, sf_dir))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op9_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(documents(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digest(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_token_records": op2_token_records,
    "op3_decontamination": op3_decontamination,
    "op4_rendezvous_sharding": op4_rendezvous_sharding,
    "op5_contextual_pii": op5_contextual_pii,
    "op6_weak_label_quality": op6_weak_label_quality,
    "op7_winnowing_line_dedup": op7_winnowing_line_dedup,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_tokenizer_fertility": op9_tokenizer_fertility,
    "op10_sainte_lague_mix": op10_sainte_lague_mix,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_SIBLINGS = "coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (WHERE u.i {0} w.i), '')"
_STEP = f"w.proof || {_SIBLINGS.format('<>')}, sha256({_SIBLINGS.format('<')} || w.h || {_SIBLINGS.format('>')})"

#: Only what SQL has: no XXH64, no tokenisers, no fits; those queries are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
j AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM j)),
x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM g)),
h AS (SELECT doc_id, s, x.n, item FROM x JOIN g ON g.n = x.n AND g.gram = array_to_string(list_slice(w, s, s + x.n - 1), ' ')),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id""",
    "op4_rendezvous_sharding": """
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda o: CAST('0x' || substr(h, o + 1, 2) AS BIGINT))), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) AS text_crc32 FROM b, t),
s AS (SELECT c.*, n.s, -ln((CAST('0x' || substr(md5(k || '#' || n.s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score FROM c CROSS JOIN range(9) n(s)),
m AS (SELECT doc_id, size, text_crc32, CAST(arg_min(s, score) FILTER (WHERE s < 8) AS INTEGER) AS shard, CAST(arg_min(s, score) AS INTEGER) AS grown_shard FROM s GROUP BY doc_id, size, text_crc32)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), doc_id) - 1 AS BIGINT) AS slot, grown_shard FROM m""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
k AS (SELECT doc_id, text, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256 FROM o""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = 1 AS kept, sha256(t) AS text_sha256 FROM g""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
c AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x))), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) % 2 = 0 AS tampered FROM documents d, t),
k AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, CASE WHEN tampered THEN {_LEAF.format("replace(text, chr(10), '')")} END AS told FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM k),
up AS (SELECT source, 0 AS lv, i, leaf AS d, n FROM b UNION ALL SELECT source, lv + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lv, i // 3, n),
subs AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, i, d, n FROM subs UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lv, i // 3, n),
one AS (SELECT source, i AS leaf_at, 0 AS lv, i, n, '' AS proof, coalesce(told, leaf) AS h FROM b UNION ALL
 SELECT w.source, w.leaf_at, w.lv + 1, w.i // 3, (w.n + 2) // 3, {_STEP} FROM one w JOIN up u ON u.source IS NOT DISTINCT FROM w.source AND u.lv = w.lv AND u.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.source, w.leaf_at, w.lv, w.i, w.n, w.proof, w.h),
two AS (SELECT o.source, leaf_at, 0 AS lv, s.i, s.n, proof, h FROM one o JOIN subs s ON s.source IS NOT DISTINCT FROM o.source WHERE o.n = 1 UNION ALL
 SELECT w.source, w.leaf_at, w.lv + 1, w.i // 3, (w.n + 2) // 3, {_STEP} FROM two w JOIN top u ON u.lv = w.lv AND u.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.source, w.leaf_at, w.lv, w.i, w.n, w.proof, w.h)
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.d AS verified
FROM b JOIN two ON two.source IS NOT DISTINCT FROM b.source AND two.leaf_at = b.i AND two.n = 1 JOIN subs s ON s.source IS NOT DISTINCT FROM b.source, (SELECT d FROM top WHERE n = 1) r""",
}
