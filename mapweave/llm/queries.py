"""The registered queries of the operators, with production parameters, and their SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from mapweave.llm import decontam, embed, idstore, merkle, middle, packing, pii, quality, secrets, simhash, substring, toxicity, warc

LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
#: A stand-in for the secret, which a caller passes as `key`.
PII_KEY = "rotate-me"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, d):
    return quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_simhash_near_dedup(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


def op3_embedding_near_dedup(spark, d):
    return embed.near_duplicates(table(spark, d, "embeddings"))


def op4_best_fit_packing(spark, d):
    return packing.packed(table(spark, d, "documents"), public_tokenizers.path(TOKENIZER), LIMIT)


def op5_suffix_array_dedup(spark, d):
    return substring.deduplicated(table(spark, d, "documents"))


def op6_benchmark_decontamination(spark, d):
    return decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op7_toxicity(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_secret_scan(spark, d):
    return secrets.secrets(table(spark, d, "documents"))


def op9_pii_pseudonyms(spark, d, key=PII_KEY):
    out = pii.pseudonymised(table(spark, d, "documents"), key, counts=True)
    return out.select("doc_id", "text", *[F.col(f"n_{k}") for k in pii.KINDS])


def op10_warc(spark, d):
    return warc.archived(table(spark, d, "pages"))


def op11_merkle_manifest(spark, d):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    out = merkle.manifest(table(spark, d, "documents"), seen={"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_token_id_files(spark, d):
    return idstore.stored(table(spark, d, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def op13_fill_in_middle(spark, d):
    out = middle.filled(table(spark, d, "documents"))
    sums = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sums)


Q = {f.__name__: f for f in (op1_quality_classifier, op2_simhash_near_dedup, op3_embedding_near_dedup, op4_best_fit_packing, op5_suffix_array_dedup,
                             op6_benchmark_decontamination, op7_toxicity, op8_secret_scan, op9_pii_pseudonyms, op10_warc, op11_merkle_manifest, op12_token_id_files, op13_fill_in_middle)}

def _tree(nodes: str, name: str, levels: int) -> str:
    """Levels over nodes (g, n, pos, node); the last of them holds each group's last node, and p{level} each node's siblings."""
    parts = [f"{name}0 AS (SELECT * FROM {nodes})"]
    for k in range(levels):
        run = "OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
        parts.append(f"""{name}_p{k} AS (SELECT g, pos, n, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS (SELECT g, (any_value(n) + 7) // 8 AS n, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {name}{k} GROUP BY g, pos // 8)""")
    return ",\n".join(parts)


def _fold(rows: str, name: str, levels: int, out: str) -> str:
    """rows (g, pos, proof, now, ...) folded up the levels of a tree."""
    parts, before = [], rows
    for k in range(levels):
        step = out if k == levels - 1 else f"{out}_{k}"
        parts.append(f"""{step} AS (SELECT x.* EXCLUDE (pos, proof, now), x.pos // 8 AS pos, CASE WHEN p.n = 1 THEN proof ELSE proof || l || r END AS proof, CASE WHEN p.n = 1 THEN now ELSE sha256(l || now || r) END AS now FROM {before} AS x JOIN {name}_p{k} AS p USING (g, pos))""")
        before = step
    return ",\n".join(parts)


def _merkle_sql(levels: int = 8) -> str:
    """The manifest for up to 8**levels rows in a language and as many languages."""
    def leaf(text: str) -> str:
        fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f})::VARCHAR || ':' || {f} END" for f in fields) + ")"
    # crc32 of a short decimal text: eight steps of the reflected polynomial for each byte
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]), lambda a, b: {bits})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rows AS (SELECT doc_id, lang, {leaf('text')} AS node, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS now FROM documents),
placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows),
nodes AS (SELECT g, n, pos, node FROM placed),
{_tree("nodes", "t", levels)},
over AS (SELECT 0 AS g, count(*) OVER () AS n, g AS pos, node FROM t{levels}),
{_tree("over", "o", levels)},
begun AS (SELECT doc_id, node AS leaf, g, pos, '' AS proof, now FROM placed),
{_fold("begun", "t", levels, "low")},
linked AS (SELECT doc_id, leaf, node AS subroot, 0 AS g, low.g AS pos, proof, now FROM low JOIN t{levels} AS s ON s.g = low.g),
{_fold("linked", "o", levels, "high")}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = node AS verified FROM high, o{levels}"""


S = {
    "op11_merkle_manifest": _merkle_sql(),
    "op13_fill_in_middle": r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
h AS (SELECT *, len(u) AS n, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT for i in range(4)] AS r FROM drawn),
cut AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts""",
    "op6_benchmark_decontamination": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM sized, unnest(range(1, len(w) - n + 2)) AS u(i)),
places AS (SELECT doc_id, w, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM words, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT doc_id, i, p.n, item_id FROM places AS p JOIN windows AS x ON p.t = x.t AND p.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_warc": r"""
WITH RECURSIVE hex AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (SELECT page_id, payload_bytes, h, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1), '' ORDER BY k) FROM range(32) AS r(k)) AS payload_digest FROM hex),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM ranked""",
}
