"""The operators of this subpackage as queries over the supplied tables, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from codeloom.llm import isolation, nbsvm, toxicity
from codeloom.llm.decontaminate import contamination
from codeloom.llm.exact_dedup import exact_duplicates
from codeloom.llm.fill_middle import fill_in_middle, restored
from codeloom.llm.html_text import extract_main_text
from codeloom.llm.license_scan import BLOCK, PHRASES, STRIDE, TEMPLATES, THRESHOLD, scan_licenses
from codeloom.llm.near_dedup import near_duplicates
from codeloom.llm.packing import packed
from codeloom.llm.sstable import read_summaries, write_shards
from codeloom.llm.subword import tokenizer_path
from codeloom.llm.token_counts import length_histogram, suffix_sums
from codeloom.sources.tables import table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op4_sstable_shards(spark: SparkSession, folder: str) -> DataFrame:
    return read_summaries(write_shards(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op5_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out), "toxic")
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_sums(length_histogram(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op10_nbsvm_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = nbsvm.fit(docs, labels.filter(~held_out), "quality")
    return nbsvm.quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_isolation_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return isolation.rule_verdicts(docs, isolation.fit(docs, table(spark, folder, "labels"), "quality"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle(table(spark, folder, "documents"), seed=7, fim_percent=100, spm_percent=50)
    sums = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sums)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sstable_shards": op4_sstable_shards,
    "op5_cost_packing": op5_cost_packing,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_token_histogram": op8_token_histogram,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_nbsvm_quality": op10_nbsvm_quality,
    "op11_isolation_rules": op11_isolation_rules,
    "op12_fill_in_middle": op12_fill_in_middle,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"



def _license_rows() -> str:
    """Phrases and templates as SQL rows: label, tokens, key, least share."""
    every = [(label, text, text, 1.0) for label, text in PHRASES] + [(label, text, key, *(own or [THRESHOLD])) for label, text, key, *own in TEMPLATES]
    return ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')), '{key}', {share})" for label, text, key, share in every)


_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, w, unnest(range(0, len(w) - {len(text.split()) - 1})) AS i FROM words) WHERE " + " AND ".join(f"w[i + {n + 1}] = '{t}'" for n, t in enumerate(text.split()))
    for label, text in PHRASES
)

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
places AS ({_PLACES}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
),
templates(label, tokens, key, least) AS (VALUES {_license_rows()}),
blocks AS (
  SELECT doc_id, s, w[s + 1:s + {BLOCK}] AS b
  FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS s FROM words) WHERE s = 0 OR s + {STRIDE} < len(w)
),
shares AS (
  SELECT doc_id, s, label, least, len(list_intersect(b, tokens)) / len(tokens) AS share, contains(' ' || array_to_string(b, ' ') || ' ', ' ' || key || ' ') AS named
  FROM blocks, templates
),
matched AS (SELECT * FROM shares WHERE share >= least - 1e-9),
found AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score, count(DISTINCT s) AS n_blocks
  FROM matched WHERE named GROUP BY doc_id
),
best AS (SELECT doc_id, count(DISTINCT s) AS n_matched, first(label ORDER BY share DESC, label) AS best_label, max(share) AS best_share FROM matched GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels,
       coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0) AS score, coalesce(f.n_blocks, 0) AS n_blocks,
       coalesce(m.n_matched, 0) AS n_matched, coalesce(m.best_label, '') AS best_label, coalesce(m.best_share, 0.0) AS best_share
FROM words w LEFT JOIN base b ON b.doc_id = w.doc_id LEFT JOIN found f ON f.doc_id = w.doc_id LEFT JOIN best m ON m.doc_id = w.doc_id
""",
    "op3_exact_dedup": f"""
WITH folded AS (SELECT doc_id, {_FOLD} AS body FROM documents),
grouped AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY body)
SELECT f.doc_id, g.keep_id, g.group_size, f.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(f.body) AS text_sha256
FROM folded f JOIN grouped g ON f.body = g.body
""",
    "op7_decontamination": f"""
WITH items AS (SELECT item_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
),
docs AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
),
found AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.phrase = v.phrase),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
owned AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN owned o ON d.doc_id = o.doc_id
""",
    "op9_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.c >= 75 * (x.n + y.n - c.c)
),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS other FROM words UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT p.doc_id, coalesce(s.n, 0) AS n_shingles, p.component_id, p.doc_id = p.component_id AS kept
FROM parts p LEFT JOIN sizes s ON s.doc_id = p.doc_id
""",
    "op12_fill_in_middle": r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbered AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM base
),
cut AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
),
parts AS (
  SELECT doc_id, n, form, t, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s
  FROM cut
),
made AS (
  SELECT doc_id, n, form, p, m, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
  FROM parts
),
split AS (
  SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3)
         || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
         ELSE substr(output, strpos(output, '<P>') + 3) END AS rest
  FROM made
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'spm' THEN replace(rest, '<M>', '') || substr(output, 4, strpos(output, '<P>') - 4) ELSE rest END) AS restored_sha256
FROM split
""",
}
