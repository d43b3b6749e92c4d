"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm import quality
from corpuslens.llm.chat import PART_TURNS, format_chats
from corpuslens.llm.common import table
from corpuslens.llm.jaccard import jaccard_components
from corpuslens.llm.langid import fit_language_model, in_fold, predict_language
from corpuslens.llm.packing import PIECE_NAMES, pack_documents
from corpuslens.llm.pii import pseudonymise
from corpuslens.llm.repeats import remove_repeats
from corpuslens.llm.sampling import sample_pieces
from corpuslens.llm.search import rank_documents
from corpuslens.llm.secrets import find_secrets, secret_digest
from corpuslens.llm.topk import inner_product_topk
from corpuslens.llm.toxicity import fit_severity, score_severity
from corpuslens.llm.whitening import whiten_embeddings

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE).select(*PIECE_NAMES)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_severity(docs, fit_severity(docs, table(spark, sf_dir, "labels")), "doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"))
    model = fit_language_model(docs.where(~held_out))
    return predict_language(docs, model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings"), k=8)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_retrieval_packing,
        op2_suffix_dedup,
        op3_toxicity,
        op4_quality_rules,
        op5_piece_sampling,
        op6_jaccard_join,
        op7_chat_format,
        op8_pii,
        op9_voronoi_topk,
        op10_language_id,
        op11_embedding_whitening,
        op12_lexical_search,
        op13_secret_scan,
    )
}

SQL_BLANK = r"[\x20\x09-\x0D]+"

REPEATS_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM t),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b,
             CASE WHEN length(h) // 2 - i >= 50 THEN md5(substr(h, 2 * i + 1, 100)) END AS g FROM p),
m AS (SELECT *, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS hit FROM s),
c AS (SELECT doc_id, i, b, coalesce(max(CASE WHEN hit THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM m),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM c),
k AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
             string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""

#: The function words that the rule on them counts, written out for the SQL on its own.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are as with by this le la les de des du et un une que qui dans en pour "
    "der die das und ist von den mit ein eine nicht zu el los las del y que en una por con para no"
)

QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{SQL_BLANK}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT doc_id, pos, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(' ', word,
             lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
             lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS g
      FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM g),
r AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM c),
n AS (SELECT doc_id, sum(inside) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             length(t) - length(translate(t, '!?', '')) AS n_marks,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: list_contains(string_split('{FUNCTION_WORDS}', ' '),
                                                         trim(lower(x), '.,;:!?()[]{{}}"''«»„“”…')))) AS n_stop
      FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 100000 AND word_chars / n_words BETWEEN 3.0 AND 10.0
       AND n_symbols / n_words <= 0.1 AND n_marks / n_words <= 0.5 AND n_stop / n_words BETWEEN 0.03 AND 0.8
       AND n_dup_lines / n_lines <= 0.4 AS kept
FROM v
"""

JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_BLANK}'),
         lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
y AS (SELECT doc_id, n, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
      FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', word, w2, w3) AS g FROM y WHERE w3 IS NOT NULL OR (n < 3 AND pos = 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN c ca ON ca.doc_id = i.a JOIN c cb ON cb.doc_id = i.b
      WHERE 100 * i.n >= 90 * (ca.n + cb.n - i.n)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
"""

CHAT_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS r, coalesce(text, '') AS x
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn, r, x) AS l, count(*) AS n FROM t GROUP BY conv_id),
u AS (SELECT l, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l, n),
k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.l[1] = a.l[1] AND b.n > a.n AND b.l[1:a.n] = a.l)),
e AS (SELECT conv_id, n, n_copies, unnest(l) AS m, generate_subscripts(l, 1) AS pos FROM k)
SELECT conv_id, ((pos - 1) // {PART_TURNS})::BIGINT AS part, min(n)::BIGINT AS n_turns, min(n_copies)::BIGINT AS n_copies,
       string_agg('<|im_start|>' || m.r || chr(10) ||
                  regexp_replace(m.x, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') || '<|im_end|>' || chr(10),
                  '' ORDER BY pos) AS text
FROM e GROUP BY conv_id, (pos - 1) // {PART_TURNS}
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.e, b.e)::BIGINT AS score
      FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, ws, len(ws) AS n FROM t WHERE len(ws) > 0),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT doc_id, n, unnest(ws) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
v AS (SELECT q.item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM v WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES = {
    "op2_suffix_dedup": REPEATS_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op6_jaccard_join": JACCARD_SQL,
    "op7_chat_format": CHAT_SQL,
    "op9_voronoi_topk": TOPK_SQL,
    "op12_lexical_search": SEARCH_SQL,
}
