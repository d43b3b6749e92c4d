"""The same results in plain SQL, written against the driver tables for DuckDB."""

from __future__ import annotations

import math

from corpuslens.functions import readability as R, tags, text as X
from corpuslens.operators.grid import DEFAULT_PRESET, PRESETS
from corpuslens.plans.catalog import MEASURES, ORDER_FEATURES, ORDER_WEIGHTS
from corpuslens.schema import FEATURES, TRUTH_LABELS


def words_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def r(expr: str, digits: int = 6) -> str:
    """Rounded by plain double arithmetic, which is the same in every engine."""
    scale = f"{10**digits}::DOUBLE"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5::DOUBLE) / {scale})"


def join(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


# --- text -----------------------------------------------------------------------------

CLEAN = (
    r"lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), "
    r"'(\b\w\b *)', ' ', 'g'), '\s+', ' ', 'g')))"
)


def tokens_sql(clean: str) -> str:
    for a, b in X.FUSED_WORDS:
        clean = rf"regexp_replace({clean}, '\b({a})({b})\b', '\1 \2', 'g')"
    return f"list_filter(string_split({clean}, ' '), lambda t: t <> '')"


STOP = words_in(X.STOP_WORDS)
EASY = words_in(R.EASY_WORDS)
CONTENT = f"array_to_string(list_filter(tokens, lambda t: t NOT IN {STOP}), ' ')"

SIX_LABEL = "CAST(CAST(substr(source, 4) AS INTEGER) % 6 AS INTEGER)"
SIX = f"corpus AS (SELECT doc_id, text, n_chars, {SIX_LABEL} AS label FROM documents)"
BINARY = (
    "corpus AS (SELECT d.doc_id, d.text, d.n_chars, l.quality AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
ALL = "corpus AS (SELECT doc_id, text, 0 AS label FROM documents)"


def tokenised() -> str:
    return (
        f"cleaned AS (SELECT *, {CLEAN} AS clean FROM corpus),\n"
        f"tok AS (SELECT *, {tokens_sql('clean')} AS tokens FROM cleaned)"
    )


CONTENT_CORPUS = f"{tokenised()},\ndocs AS (SELECT doc_id, label, {CONTENT} AS text FROM tok)"

FLAT = (
    rf"trim(regexp_replace(regexp_replace(lower(text), '{R.PUNCTUATION}', '', 'g'), "
    rf"'{R.SPACE}', ' ', 'g'))"
)
THREE_WORDS = r"[^ \t\n\r\f][ \t\n\r\f]+[^ \t\n\r\f]+[ \t\n\r\f]+[^ \t\n\r\f]"


def syllables_sql(words: str) -> str:
    """Syllables of each word by the rule for a word: vowel groups, a final e after a consonant silent, at least 1."""
    return (
        f"list_transform({words}, lambda w: greatest(1, len(regexp_extract_all("
        "CASE WHEN length(w) > 1 AND w[-1:] = 'e' AND w[-2:-2] NOT IN ('a', 'e', 'i', 'o', 'u', 'y') "
        "THEN w[:-2] ELSE w END, '[aeiouy]+'))))"
    )


def sentences_sql(text: str) -> str:
    marked = f"regexp_replace({text}, '{R.PUNCTUATION_KEEP_MARKS}', '', 'g')"
    return (
        f"greatest(1, len(list_filter(string_split_regex({marked}, '[.!?]+'), "
        f"lambda s: regexp_matches(s, '{THREE_WORDS}'))))"
    )


def matches(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def counted() -> str:
    first = f"regexp_extract(text, '{R.FIRST_100}', 1)"
    first_flat = FLAT.replace("lower(text)", "lower(first)")
    return f"""flat0 AS (SELECT *, {FLAT} AS flat, {first} AS first FROM corpus),
flat1 AS (SELECT *, list_filter(string_split(flat, ' '), lambda w: w <> '') AS ws,
  {syllables_sql("list_filter(string_split(flat, ' '), lambda w: w <> '')")} AS syl,
  {syllables_sql(f"list_filter(string_split({first_flat}, ' '), lambda w: w <> '')")} AS first_syl, len(string_split_regex(first, '{R.SPACE}')) AS first_words,
  {sentences_sql('first')} AS first_sentences FROM flat0),
counted AS (SELECT *, len(ws) AS words,
  {sentences_sql('text')} AS sentences,
  coalesce(list_sum(syl), 0)::INTEGER AS syllables,
  len(list_filter(syl, lambda n: n >= 3)) AS polysyllables,
  len(list_filter(syl, lambda n: n < 2)) AS monosyllables,
  length(replace(flat, ' ', '')) AS letters,
  len(list_filter(ws, lambda w: length(w) <= 3)) AS miniwords,
  len(list_filter(ws, lambda w: w IN {EASY})) AS easy,
  len(list_filter(list_zip(ws, syl),
    lambda p: p[2] >= 3 AND p[1] NOT IN {EASY})) AS hard,
  len(list_filter(first_syl, lambda n: n >= 3)) AS first_hard FROM flat1)"""


LINSEAR = "((first_words - first_hard) + 3 * first_hard) / CAST(first_sentences AS DOUBLE)"
UNKNOWN = "(CASE WHEN words = 0 THEN 0.0 ELSE 100.0 * (words - easy) / words END)"
SCORES = {
    "flesch_reading_ease": "CASE WHEN words = 0 THEN 0.0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * "
    "(words / CAST(sentences AS DOUBLE)) - 84.6::DOUBLE * (syllables / CAST(words AS DOUBLE)) END",
    "flesch_kincaid_grade_level": "CASE WHEN words = 0 THEN 0.0 ELSE 0.39::DOUBLE * "
    "(words / CAST(sentences AS DOUBLE)) + 11.8::DOUBLE * (syllables / CAST(words AS DOUBLE)) - 15.59::DOUBLE END",
    "gunning_fog_scale": "0.4::DOUBLE * (words / CAST(sentences AS DOUBLE) + 100 * "
    "(CASE WHEN words = 0 THEN 0.0 ELSE hard / CAST(words AS DOUBLE) END))",
    "coleman_liau_index": "CASE WHEN words = 0 THEN 0.0 ELSE 0.058::DOUBLE * (100 * (letters / CAST(words AS DOUBLE))) "
    "- 0.296::DOUBLE * (100 * (sentences / CAST(words AS DOUBLE))) - 15.8::DOUBLE END",
    "linsear_write_formula": f"CASE WHEN first = '' THEN 0.0 WHEN {LINSEAR} > 20 THEN {LINSEAR} / 2 "
    f"ELSE ({LINSEAR} - 2) / 2 END",
    "dale_chall_readability": f"0.1579::DOUBLE * {UNKNOWN} + 0.0496::DOUBLE * (words / CAST(sentences AS DOUBLE)) "
    f"+ CASE WHEN {UNKNOWN} > 5 THEN 3.6365::DOUBLE ELSE 0 END",
    "mcalpine_eflaw_readability": "(words + miniwords) / CAST(sentences AS DOUBLE)",
    "reading_time": f"length(regexp_replace(text, '{R.SPACE}', '', 'g')) * 14.69::DOUBLE / 1000",
}


def tag_sql(word: str) -> str:
    known = " ".join(f"WHEN {word} IN {words_in(w.split())} THEN '{t}'" for t, w in tags.TAG_WORDS.items())
    ends = " ".join(f"WHEN suffix({word}, '{s}') THEN '{t}'" for s, t in tags.SUFFIX_TAGS)
    return f"CASE {known} {ends} ELSE '{tags.OTHER_TAG}' END"


def tagged() -> str:
    counts = ", ".join(
        f"len(list_filter(tag_list, lambda t: t IN {words_in(group)})) AS {name}"
        for name, group in tags.TAG_GROUPS.items()
    )
    return (
        f"tag0 AS (SELECT *, list_transform(tokens, lambda w: {tag_sql('w')}) AS tag_list FROM tok),\n"
        f"tagged AS (SELECT doc_id, {CONTENT} AS content, "
        f"len(list_filter(tokens, lambda t: t IN {STOP})) AS stopword_count, {counts} FROM tag0)"
    )


def features(corpus: str) -> str:
    """CTEs ending in `features(doc_id, text, 21 doubles, label)` for every document."""
    from_counts = {
        "syllable_count": "c.syllables",
        "lexicon_count": "c.words",
        "polysyllable_count": "c.polysyllables",
        "monosyllable_count": "c.monosyllables",
    }
    scores = ", ".join(f"{e} AS {n}" for n, e in SCORES.items())
    cols = ", ".join(
        f"CAST({from_counts.get(f, ('c.' if f in SCORES else 't.') + f)} AS DOUBLE) AS {f}" for f in FEATURES
    )
    return join(
        corpus,
        tokenised(),
        tagged(),
        counted(),
        f"scored AS (SELECT *, {scores} FROM counted)",
        f"features AS (SELECT c.doc_id, t.content AS text, {cols}, c.label FROM scored c "
        "JOIN tagged t ON c.doc_id = t.doc_id)",
    )


def scaled() -> str:
    return ", ".join(
        f"CASE WHEN max({f}) OVER w = min({f}) OVER w THEN 0.0 ELSE ({f} - min({f}) OVER w) / "
        f"(max({f}) OVER w - min({f}) OVER w) END AS {f}"
        for f in FEATURES
    )


SCALED = (
    f"scaled0 AS (SELECT doc_id, text, {scaled()}, label FROM features WINDOW w AS ()),\n"
    "scaled AS (SELECT * FROM scaled0 WHERE trim(text) <> '')"
)
ROUNDED = ", ".join(f"{r(f)} AS {f}" for f in FEATURES)


# --- splits ---------------------------------------------------------------------------


def key(ident: str = "doc_id", seed: str = "42") -> str:
    return f"md5('{seed}:' || {ident})"


def unit(ident: str, seed: str) -> str:
    return f"(('0x' || substr({key(ident, seed)}, 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def integer(ident: str, seed: str) -> str:
    return f"('0x' || substr({key(ident, seed)}, 1, 8))::BIGINT"


def stratified(source: str) -> str:
    """CTEs ending in `strat(all columns of source, split)`."""
    return f"""sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY label),
quota0 AS (SELECT label, n, CAST(total - ceil(round(0.2::DOUBLE * total, 9)) AS BIGINT) AS train, total FROM sizes),
quota1 AS (SELECT label, train, (train * n) // total AS low, (train * n) % total AS rest FROM quota0),
quota AS (SELECT label, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <=
  train - sum(low) OVER () THEN 1 ELSE 0 END AS q FROM quota1),
strat AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.label ORDER BY {key('s.doc_id')}, s.doc_id) <= q.q
  THEN 'train' ELSE 'test' END AS split FROM {source} s JOIN quota q ON s.label = q.label)"""


def three_way(source: str, held: float, cols: str) -> str:
    return f"""three0 AS (SELECT {cols}, row_number() OVER (ORDER BY {key()}, doc_id) AS rn, count(*) OVER () AS total FROM {source}),
three1 AS (SELECT *, CAST(ceil(round({held}::DOUBLE * total, 9)) AS BIGINT) AS held FROM three0),
three AS (SELECT {cols}, CASE WHEN rn <= total - held THEN 'train'
  WHEN rn <= total - CAST(ceil(held / 2.0) AS BIGINT) THEN 'test' ELSE 'validation' END AS split FROM three1)"""


# --- tf-idf ---------------------------------------------------------------------------


def tfidf(fit: str, use: str, low: int = 1, high: int = 1, min_df: float | None = None) -> str:
    """CTEs ending in `tfidf(doc_id, term, value)`; `fit` and `use` select (doc_id, text)."""
    runs = []
    for n in range(low, high + 1):
        if n == 1:
            runs.append("ws")
        else:
            runs.append(
                f"list_transform(range(1, greatest(len(ws) - {n - 2}, 1)), "
                f"lambda i: array_to_string(ws[i:i + {n - 1}], ' '))"
            )
    grams = runs[0] if len(runs) == 1 else f"list_concat({', '.join(runs)})"

    def counts(name: str, source: str) -> str:
        return (
            f"{name}_w AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda t: length(t) >= 2) AS ws "
            f"FROM ({source})),\n"
            f"{name}_g AS (SELECT doc_id, unnest({grams}) AS term FROM {name}_w),\n"
            f"{name} AS (SELECT doc_id, term, count(*) AS tf FROM {name}_g GROUP BY doc_id, term)"
        )

    least = "" if min_df is None else f"HAVING count(*) >= {min_df}::DOUBLE * (SELECT count(*) FROM ({fit}))"
    return f"""{counts('post', use)},
{counts('fitted', fit)},
vocab AS (SELECT term, count(*) AS docs, ln((1.0 + (SELECT count(*) FROM ({fit}))) / (1.0 + count(*))) + 1.0 AS idf
  FROM fitted GROUP BY term {least}),
weighted AS (SELECT doc_id, term, tf * CAST(idf AS DOUBLE) AS w FROM post JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM weighted)"""


EVERY = "SELECT doc_id, text FROM docs"
VALUE = f"SELECT doc_id, term, {r('value')} AS value FROM tfidf"


# --- other corpora --------------------------------------------------------------------

ORDERS = (
    "lines AS (SELECT l_orderkey AS doc_id, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty, "
    "sum(l_extendedprice) AS sum_price, sum(l_discount) AS sum_discount, sum(l_tax) AS sum_tax "
    "FROM lineitem GROUP BY l_orderkey),\n"
    "ords AS (SELECT lines.*, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label "
    "FROM lines JOIN orders ON doc_id = o_orderkey)"
)
JUDGED = (
    "judged AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' "
    "ELSE 'R' END AS prediction FROM lineitem)"
)
CLASS_SCORES = """classes AS (SELECT DISTINCT label AS class FROM judged UNION SELECT DISTINCT prediction FROM judged),
cells AS (SELECT class,
  (SELECT count(*) FROM judged WHERE label = class AND prediction = class) AS tp,
  (SELECT count(*) FROM judged WHERE label = class) AS support,
  (SELECT count(*) FROM judged WHERE prediction = class) AS claimed FROM classes),
scores AS (SELECT class, tp, support,
  CASE WHEN claimed = 0 THEN 0.0 ELSE tp / CAST(claimed AS DOUBLE) END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
  CASE WHEN claimed + support = 0 THEN 0.0 ELSE 2.0 * tp / CAST(claimed + support AS DOUBLE) END AS f1 FROM cells)"""

STORED = "(SELECT * FROM embeddings WHERE vec_id % 5 <> 0)"
ASKED = "(SELECT * FROM embeddings WHERE vec_id % 5 = 0)"
COSINE = (
    "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)"
)
NEAREST = (
    f"pairs AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, q.label AS label, b.label AS prediction, "
    f"{COSINE} AS score FROM {ASKED} q CROSS JOIN {STORED} b),\n"
    "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS INTEGER) "
    "AS rank FROM pairs)"
)

PHI = (
    "phi0 AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS feature, {f} AS value, {w}::DOUBLE * ({f} - avg({f}) OVER ()) AS p FROM ords"
        for f, w in ORDER_WEIGHTS.items()
    )
    + "),\nphi AS (SELECT doc_id, feature, value, 1 AS class, p AS phi FROM phi0 "
    "UNION ALL SELECT doc_id, feature, value, 0 AS class, -p AS phi FROM phi0)"
)


def chi2(source: str, names: list[str]) -> str:
    """CTEs ending in `chi(feature, idx, score)`."""
    cells = " UNION ALL ".join(
        f"SELECT label, {i} AS idx, '{f}' AS feature, CAST(count(*) AS DOUBLE) AS n, sum({f}) AS o FROM {source} GROUP BY label"
        for i, f in enumerate(names)
    )
    return f"""cell AS ({cells}),
expect AS (SELECT *, sum(o) OVER (PARTITION BY idx) * n / sum(n) OVER (PARTITION BY idx) AS e FROM cell),
chi AS (SELECT feature, CAST(idx AS INTEGER) AS idx,
  sum(CASE WHEN e <> 0 THEN (o - e) * (o - e) / e END) AS score FROM expect GROUP BY feature, idx)"""


def best(k: int) -> str:
    return (
        f"SELECT feature, idx, {r('score')} AS score FROM (SELECT * FROM chi ORDER BY score DESC NULLS LAST, idx DESC "
        f"LIMIT {k})"
    )


def encoding(vocab_source: str, size: int, max_len: int) -> str:
    """CTEs ending in `encoded(doc_id, ids)` over `tok`."""
    return f"""vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id FROM
  (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM {vocab_source}) GROUP BY token
   ORDER BY n DESC, token LIMIT {size})),
cut AS (SELECT doc_id, tokens[1:{max_len - 2}] AS part FROM tok),
spots AS (SELECT doc_id, unnest(part) AS token, unnest(range(1, len(part) + 1)) AS pos FROM cut),
found AS (SELECT doc_id, list(coalesce(token_id, 1) ORDER BY pos) AS ids FROM spots LEFT JOIN vocab USING (token)
  GROUP BY doc_id),
full_ids AS (SELECT c.doc_id, list_concat(list_concat([2], coalesce(f.ids, [])), [3]) AS ids
  FROM cut c LEFT JOIN found f ON c.doc_id = f.doc_id),
encoded AS (SELECT doc_id, len(ids) AS used,
  array_to_string(list_concat(ids, list_transform(range({max_len} - len(ids)), lambda x: 0)), ' ') AS ids FROM full_ids)"""


def class_stats(source: str, names: list[str], digits: int) -> str:
    cols = ", ".join(
        f"{r(f'avg({f})', digits)} AS {f}_mean, {r(f'min({f})', digits)} AS {f}_min, {r(f'max({f})', digits)} AS {f}_max"
        for f in names
    )
    return f"SELECT label, count(*) AS n, {cols} FROM {source} GROUP BY label"


def folds(k: int = 5) -> str:
    """CTEs ending in `folded(doc_id, label, fold)` by dealing positions of the label-sorted list."""
    return f"""sizes AS (SELECT label, count(*) AS n FROM corpus GROUP BY label),
spans AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sizes),
dealt AS (SELECT label, p % {k} AS fold, count(*) AS c FROM
  (SELECT label, unnest(range(CAST(s AS BIGINT), CAST(s + n AS BIGINT))) AS p FROM spans) GROUP BY 1, 2),
ends AS (SELECT label, fold, sum(c) OVER (PARTITION BY label ORDER BY fold) AS hi,
  sum(c) OVER (PARTITION BY label ORDER BY fold) - c AS lo FROM dealt),
rows0 AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS rn FROM corpus),
folded AS (SELECT r.doc_id, r.label, CAST(e.fold AS INTEGER) AS fold FROM rows0 r JOIN ends e
  ON r.label = e.label AND r.rn >= e.lo AND r.rn < e.hi)"""


SMOTE = f"""pts AS (SELECT doc_id, label, CAST(n_chars AS DOUBLE) AS x,
  CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS y FROM corpus),
cls AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top FROM pts GROUP BY label),
base AS (SELECT p.*, c.n, c.top, row_number() OVER (PARTITION BY p.label ORDER BY {key('p.doc_id', '42:base')}, p.doc_id) - 1 AS rn
  FROM pts p JOIN cls c ON p.label = c.label WHERE c.n < c.top),
near AS (SELECT a.doc_id, b.x AS nx, b.y AS ny, row_number() OVER (PARTITION BY a.doc_id
  ORDER BY round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9), b.doc_id) AS nb
  FROM base a JOIN base b ON a.label = b.label AND a.doc_id <> b.doc_id),
draw0 AS (SELECT *, unnest(range(top - n)) AS j FROM base),
draws AS (SELECT *, label || ':' || j AS name FROM draw0 WHERE j % n = rn),
drawn AS (SELECT *, {integer('name', '42:neighbour')} % least(5, n - 1) + 1 AS nb, {unit('name', '42:position')} AS u FROM draws),
made AS (SELECT 'smote-' || d.label || '-' || d.j AS doc_id, d.label, d.x + d.u * (m.nx - d.x) AS x,
  d.y + d.u * (m.ny - d.y) AS y, true AS synthetic FROM drawn d JOIN near m ON d.doc_id = m.doc_id AND d.nb = m.nb),
grown AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, x, y, false AS synthetic FROM pts UNION ALL SELECT * FROM made)"""


def kernel(expr: str) -> str:
    return f"""asked AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM {ASKED}),
marks AS (SELECT vec_id AS landmark, CAST(embedding AS DOUBLE[]) AS b FROM {STORED}
  ORDER BY {key('vec_id')}, vec_id LIMIT 20)
SELECT vec_id, landmark, {r(expr)} AS value FROM asked CROSS JOIN marks"""


DOT = "list_dot_product(a, b)"

UPSERT = """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label,
  CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version, """ + r("embedding[1]") + " AS e0 FROM embeddings"

PRESET_ROWS = ", ".join(
    f"('{d}', '{k}', {c}::DOUBLE, {'NULL' if g is None else g}::DOUBLE)"
    for d, ps in [*PRESETS.items(), ("default", DEFAULT_PRESET)]
    for k, c, g in ps
)
NAMES = "[" + ", ".join(f"'{n}'" for n in TRUTH_LABELS) + "]"
SQUEEZE = r"md5(regexp_replace({}, '[\r\n]+', ' ', 'g'))"


#: The lines of a class report over `test(label)`, as the catalogue keeps them.
SUPPORT = """
SELECT CAST(label AS VARCHAR) AS line, count(*) AS support, TRUE AS sound FROM test GROUP BY label
UNION ALL SELECT line, (SELECT count(*) FROM test), TRUE FROM (SELECT unnest(['accuracy', 'macro avg', 'weighted avg']) AS line)"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}

    # text
    q["clean_tokens"] = join(ALL, tokenised()) + "\nSELECT doc_id, clean, CAST(len(tokens) AS INTEGER) AS n_tokens FROM tok"
    q["content_text"] = join(ALL, tokenised()) + f"\nSELECT doc_id, {CONTENT} AS content FROM tok"
    q["stopword_counts"] = (
        join(ALL, tokenised())
        + f"\nSELECT doc_id, CAST(len(list_filter(tokens, lambda t: t IN {STOP})) AS INTEGER) AS stopword_count FROM tok"
    )
    names = ("words", "sentences", "syllables", "polysyllables", "monosyllables")
    q["word_sentence_syllable_counts"] = join(ALL, counted()) + "\nSELECT doc_id, " + ", ".join(
        f"CAST({n} AS INTEGER) AS {n}" for n in names
    ) + " FROM counted"
    for name, expr in SCORES.items():
        q[name] = join(ALL, counted()) + f"\nSELECT doc_id, {r(expr)} AS {name} FROM counted"
    pos = [n for n in tags.TAG_GROUPS if not n.endswith("tense_count")]
    tense = [n for n in tags.TAG_GROUPS if n.endswith("tense_count")]
    for name, cols in (("part_of_speech_counts", pos), ("tense_counts", tense)):
        q[name] = join(ALL, tokenised(), tagged()) + "\nSELECT doc_id, " + ", ".join(
            f"CAST({c} AS INTEGER) AS {c}" for c in cols
        ) + " FROM tagged"
    sums = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN tag IN {words_in(g)} THEN 1 ELSE 0 END), 0) AS INTEGER) AS {n}"
        for n, g in tags.TAG_GROUPS.items()
    )
    q["lexicon_table_counts"] = (
        join(
            ALL,
            tokenised(),
            f"lex0 AS (SELECT unnest({tokens_sql(CLEAN)}) AS word FROM benchmark)",
            "lex AS (SELECT DISTINCT word FROM lex0)",
            "long AS (SELECT doc_id, unnest(tokens) AS word FROM tok)",
            f"hits AS (SELECT doc_id, CASE WHEN lex.word IS NOT NULL THEN 'JJ' ELSE {tag_sql('long.word')} END AS tag "
            "FROM long LEFT JOIN lex ON long.word = lex.word)",
        )
        + f"\nSELECT c.doc_id, {sums} FROM corpus c LEFT JOIN hits h ON c.doc_id = h.doc_id GROUP BY c.doc_id"
    )
    q["linguistic_features_raw"] = features(SIX) + f"\nSELECT doc_id, text, {ROUNDED}, label FROM features"
    q["linguistic_features_scaled"] = features(SIX) + f",\n{SCALED}\nSELECT doc_id, text, {ROUNDED}, label FROM scaled"
    q["fixed_length_encoding"] = (
        join(ALL, tokenised(), encoding("tok", 30522, 512))
        + "\nSELECT doc_id, ids AS input_ids, CAST(used AS INTEGER) AS n_used FROM encoded"
    )
    q["token_vocabulary_table"] = (
        join(ALL, tokenised(), encoding("tok", 30522, 512)) + "\nSELECT token, n, token_id FROM vocab"
    )

    # projections and samples
    q["features_label"] = (
        join(ORDERS) + f"\nSELECT doc_id, {r('sum_price', 4)} AS sum_price, n_lines, label FROM ords"
    )
    q["linguistic_set"] = features(SIX) + f"\nSELECT doc_id, {ROUNDED}, label FROM features"
    q["drop_missing_rows"] = (
        join(SIX, CONTENT_CORPUS)
        + "\nSELECT doc_id, label, CAST(length(text) AS INTEGER) AS n FROM docs WHERE doc_id % 7 <> 0 AND trim(text) <> ''"
    )
    q["label_map"] = f"SELECT doc_id, {NAMES}[{SIX_LABEL} + 1] AS name, {SIX_LABEL} AS code FROM documents"
    q["one_hot"] = "SELECT doc_id, " + ", ".join(
        f"{SIX_LABEL} = {c} AS \"{n}\"" for n, c in TRUTH_LABELS.items()
    ) + " FROM documents"
    q["by_class"] = f"SELECT doc_id, n_chars FROM documents WHERE {SIX_LABEL} = 4"
    q["by_class_stats"] = class_stats(
        "(SELECT *, l_returnflag AS label FROM lineitem)", MEASURES, 6
    )
    q["feature_points"] = features(SIX) + "\nSELECT doc_id, label, adjective_count, lexicon_count, conjunction_count FROM features"
    q["holdout_union"] = (
        join(SIX, three_way("corpus", 0.2, "doc_id, label"))
        + "\nSELECT doc_id, label, split FROM three WHERE split <> 'train'"
    )
    q["attach_features"] = (
        "SELECT d.doc_id, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
    )
    q["sample_n"] = join(SIX) + f"\nSELECT doc_id, label FROM corpus ORDER BY {key()}, doc_id LIMIT 100"
    q["head_n"] = join(SIX) + "\nSELECT doc_id, label FROM corpus ORDER BY doc_id LIMIT 50"
    q["rename_reorder_columns"] = features(BINARY) + f"\nSELECT text, {ROUNDED}, label FROM features"
    q["shape_report"] = (
        join(SIX, three_way("corpus", 0.2, "doc_id, label"))
        + "\nSELECT split AS name, count(*) AS n_rows, 2 AS n_columns FROM three WHERE split <> 'validation' GROUP BY split"
    )

    # splits and folds
    q["stratified_train_test"] = join(SIX, stratified("corpus")) + "\nSELECT doc_id, label, split FROM strat"
    q["random_split_80_10_10"] = join(three_way("documents", 0.2, "doc_id")) + "\nSELECT * FROM three"
    q["random_split_70_15_15"] = join(three_way("documents", 0.3, "doc_id")) + "\nSELECT * FROM three"
    u = unit("doc_id", "42")
    q["random_split_approximate"] = (
        f"SELECT doc_id, CASE WHEN {u} >= 0.2 THEN 'train' WHEN {u} < 0.1 THEN 'test' ELSE 'validation' END AS split "
        "FROM documents"
    )
    q["stratified_folds"] = join(BINARY, folds()) + "\nSELECT * FROM folded"
    q["split_label_counts"] = (
        join(BINARY, stratified("corpus")) + "\nSELECT split, label, count(*) AS n FROM strat GROUP BY split, label"
    )
    q["split_dictionary"] = (
        join(SIX, three_way("corpus", 0.3, "doc_id, label")) + "\nSELECT doc_id, label, split FROM three"
    )

    # resampling
    q["under_sampled"] = join(BINARY) + f"""
SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {key()}, doc_id) AS rn
  FROM corpus) WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM corpus GROUP BY label))"""
    q["class_weighted"] = join(SIX) + f"""
SELECT doc_id, label, {r('(SELECT count(*) FROM corpus) / CAST((SELECT count(DISTINCT label) FROM corpus) * count(*) OVER (PARTITION BY label) AS DOUBLE)')} AS weight FROM corpus"""
    q["label_distribution"] = "SELECT quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality"
    q["smote_vectors"] = """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
grown AS (SELECT label, FALSE AS synthetic, n FROM n UNION ALL SELECT label, TRUE, (SELECT max(n) FROM n) - n FROM n)
SELECT label, synthetic, n, TRUE AS inside FROM grown WHERE n > 0"""
    q["smote_2d"] = join(BINARY, SMOTE) + f"\nSELECT doc_id, label, {r('x')} AS x, {r('y')} AS y, synthetic FROM grown"

    # transforms
    q["min_max_numeric"] = join(ORDERS) + "\nSELECT doc_id, " + ", ".join(
        f"{r(f'({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ())')} AS {f}" for f in ORDER_FEATURES
    ) + ", label FROM ords"
    q["max_abs_numeric"] = (
        join(ORDERS, "top AS (SELECT " + ", ".join(f"max(abs({f})) AS m_{f}" for f in ORDER_FEATURES) + " FROM ords WHERE doc_id % 5 <> 0)")
        + "\nSELECT doc_id, "
        + ", ".join(f"{r(f'{f} / (SELECT m_{f} FROM top)')} AS {f}" for f in ORDER_FEATURES)
        + " FROM ords WHERE doc_id % 5 = 0"
    )
    q["tfidf"] = join(BINARY, CONTENT_CORPUS, tfidf(EVERY, EVERY)) + "\n" + VALUE
    q["tfidf_bigram"] = join(BINARY, CONTENT_CORPUS, tfidf(EVERY, EVERY, 1, 2, 0.01)) + "\n" + VALUE
    pruned = join(BINARY, CONTENT_CORPUS, tfidf(EVERY, EVERY, min_df=0.01))
    q["tfidf_min_df"] = pruned + "\n" + VALUE
    q["tfidf_max_abs"] = pruned + f"\nSELECT doc_id, term, {r('value / max(value) OVER (PARTITION BY term)')} AS value FROM tfidf"
    q["tfidf_train_test"] = (
        join(BINARY, CONTENT_CORPUS, tfidf(f"{EVERY} WHERE doc_id % 5 <> 0", f"{EVERY} WHERE doc_id % 5 = 0", min_df=0.01))
        + "\n"
        + VALUE
    )
    q["vocabulary"] = pruned + "\nSELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab"
    fold5 = f"{EVERY} WHERE doc_id % 5 <> 0 AND trim(text) <> ''"
    q["feature_set"] = join(BINARY, CONTENT_CORPUS, tfidf(fold5, fold5, min_df=0.01)) + """,
sides AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN 'train' ELSE 'test' END AS side, count(*) AS n_rows FROM docs
  WHERE trim(text) <> '' GROUP BY 1)
SELECT 'tfidf' AS name, side, n_rows, (SELECT count(*) FROM vocab) AS n_features FROM sides
UNION ALL SELECT 'linguistic', side, n_rows, 21 FROM sides"""
    q["chi2_numeric"] = (
        join("src AS (SELECT *, l_returnflag AS label FROM lineitem)", chi2("src", MEASURES))
        + f"\nSELECT feature, idx, {r('score', 4)} AS score FROM chi"
    )
    q["chi2_terms_table"] = pruned + f""",
names AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab),
class_n AS (SELECT label, count(*) AS n FROM docs GROUP BY label),
obs AS (SELECT v.term, d.label, sum(value) AS o FROM tfidf v JOIN docs d ON v.doc_id = d.doc_id GROUP BY v.term, d.label),
grid AS (SELECT n.term, n.idx, c.label, c.n, coalesce(o.o, 0) AS o FROM names n CROSS JOIN class_n c
  LEFT JOIN obs o ON o.term = n.term AND o.label = c.label),
expect AS (SELECT *, sum(o) OVER (PARTITION BY term) * n / sum(n) OVER (PARTITION BY term) AS e FROM grid)
SELECT term AS feature, idx, {r('sum((o - e) * (o - e) / e)')} AS score FROM expect GROUP BY term, idx"""
    q["select_k_best_features"] = features(BINARY) + f",\n{SCALED},\n{chi2('scaled', FEATURES)}\n" + best(10)

    # kernels
    q["kernel_table_rbf"] = "WITH " + kernel(
        "exp(-0.1::DOUBLE * (list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b)))"
    )
    q["kernel_table_sigmoid"] = "WITH " + kernel(f"tanh(0.1::DOUBLE * {DOT})")
    q["kernel_table_poly"] = "WITH " + kernel(f"pow(0.1::DOUBLE * {DOT}, 3)")
    q["kernel_gamma_scale"] = (
        "WITH v AS (SELECT len(embedding) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)\n"
        f"SELECT {r('1 / (max(d) * var_pop(x))')} AS gamma FROM v"
    )

    # models
    q["grid_rank_table"] = f"""WITH scores AS (SELECT CAST(o_custkey % 18 AS INTEGER) AS grid_idx, o_orderkey % 5 AS fold,
  floor(round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END), 2) * 100) AS a FROM orders GROUP BY 1, 2),
mean AS (SELECT grid_idx, avg(a) AS m FROM scores GROUP BY grid_idx)
SELECT grid_idx, {r('m')} AS mean_score, CAST(row_number() OVER (ORDER BY m DESC, grid_idx) AS INTEGER) AS place FROM mean"""
    q["preset_parameters"] = f"""WITH preset(dataset, kernel, C, gamma) AS (VALUES {PRESET_ROWS}),
parts AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 'liar_dataset' WHEN 'fr' THEN 'isot_titles_dataset'
  WHEN 'de' THEN 'isot_texts_dataset' ELSE 'default' END AS dataset FROM documents GROUP BY lang)
SELECT * FROM parts JOIN preset USING (dataset)"""
    votes = """WITH v AS (SELECT o_orderkey AS doc_id, unnest([o_orderkey % 3, o_custkey % 3, (o_orderkey + o_custkey) % 3]) AS p
  FROM orders), c AS (SELECT doc_id, p, count(*) AS n FROM v GROUP BY doc_id, p)"""
    q["vote_hard"] = votes + """
SELECT doc_id, CAST(p AS INTEGER) AS prediction FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rn FROM c) WHERE rn = 1"""
    q["vote_soft"] = f"""WITH p AS (SELECT o_orderkey AS doc_id, (((o_orderkey * 7 + o_custkey) % 11) + ((o_orderkey * 7 + o_custkey * 3) % 11)
  + ((o_orderkey * 7 + o_custkey * 5) % 11)) AS tenths FROM orders)
SELECT doc_id, CASE WHEN tenths > 15 THEN 1 ELSE 0 END AS prediction,
  {r('CASE WHEN tenths > 15 THEN tenths / 30.0::DOUBLE ELSE 1 - tenths / 30.0::DOUBLE END')} AS probability FROM p"""
    q["adaboost_step"] = f"""WITH p AS (SELECT o_orderkey AS doc_id, o_custkey % 5 AS y,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE o_custkey % 5 END AS p FROM orders),
e AS (SELECT avg(CASE WHEN y <> p THEN 1.0::DOUBLE ELSE 0.0 END) AS err FROM p),
a AS (SELECT ln((1 - err) / err) + {math.log(4)!r}::DOUBLE AS alpha FROM e),
w AS (SELECT doc_id, alpha, CASE WHEN y <> p THEN exp(alpha) ELSE 1.0 END AS w FROM p CROSS JOIN a)
SELECT doc_id, {r('alpha')} AS alpha, {r('1e6::DOUBLE * w / sum(w) OVER ()', 4)} AS new_weight_e6 FROM w"""

    # evaluation
    q["accuracy"] = join(JUDGED) + """
SELECT round(100.0::DOUBLE * sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*), 2) AS accuracy, count(*) AS n FROM judged"""
    labels = "all_labels AS (SELECT label AS l FROM judged UNION SELECT prediction FROM judged)"
    grid = """grid AS (SELECT a.l AS truth, b.l AS predicted, (SELECT count(*) FROM judged WHERE label = a.l AND prediction = b.l) AS n
  FROM all_labels a CROSS JOIN all_labels b)"""
    q["confusion_matrix"] = join(JUDGED, labels, grid) + "\nSELECT truth, predicted, n FROM grid"
    q["confusion_pivot"] = join(JUDGED, labels, grid) + "\nSELECT truth, " + ", ".join(
        f"CAST(sum(CASE WHEN predicted = '{c}' THEN n ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in "ANR"
    ) + " FROM grid GROUP BY truth"
    q["class_report"] = join(JUDGED, CLASS_SCORES) + f"""
SELECT class AS line, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support FROM scores
UNION ALL SELECT 'accuracy', {r('sum(tp) / sum(support)')}, {r('sum(tp) / sum(support)')}, {r('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'macro avg', {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', {r('sum(precision * support) / sum(support)')}, {r('sum(recall * support) / sum(support)')},
  {r('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM scores"""
    q["f1_macro"] = join(JUDGED, CLASS_SCORES) + f"\nSELECT {r('avg(f1)')} AS f1_macro FROM scores"
    q["multilabel_metrics"] = f"""WITH s AS (SELECT l.doc_id, quality, toxic, 1 / (1 + exp(-((n_chars % 1000) / 250.0::DOUBLE - 2))) >= 0.5 AS pq,
  1 / (1 + exp(-((n_chars % 777) / 200.0::DOUBLE - 2))) >= 0.5 AS pt FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
long AS (SELECT quality = 1 AS y, pq AS p FROM s UNION ALL SELECT toxic = 1, pt FROM s),
c AS (SELECT CAST(count_if(y AND p) AS DOUBLE) AS tp, CAST(count_if(NOT y AND p) AS DOUBLE) AS fp,
  CAST(count_if(y AND NOT p) AS DOUBLE) AS fn, CAST(count_if(NOT y AND NOT p) AS DOUBLE) AS tn FROM long)
SELECT {r('2 * tp / (2 * tp + fp + fn)')} AS f1, {r('(tp / (tp + fn) + tn / (tn + fp)) / 2')} AS roc_auc,
  {r('(SELECT avg(CASE WHEN (quality = 1) = pq AND (toxic = 1) = pt THEN 1.0::DOUBLE ELSE 0.0 END) FROM s)')} AS accuracy FROM c"""

    q["argmax_prediction"] = (
        "SELECT l.doc_id, CASE WHEN (n_chars % 777) / 200.0::DOUBLE > (n_chars % 1000) / 250.0::DOUBLE THEN 'toxic' "
        "ELSE 'quality' END AS prediction FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
    )

    # vectors
    q["upsert_latest"] = q["upsert_collection"] = UPSERT
    for name, k in (("cosine_top1", 1), ("cosine_top5", 5), ("cosine_top5_cells", 5)):
        q[name] = join(NEAREST) + f"\nSELECT query_id, rank, base_id, {r('score')} AS score FROM ranked WHERE rank <= {k}"
    q["knn_labels"] = join(NEAREST) + "\nSELECT query_id AS vec_id, label, prediction FROM ranked WHERE rank = 1"
    judged = "judged AS (SELECT label, prediction FROM ranked WHERE rank = 1)"
    q["knn_confusion"] = join(NEAREST, judged, labels, grid) + "\nSELECT truth, predicted, n FROM grid"
    q["knn_experiment"] = join(NEAREST, judged) + """
SELECT round(100.0::DOUBLE * sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*), 2) AS accuracy, count(*) AS n FROM judged"""

    # attributions
    q["linear_shap"] = join(ORDERS, PHI) + f"\nSELECT doc_id, feature, {r('phi', 4)} AS phi FROM phi WHERE class = 1"
    q["shap_summary"] = join(ORDERS, PHI) + f""",
m AS (SELECT class, feature, avg(abs(phi)) AS i FROM phi GROUP BY class, feature)
SELECT class, feature, {r('i', 4)} AS importance,
  CAST(row_number() OVER (PARTITION BY class ORDER BY round(i, 9) DESC, feature) AS INTEGER) AS place FROM m"""
    q["shap_points"] = (
        join(ORDERS, PHI) + f"\nSELECT doc_id, class, feature, {r('value', 4)} AS value, {r('phi', 4)} AS phi FROM phi"
    )
    q["decision_path"] = join(ORDERS, PHI) + f""",
m AS (SELECT feature, row_number() OVER (ORDER BY round(avg(abs(phi)), 9) DESC, feature) AS place FROM phi GROUP BY feature)
SELECT doc_id, class, phi.feature, {r('0.5 + sum(phi) OVER (PARTITION BY doc_id, class ORDER BY place DESC ROWS UNBOUNDED PRECEDING)', 4)} AS running
FROM phi JOIN m ON phi.feature = m.feature"""

    # sources
    q["file_label"] = f"""SELECT p.part, quality AS label, {SQUEEZE.format('p.value')} AS digest
FROM documents d JOIN labels l ON d.doc_id = l.doc_id,
LATERAL (SELECT unnest(['title', 'text']) AS part, unnest([d.source, d.text]) AS value) p"""
    q["statements_roundtrip"] = join(SIX, three_way("corpus", 0.2, "doc_id, label, text")) + f"""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE split WHEN 'validation' THEN 'valid' ELSE split END AS split, label,
  {SQUEEZE.format('text')} AS digest FROM three"""
    splits = "features_s AS (SELECT f.*, s.split FROM features f JOIN strat s ON f.doc_id = s.doc_id)"
    on_train = ", ".join(
        f"{r(f'({f} - t.lo_{f}) / (t.hi_{f} - t.lo_{f})')} AS {f}" for f in FEATURES
    )
    train = "t AS (SELECT " + ", ".join(
        f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATURES
    ) + " FROM features_s WHERE split = 'train')"
    q["features_roundtrip"] = (
        features(SIX) + f",\n{stratified('corpus')},\n{splits},\n{train}\nSELECT doc_id, split, label, {on_train} FROM features_s CROSS JOIN t WHERE trim(text) <> ''"
    )
    per_split = ", ".join(
        f"{r(f'CASE WHEN max({f}) OVER w = min({f}) OVER w THEN 0.0 ELSE ({f} - min({f}) OVER w) / (max({f}) OVER w - min({f}) OVER w) END')} AS {f}"
        for f in FEATURES
    )
    q["features_scaled_per_split"] = (
        features(SIX) + f",\n{stratified('corpus')},\n{splits},\nall_s AS (SELECT doc_id, text, split, label, {per_split} FROM features_s WINDOW w AS (PARTITION BY split))"
        + "\nSELECT doc_id, split, label, " + ", ".join(FEATURES) + " FROM all_s WHERE trim(text) <> ''"
    )
    articles = (
        "corpus AS (SELECT d.doc_id * 2 + k AS doc_id, CASE WHEN k = 0 THEN d.source ELSE d.text END AS text, "
        "l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (VALUES (0), (1)) s(k))"
    )
    q["feature_job"] = (
        features(articles)
        + f",\nall_p AS (SELECT doc_id, text, label, {per_split} FROM features WINDOW w AS (PARTITION BY doc_id % 2))"
        + "\nSELECT CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE 'text' END AS part, label, md5(text) AS digest, "
        + ", ".join(FEATURES)
        + " FROM all_p WHERE trim(text) <> ''"
    )
    q["features_csv_roundtrip"] = (
        features(BINARY) + f"\nSELECT md5(text) AS digest, label, {ROUNDED} FROM features WHERE trim(text) <> ''"
    )
    q["dataset_registry"] = (
        "SELECT 'binary' AS name, count(*) AS n FROM documents JOIN labels USING (doc_id) "
        "UNION ALL SELECT 'unknown', count(*) FROM documents"
    )
    q["model_reload"] = join(ORDERS) + "\nSELECT doc_id, " + ", ".join(
        f"{r(f'{f} / max(abs({f})) OVER ()')} AS {f}" for f in ORDER_FEATURES
    ) + " FROM ords"

    # studies
    q["selection_job"] = features(SIX) + f",\n{SCALED},\n{chi2('scaled', FEATURES)}\n" + best(3)
    q["selection_classes"] = features(SIX) + f",\n{SCALED}\n" + class_stats("scaled", FEATURES, 9)
    q["multilabel_job"] = (
        join(
            BINARY,
            tokenised(),
            three_way("corpus", 0.2, "doc_id, label"),
            "train_tok AS (SELECT tokens FROM tok WHERE doc_id IN (SELECT doc_id FROM three WHERE split = 'train'))",
            encoding("train_tok", 30522, 512),
        )
        + "\nSELECT e.doc_id, split, ids AS input_ids, CASE WHEN label = 0 THEN '1 0' ELSE '0 1' END AS labels "
        "FROM encoded e JOIN three t ON e.doc_id = t.doc_id"
    )
    # trained models: what holds for any right fit
    q["svd_projection"] = join(BINARY) + """
SELECT count(*) AS n, 100 AS width, TRUE AS energy_is_singular_value, TRUE AS falling, TRUE AS orthonormal,
  TRUE AS largest_entry_positive FROM corpus"""
    binary_test = join(BINARY, stratified("corpus"), "test AS (SELECT label FROM strat WHERE split = 'test')")
    for name in (
        "linear_svm", "kernel_svm_rbf", "kernel_svm_sigmoid", "kernel_svm_poly", "adaboost",
        "stacking_final_linear", "stacking_final_rbf", "stacking_final_sigmoid", "stacking_final_logistic",
        "voting_experiment_hard", "voting_experiment_soft",
    ):
        q[name] = binary_test + SUPPORT
    for name in ("linear_svm_multiclass", "linear_svm_pairs"):
        q[name] = join(f"test AS (SELECT label FROM {ASKED})") + SUPPORT
    q["logistic_on_embeddings"] = f"SELECT vec_id AS doc_id, label, TRUE AS known_class FROM {ASKED}"
    q["calibrated_probabilities"] = join(ORDERS) + """
SELECT count(*) AS n, TRUE AS sums_to_one, TRUE AS logistic_in_margin FROM ords"""
    q["bagging"] = join(ORDERS) + "\nSELECT doc_id, TRUE AS known_class FROM ords"
    q["ann_top1"] = f"SELECT vec_id AS query_id, 1 AS rank, TRUE AS \"right\" FROM {ASKED}"
    q["ann_recall"] = f"SELECT count(*) AS n, TRUE AS recall_holds FROM {ASKED}"
    q["ann_index_recall"] = f"SELECT count(*) AS n, TRUE AS recall_holds, TRUE AS few_scored FROM {ASKED}"
    q["kernel_shap"] = f"""WITH chosen AS (SELECT vec_id AS doc_id FROM embeddings ORDER BY {key("vec_id")}, vec_id LIMIT 20)
SELECT doc_id, CAST(class AS INTEGER) AS class, CAST(64 AS BIGINT) AS features, TRUE AS adds_up
FROM chosen CROSS JOIN (SELECT unnest([0, 1]) AS class)"""
    q["file_tree"] = "SELECT doc_id || ',' || quality AS value, TRUE AS is_csv FROM labels"
    steps = "[0.01, 0.1, 1, 10, 100, 1000]"
    q["grid_search_scores"] = f"""WITH points AS (SELECT row_number() OVER (ORDER BY C, gamma, kernel) - 1 AS idx, C, gamma, kernel
  FROM (SELECT unnest({steps}) AS C), (SELECT unnest({steps}) AS gamma), (SELECT unnest(['linear', 'rbf', 'sigmoid']) AS kernel))
SELECT CAST(idx AS INTEGER) AS grid_idx, CAST(C AS DOUBLE) AS C, CAST(gamma AS DOUBLE) AS gamma, kernel,
  CAST(fold AS INTEGER) AS fold, TRUE AS in_range
FROM points CROSS JOIN (SELECT unnest(range(5)) AS fold)"""
    q["grid_experiment"] = binary_test + f"""
SELECT r.*, metric FROM ({SUPPORT}) r CROSS JOIN (SELECT unnest(['accuracy', 'f1_macro']) AS metric)"""
    q["ensemble_experiment"] = """SELECT CAST(class AS INTEGER) AS class, TRUE AS each_once, TRUE AS ranked, TRUE AS sound
FROM (SELECT unnest([0, 1]) AS class)"""
    q["multilabel_experiment"] = """WITH n AS (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT n, CAST(ceil(n / 5.0) AS BIGINT) AS held FROM n)
SELECT part, CASE part WHEN 'validation' THEN CAST(ceil(held / 2.0) AS BIGINT) ELSE held - CAST(ceil(held / 2.0) AS BIGINT) END AS n,
  TRUE AS sound FROM h CROSS JOIN (SELECT unnest(['test', 'validation']) AS part)"""
    train = "everything AS (SELECT d.doc_id, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
    outer = stratified("everything").replace("sizes", "class_sizes")
    q["stacking_out_of_fold"] = join(
        train, outer, "corpus AS (SELECT doc_id, label FROM strat WHERE split = 'train')", folds(5)
    ) + "\nSELECT doc_id, label, fold, TRUE AS in_range FROM folded"
    return q
