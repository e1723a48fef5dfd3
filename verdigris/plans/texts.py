"""Queries of the scalar text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris import vocab
from verdigris.functions import text as T
from verdigris.plans.base import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("SELECT doc_id, CAST(k AS INTEGER) AS start, length(substr(text, CAST(k + 1 AS BIGINT), 800)) AS n, substr(sha256(substr(text, CAST(k + 1 AS BIGINT), 800)), 1, 12) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 700)) AS k FROM documents)")
def c1_fixed_chunks(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.fixed_chunks(F.col("text"))).alias("c"))
    return made.select("doc_id", "c.start", F.length("c.chunk").cast("long").alias("n"), T.fingerprint(F.col("c.chunk"), 12).alias("digest"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents), c AS (SELECT doc_id, k AS start, trim(substr(flat, CAST(k + 1 AS BIGINT), 2048)) AS chunk FROM (SELECT doc_id, flat, unnest(range(0, length(flat), 1792)) AS k FROM f WHERE length(flat) >= 80))
SELECT doc_id, CAST(start AS INTEGER) AS start, length(chunk) AS n FROM c WHERE length(chunk) >= 80""")
def c2_section_chunks(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.section_chunks(F.col("text"))).alias("c"))
    return made.select("doc_id", "c.start", F.length("c.chunk").cast("long").alias("n"))


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(c)) AS BIGINT) AS chars FROM (
SELECT doc_id, text AS c FROM documents WHERE length(text) BETWEEN 80 AND 1536
UNION ALL SELECT doc_id, c FROM (SELECT doc_id, trim(substr(text, CAST(k + 1 AS BIGINT), 1536), ' ') AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 1280)) AS k FROM documents WHERE length(text) > 1536)) WHERE c <> '') GROUP BY 1""")
def c3_article_chunks(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.article_chunks(F.col("text"))).alias("c"))
    return made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("c")).alias("chars"))


@query("SELECT page_id, length(s) AS n, substr(sha256(s), 1, 12) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM pages)")
def c4_strip_tags(spark, sf_dir):
    s = T.stripped(T.without_scripts(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(s).cast("long").alias("n"), T.fingerprint(s, 12).alias("digest"))


@query("""SELECT page_id, substr(sha256(trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), ' ')), 1, 12) AS digest FROM pages""")
def c5_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.fingerprint(T.unescaped(F.col("html")), 12).alias("digest"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE (CASE WHEN position(' ' IN substr(text, 1, 400)) > 1 THEN substr(substr(text, 1, 400), 1, length(substr(text, 1, 400)) - position(' ' IN reverse(substr(text, 1, 400)))) ELSE substr(text, 1, 400) END) || '…' END AS snippet FROM documents""")
def c6_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS canonical FROM pages""")
def c7_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^[w.]+', '') AS source_name FROM pages")
def c8_source_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.source_name(F.col("url")).alias("source_name"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(trim(text, ' '), '^(.*?[.!?])\\s') THEN regexp_extract(trim(text, ' '), '^(.*?[.!?])\\s', 1) ELSE trim(text, ' ') END AS sentence FROM documents""")
def c9_first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


def _votes_sql() -> str:
    votes = {k: f"len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t IN ({', '.join(repr(w) for w in words)})))" for k, words in vocab.PROBE_LANGUAGES.items()}
    best = "greatest(" + ", ".join(votes.values()) + ")"
    return "CASE " + " ".join(f"WHEN len(regexp_extract_all(text, '[A-Za-z]')) >= 6 AND {best} > 0 AND {v} = {best} THEN '{k}'" for k, v in votes.items()) + " ELSE 'en' END"


@query(f"SELECT doc_id, lang, {_votes_sql()} AS detected FROM documents")
def c10_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.script_language(F.col("text")).alias("detected"))


_PREPARED = "regexp_replace(lower(text), '\\s+', ' ', 'g')"


@query(f"""WITH t AS (SELECT doc_id, lang, doc_id % 5 = 0 AS held_out, string_split({_PREPARED}, '') AS c FROM documents), g AS (SELECT doc_id, lang, held_out, CASE WHEN len(c) < 3 THEN [] ELSE list_transform(range(1, len(c) - 1), lambda k: c[k] || c[k + 1] || c[k + 2]) END AS g FROM t),
c AS MATERIALIZED (SELECT lang, gram, count(*) AS c FROM (SELECT lang, unnest(g) AS gram FROM g WHERE NOT held_out) GROUP BY ALL), k AS MATERIALIZED (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS r FROM c) WHERE r <= 1500),
h AS (SELECT c.* FROM c JOIN k USING (gram)), n AS (SELECT lang, sum(c) AS total FROM h GROUP BY 1), w AS MATERIALIZED (SELECT k.gram, n.lang, ln((coalesce(h.c, 0) + 1) / CAST(n.total + (SELECT count(*) FROM k) AS DOUBLE)) AS weight FROM k CROSS JOIN n LEFT JOIN h ON h.gram = k.gram AND h.lang = n.lang),
s AS (SELECT doc_id, w.lang, sum(weight) AS s FROM (SELECT doc_id, unnest(list_distinct(g)) AS gram FROM g) d JOIN w USING (gram) GROUP BY ALL), b AS (SELECT doc_id, lang AS detected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM s) WHERE r = 1)
SELECT g.doc_id, g.lang, held_out, detected FROM g LEFT JOIN b USING (doc_id)""")
def c10_ngram_language(spark, sf_dir):
    """Languages by trigram profiles, learnt from four fifths of the documents; the others are held out."""
    from verdigris.operators import langid

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    profile = langid.profiles(d.filter("doc_id % 5 != 0"))
    return d.select("doc_id", "lang", (F.col("doc_id") % 5 == 0).alias("held_out")).join(langid.detected(d, "doc_id", profile), "doc_id", "left")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'en' END AS hint, FALSE AS cjk, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS units FROM documents")
def c12_c13_c14_cjk(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.cjk_majority(t).alias("hint"), T.has_cjk(t).alias("cjk"), T.word_or_cjk_count(t).cast("long").alias("units"))


@query("""SELECT doc_id, substr(sha256(replace(replace(text, 'tion', 'TION'), 'the', 'THE')), 1, 12) AS digest, concat_ws(',', CASE WHEN contains(text, 'tion') THEN 'tion' END, CASE WHEN contains(replace(text, 'tion', 'TION'), 'the') THEN 'the' END) AS hits FROM documents""")
def c15_canonical_terms(spark, sf_dir):
    r = T.canonical_terms(F.col("text"), {"the": "THE", "tion": "TION"})
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", T.fingerprint(F.col("r.text"), 12).alias("digest"), F.array_join("r.hits", ",").alias("hits"))


_ITEM_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS term FROM benchmark)"


@query(f"""WITH {_ITEM_WORDS}, v AS (SELECT list(term ORDER BY length(term) DESC, term) AS terms FROM w)
SELECT doc_id, substr(sha256(list_reduce(list_prepend(text, terms), lambda a, t: replace(a, t, upper(t)))), 1, 12) AS digest FROM documents, v""")
def c15_large_vocabulary(spark, sf_dir):
    """All words of the benchmark in documents, replaced by their canonical (upper-case) form, the longest first."""
    from verdigris.operators import dictionary

    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    found = dictionary.substituted(table(spark, sf_dir, "documents"), words.select("term", F.upper("term").alias("to")))
    return found.select("doc_id", T.fingerprint(F.col("text"), 12).alias("digest"))


@query(f"""WITH {_ITEM_WORDS} SELECT doc_id, count(*) AS hits, substr(sha256(string_agg(lower(term), ' ' ORDER BY lower(term))), 1, 12) AS digest FROM documents JOIN w ON contains(lower(text), lower(term)) GROUP BY 1""")
def c44_seed_terms(spark, sf_dir):
    """The benchmark's words that occur anywhere in a document."""
    from verdigris.operators import dictionary

    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    hits = dictionary.contained(table(spark, sf_dir, "documents"), words)
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), T.fingerprint(F.array_join(F.array_sort(F.collect_list("term")), " "), 12).alias("digest"))


@query("""WITH h AS (SELECT doc_id % 40 AS query_id, lang AS domain, doc_id AS pos FROM documents), c AS (SELECT query_id, domain, count(*) AS n, min(pos) AS first FROM h GROUP BY ALL)
SELECT query_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def c16_dominant_domain(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("query_id"), F.col("lang").alias("domain")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return c.groupBy("query_id").agg(F.max_by("domain", F.struct("n", -F.col("first"))).alias("domain"))


@query("SELECT doc_id, 'lang = ' || lang || '; source = ' || source AS hint FROM documents")
def c17_glossary(spark, sf_dir):
    pairs = F.array(F.struct(F.lit("lang").alias("term"), F.col("lang").alias("to")), F.struct(F.lit("source").alias("term"), F.col("source").alias("to")))
    return table(spark, sf_dir, "documents").select("doc_id", T.glossary(pairs).alias("hint"))


_NUM = "nullif(regexp_extract(trim(text, ' '), '(^|[^A-Za-z0-9])([0-9][0-9,]*(\\.[0-9]+)?)', 2), '')"
_WORDS = "|".join(vocab.NUMBER_WORDS)


_CORE = f"""CASE WHEN trim(text, ' ') = '' OR starts_with(trim(text, ' '), '[ERROR]') THEN '__error__' ELSE coalesce(replace({_NUM}, ',', ''),
CAST(nullif(list_position(string_split('{_WORDS}', '|'), regexp_extract(lower(text), '(^|[^a-z])({_WORDS})($|[^a-z])', 2)), 0) AS VARCHAR),
nullif(regexp_extract(lower(text), '(^|[^a-z])(paris|euro|dollar)($|[^a-z])', 2), ''), lower(nullif(regexp_extract(trim(text, ' '), '(^|[^A-Za-z])([A-Z][a-z]+ [A-Z][a-z]+)', 2), '')),
lower(nullif(regexp_extract(trim(text, ' '), '(^|\\s)([A-Z][a-z]{{3,}})(\\s|$|[.,])', 2), '')), trim(lower(substr(trim(text, ' '), 1, 20)), ' ')) END"""


@query(f"SELECT conv_id, turn, {_CORE} AS core FROM conversations")
def c18_core_proposition(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.core_proposition(F.col("text")).alias("core"))


def _key_sql(col: str) -> str:
    stop = ", ".join(f"'{w}'" for w in vocab.STOP_WORDS)
    return f"list_sort(list_filter(list_distinct(regexp_extract_all(lower({col}), '[a-z0-9][a-z0-9-]*')), lambda t: length(t) >= 2 AND t NOT IN ({stop})))"


@query(f"SELECT conv_id, turn, array_to_string({_key_sql('text')}, ' ') AS keys FROM conversations")
def c19_key_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.key_tokens(F.col("text"))), " ").alias("keys"))


_PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS prompt FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant')"


def pairs(spark, sf_dir):
    """Assistant turns with the user turn right before them."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(u, ["conv_id", "turn"])


@query(f"""WITH {_PAIRS}, k AS (SELECT *, {_key_sql('answer')} AS a, {_key_sql('prompt')} AS r FROM p)
SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN TRUE WHEN len(list_filter(a, lambda t: NOT regexp_matches(t, '^[0-9]+$'))) > 0 THEN len(list_intersect(list_filter(a, lambda t: NOT regexp_matches(t, '^[0-9]+$')), r)) > 0 ELSE FALSE END AS supported FROM k""")
def c21_support(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", T.supported(F.col("answer"), F.col("prompt")).alias("supported"))


@query("""SELECT doc_id, CASE WHEN trim(string_split(text, chr(10) || chr(10))[1], ' ') <> '' THEN substr(trim(string_split(text, chr(10) || chr(10))[1], ' '), 1, 80) ELSE substr(text, 1, 80) END AS core FROM documents""")
def c22_core_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.core_answer(F.col("text")).alias("core"))


@query("""SELECT conv_id, turn, regexp_matches(lower(trim(text, ' ')), '^(hi|hello|ok|okay|thanks|error)[.!?]*$') AS noise, length(trim(text, ' ')) <= 20 AND NOT contains(text, '?') AND regexp_matches(lower(trim(text, ' ')), '^(the|and|of)([^a-z]|$)') AS greeting FROM conversations""")
def c23_c24_noise_and_greeting(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.noise_turn(t).alias("noise"), T.casual_greeting(t, ("the", "and", "of")).alias("greeting"))


_TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
_LONG = "list_distinct(list_filter(" + _TOK + ", lambda w: length(w) >= 3))"


@query(f"WITH {_PAIRS}, k AS (SELECT conv_id, turn, len({_TOK.format('answer')}) AS n, {_LONG.format('answer')} AS a, {_LONG.format('prompt')} AS b FROM p) SELECT conv_id, turn, CAST(n AS BIGINT) AS n_tokens, coalesce(CAST(len(list_intersect(a, b)) AS DOUBLE) / nullif(least(len(a), len(b)), 0), 0.0) AS overlap FROM k")
def c25_c26_overlap(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.size(T.tokens(F.col("answer"))).cast("long").alias("n_tokens"), T.overlap(F.col("answer"), F.col("prompt")).alias("overlap"))


_GRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda k: substr({0}, k, 3))) WHEN length({0}) > 0 THEN [{0}] ELSE [] END"


@query(f"WITH {_PAIRS}, k AS (SELECT conv_id, turn, {_GRAMS.format('answer')} AS a, {_GRAMS.format('prompt')} AS b FROM p) SELECT conv_id, turn, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS jaccard FROM k")
def c27_gram_jaccard(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", T.gram_jaccard(F.col("answer"), F.col("prompt")).alias("jaccard"))


def _has(words, col="text") -> str:
    return f"regexp_matches(lower({col}), '{vocab.pattern(words)}')"


@query(f"SELECT conv_id, turn, CASE WHEN {_has(('was', 'with', 'for'))} THEN 2 WHEN {_has(('of', 'the'))} THEN 1 ELSE 0 END AS tier, concat_ws(',', CASE WHEN {_has(('was', 'with', 'for'))} THEN 'brief' END, CASE WHEN {_has(('and', 'this', 'that'))} THEN 'formal' END) AS cues, {_has(('not', 'or'))} AS correction FROM conversations")
def c28_c29_c30_cues(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tier(t, vocab.PROBE_VOLATILE, vocab.PROBE_STABLE).alias("tier"), F.array_join(T.cues(t, {"brief": vocab.PROBE_VOLATILE, "formal": vocab.PROBE_RECENT}), ",").alias("cues"), vocab.has(t, ("not", "or")).alias("correction"))


@query(f"""SELECT conv_id, turn, CASE WHEN {_has(('was',))} AND {_has(('the',))} THEN 'strong' WHEN {_has(('was',))} THEN 'item' WHEN {_has(('for',))} AND turn > 0 THEN 'weak_with_context' WHEN {_has(('for',))} THEN 'weak' ELSE 'none' END AS intent, {_has(('this', 'that'))} AS recall FROM conversations""")
def c31_c32_save_intent(spark, sf_dir):
    from verdigris.functions import scoring as S

    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.save_intent(vocab.has(t, ("was",)), vocab.has(t, ("the",)), vocab.has(t, ("for",)), F.col("turn") > 0).alias("intent"), vocab.has(t, ("this", "that")).alias("recall"))


@query("""WITH e AS (SELECT doc_id, list_reverse(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS e FROM documents), u AS (SELECT doc_id, unnest(e) AS w, generate_subscripts(e, 1) AS k FROM e), f AS (SELECT doc_id, w, min(k) AS k FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM f)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY r) FILTER (r <= 5), '') AS recent FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY 1""")
def c33_recent_entities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.recent_entities(T.entity_mentions(F.col("text"))), " ").alias("recent"))


@query("SELECT doc_id, substr(sha256(replace(replace(text, ' it ', ' X '), ' X and ', ' X, ')), 1, 12) AS digest FROM documents")
def c34_coreference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(T.replaced_in_order(F.col("text"), ((" it ", " X "), (" X and ", " X, "))), 12).alias("digest"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, CAST(count(*) FILTER (length(trim(s, ' ')) BETWEEN 11 AND 199 AND (ends_with(trim(s, ' '), '?') OR regexp_matches(lower(trim(s, ' ')), '^(the|and|of)[^a-z]'))) AS BIGINT) AS questions FROM s GROUP BY 1""")
def c35_questions(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return s.groupBy("doc_id").agg(F.count_if(T.is_question(F.col("s"), ("the", "and", "of"))).alias("questions"))


@query("""WITH a AS (SELECT conv_id, turn, lower(trim(text, ' ')) AS t FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN starts_with(t, 'the ') THEN substr(t, 5) ELSE t END AS t FROM a), c AS (SELECT conv_id, turn, CASE WHEN starts_with(t, 'a ') THEN substr(t, 3) ELSE t END AS t FROM b), d AS (SELECT conv_id, turn, CASE WHEN starts_with(t, 'an ') THEN substr(t, 4) ELSE t END AS t FROM c)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '[!-,./:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g')) AS answer FROM d""")
def c36_short_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.short_answer(F.col("text")).alias("answer"))


_REPLY = "CASE page_id % 8 WHEN 0 THEN 'B.' WHEN 1 THEN 'I think **C** fits' WHEN 2 THEN 'The answer is (d)' WHEN 3 THEN 'Surely this one (E).' WHEN 4 THEN 'It is 3' WHEN 5 THEN 'option 2' WHEN 6 THEN 'we say 7 or 9' ELSE 'no idea' END"
_REPLY_LETTER = "CASE page_id % 8 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' WHEN 3 THEN 'E' WHEN 4 THEN 'I' ELSE NULL END"


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' WHEN 3 THEN 'E' END AS letter, CASE page_id % 8 WHEN 0 THEN 'exact' WHEN 1 THEN 'bold' WHEN 2 THEN 'tagged' WHEN 3 THEN 'terminal' ELSE 'none' END AS letter_layer,
CASE page_id % 8 WHEN 4 THEN '3' WHEN 5 THEN '2' WHEN 6 THEN '7' END AS number, CASE page_id % 8 WHEN 4 THEN 'first' WHEN 5 THEN 'tagged' WHEN 6 THEN 'first' ELSE 'none' END AS number_layer FROM pages""")
def c37_c38_parsers(spark, sf_dir):
    r = F.expr(_REPLY)
    letter, layer = T.parsed_letter(r, "ABCDEFGH")
    number, how = T.parsed_number(r, 8)
    return table(spark, sf_dir, "pages").select("page_id", letter.alias("letter"), layer.alias("letter_layer"), number.alias("number"), how.alias("number_layer"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'routing_override' WHEN doc_id % 10 = 8 THEN 'incorrect' WHEN doc_id % 10 = 7 THEN 'abstain' WHEN doc_id % 10 = 6 THEN 'correct' WHEN doc_id % 10 = 5 THEN 'judge_review' WHEN doc_id % 10 = 4 THEN 'incorrect' ELSE 'correct' END AS verdict,
CASE WHEN doc_id % 10 = 9 THEN 'routing_override' WHEN doc_id % 10 = 8 THEN 'empty_response' WHEN doc_id % 10 = 7 THEN 'abstain_detected' WHEN doc_id % 10 = 6 THEN 'exact_normalized' WHEN doc_id % 10 = 5 THEN 'short_gold_late_match' WHEN doc_id % 10 = 4 THEN 'no_match' ELSE 'substring' END AS layer FROM documents""")
def c39_c40_answer_scorer(spark, sf_dir):
    response = F.expr("CASE doc_id % 10 WHEN 8 THEN '  ' WHEN 7 THEN 'I don''t know that' WHEN 6 THEN 'The Blue Whale!' WHEN 5 THEN concat(repeat('filler text ', 6), 'oslo is big, og it is') WHEN 4 THEN 'it is not a blue whale' ELSE 'surely a blue whale, yes' END")
    gold = F.expr("CASE WHEN doc_id % 10 = 5 THEN 'og' ELSE 'blue whale' END")
    replies = table(spark, sf_dir, "documents").select("doc_id", response.alias("response"), gold.alias("gold"), F.expr("CASE WHEN doc_id % 10 = 9 THEN 'verify' END").alias("decision"))
    return T.score_answers(replies).select("doc_id", "verdict", "layer")


@query(f"SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT {_has(('the',))} THEN 'object' END, CASE WHEN NOT {_has(('for', 'to'))} THEN 'purpose' END, CASE WHEN length(text) < 60 THEN 'detail' END) AS missing FROM conversations")
def c41_missing_context(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.tags_in_order({"object": ~vocab.has(t, ("the",)), "purpose": ~vocab.has(t, ("for", "to")), "detail": F.length(t) < 60}), ",").alias("missing"))


@query("SELECT conv_id, turn, length(text) < 40 AND regexp_matches(lower(text), '(of|to)') AS thin, regexp_matches(lower(text), '(smoke|ouaed)') AS contaminated FROM conversations")
def c42_c43_thin_and_contaminated(spark, sf_dir):
    t = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.length("text") < 40) & t.rlike("(of|to)")).alias("thin"), t.rlike("(smoke|ouaed)").alias("contaminated"))


@query(f"""WITH {_PAIRS}, f AS (SELECT conv_id, turn, list_filter(regexp_extract_all(answer, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'), lambda x: NOT contains(lower(prompt), lower(x))) AS f FROM p) SELECT conv_id, turn, CAST(len(list_distinct(f)) AS BIGINT) AS phrases FROM f""")
def c45_fabrication(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.size(T.fabricated_phrases(F.col("answer"), F.col("prompt"), 1000)).cast("long").alias("phrases"))


@query(f"SELECT conv_id, turn, length(text) AS n, ends_with(text, '?') AS ends_question, contains(text, '?') AS has_question, {_has(('with', 'for'))} AS verifies, {_has(('was', 'this'))} AS fresh, trim(text, ' ') = '' AS empty FROM conversations")
def c46_structural_features(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(t).cast("long").alias("n"), t.endswith("?").alias("ends_question"), F.contains(t, F.lit("?")).alias("has_question"), vocab.has(t, ("with", "for")).alias("verifies"), vocab.has(t, ("was", "this")).alias("fresh"), (F.trim(t) == "").alias("empty"))


@query("""SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(text, '(gsk_|sk-|ghp_)[A-Za-z0-9_-]{8,}', '[secret]', 'g'), 'token = "[^"]*"', 'token = "[secret]"', 'g')), 1, 12) AS digest, contains(text, 'token = "') AS had FROM documents""")
def c47_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(T.scrubbed(F.col("text")), 12).alias("digest"), F.contains("text", F.lit('token = "')).alias("had"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS query_fp, substr(sha256(lang || '|' || source || '|' || CAST(doc_id AS VARCHAR)), 1, 16) AS entry_fp FROM documents")
def c48_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text"), 12).alias("query_fp"), T.fingerprint(F.concat_ws("|", "lang", "source", F.col("doc_id").cast("string")), 16).alias("entry_fp"))


@query("""SELECT doc_id, trim(string_split(text, chr(10))[1], ' ') AS title, substr(trim(coalesce(string_split(text, chr(10))[2], ''), ' '), 1, 120) AS summary, regexp_extract(source, '^[a-z]+', 0) AS family FROM documents""")
def c49_title_and_family(spark, sf_dir):
    line = lambda k: F.trim(F.coalesce(F.get(F.split("text", "\n"), k), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", line(0).alias("title"), F.substring(line(1), 1, 120).alias("summary"), F.regexp_extract("source", "^[a-z]+", 0).alias("family"))


@query("SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))")
def c50_normalised_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.squeezed(F.lower("text")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_FIRST = "regexp_extract(text, '[A-Za-z]{2,}')"


@query(f"""WITH a AS (SELECT lower({_FIRST}) AS alias, min(doc_id) AS target FROM documents WHERE {_FIRST} <> '' GROUP BY 1),
w AS (SELECT conv_id, turn, text AS word FROM conversations UNION ALL SELECT conv_id, -1 - turn, {_FIRST} FROM conversations), k AS (SELECT conv_id, turn, word, lower(trim(word, ' ')) AS w FROM w),
c AS (SELECT conv_id, turn, 0 AS p, w AS alias FROM k UNION ALL SELECT conv_id, turn, 1, substr(w, 1, length(w) - 3) || 'y' FROM k WHERE ends_with(w, 'ies') AND length(w) > 4 UNION ALL SELECT conv_id, turn, 2, substr(w, 1, length(w) - 2) FROM k WHERE ends_with(w, 'es') AND length(w) > 3 UNION ALL SELECT conv_id, turn, 3, substr(w, 1, length(w) - 1) FROM k WHERE ends_with(w, 's') AND length(w) > 2
UNION ALL SELECT conv_id, turn, 4 + generate_subscripts(l, 1), lower(unnest(l)) FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(word, '[ \\t\\n\\r\\f]+'), lambda t: regexp_replace(t, '^[,.?!:;''"()\\[\\]]+|[,.?!:;''"()\\[\\]]+$', '', 'g')), lambda t: length(t) >= 2 AND t = upper(t) AND t <> lower(t)) AS l FROM k))
SELECT w.conv_id, w.turn, m.target FROM w LEFT JOIN (SELECT conv_id, turn, arg_min(target, p) AS target FROM c JOIN a USING (alias) GROUP BY ALL) m USING (conv_id, turn)""")
def c51_alias_lookup(spark, sf_dir):
    """Turns, and their first words, looked up among the first words of all documents."""
    from verdigris.operators import lookup

    first = F.regexp_extract("text", "[A-Za-z]{2,}", 0)
    aliases = table(spark, sf_dir, "documents").select(F.lower(first).alias("alias"), "doc_id").filter("alias != ''").groupBy("alias").agg(F.min("doc_id").alias("target"))
    c = table(spark, sf_dir, "conversations")
    words = c.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("word")).union(c.select(F.struct("conv_id", (-1 - F.col("turn")).alias("turn")), first))
    return lookup.aliases(words, aliases).select("id.conv_id", "id.turn", "target")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'mixed' WHEN doc_id % 3 = 0 THEN 'retrieved' WHEN doc_id % 2 = 0 THEN 'model' ELSE 'none' END AS source_class, contains(text, 'persona') AS persona FROM documents""")
def c52_c53_source_class(spark, sf_dir):
    from verdigris.functions import scoring as S

    return table(spark, sf_dir, "documents").select("doc_id", S.knowledge_source(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("source_class"), F.contains("text", F.lit("persona")).alias("persona"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, '[As of') THEN text ELSE '[As of 2024-01-01] ' || text END AS bound, CASE role WHEN 'user' THEN 'u' WHEN 'system' THEN 's' ELSE 'en' END AS bucket FROM conversations")
def c54_c55_prefix_and_bucket(spark, sf_dir):
    bucket = F.coalesce(F.get(F.array(F.when(F.col("role") == "user", "u").when(F.col("role") == "system", "s")), 0), F.lit("en"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.grammar_prefixed(F.col("text"), F.lit("2024-01-01")).alias("bound"), bucket.alias("bucket"))
