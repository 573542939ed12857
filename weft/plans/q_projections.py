"""Queries of the row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab
from weft.plans.registry import query
from weft.plans.tables import EDGES_SQL, FILES_SQL, NODES_SQL, edges, files, nodes, table


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(expr: str, mapping: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_BASE = "regexp_extract(path, '[^/]*$')"
_EXT = f"lower(regexp_extract({_BASE}, '^.+(\\.[^.]+)$', 1))"
_ACCENTS = f"translate({{}}, '{T._MARKED}', '{T._PLAIN}')"


@query("norm_id", "SELECT p_partkey, lower(trim(regexp_replace(p_type || '::' || p_name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS node_id FROM part")
def norm_id(spark, d):
    return table(spark, d, "part").select("p_partkey", T.norm_id(F.concat("p_type", F.lit("::"), "p_name")).alias("node_id"))


@query("norm_label", r"SELECT p_partkey, trim(regexp_replace(lower(p_type || '-' || p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS label FROM part")
def norm_label(spark, d):
    return table(spark, d, "part").select("p_partkey", T.norm_label(F.concat("p_type", F.lit("-"), "p_name")).alias("label"))


@query("search_tokens", f"SELECT doc_id, len(regexp_extract_all(lower({_ACCENTS.format('text')}), '[\\p{{L}}\\p{{N}}_]+')) AS n, coalesce(regexp_extract_all(lower({_ACCENTS.format('text')}), '[\\p{{L}}\\p{{N}}_]+')[1], '') AS first FROM documents")
def search_tokens(spark, d):
    tokens = T.search_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")).alias("first"))


@query("entropy_bits", """WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, length(p_name) AS n FROM part), g AS (SELECT p_partkey, ch, n, count(*) AS k FROM c GROUP BY ALL)
SELECT p_partkey, round(-sum(k / n * log2(k / n)), 6) AS bits FROM g GROUP BY p_partkey""")
def entropy_bits(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.entropy_bits(F.col("p_name")), 6).alias("bits"))


@query("shingles3", """WITH s AS (SELECT p_partkey, unnest(generate_series(1, length(p_name) - 2)) AS i, p_name FROM part)
SELECT DISTINCT p_partkey, substr(p_name, i, 3) AS shingle FROM s UNION SELECT p_partkey, p_name FROM part WHERE length(p_name) < 3""")
def shingles3(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(T.shingles(F.col("p_name"))).alias("shingle"))


@query("language_family", f"WITH {FILES_SQL} SELECT doc_id, {_case(_EXT, vocab.LANGUAGE_FAMILY)} AS family FROM files")
def language_family(spark, d):
    return files(spark, d).select("doc_id", T.language_family(F.col("path")).alias("family"))


@query("file_category", f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN {_EXT} IN ({_list(vocab.CODE_EXTENSIONS)}) THEN 'code' WHEN {_EXT} = '.pdf' THEN 'paper' WHEN {_EXT} IN ({_list(vocab.IMAGE_EXTENSIONS)}) THEN 'image' ELSE 'doc' END AS category, split_part(path, '/', 1) AS top FROM files")
def file_category(spark, d):
    return files(spark, d).select("doc_id", T.file_category(F.col("path")).alias("category"), T.top_dir(F.col("path")).alias("top"))


_SIGNALS = " + ".join(f"regexp_matches(substr(text, 1, 3000), '{p}')::int" for p in vocab.PAPER_SIGNALS)


@query("paper_signals", f"SELECT doc_id, ({_SIGNALS})::int AS signals, ({_SIGNALS}) >= 3 AS paper FROM documents")
def paper_signals(spark, d):
    n = T.paper_signals(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("signals"), (n >= 3).alias("paper"))


@query("classify_file", f"""WITH {FILES_SQL}
SELECT doc_id, CASE WHEN {_EXT} = '' THEN CASE WHEN regexp_matches(split_part(text, chr(10), 1), '^#!.*\\b(python|bash|sh|node|ruby|perl)') THEN 'code' END
 WHEN {_EXT} IN ({_list(vocab.CODE_EXTENSIONS)}) THEN 'code' WHEN {_EXT} = '.pdf' THEN CASE WHEN NOT regexp_matches(path, '\\.(imageset|xcassets|appiconset|colorset|launchimage)/') THEN 'paper' END
 WHEN {_EXT} IN ({_list(vocab.IMAGE_EXTENSIONS)}) THEN 'image' WHEN {_EXT} IN ({_list(vocab.DOC_EXTENSIONS)}) THEN CASE WHEN {_SIGNALS} >= 3 THEN 'paper' ELSE 'document' END
 WHEN {_EXT} IN ('.docx', '.xlsx') THEN 'document' WHEN {_EXT} IN ({_list(vocab.VIDEO_EXTENSIONS)}) THEN 'video' END AS kind FROM files""")
def classify_file(spark, d):
    return files(spark, d).select("doc_id", T.classify_file(F.col("path"), F.col("text")).alias("kind"))


@query("sensitive_filter", f"""WITH {FILES_SQL}, f AS (SELECT doc_id, path, {_BASE} AS name, {_EXT} AS ext, regexp_replace(regexp_replace({_BASE}, '(.)\\.[^.]*$', '\\1'), '^\\.+', '') AS stem FROM files),
s AS (SELECT *, ext IN ({_list([e for e in vocab.CODE_EXTENSIONS if e not in vocab.SECRET_PRONE])}) AS source, len(list_filter(regexp_split_to_array(stem, '[-_\\s.]+'), lambda x: x <> '')) AS words,
 regexp_matches(stem, '(?i)(^|[^a-z0-9])((credential|secret|passwd|password|private_key)s?|tokens?|service[._-]?account)([^a-z]|$)') AS hit,
 regexp_matches(stem, '(?i)(^|[^a-z0-9])((credential|secret|passwd|password|private_key)s?|tokens?|service[._-]?account)$') AS ends,
 regexp_matches(stem, '(?i)^((credential|secret|passwd|password|private_key)s?|tokens?|service[._-]?account)$') AS whole FROM f)
SELECT doc_id, regexp_matches(path, '(?i)(^|/)\\.(ssh|gnupg|aws|gcloud)/') OR (regexp_matches(path, '(?i)(^|/)\\.?(secrets)/|(^|/)credentials/') AND NOT source)
 OR ((regexp_matches(name, '(?i)^\\.(env|envrc)(\\.|$)') OR regexp_matches(name, '(?i)\\.(pem|key|p12|pfx|cert|crt|der|p8)$')) AND NOT regexp_matches(name, '(?i)^\\.(env|envrc)\\b.*(\\.example|\\.sample|\\.template|\\.dist)$'))
 OR ((ends OR (hit AND words <= 2)) AND NOT (source OR (ext IN ({_list(vocab.PROSE_EXTENSIONS)}) AND NOT whole))) AS sensitive FROM s""")
def sensitive_filter(spark, d):
    return files(spark, d).select("doc_id", T.is_sensitive(F.col("path")).alias("sensitive"))


@query("test_path", f"WITH {FILES_SQL} SELECT doc_id, regexp_matches(path, '(?i)(^|/)(tests|test|spec|specs|__tests__)(/|$)') OR regexp_matches({_BASE}, '(?i)^test_.*|_test\\..+$|\\.test\\..+$|\\.spec\\..+$|_spec\\..+$|\\.tests\\.ps1$') OR regexp_matches({_BASE}, 'Tests?\\.java$|Tests\\.cs$') AS is_test FROM files")
def test_path(spark, d):
    return files(spark, d).select("doc_id", T.is_test_path(F.col("path")).alias("is_test"))


@query("word_count", "SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+'))::bigint AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4)::bigint AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("confidence_defaults", f"WITH {EDGES_SQL} SELECT relation, confidence, count(*) AS n, round(sum(coalesce(CASE WHEN weight > 25 THEN weight / 50 END, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 ELSE 0.2 END)), 6) AS score FROM edges GROUP BY ALL")
def confidence_defaults(spark, d):
    score = T.confidence_score(F.when(F.col("weight") > 25, F.col("weight") / 50), F.col("confidence"))
    return edges(spark, d).groupBy("relation", "confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(score), 6).alias("score"))


@query("weight_sanitize", "SELECT event_id, CASE WHEN w IS NULL OR isnan(w) OR isinf(w) OR w < 0 THEN 1.0 ELSE w END AS weight FROM (SELECT event_id, try_cast(CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '-' || value::varchar WHEN 2 THEN NULL ELSE value::varchar END AS double) AS w FROM events)")
def weight_sanitize(spark, d):
    n, v = F.col("event_id") % 5, F.col("value").cast("string")
    raw = F.when(n == 0, "n/a").when(n == 1, F.concat(F.lit("-"), v)).when(n != 2, v)
    return table(spark, d, "events").select("event_id", T.weight(raw).alias("weight"))


@query("label_sanitize", "SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 256) AS label FROM documents")
def label_sanitize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.label_clean(F.col("text")).alias("label"))


@query("file_type_fold", f"SELECT event_id, CASE WHEN t IN ({_list(vocab.FILE_TYPES)}) THEN t ELSE coalesce({_case('t', vocab.FILE_TYPE_SYNONYMS)}, 'concept') END AS file_type FROM (SELECT event_id, (['markdown', 'code', 'tool', 'paper', 'whatever', 'data-source', 'text'])[(event_id % 7 + 1)::int] AS t FROM events)")
def file_type_fold(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("markdown", "code", "tool", "paper", "whatever", "data-source", "text"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.file_type(raw).alias("file_type"))


_URL_PATH = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("url_type", f"SELECT page_id, CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github' WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN ends_with({_URL_PATH}, '.pdf') THEN 'pdf' WHEN regexp_matches({_URL_PATH}, '\\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS url_type FROM pages")
def url_type(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_type(F.col("url")).alias("url_type"))


@query("html_to_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS body FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query("cypher_escape", "SELECT doc_id, replace(replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\', '\\\\'), '''', '\\''') AS literal FROM documents")
def cypher_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cypher_string(F.col("text")).alias("literal"))


@query("yaml_escape", """SELECT doc_id, '"' || regexp_replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), '[\\r\\n\\t]+', ' ', 'g') || '"' AS scalar FROM documents""")
def yaml_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.yaml_string(F.col("text")).alias("scalar"))


@query("content_hash", f"WITH {FILES_SQL} SELECT doc_id, sha256(encode(text) || '\\x00'::blob || encode(path)) AS sha FROM files")
def content_hash(spark, d):
    return files(spark, d).select("doc_id", T.content_hash(F.col("text"), F.col("path")).alias("sha"))


@query("stable_id", f"WITH {NODES_SQL} SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(sha1(label), 1, 8) AS stable FROM nodes")
def stable_id(spark, d):
    return nodes(spark, d).select("id", T.snake_stem_hash(F.col("label")).alias("stable"))


_QWORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query("query_terms", f"""WITH w AS (SELECT conv_id, turn, list_filter({_QWORDS}, lambda x: NOT regexp_matches(x, '^[a-z]{{1,2}}$')) AS terms FROM conversations WHERE role = 'user'),
c AS (SELECT *, list_filter(terms, lambda x: x NOT IN ({_list(vocab.STOPWORDS)})) AS content FROM w)
SELECT conv_id, turn, array_to_string(CASE WHEN len(content) > 0 THEN content ELSE terms END, ' ') AS terms FROM c""")
def query_terms(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


_HINTS = ", ".join(f"CASE WHEN list_has_any(words, [{_list(h)}]) THEN '{n}' END" for n, h in vocab.CONTEXT_HINTS.items())


@query("context_filters", f"""WITH q AS (SELECT event_id, (['which method calls the parser?', 'what imports this module', 'show return type and parameters', 'fields of the template', 'nothing here'])[(event_id % 5 + 1)::int] AS question FROM events),
w AS (SELECT event_id, regexp_split_to_array(translate(lower(question), '?,', '  '), '\\s+') AS words FROM q)
SELECT event_id, array_to_string(list_filter([{_HINTS}], lambda x: x IS NOT NULL), ',') AS contexts FROM w""")
def context_filters(spark, d):
    questions = ("which method calls the parser?", "what imports this module", "show return type and parameters", "fields of the template", "nothing here")
    q = F.element_at(F.array(*map(F.lit, questions)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.array_join(T.context_filters(q), ",").alias("contexts"))


@query("time_decay", "SELECT event_id, round(pow(0.5, greatest(0, epoch(timestamp '2025-01-01' - ts) / 86400) / 30), 9) AS weight FROM events")
def time_decay(spark, d):
    age = (F.unix_micros(F.lit("2025-01-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0
    return table(spark, d, "events").select("event_id", F.round(T.decay(age), 9).alias("weight"))
