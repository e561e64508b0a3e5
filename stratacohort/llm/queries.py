"""Queries over the corpus operators, with DuckDB SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, line_dedup, near_dedup, packing, phrases, quality_rules, resample, sentencepiece_codec, substring_dedup, url_filter, warc
from .common import new_path

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A conversation may hold a third of all rows: no row of the query's result holds more characters than this and one message.
PART_CHARS = 1 << 20


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.rotate(table(spark, sf_dir, "conversations"), part_chars=PART_CHARS)
    return out.withColumn("masks", F.array_join(F.transform("masks", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ","))


OP2_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER () AS r FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
m AS (SELECT t.conv_id, perspective, turn, role, text, r, coalesce(role = perspective, false) AS own,
      '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user' ELSE 'user name=' || regexp_replace(role, '[\s<|>]+', '_', 'g') END || chr(10) AS head,
      replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') || '<|im_end|>' || chr(10) AS body FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER w - length(head) - length(body) AS s, row_number() OVER w AS k FROM m
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, r ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, (s // @PART@)::BIGINT AS part FROM o),
z AS (SELECT *, s - min(s) OVER (PARTITION BY conv_id, perspective, part) AS pos FROM q)
SELECT conv_id, perspective, part, count(*)::BIGINT AS n_messages, count_if(own)::BIGINT AS n_trained, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg((pos + length(head))::BIGINT::VARCHAR || '-' || (pos + length(head) + length(body) - 1)::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (WHERE own), '') AS masks
FROM z GROUP BY conv_id, perspective, part
""".replace("@PART@", str(PART_CHARS))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


#: Rounds that the SQL spells out; the fit ends before (22 rounds at sf0.1), so more change nothing.
SQL_ROUNDS = 60


def _em_sql() -> str:
    """The rounds of expectation maximisation, each a table of rates r{k}(j, g, b) and a prior pr{k}(prior)."""
    q = quality_rules
    bound = lambda a, b: f"CASE WHEN {b} > 0 THEN greatest({q.LEAST}, least({q.MOST}, {a} / {b})) ELSE 0.5 END"
    out = [f"s0 AS MATERIALIZED (SELECT votes, n, CASE WHEN list_contains(votes, -1) THEN 1 - {q.PRIOR}::DOUBLE ELSE {q.PRIOR}::DOUBLE END AS p FROM pat)"]
    for k in range(SQL_ROUNDS + 1):
        out.append(f"pr{k} AS MATERIALIZED (SELECT {bound('sum(n * p)', 'sum(n)')} AS prior FROM s{k})")
        side = lambda w: bound(f"sum({w}) FILTER (WHERE v = -1)", f"coalesce(sum({w}) FILTER (WHERE v <> 0), 0)")
        zero = lambda x: x.replace("sum(n * p) FILTER (WHERE v = -1)", "coalesce(sum(n * p) FILTER (WHERE v = -1), 0)").replace("sum(n * (1 - p)) FILTER (WHERE v = -1)", "coalesce(sum(n * (1 - p)) FILTER (WHERE v = -1), 0)")
        out.append(f"r{k} AS MATERIALIZED (SELECT j, {zero(side('n * p'))} AS g, {zero(side('n * (1 - p)'))} AS b FROM (SELECT *, unnest(votes) AS v, generate_subscripts(votes, 1) AS j FROM s{k}) GROUP BY j)")
        out.append(f"""s{k + 1} AS MATERIALIZED (SELECT votes, any_value(n) AS n, 1 / (1 + exp(-(any_value(ln(prior / (1 - prior))) + sum(CASE v WHEN -1 THEN ln(g / b) WHEN 1 THEN ln((1 - g) / (1 - b)) ELSE 0 END)))) AS p
            FROM (SELECT *, unnest(votes) AS v, generate_subscripts(votes, 1) AS j FROM pat) x JOIN r{k} USING (j) CROSS JOIN pr{k} GROUP BY votes)""")
    return ",\n".join(out)


OP3_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT d, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT d, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT d, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT d, count(DISTINCT p)::BIGINT AS n FROM (SELECT d, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY d, s) AS c FROM win) WHERE c >= 2) GROUP BY d),
li AS (SELECT d, count(*)::BIGINT AS n, (count(*) - count(DISTINCT l))::BIGINT AS dup FROM (SELECT d, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY d),
c AS (SELECT w.d, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '\p{Lu}\p{Lu}+')) AS n_caps, len(regexp_extract_all(t, '[.,;:!?]')) AS n_marks,
      len(list_filter(w, lambda x: regexp_full_match(x, '[\p{L}\p{M}\p{Nd}\x27’-]+[.,;:!?]*'))) AS n_plain,
      coalesce(list_sum(list_transform(range(1, len(w) + 1, 64), lambda i: len(list_distinct(list_slice(w, i, i + 63))))), 0) AS n_block_distinct, coalesce(li.n, 0) AS n_lines, coalesce(li.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN li USING (d) LEFT JOIN rep USING (d)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 40 THEN 1 ELSE 0 END, @RATIOS@] AS votes FROM c),
pat AS MATERIALIZED (SELECT votes, count(*) AS n FROM v GROUP BY votes),
@EM@
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS p_good
FROM v JOIN @LAST@ USING (votes)
"""
#: Counts, what they are shares of, the two percentages, and the votes up to the first and from the second on.
_RATIOS = [("n_symbols", "n_words", 5, 25, 1), ("n_plain", "n_words", 70, 90, -1), ("n_repeat_words", "n_words", 10, 30, 1), ("n_block_distinct", "n_words", 45, 65, -1), ("n_dup_lines", "n_lines", 10, 50, 1), ("n_caps", "n_words", 5, 25, 1), ("n_marks", "n_words", 40, 80, 1)]
OP3_SQL = (
    OP3_SQL.replace("@RATIOS@", ", ".join(f"CASE WHEN {b} = 0 THEN 0 WHEN 100 * {a} <= {lo} * {b} THEN {v} WHEN 100 * {a} >= {hi} * {b} THEN {-v} ELSE 0 END" for a, b, lo, hi, v in _RATIOS))
    .replace("@EM@", _em_sql()).replace("@LAST@", f"s{SQL_ROUNDS + 1}")
)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: A public tokenizer's model file; the driver reads it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, PIECE_MODEL).drop("text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (SELECT d, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
           FROM (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents)),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT d) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(hot.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY d
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT d, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT d.*, z.n, unnest(range(1, len(w) - z.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) z WHERE len(w) >= z.n)),
hits AS (SELECT dw.d, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hw AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS p FROM hits) GROUP BY d),
hi AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT d, item_id::VARCHAR AS item FROM hits) GROUP BY d)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (d) LEFT JOIN hi USING (d)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.dedup(table(spark, sf_dir, "pages")), path)
    again = F.col("record_type") == "revisit"
    id_of = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")  # noqa: E731  after urn:page:
    return warc.read(spark, path).select(
        id_of("record_id").alias("page_id"),
        F.when(again, F.col("http_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.col("payload_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", id_of("refers_to").alias("refers_to"),
    )


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS payload_digest FROM pages),
n AS (SELECT *, strlen(h)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM n
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Passages of over 50 words are found wherever they begin and end.
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=51)
    return out.select("doc_id", "n_sentences", "n_removed", F.col("kept_text").alias("text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(verdict, *url_filter.parse_rule(rule)) for verdict, rule in RULES]
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP10_SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT u.*, (SELECT max(struct_pack(n := length(h) + length(p), rule := h || p, v := verdict)) FROM r
      WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM m
"""

#: A public tokenizer whose words are encoded apart; the driver reads it.
WORD_MODEL = "/opt/tokenizers/word_bpe_49k.json"


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"), ["doc_id"], WORD_MODEL, apart=True)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) t(m) WHERE len(w) >= m),
g AS MATERIALIZED (SELECT lang, m, list_slice(w, i, i + m - 1) AS ws, count(*)::BIGINT AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, ws, f AS a FROM g WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.ws, k.a, k.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * k.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
      FROM k JOIN g x ON x.lang = k.lang AND x.ws = list_slice(k.ws, 1, k.k) JOIN g y ON y.lang = k.lang AND y.ws = list_slice(k.ws, k.k + 1, k.m)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
v AS (SELECT lang, list_slice(ws, s, s + z - 1) AS ws, max(a) AS f FROM (SELECT c.*, s.s, z.z FROM c, (VALUES (1), (2), (3)) s(s), (VALUES (2), (3)) z(z) WHERE z.z < m AND s.s + z.z - 1 <= m) GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.ws = b.ws WHERE v.f IS NULL OR 100 * v.f::HUGEINT < 80 * b.a::HUGEINT),
z AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM e)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) z JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "clicks"), "client_id", "ts", "value", "click_id", "Asia/Kolkata").withColumnRenamed("avg", "avg_cents")


OP13_SQL = r"""
WITH c AS (SELECT client_id, click_id, epoch_us(ts) AS us, floor(100 * value + 0.5)::BIGINT AS v FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
s AS (SELECT *, (us - ((us % 1000000) + 1000000) % 1000000) // 1000000 AS t FROM c),
p AS (SELECT client_id, t, v FROM (SELECT *, row_number() OVER (PARTITION BY client_id, t ORDER BY click_id DESC NULLS LAST, v DESC) AS r FROM s) WHERE r = 1),
n AS (SELECT *, lead(t) OVER w - t AS d, lead(v) OVER w AS w FROM p WINDOW w AS (PARTITION BY client_id ORDER BY t)),
g AS (SELECT client_id, t, v::HUGEINT AS v, w::HUGEINT AS w, d FROM n WHERE d <= 3600),
b AS (SELECT *, unnest(range(t - (((t + 19800) % 3600) + 3600) % 3600, t + d, 3600)) AS bucket_start FROM g),
u AS (SELECT *, greatest(bucket_start - t, 0)::HUGEINT AS u1, least(bucket_start + 3600 - t, d)::HUGEINT AS u2 FROM b),
q AS (SELECT *, (w - v) * u1 * u1 AS x1, (w - v) * u2 * u2 AS x2 FROM u),
a AS (SELECT client_id, bucket_start, u2 - u1 AS covered, 2 * v * (u2 - u1) + (x2 - ((x2 % d) + d) % d) // d - (x1 - ((x1 % d) + d) % d) // d AS area2, 0 AS points FROM q
      UNION ALL SELECT client_id, t - (((t + 19800) % 3600) + 3600) % 3600, 0, 0, 1 FROM p),
z AS (SELECT client_id, bucket_start, sum(points)::BIGINT AS n_points, sum(covered)::BIGINT AS covered_seconds, sum(area2)::BIGINT AS area2 FROM a GROUP BY client_id, bucket_start)
SELECT client_id, bucket_start::BIGINT AS bucket_start, n_points, covered_seconds, area2,
       CASE WHEN covered_seconds > 0 THEN ((area2 - ((area2 % (2 * covered_seconds)) + 2 * covered_seconds) % (2 * covered_seconds)) // (2 * covered_seconds))::BIGINT END AS avg_cents FROM z
"""

QUERIES = {"op1_near_dedup": op1_near_dedup, "op2_chat_format": op2_chat_format, "op3_quality_rules": op3_quality_rules, "op4_html_extract": op4_html_extract, "op5_sentencepiece": op5_sentencepiece, "op6_line_dedup": op6_line_dedup, "op7_decontaminate": op7_decontaminate, "op8_warc": op8_warc, "op9_substring_dedup": op9_substring_dedup, "op10_url_filter": op10_url_filter, "op11_packing": op11_packing, "op12_phrases": op12_phrases, "op13_resample": op13_resample}
ORACLES = {"op2_chat_format": OP2_SQL, "op3_quality_rules": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_decontaminate": OP7_SQL, "op8_warc": OP8_SQL, "op10_url_filter": OP10_SQL, "op12_phrases": OP12_SQL, "op13_resample": OP13_SQL}
