"""Registered queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.llm import (
    byte_bpe, chat_format, decontaminate, fill_middle, licenses, minmax_dedup, quality, spelling_variants, suffix_index, token_store, toxicity, url_filter, warc,
)
from boreflow.llm.shared import Scratch, read

#: Id that ends each document in the token store.
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("store")
    token_store.write(read(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), END_ID)
    got = token_store.read(spark, path)
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = tokenizer_path("byte_bpe_50k.tiktoken"), piece_pattern()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = byte_bpe.encode(docs, *how, keep_text=False, decoded="decoded")
    return got.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    judged = quality.judge(docs.select("doc_id", "text"), quality.ratio_model(docs, trusted))
    return judged.select("doc_id", *quality.BASE, "base_failed", "score", "kept")


#: Host, path and verdict of the production rules.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES, Scratch(spark, "urls"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax_dedup.near_groups(read(spark, sf_dir, "documents"), Scratch(spark, "near"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_index.remove_repeats(read(spark, sf_dir, "documents"), Scratch(spark, "repeats"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs, items, Scratch(spark, "leaks"), distance=decontaminate.WINDOW)
    ids = F.array_sort(F.coalesce(F.col("item_ids").cast("array<string>"), F.array().cast("array<string>")))
    n_hit = decontaminate.hit_words("spans")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce(F.size("near_ids"), F.lit(0)).cast("bigint").alias("n_near_items"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))
    held_out = (~toxicity.in_training("doc_id")).alias("held_out")
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the digest and licence of its whole text, and the licences of its lines with how many lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("version"))
    known = licenses.known_licenses(spark)
    rows = docs.select(F.struct("doc_id", "version").alias("row"), "text")
    lines = licenses.notices(rows, known, doc_id="row").groupBy(F.col("doc_id").alias("row")).agg(
        F.count_distinct("line").alias("n_lines"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses")
    )  # rows that repeat an id and a text have the same lines
    whole = licenses.scan(docs, known)
    same = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("version") == F.col("row.version"))
    found = whole.join(lines, same, "left")
    return found.select("doc_id", "digest", "license", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "line_licenses")


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in two replicas; the second has damage planted by page_id, which the audit must find."""
    scratch = Scratch(spark, "warc")
    first = scratch.save(warc.pack(read(spark, sf_dir, "pages")), "replica-1")
    broken = F.concat(F.expr("substring(record, 1, length - 1)"), F.lit("X").cast("binary"))
    second = first.where("page_id % 101 <> 3").withColumn(
        "record", F.when(F.expr("page_id % 50 = 7"), broken).otherwise(F.col("record"))
    )
    second = second.union(first.where("page_id % 211 = 5").withColumn("archive", F.lit("spare")))
    return warc.audit(first, scratch.save(second, "replica-2"), scratch)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants.variants(read(spark, sf_dir, "documents"), Scratch(spark, "spelling"))
    return found.select("word", "n", "n_near", "form", "form_n", "root")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


#: A conversation of its own whose texts hold the marks of the template.
ODD_ID, ODD_TEXT = -7, "\\### Assistant: </turn> ok"


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, rows = Scratch(spark, "chat"), read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = rows.union(spark.range(2).select(F.lit(ODD_ID).cast("bigint"), "id", role, F.lit(ODD_TEXT)))
    windows = scratch.save(chat_format.format_windows(rows, scratch), "windows")
    return chat_format.summaries(windows)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_store, op2_byte_bpe, op3_near_dedup, op4_suffix_dedup, op5_decontaminate, op6_toxicity, op7_licenses, op8_quality, op9_url_filter, op10_warc_fixity,
        op11_spelling_variants, op12_fill_middle, op13_chat_windows,
    )
}



def _canonical_sql(text: str) -> str:
    """The canonical form of a licence text in SQL; a regex engine without lookaround drops hyphens in two passes."""
    t = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{licenses._HEADER}', ''), '{licenses._COPYRIGHT}', '', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\p{{L}})-(\p{{L}})', '\1\2', 'g')"
    same = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licenses.EQUIVALENT.items())
    words = rf"list_filter(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: CASE w {same} ELSE w END), ' ')"


def _licenses_sql() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = [(n, t, None) for n, ts in licenses.KNOWN.items() for t in ts] + [(n, None, d) for n, ds in licenses.KNOWN_DIGESTS.items() for d in ds]
    known = ",\n    ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    return rf"""
WITH k(license, text, given) AS (VALUES {known}),
f AS (SELECT license, given, {_canonical_sql("text")} AS form FROM k),
g AS (SELECT coalesce(given, sha256(form)) AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license FROM f WHERE given IS NOT NULL OR form <> '' GROUP BY 1),
d AS (SELECT doc_id, text, sha256({_canonical_sql("text")}) AS digest FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM (SELECT DISTINCT doc_id, text FROM documents)),
n AS (SELECT doc_id, text, i, sha256({_canonical_sql("line")}) AS digest FROM l WHERE regexp_matches(line, '[\p{{L}}\p{{N}}]')),
m AS (SELECT doc_id, text, count(DISTINCT i) AS n_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM n JOIN g USING (digest) GROUP BY 1, 2)
SELECT d.doc_id, d.digest, g.license, coalesce(n_lines, 0) AS n_lines, line_licenses FROM d LEFT JOIN g ON g.digest = d.digest
    LEFT JOIN m ON m.doc_id IS NOT DISTINCT FROM d.doc_id AND m.text = d.text"""


ORACLE_SQL: dict[str, str] = {
    "op7_licenses": _licenses_sql(),
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
        lambda s: w[s : s + least(10, len(w)) - 1])) AS g FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, w FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m),
h AS (SELECT doc_id, s, p.m, item_id FROM p JOIN i ON p.m = i.m AND w[s : s + p.m - 1] = g),
k AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS q FROM h) GROUP BY 1),
c AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) WHERE term IN (SELECT unnest(w) FROM b) GROUP BY 1),
x AS (SELECT DISTINCT item_id, m, s, j, w[j] AS term, coalesce(c.n, 0) AS n FROM (SELECT item_id, w, m, s, unnest(range(s, s + m)) AS j
    FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM (SELECT DISTINCT * FROM b)
    WHERE len(w) > 1)) LEFT JOIN c ON c.term = w[j]),
y AS (SELECT *, row_number() OVER (PARTITION BY item_id, s ORDER BY n, term, j) AS k FROM x),
a AS (SELECT DISTINCT e.item_id, e.term AS t1, f.term AS t2 FROM y e JOIN y f ON e.item_id = f.item_id AND e.s = f.s
    WHERE e.k = 1 AND f.k = 2 AND e.n > 0),
o AS (SELECT doc_id, j, w[j] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) WHERE w[j] IN (SELECT t1 FROM a UNION SELECT t2 FROM a)),
u AS (SELECT e.doc_id, count(DISTINCT a.item_id) AS n FROM a JOIN o e ON e.term = a.t1 JOIN o f ON f.doc_id = e.doc_id AND f.term = a.t2
    AND abs(f.j - e.j) BETWEEN 1 AND 10 GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ','
        ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
    sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(k.n, 0) > 0 AS contaminated, coalesce(u.n, 0) AS n_near_items
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)""",
    "op9_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')) AS t(h, p, v)),
m AS (SELECT q.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
    FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
    "op10_warc_fixity": r"""
WITH w AS (SELECT page_id, coalesce(CAST(page_id // 1024 AS VARCHAR), 'none') AS archive,
    'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e ||
    'WARC-Date: 2024-01-01T00:00:00Z' || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') ||
    '>' || e || 'Content-Type: text/html' || e || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || e || e ||
    coalesce(html, '') || e || e AS record FROM pages, (SELECT chr(13) || chr(10) AS e)),
a AS (SELECT *, octet_length(encode(record)) AS length, coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY archive
    ORDER BY page_id, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w),
b AS (SELECT archive, pos, length, CASE WHEN page_id % 50 = 7 THEN left(record, length(record) - 1) || 'X' ELSE record END
    AS record FROM a WHERE page_id % 101 <> 3
    UNION ALL SELECT 'spare', pos, length, record FROM a WHERE page_id % 211 = 5),
g AS (SELECT archive, pos, string_agg(h, '' ORDER BY h) AS hs, count(*) AS n, sum(length) AS length
    FROM (SELECT archive, pos, sha256(record) AS h, length FROM b) GROUP BY ALL),
y AS (SELECT archive, pos, CASE WHEN n = 1 THEN hs ELSE sha256(hs) END AS hash_b, length AS length_b FROM g),
x AS (SELECT archive, pos, sha256(record) AS hash_a, length AS length_a FROM a)
SELECT archive, CAST(pos AS BIGINT) AS "offset",
    CASE WHEN hash_b IS NULL THEN 'missing' WHEN hash_a IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
    hash_a, hash_b, CAST(length_a AS BIGINT) AS length_a, CAST(length_b AS BIGINT) AS length_b
FROM x FULL JOIN y USING (archive, pos) WHERE hash_a IS DISTINCT FROM hash_b""",
    "op11_spelling_variants": r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
x AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT]
    ELSE [195, ord(c)::BIGINT - 64] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM x, tab),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) ||
    substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM k a JOIN k b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
    UNION SELECT k.word, k.n, w.word, w.n FROM k JOIN w ON k.p || k.s = w.word
    UNION SELECT w.word, w.n, k.word, k.n FROM k JOIN w ON k.p || k.s = w.word),
f AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS q FROM e),
g AS (SELECT word, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM f WHERE q = 1),
r AS (SELECT word, form AS root FROM g WHERE form IS NOT NULL
    UNION ALL SELECT r.word, g.form FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL)
SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, g.form, g.form_n, coalesce(z.root, w.word) AS root FROM w LEFT JOIN g USING (word)
    LEFT JOIN (SELECT r.word, r.root FROM r LEFT JOIN g ON g.word = r.root WHERE g.form IS NULL) z USING (word)""",
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p""",
    "op13_chat_windows": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]')) + 4 AS tokens,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS r,
    replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS x FROM c),
q AS (SELECT *, place = 1 AND role = 'system' AS sys, 14 + length(r) + length(x) AS chars FROM o),
s AS (SELECT *, sum(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS st,
    sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM q),
h AS (SELECT *, upto - tokens AS before, greatest(768 - st, 256) // 2 AS half FROM s WHERE NOT sys),
w AS (SELECT conv_id, win, min(before) AS start FROM (SELECT conv_id, before, 2 * (before // half) + CASE WHEN tokens > half THEN 1 ELSE 0 END AS win FROM h)
    GROUP BY ALL),
f AS (SELECT conv_id, chars FROM h UNION ALL SELECT h.conv_id, h.chars FROM h JOIN w ON h.conv_id IS NOT DISTINCT FROM w.conv_id
        AND h.upto <= w.start AND w.start - h.before <= 256
    UNION ALL SELECT q.conv_id, q.chars FROM q JOIN w ON q.conv_id IS NOT DISTINCT FROM w.conv_id WHERE sys
    UNION ALL SELECT conv_id, chars FROM q WHERE sys AND NOT EXISTS (SELECT 1 FROM w WHERE w.conv_id IS NOT DISTINCT FROM q.conv_id)),
z AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS n FROM f GROUP BY 1),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS loss FROM o GROUP BY 1)
SELECT t.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    z.n AS formatted_chars FROM t JOIN z ON t.conv_id IS NOT DISTINCT FROM z.conv_id""",
}
