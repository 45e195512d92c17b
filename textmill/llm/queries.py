"""The queries opN_<name> and the SQL that checks them. Each query is thin: the operator does the work."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import (
    conversation_trie, exact_dedup, language_id, license_scan, ngram_join, quality, sentencepiece_bpe, source_mix, substring_dedup, toxicity, url_filter, vector_codes, warc,
)
from textmill.llm.common import table


#: Dated entries of a filter list: rule, action, day.
URL_LIST = [
    ("casino-win.example.com", "block", "2024-01-05"), ("casino-win.example.com", "remove", "2024-03-01"),
    ("casino-win.example.com", "block", "2024-04-10"), ("free-bets.example.com", "block", "2024-02-01"),
    ("cheap-pills.example.com", "block", "2023-11-20"), ("www.cheap-pills.example.com", "allow", "2024-05-01"),
    ("ads-track.example.com", "block", "2024-01-20"), ("ads-track.example.com", "allow", "2024-02-20"),
    ("ads-track.example.com", "block", "2024-03-20"), ("tionsh.example.com", "block", "2024-03-15"),
    ("blog.tionsh.example.com", "allow", "2024-04-01"), ("blog.tionsh.example.com", "remove", "2024-05-15"),
    ("example.net", "block", "2024-06-01"),
]
#: Pages have no time of capture: a stand-in is this day and page_id mod 180 days after it.
FIRST_CAPTURE, CAPTURE_DAYS = "2024-01-01", 180


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document, or a line of it, names."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of the sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return source_mix.mix(docs)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page at its capture."""
    entries = spark.createDataFrame(URL_LIST, "rule string, action string, listed_at string").withColumn("listed_at", F.to_date("listed_at"))
    fetched = F.date_add(F.to_date(F.lit(FIRST_CAPTURE)), F.pmod(F.col("page_id"), F.lit(CAPTURE_DAYS)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    return url_filter.evaluate(captures, entries).drop("url")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """A file of public tokenizers: in TEXTMILL_TOKENIZERS if that is set, else where public_tokenizers has it."""
    if folder := os.environ.get("TEXTMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.sentencepiece(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=False, keep_text=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under the Jaccard join on word shingles."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from normalised archives."""
    return warc.page_records(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, with its error."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when passages of earlier ones go."""
    return substring_dedup.shared_passages(table(spark, sf_dir, "documents")).drop("intervals")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op3_source_mix": op3_source_mix,
    "op4_url_filter": op4_url_filter,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_ngram_join": op8_ngram_join,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_substring_dedup": op13_substring_dedup,
}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """license_scan.spelled(license_scan.plain(text)) in DuckDB SQL."""
    found = f"regexp_replace(lower({text}), {_quoted(license_scan.COPYRIGHT_LINE)}, ' ', 'g')"
    found = f"' ' || trim(regexp_replace({found}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for other, one in [*license_scan.SPELLINGS, *license_scan.SPELLINGS]:
        found = f"replace({found}, ' {other} ', ' {one} ')"
    return f"trim({found})"


def _codes_sql() -> str:
    """vector_codes.compress in DuckDB SQL: a step of the codebooks for each round."""
    nearest = """
        a{k} AS (
            SELECT vec_id, label, part, entry, far FROM (
                SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) AS r
                FROM (
                    SELECT v.vec_id, v.label, v.part, e.entry, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - e.x[i]) * (v.x[i] - e.x[i]))) AS far
                    FROM parts v JOIN e{k} e ON e.part = v.part
                )
            ) WHERE r = 1
        )"""
    refined = """
        s{k} AS (
            SELECT part, entry, list(floor_mean ORDER BY i) AS x FROM (
                SELECT a.part, a.entry, i, (sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
                FROM a{k} a JOIN parts v ON v.vec_id = a.vec_id AND v.part = a.part, range(1, (SELECT max(len(x)) + 1 FROM parts)) r(i)
                GROUP BY a.part, a.entry, i
            ) GROUP BY part, entry
        ),
        e{n} AS (SELECT part, entry, CASE WHEN s{k}.x IS NULL THEN e{k}.x ELSE list_transform(s{k}.x, lambda m: CAST(m AS BIGINT)) END AS x FROM e{k} LEFT JOIN s{k} USING (part, entry))"""
    rounds = vector_codes.ROUNDS
    steps = ",".join(nearest.format(k=k) + "," + refined.format(k=k, n=k + 1) for k in range(rounds))
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        parts AS (
            SELECT vec_id, label, part, q[part * (len(q) // {vector_codes.PARTS}) + 1:(part + 1) * (len(q) // {vector_codes.PARTS})] AS x
            FROM kept, range({vector_codes.PARTS}) r(part)
        ),
        e0 AS (
            SELECT part, entry, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id)
            WHERE entry < {vector_codes.ENTRIES}
        ),
        {steps},
        {nearest.format(k=rounds)},
        books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}),
        codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, books
    """


_KNOWN_SQL = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in license_scan.KNOWN.items() for text in texts)
_LIST_SQL = ", ".join(f"('{rule}', '{action}', DATE '{day}')" for rule, action, day in URL_LIST)

ORACLE_SQL = {
    "op1_license_scan": f"""
        WITH known AS (SELECT DISTINCT license, sha256({_canonical_sql("text")}) AS digest FROM (VALUES {_KNOWN_SQL}) k(license, text)),
        docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        units AS (SELECT row, true AS whole, text AS unit FROM docs UNION ALL SELECT row, false, unnest(string_split(text, chr(10))) FROM docs),
        hits AS (
            SELECT row, whole, license
            FROM (SELECT row, whole, sha256({_canonical_sql("unit")}) AS digest FROM units) JOIN known USING (digest)
        ),
        found AS (
            SELECT row, min(license) FILTER (whole) AS license,
                   coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole), '') AS line_licenses,
                   count(*) FILTER (NOT whole) AS n_license_lines
            FROM hits GROUP BY row
        )
        SELECT doc_id, license, coalesce(line_licenses, '') AS line_licenses, coalesce(n_license_lines, 0) AS n_license_lines
        FROM docs LEFT JOIN found USING (row)
    """,
    "op3_source_mix": f"""
        WITH RECURSIVE
        sizes AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
        total AS (SELECT greatest({source_mix.QUANTA}, 2 * count(*)) AS cycle, count(*) AS k, sum(pow(n, {source_mix.ALPHA})) AS w FROM sizes),
        shares AS (SELECT source, n, cycle, k, (cycle - k) * pow(n, {source_mix.ALPHA}) / w AS share FROM sizes, total),
        weights AS (
            SELECT source, n, cycle, CAST(1 + floor(share) AS BIGINT) + CAST(
                row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, source) <= cycle - k - sum(floor(share)) OVER () AS BIGINT) AS q
            FROM shares
        ),
        lists AS (SELECT list(q ORDER BY source) AS qs, list(source ORDER BY source) AS names, max(cycle) AS cycle FROM weights),
        run(slot, done, pick) AS (
            SELECT CAST(-1 AS BIGINT), list_transform(qs, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM lists
            UNION ALL
            SELECT slot + 1, list_transform(done, lambda d, i: d + CAST(i = p AS BIGINT)), p
            FROM (
                SELECT slot, done, CAST(list_position(ready, list_min(ready)) AS BIGINT) AS p
                FROM (
                    SELECT slot, done, list_transform(done, lambda d, i: CASE WHEN d * cycle // qs[i] <= slot + 1
                        THEN ((d + 1) * cycle + qs[i] - 1) // qs[i] ELSE 1::BIGINT << 60 END) AS ready
                    FROM run, lists WHERE slot + 1 < cycle
                )
            )
        ),
        slots AS (
            SELECT names[pick] AS source, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth FROM run, lists WHERE slot >= 0
        ),
        missing AS (
            SELECT min(b // q * cycle + slot) AS stop
            FROM (SELECT *, (n + {source_mix.BLOCK_ROWS - 1}) // {source_mix.BLOCK_ROWS} AS b FROM weights) JOIN slots USING (source) WHERE nth = b % q
        ),
        ranked AS (
            SELECT doc_id, source AS own, coalesce(source, '') AS source,
                   row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY CAST('0x' || h[1:4] AS INT) % {source_mix.BUCKETS}, h, doc_id) - 1 AS r
            FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)
        )
        SELECT doc_id, own AS source, r // {source_mix.BLOCK_ROWS} // q * cycle + slot AS mix_slot, r % {source_mix.BLOCK_ROWS} AS mix_place,
               r // {source_mix.BLOCK_ROWS} // q * cycle + slot < stop AS in_mix
        FROM ranked JOIN weights USING (source) JOIN slots ON slots.source = ranked.source AND nth = r // {source_mix.BLOCK_ROWS} % q, missing
    """,
    "op4_url_filter": f"""
        WITH log AS (SELECT * FROM (VALUES {_LIST_SQL}) l(rule, action, since)),
        captures AS (
            SELECT page_id, DATE '{FIRST_CAPTURE}' + CAST(page_id % {CAPTURE_DAYS} AS INT) AS fetched_at,
                   nullif(rtrim(lower(url_decode(regexp_extract(lower(trim(url)), {_quoted(url_filter.HOST)}, 1))), '.'), '') AS host
            FROM pages
        ),
        asked AS (
            SELECT page_id, fetched_at, array_to_string(labels[i:], '.') AS rule
            FROM (SELECT *, string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM captures)
            WHERE i = 1 OR NOT regexp_matches(host, {_quoted(url_filter.ADDRESS)})
        ),
        active AS (
            SELECT page_id, log.rule, action, since FROM asked ASOF JOIN log ON asked.rule = log.rule AND asked.fetched_at >= log.since
        ),
        best AS (SELECT page_id, arg_max(active, length(rule)) AS b FROM active WHERE action <> 'remove' GROUP BY page_id)
        SELECT page_id, fetched_at, host, coalesce(b.action, 'none') AS verdict, b.rule AS rule, b.since AS rule_since
        FROM captures LEFT JOIN best USING (page_id)
    """,
    "op2_exact_dedup": """
        SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
               max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        g AS (SELECT page_id, payload, strlen(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN n >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
        FROM g
    """,
    "op8_ngram_join": r"""
        WITH RECURSIVE
        w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
            FROM w
        ),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) USING (doc_id)
    """,
    "op11_conversation_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        crc AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(i))
        ),
        ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS first FROM turns),
        lent AS (
            SELECT conv_id, first, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 9 AS h
            FROM ids, crc
        ),
        rebuilt AS (
            SELECT l.conv_id, 0 AS part, t.pos, t.role, t.text FROM lent l JOIN turns t ON t.conv_id = l.first AND t.pos <= l.h
            UNION ALL
            SELECT l.conv_id, 1, t.pos, t.role, t.text FROM lent l JOIN turns t ON t.conv_id = l.conv_id AND t.pos > l.h
        ),
        paths AS (
            SELECT conv_id, coalesce(p, []) AS p, len(coalesce(p, [])) AS n
            FROM lent LEFT JOIN (SELECT conv_id, list(struct_pack(role, text) ORDER BY part, pos) AS p FROM rebuilt GROUP BY 1) USING (conv_id)
        ),
        occ AS (
            SELECT conv_id, n, d, sha256(CAST(to_json(p[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(to_json(p[1:d - 1]) AS VARCHAR)) END AS up,
                   CASE WHEN d > 0 THEN strlen(p[d].text) ELSE 0 END AS bytes
            FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM paths)
        ),
        nodes AS (
            SELECT k, any_value(up) AS up, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM occ GROUP BY k
        ),
        kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
        below AS (
            SELECT a.k, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
            FROM nodes v JOIN occ a ON a.conv_id = v.conv_id AND a.d <= v.d LEFT JOIN kids ON kids.k = v.k GROUP BY a.k
        )
        SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
               CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM nodes v LEFT JOIN nodes u ON v.up = u.k LEFT JOIN kids ON kids.k = v.k JOIN below ON below.k = v.k
    """,
    "op12_vector_codes": _codes_sql(),
    "op13_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
        ),
        firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
        hit AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (k) WHERE first < win.doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
        gaps AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
            FROM (SELECT w.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w JOIN gaps USING (doc_id)) x
            WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.i = x.i)
            GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN g IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256
        FROM w LEFT JOIN gaps USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
